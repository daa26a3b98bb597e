"""Token counts of a SentencePiece BPE model without tokenising documents.

The model merges no pieces across a pre-token's edge: a pre-token is a run of spaces with the text that
follows it up to the next space, and a line feed is one of its own. That holds if no piece has a space mark
behind another character and none holds a line feed, which is checked when the model is loaded. So a text's
count is the sum of its pre-tokens' counts.

1. A map counts pre-tokens (by 64-bit hash) over all texts; they are summed per distinct pre-token. Strings are compared
   on the way: should several share a hash (about n * n / 2**65 of n distinct ones do), the documents count those by string.
2. The pieces of each distinct pre-token are counted once.
3. A second map makes every document's pre-token frequencies. Pre-tokens that occur often go to it as a table of
   at most HEAD rows (broadcast), which also takes the hot keys; the rest is joined by shuffle and summed.

Defined results: null and empty texts have no tokens; repeated rows are counted each; special strings in a
text are ordinary text; texts of any length are read whole; an empty table gives an empty table. Columns other than
doc_id and text are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.llm import textops as X
from pairlens.llm.common import map_batches, table
from pairlens.session import written

#: Rows of the table of frequent pre-tokens, at most.
HEAD = 1 << 18
MARK = "▁"
_processors: dict[str, object] = {}


def processor(path: str):
    """The model of a file on this worker, after a check of the rule above."""
    if path not in _processors:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
                piece = model.id_to_piece(i)
                if MARK in piece.lstrip(MARK) or "\n" in piece:
                    raise ValueError(f"{path}: piece {piece!r} crosses pre-tokens")
        if len(model.encode("\n")) != 2 or len(model.encode("a  b")) < 3:
            raise ValueError(f"{path}: white space is not kept as it is")
        _processors[path] = model
    return _processors[path]


def count_pieces(path: str, pretokens: list[str]) -> list[int]:
    """Pieces of every pre-token where it stands in a text: behind a line feed, whose two pieces are taken off."""
    return [len(ids) - 2 for ids in processor(path).encode(["\n" + t for t in pretokens], num_threads=1)]


def _marked(texts: pa.Array) -> pa.Array:
    """Texts with the space that the model puts in front, and spaces for space marks; empty ones stay empty."""
    import pyarrow.compute as pc

    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.replace_substring(pc.fill_null(texts, ""), MARK, " ")
    front = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", " ")
    return pc.binary_join_element_wise(front, texts, "")


def pretokens(data: np.ndarray, offsets: np.ndarray, hash_bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the pre-tokens of marked texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    space, feed = data == 32, data == 10
    begin = feed.copy()
    begin[1:] |= feed[:-1] | (space[1:] & ~space[:-1])
    begin[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], len(data))
    return starts, ends, X.strong_hashes(data, starts, ends) >> np.uint64(64 - hash_bits)


def _differs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether each span differs from the span `first` (its place in starts), byte by byte."""
    n = ends - starts
    out = n != n[first]
    same = np.flatnonzero(~out & (first != np.arange(len(first))))
    sizes = n[same]
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    unequal = data[np.repeat(starts[same], sizes) + place] != data[np.repeat(starts[first[same]], sizes) + place]
    out[np.repeat(same, sizes)[unequal]] = True
    return out


def _vocabulary(docs: DataFrame, hash_bits: int) -> DataFrame:
    """(hash, pretoken, other, freq) of all texts: the least and the greatest string with this hash."""

    def build():
        def work(batch):
            for _, _, data, offsets in X.blocks(_marked(batch.column(0))):
                starts, ends, hashes = pretokens(data, offsets, hash_bits)
                names, at, back, times = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
                raw = data.tobytes()
                strings = [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
                others = [None] * len(strings)
                for k in np.flatnonzero(_differs(data, starts, ends, at[back])).tolist():
                    others[back[k]] = raw[starts[k] : ends[k]]
                columns = [pa.array(X.signed(names)), *(pa.array(s, pa.binary()).cast(pa.string()) for s in (strings, others)), pa.array(times.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["hash", "pretoken", "other", "freq"])

        return work

    parts = map_batches(docs.select("text"), build, "hash long, pretoken string, other string, freq long")
    least, most = F.min(F.least("pretoken", "other")), F.max(F.greatest("pretoken", "other"))
    return parts.groupBy("hash").agg(least.alias("pretoken"), most.alias("other"), F.sum("freq").alias("freq"))


def _counted(vocabulary: DataFrame, path: str) -> DataFrame:
    """(hash, freq, pieces); pieces are null where strings share the hash."""

    def build():
        def work(batch):
            counts = count_pieces(path, batch.column(1).to_pylist())
            counts = [n if one else None for n, one in zip(counts, batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int32())], names=["hash", "freq", "pieces"])

        return work

    return map_batches(vocabulary.select("hash", "pretoken", "freq", F.col("pretoken") == F.col("other")), build, "hash long, freq long, pieces int")


def _head(counted: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of the pre-tokens above the lowest power of two that at most `rows` of them reach."""
    level = F.floor(F.log2("freq")).cast("int").alias("level")
    levels = sorted(counted.groupBy(level).count().collect(), reverse=True)
    total, least = 0, None
    for row in levels:
        total += row["count"]
        if total > rows:
            break
        least = row.level
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    found = counted.where(F.col("freq") >= 2**least).where("pieces IS NOT NULL").select("hash", "pieces").toArrow()
    hashes, pieces = X.unsigned(found["hash"].to_numpy()), found["pieces"].to_numpy().astype(np.int64)
    order = np.argsort(hashes)
    return hashes[order], pieces[order]


def _frequencies(docs: DataFrame, head: tuple[np.ndarray, np.ndarray], clashes: np.ndarray, path: str, hash_bits: int) -> DataFrame:
    """Rows (doc_id, row_hash, hash, freq) of rarer pre-tokens; rows with n_bytes and the head's sum, one per document.

    Pre-tokens whose hash is among the clashes are counted here, by their strings.
    """
    shared = docs.sparkSession.sparkContext.broadcast((*head, clashes))

    def build():
        names, pieces, clashes = shared.value

        def work(batch):
            ids, keys = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            valid = np.array(batch.column(0).is_valid())
            ids = np.where(valid, np.nan_to_num(ids), 0).astype(np.int64) if not valid.all() else ids
            lengths = np.diff(X.text_buffer(batch.column(2))[1])
            for first, end, data, offsets in X.blocks(_marked(batch.column(2))):
                starts, ends, hashes = pretokens(data, offsets, hash_bits)
                owner = np.searchsorted(offsets, starts, "right") - 1
                distinct, back = np.unique(hashes, return_inverse=True)
                place = np.minimum(np.searchsorted(names, distinct), max(len(names) - 1, 0))
                known = names[place] == distinct if len(names) else np.zeros(len(distinct), bool)
                count = np.where(known, pieces[place], 0) if len(names) else np.zeros(len(distinct), np.int64)
                sums = np.bincount(owner, count[back], end - first).astype(np.int64)
                if len(clashes):
                    odd = np.isin(distinct, clashes)
                    raw, at = data.tobytes(), np.flatnonzero(odd[back])
                    own = count_pieces(path, [raw[starts[k] : ends[k]].decode() for k in at.tolist()])
                    np.add.at(sums, owner[at], np.array(own, np.int64))
                    known = known | odd
                rare = np.flatnonzero(~known[back])
                pairs, times = np.unique(owner[rare] * len(distinct) + back[rare], return_counts=True)
                doc, which = np.divmod(pairs, max(len(distinct), 1))
                rows = np.concatenate([np.arange(end - first), doc]) + first
                none = pa.nulls(len(doc), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[rows], mask=~valid[rows]),
                        pa.array(keys[rows]),
                        pa.array(np.concatenate([X.signed(X.mix(X.unsigned(keys[first:end]))), X.signed(distinct)[which]])),
                        pa.array(np.concatenate([np.ones(end - first, np.int64), times])),
                        pa.concat_arrays([pa.array(lengths[first:end].astype(np.int64)), none]),
                        pa.concat_arrays([pa.array(sums), none]),
                    ],
                    names=["doc_id", "row_hash", "hash", "freq", "n_bytes", "head"],
                )

        return work

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row_hash"), "text")
    return map_batches(rows, build, "doc_id long, row_hash long, hash long, freq long, n_bytes long, head long")


def token_counts(docs: DataFrame, model_path: str, head_rows: int = HEAD, hash_bits: int = 64) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row; fewer hash bits only make more clashes, for tests."""
    counted = written(_counted(_vocabulary(docs, hash_bits), model_path), "piece_counts")
    clashes = X.unsigned(counted.where("pieces IS NULL").select("hash").toArrow()["hash"].to_numpy())
    rows = _frequencies(docs, _head(counted, head_rows), clashes, model_path, hash_bits)
    tokens = F.when(F.col("n_bytes").isNotNull(), F.col("head")).otherwise(F.col("freq") * F.col("pieces"))
    joined = rows.join(counted.select("hash", "pieces"), "hash", "left")
    # equal rows give equal pre-tokens, so their sum is shared among them
    sums = joined.groupBy("doc_id", "row_hash").agg(F.max("n_bytes").alias("n_bytes"), F.sum(tokens).alias("tokens"), F.count("n_bytes").alias("times"))
    each = sums.select("doc_id", "n_bytes", F.expr("tokens DIV times").alias("n_tokens"), F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int"))).alias("_"))
    return each.drop("_")
