"""Cross-tokenizer alignment: the groups of tokens that two tokenizers cut at the same bytes, and the id pairs they link.

A byte-level BPE model (A) encodes space + text, a SentencePiece BPE model (B, which adds the space) the text. Both
lists of cumulative byte ends go into dictionaries from end to index; the common keys, sorted, slice both id lists
into groups. Every A id of a group is linked to every B id of it.

1. A map aligns the texts. Neither model has a piece with a single space between other characters (checked when they are
   loaded), so a text may be cut at every single space between two other characters, and such a space is a common
   end of both. Each distinct unit between cuts is aligned once per task (about CACHE of them are kept).
   The result, one row per document with its distinct pairs and how often it links them, is written once.
2. Pairs are counted over all documents, one per document; the highest count of each A id marks its best pairs.
3. A second map adds up the counts of the pairs of each document. Frequent pairs go to it as a table of at most
   HEAD rows (broadcast), which also takes the hot keys; the rest is joined by shuffle and summed.

Defined results: null and empty texts have no tokens; neither have texts that a model does not give back byte by byte
(then all numbers are 0 and the digest of the groups is ''); repeated rows are documents of their own and count each; rows
without doc_id count as well; texts are read whole; an empty table gives an empty table. Columns other than doc_id and
text are never read.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.llm.common import map_batches
from pairlens.session import written

#: Rows of the table of frequent pairs, at most.
HEAD = 1 << 18
#: Units kept per task, and units that are encoded together.
CACHE, CHUNK = 200_000, 1000
#: Bytes of text whose pairs are summed together.
BLOCK = 1 << 21
MARK = "▁"
_CUT = re.compile(r"(?<=\S) (?=\S)")
_models: dict[tuple[str, str], Aligner] = {}


def byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def common_slices(ends_a: list[int], ends_b: list[int]) -> tuple[list[int], list[int], list[int]]:
    """The common ends in order, and for each the end of its group in a and in b."""
    at_a = dict(zip(ends_a, range(1, len(ends_a) + 1), strict=True))
    at_b = dict(zip(ends_b, range(1, len(ends_b) + 1), strict=True))
    common = sorted(at_a.keys() & at_b.keys())
    return common, list(map(at_a.__getitem__, common)), list(map(at_b.__getitem__, common))


class Aligner:
    """Two tokenizers and the alignments of the units of text seen last."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        table = byte_characters()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
            if _CUT.search(self.bytes_a[i].decode(errors="ignore")):
                raise ValueError(f"{path_a}: token {token!r} holds a space between other characters")
        self.bytes_b = [self._piece(i, path_b) for i in range(self.b.get_piece_size())]
        if len(self.b.encode("a  b")) < 3:
            raise ValueError(f"{path_b}: white space is not kept as it is")
        self.lengths_a, self.lengths_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        # ids as they are listed: followed by "," inside a group, by "|" behind A's last, by ";" or a line feed behind B's last
        self.listed = [str(i) + c for c, n in ((",", len(self.bytes_a)), ("|", len(self.bytes_a)), (",", len(self.bytes_b)), (";", len(self.bytes_b)), ("\n", len(self.bytes_b))) for i in range(n)]
        self.kept: dict[str, tuple] = {}
        self.fresh: dict[str, tuple] = {}

    def _piece(self, i: int, path: str) -> bytes:
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[1:-1], 16)])
        piece = self.b.id_to_piece(i)
        if _CUT.search(piece.replace(MARK, " ")):
            raise ValueError(f"{path}: piece {piece!r} holds a space between other characters")
        return piece.replace(MARK, " ").encode()

    def align(self, units: list[str]) -> list[tuple]:
        """(numbers of A and B tokens, groups and links; pairs; group text) of every unit, as it stands in a text; () if its bytes are not given back.

        Numbers and pairs are the bytes of 64-bit integers, so that many units are put together at once.
        """
        text = " " + " ".join(units)
        ids_a, ids_b = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.b.encode(text[1:])
        parts = list(map(str.encode, units))
        raw = b" " + b" ".join(parts)
        if b"".join(map(self.bytes_a.__getitem__, ids_a)) != raw or b"".join(map(self.bytes_b.__getitem__, ids_b)) != raw:
            return [()] if len(units) == 1 else [x for u in units for x in self.align([u])]
        edges = np.cumsum(np.fromiter(map(len, parts), np.int64) + 1)
        ids_a, ids_b = np.array(ids_a), np.array(ids_b)
        common, ends_a, ends_b = common_slices(np.cumsum(self.lengths_a[ids_a]).tolist(), np.cumsum(self.lengths_b[ids_b]).tolist())
        last = np.searchsorted(common, edges)  # the last group of every unit
        n_a, n_b = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
        first_a, first_b = np.array(ends_a) - n_a, np.array(ends_b) - n_b

        links = n_a * n_b
        ends = np.cumsum(links)
        group = np.repeat(np.arange(len(links)), links)
        place = np.arange(len(group)) - (ends - links)[group]
        pairs = ids_a[first_a[group] + place // n_b[group]] * len(self.bytes_b) + ids_b[first_b[group] + place % n_b[group]]

        closing = np.full(len(links), 3 * len(self.bytes_b))  # of the groups: ";", and a line feed behind a unit's last
        closing[last] += len(self.bytes_b)
        codes = np.empty(len(ids_a) + len(ids_b), np.int64)
        a_last, b_last = np.array(ends_a) - 1, np.array(ends_b) - 1
        listed_a, listed_b = ids_a.copy(), ids_b + 2 * len(self.bytes_a)
        listed_a[a_last] += len(self.bytes_a)
        listed_b[b_last] += closing - 2 * len(self.bytes_b)
        codes[np.arange(len(ids_a)) + np.repeat(first_b, n_a)] = listed_a
        codes[np.arange(len(ids_b)) + np.repeat(ends_a, n_b)] = listed_b
        texts = "".join(map(self.listed.__getitem__, codes.tolist())).split("\n")

        totals = np.stack([np.array(ends_a)[last], np.array(ends_b)[last], last + 1, ends[last]], axis=1)
        numbers = np.diff(totals, axis=0, prepend=0).astype(np.int64).tobytes()
        raw_pairs, cuts = pairs.astype(np.int64).tobytes(), [0, *(8 * ends[last]).tolist()]
        return [(numbers[32 * k : 32 * k + 32], raw_pairs[cuts[k] : cuts[k + 1]], texts[k]) for k in range(len(units))]

    def known(self, units: list[str]) -> list[tuple]:
        """The alignments of distinct units. Up to CACHE units seen in several calls are kept, and as many seen in one."""
        kept, fresh = self.kept, self.fresh
        for some in (kept, fresh):
            if len(some) > CACHE:
                some.clear()
        for u in [u for u in units if u in fresh]:
            kept[u] = fresh.pop(u)
        missing = [u for u in units if u not in kept]
        # white space at a unit's end would join the next unit's space
        alone = [u for u in missing if u[-1:].isspace()]
        joined = [u for u in missing if not u[-1:].isspace()] if alone else missing
        for some in [joined[k : k + CHUNK] for k in range(0, len(joined), CHUNK)] + [[u] for u in alone]:
            fresh.update(zip(some, self.align(some), strict=True))
        return [kept[u] if u in kept else fresh[u] for u in units]


def aligner(path_a: str, path_b: str) -> Aligner:
    """The models of two files on this worker."""
    if (path_a, path_b) not in _models:
        _models[path_a, path_b] = Aligner(path_a, path_b)
    return _models[path_a, path_b]


def _block(model: Aligner, texts: list[str]) -> Iterator[tuple]:
    """(n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of every text; the texts of one block share their sums."""
    units = [_CUT.split(t) if t else [] for t in texts]
    at = dict.fromkeys(chain.from_iterable(units))
    found = model.known(list(at))
    at = dict(zip(at, range(len(at)), strict=True))
    if () in found:  # for texts with such units the whole text decides
        for i, us in enumerate(units):
            if any(not found[at[u]] for u in us):
                whole = model.align([texts[i]])
                units[i] = [texts[i]] if whole[0] else []
                at[texts[i]] = len(found)
                found += whole
    found = [f or (bytes(32), b"", "") for f in found]
    flat = np.fromiter(map(at.__getitem__, chain.from_iterable(units)), np.int64)
    numbers = np.frombuffer(b"".join([f[0] for f in found]), np.int64).reshape(-1, 4)
    pairs = np.frombuffer(b"".join([f[1] for f in found]), np.int64)
    listed = [f[2] for f in found]
    cuts = np.concatenate([[0], np.cumsum([len(us) for us in units])])
    owner = np.repeat(np.arange(len(texts)), np.diff(cuts))
    total = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(numbers[flat], axis=0)])
    total = total[cuts[1:]] - total[cuts[:-1]]
    starts = np.cumsum(numbers[:, 3]) - numbers[:, 3]
    counts = numbers[flat, 3]
    place = np.repeat(starts[flat] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    span = int(pairs.max()) + 1 if len(pairs) else 1
    keys, times = np.unique(np.repeat(owner, counts) * span + pairs[place], return_counts=True)
    edges = np.searchsorted(keys, np.arange(len(texts) + 1) * span)
    places = flat.tolist()
    for i, us in enumerate(units):
        part = slice(edges[i], edges[i + 1])
        digest = hashlib.sha256(";".join([listed[k] for k in places[cuts[i] : cuts[i + 1]]]).encode()).hexdigest() if us else ""
        yield *total[i].tolist(), digest, keys[part] - i * span, times[part].astype(np.int32)


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    cuts = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(arrays), kind))


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of every row; a pair is A id * pieces of B + B id."""

    def build():
        model, row = aligner(path_a, path_b), TaskContext.get().partitionId() << 36

        def work(batch):
            nonlocal row
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            first = 0
            while first < len(texts):
                end, size = first + 1, len(texts[first])
                while end < len(texts) and size + len(texts[end]) <= BLOCK:
                    size, end = size + len(texts[end]), end + 1
                gc.disable()  # nothing here makes cycles, and a collection would walk the kept units each time
                try:
                    n_a, n_b, groups, links, digests, pairs, times = zip(*_block(model, texts[first:end]), strict=True)
                finally:
                    gc.enable()
                numbers = [pa.array(x, pa.int64()) for x in (range(row, row + end - first), n_a, n_b, groups, links)]
                yield pa.RecordBatch.from_arrays(
                    [numbers[0], ids[first:end], *numbers[1:], pa.array(digests, pa.string()), _lists(pairs, pa.int64()), _lists(times, pa.int32())],
                    names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
                )
                row, first = row + end - first, end

        return work

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(rows, build, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>")


def pair_counts(rows: DataFrame, pieces_b: int) -> DataFrame:
    """(pair, docs, best): documents that link the pair; best if no pair of its A id has more."""
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs"))
    counts = written(counts.withColumn("a", F.floor(F.col("pair") / pieces_b)), "link_counts")
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))
    return written(counts.join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")), "best_links")


def _head(counts: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted pairs, counts and best marks of the pairs above the lowest power of two that at most `rows` of them reach."""
    levels = counts.groupBy(F.floor(F.log2("docs")).cast("int").alias("level")).count().collect()
    total, least = 0, None
    for row in sorted(levels, reverse=True):
        total += row["count"]
        if total > rows:
            break
        least = row.level
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = counts.where(F.col("docs") >= 2**least).toArrow().sort_by("pair")
    return tuple(found[c].cast(pa.int64()).to_numpy() for c in ("pair", "docs", "best"))


def _sums(rows: DataFrame, head: tuple) -> DataFrame:
    """Rows (row, best_links, count_links) with the head's sums, and rows (row, pair, times) of rarer pairs."""
    shared = rows.sparkSession.sparkContext.broadcast(head)

    def build():
        names, docs, best = shared.value

        def work(batch):
            lists = batch.column(1)
            pairs, times = lists.flatten().to_numpy(), batch.column(2).flatten().to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            place = np.minimum(np.searchsorted(names, pairs), max(len(names) - 1, 0))
            known = names[place] == pairs if len(names) else np.zeros(len(pairs), bool)
            sums = np.zeros((2, batch.num_rows), np.int64)
            for out, value in zip(sums, (best, docs), strict=True):
                np.add.at(out, owner[known], times[known] * value[place[known]])
            rest, all_rows = np.flatnonzero(~known), batch.column(0).to_numpy()
            none, empty = pa.nulls(len(rest), pa.int64()), pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([all_rows, all_rows[owner[rest]]])),
                    pa.concat_arrays([pa.array(sums[0]), none]), pa.concat_arrays([pa.array(sums[1]), none]),
                    pa.concat_arrays([empty, pa.array(pairs[rest])]), pa.concat_arrays([empty, pa.array(times[rest])]),
                ],
                names=["row", "best_links", "count_links", "pair", "times"],
            )

        return work

    return map_batches(rows.select("row", "pairs", "times"), build, "row long, best_links long, count_links long, pair long, times long")


def alignment_report(docs: DataFrame, path_a: str, path_b: str, head_rows: int = HEAD) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best (links of a best pair), count_sum (counts over links), groups_sha256."""
    rows = written(aligned(docs, path_a, path_b), "alignments")
    counts = pair_counts(rows, len(aligner(path_a, path_b).bytes_b))
    parts = _sums(rows, _head(counts, head_rows)).join(counts, "pair", "left")
    rare = F.col("pair").isNotNull()
    sums = parts.groupBy("row").agg(
        F.sum(F.when(rare, F.col("times") * F.col("best").cast("long")).otherwise(F.col("best_links"))).alias("n_best"),
        F.sum(F.when(rare, F.col("times") * F.col("docs")).otherwise(F.col("count_links"))).alias("count_sum"),
    )
    return rows.join(sums, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
