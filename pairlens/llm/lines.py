"""Removal of lines that many documents share, by two Bloom filters and an exact check of the suspects.

A first map sets, for the key of every line, two bits of a filter of once-seen hashes; a bit that is set
again is set in the filter of twice-seen hashes. Filters are cut into chunks of hash range, so that the
partial results meet chunk by chunk, in tasks of bounded memory. A second map asks the twice-seen filter
(broadcast, at most MAX_BITS / 8 bytes): only lines that may be repeats are shuffled, as (digest, doc_id),
for the exact count and the choice of the document that keeps them. A full filter only means more suspects,
up to all lines, never a wrong result.

Defined results: null and empty texts are one empty line; a line's key has white space stripped and A-Z
lower-cased; repeated rows of one doc_id are one document; rows without doc_id neither count nor lose
lines; of documents that share a line, the largest doc_id keeps it. Columns other than doc_id and text pass
unchanged and are never read. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.llm import textops as X
from pairlens.llm.common import arrow_map, free_name, join_hot, map_batches, split_by_keys, table
from pairlens.session import written

MIN_CHARS = 20
MIN_DOCS = 3
BITS_PER_LINE = 16
MIN_BITS, MAX_BITS = 1 << 16, 1 << 28
CHUNKS = 64
_STRIP = X.WHITE.encode()


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """Key of a UTF-8 line, or None if it is too short to count."""
    key = line.strip(_STRIP)
    if len(key) < min_chars or not key.isascii() and len(key.decode()) < min_chars:
        return None
    return key.lower()


def _texts(column: pa.Array) -> list[bytes]:
    data, offsets = X.text_buffer(column)
    data = data.tobytes()
    return [data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _keys(text: bytes, min_chars: int) -> set[bytes]:
    return {k for line in text.split(b"\n") if (k := line_key(line, min_chars)) is not None}


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Chunk of every hash, and its two places inside the chunk (one row each)."""
    size = np.uint64(bits // CHUNKS)
    chunk = hashes >> np.uint64(58)
    return chunk.astype(np.int64), np.stack([(hashes & np.uint64(0xFFFFFFF)) % size, (hashes >> np.uint64(29) & np.uint64(0xFFFFFFF)) % size]).astype(np.uint32)


def _hashes(keys) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64)


def twice_seen(docs: DataFrame, min_chars: int, bits: int) -> np.ndarray:
    """The filter of twice-seen hashes as packed bits, one row per chunk."""

    def build():
        def work(batch):
            per_doc = [_hashes(_keys(t, min_chars)) for t in _texts(batch.column(0))]
            chunk, places = _places(np.concatenate(per_doc), bits)
            order = np.argsort(chunk, kind="stable")
            cuts = np.searchsorted(chunk[order], np.arange(CHUNKS + 1))
            found = [c for c in range(CHUNKS) if cuts[c] < cuts[c + 1]]
            yield table(["chunk", "places"], [found, [np.concatenate([p[order[cuts[c] : cuts[c + 1]]] for p in places]).tobytes() for c in found]], [pa.int32(), pa.binary()])

        return work

    def merge(batches):
        chunk, once, twice = None, None, None
        for batch in batches:
            for c, places in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if c != chunk:
                    if chunk is not None:
                        yield table(["chunk", "twice"], [[chunk], [np.packbits(twice).tobytes()]], [pa.int32(), pa.binary()])
                    chunk, once, twice = c, np.zeros(bits // CHUNKS, bool), np.zeros(bits // CHUNKS, bool)
                found, times = np.unique(np.frombuffer(places.as_buffer(), np.uint32), return_counts=True)
                twice[found[once[found] | (times > 1)]] = True
                once[found] = True
        if chunk is not None:
            yield table(["chunk", "twice"], [[chunk], [np.packbits(twice).tobytes()]], [pa.int32(), pa.binary()])

    parts = map_batches(docs.select("text"), build, "chunk int, places binary")
    merged = arrow_map(parts.repartition(CHUNKS, "chunk").sortWithinPartitions("chunk"), merge, "chunk int, twice binary")
    out = np.zeros((CHUNKS, bits // CHUNKS // 8), np.uint8)
    for row in merged.collect():
        out[row.chunk] = np.frombuffer(row.twice, np.uint8)
    return out


def filter_bits(docs: DataFrame, max_bits: int = MAX_BITS) -> int:
    lines = docs.select(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)).first()[0] or 0
    return int(min(max(1 << (BITS_PER_LINE * lines).bit_length(), MIN_BITS), max_bits))


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def suspects(docs: DataFrame, min_chars: int, bits: int) -> DataFrame:
    """(digest, doc_id) of the lines whose hash the twice-seen filter holds, once per task and document."""
    shared = docs.sparkSession.sparkContext.broadcast(twice_seen(docs, min_chars, bits))

    def build():
        twice = shared.value

        def work(batch):
            digests, ids = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), strict=True):
                keys = list(_keys(text, min_chars))
                if keys:
                    chunk, places = _places(_hashes(keys), bits)
                    hit = np.ones(len(keys), bool)
                    for p in places:
                        hit &= (twice[chunk, p >> np.uint32(3)] >> (7 - (p & np.uint32(7))).astype(np.uint8) & 1).astype(bool)
                    digests += [digest(keys[i]) for i in np.flatnonzero(hit)]
                    ids += [doc_id] * int(hit.sum())
            yield table(["digest", "doc_id"], [digests, ids], [pa.binary(), pa.int64()])

        return work

    return map_batches(docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), build, "digest binary, doc_id long")


def with_drops(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, max_bits: int = MAX_BITS) -> DataFrame:
    """docs and a last column: the digests of the lines that the row loses (null if none)."""
    found = written(suspects(docs, min_chars, filter_bits(docs, max_bits)).distinct(), "suspect_lines")
    confirmed = written(
        found.groupBy("digest").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs), "shared_lines"
    )
    lost = join_hot(found, confirmed, ["digest"], "n", "inner").where("doc_id < keeper")
    key, digests = free_name(docs, "line_doc"), free_name(docs, "line_digests")
    drops = written(lost.groupBy(F.col("doc_id").alias(key)).agg(F.collect_set("digest").alias(digests)), "dropped_lines")
    maybe, rest = split_by_keys(docs, "doc_id", drops.select(key))
    touched = maybe.join(drops, F.col("doc_id") == F.col(key), "left").drop(key)
    return touched.unionByName(rest.withColumn(digests, F.lit(None).cast("array<binary>")))


def _kept(text: bytes, drops: list | None, min_chars: int) -> tuple[bytes, int, int]:
    """Remaining text, lines before, lines dropped."""
    if not drops:
        return text, text.count(b"\n") + 1, 0
    gone = set(drops)
    lines = text.split(b"\n")
    kept = [x for x in lines if (k := line_key(x, min_chars)) is None or digest(k) not in gone]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def line_report(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, max_bits: int = MAX_BITS) -> DataFrame:
    """Per row: doc_id, n_lines, n_dropped, kept_sha256."""

    def build():
        def work(batch):
            rows = [_kept(t, d, min_chars) for t, d in zip(_texts(batch.column(1)), batch.column(2).to_pylist(), strict=True)]
            yield table(
                ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
                [batch.column(0).to_pylist(), [r[1] for r in rows], [r[2] for r in rows], [hashlib.sha256(r[0]).hexdigest() for r in rows]],
                [pa.int64(), pa.int64(), pa.int64(), pa.string()],
            )

        return work

    rows = with_drops(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), min_chars, min_docs, max_bits)
    return map_batches(rows, build, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, max_bits: int = MAX_BITS) -> DataFrame:
    """docs with shared lines removed from `text`; a column n_chars follows the new text."""
    names = docs.columns
    at = names.index("text")

    def build():
        def work(batch):
            drops = batch.column(len(names)).to_pylist()
            if any(drops):
                column = batch.column(at)
                texts = [t if not d else _kept(t.encode(), d, min_chars)[0].decode() for t, d in zip(column.to_pylist(), drops, strict=True)]
                batch = batch.set_column(at, names[at], pa.array(texts, column.type))
            yield batch.select(range(len(names)))

        return work

    out = map_batches(with_drops(docs, min_chars, min_docs, max_bits), build, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in names else out
