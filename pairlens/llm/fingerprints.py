"""Document fingerprints by content-defined chunking.

A gear hash over the last 32 bytes marks cut points. Chunk lengths are normalised: up to NORMAL bytes a strict
mask must fit, from there on a loose one, with MIN and MAX as bounds. A fingerprint is the sorted list of the
distinct chunks' 48-bit digests with the length that they cover; inserting or removing text moves cuts only
nearby. Likeness is containment: the length in common chunks over the smaller document's length.

The next document in the order of doc_id comes without a sort in one task: rows are dealt into ranges of
doc_id, a range's first row is also dealt to the range before it, and each range is read in order.

Defined results: null and empty texts have the empty fingerprint, which is like itself (1) and unlike all others
(0); rows without doc_id stand before all others; rows of equal doc_id are in the order of a hash of their text; a
single row is its own next document; an empty table gives an empty table. Columns other than doc_id and
text are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.llm import textops as X
from pairlens.llm.common import arrow_map, map_batches, table

MIN, NORMAL, MAX = 8, 32, 128
#: Bits of the top of the gear hash that must be zero before and after the normal length.
STRICT, LOOSE = 6, 4
GEAR = (X.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(32)).astype(np.uint32)
#: Ranges of doc_id for this many rows each.
RANGE_ROWS = 4000
#: Ranges at most; a longer table has longer ranges, each read as a stream.
MAX_RANGES = 20_000
#: Documents, or code points of them, whose chunks a task holds at once; chunks take about ten times the memory of their text.
SLICE_ROWS = 200
SLICE_CHARS = 1 << 20
_HEX = 12


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """sum of GEAR[byte] << age over the last 32 bytes, by doubling."""
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16):
        h[step:] += h[:-step] << np.uint32(step)
    return h


def cuts(data: np.ndarray) -> list[int]:
    """Ends of the chunks of one text."""
    h = gear_hashes(data)
    loose = np.flatnonzero(h >> np.uint32(32 - LOOSE) == 0)
    is_strict = (h[loose] >> np.uint32(32 - STRICT) == 0).tolist()
    loose, n, out, pos, k = (loose + 1).tolist(), len(data), [], 0, 0
    last = len(loose)
    while n - pos > MIN:
        end = min(pos + MAX, n)
        while k < last and loose[k] < pos + MIN:
            k += 1
        j = k
        while j < last and loose[j] <= end:
            if is_strict[j] or loose[j] >= pos + NORMAL:
                end = loose[j]
                break
            j += 1
        out.append(end)
        pos = end
    if pos < n:
        out.append(n)
    return out


def chunks(texts: list[bytes]) -> list[dict[int, int]]:
    """Per text: digest to the length in bytes that its chunks cover."""
    out, group, size = [], [], 0
    for i, text in enumerate(texts):
        group.append(text)
        size += len(text)
        if size >= X.BLOCK_BYTES or i == len(texts) - 1:
            starts, ends, owner, base = [], [], [], 0
            for k, t in enumerate(group):
                ends_k = [base + e for e in cuts(np.frombuffer(t, np.uint8))]
                starts += [base, *ends_k[:-1]] if ends_k else []
                ends += ends_k
                owner += [k] * len(ends_k)
                base += len(t)
            found = [{} for _ in group]
            if ends:
                a, b = np.array(starts), np.array(ends)
                digests = X.span_hashes(np.frombuffer(b"".join(group), np.uint8), a, b) >> np.uint64(64 - 4 * _HEX)
                for k, d, n in zip(owner, digests.tolist(), (b - a).tolist(), strict=True):
                    found[k][d] = found[k].get(d, 0) + n
            out += found
            group, size = [], 0
    return out


def render(chunk: dict[int, int]) -> str:
    """Sorted digests, each with its length in hexadecimal: d:n,d:n."""
    return ",".join(f"{d:0{_HEX}x}:{n:x}" for d, n in sorted(chunk.items()))


def parse(fingerprint: str) -> dict[int, int]:
    return {int(d, 16): int(n, 16) for d, n in (x.split(":") for x in fingerprint.split(","))} if fingerprint else {}


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """Containment of the smaller chunk set in the larger, by length."""
    if not a or not b:
        return float(not a and not b)
    if len(a) > len(b):
        a, b = b, a
    both = sum(min(n, b[d]) for d, n in a.items() if d in b)
    return both / min(sum(a.values()), sum(b.values()))


def edited(text: str, following: str) -> str:
    """The last quarter replaced by as many first code points of the following text, or all of them."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _ranges(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows with `part` (range of doc_id) and `guest` (1 for the row after the range's last), and the number of ranges."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    n = keyed.count()
    parts = min(max(1, -(-n // RANGE_ROWS)), MAX_RANGES)
    bounds = np.array(sorted(set(keyed.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 1 / (4 * parts)))), np.int64) if parts > 1 else np.zeros(0, np.int64)

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(), "right").astype(np.int32))

    keyed = keyed.withColumn("part", part_of(F.coalesce("doc_id", F.lit(-(1 << 63)))))
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "tie")
    firsts = {r.part: r.f for r in keyed.groupBy("part").agg(F.min(order).alias("f")).collect()}
    filled = sorted(firsts)
    before = [(filled[i - 1], firsts[p].known, firsts[p].doc_id, firsts[p].tie) for i, p in enumerate(filled)]
    guests = docs.sparkSession.createDataFrame(before, "guest_of int, g_known boolean, g_id long, g_tie long")
    match = F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("tie") == F.col("g_tie"))
    lent = keyed.join(F.broadcast(guests), match).select("doc_id", "text", "tie", F.col("guest_of").alias("part"), F.lit(1).alias("guest"))
    return keyed.withColumn("guest", F.lit(0)).unionByName(lent), max(len(filled), 1)


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _report(some: list) -> pa.RecordBatch:
    """Report rows of (doc_id, text, part, following text)."""
    changed = [edited(r[1], r[3]).encode() for r in some]
    own = chunks([r[1].encode() for r in some])
    after = chunks([some[-1][3].encode()])
    new = chunks(changed)
    following = [own[k + 1] if k + 1 < len(some) and some[k + 1][1] == r[3] else chunks([r[3].encode()])[0] if k + 1 < len(some) else after[0] for k, r in enumerate(some)]
    columns = [
        [r[0] for r in some],
        [len(r[1]) for r in some],
        [hashlib.sha256(c).hexdigest() for c in changed],
        [render(c) for c in own],
        [render(c) for c in new],
        [likeness(a, b) for a, b in zip(own, new, strict=True)],
        [likeness(a, b) for a, b in zip(own, following, strict=True)],
    ]
    return table(NAMES, columns, TYPES)


def reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Report rows of the ordered rows of ranges, in slices of bounded length."""
    held = None  # the row that waits for its follower
    found, size = [], 0
    for batch in batches:
        for first in range(0, batch.num_rows, SLICE_ROWS):
            some = batch.slice(first, SLICE_ROWS)
            for doc_id, text, part, guest in zip(*(some.column(k).to_pylist() for k in (0, 1, 3, 4)), strict=True):
                text = text or ""
                if held and held[2] == part:
                    found.append((*held, text))
                    size += len(held[1])
                held = None if guest else (doc_id, text, part)
                if len(found) >= SLICE_ROWS or size >= SLICE_CHARS:
                    yield _report(found)
                    found, size = [], 0
    if found:
        yield _report(found)


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows, parts = _ranges(docs)
    rows = rows.repartition(parts, "part").sortWithinPartitions("part", "guest", F.col("doc_id").asc_nulls_first(), "tie")
    return arrow_map(rows, reports, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row, without neighbours."""
    def build():
        def work(batch):
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            yield table(["doc_id", "fingerprint"], [batch.column(0).to_pylist(), [render(c) for c in chunks(texts)]], [pa.int64(), pa.string()])

        return work

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), build, "doc_id long, fingerprint string")
