"""Benchmark decontamination with spaced seeds.

A seed is the hash of the words that a fixed mask selects from a window, so a changed word at an ignored
place leaves it equal. Seeds of the benchmark make a Bloom filter (at most MAX_BITS / 8 bytes, broadcast);
a map over the documents keeps the windows around places whose seed the filter may hold. Only these are
shuffled: seeds meet in an equi-join, and each (window, item, diagonal) is verified once: sums along the
diagonal give its best run without gaps.

An overlap counts if a run of words on one diagonal has at least min(MIN_WORDS, words of the item) words of
which SHARE agree. Words are compared lower-cased (A-Z) and without ASCII punctuation.

The masks miss nothing that counts: of every run of MIN_WORDS words or more of which SHARE agree, one of MASKS reads
only words that agree (test_masks_cover_every_run tries all of them), and a shorter item has masks of its own.

Defined results: null and empty texts and items match nothing; items of less than MIN_WORDS words are sought whole;
equal items are sought once and reported for every item_id; a repeated row is reported once;
without documents or benchmark the result is empty. Columns other than doc_id, text (documents) and item_id, text (benchmark)
are never read.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.llm import textops as X
from pairlens.llm.common import free_name, map_batches, split_by_keys, table
from pairlens.session import written

#: Fixed masks: the places of a window that a seed reads. A run of 26 words or more has a half of at least 13 that agrees as well,
#: so that they cover 13 words with 2 changed, 15 with 3, 20 with 4 and 25 with 5 is enough for runs of any length.
MASKS = ("11101111", "1111010011", "1110101011", "1100011111", "11111011", "11011111", "1111100101", "101111011")
MIN_WORDS = 13
SHARE = 0.8
MIN_BITS, MAX_BITS = 1 << 16, 1 << 27
#: Copies of the benchmark's seeds and items, so that one that a third of all documents holds is split.
SALTS = 16
_PLACES = tuple(np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def mask_seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    """Seed of every window of the mask's length."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return hashes[:0]
    seeds = X.sequence_hash([hashes[i : i + n] for i, c in enumerate(mask) if c == "1"])
    return X.mix(seeds + np.uint64(int("1" + mask, 2)))


def item_masks(n_words: int, share: float = SHARE) -> tuple[str, ...]:
    """Masks of an item. One of less than MIN_WORDS words, of which k may change, is cut in k + 3 parts; each mask leaves out k of them."""
    if n_words >= MIN_WORDS:
        return MASKS
    k = next(k for k in range(n_words, -1, -1) if n_words - k >= share * n_words)
    parts = min(n_words, k + 3)
    return tuple("".join("0" if i * parts // n_words in out else "1" for i in range(n_words)) for out in combinations(range(parts), k))


def filter_places(seeds: np.ndarray, bits: int) -> list[np.ndarray]:
    shift = np.uint64(64 - (bits.bit_length() - 1))
    return [(seeds * k) >> shift for k in _PLACES]


def _item_rows(benchmark: DataFrame) -> DataFrame:
    """(item_id, content, words): content is a hash of all words, words their hashes."""

    def build():
        def work(batch):
            ids, contents, arrays = [], [], []
            for first, end, data, offsets in X.blocks(batch.column(1)):
                words = X.Words(data, offsets, X.PUNCTUATION)
                for i in range(end - first):
                    h = words.hashes[words.bounds[i] : words.bounds[i + 1]]
                    if len(h):
                        ids.append(batch.column(0)[first + i].as_py())
                        powers = np.cumprod(np.full(len(h), X.BASE, np.uint64))
                        contents.append(int(X.signed(X.mix(np.array([(h * powers).sum(dtype=np.uint64) + np.uint64(len(h))])))[0]))
                        arrays.append(h.tobytes())
            yield table(["item_id", "content", "words"], [ids, contents, arrays], [pa.int64(), pa.int64(), pa.binary()])

        return work

    return map_batches(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text"), build, "item_id long, content long, words binary")


def _item_seeds(items: DataFrame, share: float) -> DataFrame:
    """(seed, content, item_pos) of distinct contents."""

    def build():
        def work(batch):
            seeds, contents, places = [], [], []
            for content, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = np.frombuffer(words, np.uint64)
                for mask in item_masks(len(h), share):
                    s = mask_seeds(h, mask)
                    seeds += X.signed(s).tolist()
                    contents += [content] * len(s)
                    places += range(len(s))
            yield table(["seed", "content", "item_pos"], [seeds, contents, places], [pa.int64(), pa.int64(), pa.int32()])

        return work

    return map_batches(items.select("content", "words"), build, "seed long, content long, item_pos int")


def _bloom(seeds: DataFrame, bits: int) -> np.ndarray:
    """Packed bits of a Bloom filter with four places per seed; comes to the driver as at most bits / 64 words."""

    def build():
        def work(batch):
            places = np.unique(np.concatenate(filter_places(X.unsigned(batch.column(0).to_numpy()), bits)))
            yield table(["word", "mask"], [(places >> np.uint64(6)).astype(np.int64), X.signed(np.uint64(1) << (places & np.uint64(63)))], [pa.int64(), pa.int64()])

        return work

    words = map_batches(seeds.select("seed").distinct(), build, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask"))
    out = np.zeros(bits // 64, np.uint64)
    for row in words.collect():
        out[row.word] = row.mask % (1 << 64)
    return out


def _windows(docs: DataFrame, bloom: np.ndarray, masks: list[str], reach: int) -> DataFrame:
    """(row_key, doc_id, start, words, seeds, places): stretches of documents around places that may hold a seed."""
    shared = docs.sparkSession.sparkContext.broadcast(bloom)
    bits = len(bloom) * 64

    def build():
        filled = shared.value

        def work(batch):
            rows = []
            for first, _, data, offsets in X.blocks(batch.column(2)):
                words = X.Words(data, offsets, X.PUNCTUATION)
                owner = np.repeat(np.arange(len(offsets) - 1), np.diff(words.bounds))
                at, found, ends = [], [], []
                for mask in masks:
                    s = mask_seeds(words.hashes, mask)
                    near = np.flatnonzero(owner[: len(s)] == owner[len(mask) - 1 :]) if len(s) else np.zeros(0, np.int64)
                    s = s[near]
                    for k in range(len(_PLACES)):
                        p = filter_places_one(s, bits, k)
                        ok = (filled[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
                        s, near = s[ok], near[ok]
                    at.append(near)
                    found.append(s)
                    ends.append(near + len(mask))
                at, found, ends = np.concatenate(at), np.concatenate(found), np.concatenate(ends)
                order = np.argsort(at, kind="stable")
                at, found, ends = at[order], found[order], ends[order]
                i = 0
                while i < len(at):
                    doc = owner[at[i]]
                    lo, hi = words.bounds[doc], words.bounds[doc + 1]
                    start, stop, j = max(at[i] - reach, lo), min(ends[i] + reach, hi), i + 1
                    while j < len(at) and owner[at[j]] == doc and at[j] - reach <= stop:
                        stop, j = max(stop, min(ends[j] + reach, hi)), j + 1
                    rows.append((first + doc, start - lo, words.hashes[start:stop].tobytes(), X.signed(found[i:j]).tolist(), (at[i:j] - start).tolist()))
                    i = j
            keys, ids = batch.column(0), batch.column(1)
            yield table(
                ["row_key", "doc_id", "start", "words", "seeds", "places"],
                [[keys[r[0]].as_py() for r in rows], [ids[r[0]].as_py() for r in rows], [int(r[1]) for r in rows], *[[r[k] for r in rows] for k in (2, 3, 4)]],
                [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())],
            )

        return work

    rows = docs.select(F.xxhash64("doc_id", "text").alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(rows, build, "row_key long, doc_id long, start long, words binary, seeds array<long>, places array<int>")


def filter_places_one(seeds: np.ndarray, bits: int, k: int) -> np.ndarray:
    return (seeds * _PLACES[k]) >> np.uint64(64 - (bits.bit_length() - 1))


def _best_run(same: np.ndarray, min_words: int, share: float) -> tuple[int, int, int] | None:
    """(start, end, matches) of the run of at least min_words of which share agree that has most matches above share; the longest of equals."""
    n = len(same)
    if n < min_words:
        return None
    part = Fraction(share).limit_denominator(1000)
    total = np.concatenate([[0], np.cumsum(same, dtype=np.int64)])
    above = total * part.denominator - np.arange(n + 1) * part.numerator
    ranked = above * (n + 1) + np.arange(n + 1)
    lowest = np.minimum.accumulate(ranked[: n + 1 - min_words])
    end = int(np.argmax(ranked[min_words:] - lowest))
    start = int(np.argmin(ranked[: end + 1]))
    end += min_words
    return (start, end, int(total[end] - total[start])) if above[end] >= above[start] else None


def overlap(doc: np.ndarray, item: np.ndarray, diagonal: int, min_words: int = MIN_WORDS, share: float = SHARE) -> tuple[int, int, int] | None:
    """(start in doc, words, matches) of the best run that counts with doc[i + diagonal] against item[i]."""
    lo, hi = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    if hi <= lo:
        return None
    run = _best_run(doc[lo + diagonal : hi + diagonal] == item[lo:hi], min(min_words, len(item)), share)
    return (lo + run[0] + diagonal, run[1] - run[0], run[2]) if run else None


def find_overlaps(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, share: float = SHARE) -> DataFrame:
    """(row_key, doc_id, item_id, first_word, n_words, n_matches): the best overlap of every row and item that overlap."""
    if min_words < MIN_WORDS or share < SHARE:
        raise ValueError(f"the masks cover runs of {MIN_WORDS} words or more of which {SHARE} agree")
    items = written(_item_rows(benchmark), "items")
    contents = items.groupBy("content").agg(F.first("words").alias("words"))
    seeds = written(_item_seeds(contents, share), "item_seeds")
    n_seeds, reach = seeds.count(), (items.agg(F.max(F.octet_length("words"))).first()[0] or 0) // 8
    short = [r.n for r in items.select((F.octet_length("words") / 8).cast("int").alias("n")).where(F.col("n") < MIN_WORDS).distinct().collect()]
    masks = [*MASKS, *(m for n in sorted(short) for m in item_masks(n, share))]
    bloom = _bloom(seeds, int(min(max(1 << (32 * n_seeds).bit_length(), MIN_BITS), MAX_BITS)))
    windows = written(_windows(docs, bloom, masks, reach).withColumn("window", F.monotonically_increasing_id()), "windows")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    salt = F.pmod(F.xxhash64("window"), F.lit(SALTS)).cast("int").alias("salt")
    hits = windows.select("window", salt, F.explode(F.arrays_zip("seeds", "places")).alias("h")).select("window", "salt", F.col("h.seeds").alias("seed"), F.col("h.places").alias("place"))
    pairs = hits.join(seeds.select("*", salts), ["seed", "salt"]).select("window", "salt", "content", (F.col("place") - F.col("item_pos")).alias("diagonal")).distinct()
    pairs = pairs.join(contents.select("content", F.col("words").alias("item_words"), salts), ["content", "salt"])
    pairs = pairs.join(windows.select("window", "row_key", "doc_id", "start", "words"), "window").select("row_key", "doc_id", "content", "start", "diagonal", "words", "item_words")

    def build():
        def work(batch):
            rows = []
            for key, doc, content, start, diagonal, words, item in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                run = overlap(np.frombuffer(words, np.uint64), np.frombuffer(item, np.uint64), diagonal, min_words, share)
                if run:
                    rows.append((key, doc, content, start + run[0], run[1], run[2]))
            yield table(["row_key", "doc_id", "content", "first_word", "n_words", "n_matches"], [list(c) for c in zip(*rows, strict=True)] or [[]] * 6, [pa.int64()] * 6)

        return work

    found = map_batches(pairs, build, "row_key long, doc_id long, content long, first_word long, n_words long, n_matches long")
    best = found.groupBy("row_key", "doc_id", "content").agg(F.max(F.struct("n_matches", (-F.col("n_words")).alias("n"), (-F.col("first_word")).alias("f"))).alias("b"))
    best = best.join(items.select("content", "item_id").distinct(), "content")
    return best.select("row_key", "doc_id", "item_id", (-F.col("b.f")).alias("first_word"), (-F.col("b.n")).alias("n_words"), F.col("b.n_matches").alias("n_matches"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, share: float = SHARE) -> DataFrame:
    """Rows of docs that overlap with no item, all columns unchanged."""
    key, name = free_name(docs, "row_key"), free_name(docs, "overlapping")
    bad = written(find_overlaps(docs, benchmark, min_words, share).select(F.col("row_key").alias(name)).distinct(), "overlapping")
    doubtful, rest = split_by_keys(docs.withColumn(key, F.xxhash64("doc_id", "text")), key, bad)
    return rest.unionByName(doubtful.join(bad, F.col(key) == F.col(name), "left_anti")).drop(key)
