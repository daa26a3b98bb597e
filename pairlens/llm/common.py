"""Shared parts of the corpus operators: batch maps, hot keys, bounded bitmaps and connected components."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.session import written

#: A key with more than 1/HOT_KEYS of all rows is hot; there can be at most HOT_KEYS of them.
HOT_KEYS = 1000
BATCH_ROWS = 2000
BATCH_BYTES = 16 << 20
KEY_BITS, MAX_KEY_BITS = 16, 1 << 26


def arrow_map(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow over batches of at most BATCH_ROWS rows or about BATCH_BYTES, so that long texts do not fill a worker."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def lean(batches):
        yield from run(batches)
        give_back()

    return df.mapInArrow(lean, schema)


def give_back() -> None:
    """Hand memory that this worker no longer uses back to the machine; an idle worker stays for the next task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_batches(df: DataFrame, build: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: str) -> DataFrame:
    """mapInArrow with set-up once per task: build() returns the function of one batch."""

    def run(batches):
        work = build()
        for batch in batches:
            if batch.num_rows:
                yield from work(batch)

    return arrow_map(df, run, schema)


def table(names: list[str], columns: list, types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def join_hot(rows: DataFrame, dim: DataFrame, keys: list[str], weight: str, how: str = "left") -> DataFrame:
    """rows join dim on keys, where dim has one row per key and `weight` tells how many rows it meets.

    Weights add up to the number of rows, so fewer than HOT_KEYS of them exceed 1/HOT_KEYS of it: those
    few go by broadcast, all other keys by shuffle. `weight` is not part of the result. Both inputs are
    read more than once and should be tables.
    """
    total = dim.agg(F.sum(weight)).first()[0] or 0
    limit = max(total // HOT_KEYS, 1)
    hot = F.broadcast(dim.where(F.col(weight) > limit).drop(weight).withColumn("pairlens_hot", F.lit(True)))
    cold = dim.where(F.col(weight) <= limit).drop(weight)
    marked = rows.join(hot, keys, "left")
    extra = [c for c in cold.columns if c not in keys]
    plain = marked.where(F.col("pairlens_hot").isNull()).drop("pairlens_hot", *extra)
    return marked.where("pairlens_hot").drop("pairlens_hot").unionByName(plain.join(cold, keys, how))


def key_bitmap(keys: DataFrame, bits: int = 1 << 23) -> DataFrame:
    """Bitmap of a long column `key` as rows (word, mask): at most bits / 64 rows, whatever the input's size."""
    place = F.pmod(F.xxhash64("key"), F.lit(bits))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
    return keys.select(F.floor(place / 64).cast("long").alias("word"), one.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask"))


def maybe_flag(df: DataFrame, column: str, bitmap: DataFrame, bits: int = 1 << 23) -> DataFrame:
    """df with `_maybe`: true for every row whose key is in the bitmap, and for few others while it is not full."""
    place = F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(bits))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
    words = F.broadcast(bitmap.select(F.col("word").alias("pairlens_word"), F.col("mask").alias("pairlens_mask")))
    found = df.withColumn("pairlens_word", F.floor(place / 64).cast("long")).join(words, "pairlens_word", "left")
    return found.withColumn("pairlens_maybe", F.coalesce(F.col("pairlens_mask").bitwiseAND(one) != 0, F.lit(False))).drop("pairlens_word", "pairlens_mask")


def free_name(df: DataFrame, name: str) -> str:
    """A column name like `name` that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def split_by_keys(df: DataFrame, column: str, keys: DataFrame, key_bits: int = KEY_BITS) -> tuple[DataFrame, DataFrame]:
    """(rows that may have a key, rows that have none): df split by a bitmap of the long keys in the only column of `keys`.

    Rows without a value have none. The bitmap has key_bits bits a key up to MAX_KEY_BITS, so at most MAX_KEY_BITS / 64
    rows are broadcast; a fuller one only puts more rows on the first side.
    """
    bits = 1 << max(16, min(key_bits * keys.count(), MAX_KEY_BITS - 1).bit_length())
    word, mask = free_name(df, "word"), free_name(df, "mask")
    bitmap = key_bitmap(keys.toDF("key"), bits).toDF(word, mask)
    place = F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(bits))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
    marked = df.withColumn(word, F.floor(place / 64).cast("long")).join(F.broadcast(bitmap), word, "left")
    maybe = F.coalesce((F.col(mask).bitwiseAND(one) != 0) & F.col(column).isNotNull(), F.lit(False))
    return marked.where(maybe).select(*df.columns), marked.where(~maybe).select(*df.columns)


class Forest:
    """Union-find over integers with the smallest member as root."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        """False if they were connected before."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _contract():
    """Edges of a task to stars around its smallest nodes; at most one edge per node of the task."""

    def run(batches):
        forest = Forest()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                forest.join(a, b)
            if len(forest.parent) > 1_000_000:
                yield from emit(forest)
                forest = Forest()
        yield from emit(forest)

    def emit(forest):
        pairs = [(x, r) for x in forest.parent if (r := forest.find(x)) != x]
        if pairs:
            yield table(["a", "b"], list(zip(*pairs, strict=True)), [pa.int64(), pa.int64()])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from every node that has an edge (columns a and b, longs).

    Alternates large stars and small stars until nothing changes; every round is written to the shared
    folder. A task first reduces its edges to stars. The hub of a large component meets its one row of
    minima in a join that adaptive execution splits. Self-loops are ignored; nodes without edges are absent.
    """
    plain = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now, before = written(arrow_map(plain, _contract(), "a long, b long").distinct(), "edges"), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        large = written(arrow_map(large, _contract(), "a long, b long").distinct(), "large_star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select("a", F.col("m").alias("b")).unionByName(small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        now = written(small.where("a != b").distinct(), "small_star")
