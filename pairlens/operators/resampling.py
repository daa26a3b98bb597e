"""Bootstrap over units (prompts) with reproducible draws.

One method for every cell size. The units of a cell are dealt over blocks of about
``block`` units by a hash of their key; a replicate of n draws first splits n over the
blocks (multinomial, by their sizes) and then draws with replacement inside each block,
which is the same as n draws from the whole cell. A block is one bounded array, its
replicates are spread over tasks, and the draws happen inside the task, so no draw is
ever shuffled. A cell that fits one block is the case of a split into one part.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.functions.stats import (
    BLOCK_STEP,
    DRAW_MODULUS,
    DRAW_MULTIPLIERS,
    counter_draw,
    replicate_key,
)
from pairlens.session import spread, written

BLOCK = 20_000
REPLICATES_PER_ROW = 500
# Copies of the one row per cell that its units are joined to, so a large cell is split over tasks
SALTS = 32
# Values are summed as whole multiples of 1 / SCALE, so a mean does not depend on the order of its sum
SCALE = 1e9
# Numbers worked on at once: they and their spare copy stay in a core's cache
TILE = 1 << 14
MODULUS = np.uint64(DRAW_MODULUS)
# Parts that the cells are dealt into, so that few blocks of many cells are still work for many tasks
PACKS = 2


def _blocks(
    units: DataFrame, cell: Sequence[str], unit: Sequence[str], rest: Sequence[str], block: int
) -> DataFrame:
    """One row per cell and block: its units in order of their key, as ``_units``."""
    hashed = F.xxhash64(*unit)
    sizes = units.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"))
    salted = sizes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    placed = (
        units.select(*cell, *unit, *rest)
        .withColumn("_salt", F.pmod(hashed, F.lit(SALTS)).cast("int"))
        .join(salted, [*cell, "_salt"])
        .withColumn("_block", F.pmod(F.xxhash64(hashed), F.ceil(F.col("_n") / block)))
    )
    return placed.groupBy(*cell, "_block").agg(
        F.array_sort(F.collect_list(F.struct(*unit, *rest))).alias("_units")
    )


def _split(frames: Iterator[pd.DataFrame], cell: list[str], resamples: int, seed: int) -> Iterator[pd.DataFrame]:
    """Draws that each block of a cell gets in each replicate of a chunk."""
    for frame in frames:
        for row in frame.to_dict("records"):
            ids, sizes = (np.asarray(x, dtype="int64") for x in (row["_ids"], row["_sizes"]))
            first = row["_chunk"] * REPLICATES_PER_ROW
            count = min(REPLICATES_PER_ROW, resamples - first)
            rng = np.random.default_rng([seed, first])
            drawn = rng.multinomial(sizes.sum(), sizes / sizes.sum(), size=count)
            out = pd.DataFrame({"_block": ids, "_first": first, "_drawn": list(drawn.T)})
            for name in cell:
                out[name] = row[name]
            yield out[[*cell, "_block", "_first", "_drawn"]]


def _drawn_blocks(blocks: DataFrame, cell: Sequence[str], resamples: int, seed: int, listed_in: str = "_units") -> DataFrame:
    """One row per block and chunk of replicates, with the draws of each replicate."""
    sizes = blocks.select(*cell, F.struct("_block", F.size(listed_in).alias("n")).alias("_s"))
    chunk = F.explode(F.sequence(F.lit(0), F.lit((resamples - 1) // REPLICATES_PER_ROW)))
    listed = sizes.groupBy(*cell).agg(F.array_sort(F.collect_list("_s")).alias("_s")).select(
        *cell, F.col("_s._block").alias("_ids"), F.col("_s.n").alias("_sizes"), chunk.alias("_chunk")
    )
    kinds = dict(blocks.dtypes)
    head = "".join(f"`{c}` {kinds[c]}, " for c in cell)
    names = list(cell)
    return spread(listed, *cell, "_chunk").mapInPandas(
        lambda frames: _split(frames, names, resamples, seed),
        f"{head}_block long, _first int, _drawn array<long>",
    )


def _reduce(x: np.ndarray, spare: np.ndarray) -> None:
    """Remainder by the modulus, in place, of values below twice it; a difference below zero wraps to a large value."""
    np.subtract(x, MODULUS, out=spare)
    np.minimum(x, spare, out=x)


def draw_numbers(seed: int, replicates: np.ndarray, block: int, first: int, count: int) -> np.ndarray:
    """Numbers ``first`` to ``first + count`` of each replicate in a block, a row per replicate, as ``counter_draw`` has them.

    They do not depend on the cell. A remainder by 2^31 - 1 is the sum of the high and the low bits, which is several
    times as fast as a division.
    """
    found = np.empty((len(replicates), count), dtype="uint32")
    steps = (np.arange(first, first + count, dtype="int64") * 69069 % DRAW_MODULUS).astype("uint64")
    keys = (seed + np.asarray(replicates, dtype="int64") * 40503 + block * BLOCK_STEP) % DRAW_MODULUS
    for multiplier in DRAW_MULTIPLIERS[:2]:
        keys = (keys ^ (keys >> 15)) * multiplier % DRAW_MODULUS
    for start in range(0, count, TILE):
        part = steps[start : start + TILE]
        x, spare = np.empty_like(part), np.empty_like(part)
        for i, key in enumerate(keys.astype("uint64")):
            np.add(part, key, out=x)
            _reduce(x, spare)
            for multiplier in DRAW_MULTIPLIERS:
                np.right_shift(x, 15, out=spare)
                np.bitwise_xor(x, spare, out=x)
                np.multiply(x, multiplier, out=x)
                np.right_shift(x, 31, out=spare)
                np.bitwise_and(x, MODULUS, out=x)
                np.add(x, spare, out=x)
                _reduce(x, spare)
            found[i, start : start + TILE] = x
    return found


class DrawRoom:
    """Arrays that the steps of a draw write to, so that no step asks for memory."""

    def __init__(self, size: int):
        self.whole = np.empty(size, dtype="uint32")
        self.place = np.empty(size, dtype="int64")
        self.value = np.empty(size, dtype="int64")

    def of(self, shape: tuple[int, ...]) -> list[np.ndarray]:
        size = int(np.prod(shape))
        return [x[:size].reshape(shape) for x in (self.whole, self.place, self.value)]


def places(numbers: np.ndarray, units: int, whole: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Remainders by the number of units, put into ``place``."""
    n = np.uint32(units)
    np.floor_divide(numbers, n, out=whole)
    np.multiply(whole, n, out=whole)
    return np.subtract(numbers, whole, out=place)


def draws(seed: int, b: int, block: int, count: int, units: int) -> np.ndarray:
    """Places of the units that replicate ``b`` draws from a block."""
    return places(draw_numbers(seed, np.array([b]), block, 0, count)[0], units, *DrawRoom(count).of((count,))[:2])


class _Numbers:
    """The numbers of a chunk of replicates in a block, kept while rows of the same block and chunk follow."""

    def __init__(self, seed: int):
        self.seed, self.of = seed, None

    def get(self, block: int, first: int, rows: int, count: int) -> np.ndarray:
        if self.of != (block, first, rows):
            self.of, self.kept = (block, first, rows), np.empty((rows, 0), dtype="uint32")
        have = self.kept.shape[1]
        if have < count:
            # a little more than asked for: the next cells differ by a few units
            more = draw_numbers(self.seed, np.arange(first, first + rows), block, have, count + count // 32 - have)
            self.kept = np.hstack([self.kept, more])
        return self.kept


def _block_sums(frames: Iterator[pd.DataFrame], cell: list[str], seed: int) -> Iterator[pd.DataFrame]:
    """Sums of the units drawn from a block; the rows come by block and chunk."""
    kept, room = _Numbers(seed), DrawRoom(TILE)
    for frame in frames:
        for row in frame.to_dict("records"):
            values = np.asarray(row["_values"], dtype="float64")
            exact = np.floor(values * SCALE + 0.5).astype("int64")
            drawn = np.asarray(row["_drawn"], dtype="int64")
            count = int(drawn.max())
            numbers = kept.get(row["_block"], row["_first"], len(drawn), count)
            totals = np.zeros(len(drawn), dtype="int64")
            if len(room.place) < count:
                room = DrawRoom(count)
            # replicates of as many draws go together, others one by one
            step = max(1, TILE // max(1, count)) if drawn.min() == count else 1
            for i in range(0, len(drawn), step):
                chunk = numbers[i : i + step, : drawn[i]]
                whole, place, value = room.of(chunk.shape)
                places(chunk, len(values), whole, place)
                totals[i : i + step] = exact.take(place, out=value, mode="wrap").sum(axis=1)
            b = np.arange(row["_first"], row["_first"] + len(drawn), dtype="int32")
            out = pd.DataFrame({"b": b, "total": totals, "drawn": drawn})
            for name in cell:
                out[name] = row[name]
            yield out[[*cell, "b", "total", "drawn"]]


def bootstrap_means(
    units: DataFrame,
    cell: Sequence[str],
    unit: Sequence[str],
    value: str,
    resamples: int,
    seed: int,
    block: int = BLOCK,
) -> DataFrame:
    """Mean of each resample: one row per cell and replicate ``b``.

    The units are read by several branches; pass a stored table. Units need distinct keys. Cells that share a task
    share the numbers of its block and chunk, so these are made once and not once per cell.
    """
    blocks = _blocks(units, cell, unit, [value], block)
    arrays = blocks.select(*cell, "_block", F.transform("_units", lambda x: x[value]).alias("_values"))
    arrays = written(arrays, "blocks")
    work = arrays.join(_drawn_blocks(arrays, cell, resamples, seed, "_values"), [*cell, "_block"])
    kinds = dict(units.dtypes)
    head = "".join(f"`{c}` {kinds[c]}, " for c in cell)
    names = list(cell)
    work = work.withColumn("_pack", F.pmod(F.hash(*cell), F.lit(PACKS)))
    work = spread(work, "_block", "_first", "_pack").sortWithinPartitions("_block", "_first").drop("_pack")
    sums = work.mapInPandas(
        lambda frames: _block_sums(frames, names, seed), f"{head}b int, total long, drawn long"
    )
    total = F.sum(F.col("total").cast("decimal(38,0)")).cast("double")
    return sums.groupBy(*cell, "b").agg((total / (F.sum("drawn") * SCALE)).alias("mean"))


def resample_weights(
    units: DataFrame,
    cell: Sequence[str],
    unit: Sequence[str],
    resamples: int,
    seed: int,
    block: int = BLOCK,
) -> DataFrame:
    """How often each unit occurs in each replicate; zero weights are left out."""
    blocks = _blocks(units, cell, unit, [], block)
    drawn = _drawn_blocks(blocks, cell, resamples, seed).select(
        *cell, "_block", "_first", F.posexplode("_drawn").alias("_i", "_n")
    )
    n = F.size("_units")
    picks = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1),
        lambda slot: F.element_at("_units", (counter_draw(F.col("_key"), slot) % n).cast("int") + 1),
    )
    return (
        blocks.join(drawn.filter("_n > 0"), [*cell, "_block"])
        .withColumn("b", F.col("_first") + F.col("_i"))
        .withColumn("_key", replicate_key(seed, F.col("b"), F.col("_block")))
        .repartition(*cell, "_block", "b")
        .select(*cell, "b", F.explode(picks).alias("_u"))
        .groupBy(*cell, "b", *[F.col(f"_u.{u}").alias(u) for u in unit])
        .agg(F.count(F.lit(1)).cast("double").alias("weight"))
    )


def drawn_points(
    points: DataFrame, cell: Sequence[str], unit: Sequence[str], values: Sequence[str],
    resamples: int, seed: int, block: int = BLOCK, slice_rows: int = BLOCK,
) -> DataFrame:
    """The points of every block of units beside the draws of a chunk of replicates; points are never multiplied.

    A row has a slice of about ``slice_rows`` points as arrays: ``owner`` (place of the unit in its block) and the
    ``values``. With ``draws`` of the ``_drawn`` units, every task finds the weights of its points in all
    replicates ``_first`` + i. A unit with very many points is spread over slices. Points are read by several branches.
    """
    blocks = written(_blocks(points.select(*cell, *unit).distinct(), cell, unit, [], block), "unit_blocks")
    placed = blocks.select(*cell, "_block", F.size("_units").alias("n_units"), F.posexplode("_units").alias("owner", "_u")).select(
        *cell, "_block", "n_units", "owner", *[F.col(f"_u.{u}").alias(u) for u in unit]
    )
    placed = written(points.join(placed, [*cell, *unit]).select(*cell, "_block", "n_units", "owner", *values), "placed_points")
    sizes = placed.groupBy(*cell, "_block").agg(F.ceil(F.count(F.lit(1)) / slice_rows).alias("_slices"))
    sliced = placed.join(sizes, [*cell, "_block"]).withColumn("_slice", F.pmod(F.xxhash64("owner", *values), F.col("_slices")))
    names = ["owner", *values]
    rows = sliced.groupBy(*cell, "_block", "n_units", "_slice").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("_p"))
    rows = rows.select(*cell, "_block", "n_units", "_slice", *[F.col(f"_p.{n}").alias(n) for n in names])
    return written(rows.join(_drawn_blocks(blocks, cell, resamples, seed), [*cell, "_block"]), "drawn_points")


def interpolated_interval(means: DataFrame, cell: Sequence[str], value: str = "mean") -> DataFrame:
    """2.5 and 97.5 % points by linear interpolation; a cell has one row per replicate."""
    ends = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    return means.groupBy(*cell).agg(ends.alias("_q")).select(
        *cell, F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high")
    )


def positional_interval(means: DataFrame, cell: Sequence[str], resamples: int) -> DataFrame:
    """Interval ends by position among the sorted replicates, not interpolated."""
    ordered = F.sort_array(F.collect_list("mean"))
    return means.groupBy(*cell).agg(ordered.alias("_m")).select(
        *cell,
        F.element_at("_m", int(0.025 * resamples) + 1).alias("low"),
        F.element_at("_m", int(0.975 * resamples)).alias("high"),
    )
