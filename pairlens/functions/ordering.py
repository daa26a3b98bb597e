"""Ordered operators that never sort one whole key in one task.

A plain window puts every row of a key into a single task. These helpers take
a ``bucket``: columns that coarsen the order (all rows of a lower bucket come
before all rows of a higher one, for instance the hour of a timestamp). Rows
are ordered inside (key, bucket); what a bucket must know about the buckets
before it is one small row per bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _attach(df: DataFrame, small: DataFrame, on: Sequence[str], take: Sequence[str]) -> DataFrame:
    """Bring the columns of one small row per key to the rows of that key.

    Keys are never null here and every key has its small row, so this is an
    inner equi-join. Both sides then carry the same filters down to their
    common input, and Spark reads that input once; plain equality also keeps
    the partitioning of the window below, so the rows are not shuffled again.
    """
    return df.join(small.select(*on, *take), list(on))


def row_index(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Sequence[str],
    order: Sequence[str | Column],
    out: str = "row_index",
) -> DataFrame:
    """1-based position of each row of its key in the given order."""
    group = [*keys, *bucket]
    local = Window.partitionBy(*group).orderBy(*order)
    before = Window.partitionBy(*keys).orderBy(*bucket).rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        df.groupBy(*group)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(*group, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    placed = df.withColumn("_local", F.row_number().over(local))
    return (
        _attach(placed, offsets, group, ["_offset"])
        .withColumn(out, (F.col("_local") + F.col("_offset")).cast("bigint"))
        .drop("_local", "_offset")
    )


def previous_value(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Sequence[str],
    order: Sequence[str],
    value: Column,
    out: str,
) -> DataFrame:
    """Last non-null value on the rows before this one."""
    group = [*keys, *bucket]
    marked = df.withColumn("_value", value)
    local = Window.partitionBy(*group).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    before = Window.partitionBy(*keys).orderBy(*bucket).rowsBetween(
        Window.unboundedPreceding, -1
    )
    place = F.when(F.col("_value").isNotNull(), F.struct(*order))
    carried = (
        marked.groupBy(*group)
        .agg(F.max_by("_value", place).alias("_tail"))
        .select(*group, F.last("_tail", ignorenulls=True).over(before).alias("_carried"))
    )
    seen = marked.withColumn("_near", F.last("_value", ignorenulls=True).over(local))
    return (
        _attach(seen, carried, group, ["_carried"])
        .withColumn(out, F.coalesce("_near", "_carried"))
        .drop("_value", "_near", "_carried")
    )


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Sequence[str],
    order: Sequence[str],
    amount: Column,
    out: str,
) -> DataFrame:
    """Sum of an integer amount up to and including each row."""
    group = [*keys, *bucket]
    marked = df.withColumn("_amount", amount)
    local = Window.partitionBy(*group).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    before = Window.partitionBy(*keys).orderBy(*bucket).rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        marked.groupBy(*group)
        .agg(F.sum("_amount").alias("_sums"))
        .select(*group, F.coalesce(F.sum("_sums").over(before), F.lit(0)).alias("_offset"))
    )
    summed = marked.withColumn("_near", F.sum("_amount").over(local))
    return (
        _attach(summed, offsets, group, ["_offset"])
        .withColumn(out, (F.col("_near") + F.col("_offset")).cast("bigint"))
        .drop("_amount", "_near", "_offset")
    )


def running_count(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Sequence[str],
    order: Sequence[str],
    flag: Column,
    out: str,
) -> DataFrame:
    """How many rows up to and including this one satisfy the flag."""
    return running_sum(df, keys, bucket, order, F.when(flag, 1).otherwise(0), out)


def magnitude_bucket(value: Column) -> Column:
    """Monotone bucket of a positive double, about 0.1 % wide."""
    return F.floor(F.log2(value) * 1024).cast("bigint")


def average_rank(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    out: str,
    bucket: Column | None = None,
    weight: Column | None = None,
) -> DataFrame:
    """Tie-averaged rank of ``value`` within its key.

    Equal values are counted first, so ties collapse before any ordering. Only
    distinct values are ordered, bucket by bucket. ``weight`` is the number of
    rows a row stands for. Rows without a value drop out.
    """
    df = df.filter(F.col(value).isNotNull())
    rows = F.count(F.lit(1)) if weight is None else F.sum(weight)
    ranks = ranked_values(df, keys, value, out, rows, {}, bucket)
    return _attach(df, ranks, [*keys, value], [out, out + "_ties"])


def ranked_values(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    out: str,
    rows: Column,
    sums: dict[str, Column],
    bucket: Column | None = None,
) -> DataFrame:
    """One row per key and distinct value: its tie-averaged rank, its ties (counted by ``rows``) and further ``sums``.

    Enough where only totals of the ranks are wanted: no row gets its rank back by a join.
    """
    spread = bucket if bucket is not None else signed_bucket(F.col(value))
    counts = (
        df.groupBy(*keys, value)
        .agg(rows.alias("_ties"), *[column.alias(name) for name, column in sums.items()])
        .withColumn("_bucket", spread)
    )
    group = [*keys, "_bucket"]
    local = Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        counts.groupBy(*group)
        .agg(F.sum("_ties").alias("_rows"))
        .select(*group, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    near = counts.withColumn("_near", F.coalesce(F.sum("_ties").over(local), F.lit(0)))
    return _attach(near, offsets, group, ["_offset"]).select(
        *keys,
        value,
        (F.col("_offset") + F.col("_near") + (F.col("_ties") + 1) / 2.0).alias(out),
        F.col("_ties").alias(out + "_ties"),
        *sums,
    )


def first_by(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    columns: Sequence[str],
    last: bool = False,
) -> DataFrame:
    """One row per key, the first (or last) in the order.

    An aggregate with map-side combine, unlike ``row_number() = 1``.
    """
    pick = F.max_by if last else F.min_by
    return (
        df.groupBy(*keys)
        .agg(pick(F.struct(*columns), F.struct(*order)).alias("_row"))
        .select(*keys, "_row.*")
    )


def signed_bucket(value: Column) -> Column:
    """Monotone bucket of any double."""
    shift = F.lit(1 << 21)
    return (
        F.when(value > 0, magnitude_bucket(value) + shift)
        .when(value < 0, -(magnitude_bucket(-value) + shift))
        .otherwise(F.lit(0))
        .cast("bigint")
    )


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float]
) -> DataFrame:
    """Linear-interpolation quantiles per key, exact at any group size.

    ``percentile`` keeps every distinct value of a key in one task. Here the
    distinct values are counted in parallel, the buckets give each value its
    cumulative count, and the two neighbours of a position are found by ``min``.
    """
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("_ties"))
        .withColumn("_bucket", signed_bucket(F.col(value)))
    )
    group = [*keys, "_bucket"]
    local = Window.partitionBy(*group).orderBy(value).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    by_bucket = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    whole = Window.partitionBy(*keys)
    offsets = (
        counts.groupBy(*group)
        .agg(F.sum("_ties").alias("_rows"))
        .select(
            *group,
            F.coalesce(F.sum("_rows").over(by_bucket), F.lit(0)).alias("_offset"),
            F.sum("_rows").over(whole).alias("_total"),
        )
    )
    near = counts.withColumn("_near", F.sum("_ties").over(local))
    placed = _attach(near, offsets, group, ["_offset", "_total"]).withColumn(
        "_through", F.col("_offset") + F.col("_near")
    )
    parts = [F.max("_total").alias("_n")]
    for name, q in quantiles.items():
        place = F.lit(q) * (F.col("_total") - 1)
        parts += [
            F.min(F.when(F.col("_through") > F.floor(place), F.col(value))).alias(f"_{name}_lo"),
            F.min(F.when(F.col("_through") > F.ceil(place), F.col(value))).alias(f"_{name}_hi"),
        ]
    found = placed.groupBy(*keys).agg(*parts)
    result = []
    for name, q in quantiles.items():
        place = F.lit(q) * (F.col("_n") - 1)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        result.append((lo + (hi - lo) * (place - F.floor(place))).alias(name))
    return found.select(*keys, *result)
