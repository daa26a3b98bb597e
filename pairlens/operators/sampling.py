"""Stratified selection of comparisons for human raters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlens.functions.stats import seeded_draw
from pairlens.session import written


def quotas(strata: DataFrame, cell: Sequence[str], stratum: Sequence[str], count: int) -> DataFrame:
    """Largest-remainder share of ``count`` for each stratum of a cell.

    ``strata`` has one row per stratum with its size ``n``.
    """
    total = F.sum("n").over(Window.partitionBy(*cell))
    # integer arithmetic: floor and remainder of count * n / total
    exact = strata.withColumn("_total", total).withColumns(
        {
            "_quota": F.floor(F.lit(count) * F.col("n") / F.col("_total")).cast("bigint"),
            "_rest": (F.lit(count) * F.col("n")) % F.col("_total"),
        }
    )
    left = F.lit(count) - F.sum("_quota").over(Window.partitionBy(*cell))
    place = F.row_number().over(Window.partitionBy(*cell).orderBy(F.desc("_rest"), *stratum))
    return (
        exact.withColumns({"_left": left, "_place": place})
        .withColumn(
            "quota", F.col("_quota") + F.when(F.col("_place") <= F.col("_left"), 1).otherwise(0)
        )
        .select(*cell, *stratum, "n", "quota")
    )


def stratified_pick(
    rows: DataFrame, cell: Sequence[str], stratum: Sequence[str], unit: str, count: int, seed: int
) -> DataFrame:
    """Seeded pick of ``count`` rows per cell in proportion to its strata.

    No stratum gives more than ``count`` rows, so each task keeps at most that
    many per stratum before the shuffle.
    """
    sizes = rows.groupBy(*cell, *stratum).agg(F.count(F.lit(1)).alias("n"))
    share = quotas(sizes, cell, stratum, count).drop("n")
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(unit)))
    place = F.row_number().over(Window.partitionBy(*cell, *stratum).orderBy("_draw", unit))
    return (
        rows.withColumn("_draw", draw)
        .withColumn("_place", place)
        .filter(F.col("_place") <= count)
        .join(share, [*cell, *stratum])
        .filter(F.col("_place") <= F.col("quota"))
        .drop("_draw", "_place", "quota")
    )


def balanced_packet(
    candidates: DataFrame,
    contrasts: Sequence[str],
    group: Sequence[str],
    stratum: Sequence[str],
    unit: str,
    count: int,
    seed: int,
) -> DataFrame:
    """``count`` candidates per contrast and group, preferring unused prompts.

    Contrasts are handled in order. Where the prompts that earlier contrasts did
    not take are fewer than ``count``, the whole pool of the group is used. The
    prompts taken so far are at most ``count`` per group and contrast. Every
    step reads the candidates, so they and each small pick are written once.
    """
    candidates = written(candidates, "candidates")
    picked = None
    for contrast in contrasts:
        pool = candidates.filter(F.col("contrast") == contrast)
        if picked is not None:
            used = picked.select("benchmark", unit).distinct()
            fresh = pool.join(F.broadcast(used), ["benchmark", unit], "left_anti")
            enough = (
                fresh.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= count)
            ).select(*group)
            pool = fresh.join(enough, list(group), "left_semi").unionByName(
                pool.join(enough, list(group), "left_anti")
            )
        chosen = written(
            stratified_pick(pool, list(group), stratum, unit, count, seed), "picked"
        )
        picked = chosen if picked is None else picked.unionByName(chosen)
    return picked


def blinded_assignment(
    selected: DataFrame, annotators: Sequence[str], order: Sequence[str], seed: int
) -> DataFrame:
    """Comparison ids, and per annotator a seed whose parity decides side A.

    ``selected`` is the packet handed to raters, a few hundred rows.
    """
    number = F.row_number().over(Window.orderBy(*order))
    named = selected.withColumn(
        "comparison_id", F.format_string("comparison-%03d", number)
    )
    rows = named.withColumn("annotator_id", F.explode(F.array(*[F.lit(a) for a in annotators])))
    draw = 1 + seeded_draw(seed, F.col("comparison_id"), F.col("annotator_id")) % 2147483647
    return rows.withColumn("presentation_seed", draw).withColumn(
        "condition_a",
        F.when(F.col("presentation_seed") % 2 == 0, F.col("left_condition")).otherwise(
            F.col("right_condition")
        ),
    )
