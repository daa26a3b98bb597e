"""Iterative fits whose every step is one distributed aggregate.

The parameters of all groups live in a small table (one row per group); each
step joins it to the data, sums the gradient terms per group and writes the new
parameters. Lineage is cut with a checkpoint after every step.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.functions.stats import logistic
from pairlens.operators.resampling import BLOCK, REPLICATES_PER_ROW, DrawRoom, draw_numbers, drawn_points, places
from pairlens.session import reliable_checkpoint, written


def bradley_terry(games: DataFrame, keys: Sequence[str], max_iterations: int = 10_000) -> DataFrame:
    """Tie-aware Bradley-Terry strengths per group, by MM updates.

    Spark reduces the games to one row per unordered pair of conditions; a
    group then holds conditions squared over two rows at most, which is the
    size of its report, and is fitted in one step.
    """
    left, right = F.col("left_condition"), F.col("right_condition")
    low, high = F.least(left, right), F.greatest(left, right)
    low_score = (
        F.when(F.col("result") == "tie", 0.5)
        .when((F.col("result") == "left") == (left == low), 1.0)
        .otherwise(0.0)
    )
    counts = games.filter(left != right).groupBy(*keys, low.alias("low"), high.alias("high")).agg(
        F.count(F.lit(1)).alias("played"), F.sum(low_score).alias("low_wins")
    )
    fields = dict(counts.dtypes)
    head = ", ".join(f"{k} {fields[k]}" for k in keys)
    schema = f"{head}, status string, condition string, strength double, iterations int"

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        label = [group[k].iloc[0] for k in keys]
        names = sorted(set(group["low"]) | set(group["high"]))
        place = {n: i for i, n in enumerate(names)}
        met = np.zeros((len(names), len(names)))
        won = np.zeros(len(names))
        lost = np.zeros(len(names))
        for row in group.itertuples():
            i, j = place[row.low], place[row.high]
            met[i, j] += row.played
            met[j, i] += row.played
            won[i] += row.low_wins
            won[j] += row.played - row.low_wins
            lost[j] += row.low_wins
            lost[i] += row.played - row.low_wins
        status, strength, used = "complete separation", None, 0
        if (won > 0).all() and (lost > 0).all():
            status, strength = "non-convergence", np.ones(len(names))
            for used in range(1, max_iterations + 1):
                fresh = won / (met / (strength[:, None] + strength[None, :])).sum(axis=1)
                fresh /= np.exp(np.log(fresh).mean())
                moved = np.abs(fresh - strength).max()
                strength = fresh
                if moved < 1e-10:
                    status = "ok"
                    break
        rows = [
            (*label, status, n, float(strength[place[n]]) if status == "ok" else None, used)
            for n in names
        ]
        return pd.DataFrame(rows, columns=[*keys, "status", "condition", "strength", "iterations"])

    return counts.groupBy(*keys).applyInPandas(fit, schema)


def mean_strengths(fits: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Mean strength over judges, only where every judge's fit is ok."""
    return fits.groupBy(*cell, "condition").agg(
        F.every(F.col("status") == "ok").alias("all_ok"), F.avg("strength").alias("strength")
    ).join(
        fits.groupBy(*cell).agg(F.every(F.col("status") == "ok").alias("_cell_ok")), list(cell)
    ).select(*cell, "condition", F.when(F.col("_cell_ok"), F.col("strength")).alias("strength"))


def _newton_step(params: DataFrame, sums: DataFrame, keys: Sequence[str], tolerance: float) -> DataFrame:
    """Parameters after a step by the sums of gradient and information; rows without sums stay as they are."""
    det = F.col("h00") * F.col("h11") - F.col("h01") * F.col("h01")
    move0 = (F.col("h11") * F.col("g0") - F.col("h01") * F.col("g1")) / det
    move1 = (F.col("h00") * F.col("g1") - F.col("h01") * F.col("g0")) / det
    singular = det.isNull() | F.isnan(det) | (det <= 0)
    moved = sums.select(
        *keys,
        singular.alias("_singular"),
        F.when(~singular, move0).alias("_d0"),
        F.when(~singular, move1).alias("_d1"),
    )
    settled = (F.abs("_d0") < tolerance) & (F.abs("_d1") < tolerance)
    return params.join(moved, list(keys), "left").select(
        *keys,
        (F.col("intercept") + F.coalesce("_d0", F.lit(0.0))).alias("intercept"),
        (F.col("slope") + F.coalesce("_d1", F.lit(0.0))).alias("slope"),
        F.when(F.col("_singular"), "singular").when(settled, "ok").otherwise(F.col("status")).alias("status"),
    )


def fit_logistic(
    points: DataFrame, keys: Sequence[str], steps: int = 50, tolerance: float = 1e-10
) -> DataFrame:
    """Two-parameter logistic fit of ``y`` on ``x`` per group, by Newton steps.

    ``points(keys, x, y, weight)``. A group whose information matrix is singular
    gets the status ``singular`` in place of an error.
    """
    # equal points are merged, and every step reads the merged table
    points = written(
        points.groupBy(*keys, "x", "y").agg(F.sum("weight").alias("weight")), "newton"
    )
    params = points.select(*keys).distinct().select(
        *keys,
        F.lit(0.0).alias("intercept"),
        F.lit(0.0).alias("slope"),
        F.lit("running").alias("status"),
    )
    params = reliable_checkpoint(params)
    for _ in range(steps):
        p = logistic(F.col("intercept") + F.col("slope") * F.col("x"))
        w, x = F.col("weight"), F.col("x")
        info = w * p * (1 - p)
        sums = (
            points.join(params.filter("status = 'running'"), list(keys))
            .groupBy(*keys)
            .agg(
                F.sum(w * (F.col("y") - p)).alias("g0"),
                F.sum(w * (F.col("y") - p) * x).alias("g1"),
                F.sum(info).alias("h00"),
                F.sum(info * x).alias("h01"),
                F.sum(info * x * x).alias("h11"),
            )
        )
        params = reliable_checkpoint(_newton_step(params, sums, keys, tolerance))
        if params.filter("status = 'running'").isEmpty():
            break
    return params


def length_points(pairs: DataFrame) -> DataFrame:
    """Decided pairs as (x, y): log length ratio and whether the left side won."""
    return pairs.filter(
        (F.col("verdict") != "tie") & (F.col("left_length") > 0) & (F.col("right_length") > 0)
    ).select(
        "left_condition",
        "right_condition",
        "benchmark",
        "prompt",
        F.log(F.col("left_length") / F.col("right_length")).alias("x"),
        (F.col("verdict") == "left").cast("double").alias("y"),
    )


CONTRAST = ["left_condition", "right_condition"]


#: Weights of (replicate, point) that a task holds at once.
WEIGHTS = 1 << 21
SUMS = ["g0", "g1", "h00", "h01", "h11"]


def _newton_sums(frames: Iterator[pd.DataFrame], keys: list[str], seed: int) -> Iterator[pd.DataFrame]:
    """Gradient and information of every open replicate over the points of a row, one row per replicate."""
    for frame in frames:
        for row in frame.to_dict("records"):
            x, y, w = (np.asarray(row[c], dtype="float64") for c in ("x", "y", "weight"))
            owner = np.asarray(row["owner"], dtype="int64")
            b, intercept, slope = (np.asarray(row[c]) for c in ("_b", "_intercept", "_slope"))
            drawn = np.asarray(row["_drawn"], dtype="int64")
            step, room = max(1, WEIGHTS // len(x)), DrawRoom(int(drawn.max()))
            for first in range(0, len(b), step):
                part = slice(first, first + step)
                weights = np.empty((len(b[part]), len(x)))
                counts = drawn[b[part] - row["_first"]]
                numbers = draw_numbers(seed, b[part], row["_block"], 0, int(counts.max()))
                for i, count in enumerate(counts.tolist()):
                    whole, place, _ = room.of((count,))
                    times = np.bincount(places(numbers[i, :count], row["n_units"], whole, place), minlength=row["n_units"])
                    weights[i] = times[owner] * w
                with np.errstate(over="ignore"):
                    p = 1 / (1 + np.exp(-(intercept[part, None] + slope[part, None] * x)))
                left, info = weights * (y - p), weights * p * (1 - p)
                out = pd.DataFrame({"b": b[part], "g0": left.sum(axis=1), "g1": left @ x, "h00": info.sum(axis=1), "h01": info @ x, "h11": info @ (x * x)})
                for name in keys:
                    out[name] = row[name]
                yield out[[*keys, "b", *SUMS]]


def fit_replicates(drawn: DataFrame, keys: Sequence[str], resamples: int, seed: int, steps: int = 50, tolerance: float = 1e-10) -> DataFrame:
    """``fit_logistic`` for all replicates of ``drawn_points`` at once: (keys, b, intercept, slope, status).

    A step sends the parameters of a chunk of replicates to the rows of points, and brings back five sums per row and
    replicate. Replicates that have ended take no further part.
    """
    names, kinds = list(keys), dict(drawn.dtypes)
    head = "".join(f"`{k}` {kinds[k]}, " for k in names)
    rows = drawn.select(*names, F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("b")).distinct()
    params = reliable_checkpoint(rows.select(*names, "b", F.lit(0.0).alias("intercept"), F.lit(0.0).alias("slope"), F.lit("running").alias("status")))
    for _ in range(steps):
        chunk = (F.floor(F.col("b") / REPLICATES_PER_ROW) * REPLICATES_PER_ROW).cast("int").alias("_first")
        listed = F.sort_array(F.collect_list(F.struct("b", "intercept", "slope"))).alias("_p")
        open_ones = params.filter("status = 'running'").groupBy(*names, chunk).agg(listed).select(
            *names, "_first", F.col("_p.b").alias("_b"), F.col("_p.intercept").alias("_intercept"), F.col("_p.slope").alias("_slope")
        )
        sums = drawn.join(open_ones, [*names, "_first"]).mapInPandas(
            lambda frames: _newton_sums(frames, names, seed), f"{head}b int, " + ", ".join(f"{c} double" for c in SUMS)
        )
        sums = sums.groupBy(*names, "b").agg(*[F.sum(c).alias(c) for c in SUMS])
        params = reliable_checkpoint(_newton_step(params, sums, [*names, "b"], tolerance))
        if params.filter("status = 'running'").isEmpty():
            break
    return params


def logistic_cluster_bootstrap(points: DataFrame, resamples: int, seed: int, block: int = BLOCK) -> DataFrame:
    """Logistic length fit per contrast with prompt-clustered intervals.

    Equal points of a prompt are merged first; all replicates of all contrasts take each Newton step together.
    A replicate that has not settled after the last step counts as it stands (``unsettled``); one whose information is
    singular gives no values (``failed``); ``replicates`` are those that the intervals rest on.
    """
    merged = written(
        points.groupBy(*CONTRAST, "benchmark", "prompt", "x", "y").agg(
            F.count(F.lit(1)).cast("double").alias("weight")
        ),
        "points",
    )
    whole = fit_logistic(merged.select(*CONTRAST, "x", "y", "weight"), CONTRAST)
    drawn = drawn_points(merged, CONTRAST, ["benchmark", "prompt"], ["x", "y", "weight"], resamples, seed, block)
    fits = fit_replicates(drawn, CONTRAST, resamples, seed)
    kept = F.col("status") != "singular"
    ends = F.array(F.lit(0.025), F.lit(0.975))
    intervals = fits.groupBy(*CONTRAST).agg(
        F.count_if(kept).alias("replicates"),
        F.count_if(F.col("status") == "running").alias("unsettled"),
        F.count_if(~kept).alias("failed"),
        F.percentile(F.when(kept, F.col("intercept")), ends).alias("_i"),
        F.percentile(F.when(kept, F.col("slope")), ends).alias("_s"),
    )
    sizes = merged.groupBy(*CONTRAST).agg(F.sum("weight").cast("bigint").alias("decided_pairs"))
    clusters = merged.select(*CONTRAST, "benchmark", "prompt").distinct()
    prompts = clusters.groupBy(*CONTRAST).agg(F.count(F.lit(1)).alias("prompts"))
    return (
        whole.join(intervals, CONTRAST, "left")
        .join(sizes, CONTRAST)
        .join(prompts, CONTRAST)
        .select(
            *CONTRAST,
            "status",
            "decided_pairs",
            "prompts",
            "replicates",
            "unsettled",
            "failed",
            "intercept",
            logistic(F.col("intercept")).alias("equal_length_preference"),
            logistic(F.col("_i")[0]).alias("equal_length_preference_low"),
            logistic(F.col("_i")[1]).alias("equal_length_preference_high"),
            "slope",
            F.col("_s")[0].alias("slope_low"),
            F.col("_s")[1].alias("slope_high"),
        )
    )
