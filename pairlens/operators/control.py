"""Length and compute control of pairwise verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.functions.ordering import average_rank
from pairlens.functions.stats import sign_test_p, win_rate, wilson_bounds

# Bin bounds and matched bands
LENGTH_BOUNDS = (1.05, 1.10, 1.25, 1.50, 2.00)
COMPUTE_BOUNDS = (0.50, 2 / 3, 0.80, 1 / 1.10, 1 / 1.05, *LENGTH_BOUNDS)
LENGTH_BANDS = (1.05, 1.10)
COMPUTE_BANDS = (1.25, 1.50)
UNIT = ["benchmark", "prompt"]


def ratio_bin(ratio: Column, bounds: Sequence[float], start: float) -> Column:
    """Label of the half-open bin a ratio falls in."""
    edges = [start, *bounds]
    label = F.lit(f"{edges[-1]:.2f}+")
    for low, high in reversed(list(zip(edges, edges[1:]))):
        label = F.when(ratio < high, F.lit(f"{low:.2f}-{high:.2f}")).otherwise(label)
    return F.when(ratio.isNotNull(), label)


def length_columns(left: Column, right: Column) -> list[Column]:
    """Length ratio, its bin and the longer side; null for a non-positive length."""
    ratio = F.when(
        (left > 0) & (right > 0), F.greatest(left, right) / F.least(left, right).cast("double")
    )
    side = F.when(left > right, "left").when(left < right, "right")
    return [
        ratio.alias("ratio"),
        ratio_bin(ratio, LENGTH_BOUNDS, 1.0).alias("ratio_bin"),
        side.alias("longer_side"),
    ]


def compute_columns(left: Column, right: Column) -> list[Column]:
    """Left over right tokens, the ratio away from one, and the bin."""
    ratio = F.when((left > 0) & (right > 0), left / right.cast("double"))
    return [
        ratio.alias("compute_ratio"),
        F.greatest(ratio, 1 / ratio).alias("ratio"),
        ratio_bin(ratio, COMPUTE_BOUNDS, 0.0).alias("ratio_bin"),
    ]


def compute_tokens(
    attempts: Column, status: Column, output: Column, reasoning: Column, total: Column, used: Column
) -> Column:
    """Token count of a run when its accounting is complete and consistent, else null."""
    good = (
        (attempts > 0)
        & (status == "observed")
        & (output >= 0)
        & (reasoning >= 0)
        & (total > 0)
        & (output + reasoning == total)
        & (used == total)
    )
    return F.when(good, total.cast("double"))


def outcome_of(side: Column, verdict: Column = None) -> Column:
    """win, loss or tie of one side of the pair."""
    verdict = F.col("verdict") if verdict is None else verdict
    return F.when(verdict == "tie", "tie").when(verdict == side, "win").otherwise("loss")


def focal_shorter(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs of one contrast whose left output is at least a tenth shorter."""
    return pairs.filter(
        (F.col("left_condition") == left)
        & (F.col("right_condition") == right)
        & (F.col("left_length") * 10 <= F.col("right_length") * 9)
    )


def summarize(rows: DataFrame, keys: Sequence[str], unit: Sequence[str] = UNIT) -> DataFrame:
    """Outcome counts with intervals, over pairs and over prompts.

    ``rows`` carry ``outcome`` (win, loss, tie or null for a pair that is
    selected but not counted) and may carry ``equal_length``. Prompts are
    summed first, so the second aggregate sees one row per prompt.
    """
    equal = F.col("equal_length") if "equal_length" in rows.columns else F.lit(False)
    is_ = lambda name: F.count_if(F.col("outcome") == name)
    per_unit = rows.groupBy(*keys, *unit).agg(
        is_("win").alias("_w"),
        is_("loss").alias("_l"),
        is_("tie").alias("_t"),
        F.count(F.lit(1)).alias("_selected"),
        F.count_if(equal).alias("_equal"),
    )
    net = F.col("_w") - F.col("_l")
    counted = F.col("_w") + F.col("_l") + F.col("_t") > 0
    cells = per_unit.groupBy(*keys).agg(
        F.sum(F.col("_w") + F.col("_l") + F.col("_t")).alias("pairs"),
        F.sum("_selected").alias("selected_pairs"),
        F.sum("_equal").alias("equal_length_pairs"),
        F.sum("_w").alias("wins"),
        F.sum("_l").alias("losses"),
        F.sum("_t").alias("ties"),
        F.count_if(counted).alias("prompts"),
        F.count_if(net > 0).alias("prompt_wins"),
        F.count_if(net < 0).alias("prompt_losses"),
    )
    w, l = F.col("wins"), F.col("losses")
    low, high = wilson_bounds(w, l)
    return cells.select(
        "*",
        (F.col("prompts") - F.col("prompt_wins") - F.col("prompt_losses")).alias("prompt_ties"),
        (w + l).alias("n_non_tie"),
        win_rate(w, l).alias("win_rate"),
        low.alias("wilson_low"),
        high.alias("wilson_high"),
        sign_test_p(w, l).alias("sign_test_p"),
        sign_test_p(F.col("prompt_wins"), F.col("prompt_losses")).alias("prompt_sign_test_p"),
    )


def length_report(
    pairs: DataFrame,
    shorter: tuple[str, str] = ("A7", "A1"),
    bands: Sequence[float] = LENGTH_BANDS,
) -> DataFrame:
    """All length cuts, per run set and over run sets, in one aggregation.

    Cuts: the longer side over all pairs, per contrast and per ratio bin; the
    focal (left) side per contrast, per contrast and band, and for the focal
    pairs that are at least a tenth shorter. Every cut of a pair is one narrow
    copy that the map side sums at once.
    """
    focal = outcome_of(F.lit("left"))
    longer = F.when(F.col("longer_side").isNotNull(), outcome_of(F.col("longer_side")))
    label = F.concat_ws(":", "left_condition", "right_condition")

    def cut(section: str, name: Column, outcome: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), name.alias("cut"), outcome.alias("outcome"))

    in_band = [
        F.when(
            F.col("ratio") <= band,
            cut("length_matched", F.concat(label, F.lit(f" within_{band:g}")), focal),
        )
        for band in bands
    ]
    much_shorter = (
        (F.col("left_condition") == shorter[0])
        & (F.col("right_condition") == shorter[1])
        & (F.col("left_length") * 10 <= F.col("right_length") * 9)
    )
    cuts = F.array(
        cut("longer_overall", F.lit("all"), longer),
        cut("longer_by_contrast", label, longer),
        cut("focal_by_contrast", label, focal),
        cut("longer_by_bin", F.col("ratio_bin"), longer),
        F.when(much_shorter, cut("focal_shorter", label, focal)),
        *in_band,
    )
    rows = (
        pairs.withColumn("_cut", F.explode(F.array_compact(cuts)))
        .withColumn("scope", F.explode(F.array(F.col("run_set").cast("string"), F.lit("pooled"))))
        .select("scope", "_cut.*", F.col("longer_side").isNull().alias("equal_length"), *UNIT)
    )
    return summarize(rows, ["scope", "section", "cut"])


def spearman(pairs: DataFrame, keys: Sequence[str], value: str = "compute_ratio") -> DataFrame:
    """Rank correlation of the ratio with the outcome (win 1, tie 0.5, loss 0).

    Pairs with equal ratio and outcome are counted first; ranks and sums then
    run over those counts, so a very common ratio is one row. The outcome has
    three values, and its ranks follow from three counts.
    """
    score = F.when(F.col("verdict") == "left", 2).when(F.col("verdict") == "right", 0).otherwise(1)
    counts = pairs.filter(F.col(value).isNotNull()).groupBy(*keys, value, score.alias("_score")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    level = lambda i: F.sum(F.when(F.col("_score") == i, F.col("_n")).otherwise(0))
    levels = counts.groupBy(*keys).agg(*[level(i).alias(f"_n{i}") for i in range(3)])
    ranked = average_rank(counts, keys, value, "_rank_x", weight=F.col("_n")).join(levels, list(keys))
    total = F.col("_n0") + F.col("_n1") + F.col("_n2")
    rank_y = (
        F.when(F.col("_score") == 0, (F.col("_n0") + 1) / 2)
        .when(F.col("_score") == 1, F.col("_n0") + (F.col("_n1") + 1) / 2)
        .otherwise(F.col("_n0") + F.col("_n1") + (F.col("_n2") + 1) / 2)
    )
    # both rankings have the mean (n + 1) / 2
    dx, dy, w = F.col("_rank_x") - (total + 1) / 2, rank_y - (total + 1) / 2, F.col("_n")
    sums = ranked.groupBy(*keys).agg(
        F.sum(w).alias("n"),
        F.sum(w * dx * dy).alias("_xy"),
        F.sum(w * dx * dx).alias("_xx"),
        F.sum(w * dy * dy).alias("_yy"),
    )
    varies = (F.col("n") >= 2) & (F.col("_xx") > 0) & (F.col("_yy") > 0)
    rho = F.when(varies, F.col("_xy") / (F.sqrt("_xx") * F.sqrt("_yy")))
    return sums.select(*keys, "n", rho.alias("rho"))


def compute_report(
    pairs: DataFrame, contrasts: DataFrame, bands: Sequence[float] = COMPUTE_BANDS
) -> DataFrame:
    """All compute cuts per scope; requested contrasts stay with zero rows."""
    label = F.concat_ws(":", "left_condition", "right_condition")
    cut = lambda section, name: F.struct(
        F.lit(section).alias("section"), name.alias("cut")
    )
    cuts = F.array(
        cut("focal", F.lit("all")),
        cut("ratio_bin", F.col("ratio_bin")),
        *[
            F.when(F.col("ratio") <= band, cut("compute_matched", F.lit(f"within_{band:g}")))
            for band in bands
        ],
    )
    rows = (
        pairs.withColumn("_cut", F.explode(F.array_compact(cuts)))
        .withColumn("scope", F.explode(F.array(F.col("run_set").cast("string"), F.lit("pooled"))))
        .select("scope", label.alias("contrast"), "_cut.*", outcome_of(F.lit("left")).alias("outcome"), *UNIT)
    )
    report = summarize(rows, ["scope", "contrast", "section", "cut"]).drop("equal_length_pairs")
    wanted = contrasts.select(
        F.concat_ws(":", "left_condition", "right_condition").alias("contrast"),
        F.lit("pooled").alias("scope"),
        F.lit("focal").alias("section"),
        F.lit("all").alias("cut"),
    )
    keys = ["scope", "contrast", "section", "cut"]
    counts = ["pairs", "selected_pairs", "wins", "losses", "ties", "prompts"]
    empty = wanted.join(report.select(*keys), keys, "left_anti").select(
        *keys,
        *[F.lit(0).cast("bigint").alias(c) for c in (*counts, "prompt_wins", "prompt_losses", "prompt_ties", "n_non_tie")],
        F.lit(1.0).alias("sign_test_p"),
        F.lit(1.0).alias("prompt_sign_test_p"),
    )
    return report.unionByName(empty, allowMissingColumns=True)


def length_strata(pairs: DataFrame, keys: Sequence[str], minimum: int) -> DataFrame:
    """Results raw and by length stratum; strata below the minimum size are left out."""
    rows = pairs.withColumn(
        "stratum", F.explode(F.array(F.lit("raw"), F.col("ratio_bin")))
    ).withColumn("outcome", outcome_of(F.lit("left")))
    cells = summarize(rows, [*keys, "stratum"])
    return cells.filter((F.col("stratum") == "raw") | (F.col("pairs") >= minimum))


def score_strata(
    scores: DataFrame, keys: Sequence[str], values: Sequence[str], length: Column, requested: Column, minimum: int
) -> DataFrame:
    """Mean scores raw and by stratum of the output length against the requested one; small strata are left out.

    The stratum is the frozen bin of the larger over the smaller of both lengths. Scores without two positive lengths
    have no stratum and count in the raw means alone.
    """
    known = (length > 0) & (requested > 0)
    ratio = F.when(known, F.greatest(length, requested) / F.least(length, requested).cast("double"))
    cut = F.array_compact(F.array(F.lit("raw"), ratio_bin(ratio, LENGTH_BOUNDS, 1.0)))
    rows = scores.select(*keys, *values, F.explode(cut).alias("stratum"))
    cells = rows.groupBy(*keys, "stratum").agg(F.count(F.lit(1)).alias("scores"), *[F.avg(v).alias(v) for v in values])
    return cells.filter((F.col("stratum") == "raw") | (F.col("scores") >= minimum))
