"""Agreement between judges and between human raters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.functions.stats import sign_test_p, win_rate, wilson_bounds


def join_two_judges(
    pairs: DataFrame, key: Sequence[str], judges: tuple[str, str], values: Sequence[str]
) -> DataFrame:
    """Pairs scored by both judges, side by side, with one shuffle.

    The first artifact per judge and key (by ``artifact``) counts.
    """
    own = F.struct(*values)
    pick = lambda j: F.min_by(
        F.when(F.col("judge_id") == j, own), F.when(F.col("judge_id") == j, F.col("artifact"))
    )
    both = pairs.filter(F.col("judge_id").isin(*judges)).groupBy(*key).agg(
        pick(judges[0]).alias("_c"), pick(judges[1]).alias("_r")
    )
    return both.filter(F.col("_c").isNotNull() & F.col("_r").isNotNull()).select(
        *key,
        *[F.col(f"_c.{v}").alias(f"cross_{v}") for v in values],
        *[F.col(f"_r.{v}").alias(f"reference_{v}") for v in values],
    )


def cross_judge_metrics(joined: DataFrame, cuts: Sequence[Sequence[str]]) -> DataFrame:
    """Counts, commit and win rates, agreements and conflicts for several cuts at once."""
    cross, ref = F.col("cross_verdict"), F.col("reference_verdict")
    agree = (F.col("cross_code_ab") == F.col("reference_code_ab")).cast("int") + (
        F.col("cross_code_ba") == F.col("reference_code_ba")
    ).cast("int")
    columns = list(dict.fromkeys(c for cut in cuts for c in cut))
    cells = joined.groupingSets([list(c) for c in cuts], *columns).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(cross == "left").alias("wins"),
        F.count_if(cross == "right").alias("losses"),
        F.count_if(cross == "tie").alias("ties"),
        F.sum(agree).alias("presentation_agreement"),
        F.count_if(cross == ref).alias("collapsed_agreement"),
        F.count_if((cross != "tie") & (ref != "tie") & (cross != ref)).alias("direction_conflicts"),
    )
    decided = F.col("wins") + F.col("losses")
    commit_low, commit_high = wilson_bounds(decided, F.col("n") - decided)
    low, high = wilson_bounds(F.col("wins"), F.col("losses"))
    return cells.select(
        *columns,
        "n",
        "wins",
        "losses",
        "ties",
        win_rate(decided, F.col("n") - decided).alias("commit_rate"),
        commit_low.alias("commit_low"),
        commit_high.alias("commit_high"),
        win_rate(F.col("wins"), F.col("losses")).alias("win_rate"),
        low.alias("win_low"),
        high.alias("win_high"),
        sign_test_p(F.col("wins"), F.col("losses")).alias("sign_test_p"),
        "presentation_agreement",
        (2 * F.col("n")).alias("presentation_total"),
        "collapsed_agreement",
        "direction_conflicts",
    )


def provenance_constant(manifests: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Distinct non-null values of each judge field; exactly one is required."""
    counts = manifests.agg(
        *[F.countDistinct(f).alias(f"{f}_n") for f in fields],
        *[F.min(F.col(f).cast("string")).alias(f"{f}_v") for f in fields],
    )
    entry = lambda f: F.struct(
        F.lit(f).alias("field"),
        F.col(f"{f}_n").alias("distinct_values"),
        F.when(F.col(f"{f}_n") == 1, F.col(f"{f}_v")).alias("value"),
    )
    rows = counts.select(F.explode(F.array(*[entry(f) for f in fields])).alias("_e")).select("_e.*")
    return rows.withColumn("consistent", F.col("distinct_values") == 1)


def cohen_kappa(
    pairs: DataFrame, keys: Sequence[str], first: str, second: str, certain: float | None = None
) -> DataFrame:
    """Cohen's kappa from the contingency counts.

    ``certain`` is the value when chance agreement is one; null by default.
    """
    table = pairs.groupBy(*keys, F.col(first).alias("_a"), F.col(second).alias("_b")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    sides = table.withColumn("_m", F.explode(F.array(
        F.struct(F.lit("a").alias("side"), F.col("_a").alias("category")),
        F.struct(F.lit("b").alias("side"), F.col("_b").alias("category")),
    ))).groupBy(*keys, "_m.category").agg(
        F.sum(F.when(F.col("_m.side") == "a", F.col("_n")).otherwise(0)).alias("_na"),
        F.sum(F.when(F.col("_m.side") == "b", F.col("_n")).otherwise(0)).alias("_nb"),
    )
    expected = sides.groupBy(*keys).agg(
        F.sum(F.col("_na").cast("double") * F.col("_nb")).alias("_products")
    )
    totals = table.groupBy(*keys).agg(
        F.sum("_n").alias("pairs"),
        F.sum(F.when(F.col("_a") == F.col("_b"), F.col("_n")).otherwise(0)).alias("agreeing"),
    )
    joined = totals.join(expected, list(keys)) if keys else totals.join(F.broadcast(expected))
    n = F.col("pairs").cast("double")
    chance = F.col("_products") / (n * n)
    kappa = F.when(chance < 1, (F.col("agreeing") / n - chance) / (1 - chance)).otherwise(
        F.lit(certain).cast("double")
    )
    return joined.select(*keys, "pairs", "agreeing", kappa.alias("kappa"))


def judge_agreement(joined: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Kappa on all pairs and on pairs both judges decided, overall and per key."""
    scoped = joined.withColumn("scope", F.explode(F.array(F.lit("all"), F.concat_ws(":", *keys))))
    decided = scoped.filter(
        (F.col("cross_verdict") != "tie") & (F.col("reference_verdict") != "tie")
    )
    a = cohen_kappa(scoped, ["scope"], "reference_verdict", "cross_verdict")
    b = cohen_kappa(decided, ["scope"], "reference_verdict", "cross_verdict").withColumnsRenamed(
        {
            "pairs": "both_decided_pairs",
            "agreeing": "both_decided_agreeing",
            "kappa": "both_decided_kappa",
        }
    )
    return a.join(b, "scope", "left")


def unit_counts(ratings: DataFrame, keys: Sequence[str], unit: str, value: str) -> DataFrame:
    """Ratings per unit and category: everything the coefficients need."""
    return ratings.groupBy(*keys, unit, value).agg(F.count(F.lit(1)).alias("c"))


def rater_agreement(ratings: DataFrame, keys: Sequence[str], unit: str, value: str) -> DataFrame:
    """Raw agreement, Fleiss' kappa and Krippendorff's alpha from counts.

    No pair of raters is ever formed. Fleiss and alpha use units with two or
    more ratings; alpha weights a unit by n(n-1).
    """
    counts = unit_counts(ratings, keys, unit, value)
    per_unit = counts.groupBy(*keys, unit).agg(
        F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("sq")
    )
    n, sq = F.col("n"), F.col("sq")
    rated = n >= 2
    pairs = n * (n - 1)
    cells = per_unit.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("comparisons"),
        F.sum("n").alias("ratings"),
        F.sum((sq - n) / 2).alias("_agree"),
        F.sum(pairs / 2).alias("_possible"),
        F.avg(F.when(rated, (sq - n) / pairs)).alias("_fleiss"),
        F.sum(F.when(rated, n * n - sq)).alias("_disagree"),
        F.sum(F.when(rated, pairs)).alias("_pairs"),
        F.sum(F.when(rated, n)).alias("_values"),
    )
    # category totals over units with two ratings or more
    usable = counts.join(per_unit.filter(rated).select(*keys, unit), [*keys, unit], "left_semi")
    shares = usable.groupBy(*keys, value).agg(F.sum("c").alias("_c")).groupBy(*keys).agg(
        F.sum(F.col("_c").cast("double") * F.col("_c")).alias("_cc")
    )
    joined = cells.join(shares, list(keys), "left") if keys else cells.join(F.broadcast(shares))
    total = F.col("_values").cast("double")
    fleiss_chance = F.col("_cc") / (total * total)
    observed = F.col("_disagree") / F.col("_pairs")
    expected = (total * total - F.col("_cc")) / (total * (total - 1))
    raw = F.when(F.col("_possible") > 0, F.col("_agree") / F.col("_possible"))
    return joined.select(
        *keys,
        "comparisons",
        "ratings",
        raw.alias("raw_agreement"),
        (1 - raw).alias("disagreement"),
        F.when(fleiss_chance == 1, 1.0)
        .otherwise((F.col("_fleiss") - fleiss_chance) / (1 - fleiss_chance))
        .alias("fleiss_kappa"),
        F.when(expected == 0, F.when(observed == 0, 1.0).otherwise(0.0))
        .otherwise(1 - observed / expected)
        .alias("krippendorff_alpha"),
    )


def majority_vote(ratings: DataFrame, unit: Sequence[str], value: str) -> DataFrame:
    """Modal value per unit, ``tie`` when several values share the highest count."""
    counts = ratings.groupBy(*unit, value).agg(F.count(F.lit(1)).alias("c"))
    best = counts.groupBy(*unit).agg(
        F.max(F.struct("c", value)).alias("_hi"),
        F.min(F.struct((-F.col("c")).alias("c"), value)).alias("_lo"),
        F.sum("c").alias("votes"),
    )
    # the largest and smallest value among those with the top count
    same = F.col(f"_hi.{value}") == F.col(f"_lo.{value}")
    return best.select(
        *unit, "votes", F.when(same, F.col(f"_hi.{value}")).otherwise("tie").alias("majority")
    )


def human_side(preference: Column, contrast_left: Column, contrast_right: Column, condition_a: Column) -> Column:
    """Condition preferred by a rater who saw ``condition_a`` as A."""
    other = F.when(condition_a == contrast_left, contrast_right).otherwise(contrast_left)
    return (
        F.when(preference == "tie", "tie")
        .when(preference == "A", condition_a)
        .when(preference == "B", other)
    )


def join_human_key(answers: DataFrame, key: DataFrame, annotators: Sequence[str]) -> DataFrame:
    """Answers with the condition each one prefers; unknown comparisons drop out.

    The key has one ``condition_a_<n>`` column per annotator, unpivoted here.
    """
    sides = key.select(
        *[c for c in key.columns if not c.startswith("condition_a_")],
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(a).alias("annotator_id"), F.col(f"condition_a_{a.rsplit('-', 1)[-1]}").alias("condition_a")
                    )
                    for a in annotators
                ]
            )
        ).alias("_s"),
    ).select("*", "_s.*").drop("_s")
    joined = answers.join(sides, ["comparison_id", "annotator_id"])
    return joined.withColumn(
        "condition",
        human_side(
            F.col("preference"), F.col("left_condition"), F.col("right_condition"), F.col("condition_a")
        ),
    )


def human_auto_agreement(
    rated: DataFrame, dimensions: Sequence[str], decisions: Sequence[str]
) -> DataFrame:
    """Majority against each automatic decision, overall and per dimension; a missing group is "unknown".

    ``rated`` has one row per rating, with the key's columns beside it.
    """
    unit = ["comparison_id", *dimensions, *decisions]
    votes = majority_vote(rated, unit, "condition")
    families = F.explode(
        F.array(
            *[F.struct(F.lit(d).alias("family"), F.col(d).alias("decision")) for d in decisions]
        )
    )
    cut = lambda name, column: F.struct(
        F.lit(name).alias("dimension"), F.coalesce(column.cast("string"), F.lit("unknown")).alias("group")
    )
    cuts = F.array(cut("overall", F.lit("all")), *[cut(d, F.col(d)) for d in dimensions])
    rows = (
        votes.withColumn("_f", families)
        .filter(F.coalesce(F.col("_f.decision"), F.lit("")) != "")
        .withColumn("_cut", F.explode(cuts))
    )
    return rows.groupBy("_cut.dimension", "_cut.group", "_f.family").agg(
        F.count(F.lit(1)).alias("comparisons"),
        F.count_if(F.col("_f.decision") == F.col("majority")).alias("matches"),
        F.avg((F.col("_f.decision") == F.col("majority")).cast("double")).alias("agreement"),
    )


def decision_margin(votes: DataFrame, unit: Sequence[str], value: str) -> DataFrame:
    """Top vote count minus the second one."""
    counts = votes.groupBy(*unit, value).agg(F.count(F.lit(1)).alias("c"))
    tops = counts.groupBy(*unit).agg(F.max("c").alias("_top"))
    ranked = counts.join(tops, list(unit)).groupBy(*unit).agg(
        F.any_value("_top").alias("_top"),
        F.count_if(F.col("c") == F.col("_top")).alias("_n"),
        F.max(F.when(F.col("c") < F.col("_top"), F.col("c"))).alias("_next"),
    )
    second = F.when(F.col("_n") > 1, F.col("_top")).otherwise(F.coalesce("_next", F.lit(0)))
    return ranked.select(*unit, (F.col("_top") - second).alias("margin"))
