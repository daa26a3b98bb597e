"""Measures stated by the evaluation protocol."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.functions.ordering import average_rank, exact_quantiles, ranked_values
from pairlens.functions.stats import normal_two_sided_p
from pairlens.session import written


def length_deviation(requested: Column, produced: Column) -> Column:
    """Relative distance from the requested length; null without a request."""
    return F.when(requested > 0, F.abs(produced - requested) / requested)


def length_compliance(rows: DataFrame, keys: Sequence[str], requested: Column, produced: Column, within: float = 0.20) -> DataFrame:
    """Requests, mean deviation and the share of deviations of at most ``within`` per group; rows without a request count in none."""
    d = length_deviation(requested, produced)
    return rows.groupBy(*keys).agg(
        F.count(d).alias("requested"),
        F.avg(d).alias("mean_deviation"),
        F.avg((d <= within).cast("double")).alias("compliance"),
    )


def length_score(requested: Column, produced: Column) -> Column:
    """0 to 100: falls to zero at four times the request, or a third of it."""
    over = 100 * F.greatest(F.lit(0.0), 1 - (produced / requested - 1) / 3)
    under = 100 * F.greatest(F.lit(0.0), 1 - (requested / produced - 1) / 2)
    return F.when(
        requested > 0,
        F.when(produced == 0, 0.0).when(produced > requested, over).otherwise(under),
    )


def wilcoxon_signed_rank(diffs: DataFrame, keys: Sequence[str], value: str = "diff") -> DataFrame:
    """Signed-rank sums with a tie-corrected normal p-value; zeros are dropped.

    Equal differences are counted first; ranks come from those counts, bucket by
    bucket, so no contrast is ordered in one task.
    """
    up = F.col(value) > 0
    sizes = diffs.filter(F.col(value) != 0).select(*keys, F.abs(F.col(value)).alias("_abs"), up.cast("bigint").alias("_up"))
    # the offsets of the ranks are a branch of their own
    sizes = written(sizes, "sizes")
    ranked = ranked_values(sizes, keys, "_abs", "_rank", F.count(F.lit(1)), {"_up": F.sum("_up")})
    n, ties = F.col("_rank_ties"), F.col("_rank_ties").cast("double")
    cells = ranked.groupBy(*keys).agg(
        F.sum(n).alias("n"),
        F.sum(F.col("_up") * F.col("_rank")).alias("w_plus"),
        F.sum((n - F.col("_up")) * F.col("_rank")).alias("w_minus"),
        # a group of t ties adds t^3 - t
        F.sum(ties * (ties * ties - 1)).alias("_ties"),
    )
    n = F.col("n").cast("double")
    mean = n * (n + 1) / 4
    variance = n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48
    z = F.when(variance > 0, (F.col("w_plus") - mean) / F.sqrt(variance)).otherwise(0.0)
    return cells.select(
        *keys, "n", "w_plus", "w_minus", z.alias("z"), normal_two_sided_p(z).alias("p")
    )


def paired_summary(diffs: DataFrame, keys: Sequence[str], value: str = "diff") -> DataFrame:
    """Mean and median difference and the standardised effect; several branches read the differences, so they are stored."""
    diffs = written(diffs.select(*keys, value), "differences")
    cells = diffs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(value).alias("mean_difference"),
        F.stddev_samp(value).alias("_sd"),
    )
    medians = exact_quantiles(diffs, keys, value, {"median_difference": 0.5})
    effect = F.when(F.col("_sd") > 0, F.col("mean_difference") / F.col("_sd"))
    return cells.join(medians, list(keys)).withColumn("effect_size", effect).drop("_sd")


def rank_agreement(scores: DataFrame, keys: Sequence[str], platforms: tuple[str, str]) -> DataFrame:
    """Rank correlation of the systems' scores between two platforms.

    ``scores`` has one row per key, platform and system: a report table.
    """
    sides = scores.filter(F.col("platform").isin(*platforms)).groupBy(*keys, "condition").agg(
        *[
            F.max(F.when(F.col("platform") == p, F.col("score"))).alias(f"_{i}")
            for i, p in enumerate(platforms)
        ]
    ).filter(F.col("_0").isNotNull() & F.col("_1").isNotNull())
    from pairlens.functions.ordering import signed_bucket

    one = average_rank(sides, keys, "_0", "_r0", signed_bucket(F.col("_0")))
    two = average_rank(one, keys, "_1", "_r1", signed_bucket(F.col("_1")))
    return two.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("systems"), F.corr("_r0", "_r1").alias("rho")
    )


def covariate_adjusted_fit(rows: DataFrame, outcome: str, labels: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """Linear fit of an outcome on conditions and covariates.

    One-hot levels and the weighted least squares run in Spark ML; the result
    has one row per coefficient. Every stage of the fit reads its input again,
    so equal rows are merged into one with a weight and stored first.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    columns = [outcome, *labels, *numbers]
    merged = rows.dropna(subset=columns).groupBy(*columns).agg(F.count(F.lit(1)).cast("double").alias("_weight"))
    kept = written(merged, "fit_rows")
    stages = []
    for name in labels:
        stages.append(StringIndexer(inputCol=name, outputCol=f"_{name}_i", stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCol=f"_{name}_i", outputCol=f"_{name}_v", dropLast=True))
    features = [*[f"_{name}_v" for name in labels], *numbers]
    stages.append(VectorAssembler(inputCols=features, outputCol="_features"))
    stages.append(
        GeneralizedLinearRegression(
            family="gaussian", link="identity", featuresCol="_features", labelCol=outcome, weightCol="_weight",
            regParam=0.0,
        )
    )
    model = Pipeline(stages=stages).fit(kept)
    fitted = model.stages[-1]
    names = []
    for i, name in enumerate(labels):
        levels = list(model.stages[2 * i].labels)
        names += [f"{name}={level}" for level in levels[:-1]]
    names += list(numbers)
    coefficients = [("intercept", float(fitted.intercept))] + [
        (n, float(c)) for n, c in zip(names, fitted.coefficients)
    ]
    return rows.sparkSession.createDataFrame(coefficients, "term string, coefficient double")
