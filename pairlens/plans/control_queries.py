"""Registered queries of the length, compute and robustness reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.functions.ordering import average_rank
from pairlens.functions.stats import round6, sign_test_p
from pairlens.operators import control as L
from pairlens.operators import models as M
from pairlens.operators import pairs as P
from pairlens.operators import quality as Q
from pairlens.operators import resampling as B
from pairlens.plans import views as V
from pairlens.plans.pairwise_queries import rounded
from pairlens.plans.quality_queries import DIM, POINT_SQL, pointwise
from pairlens.plans.registry import Tables, query, r6
from pairlens.session import written

SHORTER = ("A4", "A1")


def bin_sql(ratio: str, bounds, start: float) -> str:
    edges = [start, *bounds]
    cases = " ".join(
        f"WHEN {ratio} < CAST({high!r} AS DOUBLE) THEN '{low:.2f}-{high:.2f}'" for low, high in zip(edges, edges[1:])
    )
    return f"CASE {cases} ELSE '{edges[-1]:.2f}+' END"


def length_pairs(t: Tables) -> DataFrame:
    pairs = V.measured(t, ["run_set"])
    return pairs.select("*", *L.length_columns(F.col("left_length"), F.col("right_length")))


def compute_pairs(t: Tables) -> DataFrame:
    pairs = V.measured(t, ["run_set"])
    return pairs.select("*", *L.compute_columns(F.col("left_tokens"), F.col("right_tokens")))


LEN_SQL = f"""{V.VERDICT_RUN_SQL}, lr AS (SELECT *, greatest(left_length, right_length) / CAST(least(left_length, right_length) AS DOUBLE) AS ratio,
  CASE WHEN left_length > right_length THEN 'left' WHEN left_length < right_length THEN 'right' END AS longer_side FROM verdicts),
lp AS (SELECT *, {bin_sql('ratio', L.LENGTH_BOUNDS, 1.0)} AS ratio_bin,
  CASE verdict WHEN 'tie' THEN 'tie' WHEN 'left' THEN 'win' ELSE 'loss' END AS focal,
  CASE WHEN longer_side IS NULL THEN NULL WHEN verdict = 'tie' THEN 'tie' WHEN verdict = longer_side THEN 'win' ELSE 'loss' END AS longer FROM lr)"""
CMP_SQL = f"""{V.VERDICT_RUN_SQL}, cr AS (SELECT *, left_tokens / CAST(right_tokens AS DOUBLE) AS compute_ratio FROM verdicts),
cp AS (SELECT *, greatest(compute_ratio, 1 / compute_ratio) AS ratio, {bin_sql('compute_ratio', L.COMPUTE_BOUNDS, 0.0)} AS ratio_bin,
  CASE verdict WHEN 'tie' THEN 'tie' WHEN 'left' THEN 'win' ELSE 'loss' END AS focal FROM cr)"""


def summary_sql(source: str, keys: str, equal: bool = True) -> str:
    """SQL twin of control.summarize over (keys, benchmark, prompt, outcome, equal_length)."""
    eq = "CAST(sum(e) AS BIGINT) AS equal_length_pairs," if equal else ""
    eq_in = "count(*) FILTER (equal_length) AS e," if equal else ""
    return f"""units AS (SELECT {keys}, benchmark, prompt, count(*) FILTER (outcome = 'win') AS w, count(*) FILTER (outcome = 'loss') AS l,
  count(*) FILTER (outcome = 'tie') AS ti, {eq_in} count(*) AS sel FROM {source} GROUP BY ALL),
tallied AS (SELECT {keys}, CAST(sum(w + l + ti) AS BIGINT) AS pairs, CAST(sum(sel) AS BIGINT) AS selected_pairs, {eq}
  CAST(sum(w) AS BIGINT) AS wins, CAST(sum(l) AS BIGINT) AS losses, CAST(sum(ti) AS BIGINT) AS ties,
  count(*) FILTER (w + l + ti > 0) AS prompts, count(*) FILTER (w > l) AS prompt_wins, count(*) FILTER (w < l) AS prompt_losses
  FROM units GROUP BY ALL),
summary AS (SELECT *, prompts - prompt_wins - prompt_losses AS prompt_ties, wins + losses AS n_non_tie,
  {r6(V.rate_sql('wins', 'losses'))} AS win_rate, {r6(V.wilson_sql('wins', 'losses', 'low'))} AS wilson_low,
  {r6(V.wilson_sql('wins', 'losses', 'high'))} AS wilson_high, {r6(V.sign_sql('wins', 'losses'))} AS sign_test_p,
  {r6(V.sign_sql('prompt_wins', 'prompt_losses'))} AS prompt_sign_test_p FROM tallied)"""


STATS = ("win_rate", "wilson_low", "wilson_high", "sign_test_p", "prompt_sign_test_p")


@query(
    "length_ratio",
    f"""WITH {LEN_SQL} SELECT benchmark, coalesce(longer_side, 'equal') AS longer_side, coalesce(longer, 'none') AS longer_verdict,
      count(*) AS n, {r6('avg(ratio)')} AS mean_ratio FROM lp GROUP BY ALL""",
)
def length_ratio(t: Tables) -> DataFrame:
    longer = F.when(F.col("longer_side").isNotNull(), L.outcome_of(F.col("longer_side")))
    rows = length_pairs(t).withColumn("longer_verdict", F.coalesce(longer, F.lit("none")))
    return (
        rows.withColumn("longer_side", F.coalesce("longer_side", F.lit("equal")))
        .groupBy("benchmark", "longer_side", "longer_verdict")
        .agg(F.count(F.lit(1)).alias("n"), round6(F.avg("ratio")).alias("mean_ratio"))
    )


@query(
    "compute_ratio",
    f"""WITH {CMP_SQL} SELECT benchmark, left_condition, right_condition, count(*) AS n, {r6('avg(compute_ratio)')} AS mean_ratio,
      {r6('avg(ratio)')} AS mean_relative, {r6('max(ratio)')} AS max_relative FROM cp GROUP BY ALL""",
)
def compute_ratio(t: Tables) -> DataFrame:
    report = compute_pairs(t).groupBy("benchmark", *P.CONTRAST).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("compute_ratio").alias("mean_ratio"),
        F.avg("ratio").alias("mean_relative"),
        F.max("ratio").alias("max_relative"),
    )
    return rounded(report, "mean_ratio", "mean_relative", "max_relative")


@query("ratio_bin_length", f"WITH {LEN_SQL} SELECT benchmark, ratio_bin, verdict, count(*) AS n FROM lp GROUP BY ALL")
def ratio_bin_length(t: Tables) -> DataFrame:
    return length_pairs(t).groupBy("benchmark", "ratio_bin", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query("ratio_bin_compute", f"WITH {CMP_SQL} SELECT benchmark, ratio_bin, verdict, count(*) AS n FROM cp GROUP BY ALL")
def ratio_bin_compute(t: Tables) -> DataFrame:
    return compute_pairs(t).groupBy("benchmark", "ratio_bin", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query(
    "matched_band",
    f"""WITH {LEN_SQL} SELECT benchmark, left_condition, right_condition, count(*) FILTER (ratio <= 1.05) AS within_5,
      count(*) FILTER (ratio <= 1.1) AS within_10, count(*) AS pairs FROM lp GROUP BY ALL""",
)
def matched_band(t: Tables) -> DataFrame:
    within = lambda band: F.count_if(F.col("ratio") <= band)
    return length_pairs(t).groupBy("benchmark", *P.CONTRAST).agg(
        within(1.05).alias("within_5"), within(1.10).alias("within_10"), F.count(F.lit(1)).alias("pairs")
    )


@query(
    "focal_shorter",
    f"""WITH {LEN_SQL}, sel AS (SELECT benchmark, prompt, focal AS outcome FROM lp WHERE right_condition = 'A1' AND left_length * 10 <= right_length * 9),
    {summary_sql('(SELECT *, benchmark AS bench FROM sel)', 'bench', False)} SELECT * FROM summary""",
)
def focal_shorter(t: Tables) -> DataFrame:
    rows = L.focal_shorter(length_pairs(t), *SHORTER).select(
        F.col("benchmark").alias("bench"), *L.UNIT, L.outcome_of(F.lit("left")).alias("outcome")
    )
    return rounded(L.summarize(rows, ["bench"]).drop("equal_length_pairs"), *STATS)


ELIGIBLE_COLUMNS = [
    *V.RUN_COLUMNS[:4],
    "CAST(o_orderkey % 4 AS BIGINT) AS attempts",
    "CASE WHEN o_orderkey % 5 = 0 THEN 'estimated' ELSE 'observed' END AS accounting",
    "CAST(floor(o_totalprice) AS BIGINT) AS output_tokens",
    "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_custkey END AS reasoning_tokens",
    "CAST(floor(o_totalprice) AS BIGINT) + o_custkey + CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0 END AS total_tokens",
    "CAST(floor(o_totalprice) AS BIGINT) + o_custkey + CASE WHEN o_orderkey % 10 = 1 THEN 1 ELSE 0 END AS budget_used",
]


@query(
    "compute_eligible",
    f"""WITH e AS (SELECT {', '.join(ELIGIBLE_COLUMNS)} FROM orders), f AS (SELECT *, attempts > 0 AND accounting = 'observed'
      AND output_tokens >= 0 AND reasoning_tokens >= 0 AND total_tokens > 0 AND output_tokens + reasoning_tokens = total_tokens
      AND budget_used = total_tokens AS good FROM e)
    SELECT benchmark, condition, count(*) AS runs, count(*) FILTER (good) AS eligible,
      CAST(coalesce(sum(total_tokens) FILTER (good), 0) AS BIGINT) AS tokens FROM f GROUP BY ALL""",
)
def compute_eligible(t: Tables) -> DataFrame:
    runs = t.orders.selectExpr(*ELIGIBLE_COLUMNS)
    tokens = L.compute_tokens(
        *[
            F.col(c)
            for c in ("attempts", "accounting", "output_tokens", "reasoning_tokens", "total_tokens", "budget_used")
        ]
    )
    return runs.withColumn("tokens", tokens).groupBy("benchmark", "condition").agg(
        F.count(F.lit(1)).alias("runs"),
        F.count("tokens").alias("eligible"),
        F.coalesce(F.sum(F.col("tokens").cast("bigint")), F.lit(0)).alias("tokens"),
    )


@query(
    "outcome_summary_length",
    f"""WITH {LEN_SQL}, src AS (SELECT left_condition, right_condition, benchmark, prompt, longer AS outcome, longer_side IS NULL AS equal_length FROM lp),
    {summary_sql('src', 'left_condition, right_condition')} SELECT * FROM summary""",
)
def outcome_summary_length(t: Tables) -> DataFrame:
    longer = F.when(F.col("longer_side").isNotNull(), L.outcome_of(F.col("longer_side")))
    rows = length_pairs(t).select(
        *P.CONTRAST, *L.UNIT, longer.alias("outcome"), F.col("longer_side").isNull().alias("equal_length")
    )
    return rounded(L.summarize(rows, P.CONTRAST), *STATS)


@query(
    "outcome_summary_compute",
    f"""WITH {CMP_SQL}, src AS (SELECT left_condition, right_condition, benchmark, prompt, focal AS outcome FROM cp),
    {summary_sql('src', 'left_condition, right_condition', False)} SELECT * FROM summary""",
)
def outcome_summary_compute(t: Tables) -> DataFrame:
    rows = compute_pairs(t).select(
        *P.CONTRAST, *L.UNIT, L.outcome_of(F.lit("left")).alias("outcome")
    )
    return rounded(L.summarize(rows, P.CONTRAST).drop("equal_length_pairs"), *STATS)


LENGTH_CUTS = """cuts AS (
  SELECT run_set, benchmark, prompt, 'longer_overall' AS section, 'all' AS cut, longer AS outcome, longer_side IS NULL AS equal_length FROM lp
  UNION ALL SELECT run_set, benchmark, prompt, 'longer_by_contrast', left_condition || ':' || right_condition, longer, longer_side IS NULL FROM lp
  UNION ALL SELECT run_set, benchmark, prompt, 'focal_by_contrast', left_condition || ':' || right_condition, focal, longer_side IS NULL FROM lp
  UNION ALL SELECT run_set, benchmark, prompt, 'longer_by_bin', ratio_bin, longer, longer_side IS NULL FROM lp
  UNION ALL SELECT run_set, benchmark, prompt, 'focal_shorter', left_condition || ':' || right_condition, focal, longer_side IS NULL FROM lp
    WHERE right_condition = 'A1' AND left_length * 10 <= right_length * 9
  UNION ALL SELECT run_set, benchmark, prompt, 'length_matched', left_condition || ':' || right_condition || ' within_1.05', focal, longer_side IS NULL FROM lp WHERE ratio <= 1.05
  UNION ALL SELECT run_set, benchmark, prompt, 'length_matched', left_condition || ':' || right_condition || ' within_1.1', focal, longer_side IS NULL FROM lp WHERE ratio <= 1.1),
scoped AS (SELECT CAST(run_set AS VARCHAR) AS scope, * EXCLUDE (run_set) FROM cuts UNION ALL SELECT 'pooled', * EXCLUDE (run_set) FROM cuts)"""


@query(
    "length_report",
    f"WITH {LEN_SQL}, {LENGTH_CUTS}, {summary_sql('scoped', 'scope, section, cut')} SELECT * FROM summary",
)
def length_report(t: Tables) -> DataFrame:
    return rounded(L.length_report(length_pairs(t), SHORTER), *STATS)


COMPUTE_CONTRASTS = (*V.CONTRASTS, ("A4", "A5"))
COMPUTE_CUTS = """cuts AS (
  SELECT run_set, benchmark, prompt, left_condition || ':' || right_condition AS contrast, 'focal' AS section, 'all' AS cut, focal AS outcome FROM cp
  UNION ALL SELECT run_set, benchmark, prompt, left_condition || ':' || right_condition, 'ratio_bin', ratio_bin, focal FROM cp
  UNION ALL SELECT run_set, benchmark, prompt, left_condition || ':' || right_condition, 'compute_matched', 'within_1.25', focal FROM cp WHERE ratio <= 1.25
  UNION ALL SELECT run_set, benchmark, prompt, left_condition || ':' || right_condition, 'compute_matched', 'within_1.5', focal FROM cp WHERE ratio <= 1.5),
scoped AS (SELECT CAST(run_set AS VARCHAR) AS scope, * EXCLUDE (run_set) FROM cuts UNION ALL SELECT 'pooled', * EXCLUDE (run_set) FROM cuts)"""


@query(
    "compute_report",
    f"""WITH {CMP_SQL}, {COMPUTE_CUTS}, {summary_sql('scoped', 'scope, contrast, section, cut', False)} SELECT * FROM summary
    UNION ALL SELECT 'pooled', 'A4:A5', 'focal', 'all', 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, NULL, NULL, NULL, 1.0, 1.0""",
)
def compute_report(t: Tables) -> DataFrame:
    return rounded(L.compute_report(compute_pairs(t), V.contrast_table(t, COMPUTE_CONTRASTS)), *STATS)


@query(
    "prompt_clustered_sign",
    f"""WITH {LEN_SQL}, src AS (SELECT left_condition, right_condition, benchmark, prompt, focal AS outcome FROM lp),
    {summary_sql('src', 'left_condition, right_condition', False)}
    SELECT left_condition, right_condition, prompts, prompt_wins, prompt_losses, prompt_ties, prompt_sign_test_p FROM summary""",
)
def prompt_clustered_sign(t: Tables) -> DataFrame:
    rows = length_pairs(t).select(*P.CONTRAST, *L.UNIT, L.outcome_of(F.lit("left")).alias("outcome"))
    return rounded(P.clustered_sign(rows, P.CONTRAST, L.UNIT), "prompt_sign_test_p")


RANK_SQL = f"""{CMP_SQL}, sc AS (SELECT *, CASE verdict WHEN 'left' THEN 1.0 WHEN 'right' THEN 0.0 ELSE 0.5 END AS score FROM cp),
rk AS (SELECT *, rank() OVER (PARTITION BY benchmark, left_condition, right_condition ORDER BY compute_ratio)
    + (count(*) OVER (PARTITION BY benchmark, left_condition, right_condition, compute_ratio) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY benchmark, left_condition, right_condition ORDER BY score)
    + (count(*) OVER (PARTITION BY benchmark, left_condition, right_condition, score) - 1) / 2.0 AS ry FROM sc)"""


@query(
    "spearman",
    f"""WITH {RANK_SQL} SELECT benchmark, left_condition, right_condition, count(*) AS n, {r6('corr(rx, ry)')} AS rho FROM rk GROUP BY ALL""",
)
def spearman(t: Tables) -> DataFrame:
    return rounded(L.spearman(compute_pairs(t), ["benchmark", *P.CONTRAST]), "rho")


@query(
    "average_rank",
    f"""WITH {RANK_SQL} SELECT benchmark, prompt, judge_id, run_set, left_condition, right_condition, {r6('rx')} AS rank FROM rk""",
)
def average_ranks(t: Tables) -> DataFrame:
    ranked = average_rank(compute_pairs(t), ["benchmark", *P.CONTRAST], "compute_ratio", "rank")
    return rounded(
        ranked.select("benchmark", "prompt", "judge_id", "run_set", *P.CONTRAST, "rank"), "rank"
    )


# --- prompt-level robustness ---------------------------------------------------

SEED, RESAMPLES = 20260908, 10_000
UNIT_SQL = f"""{V.VERDICT_RUN_SQL}, unit_means AS (SELECT left_condition, right_condition, benchmark, prompt,
  avg(CASE verdict WHEN 'left' THEN 1.0 WHEN 'right' THEN 0.0 ELSE 0.5 END) AS value, count(*) AS pairs FROM verdicts GROUP BY ALL),
placed AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY benchmark, left_condition, right_condition) AS n
  FROM unit_means WINDOW w AS (PARTITION BY benchmark, left_condition, right_condition ORDER BY prompt)),
{V.draw_ctes(SEED, RESAMPLES, 'benchmark, left_condition, right_condition')},
means AS (SELECT benchmark, left_condition, right_condition, b, {V.exact_mean_sql('value')} AS mean FROM draws d
  JOIN placed p USING (benchmark, left_condition, right_condition) WHERE p.i = d.pick GROUP BY ALL)"""
CELL = ["benchmark", *P.CONTRAST]


def unit_means(t: Tables) -> DataFrame:
    score = F.when(F.col("verdict") == "left", 1.0).when(F.col("verdict") == "right", 0.0).otherwise(0.5)
    return V.verdicts(t, ["run_set"]).groupBy(*CELL, "prompt").agg(
        F.avg(score).alias("value"), F.count(F.lit(1)).alias("pairs")
    )


@query(
    "bootstrap_mean",
    f"WITH {UNIT_SQL} SELECT benchmark, left_condition, right_condition, CAST(b AS INTEGER) AS b, floor(mean * 1e6 + 0.5) / 1e6 AS mean FROM means",
)
def bootstrap_mean(t: Tables) -> DataFrame:
    means = B.bootstrap_means(written(unit_means(t), "units"), CELL, ["prompt"], "value", RESAMPLES, SEED)
    return means.withColumn("mean", F.floor(F.col("mean") * 1e6 + 0.5) / 1e6)


@query(
    "order_statistics",
    f"""WITH {UNIT_SQL} SELECT benchmark, left_condition, right_condition, {r6('quantile_cont(value, 0.25)')} AS q25,
      {r6('quantile_cont(value, 0.5)')} AS q50, {r6('quantile_cont(value, 0.9)')} AS q90 FROM unit_means GROUP BY ALL""",
)
def order_statistics(t: Tables) -> DataFrame:
    from pairlens.functions.ordering import exact_quantiles

    found = exact_quantiles(unit_means(t), CELL, "value", {"q25": 0.25, "q50": 0.5, "q90": 0.9})
    return rounded(found, "q25", "q50", "q90")


@query(
    "prompt_level_rate",
    f"""WITH {UNIT_SQL}, ends AS (SELECT benchmark, left_condition, right_condition, quantile_cont(mean, 0.025) AS low,
      quantile_cont(mean, 0.975) AS high FROM means GROUP BY ALL),
    cells AS (SELECT benchmark, left_condition, right_condition, CAST(sum(pairs) AS BIGINT) AS pairs, count(*) AS prompts, avg(value) AS rate,
      count(*) FILTER (value > 0.5) AS prompt_wins, count(*) FILTER (value < 0.5) AS prompt_losses,
      count(*) FILTER (value = 0.5) AS prompt_ties FROM unit_means GROUP BY ALL)
    SELECT benchmark, left_condition, right_condition, pairs, prompts, {r6('rate')} AS rate, {r6('low')} AS bootstrap_low,
      {r6('high')} AS bootstrap_high, prompt_wins, prompt_losses, prompt_ties, {r6(V.sign_sql('prompt_wins', 'prompt_losses'))} AS sign_test_p
    FROM cells JOIN ends USING (benchmark, left_condition, right_condition)""",
)
def prompt_level_rate(t: Tables) -> DataFrame:
    units = written(unit_means(t), "units")
    ends = B.interpolated_interval(
        B.bootstrap_means(units, CELL, ["prompt"], "value", RESAMPLES, SEED), CELL
    )
    cells = units.groupBy(*CELL).agg(
        F.sum("pairs").alias("pairs"),
        F.count(F.lit(1)).alias("prompts"),
        F.avg("value").alias("rate"),
        F.count_if(F.col("value") > 0.5).alias("prompt_wins"),
        F.count_if(F.col("value") < 0.5).alias("prompt_losses"),
        F.count_if(F.col("value") == 0.5).alias("prompt_ties"),
    ).withColumn(
        # the last digits of a sum would decide a tie of the sixth decimal
        "sign_test_p", F.round(sign_test_p(F.col("prompt_wins"), F.col("prompt_losses")), 12)
    )
    report = cells.join(ends, CELL).withColumnsRenamed({"low": "bootstrap_low", "high": "bootstrap_high"})
    return rounded(report, "rate", "bootstrap_low", "bootstrap_high", "sign_test_p")


@query(
    "logistic_length",
    f"""WITH RECURSIVE {V.VERDICT_SQL}, pts AS MATERIALIZED (SELECT left_condition, right_condition, ln(left_length / CAST(right_length AS DOUBLE)) AS x,
      CAST(verdict = 'left' AS DOUBLE) AS y, CAST(count(*) AS DOUBLE) AS w FROM verdicts WHERE verdict <> 'tie' AND left_length > 0 AND right_length > 0 GROUP BY ALL),
    fit AS (SELECT DISTINCT left_condition, right_condition, 0 AS step, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 'running' AS status FROM pts
      UNION ALL SELECT left_condition, right_condition, step + 1, CASE WHEN det > 0 THEN a + (h11 * g0 - h01 * g1) / det ELSE a END, CASE WHEN det > 0 THEN b + (h00 * g1 - h01 * g0) / det ELSE b END,
        CASE WHEN det > 0 THEN CASE WHEN abs((h11 * g0 - h01 * g1) / det) < 1e-10 AND abs((h00 * g1 - h01 * g0) / det) < 1e-10 THEN 'ok' ELSE 'running' END ELSE 'singular' END
      FROM (SELECT *, h00 * h11 - h01 * h01 AS det FROM (SELECT left_condition, right_condition, step, a, b, sum(w * (y - p)) AS g0, sum(w * (y - p) * x) AS g1, sum(w * p * (1 - p)) AS h00, sum(w * p * (1 - p) * x) AS h01, sum(w * p * (1 - p) * x * x) AS h11
        FROM (SELECT f.*, x, y, w, 1 / (1 + exp(-(a + b * x))) AS p FROM fit f JOIN pts USING (left_condition, right_condition) WHERE f.status = 'running' AND f.step < 50) GROUP BY left_condition, right_condition, step, a, b)))
    SELECT left_condition, right_condition, {r6('arg_max(a, step)')} AS intercept, {r6('arg_max(b, step)')} AS slope, arg_max(status, step) AS status FROM fit GROUP BY left_condition, right_condition""",
)
def logistic_length(t: Tables) -> DataFrame:
    """Newton fit per contrast; its SQL twin takes the steps in a recursive query."""
    points = M.length_points(V.measured(t)).withColumn("weight", F.lit(1.0))
    return rounded(M.fit_logistic(points, P.CONTRAST), "intercept", "slope")


LOGISTIC_RESAMPLES = 2000


@query("logistic_cluster_bootstrap")
def logistic_cluster_bootstrap(t: Tables) -> DataFrame:
    report = M.logistic_cluster_bootstrap(M.length_points(V.measured(t)), LOGISTIC_RESAMPLES, SEED)
    return rounded(report, *[n for n, kind in report.dtypes if kind == "double"])


#: Games reduced to one matrix of meetings per group, then MM steps over lists in a recursive query.
BT_SQL = f"""{V.VERDICT_SQL}, g AS (SELECT benchmark, platform, judge_id, least(left_condition, right_condition) AS low, greatest(left_condition, right_condition) AS high,
  unnest([outcome_ab, outcome_ba]) AS outcome FROM verdicts WHERE left_condition <> right_condition),
c AS (SELECT benchmark, platform, judge_id, low, high, count(*) AS played, sum(CASE WHEN outcome = 'tie' THEN 0.5 WHEN outcome = low THEN 1.0 ELSE 0.0 END) AS low_wins FROM g GROUP BY ALL),
sides AS (SELECT benchmark, platform, judge_id, low AS name, high AS other, played, CAST(low_wins AS DOUBLE) AS won FROM c
  UNION ALL SELECT benchmark, platform, judge_id, high, low, played, CAST(played - low_wins AS DOUBLE) FROM c),
totals AS (SELECT benchmark, platform, judge_id, name, sum(won) AS won, sum(played - won) AS lost FROM sides GROUP BY ALL),
met AS (SELECT x.benchmark, x.platform, x.judge_id, x.name, x.won, x.lost, list(CAST(coalesce(s.played, 0) AS DOUBLE) ORDER BY y.name) AS row_met
  FROM totals x JOIN totals y USING (benchmark, platform, judge_id)
  LEFT JOIN sides s ON s.benchmark = x.benchmark AND s.platform = x.platform AND s.judge_id = x.judge_id AND s.name = x.name AND s.other = y.name GROUP BY ALL),
grp AS MATERIALIZED (SELECT benchmark, platform, judge_id, list(name ORDER BY name) AS names, list(won ORDER BY name) AS won, list(row_met ORDER BY name) AS met,
  bool_and(won > 0 AND lost > 0) AS fits FROM met GROUP BY ALL),
mm AS (SELECT benchmark, platform, judge_id, 0 AS step, list_transform(names, lambda x: CAST(1 AS DOUBLE)) AS s, NOT fits AS done FROM grp
  UNION ALL SELECT benchmark, platform, judge_id, step + 1, fresh, list_max(list_transform(range(1, len(s) + 1), lambda i: abs(fresh[i] - s[i]))) < 1e-10
  FROM (SELECT benchmark, platform, judge_id, step, s, list_transform(raw, lambda x: x / exp(list_avg(list_transform(raw, lambda y: ln(y))))) AS fresh
    FROM (SELECT m.*, list_transform(range(1, len(m.s) + 1), lambda i: g.won[i] / list_sum(list_transform(range(1, len(m.s) + 1), lambda j: g.met[i][j] / (m.s[i] + m.s[j])))) AS raw
      FROM mm m JOIN grp g USING (benchmark, platform, judge_id) WHERE NOT m.done AND m.step < 10000))),
ends AS (SELECT benchmark, platform, judge_id, CAST(max(step) AS INTEGER) AS iterations, arg_max(s, step) AS s, arg_max(done, step) AS done FROM mm GROUP BY ALL),
strengths AS (SELECT benchmark, platform, judge_id, CASE WHEN NOT fits THEN 'complete separation' WHEN done THEN 'ok' ELSE 'non-convergence' END AS status,
  unnest(names) AS condition, unnest(CASE WHEN fits AND done THEN s ELSE list_transform(names, lambda x: NULL) END) AS strength, iterations FROM grp JOIN ends USING (benchmark, platform, judge_id))"""


@query(
    "bradley_terry",
    f"""WITH RECURSIVE {BT_SQL} SELECT * REPLACE ({r6('strength')} AS strength) FROM strengths""",
)
def bradley_terry(t: Tables) -> DataFrame:
    """Strengths per benchmark, platform and judge."""
    games = P.games(V.verdicts(t))
    return rounded(M.bradley_terry(games, ["benchmark", "platform", "judge_id"]), "strength")


@query(
    "bradley_terry_mean",
    f"""WITH RECURSIVE {BT_SQL}, whole AS (SELECT benchmark, platform, bool_and(status = 'ok') AS ok FROM strengths GROUP BY ALL)
    SELECT benchmark, platform, condition, CASE WHEN any_value(ok) THEN {r6('avg(strength)')} END AS strength FROM strengths JOIN whole USING (benchmark, platform) GROUP BY benchmark, platform, condition""",
)
def bradley_terry_mean(t: Tables) -> DataFrame:
    cell = ["benchmark", "platform"]
    fits = M.bradley_terry(P.games(V.verdicts(t)), [*cell, "judge_id"])
    return rounded(M.mean_strengths(fits, cell), "strength")


STRATA_MIN = 20


@query(
    "length_stratified",
    f"""WITH {LEN_SQL}, src AS (SELECT left_condition, right_condition, 'raw' AS stratum, benchmark, prompt, focal AS outcome FROM lp
      UNION ALL SELECT left_condition, right_condition, ratio_bin, benchmark, prompt, focal FROM lp),
    {summary_sql('src', 'left_condition, right_condition, stratum', False)}
    SELECT * FROM summary WHERE stratum = 'raw' OR pairs >= {STRATA_MIN}""",
)
def length_stratified(t: Tables) -> DataFrame:
    report = L.length_strata(length_pairs(t), P.CONTRAST, STRATA_MIN).drop("equal_length_pairs")
    return rounded(report, *STATS)


@query(
    "length_stratified_scores",
    f"""WITH {POINT_SQL}, l AS (SELECT *, CAST(l_q AS DOUBLE) AS len, CASE WHEN o3 % 4 <> 0 THEN 10 + o3 % 30 END AS req FROM (SELECT *, instruction_fulfillment AS l_q FROM valid)),
    b AS (SELECT *, CASE WHEN len > 0 AND req > 0 THEN greatest(len, req) / CAST(least(len, req) AS DOUBLE) END AS ratio FROM l),
    src AS (SELECT *, 'raw' AS stratum FROM b UNION ALL SELECT *, {bin_sql('ratio', L.LENGTH_BOUNDS, 1.0)} FROM b WHERE ratio IS NOT NULL)
    SELECT benchmark, condition, stratum, count(*) AS scores, {', '.join(f"{r6(f'avg({d})')} AS {d}" for d in DIM)} FROM src
    GROUP BY benchmark, condition, stratum HAVING stratum = 'raw' OR count(*) >= {STRATA_MIN}""",
)
def length_stratified_scores(t: Tables) -> DataFrame:
    """Pointwise scores by output length against a requested one that a quarter of the records lack."""
    requested = F.when(F.col("o3") % 4 != 0, 10 + F.col("o3") % 30)
    valid = Q.pointwise_valid(pointwise(t))
    report = L.score_strata(valid, ["benchmark", "condition"], DIM, F.col("instruction_fulfillment"), requested, STRATA_MIN)
    return rounded(report, *DIM)
