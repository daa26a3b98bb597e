"""Registered queries on judge and rater agreement, power, sampling and protocol tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.functions import stats as S
from pairlens.operators import agreement as A
from pairlens.operators import control as L
from pairlens.operators import pairs as P
from pairlens.operators import prompts as T
from pairlens.operators import protocol as X
from pairlens.operators import sampling as M
from pairlens.plans import views as V
from pairlens.plans.pairwise_queries import COLLAPSED, rounded
from pairlens.plans.quality_queries import DIFF_SQL, NATIVE_SQL, POINT_SQL, diffs, native_scores, pointwise
from pairlens.plans.registry import Tables, query, r6

SEED = 20260908
JUDGES = ("judge-0", "judge-1")
PAIR_KEY = [*P.PROMPT, *P.CONTRAST]


def two_judges(t: Tables) -> DataFrame:
    pairs = V.verdicts(t).withColumn("artifact", F.col("prompt"))
    return A.join_two_judges(pairs, PAIR_KEY, JUDGES, ["code_ab", "code_ba", "verdict"])


JOINED_SQL = f"""{V.VERDICT_SQL}, joined AS (SELECT c.benchmark, c.platform, c.prompt, c.left_condition, c.right_condition, c.outcome_ab AS cross_ab,
  c.outcome_ba AS cross_ba, c.verdict AS cross_verdict, r.outcome_ab AS ref_ab, r.outcome_ba AS ref_ba, r.verdict AS reference_verdict
  FROM verdicts c JOIN verdicts r USING (benchmark, platform, prompt, left_condition, right_condition)
  WHERE c.judge_id = 'judge-0' AND r.judge_id = 'judge-1')"""


@query(
    "join_two_judges",
    f"WITH {JOINED_SQL} SELECT benchmark, platform, prompt, right_condition, cross_verdict, reference_verdict FROM joined",
)
def join_two_judges(t: Tables) -> DataFrame:
    return two_judges(t).select(*P.PROMPT, "right_condition", "cross_verdict", "reference_verdict")


CROSS_CUTS = [["left_condition", "right_condition"], ["left_condition", "right_condition", "benchmark"], []]
CROSS_SQL = f"""{JOINED_SQL}, m AS (SELECT left_condition, right_condition, benchmark, count(*) AS n, count(*) FILTER (cross_verdict = 'left') AS wins,
  count(*) FILTER (cross_verdict = 'right') AS losses, count(*) FILTER (cross_verdict = 'tie') AS ties,
  CAST(sum((cross_ab = ref_ab)::INT + (cross_ba = ref_ba)::INT) AS BIGINT) AS presentation_agreement,
  count(*) FILTER (cross_verdict = reference_verdict) AS collapsed_agreement,
  count(*) FILTER (cross_verdict <> 'tie' AND reference_verdict <> 'tie' AND cross_verdict <> reference_verdict) AS direction_conflicts
  FROM joined GROUP BY GROUPING SETS ((left_condition, right_condition), (left_condition, right_condition, benchmark), ())),
cross_report AS (SELECT left_condition, right_condition, benchmark, n, wins, losses, ties, {r6(V.rate_sql('(wins + losses)', 'ties'))} AS commit_rate,
  {r6(V.wilson_sql('(wins + losses)', 'ties', 'low'))} AS commit_low, {r6(V.wilson_sql('(wins + losses)', 'ties', 'high'))} AS commit_high,
  {r6(V.rate_sql('wins', 'losses'))} AS win_rate, {r6(V.wilson_sql('wins', 'losses', 'low'))} AS win_low, {r6(V.wilson_sql('wins', 'losses', 'high'))} AS win_high,
  {r6(V.sign_sql('wins', 'losses'))} AS sign_test_p, presentation_agreement, 2 * n AS presentation_total, collapsed_agreement, direction_conflicts FROM m)"""
CROSS_RATES = ("commit_rate", "commit_low", "commit_high", "win_rate", "win_low", "win_high", "sign_test_p")


@query("cross_judge_metrics", f"WITH {CROSS_SQL} SELECT * FROM cross_report")
def cross_judge_metrics(t: Tables) -> DataFrame:
    return rounded(A.cross_judge_metrics(two_judges(t), CROSS_CUTS), *CROSS_RATES)


@query(
    "tie_share",
    f"""WITH {CROSS_SQL}, c AS (SELECT benchmark, left_condition, right_condition, count(*) FILTER (verdict = 'left') AS w, count(*) FILTER (verdict = 'right') AS l
      FROM verdicts WHERE judge_id = 'judge-1' GROUP BY ALL)
    SELECT benchmark, left_condition, right_condition, ties, n, {r6('ties / n::DOUBLE')} AS tie_share, win_rate AS cross_win_rate,
      {r6(V.rate_sql('w', 'l'))} AS reference_win_rate FROM cross_report JOIN c USING (benchmark, left_condition, right_condition)""",
)
def tie_share(t: Tables) -> DataFrame:
    key = ["benchmark", *P.CONTRAST]
    cross = A.cross_judge_metrics(two_judges(t), [key])
    own = V.verdicts(t).filter(F.col("judge_id") == JUDGES[1]).groupBy(*key).agg(*P.tally())
    reference = own.select(*key, S.win_rate(F.col("wins"), F.col("losses")).alias("reference_win_rate"))
    report = cross.select(
        *key, "ties", "n", (F.col("ties") / F.col("n")).alias("tie_share"), F.col("win_rate").alias("cross_win_rate")
    ).join(reference, key)
    return rounded(report, "tie_share", "cross_win_rate", "reference_win_rate")


@query(
    "provenance_constant",
    """WITH m AS (SELECT 'model-x' AS model, l_linestatus AS effort, 7 AS seed, CASE WHEN l_orderkey % 2 = 0 THEN 4096 END AS max_output_tokens FROM lineitem)
    SELECT 'model' AS field, count(DISTINCT model) AS distinct_values, min(model) AS value, 1 AS consistent FROM m
    UNION ALL SELECT 'effort', count(DISTINCT effort), NULL, 0 FROM m UNION ALL SELECT 'seed', count(DISTINCT seed), '7', 1 FROM m
    UNION ALL SELECT 'max_output_tokens', count(DISTINCT max_output_tokens), '4096', 1 FROM m""",
)
def provenance_constant(t: Tables) -> DataFrame:
    manifests = t.lineitem.selectExpr(
        "'model-x' AS model", "l_linestatus AS effort", "7 AS seed",
        "CASE WHEN l_orderkey % 2 = 0 THEN 4096 END AS max_output_tokens",
    )
    report = A.provenance_constant(manifests, ["model", "effort", "seed", "max_output_tokens"])
    return report.withColumn("consistent", F.col("consistent").cast("int"))


def kappa_sql(source: str, keys: str, a: str, b: str, name: str = "kap") -> str:
    """Cohen's kappa as CTEs named after ``name``."""
    return f"""{name}_t AS (SELECT {keys}, {a} AS ca, {b} AS cb, count(*) AS n FROM {source} GROUP BY ALL),
{name}_a AS (SELECT {keys}, ca AS c, sum(n) AS na FROM {name}_t GROUP BY ALL), {name}_b AS (SELECT {keys}, cb AS c, sum(n) AS nb FROM {name}_t GROUP BY ALL),
{name}_e AS (SELECT {keys}, sum(na * nb) AS prod FROM {name}_a JOIN {name}_b USING ({keys}, c) GROUP BY ALL),
{name}_n AS (SELECT {keys}, CAST(sum(n) AS BIGINT) AS pairs, CAST(coalesce(sum(n) FILTER (ca = cb), 0) AS BIGINT) AS agreeing FROM {name}_t GROUP BY ALL),
{name} AS (SELECT {keys}, pairs, agreeing, {r6('(agreeing / pairs::DOUBLE - coalesce(prod, 0) / (pairs::DOUBLE * pairs)) / (1 - coalesce(prod, 0) / (pairs::DOUBLE * pairs))')} AS kappa
  FROM {name}_n LEFT JOIN {name}_e USING ({keys}))"""


@query(
    "cohen_kappa",
    f"""WITH src AS (SELECT lang, quality, toxic FROM labels JOIN documents USING (doc_id)), {kappa_sql('src', 'lang', 'quality', 'toxic')} SELECT * FROM kap""",
)
def cohen_kappa(t: Tables) -> DataFrame:
    rated = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id")
    return rounded(A.cohen_kappa(rated, ["lang"], "quality", "toxic"), "kappa")


@query(
    "judge_agreement",
    f"""WITH {JOINED_SQL}, s AS (SELECT 'all' AS scope, * FROM joined UNION ALL SELECT left_condition || ':' || right_condition, * FROM joined),
    d AS (SELECT * FROM s WHERE cross_verdict <> 'tie' AND reference_verdict <> 'tie'),
    {kappa_sql('s', 'scope', 'reference_verdict', 'cross_verdict', 'k1')}, {kappa_sql('d', 'scope', 'reference_verdict', 'cross_verdict', 'k2')}
    SELECT scope, k1.pairs, k1.agreeing, k1.kappa, k2.pairs AS both_decided_pairs, k2.agreeing AS both_decided_agreeing, k2.kappa AS both_decided_kappa
    FROM k1 LEFT JOIN k2 USING (scope)""",
)
def judge_agreement(t: Tables) -> DataFrame:
    return rounded(A.judge_agreement(two_judges(t), P.CONTRAST), "kappa", "both_decided_kappa")


# --- raters -----------------------------------------------------------------------

RATING_SQL = """ratings AS (SELECT l_orderkey AS unit, l_linenumber AS annotator, arg_min(l_returnflag, (l_partkey, l_suppkey, l_extendedprice)) AS value,
  any_value(l_orderkey % 4) AS grp FROM lineitem GROUP BY l_orderkey, l_linenumber)"""


def ratings(t: Tables) -> DataFrame:
    first = F.min_by("l_returnflag", F.struct("l_partkey", "l_suppkey", "l_extendedprice"))
    return t.lineitem.groupBy(F.col("l_orderkey").alias("unit"), F.col("l_linenumber").alias("annotator")).agg(
        first.alias("value")
    ).withColumn("grp", F.col("unit") % 4)


RATER_SQL = f"""{RATING_SQL}, c AS (SELECT grp, unit, value, count(*) AS c FROM ratings GROUP BY ALL),
u AS (SELECT grp, unit, sum(c) AS n, sum(c * c) AS sq FROM c GROUP BY ALL),
share AS (SELECT grp, value, sum(c) AS cc FROM c JOIN u USING (grp, unit) WHERE n >= 2 GROUP BY ALL),
chance AS (SELECT grp, sum(cc * cc)::DOUBLE AS cc2, sum(cc)::DOUBLE AS tot FROM share GROUP BY ALL),
cell AS (SELECT grp, count(*) AS comparisons, CAST(sum(n) AS BIGINT) AS ratings, sum((sq - n) / 2) / sum(n * (n - 1) / 2) AS raw,
  avg(CASE WHEN n >= 2 THEN (sq - n) / (n * (n - 1)) END) AS fl, sum(CASE WHEN n >= 2 THEN n * n - sq END) / sum(CASE WHEN n >= 2 THEN n * (n - 1) END) AS dis
  FROM u GROUP BY ALL),
rater AS (SELECT grp, comparisons, ratings, {r6('raw')} AS raw_agreement, {r6('1 - raw')} AS disagreement,
  {r6('(fl - cc2 / (tot * tot)) / (1 - cc2 / (tot * tot))')} AS fleiss_kappa, {r6('1 - dis / ((tot * tot - cc2) / (tot * (tot - 1)))')} AS krippendorff_alpha
  FROM cell JOIN chance USING (grp))"""


def rater_report(t: Tables) -> DataFrame:
    report = A.rater_agreement(ratings(t), ["grp"], "unit", "value")
    return rounded(report, "raw_agreement", "disagreement", "fleiss_kappa", "krippendorff_alpha")


@query("raw_agreement", f"WITH {RATER_SQL} SELECT grp, comparisons, ratings, raw_agreement, disagreement FROM rater")
def raw_agreement(t: Tables) -> DataFrame:
    return rater_report(t).drop("fleiss_kappa", "krippendorff_alpha")


@query("fleiss_kappa", f"WITH {RATER_SQL} SELECT grp, comparisons, fleiss_kappa FROM rater")
def fleiss_kappa(t: Tables) -> DataFrame:
    return rater_report(t).select("grp", "comparisons", "fleiss_kappa")


@query("krippendorff_alpha", f"WITH {RATER_SQL} SELECT grp, comparisons, krippendorff_alpha FROM rater")
def krippendorff_alpha(t: Tables) -> DataFrame:
    return rater_report(t).select("grp", "comparisons", "krippendorff_alpha")


MAJ_SQL = f"""{RATING_SQL}, vc AS (SELECT unit, value, count(*) AS c FROM ratings GROUP BY ALL),
mx AS (SELECT unit, max(c) AS top, CAST(sum(c) AS BIGINT) AS votes FROM vc GROUP BY unit),
maj AS (SELECT unit, any_value(votes) AS votes, CASE WHEN count(*) = 1 THEN min(value) ELSE 'tie' END AS majority FROM vc JOIN mx USING (unit) WHERE c = top GROUP BY unit)"""


@query("majority_vote", f"WITH {MAJ_SQL} SELECT * FROM maj")
def majority_vote(t: Tables) -> DataFrame:
    return A.majority_vote(ratings(t), ["unit"], "value")


@query(
    "decision_margin",
    f"WITH {MAJ_SQL}, o AS (SELECT unit, list_reverse_sort(list(c)) AS cs FROM vc GROUP BY unit) SELECT unit, cs[1] - coalesce(cs[2], 0) AS margin FROM o",
)
def decision_margin(t: Tables) -> DataFrame:
    return A.decision_margin(ratings(t), ["unit"], "value")


ANNOTATORS = ("annotator-1", "annotator-2", "annotator-3")
ANSWER_COLUMNS = [
    "concat('comparison-', CAST(l_orderkey AS VARCHAR(20))) AS comparison_id",
    "concat('annotator-', CAST(1 + l_linenumber % 3 AS VARCHAR(9))) AS annotator_id",
    "CASE l_returnflag WHEN 'N' THEN 'tie' WHEN 'A' THEN 'A' ELSE 'B' END AS preference",
    "l_partkey AS k1",
    "l_suppkey AS k2",
    "l_extendedprice AS k3",
    "l_linenumber AS k4",
]
KEY_COLUMNS = [
    "concat('comparison-', CAST(o_orderkey AS VARCHAR(20))) AS comparison_id",
    "o_orderpriority AS benchmark",
    "'A4' AS left_condition",
    "concat('A', CAST(1 + o_custkey % 3 AS VARCHAR(9))) AS right_condition",
    "CASE WHEN o_totalprice < 100000 THEN 'short' WHEN o_totalprice < 200000 THEN 'middle' ELSE 'long' END AS output_length_gap",
    "CASE o_custkey % 4 WHEN 0 THEN 'even' WHEN 1 THEN 'narrow' WHEN 2 THEN 'clear' END AS automatic_decision_margin",
    "CASE WHEN o_custkey % 2 = 0 THEN 'A4' ELSE concat('A', CAST(1 + o_custkey % 3 AS VARCHAR(9))) END AS condition_a_1",
    "CASE WHEN o_custkey % 5 < 2 THEN 'A4' ELSE concat('A', CAST(1 + o_custkey % 3 AS VARCHAR(9))) END AS condition_a_2",
    "CASE WHEN o_custkey % 7 < 3 THEN 'A4' ELSE concat('A', CAST(1 + o_custkey % 3 AS VARCHAR(9))) END AS condition_a_3",
    "CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'A4' WHEN 2 THEN 'tie' ELSE concat('A', CAST(1 + o_custkey % 3 AS VARCHAR(9))) END AS same_family_decision",
    "CASE o_orderkey % 3 WHEN 0 THEN 'A4' WHEN 1 THEN 'tie' ELSE concat('A', CAST(1 + o_custkey % 3 AS VARCHAR(9))) END AS cross_family_decision",
]


HUMAN_DIMENSIONS = ["benchmark", "right_condition", "output_length_gap", "automatic_decision_margin"]


def rated_answers(t: Tables) -> DataFrame:
    answers = P.first_by(
        t.lineitem.selectExpr(*ANSWER_COLUMNS), ["comparison_id", "annotator_id"], ["k1", "k2", "k3", "k4"], ["preference"]
    )
    return A.join_human_key(answers, t.orders.selectExpr(*KEY_COLUMNS), ANNOTATORS)


HUMAN_SQL = (
    "raw AS (SELECT " + ", ".join(ANSWER_COLUMNS) + " FROM lineitem), answers AS (SELECT comparison_id, annotator_id, arg_min(preference, (k1, k2, k3, k4)) AS preference FROM raw GROUP BY ALL), keys AS (SELECT "
    + ", ".join(KEY_COLUMNS)
    + """ FROM orders), rated AS (SELECT a.*, k.* EXCLUDE (comparison_id), CASE annotator_id WHEN 'annotator-1' THEN condition_a_1 WHEN 'annotator-2' THEN condition_a_2 ELSE condition_a_3 END AS condition_a
  FROM answers a JOIN keys k USING (comparison_id)),
human AS (SELECT *, CASE preference WHEN 'tie' THEN 'tie' WHEN 'A' THEN condition_a ELSE CASE WHEN condition_a = left_condition THEN right_condition ELSE left_condition END END AS condition FROM rated)"""
)


@query(
    "human_side",
    f"WITH {HUMAN_SQL} SELECT benchmark, annotator_id, preference, condition, count(*) AS n FROM human GROUP BY ALL",
)
def human_side(t: Tables) -> DataFrame:
    return rated_answers(t).groupBy("benchmark", "annotator_id", "preference", "condition").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("join_human_key", f"WITH {HUMAN_SQL} SELECT comparison_id, annotator_id, condition FROM human")
def join_human_key(t: Tables) -> DataFrame:
    return rated_answers(t).select("comparison_id", "annotator_id", "condition")


@query(
    "human_auto_agreement",
    f"""WITH {HUMAN_SQL}, vc AS (SELECT comparison_id, benchmark, right_condition, output_length_gap, automatic_decision_margin, same_family_decision, cross_family_decision, condition, count(*) AS c FROM human GROUP BY ALL),
    mx AS (SELECT comparison_id, max(c) AS top FROM vc GROUP BY ALL),
    maj AS (SELECT comparison_id, any_value(benchmark) AS benchmark, any_value(right_condition) AS right_condition, any_value(output_length_gap) AS gap, any_value(automatic_decision_margin) AS margin, any_value(same_family_decision) AS s, any_value(cross_family_decision) AS x,
      CASE WHEN count(*) = 1 THEN min(condition) ELSE 'tie' END AS majority FROM vc JOIN mx USING (comparison_id) WHERE c = top GROUP BY comparison_id),
    fam AS (SELECT *, 'same_family_decision' AS family, s AS decision FROM maj UNION ALL SELECT *, 'cross_family_decision', x FROM maj),
    cut AS (SELECT 'overall' AS dimension, 'all' AS "group", * FROM fam UNION ALL SELECT 'benchmark', benchmark, * FROM fam UNION ALL SELECT 'right_condition', right_condition, * FROM fam
      UNION ALL SELECT 'output_length_gap', gap, * FROM fam UNION ALL SELECT 'automatic_decision_margin', coalesce(margin, 'unknown'), * FROM fam)
    SELECT dimension, "group", family, count(*) AS comparisons, count(*) FILTER (decision = majority) AS matches, {r6('avg(CAST(decision = majority AS INT))')} AS agreement
    FROM cut WHERE decision <> '' GROUP BY dimension, "group", family""",
)
def human_auto_agreement(t: Tables) -> DataFrame:
    report = A.human_auto_agreement(
        rated_answers(t), HUMAN_DIMENSIONS, ["same_family_decision", "cross_family_decision"]
    )
    return rounded(report, "agreement")


# --- power -----------------------------------------------------------------------

ALPHA, POWER_TARGET = 0.05 / 24, 0.8
POWER_RATES = [round(0.5 + 0.05 * i, 2) for i in range(10)]


def power_cells(t: Tables) -> DataFrame:
    cells = P.prompt_verdicts(V.verdicts(t)).groupBy(*P.CELL).agg(*P.tally())
    return cells.select(*P.CELL, (F.col("wins") + F.col("losses")).alias("n"))


# the largest k with a p-value of at most alpha, then both tails at the rate
POWER_CTE = f"""{COLLAPSED}, sized AS (SELECT benchmark, platform, left_condition, right_condition, wins + losses AS n FROM collapsed),
tails AS (SELECT *, [exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2)) FOR k IN range(0, CAST(n // 2 AS BIGINT) + 1)] AS masses FROM sized),
crit AS (SELECT * EXCLUDE (masses), len(list_filter(range(1, len(masses) + 1), lambda i: 2 * list_sum(masses[1:i]) <= {ALPHA!r})) - 1 AS k FROM tails)"""


def cdf_sql(rate: str) -> str:
    term = f"exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({rate}) + (n - j) * ln(1 - {rate}))"
    return f"(CASE WHEN k < 0 THEN 0.0 ELSE list_sum([{term} FOR j IN range(0, k + 1)]) END)"


@query(
    "power_by_cell",
    f"""WITH {POWER_CTE}, g AS (SELECT CAST(unnest({POWER_RATES}) AS DOUBLE) AS rate)
    SELECT benchmark, platform, left_condition, right_condition, n, rate, {r6(f"{cdf_sql('rate')} + {cdf_sql('(1 - rate)')}")} AS power FROM crit, g""",
)
def power_by_cell(t: Tables) -> DataFrame:
    rates = F.array(*[F.lit(r) for r in POWER_RATES])
    return rounded(P.power_table(power_cells(t), P.CELL, rates, ALPHA), "power")


@query(
    "detectable_rate",
    f"""WITH RECURSIVE {POWER_CTE}, halves AS (SELECT benchmark, platform, left_condition, right_condition, n, k, CAST(0.5 AS DOUBLE) AS low, CAST(1 AS DOUBLE) AS high, 0 AS step FROM crit
      UNION ALL SELECT benchmark, platform, left_condition, right_condition, n, k, CASE WHEN power < {POWER_TARGET} THEN middle ELSE low END,
        CASE WHEN power < {POWER_TARGET} THEN high ELSE middle END, step + 1
      FROM (SELECT *, {cdf_sql('middle')} + {cdf_sql('(1 - middle)')} AS power FROM (SELECT *, (low + high) / 2 AS middle FROM halves WHERE step < 80)))
    SELECT benchmark, platform, left_condition, right_condition, n, {r6('high')} AS detectable_rate FROM halves WHERE step = 80""",
)
def detectable_rate(t: Tables) -> DataFrame:
    """Smallest rate with enough power, by bisection."""
    report = P.detectable_rate(power_cells(t), P.CELL, ALPHA, POWER_TARGET)
    return rounded(report, "detectable_rate")


# --- selection of comparisons --------------------------------------------------------

CANDIDATE_CELL = ["contrast", "benchmark", "tertile"]
STRATUM = ["output_length_gap", "margin"]


def candidates(t: Tables) -> DataFrame:
    """Pairs with a same-family decision: gap bin, vote margin and length tertile."""
    pairs = V.measured(t)
    key = [*P.PROMPT, *P.CONTRAST]
    own = F.col("judge_id") == JUDGES[0]
    first = lambda c: F.max(F.when(own, F.col(c)))
    sides = pairs.groupBy(*key).agg(
        first("left_length").alias("left_length"),
        first("right_length").alias("right_length"),
        first("verdict").alias("same_family_decision"),
        F.max(F.when(~own, F.col("verdict"))).alias("cross_family_decision"),
        first("code_ab").alias("_ab"),
        first("code_ba").alias("_ba"),
    ).filter(F.col("same_family_decision").isNotNull())
    side = lambda o: P.code_name(F.col(o))
    votes = F.array_compact(F.array(side("_ab"), side("_ba"), F.col("cross_family_decision")))
    count = lambda v: F.size(F.filter(votes, lambda x: x == v))
    ranked = F.sort_array(F.array(count("left"), count("right"), count("tie")), asc=False)
    rows = sides.select(
        *key,
        F.concat_ws(":", *P.CONTRAST).alias("contrast"),
        "left_length",
        "right_length",
        "same_family_decision",
        "cross_family_decision",
        (ranked[0] - ranked[1]).cast("int").alias("margin"),
        *L.length_columns(F.col("left_length"), F.col("right_length"))[1:2],
        F.length("prompt").alias("prompt_units"),
    ).withColumnRenamed("ratio_bin", "output_length_gap")
    return T.tertiles(rows, ["benchmark", "contrast"], "prompt_units", "prompt")


CAND_SQL = f"""{V.VERDICT_SQL}, cs AS (SELECT benchmark, platform, prompt, left_condition, right_condition,
  max(left_length) FILTER (judge_id = 'judge-0') AS left_length, max(right_length) FILTER (judge_id = 'judge-0') AS right_length,
  max(verdict) FILTER (judge_id = 'judge-0') AS same_family_decision, max(verdict) FILTER (judge_id = 'judge-1') AS cross_family_decision,
  max(outcome_ab) FILTER (judge_id = 'judge-0') AS ab, max(outcome_ba) FILTER (judge_id = 'judge-0') AS ba FROM verdicts GROUP BY ALL),
cv AS (SELECT *, left_condition || ':' || right_condition AS contrast,
  [CASE ab WHEN left_condition THEN 'left' WHEN right_condition THEN 'right' ELSE 'tie' END, CASE ba WHEN left_condition THEN 'left' WHEN right_condition THEN 'right' ELSE 'tie' END, cross_family_decision] AS votes
  FROM cs WHERE same_family_decision IS NOT NULL),
cm AS (SELECT *, list_reverse_sort([len(list_filter(votes, lambda x: x = 'left')), len(list_filter(votes, lambda x: x = 'right')), len(list_filter(votes, lambda x: x = 'tie'))]) AS k,
  greatest(left_length, right_length) / CAST(least(left_length, right_length) AS DOUBLE) AS ratio FROM cv),
cand AS (SELECT benchmark, prompt, contrast, right_condition, same_family_decision, coalesce(cross_family_decision, '') AS cross_family_decision, CAST(k[1] - k[2] AS INTEGER) AS margin,
  CASE WHEN ratio < 1.05 THEN '1.00-1.05' WHEN ratio < 1.1 THEN '1.05-1.10' WHEN ratio < 1.25 THEN '1.10-1.25' WHEN ratio < 1.5 THEN '1.25-1.50' WHEN ratio < 2 THEN '1.50-2.00' ELSE '2.00+' END AS output_length_gap,
  CAST(least((row_number() OVER (PARTITION BY benchmark, contrast ORDER BY length(prompt), prompt) - 1) * 3 // count(*) OVER (PARTITION BY benchmark, contrast), 2) AS INTEGER) AS tertile FROM cm)"""


@query(
    "candidate_features",
    f"WITH {CAND_SQL} SELECT benchmark, prompt, contrast, same_family_decision, cross_family_decision, margin, output_length_gap, tertile FROM cand",
)
def candidate_features(t: Tables) -> DataFrame:
    return candidates(t).select(
        "benchmark", "prompt", "contrast", "same_family_decision",
        F.coalesce("cross_family_decision", F.lit("")).alias("cross_family_decision"),
        "margin", "output_length_gap", "tertile",
    )


def quota_sql(source: str, cell: str, stratum: str, count: int, name: str = "q") -> str:
    return f"""{name}_n AS (SELECT {cell}, {stratum}, count(*) AS n FROM {source} GROUP BY ALL),
{name}_x AS (SELECT *, CAST(sum(n) OVER (PARTITION BY {cell}) AS BIGINT) AS total FROM {name}_n),
{name}_f AS (SELECT *, {count} * n // total AS base, ({count} * n) % total AS rest FROM {name}_x),
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY {cell} ORDER BY rest DESC, {stratum}) AS place, {count} - sum(base) OVER (PARTITION BY {cell}) AS remaining FROM {name}_f),
{name} AS (SELECT {cell}, {stratum}, n, CAST(base + CASE WHEN place <= remaining THEN 1 ELSE 0 END AS BIGINT) AS quota FROM {name}_r)"""


@query(
    "stratified_quota",
    f"WITH {CAND_SQL}, {quota_sql('cand', 'contrast, benchmark, tertile', 'output_length_gap, margin', 8)} SELECT * FROM q",
)
def stratified_quota(t: Tables) -> DataFrame:
    sizes = candidates(t).groupBy(*CANDIDATE_CELL, *STRATUM).agg(F.count(F.lit(1)).alias("n"))
    return M.quotas(sizes, CANDIDATE_CELL, STRATUM, 8)


CONTRAST_LABELS = [f"{a}:{b}" for a, b in V.CONTRASTS]


def packet_sql() -> str:
    steps = [f"{CAND_SQL}"]
    used = []
    for i, label in enumerate(CONTRAST_LABELS):
        taken = " UNION ALL ".join(f"SELECT benchmark, prompt FROM s{j}" for j in used) or "SELECT '' AS benchmark, '' AS prompt"
        steps.append(
            f"""p{i} AS (SELECT * FROM cand WHERE contrast = '{label}'),
fresh{i} AS (SELECT * FROM p{i} WHERE (benchmark, prompt) NOT IN (SELECT (benchmark, prompt) FROM ({taken}))),
enough{i} AS (SELECT benchmark, tertile FROM fresh{i} GROUP BY ALL HAVING count(*) >= 8),
pool{i} AS (SELECT f.* FROM fresh{i} f JOIN enough{i} USING (benchmark, tertile) UNION ALL SELECT p.* FROM p{i} p WHERE (benchmark, tertile) NOT IN (SELECT (benchmark, tertile) FROM enough{i})),
{quota_sql(f'pool{i}', 'contrast, benchmark, tertile', 'output_length_gap, margin', 8, f'q{i}')},
s{i} AS (SELECT * EXCLUDE (n, quota, place) FROM (SELECT p.*, q.n, q.quota, row_number() OVER (PARTITION BY contrast, benchmark, tertile, output_length_gap, margin ORDER BY md5('{SEED}:' || prompt), prompt) AS place
  FROM pool{i} p JOIN q{i} q USING (contrast, benchmark, tertile, output_length_gap, margin)) WHERE place <= quota)"""
        )
        used.append(i)
    steps.append("packet AS (" + " UNION ALL ".join(f"SELECT * FROM s{i}" for i in used) + ")")
    return ", ".join(steps)


def packet(t: Tables) -> DataFrame:
    return M.balanced_packet(
        candidates(t), CONTRAST_LABELS, ["contrast", "benchmark", "tertile"], STRATUM, "prompt", 8, SEED
    )


@query("balanced_packet", f"WITH {packet_sql()} SELECT contrast, benchmark, tertile, output_length_gap, margin, prompt FROM packet")
def balanced_packet(t: Tables) -> DataFrame:
    return packet(t).select("contrast", "benchmark", "tertile", "output_length_gap", "margin", "prompt")


@query(
    "blinded_assignment",
    f"""WITH {packet_sql()}, named AS (SELECT *, 'comparison-' || printf('%03d', row_number() OVER (ORDER BY contrast, benchmark, tertile, prompt)) AS comparison_id FROM packet),
    a AS (SELECT *, unnest(['annotator-1', 'annotator-2', 'annotator-3']) AS annotator_id FROM named),
    d AS (SELECT *, 1 + ('0x' || substr(md5('{SEED}:' || comparison_id || ':' || annotator_id), 1, 8))::BIGINT % 2147483647 AS presentation_seed FROM a)
    SELECT comparison_id, annotator_id, contrast, benchmark, prompt, presentation_seed, CASE WHEN presentation_seed % 2 = 0 THEN 'A4' ELSE right_condition END AS condition_a FROM d""",
)
def blinded_assignment(t: Tables) -> DataFrame:
    rows = M.blinded_assignment(packet(t), ANNOTATORS, ["contrast", "benchmark", "tertile", "prompt"], SEED)
    return rows.select(
        "comparison_id", "annotator_id", "contrast", "benchmark", "prompt", "presentation_seed", "condition_a"
    )


# --- protocol tests --------------------------------------------------------------------

DIFF_CELL = ["benchmark", "left_condition", "right_condition"]


def erfc_sql(z: str) -> str:
    x = f"(abs({z}) / sqrt(2.0::DOUBLE))"
    t = f"(1.0 / (1 + 0.5 * {x}))"
    poly = f"({S.ERFC_COEFFICIENTS[-1]})"
    for value in reversed(S.ERFC_COEFFICIENTS[:-1]):
        poly = f"({poly} * {t} + ({value}))"
    return f"({t} * exp(-{x} * {x} + {poly}))"


@query(
    "wilcoxon_signed_rank",
    f"""WITH {DIFF_SQL}, nz AS (SELECT benchmark, left_condition, right_condition, diff FROM diffs WHERE diff <> 0),
    rk AS (SELECT *, rank() OVER (PARTITION BY benchmark, left_condition, right_condition ORDER BY abs(diff))
      + (count(*) OVER (PARTITION BY benchmark, left_condition, right_condition, abs(diff)) - 1) / 2.0 AS r,
      count(*) OVER (PARTITION BY benchmark, left_condition, right_condition, abs(diff)) AS ties FROM nz),
    w AS (SELECT benchmark, left_condition, right_condition, count(*) AS n, sum(CASE WHEN diff > 0 THEN r ELSE 0 END)::DOUBLE AS wp, sum(CASE WHEN diff < 0 THEN r ELSE 0 END)::DOUBLE AS wm,
      sum(ties * ties - 1)::DOUBLE AS tie_sum FROM rk GROUP BY ALL),
    zed AS (SELECT *, (wp - n * (n + 1) / 4.0) / sqrt(n::DOUBLE * (n + 1) * (2 * n + 1) / 24 - tie_sum / 48) AS z FROM w)
    SELECT benchmark, left_condition, right_condition, n, {r6('wp')} AS w_plus, {r6('wm')} AS w_minus, {r6('z')} AS z, {r6(erfc_sql('z'))} AS p FROM zed""",
)
def wilcoxon_signed_rank(t: Tables) -> DataFrame:
    return rounded(X.wilcoxon_signed_rank(diffs(t), DIFF_CELL), "w_plus", "w_minus", "z", "p")


@query(
    "paired_summary",
    f"""WITH {DIFF_SQL} SELECT benchmark, left_condition, right_condition, count(*) AS n, {r6('avg(diff)')} AS mean_difference,
      {r6('quantile_cont(diff, 0.5)')} AS median_difference, {r6('avg(diff) / stddev_samp(diff)')} AS effect_size FROM diffs GROUP BY ALL""",
)
def paired_summary(t: Tables) -> DataFrame:
    return rounded(X.paired_summary(diffs(t), DIFF_CELL), "mean_difference", "median_difference", "effect_size")


@query(
    "rank_agreement",
    f"""WITH {POINT_SQL}, s AS (SELECT platform, benchmark, condition, avg(composite) AS score FROM judges GROUP BY ALL),
    r AS (SELECT *, rank() OVER (PARTITION BY benchmark, platform ORDER BY score) AS rk FROM s)
    SELECT a.benchmark, count(*) AS systems, {r6('corr(a.rk, b.rk)')} AS rho FROM r a JOIN r b ON a.benchmark = b.benchmark AND a.condition = b.condition
      AND a.platform = 'F' AND b.platform = 'O' GROUP BY a.benchmark""",
)
def rank_agreement(t: Tables) -> DataFrame:
    from pairlens.operators.quality import pointwise_judges

    scores = pointwise_judges(pointwise(t)).groupBy("platform", "benchmark", "condition").agg(
        F.avg("composite").alias("score")
    )
    return rounded(X.rank_agreement(scores, ["benchmark"], ("F", "O")), "rho")


@query(
    "covariate_adjusted_fit",
)
def covariate_adjusted_fit(t: Tables) -> DataFrame:
    """Verdict score on condition, judge, platform and lengths; fitted by Spark ML."""
    score = F.when(F.col("verdict") == "left", 1.0).when(F.col("verdict") == "right", 0.0).otherwise(0.5)
    rows = V.measured(t).select(
        score.alias("score"), "right_condition", "judge_id", "platform",
        F.col("left_length").cast("double").alias("left_length"),
        F.col("right_length").cast("double").alias("right_length"),
    )
    fit = X.covariate_adjusted_fit(rows, "score", ["right_condition", "judge_id", "platform"], ["left_length", "right_length"])
    return rounded(fit, "coefficient")


@query(
    "raw_condition_means",
    f"""WITH {NATIVE_SQL} SELECT benchmark, condition, count(*) AS n, {r6('avg(artifact_mean)')} AS raw_mean FROM scores GROUP BY ALL""",
)
def raw_condition_means(t: Tables) -> DataFrame:
    """Raw means shown beside the adjusted fit."""
    return native_scores(t).groupBy("benchmark", "condition").agg(
        F.count(F.lit(1)).alias("n"), S.round6(F.avg("artifact_mean")).alias("raw_mean")
    )
