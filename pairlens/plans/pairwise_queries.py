"""Registered queries of the pairwise report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.functions import stats as S
from pairlens.operators import pairs as P
from pairlens.plans import views as V
from pairlens.plans.registry import Tables, query, r6

CELL = "benchmark, platform, left_condition, right_condition"
COLLAPSED = f"{V.PROMPT_SQL}, collapsed AS (SELECT {CELL}, {V.WLT_SQL} FROM prompt_verdicts GROUP BY ALL)"
POOLED = f"""{V.VERDICT_SQL}, pooled AS (SELECT {CELL},
  CAST(sum((outcome_ab = left_condition)::INT + (outcome_ba = left_condition)::INT) AS BIGINT) AS wins,
  CAST(sum((outcome_ab = right_condition)::INT + (outcome_ba = right_condition)::INT) AS BIGINT) AS losses,
  CAST(sum((outcome_ab = 'tie')::INT + (outcome_ba = 'tie')::INT) AS BIGINT) AS ties
  FROM verdicts GROUP BY ALL)"""
STATS_SQL = f"""wins + losses AS n_non_tie, {V.rate_sql('wins', 'losses')} AS win_rate,
  {V.wilson_sql('wins', 'losses', 'low')} AS wilson_low, {V.wilson_sql('wins', 'losses', 'high')} AS wilson_high,
  {V.sign_sql('wins', 'losses')} AS p_raw"""


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Round the named doubles for the oracle comparison."""
    for name in names:
        df = df.withColumn(name, S.round6(F.col(name)))
    return df


def replace_sql(*names: str) -> str:
    return "REPLACE (" + ", ".join(f"{r6(n)} AS {n}" for n in names) + ")"


RATES = ("win_rate", "wilson_low", "wilson_high", "p_raw")
HOLM_SQL = """max(least(1.0, (m - rk + 1) * p_raw)) OVER (PARTITION BY benchmark, platform, estimand
  ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p_holm"""
REPORT_CTE = f"""{COLLAPSED}, pooled AS (SELECT {CELL},
  CAST(sum((outcome_ab = left_condition)::INT + (outcome_ba = left_condition)::INT) AS BIGINT) AS wins,
  CAST(sum((outcome_ab = right_condition)::INT + (outcome_ba = right_condition)::INT) AS BIGINT) AS losses,
  CAST(sum((outcome_ab = 'tie')::INT + (outcome_ba = 'tie')::INT) AS BIGINT) AS ties
  FROM verdicts GROUP BY ALL),
cells AS (SELECT *, 'prompt_collapsed' AS estimand FROM collapsed
  UNION ALL SELECT *, 'record_pooled' FROM pooled),
tested AS (SELECT *, {STATS_SQL} FROM cells),
ranked AS (SELECT *, row_number() OVER (PARTITION BY benchmark, platform, estimand
    ORDER BY p_raw, left_condition, right_condition) AS rk,
  count(*) OVER (PARTITION BY benchmark, platform, estimand) AS m FROM tested),
report AS (SELECT * EXCLUDE (rk, m), {HOLM_SQL} FROM ranked)"""


@query(
    "pairwise_report",
    f"WITH {REPORT_CTE} SELECT * {replace_sql(*RATES, 'p_holm')} FROM report",
)
def pairwise_report(t: Tables) -> DataFrame:
    return rounded(P.pairwise_report(V.verdicts(t)), *RATES, "p_holm")


# --- records and verdicts ----------------------------------------------------

ARTIFACT_COLUMNS = [
    "p_type AS benchmark",
    "concat('p', CAST(l_partkey AS VARCHAR(20))) AS prompt",
    "CASE WHEN l_suppkey % 2 = 0 THEN 'A4' ELSE concat('A', CAST(1 + l_partkey % 3 AS VARCHAR(9))) END AS first_condition",
    "CASE WHEN l_suppkey % 2 = 0 THEN concat('A', CAST(1 + l_partkey % 3 AS VARCHAR(9))) ELSE 'A4' END AS second_condition",
    "CASE WHEN l_linestatus = 'F' THEN 'A|B' ELSE 'B|A' END AS presentation",
    "CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'R' THEN 'B' ELSE 'tie' END AS winner",
    "l_orderkey % 6 AS mapping_kind",
    "l_linenumber AS lineno",
]
# The mapping lists of the six kinds used by the view
MAPPINGS = (
    (),
    (("A|B", "first_run", "compare_run"), ("B|A", "compare_run", "first_run")),
    (("A|B", "compare_run", "first_run"), ("B|A", "first_run", "compare_run")),
    (("A|B", "compare_run", "first_run"),),
    (("A|B", "first_run", "compare_run"), ("B|A", "first_run", "compare_run")),
    (("A|B", "first_run", "first_run"), ("B|A", "compare_run", "first_run")),
)


def artifact_records(t: Tables) -> DataFrame:
    part = t.part.select("p_partkey", "p_type")
    raw = t.lineitem.join(part, F.col("l_partkey") == F.col("p_partkey")).selectExpr(*ARTIFACT_COLUMNS)
    entry = "struct<presentation:string,first_output:string,second_output:string>"
    kinds = F.array(
        *[
            F.array(
                *[
                    F.struct(
                        F.lit(a).alias("presentation"),
                        F.lit(b).alias("first_output"),
                        F.lit(c).alias("second_output"),
                    )
                    for a, b, c in items
                ]
            ).cast(f"array<{entry}>")
            for items in MAPPINGS
        ]
    )
    return raw.withColumn("order_mapping", F.element_at(kinds, F.col("mapping_kind").cast("int") + 1))


ARTIFACT_SQL = (
    "raw AS (SELECT " + ", ".join(ARTIFACT_COLUMNS) + " FROM lineitem JOIN part ON l_partkey = p_partkey)"
)
# source index of side A / side B per mapping kind and presentation
INDEX_SQL = """idx(mapping_kind, presentation, a, b) AS (VALUES
  (0, 'A|B', 0, 1), (0, 'B|A', 1, 0), (1, 'A|B', 0, 1), (1, 'B|A', 1, 0),
  (2, 'A|B', 1, 0), (2, 'B|A', 0, 1), (3, 'A|B', 1, 0), (3, 'B|A', 0, 1),
  (4, 'A|B', 0, 1), (4, 'B|A', 0, 1), (5, 'A|B', 0, 0), (5, 'B|A', 1, 0))"""


@query(
    "semantic_winner",
    f"""WITH {ARTIFACT_SQL}, {INDEX_SQL},
    named AS (SELECT benchmark, presentation, mapping_kind, CASE WHEN winner = 'tie' THEN 'tie'
      WHEN (CASE WHEN winner = 'A' THEN a ELSE b END) = 0 THEN first_condition ELSE second_condition END AS outcome
      FROM raw JOIN idx USING (mapping_kind, presentation))
    SELECT benchmark, presentation, mapping_kind, outcome, count(*) AS n FROM named GROUP BY ALL""",
)
def semantic_winner(t: Tables) -> DataFrame:
    named = artifact_records(t).withColumn(
        "outcome",
        P.semantic_winner(
            F.col("winner"),
            F.col("presentation"),
            F.col("order_mapping"),
            F.array("first_condition", "second_condition"),
        ),
    )
    return named.groupBy("benchmark", "presentation", "mapping_kind", "outcome").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "strict_order_mapping",
    f"""WITH {ARTIFACT_SQL} SELECT benchmark,
      CASE WHEN mapping_kind IN (1, 2) THEN 'kept' ELSE 'invalid_order_mapping' END AS reason, count(*) AS n
      FROM raw GROUP BY ALL""",
)
def strict_order_mapping(t: Tables) -> DataFrame:
    reason = P.strict_mapping_reason(F.col("order_mapping"))
    return (
        artifact_records(t)
        .withColumn("reason", F.coalesce(reason, F.lit("kept")))
        .groupBy("benchmark", "reason")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "match_contrast",
    f"""WITH {ARTIFACT_SQL}, {V.contrast_sql()},
    hit AS (SELECT benchmark, c.left_condition, c.right_condition, first_condition <> c.left_condition AS swapped
      FROM raw JOIN contrasts c ON (first_condition = c.left_condition AND second_condition = c.right_condition)
        OR (first_condition = c.right_condition AND second_condition = c.left_condition))
    SELECT benchmark, left_condition, right_condition, CAST(swapped AS INTEGER) AS swapped, count(*) AS n FROM hit GROUP BY ALL""",
)
def match_contrast(t: Tables) -> DataFrame:
    matched = P.match_contrast(artifact_records(t), V.contrast_table(t))
    return matched.groupBy(
        "benchmark", "left_condition", "right_condition", F.col("swapped").cast("int").alias("swapped")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "first_artifact",
    f"""WITH {V.VERDICT_SQL} SELECT benchmark, platform, left_condition, right_condition, judge_id, presentation,
      count(*) AS n, CAST(sum(o1) AS BIGINT) AS first_orders FROM firsts GROUP BY ALL""",
)
def first_artifact(t: Tables) -> DataFrame:
    first = P.first_by(
        P.valid_records(V.records(t)).withColumn("first_order", F.col("o1")),
        [*P.PAIR, "presentation"],
        V.RECORD_ORDER,
        ["first_order"],
    )
    return first.groupBy(*P.CELL, "judge_id", "presentation").agg(
        F.count(F.lit(1)).alias("n"), F.sum("first_order").alias("first_orders")
    )


@query(
    "exactly_one_per_side",
    f"""WITH {V.VERDICT_SQL}, counted AS (SELECT {CELL}, prompt, judge_id,
      count(*) FILTER (presentation = 'A|B') = 1 AND count(*) FILTER (presentation = 'B|A') = 1 AS kept
      FROM records GROUP BY ALL)
    SELECT {CELL}, judge_id, count(*) FILTER (kept) AS kept_pairs, count(*) FILTER (NOT kept) AS dropped_pairs
    FROM counted GROUP BY ALL""",
)
def exactly_one_per_side(t: Tables) -> DataFrame:
    raw = P.valid_records(V.records(t))
    one = lambda p: F.count_if(F.col("presentation") == p) == 1
    sides = raw.groupBy(*P.PAIR).agg((one("A|B") & one("B|A")).alias("kept"))
    return sides.groupBy(*P.CELL, "judge_id").agg(
        F.count_if("kept").alias("kept_pairs"), F.count_if(~F.col("kept")).alias("dropped_pairs")
    )


@query(
    "collapse_presentations",
    f"WITH {V.VERDICT_SQL} SELECT {CELL}, judge_id, verdict, count(*) AS n FROM verdicts GROUP BY ALL",
)
def collapse_presentations(t: Tables) -> DataFrame:
    return V.verdicts(t).groupBy(*P.CELL, "judge_id", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query("record_pooled", f"WITH {POOLED} SELECT * FROM pooled")
def record_pooled(t: Tables) -> DataFrame:
    return P.record_pooled(V.verdicts(t))


@query(
    "prompt_collapsed",
    f"""WITH {V.PROMPT_SQL} SELECT {CELL}, {V.WLT_SQL},
      CAST(sum(presentation_disagreements) AS BIGINT) AS presentation_disagreements,
      CAST(sum(judges_disagree) AS BIGINT) AS judge_disagreements,
      CAST(sum(observations) AS BIGINT) AS judge_prompt_observations, count(*) AS prompt_total
    FROM prompt_verdicts GROUP BY ALL""",
)
def prompt_collapsed(t: Tables) -> DataFrame:
    return P.prompt_collapsed(V.verdicts(t))


@query(
    "prompt_outcomes",
    f"WITH {V.PROMPT_SQL} SELECT {CELL}, prompt, verdict FROM prompt_verdicts",
)
def prompt_outcomes(t: Tables) -> DataFrame:
    return P.prompt_verdicts(V.verdicts(t)).select(*P.CELL, "prompt", "verdict")


@query(
    "position_consistency",
    f"""WITH {V.VERDICT_SQL}, j AS (SELECT benchmark, platform, judge_id,
      avg(CAST(consistent AS DOUBLE)) AS rate, count(*) AS scored_pairs FROM verdicts GROUP BY ALL)
    SELECT benchmark, platform, judge_id, {r6('rate')} AS rate, scored_pairs FROM j
    UNION ALL SELECT benchmark, platform, 'all', {r6('avg(rate)')}, CAST(sum(scored_pairs) AS BIGINT) FROM j GROUP BY ALL""",
)
def position_consistency(t: Tables) -> DataFrame:
    return rounded(P.position_consistency(V.verdicts(t)), "rate")


@query(
    "missing_pairs",
    f"""WITH {V.VERDICT_SQL}, {V.contrast_sql()},
    expected AS (SELECT benchmark, platform, count(*) * (SELECT count(*) FROM contrasts) AS expected_pairs
      FROM (SELECT DISTINCT benchmark, platform, prompt FROM records) GROUP BY ALL),
    scored AS (SELECT benchmark, platform, count(*) AS scored_pairs FROM
      (SELECT DISTINCT benchmark, platform, prompt, left_condition, right_condition FROM verdicts) GROUP BY ALL)
    SELECT benchmark, platform, expected_pairs, coalesce(scored_pairs, 0) AS scored_pairs,
      expected_pairs - coalesce(scored_pairs, 0) AS missing_pairs FROM expected LEFT JOIN scored USING (benchmark, platform)""",
)
def missing_pairs(t: Tables) -> DataFrame:
    return P.missing_pairs(V.records(t), V.contrast_table(t), V.verdicts(t))


@query(
    "orient_contrast",
    f"""WITH {COLLAPSED}, s AS (SELECT *, {STATS_SQL} FROM collapsed)
    SELECT benchmark, platform, right_condition AS left_condition, left_condition AS right_condition,
      losses AS wins, wins AS losses, ties, {r6('1 - win_rate')} AS win_rate,
      {r6('1 - wilson_high')} AS wilson_low, {r6('1 - wilson_low')} AS wilson_high, 1 AS flipped
    FROM s WHERE right_condition <> 'A3'
    UNION ALL SELECT benchmark, platform, left_condition, right_condition, wins, losses, ties,
      {r6('win_rate')}, {r6('wilson_low')}, {r6('wilson_high')}, 0 FROM s WHERE right_condition = 'A3'""",
)
def orient_contrast(t: Tables) -> DataFrame:
    cells = P.prompt_collapsed(V.verdicts(t)).select("*", *S.record_columns())
    wanted = V.contrast_table(t, (("A1", "A4"), ("A2", "A4"), ("A4", "A3")))
    return rounded(P.orient(cells, wanted), "win_rate", "wilson_low", "wilson_high")


@query(
    "pooled_over_benchmarks",
    f"""WITH {COLLAPSED}, p AS (SELECT platform, left_condition, right_condition, CAST(sum(wins) AS BIGINT) AS wins,
      CAST(sum(losses) AS BIGINT) AS losses, CAST(sum(ties) AS BIGINT) AS ties FROM collapsed GROUP BY ALL)
    SELECT *, {r6(V.rate_sql('wins', 'losses'))} AS win_rate,
      {r6(V.wilson_sql('wins', 'losses', 'low', '1.96', True))} AS wilson_low,
      {r6(V.wilson_sql('wins', 'losses', 'high', '1.96', True))} AS wilson_high FROM p""",
)
def pooled_over_benchmarks(t: Tables) -> DataFrame:
    pooled = P.pooled_over_benchmarks(P.prompt_collapsed(V.verdicts(t)))
    return rounded(pooled, "win_rate", "wilson_low", "wilson_high")


@query(
    "sign_test",
    f"WITH {COLLAPSED} SELECT *, {r6(V.sign_sql('wins', 'losses'))} AS p_raw FROM collapsed",
)
def sign_test(t: Tables) -> DataFrame:
    cells = P.prompt_verdicts(V.verdicts(t)).groupBy(*P.CELL).agg(*P.tally())
    return cells.withColumn("p_raw", S.round6(S.sign_test_p(F.col("wins"), F.col("losses"))))


@query(
    "wilson",
    f"""WITH {COLLAPSED} SELECT *, {r6(V.wilson_sql('wins', 'losses', 'low'))} AS wilson_low,
      {r6(V.wilson_sql('wins', 'losses', 'high'))} AS wilson_high FROM collapsed""",
)
def wilson(t: Tables) -> DataFrame:
    cells = P.prompt_verdicts(V.verdicts(t)).groupBy(*P.CELL).agg(*P.tally())
    low, high = S.wilson_bounds(F.col("wins"), F.col("losses"))
    return cells.select("*", S.round6(low).alias("wilson_low"), S.round6(high).alias("wilson_high"))


@query(
    "wilson_clamped",
    f"""WITH {POOLED} SELECT *, {r6(V.wilson_sql('wins', 'losses', 'low', '1.96', True))} AS wilson_low,
      {r6(V.wilson_sql('wins', 'losses', 'high', '1.96', True))} AS wilson_high FROM pooled""",
)
def wilson_clamped(t: Tables) -> DataFrame:
    low, high = S.wilson_bounds(F.col("wins"), F.col("losses"), 1.96, clamp=True)
    return P.record_pooled(V.verdicts(t)).select(
        "*", S.round6(low).alias("wilson_low"), S.round6(high).alias("wilson_high")
    )


@query(
    "record_stats",
    f"WITH {POOLED} SELECT * {replace_sql(*RATES)} FROM (SELECT *, {STATS_SQL} FROM pooled)",
)
def record_stats(t: Tables) -> DataFrame:
    return rounded(P.record_pooled(V.verdicts(t)).select("*", *S.record_columns()), *RATES)


@query(
    "holm",
    f"""WITH {REPORT_CTE} SELECT estimand, {CELL}, {r6('p_raw')} AS p_raw, {r6('p_holm')} AS p_holm FROM report""",
)
def holm(t: Tables) -> DataFrame:
    report = P.pairwise_report(V.verdicts(t)).select("estimand", *P.CELL, "p_raw", "p_holm")
    return rounded(report, "p_raw", "p_holm")


# --- replications: the run set is a key --------------------------------------

RUN_CELLS = f"""{V.VERDICT_RUN_SQL}, prompt_verdicts AS (SELECT run_set, benchmark, platform, prompt, left_condition,
  right_condition, CASE WHEN min(verdict) = max(verdict) THEN min(verdict) ELSE 'tie' END AS verdict,
  count(*) AS observations, count(*) FILTER (NOT consistent) AS disagreements FROM verdicts GROUP BY ALL),
cells AS (SELECT run_set, {CELL}, {V.WLT_SQL}, CAST(sum(disagreements) AS BIGINT) AS disagreements, count(*) AS prompts
  FROM prompt_verdicts GROUP BY ALL)"""


def run_cells(t: Tables) -> DataFrame:
    """Prompt-collapsed cells of each replication."""
    prompts = P.prompt_rows(V.verdicts(t, ["run_set"]), ["run_set"])
    return prompts.groupBy("run_set", *P.CELL).agg(
        *P.code_tally(),
        F.sum("presentation_disagreements").alias("disagreements"),
        F.count(F.lit(1)).alias("prompts"),
    )


FAMILY_SQL = f"""{RUN_CELLS}, tested AS (SELECT *, {V.sign_sql('wins', 'losses')} AS p_raw FROM cells),
ranked AS (SELECT *, row_number() OVER (PARTITION BY benchmark, platform
    ORDER BY p_raw, run_set, left_condition, right_condition) AS rk,
  count(*) OVER (PARTITION BY benchmark, platform) AS m FROM tested),
fam AS (SELECT * EXCLUDE (rk, m), m AS family_size, max(least(1.0, (m - rk + 1) * p_raw)) OVER (PARTITION BY
  benchmark, platform ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p_holm FROM ranked)"""


def holm_family(t: Tables) -> DataFrame:
    """One Holm family over all replications and contrasts of a benchmark."""
    cells = run_cells(t).withColumn("p_raw", S.sign_test_p(F.col("wins"), F.col("losses")))
    members = P.family_members((0, 1, 2), V.CONTRASTS, V.CONTRASTS)
    return P.holm_over_runs(cells, members, ["benchmark", "platform"])


@query(
    "holm_family_runs",
    f"""WITH {FAMILY_SQL} SELECT run_set, {CELL}, wins, losses, ties, family_size, family_size = {3 * len(V.CONTRASTS)} AS complete,
      'run-' || (run_set + 1) || ':' || left_condition || ':' || right_condition AS member, {r6('p_raw')} AS p_raw, {r6('p_holm')} AS p_holm FROM fam""",
)
def holm_family_runs(t: Tables) -> DataFrame:
    return rounded(holm_family(t).drop("disagreements", "prompts"), "p_raw", "p_holm")


@query(
    "holm_survivors",
    f"""WITH {FAMILY_SQL} SELECT run_set, left_condition, right_condition,
      count(*) FILTER (p_holm < 0.05) AS survivors, count(*) AS cells
    FROM fam GROUP BY GROUPING SETS ((run_set, left_condition, right_condition), (left_condition, right_condition))""",
)
def holm_survivors(t: Tables) -> DataFrame:
    return (
        holm_family(t)
        .groupingSets(
            [["run_set", *P.CONTRAST], [*P.CONTRAST]], "run_set", *P.CONTRAST
        )
        .agg(F.count_if(F.col("p_holm") < P.SIGNIFICANCE).alias("survivors"), F.count(F.lit(1)).alias("cells"))
        .select("run_set", *P.CONTRAST, "survivors", "cells")
    )


@query(
    "replicate_mean_sd",
    f"""WITH {RUN_CELLS}, rates AS (SELECT run_set, {CELL}, {V.rate_sql('wins', 'losses')} AS rate FROM cells)
    SELECT {CELL}, count(rate) AS runs, {r6('avg(rate)')} AS rate_mean, {r6('stddev_samp(rate)')} AS rate_sd,
      {r6('max(CASE WHEN run_set = 0 THEN rate END)')} AS run_0, {r6('max(CASE WHEN run_set = 1 THEN rate END)')} AS run_1,
      {r6('max(CASE WHEN run_set = 2 THEN rate END)')} AS run_2 FROM rates GROUP BY {CELL}""",
)
def replicate_mean_sd(t: Tables) -> DataFrame:
    rates = run_cells(t).withColumn("rate", S.win_rate(F.col("wins"), F.col("losses")))
    report = rates.groupBy(*P.CELL).agg(
        F.count("rate").alias("runs"),
        F.avg("rate").alias("rate_mean"),
        F.stddev_samp("rate").alias("rate_sd"),
        *[F.max(F.when(F.col("run_set") == i, F.col("rate"))).alias(f"run_{i}") for i in range(3)],
    )
    return rounded(report, "rate_mean", "rate_sd", "run_0", "run_1", "run_2")


@query(
    "disagreement_rate",
    f"""WITH {RUN_CELLS}, per_run AS (SELECT benchmark, run_set, sum(disagreements) / CAST(sum(prompts) AS DOUBLE) AS rate,
      CAST(sum(disagreements) AS BIGINT) AS disagreements, CAST(sum(prompts) AS BIGINT) AS prompts FROM cells GROUP BY ALL)
    SELECT benchmark, run_set, disagreements, prompts, {r6('rate')} AS rate, NULL::DOUBLE AS rate_mean, NULL::DOUBLE AS rate_sd FROM per_run
    UNION ALL SELECT benchmark, NULL, CAST(sum(disagreements) AS BIGINT), CAST(sum(prompts) AS BIGINT),
      {r6('sum(disagreements) / sum(prompts)')}, {r6('avg(rate)')}, {r6('stddev_samp(rate)')} FROM per_run GROUP BY benchmark""",
)
def disagreement_rate(t: Tables) -> DataFrame:
    per_run = run_cells(t).groupBy("benchmark", "run_set").agg(
        F.sum("disagreements").alias("disagreements"), F.sum("prompts").alias("prompts")
    )
    per_run = per_run.withColumn("rate", F.col("disagreements") / F.col("prompts"))
    pooled = per_run.groupBy("benchmark").agg(
        F.sum("disagreements").alias("disagreements"),
        F.sum("prompts").alias("prompts"),
        F.avg("rate").alias("rate_mean"),
        F.stddev_samp("rate").alias("rate_sd"),
    ).withColumn("rate", F.col("disagreements") / F.col("prompts"))
    return rounded(
        per_run.unionByName(pooled, allowMissingColumns=True), "rate", "rate_mean", "rate_sd"
    )


# --- attempted prompts, missing pairs and audits -------------------------------

ATTEMPT_SQL = f"""{V.PROMPT_SQL}, attempted AS (SELECT benchmark, platform, count(DISTINCT prompt) AS attempted FROM records GROUP BY ALL),
won AS (SELECT {CELL}, {V.WLT_SQL}, count(*) AS scored FROM prompt_verdicts GROUP BY ALL),
both_sides AS (SELECT *, attempted - scored AS missing FROM won JOIN attempted USING (benchmark, platform))"""


def attempted_cells(t: Tables) -> DataFrame:
    attempted = (
        V.records(t).select(*P.PROMPT).distinct()
        .groupBy("benchmark", "platform").agg(F.count(F.lit(1)).alias("attempted"))
    )
    won = P.prompt_verdicts(V.verdicts(t)).groupBy(*P.CELL).agg(
        *P.tally(), F.count(F.lit(1)).alias("scored")
    )
    return won.join(attempted, ["benchmark", "platform"]).withColumn(
        "missing", F.col("attempted") - F.col("scored")
    )


@query(
    "unconditional_share",
    f"""WITH {ATTEMPT_SQL} SELECT {CELL}, wins, losses, attempted, {r6('wins / attempted::DOUBLE')} AS win_share,
      {r6('losses / attempted::DOUBLE')} AS loss_share FROM both_sides""",
)
def unconditional_share(t: Tables) -> DataFrame:
    return attempted_cells(t).select(
        *P.CELL, "wins", "losses", "attempted",
        S.round6(F.col("wins") / F.col("attempted")).alias("win_share"),
        S.round6(F.col("losses") / F.col("attempted")).alias("loss_share"),
    )


@query(
    "missing_pair_bounds",
    f"""WITH {ATTEMPT_SQL} SELECT {CELL}, missing, {r6('wins / (wins + losses + missing)::DOUBLE')} AS worst_rate,
      {r6('(wins + missing) / (wins + losses + missing)::DOUBLE')} AS best_rate FROM both_sides""",
)
def missing_pair_bounds(t: Tables) -> DataFrame:
    total = F.col("wins") + F.col("losses") + F.col("missing")
    return attempted_cells(t).select(
        *P.CELL, "missing",
        S.round6(F.col("wins") / total).alias("worst_rate"),
        S.round6((F.col("wins") + F.col("missing")) / total).alias("best_rate"),
    )


@query(
    "pair_count_audit",
    f"""WITH {ATTEMPT_SQL}, j AS (SELECT {CELL}, count(DISTINCT prompt) AS judged FROM records GROUP BY ALL)
    SELECT {CELL}, judged AS eligible, scored, judged - scored AS dropped, wins + losses AS non_ties,
      CASE WHEN wins + losses + ties = scored THEN 0 ELSE 1 END + CASE WHEN judged < scored THEN 1 ELSE 0 END AS violations
    FROM both_sides JOIN j USING ({CELL})""",
)
def pair_count_audit(t: Tables) -> DataFrame:
    judged = V.records(t).select(*P.CELL, "prompt").distinct().groupBy(*P.CELL).agg(
        F.count(F.lit(1)).alias("eligible")
    )
    won = P.prompt_verdicts(V.verdicts(t)).groupBy(*P.CELL).agg(
        *P.tally(), F.count(F.lit(1)).alias("scored")
    )
    counts_agree = F.col("wins") + F.col("losses") + F.col("ties") == F.col("scored")
    return won.join(judged, P.CELL).select(
        *P.CELL, "eligible", "scored",
        (F.col("eligible") - F.col("scored")).alias("dropped"),
        (F.col("wins") + F.col("losses")).alias("non_ties"),
        (F.when(counts_agree, 0).otherwise(1) + F.when(F.col("eligible") < F.col("scored"), 1).otherwise(0)).alias("violations"),
    )


@query(
    "report_ranges",
    f"""WITH {REPORT_CTE} SELECT estimand, {CELL},
      CAST(coalesce(win_rate BETWEEN 0 AND 1, true) AS INTEGER) AS rate_ok,
      CAST(coalesce(wilson_low <= wilson_high, true) AS INTEGER) AS interval_ok,
      CAST(p_holm >= p_raw AS INTEGER) AS holm_ok, CAST(n_non_tie = wins + losses AS INTEGER) AS counts_ok FROM report""",
)
def report_ranges(t: Tables) -> DataFrame:
    ok = lambda c: F.coalesce(c, F.lit(True)).cast("int")
    return P.pairwise_report(V.verdicts(t)).select(
        "estimand", *P.CELL,
        ok(F.col("win_rate").between(0, 1)).alias("rate_ok"),
        ok(F.col("wilson_low") <= F.col("wilson_high")).alias("interval_ok"),
        ok(F.col("p_holm") >= F.col("p_raw")).alias("holm_ok"),
        ok(F.col("n_non_tie") == F.col("wins") + F.col("losses")).alias("counts_ok"),
    )


@query(
    "tie_half_win_rate",
    f"""WITH {V.VERDICT_SQL} SELECT {CELL}, judge_id, count(*) AS pairs,
      {r6("avg(CASE verdict WHEN 'left' THEN 1.0 WHEN 'right' THEN 0.0 ELSE 0.5 END)")} AS rate FROM verdicts GROUP BY ALL""",
)
def tie_half_win_rate(t: Tables) -> DataFrame:
    score = F.when(F.col("verdict") == "left", 1.0).when(F.col("verdict") == "right", 0.0).otherwise(0.5)
    return V.verdicts(t).groupBy(*P.CELL, "judge_id").agg(
        F.count(F.lit(1)).alias("pairs"), S.round6(F.avg(score)).alias("rate")
    )
