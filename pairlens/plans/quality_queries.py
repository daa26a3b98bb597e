"""Registered queries on quality scores, paired differences and cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.functions.stats import round6
from pairlens.functions.text import CJK, SPACE, output_units
from pairlens.operators import canon as C
from pairlens.operators import cost as K
from pairlens.operators import quality as Q
from pairlens.operators import resampling as B
from pairlens.plans import views as V
from pairlens.plans.pairwise_queries import replace_sql, rounded
from pairlens.plans.registry import Tables, query, r6
from pairlens.session import written

POINT_COLUMNS = [
    "p_type AS benchmark",
    "l_linestatus AS platform",
    "l_returnflag AS judge_id",
    "concat('A', CAST(1 + l_suppkey % 7 AS VARCHAR(9))) AS condition",
    "concat('p', CAST(l_partkey AS VARCHAR(20))) AS prompt",
    "l_orderkey AS path",
    "l_orderkey % 3 AS run_set",
    "CASE WHEN l_quantity = 17 THEN 2 ELSE 1 END AS n_sources",
    "l_quantity AS instruction_fulfillment",
    "l_extendedprice AS organization_global_coherence",
    "l_discount AS content_adequacy_depth",
    "CASE WHEN l_quantity = 13 THEN NULL ELSE l_tax END AS style_voice_audience_fit",
    "CAST(l_linenumber AS DOUBLE) AS factuality_constraint_fidelity",
    "l_orderkey AS o1",
    "l_linenumber AS o2",
    "l_suppkey AS o3",
    "l_extendedprice AS o4",
]
DIM = Q.DIMENSIONS


def pointwise(t: Tables) -> DataFrame:
    part = t.part.select("p_partkey", "p_type")
    return t.lineitem.join(part, F.col("l_partkey") == F.col("p_partkey")).selectExpr(*POINT_COLUMNS)


def z_sql(group: str, source: str) -> str:
    z = " + ".join(
        f"(CASE WHEN stddev_pop({d}) OVER w = 0 THEN 0 ELSE ({d} - avg({d}) OVER w) / stddev_pop({d}) OVER w END)"
        for d in DIM
    )
    return f"SELECT *, ({z}) / 5 AS composite FROM {source} WINDOW w AS (PARTITION BY {group})"


POINT_SQL = (
    "points AS (SELECT "
    + ", ".join(POINT_COLUMNS)
    + " FROM lineitem JOIN part ON l_partkey = p_partkey), valid AS (SELECT * FROM points WHERE n_sources = 1 AND "
    + " AND ".join(f"{d} IS NOT NULL" for d in DIM)
    + f"), z AS ({z_sql('platform, judge_id, benchmark', 'valid')}), judges AS (SELECT platform, benchmark, condition, judge_id, "
    + ", ".join(f"avg({d}) AS {d}" for d in DIM)
    + ", avg(composite) AS composite, count(*) AS record_count FROM z GROUP BY ALL)"
)


@query(
    "pointwise_valid",
    f"WITH {POINT_SQL} SELECT platform, benchmark, judge_id, count(*) AS records FROM valid GROUP BY ALL",
)
def pointwise_valid(t: Tables) -> DataFrame:
    return Q.pointwise_valid(pointwise(t)).groupBy("platform", "benchmark", "judge_id").agg(
        F.count(F.lit(1)).alias("records")
    )


@query(
    "z_score",
    f"""WITH {POINT_SQL} SELECT platform, benchmark, condition, judge_id, record_count, {r6('composite')} AS composite FROM judges""",
)
def z_score(t: Tables) -> DataFrame:
    judged = Q.pointwise_judges(pointwise(t))
    return rounded(judged.drop(*DIM), "composite")


@query(
    "pointwise_z",
    f"""WITH {POINT_SQL}, r AS (SELECT platform, benchmark, condition, count(DISTINCT path) AS run_count FROM valid GROUP BY ALL)
    SELECT platform, benchmark, condition, {', '.join(f"{r6(f'avg({d})')} AS {d}" for d in DIM)},
      {r6('avg(composite)')} AS composite, CAST(sum(record_count) AS BIGINT) AS record_count, count(*) AS judges,
      any_value(run_count) AS run_count FROM judges JOIN r USING (platform, benchmark, condition) GROUP BY ALL""",
)
def pointwise_z(t: Tables) -> DataFrame:
    return rounded(Q.pointwise_report(pointwise(t)), *DIM, "composite")


NATIVE_SQL = """scores AS (
  SELECT 'codex' AS platform, 'checklist' AS benchmark, concat('A', CAST(label AS VARCHAR)) AS condition,
    'judge-' || CAST(vec_id % 2 AS VARCHAR) AS judge_id, '0-1' AS scale,
    list_avg([round(abs(x) * 4) / 4 FOR x IN embedding]) AS artifact_mean FROM embeddings
  UNION ALL SELECT 'codex', p_type, concat('A', CAST(1 + l_suppkey % 7 AS VARCHAR)), 'judge-' || CAST(l_orderkey % 2 AS VARCHAR), '1-10',
    avg(1 + l_quantity % 10) FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type, 1 + l_suppkey % 7, l_orderkey)"""


def native_scores(t: Tables) -> DataFrame:
    """Artifact means: a fold over checklist items, and criterion scores grouped by artifact."""
    items = F.transform("embedding", lambda x: F.round(F.abs(x.cast("double")) * 4, 0) / 4)
    total = F.aggregate(items, F.lit(0.0), lambda a, x: a + x)
    judge = lambda c: F.concat(F.lit("judge-"), (c % 2).cast("string"))
    checklist = t.embeddings.select(
        F.lit("codex").alias("platform"),
        F.lit("checklist").alias("benchmark"),
        F.concat(F.lit("A"), F.col("label").cast("string")).alias("condition"),
        judge(F.col("vec_id")).alias("judge_id"),
        F.lit("0-1").alias("scale"),
        (total / F.size("embedding")).alias("artifact_mean"),
    )
    part = t.part.select("p_partkey", "p_type")
    criteria = t.lineitem.join(part, F.col("l_partkey") == F.col("p_partkey"))
    rated = criteria.groupBy(
        F.col("p_type").alias("benchmark"), (1 + F.col("l_suppkey") % 7).alias("c"), "l_orderkey"
    ).agg(F.avg(1 + F.col("l_quantity") % 10).alias("artifact_mean"))
    pointwise_native = rated.select(
        F.lit("codex").alias("platform"),
        "benchmark",
        F.concat(F.lit("A"), F.col("c").cast("string")).alias("condition"),
        judge(F.col("l_orderkey")).alias("judge_id"),
        F.lit("1-10").alias("scale"),
        "artifact_mean",
    )
    return checklist.unionByName(pointwise_native)


@query(
    "native_score",
    f"""WITH {NATIVE_SQL}, j AS (SELECT platform, benchmark, condition, judge_id, scale, avg(artifact_mean) AS score, count(*) AS artifacts
      FROM scores GROUP BY ALL)
    SELECT platform, benchmark, condition, scale, {r6('avg(score)')} AS mean_score, count(*) AS judges,
      CAST(sum(artifacts) AS BIGINT) AS artifacts FROM j GROUP BY ALL""",
)
def native_score(t: Tables) -> DataFrame:
    return rounded(Q.native_report(native_scores(t)), "mean_score")


SCORES_SQL = f"""{POINT_SQL}, firsts AS (SELECT * FROM valid QUALIFY row_number() OVER
  (PARTITION BY run_set, benchmark, condition, prompt ORDER BY o1, o2, o3, o4) = 1),
zs AS ({z_sql('run_set, benchmark', 'firsts')}),
prompt_scores AS (SELECT benchmark, condition, prompt, avg(composite) AS score, count(*) AS runs FROM zs GROUP BY ALL)"""


def prompt_scores(t: Tables) -> DataFrame:
    return Q.prompt_scores(Q.pointwise_valid(pointwise(t)), V.record_place())


@query(
    "prompt_scores_runs",
    f"WITH {SCORES_SQL} SELECT benchmark, condition, prompt, {r6('score')} AS score, runs FROM prompt_scores",
)
def prompt_scores_runs(t: Tables) -> DataFrame:
    return rounded(prompt_scores(t), "score")


# System pairs compared by the paired report
PAIRED = (
    *[(a, b) for a in ("A1", "A2", "A3", "A4") for b in ("A1", "A2", "A3", "A4") if a != b],
    *[(a, b) for a in ("A5", "A6") for b in ("A1", "A2", "A3")],
)
DIFF_SQL = f"""{SCORES_SQL}, {V.contrast_sql(PAIRED)}, diffs AS (SELECT l.benchmark, l.prompt, c.left_condition, c.right_condition,
  l.score - r.score AS diff FROM contrasts c JOIN prompt_scores l ON l.condition = c.left_condition
  JOIN prompt_scores r ON r.condition = c.right_condition AND r.benchmark = l.benchmark AND r.prompt = l.prompt)"""


def diffs(t: Tables, contrasts=PAIRED) -> DataFrame:
    both = C.paired_rows(
        prompt_scores(t), V.contrast_table(t, contrasts), ["benchmark", "prompt"], ["score"]
    )
    return both.withColumn("diff", F.col("left_score") - F.col("right_score"))


PAIR_CELL = ["benchmark", "left_condition", "right_condition"]


@query(
    "paired_prompts",
    f"""WITH {DIFF_SQL} SELECT benchmark, left_condition, right_condition, count(*) AS prompts, {r6('avg(diff)')} AS mean_difference
    FROM diffs GROUP BY ALL""",
)
def paired_prompts(t: Tables) -> DataFrame:
    return diffs(t).groupBy(*PAIR_CELL).agg(
        F.count(F.lit(1)).alias("prompts"), round6(F.avg("diff")).alias("mean_difference")
    )


@query(
    "intersect_prompts",
    f"""WITH {SCORES_SQL} SELECT benchmark, count(*) AS prompts FROM (
      SELECT benchmark, prompt FROM prompt_scores WHERE condition = 'A4' INTERSECT
      SELECT benchmark, prompt FROM prompt_scores WHERE condition = 'A1') GROUP BY ALL""",
)
def intersect_prompts(t: Tables) -> DataFrame:
    scored = prompt_scores(t)
    of = lambda c: scored.filter(F.col("condition") == c).select("benchmark", "prompt")
    return of("A4").intersect(of("A1")).groupBy("benchmark").agg(F.count(F.lit(1)).alias("prompts"))


SEED, RESAMPLES = 20260908, 10_000
BOOT_SQL = f"""{SCORES_SQL}, {V.contrast_sql(PAIRED)}, diffs AS (SELECT l.benchmark, l.prompt, c.left_condition, c.right_condition,
  l.score - r.score AS diff FROM contrasts c JOIN prompt_scores l ON l.condition = c.left_condition
  JOIN prompt_scores r ON r.condition = c.right_condition AND r.benchmark = l.benchmark AND r.prompt = l.prompt),
placed AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY benchmark, left_condition, right_condition) AS n
  FROM diffs WINDOW w AS (PARTITION BY benchmark, left_condition, right_condition ORDER BY prompt)),
{V.draw_ctes(SEED, RESAMPLES, 'benchmark, left_condition, right_condition')},
means AS (SELECT benchmark, left_condition, right_condition, b, {V.exact_mean_sql('diff')} AS mean FROM draws d
  JOIN placed p USING (benchmark, left_condition, right_condition) WHERE p.i = d.pick GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY benchmark, left_condition, right_condition ORDER BY mean) AS rk FROM means),
boot AS (SELECT benchmark, left_condition, right_condition, max(CASE WHEN rk = {int(0.025 * RESAMPLES) + 1} THEN mean END) AS low,
  max(CASE WHEN rk = {int(0.975 * RESAMPLES)} THEN mean END) AS high FROM ranked GROUP BY ALL),
cells AS (SELECT benchmark, left_condition, right_condition, count(*) AS prompts, avg(diff) AS mean_difference FROM diffs GROUP BY ALL)"""


def paired_bootstrap_report(t: Tables) -> DataFrame:
    units = written(diffs(t, PAIRED), "diffs")
    means = B.bootstrap_means(units, PAIR_CELL, ["prompt"], "diff", RESAMPLES, SEED)
    cells = units.groupBy(*PAIR_CELL).agg(
        F.count(F.lit(1)).alias("prompts"), F.avg("diff").alias("mean_difference")
    )
    return cells.join(B.positional_interval(means, PAIR_CELL, RESAMPLES), PAIR_CELL)


@query(
    "paired_bootstrap",
    f"""WITH {BOOT_SQL} SELECT benchmark, left_condition, right_condition, prompts, {r6('mean_difference')} AS mean_difference,
      {r6('low')} AS low, {r6('high')} AS high FROM cells JOIN boot USING (benchmark, left_condition, right_condition)""",
)
def paired_bootstrap(t: Tables) -> DataFrame:
    return rounded(paired_bootstrap_report(t), "mean_difference", "low", "high")


@query(
    "separation_count",
    f"""WITH {BOOT_SQL} SELECT left_condition, count(*) AS contrasts, count(*) FILTER (round(low / 0.1, 3) > 0) AS separated
    FROM boot GROUP BY ALL""",
)
def separation_count(t: Tables) -> DataFrame:
    """Contrasts whose lower bound, scaled and shown with three decimals, is above zero."""
    shown = F.round(F.col("low") / 0.1, 3)
    return paired_bootstrap_report(t).groupBy("left_condition").agg(
        F.count(F.lit(1)).alias("contrasts"), F.count_if(shown > 0).alias("separated")
    )


@query(
    "scaled_run_mean_sd",
    f"""WITH {POINT_SQL}, runs3 AS (SELECT run_set, benchmark, condition, avg(instruction_fulfillment) / 10 AS native,
        avg(factuality_constraint_fidelity) AS fidelity FROM valid GROUP BY ALL),
      over AS (SELECT a.benchmark, count(*) FILTER (a.native > b.native) AS exceeds FROM runs3 a JOIN runs3 b
        ON a.benchmark = b.benchmark AND a.run_set = b.run_set AND a.condition = 'A4' AND b.condition = 'A3' GROUP BY ALL)
    SELECT benchmark, condition, {r6('avg(native)')} AS native_mean, {r6('stddev_samp(native)')} AS native_sd,
      {r6('avg(fidelity)')} AS fidelity_mean, {r6('stddev_samp(fidelity)')} AS fidelity_sd, any_value(exceeds) AS a4_exceeds_a3
    FROM runs3 JOIN over USING (benchmark) GROUP BY benchmark, condition""",
)
def scaled_run_mean_sd(t: Tables) -> DataFrame:
    runs = Q.pointwise_valid(pointwise(t)).groupBy("run_set", "benchmark", "condition").agg(
        (F.avg("instruction_fulfillment") / 10).alias("native"),
        F.avg("factuality_constraint_fidelity").alias("fidelity"),
    )
    per_run = runs.groupBy("benchmark", "run_set").agg(
        F.max(F.when(F.col("condition") == "A4", F.col("native"))).alias("a4"),
        F.max(F.when(F.col("condition") == "A3", F.col("native"))).alias("a3"),
    )
    exceeds = per_run.groupBy("benchmark").agg(F.count_if(F.col("a4") > F.col("a3")).alias("a4_exceeds_a3"))
    cells = runs.groupBy("benchmark", "condition").agg(
        F.avg("native").alias("native_mean"),
        F.stddev_samp("native").alias("native_sd"),
        F.avg("fidelity").alias("fidelity_mean"),
        F.stddev_samp("fidelity").alias("fidelity_sd"),
    )
    return rounded(
        cells.join(exceeds, "benchmark"), "native_mean", "native_sd", "fidelity_mean", "fidelity_sd"
    )


# --- cost from conversations -----------------------------------------------

# Prices per million tokens used by the views
PRICES = (1.25, 0.125, 10.0)
CHAT_COLUMNS = [
    "conv_id AS path",
    "turn AS pos",
    "'codex' AS platform",
    "concat('b', CAST(conv_id % 3 AS VARCHAR(9))) AS benchmark",
    "concat('A', CAST(1 + conv_id % 7 AS VARCHAR(9))) AS condition",
    "CASE WHEN role = 'assistant' THEN 'turn.completed' ELSE 'turn.started' END AS type",
    "CASE WHEN conv_id % 3 = 0 THEN NULL WHEN conv_id % 7 = 0 THEN -5 ELSE CAST(length(text) AS BIGINT) END AS input_tokens",
    "CASE WHEN conv_id % 5 = 0 THEN NULL ELSE CAST(length(text) AS BIGINT) + 1 END AS prompt_tokens",
    "CASE WHEN turn % 2 = 1 THEN 40 END AS cached_input_tokens",
    "CASE WHEN conv_id % 2 = 0 THEN 25 END AS cached_tokens",
    "CASE WHEN conv_id % 11 = 0 THEN NULL ELSE turn * 3 END AS reasoning_tokens",
    "text",
]
UNITS_SQL = (
    f"(len(regexp_extract_all(text, '[{CJK}]')) + len(regexp_extract_all(text, '[^{CJK}{SPACE}]+')))"
)
CHAT_SQL = (
    "chat AS (SELECT "
    + ", ".join(CHAT_COLUMNS)
    + f", {UNITS_SQL} AS output_tokens FROM conversations)"
    + """, used AS (SELECT *, coalesce(CASE WHEN cached_input_tokens >= 0 THEN cached_input_tokens END, CASE WHEN cached_tokens >= 0 THEN cached_tokens END, 0) AS cached_input,
  coalesce(CASE WHEN input_tokens >= 0 THEN input_tokens END, CASE WHEN prompt_tokens >= 0 THEN prompt_tokens END, 0) AS asked,
  output_tokens + coalesce(reasoning_tokens, 0) AS output FROM chat),
events3 AS (SELECT * EXCLUDE (asked), greatest(asked - cached_input, 0) AS input FROM used)"""
)


def chat(t: Tables) -> DataFrame:
    return t.conversations.selectExpr(*CHAT_COLUMNS).withColumn(
        "output_tokens", output_units(F.col("text")).cast("bigint")
    )


def _usage(df: DataFrame) -> dict:
    return {c: F.col(c) for c in df.columns if c.endswith("_tokens")}


def usage_events(t: Tables) -> DataFrame:
    turns = chat(t)
    return turns.select("path", "pos", "platform", "benchmark", "condition", "type", *K.usage_columns(_usage(turns)))


def prices(t: Tables) -> DataFrame:
    a, b, c = PRICES
    return t.spark.sql(f"SELECT {a}D AS input, {b}D AS cached_input, {c}D AS output")


@query(
    "usage_fields",
    f"""WITH {CHAT_SQL} SELECT benchmark, condition, type, CAST(sum(input) AS BIGINT) AS input,
      CAST(sum(cached_input) AS BIGINT) AS cached_input, CAST(sum(output) AS BIGINT) AS output FROM events3 GROUP BY ALL""",
)
def usage_fields(t: Tables) -> DataFrame:
    return usage_events(t).groupBy("benchmark", "condition", "type").agg(
        *[F.sum(k).alias(k) for k in K.PRICE_KEYS]
    )


GEN_SQL = f"""{CHAT_SQL}, gen AS (SELECT platform, benchmark, condition, count(DISTINCT path) AS run_count,
  CAST(coalesce(sum(input) FILTER (type = 'turn.completed'), 0) AS BIGINT) AS input,
  CAST(coalesce(sum(cached_input) FILTER (type = 'turn.completed'), 0) AS BIGINT) AS cached_input,
  CAST(coalesce(sum(output) FILTER (type = 'turn.completed'), 0) AS BIGINT) AS output FROM events3 GROUP BY ALL),
gencost AS (SELECT *, (input * {PRICES[0]} + cached_input * {PRICES[1]} + output * {PRICES[2]}) / 1e6 AS cost FROM gen)"""


def generation(t: Tables) -> DataFrame:
    runs = chat(t).select("path", "platform", "benchmark", "condition").distinct()
    return K.generation_cost(runs, usage_events(t), prices(t))


@query("tokens_cost_generation", f"WITH {GEN_SQL} SELECT * {replace_sql('cost')} FROM gencost")
def tokens_cost_generation(t: Tables) -> DataFrame:
    return rounded(generation(t), "cost")


@query(
    "tokens_per_run",
    f"""WITH {GEN_SQL} SELECT condition, CAST(sum(run_count) AS BIGINT) AS run_count,
      {r6('sum(input) / sum(run_count)')} AS input_per_run, {r6('sum(cached_input) / sum(run_count)')} AS cached_input_per_run,
      {r6('sum(output) / sum(run_count)')} AS output_per_run, {r6('sum(cost) / sum(run_count)')} AS cost_per_run FROM gencost GROUP BY ALL""",
)
def tokens_per_run(t: Tables) -> DataFrame:
    return rounded(
        K.per_run(generation(t), ["condition"]), *[f"{k}_per_run" for k in (*K.PRICE_KEYS, "cost")]
    )


JUDGE_SQL = f"""judged AS (SELECT CASE path % 3 WHEN 0 THEN 'pairwise' WHEN 1 THEN 'pointwise' ELSE 'native-checklist' END AS task,
  path, coalesce(CASE WHEN cached_tokens >= 0 THEN cached_tokens END, CASE WHEN cached_input_tokens >= 0 THEN cached_input_tokens END, 0) AS c,
  coalesce(CASE WHEN prompt_tokens >= 0 THEN prompt_tokens END, CASE WHEN input_tokens >= 0 THEN input_tokens END, 0) AS p,
  output_tokens AS o FROM chat),
jud AS (SELECT task, count(DISTINCT path) AS run_count, count(*) AS record_count, CAST(sum(greatest(p - c, 0)) AS BIGINT) AS input,
  CAST(sum(c) AS BIGINT) AS cached_input, CAST(sum(o) AS BIGINT) AS output FROM judged GROUP BY ALL),
judcost AS (SELECT *, (input * {PRICES[0]} + cached_input * {PRICES[1]} + output * {PRICES[2]}) / 1e6 AS cost FROM jud)"""


def judge_records(t: Tables) -> DataFrame:
    turns = chat(t)
    usage = {**_usage(turns), "completion_tokens": F.col("output_tokens")}
    kind = F.col("path") % 3
    task = F.when(kind == 0, "pairwise").when(kind == 1, "pointwise").otherwise("native-checklist")
    return turns.select(
        task.alias("task"), F.col("path").alias("source_path"), *K.usage_columns(usage, judge=True)
    )


@query("tokens_cost_judge", f"WITH {CHAT_SQL}, {JUDGE_SQL} SELECT * {replace_sql('cost')} FROM judcost")
def tokens_cost_judge(t: Tables) -> DataFrame:
    return rounded(K.judge_cost(judge_records(t), prices(t)), "cost")


@query(
    "cost_totals",
    f"""WITH {GEN_SQL}, {JUDGE_SQL}, both_parts AS (SELECT 'generation' AS part, input, cached_input, output, cost FROM gencost
      UNION ALL SELECT 'judge', input, cached_input, output, cost FROM judcost)
    SELECT coalesce(part, 'total') AS part, CAST(sum(input) AS BIGINT) AS input, CAST(sum(cached_input) AS BIGINT) AS cached_input,
      CAST(sum(output) AS BIGINT) AS output, {r6('sum(cost)')} AS cost FROM both_parts GROUP BY ROLLUP (part)""",
)
def cost_totals(t: Tables) -> DataFrame:
    totals = K.cost_totals(generation(t), K.judge_cost(judge_records(t), prices(t)))
    return rounded(totals, "cost")


@query(
    "strict_token_usage",
    f"""WITH {CHAT_SQL}, strict AS (SELECT path, count(*) FILTER (type = 'turn.completed') AS turns,
      count(*) FILTER (type = 'turn.completed' AND path % 13 = 0 AND pos = 1) AS bad,
      sum(output_tokens) FILTER (type = 'turn.completed') AS o, sum(coalesce(reasoning_tokens, 0)) FILTER (type = 'turn.completed') AS r
      FROM chat GROUP BY path), st AS (SELECT *, CASE WHEN turns = 0 THEN 'missing' WHEN bad > 0 THEN 'malformed' ELSE 'observed' END AS status FROM strict)
    SELECT path, status, CAST(CASE WHEN status = 'observed' THEN o END AS BIGINT) AS output_tokens,
      CAST(CASE WHEN status = 'observed' THEN r END AS BIGINT) AS reasoning_output_tokens,
      CAST(CASE WHEN status = 'observed' THEN o + r END AS BIGINT) AS total_tokens FROM st""",
)
def strict_token_usage(t: Tables) -> DataFrame:
    broken = (F.col("path") % 13 == 0) & (F.col("pos") == 1)
    events = chat(t).select(
        "path", "type", F.lit(True).alias("has_usage"),
        F.when(~broken, F.col("output_tokens")).alias("output_tokens"),
        F.col("reasoning_tokens").cast("bigint").alias("reasoning_output_tokens"),
    )
    return K.strict_token_usage(events, chat(t).select("path").distinct())


@query(
    "running_budget",
    f"""WITH RECURSIVE {CHAT_SQL}, st AS (SELECT path, row_number() OVER (PARTITION BY path ORDER BY pos) AS k, output_tokens AS units FROM chat),
    fold AS (SELECT path, 0::BIGINT AS k, 0::BIGINT AS used, 0::BIGINT AS accepted FROM st WHERE k = 1
      UNION ALL SELECT f.path, f.k + 1, CASE WHEN f.used + s.units <= 150 THEN f.used + s.units ELSE f.used END,
        CASE WHEN f.used + s.units <= 150 THEN f.accepted + 1 ELSE f.accepted END
      FROM fold f JOIN st s ON s.path = f.path AND s.k = f.k + 1),
    n AS (SELECT path, count(*) AS stages FROM st GROUP BY path)
    SELECT path, stages, used, accepted, stages - accepted AS rejected FROM fold JOIN n USING (path) WHERE k = stages""",
)
def running_budget(t: Tables) -> DataFrame:
    stages = chat(t).select("path", "pos", F.col("output_tokens").alias("units"))
    return K.running_budget(stages, 150)
