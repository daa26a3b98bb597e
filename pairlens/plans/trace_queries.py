"""Registered queries on process traces, built from the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.functions.ordering import first_by
from pairlens.functions.stats import round6
from pairlens.operators import pairs as P
from pairlens.operators import traces as R
from pairlens.plans import views as V
from pairlens.plans.pairwise_queries import rounded
from pairlens.plans.registry import Tables, query, r6

EVENT_COLUMNS = [
    "user_id",
    "event_id",
    "ts",
    "concat(CAST(user_id AS VARCHAR(20)), '-', CAST(CAST(ts AS DATE) AS VARCHAR(20))) AS run_id",
    "user_id % 3 AS run_set",
    "CASE WHEN user_id % 2 = 0 THEN 'A4' ELSE 'A6' END AS condition",
    "CASE event_type WHEN 'signup' THEN 'goal_regenerated' ELSE 'process_switch' END AS event_type",
    "CASE WHEN event_id % 2 = 0 THEN 'reviewing' ELSE 'planning' END AS process",
    "CASE event_type WHEN 'click' THEN 'planning' WHEN 'view' THEN 'translating' WHEN 'purchase' THEN 'reviewing' END AS to_process",
    "CASE event_id % 6 WHEN 0 THEN 'Do the Planning step' WHEN 1 THEN 'start reviewing now' ELSE 'other work' END AS prompt",
]
ATTRS = ["run_set", "condition"]


def trace(t: Tables) -> DataFrame:
    """Runs are a user and a day; the bucket inside a run is the hour."""
    return t.events.selectExpr(*EVENT_COLUMNS, "hour(ts) AS bucket")


def week_trace(t: Tables) -> DataFrame:
    """Runs are a user and a week; the bucket inside a run is the day."""
    week = F.floor(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) / 7)
    return (
        t.events.selectExpr(*EVENT_COLUMNS)
        .withColumn("run_id", F.concat_ws("-w", F.col("user_id"), week.cast("bigint")))
        .withColumn("bucket", F.col("ts").cast("date"))
    )


def delegated(t: Tables) -> DataFrame:
    events = trace(t).filter(F.col("event_type") == R.REGENERATION)
    return R.first_delegated(
        events.select(
            "run_id", "prompt", F.col("ts").alias("file"), F.col("event_id").alias("line"),
            F.lit("item.started").alias("type"), F.lit("collab_tool_call").alias("item_type"), F.lit("spawn_agent").alias("tool"),
        )
    )


EV_SQL = "ev AS (SELECT " + ", ".join(EVENT_COLUMNS) + " FROM events)"
WEEK_SQL = (
    "ev AS (SELECT * REPLACE (concat(CAST(user_id AS VARCHAR), '-w', CAST(CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 7) AS BIGINT) AS VARCHAR)) AS run_id) FROM (SELECT "
    + ", ".join(EVENT_COLUMNS)
    + " FROM events))"
)
SW_SQL = """sw AS (SELECT *, lag(to_process) OVER w AS previous, row_number() OVER w AS place FROM ev
  WHERE event_type = 'process_switch' AND to_process IS NOT NULL WINDOW w AS (PARTITION BY run_id ORDER BY ts, event_id)),
ends AS (SELECT run_id, any_value(run_set) AS run_set, any_value(condition) AS condition,
  arg_max(to_process, (ts, event_id)) FILTER (to_process IS NOT NULL) AS last_target,
  count(*) FILTER (event_type = 'goal_regenerated') AS regenerations, count(*) AS events FROM ev GROUP BY run_id)"""
TR_SQL = """steps AS (SELECT run_id, run_set, condition, coalesce(previous, 'START') AS source, to_process AS target FROM sw
  UNION ALL SELECT run_id, run_set, condition, coalesce(last_target, 'START'), 'END' FROM ends)"""
DET_SQL = f"""{EV_SQL}, {SW_SQL}, dele AS (SELECT run_id, arg_min(lower(regexp_extract(prompt, '(?i)\\b(planning|translating|reviewing)\\b', 1)), (ts, event_id)) AS first_delegated
  FROM ev WHERE event_type = 'goal_regenerated' AND regexp_matches(prompt, '(?i)\\b(planning|translating|reviewing)\\b') GROUP BY run_id),
seqs AS (SELECT run_id, list(to_process ORDER BY ts, event_id) AS s, count(*) FILTER (previous = 'reviewing' AND to_process = 'translating') AS returns FROM sw GROUP BY run_id),
lead_in AS (SELECT e.*, coalesce(s, []) AS s, coalesce(returns, 0) AS returns, first_delegated,
  coalesce(first_delegated = 'planning' AND len(s) > 0 AND s[1] <> 'planning', false) AS reconstructed
  FROM ends e LEFT JOIN seqs USING (run_id) LEFT JOIN dele USING (run_id)),
full_seq AS (SELECT *, CASE WHEN reconstructed THEN list_concat(['planning'], s) ELSE s END AS f FROM lead_in),
coll AS (SELECT *, list_filter(f, lambda x, i: i = 1 OR x <> f[i - 1]) AS c FROM full_seq),
det AS (SELECT *, len(c) > 0 AND len(c) % 3 = 0 AND len(list_filter(c, lambda x, i: x <> ['planning', 'translating', 'reviewing'][(i - 1) % 3 + 1])) = 0 AS cycle_compliant,
  f = ['planning', 'translating', 'reviewing'] AS single_cycle_exact,
  c = ['planning', 'translating', 'reviewing'] AND
    (CASE WHEN len(list_filter(f, lambda x: x = 'planning')) > 1 THEN 1 ELSE 0 END + CASE WHEN len(list_filter(f, lambda x: x = 'translating')) > 1 THEN 1 ELSE 0 END
     + CASE WHEN len(list_filter(f, lambda x: x = 'reviewing')) > 1 THEN 1 ELSE 0 END) <= 1 AS single_repeat FROM coll)"""


def details(t: Tables) -> DataFrame:
    return R.run_details(trace(t), ATTRS, delegated(t))


BLOCK_SQL = f"""sb AS (SELECT run_id, CAST((place - 1) // {R.SEQUENCE_BLOCK} AS BIGINT) AS block, string_agg(to_process, '>' ORDER BY place) AS sequence FROM sw GROUP BY ALL)"""


@query(
    "process_sequence",
    f"""WITH {EV_SQL}, {SW_SQL}, {BLOCK_SQL}, n AS (SELECT run_id, count(*) AS length FROM sw GROUP BY run_id)
    SELECT run_id, coalesce(length, 0) AS length, coalesce(block, 0) AS block, coalesce(sequence, '') AS sequence FROM ends LEFT JOIN n USING (run_id) LEFT JOIN sb USING (run_id)""",
)
def process_sequence(t: Tables) -> DataFrame:
    return R.process_sequences(trace(t))


@query(
    "transitions",
    f"WITH {WEEK_SQL}, {SW_SQL}, {TR_SQL} SELECT run_set, condition, source, target, count(*) AS n FROM steps GROUP BY ALL",
)
def transitions(t: Tables) -> DataFrame:
    return R.transitions(week_trace(t), ATTRS)


@query(
    "lag_transition",
    f"WITH {WEEK_SQL}, {SW_SQL} SELECT run_id, event_id, place, previous, to_process FROM sw",
)
def lag_transition(t: Tables) -> DataFrame:
    return R.ordered_switches(week_trace(t)).select("run_id", "event_id", "place", "previous", "to_process")


@query(
    "after_state",
    f"""WITH {WEEK_SQL}, {SW_SQL}, f AS (SELECT condition, run_id, to_process AS next FROM sw WHERE previous = 'reviewing'
      UNION ALL SELECT condition, run_id, 'termination' FROM ends WHERE last_target = 'reviewing')
    SELECT condition, next, count(*) AS events, count(DISTINCT run_id) AS runs FROM f GROUP BY ALL""",
)
def after_state(t: Tables) -> DataFrame:
    return R.after_state(week_trace(t), ["condition"])


@query(
    "collapse_repeats",
    f"""WITH {WEEK_SQL}, {SW_SQL} SELECT run_id, count(*) AS switches, count(*) FILTER (previous IS NULL OR previous <> to_process) AS steps
    FROM sw GROUP BY run_id""",
)
def collapse_repeats(t: Tables) -> DataFrame:
    return R.ordered_switches(week_trace(t)).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("switches"), F.count_if("changed").alias("steps")
    )


@query(
    "cycle_passes",
    f"""WITH {DET_SQL} SELECT run_id, CAST(cycle_compliant AS INTEGER) AS cycle_compliant,
      CASE WHEN cycle_compliant THEN CAST(len(c) // 3 AS BIGINT) END AS cycle_passes FROM det""",
)
def cycle_passes(t: Tables) -> DataFrame:
    return details(t).select("run_id", F.col("cycle_compliant").cast("int").alias("cycle_compliant"), "cycle_passes")


@query(
    "exact_cycle",
    f"""WITH {DET_SQL} SELECT run_id, CAST(single_cycle_exact AS INTEGER) AS single_cycle_exact, CAST(single_repeat AS INTEGER) AS single_repeat FROM det""",
)
def exact_cycle(t: Tables) -> DataFrame:
    return details(t).select(
        "run_id", *[F.col(c).cast("int").alias(c) for c in ("single_cycle_exact", "single_repeat")]
    )


@query(
    "lead_reconstruction",
    f"""WITH {DET_SQL} SELECT condition, coalesce(first_delegated, 'none') AS first_delegated, count(*) AS runs,
      count(*) FILTER (len(s) > 0 AND s[1] <> 'planning') AS late_starts, count(*) FILTER (reconstructed) AS reconstructed,
      count(*) FILTER (len(s) > 0 AND s[1] <> 'planning' AND NOT reconstructed) AS real_deviations FROM det GROUP BY ALL""",
)
def lead_reconstruction(t: Tables) -> DataFrame:
    late = F.col("first_target").isNotNull() & (F.col("first_target") != R.FIXED_ORDER[0])
    return details(t).groupBy("condition", F.coalesce("first_delegated", F.lit("none")).alias("first_delegated")).agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(late).alias("late_starts"),
        F.count_if("reconstructed").alias("reconstructed"),
        F.count_if(late & ~F.col("reconstructed")).alias("real_deviations"),
    )


@query(
    "regeneration_locations",
    f"""WITH {WEEK_SQL}, a AS (SELECT *, last_value(to_process IGNORE NULLS) OVER w AS active, count(to_process) OVER w AS idx FROM ev
      WINDOW w AS (PARTITION BY run_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT process AS event_process, coalesce(active, process) AS active_process, CASE WHEN idx > 0 THEN idx END AS sequence_index, count(*) AS n
    FROM a WHERE event_type = 'goal_regenerated' GROUP BY ALL""",
)
def regeneration_locations(t: Tables) -> DataFrame:
    return (
        R.regeneration_locations(week_trace(t))
        .groupBy("event_process", "active_process", "sequence_index")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "event_counters",
    f"""WITH {EV_SQL} SELECT 'event_type' AS cut, event_type, NULL AS process, count(*) AS n FROM ev GROUP BY ALL
    UNION ALL SELECT 'process', NULL, process, count(*) FROM ev GROUP BY ALL
    UNION ALL SELECT 'both', event_type, process, count(*) FROM ev GROUP BY ALL""",
)
def event_counters(t: Tables) -> DataFrame:
    return R.event_counters(trace(t))


DIST_SQL = f"""{EV_SQL}, {SW_SQL}, s AS (SELECT run_id, string_agg(to_process, '>' ORDER BY ts, event_id) AS sequence, count(*) AS length FROM sw GROUP BY run_id),
dist AS (SELECT condition, coalesce(length, 0) AS length, coalesce(sequence, '') AS sequence, count(*) AS n FROM ends LEFT JOIN s USING (run_id) GROUP BY ALL),
rated AS (SELECT *, CAST(sum(n) OVER (PARTITION BY condition) AS BIGINT) AS total, n / CAST(sum(n) OVER (PARTITION BY condition) AS DOUBLE) AS rate FROM dist)"""


def distribution(t: Tables) -> DataFrame:
    return R.sequence_distribution(trace(t), ["condition"])


#: The blocks of a sequence given as a list of its targets.
CUT_SQL = f"""[struct_pack(block := CAST(i AS BIGINT), sequence := array_to_string(s[i * {R.SEQUENCE_BLOCK} + 1:(i + 1) * {R.SEQUENCE_BLOCK}], '>')) FOR i IN range(0, greatest(1, (len(s) + {R.SEQUENCE_BLOCK - 1}) // {R.SEQUENCE_BLOCK}))]"""
WHOLE_SQL = f"""{DIST_SQL}, cut AS (SELECT *, unnest({CUT_SQL}) AS b FROM (SELECT *, CASE WHEN length = 0 THEN [] ELSE string_split(sequence, '>') END AS s FROM {{source}}))"""


@query(
    "sequence_distribution",
    f"""WITH {WHOLE_SQL.replace('{source}', 'rated')} SELECT condition, length, b.block AS block, b.sequence AS sequence, n, total, {r6('rate')} AS rate FROM cut""",
)
def sequence_distribution(t: Tables) -> DataFrame:
    return rounded(distribution(t), "rate")


@query(
    "length_distribution",
    f"""WITH {DIST_SQL} SELECT condition, length, CAST(sum(n) AS BIGINT) AS n, any_value(total) AS total, {r6('sum(n) / any_value(total)')} AS rate FROM rated GROUP BY condition, length""",
)
def length_distribution(t: Tables) -> DataFrame:
    counts = R.sequence_lengths(trace(t), ATTRS).groupBy("condition", "length").agg(F.count(F.lit(1)).alias("n"))
    return rounded(R.with_rate(counts, ["condition"]), "rate")


@query(
    "pass_distribution",
    f"""WITH {DET_SQL} SELECT condition, CAST(len(c) // 3 AS BIGINT) AS cycle_passes, count(*) AS n FROM det WHERE cycle_compliant GROUP BY ALL""",
)
def pass_distribution(t: Tables) -> DataFrame:
    return details(t).filter("cycle_compliant").groupBy("condition", "cycle_passes").agg(F.count(F.lit(1)).alias("n"))


@query(
    "top_sequences",
    f"""WITH {WHOLE_SQL.replace('{source}', 'ranked').replace(', cut AS', ", ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY condition ORDER BY n DESC, length, sequence) AS INTEGER) AS rank FROM rated QUALIFY rank <= 5), cut AS")}
    SELECT condition, length, b.block AS block, b.sequence AS sequence, n, total, {r6('rate')} AS rate, rank FROM cut""",
)
def top_sequences(t: Tables) -> DataFrame:
    return rounded(R.top_sequences(trace(t), ["condition"]), "rate")


@query(
    "transition_matrix",
    f"""WITH {WEEK_SQL}, {SW_SQL}, {TR_SQL}, st AS (SELECT * FROM (VALUES ('START'), ('planning'), ('translating'), ('reviewing'), ('END')) x(s)),
    counts AS (SELECT condition, source, target, count(*) AS n FROM steps GROUP BY ALL)
    SELECT c.condition, a.s AS source, b.s AS target, coalesce(n, 0) AS n FROM (SELECT DISTINCT condition FROM ev) c, st a, st b
    LEFT JOIN counts k ON k.condition = c.condition AND k.source = a.s AND k.target = b.s""",
)
def transition_matrix(t: Tables) -> DataFrame:
    return R.transition_matrix(R.transitions(week_trace(t), ["condition"]), ["condition"])


SUMMARY_RATES = ("compliance_rate", "exact_rate", "return_rate", "regeneration_rate", "no_loop_rate")


@query(
    "trace_summary",
    f"""WITH {DET_SQL} SELECT coalesce(CAST(run_set AS VARCHAR), 'pooled') AS run_set, condition, count(*) AS run_count,
      count(*) FILTER (cycle_compliant) AS compliant_runs, count(*) FILTER (single_cycle_exact) AS exact_runs,
      count(*) FILTER (single_repeat) AS single_repeat_runs, count(*) FILTER (reconstructed) AS reconstructed_runs,
      count(*) FILTER (returns > 0) AS return_runs, count(*) FILTER (regenerations > 0) AS regeneration_runs,
      CAST(sum(regenerations) AS BIGINT) AS regeneration_events, {r6('avg(CAST(cycle_compliant AS INT))')} AS compliance_rate,
      {r6('avg(CAST(single_cycle_exact AS INT))')} AS exact_rate, {r6('avg(CAST(returns > 0 AS INT))')} AS return_rate,
      {r6('avg(CAST(regenerations > 0 AS INT))')} AS regeneration_rate, {r6('avg(CAST(returns = 0 AND regenerations = 0 AS INT))')} AS no_loop_rate
    FROM det GROUP BY GROUPING SETS ((run_set, condition), (condition))""",
)
def trace_summary(t: Tables) -> DataFrame:
    return rounded(R.trace_summary(details(t)), *SUMMARY_RATES)


@query(
    "no_loop_rate",
    f"""WITH {DET_SQL} SELECT condition, count(*) AS runs, {r6('avg(CAST(returns = 0 AND regenerations = 0 AS INT))')} AS no_loop_rate FROM det GROUP BY ALL""",
)
def no_loop_rate(t: Tables) -> DataFrame:
    summary = R.trace_summary(details(t)).filter("run_set = 'pooled'")
    return rounded(summary.select("condition", F.col("run_count").alias("runs"), "no_loop_rate"), "no_loop_rate")


@query(
    "timestamp_plausibility",
    f"""WITH {EV_SQL}, p AS (SELECT run_id, ts, event_id, CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 13 = 0 THEN ts - INTERVAL 2 HOUR ELSE ts END AS seen_at,
      date_trunc('day', ts) + INTERVAL 1 HOUR AS started, date_trunc('day', ts) + INTERVAL 23 HOUR AS written FROM ev),
    q AS (SELECT *, last_value(seen_at IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_at FROM p),
    r AS (SELECT run_id, count(*) AS events, count(*) FILTER (seen_at IS NULL) AS unparseable,
      count(*) FILTER (seen_at < started - INTERVAL 60 SECOND OR seen_at > written + INTERVAL 60 SECOND) AS out_of_window,
      count(*) FILTER (seen_at < prior_at) AS non_monotonic FROM q GROUP BY run_id)
    SELECT *, CAST(unparseable + out_of_window + non_monotonic = 0 AS INTEGER) AS plausible FROM r""",
)
def timestamp_plausibility(t: Tables) -> DataFrame:
    shown = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    kind = F.col("event_id")
    shifted = F.expr("CASE WHEN event_id % 13 = 0 THEN ts - INTERVAL 2 HOURS ELSE ts END")
    events = trace(t).select(
        "run_id",
        "bucket",
        F.struct("ts", "event_id").alias("pos"),
        F.when(kind % 17 == 0, shown("ts")).otherwise(F.concat(shown(shifted), F.lit("+00:00"))).alias("timestamp"),
    )
    day = F.substring("run_id", -10, 10)
    runs = trace(t).select("run_id").distinct().select(
        "run_id",
        F.concat(day, F.lit("T01:00:00+00:00")).alias("started_at"),
        F.concat(day, F.lit("T23:00:00+00:00")).alias("written_at"),
    )
    return R.timestamp_plausibility(events, runs).withColumn("plausible", F.col("plausible").cast("int"))


# --- verdicts beside traces ------------------------------------------------------

TRACED_SQL = f"""{V.PROMPT_SQL}, {DET_SQL}, attempts AS (SELECT *, 'p' || CAST(CAST(split_part(run_id, '-', 1) AS BIGINT) * 13 + CAST(right(run_id, 2) AS BIGINT) % 13 AS VARCHAR) AS prompt FROM det),
latest AS (SELECT * FROM attempts QUALIFY row_number() OVER (PARTITION BY prompt ORDER BY run_id DESC) = 1),
both_of AS (SELECT v.*, single_cycle_exact, returns, regenerations, len(s) AS sequence_length FROM prompt_verdicts v JOIN latest USING (prompt))"""


def traced_verdicts(t: Tables) -> DataFrame:
    """Prompt verdicts with the latest trace of the prompt."""
    day = F.substring("run_id", -2, 2).cast("bigint")
    user = F.split("run_id", "-")[0].cast("bigint")
    attempts = details(t).withColumn(
        "prompt", F.concat(F.lit("p"), (user * 13 + day % 13).cast("string"))
    )
    latest = first_by(
        attempts, ["prompt"], ["run_id"],
        ["single_cycle_exact", "returns", "regenerations", "sequence_length"], last=True,
    )
    return R.verdicts_with_trace(P.prompt_verdicts(V.verdicts(t)), latest, ["prompt"])


@query(
    "join_verdict_trace",
    f"""WITH {TRACED_SQL} SELECT benchmark, right_condition, verdict, CAST(single_cycle_exact AS INTEGER) AS exact, count(*) AS n,
      CAST(sum(sequence_length) AS BIGINT) AS switches FROM both_of GROUP BY ALL""",
)
def join_verdict_trace(t: Tables) -> DataFrame:
    return traced_verdicts(t).groupBy(
        "benchmark", "right_condition", "verdict", F.col("single_cycle_exact").cast("int").alias("exact")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum("sequence_length").alias("switches"))


def fisher_sql(a: str, b: str, c: str, d: str) -> str:
    lf = lambda x: f"lgamma({x} + 1)"
    choose = lambda n, k: f"({lf(n)} - {lf(k)} - {lf(f'({n} - {k})')})"
    r1, r2, c1, n = f"({a} + {b})", f"({c} + {d})", f"({a} + {c})", f"({a} + {b} + {c} + {d})"
    mass = lambda x: f"exp({choose(r1, x)} + {choose(r2, f'({c1} - {x})')} - {choose(n, c1)})"
    return (
        f"(CASE WHEN {n} = 0 THEN 1.0 ELSE least(1.0, list_sum(list_filter([{mass('x')} FOR x IN range(greatest(0, {c1} - {r2}), least({r1}, {c1}) + 1)],"
        f" lambda p: p <= {mass(a)} + 1e-12))) END)"
    )


ASSOC_SQL = f"""{TRACED_SQL}, placed AS (SELECT platform AS run_set, * FROM both_of UNION ALL SELECT 'pooled', * FROM both_of),
assoc AS (SELECT run_set, right_condition, count(*) FILTER (verdict = 'left' AND single_cycle_exact) AS wins_exact,
  count(*) FILTER (verdict = 'right' AND single_cycle_exact) AS losses_exact, count(*) FILTER (verdict = 'tie' AND single_cycle_exact) AS ties_exact,
  count(*) FILTER (verdict = 'left' AND NOT single_cycle_exact) AS wins_other, count(*) FILTER (verdict = 'right' AND NOT single_cycle_exact) AS losses_other,
  count(*) FILTER (verdict = 'tie' AND NOT single_cycle_exact) AS ties_other FROM placed GROUP BY ALL)"""
ASSOC_RATES = [f"{n}_{p}" for p in ("exact", "other") for n in ("win_rate", "wilson_low", "wilson_high")]


@query(
    "cycle_association",
    f"""WITH {ASSOC_SQL} SELECT *, {', '.join(f"{r6(V.rate_sql(f'wins_{p}', f'losses_{p}'))} AS win_rate_{p}, {r6(V.wilson_sql(f'wins_{p}', f'losses_{p}', 'low'))} AS wilson_low_{p}, {r6(V.wilson_sql(f'wins_{p}', f'losses_{p}', 'high'))} AS wilson_high_{p}" for p in ('exact', 'other'))},
      {r6(fisher_sql('wins_exact', 'losses_exact', 'wins_other', 'losses_other'))} AS fisher_p FROM assoc""",
)
def cycle_association(t: Tables) -> DataFrame:
    return rounded(R.cycle_association(traced_verdicts(t), ["right_condition"], "platform"), *ASSOC_RATES, "fisher_p")


@query(
    "fisher_exact",
    f"""WITH {TRACED_SQL}, tab AS (SELECT benchmark, right_condition, count(*) FILTER (verdict = 'left' AND regenerations > 0) AS a,
      count(*) FILTER (verdict = 'right' AND regenerations > 0) AS b, count(*) FILTER (verdict = 'left' AND regenerations = 0) AS c,
      count(*) FILTER (verdict = 'right' AND regenerations = 0) AS d FROM both_of GROUP BY ALL)
    SELECT *, {r6(fisher_sql('a', 'b', 'c', 'd'))} AS p FROM tab""",
)
def fisher_exact(t: Tables) -> DataFrame:
    again = F.col("regenerations") > 0
    won, lost = F.col("verdict") == "left", F.col("verdict") == "right"
    table = traced_verdicts(t).groupBy("benchmark", "right_condition").agg(
        F.count_if(won & again).alias("a"),
        F.count_if(lost & again).alias("b"),
        F.count_if(won & ~again).alias("c"),
        F.count_if(lost & ~again).alias("d"),
    )
    return table.withColumn("p", round6(R.fisher_exact_p(*[F.col(x) for x in "abcd"])))


@query(
    "process_quality_corr",
    f"""WITH {TRACED_SQL}, pr AS (SELECT prompt, judge_id, avg(CASE verdict WHEN 'left' THEN 1.0 WHEN 'right' THEN 0.0 ELSE 0.5 END) AS quality FROM verdicts GROUP BY ALL)
    SELECT judge_id, count(*) AS n, {r6('corr(len(s), quality)')} AS length_corr, {r6('corr(regenerations, quality)')} AS regeneration_corr
    FROM pr JOIN latest USING (prompt) GROUP BY ALL""",
)
def process_quality_corr(t: Tables) -> DataFrame:
    score = F.when(F.col("verdict") == "left", 1.0).when(F.col("verdict") == "right", 0.0).otherwise(0.5)
    quality = V.verdicts(t).groupBy("prompt", "judge_id").agg(F.avg(score).alias("quality"))
    day = F.substring("run_id", -2, 2).cast("bigint")
    user = F.split("run_id", "-")[0].cast("bigint")
    attempts = details(t).withColumn("prompt", F.concat(F.lit("p"), (user * 13 + day % 13).cast("string")))
    latest = first_by(attempts, ["prompt"], ["run_id"], ["sequence_length", "regenerations"], last=True)
    joined = R.verdicts_with_trace(quality, latest, ["prompt"])
    return joined.groupBy("judge_id").agg(
        F.count(F.lit(1)).alias("n"),
        round6(F.corr(F.col("sequence_length").cast("double"), F.col("quality"))).alias("length_corr"),
        round6(F.corr(F.col("regenerations").cast("double"), F.col("quality"))).alias("regeneration_corr"),
    )


# --- protocol measures -------------------------------------------------------------


@query(
    "process_entropy",
    f"""WITH {WEEK_SQL}, {SW_SQL}, {TR_SQL}, c AS (SELECT condition, source, target, count(*) AS n FROM steps GROUP BY ALL),
    p AS (SELECT condition, n / sum(n) OVER (PARTITION BY condition) AS p FROM c),
    e AS (SELECT condition, -sum(p * log2(p)) AS entropy, count(*) AS states FROM p GROUP BY ALL)
    SELECT condition, {r6('entropy')} AS entropy, states, {r6('entropy / log2(states)')} AS normalised FROM e""",
)
def process_entropy(t: Tables) -> DataFrame:
    counts = R.transitions(week_trace(t), ["condition"])
    return rounded(R.process_entropy(counts, ["condition"]), "entropy", "normalised")


@query(
    "sequence_entropy",
    f"""WITH {DIST_SQL}, e AS (SELECT condition, -sum(rate * log2(rate)) AS entropy, count(*) AS states FROM rated GROUP BY ALL)
    SELECT condition, {r6('entropy')} AS entropy, states, {r6('entropy / log2(states)')} AS normalised FROM e""",
)
def sequence_entropy(t: Tables) -> DataFrame:
    counts = distribution(t).drop("total", "rate")
    return rounded(R.process_entropy(counts, ["condition"]), "entropy", "normalised")


@query(
    "transition_rate_per_run",
    f"""WITH {WEEK_SQL}, {SW_SQL}, {TR_SQL}, c AS (SELECT run_id, source, target, count(*) AS n FROM steps GROUP BY ALL)
    SELECT run_id, source, target, n, CAST(sum(n) OVER (PARTITION BY run_id) AS BIGINT) AS total,
      {r6('n / CAST(sum(n) OVER (PARTITION BY run_id) AS DOUBLE)')} AS rate FROM c""",
)
def transition_rate_per_run(t: Tables) -> DataFrame:
    counts = R.transitions(week_trace(t), ["run_id"])
    return rounded(R.with_rate(counts, ["run_id"]), "rate")


GOAL_COLUMNS = [
    "concat(CAST(user_id AS VARCHAR(20)), '-', CAST(CAST(ts AS DATE) AS VARCHAR(20))) AS run_id",
    "ts",
    "event_id",
    "CASE event_type WHEN 'signup' THEN 'goal_regenerated' WHEN 'click' THEN 'goal_created' WHEN 'view' THEN 'goal_developed' ELSE 'process_switch' END AS event_type",
    "CAST(event_id % 20 AS VARCHAR(9)) AS goal_id",
    "CASE WHEN event_id % 20 > 0 THEN CAST(CAST(floor((event_id % 20) / 2) AS BIGINT) AS VARCHAR(9)) END AS parent_goal_id",
]
GOAL_SQL = "goals AS (SELECT " + ", ".join(GOAL_COLUMNS) + " FROM events)"


def goals(t: Tables) -> DataFrame:
    return t.events.selectExpr(*GOAL_COLUMNS, "hour(ts) AS bucket")


@query(
    "goal_counts",
    f"""WITH {GOAL_SQL} SELECT run_id, count(*) FILTER (event_type = 'goal_created') AS goal_created, count(*) FILTER (event_type = 'goal_developed') AS goal_developed,
      count(*) FILTER (event_type = 'goal_regenerated') AS goal_regenerated,
      count(DISTINCT CASE WHEN event_type <> 'process_switch' THEN goal_id END) AS goal_ids FROM goals GROUP BY ALL""",
)
def goal_counts(t: Tables) -> DataFrame:
    return R.goal_counts(goals(t))


@query(
    "goal_pop_backs",
    f"""WITH {GOAL_SQL}, l AS (SELECT *, lag(parent_goal_id) OVER (PARTITION BY run_id ORDER BY ts, event_id) AS before FROM goals),
    p AS (SELECT run_id, count(*) FILTER (goal_id = before) AS pop_backs FROM l GROUP BY run_id),
    u AS (SELECT run_id, count(*) AS u FROM (SELECT run_id, parent_goal_id FROM goals WHERE parent_goal_id IS NOT NULL
      EXCEPT SELECT run_id, goal_id FROM goals) GROUP BY run_id)
    SELECT run_id, pop_backs, coalesce(u, 0) AS unresolved_parents FROM p LEFT JOIN u USING (run_id)""",
)
def goal_pop_backs(t: Tables) -> DataFrame:
    return R.goal_pop_backs(goals(t))


@query(
    "within_process_ops",
    f"""WITH {GOAL_SQL} SELECT run_id, event_type, count(*) AS n FROM goals WHERE event_type <> 'process_switch' GROUP BY ALL""",
)
def within_process_ops(t: Tables) -> DataFrame:
    return goals(t).filter(F.col("event_type") != R.SWITCH).groupBy("run_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


RUN_COLUMNS = [
    "concat(CAST(user_id AS VARCHAR(20)), '-', CAST(CAST(ts AS DATE) AS VARCHAR(20))) AS run_id",
    "ts",
    "CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS spawn",
    "CAST(floor(value * 10) AS BIGINT) AS tokens",
    "CASE WHEN event_type = 'purchase' THEN event_id % 50 END AS units",
]
PROFILE_MEANS = ["events", "sequence_length", "regenerations", *R.GOAL_EVENTS, "spawns", "tokens", "seconds"]
PROFILE_MEDIANS = ["events", "output_units"]


@query(
    "process_profile",
    f"""WITH {DET_SQL}, {GOAL_SQL}, g AS (SELECT run_id, {', '.join(f"count(*) FILTER (event_type = '{e}') AS {e}" for e in R.GOAL_EVENTS)} FROM goals GROUP BY run_id),
    m AS (SELECT run_id, sum(spawn) AS spawns, sum(tokens) AS tokens, sum(units) AS output_units, date_diff('microsecond', min(ts), max(ts)) / 1e6 AS seconds
      FROM (SELECT {', '.join(RUN_COLUMNS)} FROM events) GROUP BY run_id),
    runs AS (SELECT run_id, condition, events, len(s) AS sequence_length, regenerations, g.* EXCLUDE (run_id), m.* EXCLUDE (run_id) FROM det JOIN g USING (run_id) JOIN m USING (run_id))
    SELECT condition, count(*) AS runs, {', '.join(f"{r6(f'avg({c})')} AS mean_{c}" for c in PROFILE_MEANS)}, {', '.join(f"{r6(f'quantile_cont({c}, 0.5)')} AS median_{c}" for c in PROFILE_MEDIANS)}
    FROM runs GROUP BY condition""",
)
def process_profile(t: Tables) -> DataFrame:
    """Goal events by type, output units, spawns, tokens and seconds of the runs of each condition."""
    recorded = t.events.selectExpr(*RUN_COLUMNS).groupBy("run_id").agg(
        F.sum("spawn").alias("spawns"),
        F.sum("tokens").alias("tokens"),
        F.sum("units").alias("output_units"),
        (F.expr("timestampdiff(MICROSECOND, min(ts), max(ts))") / 1e6).alias("seconds"),
    )
    runs = details(t).join(R.goal_counts(goals(t)), "run_id").join(recorded, "run_id")
    report = R.process_profile(runs, ["condition"], PROFILE_MEANS, PROFILE_MEDIANS)
    return rounded(report, *[f"mean_{c}" for c in PROFILE_MEANS], *[f"median_{c}" for c in PROFILE_MEDIANS])
