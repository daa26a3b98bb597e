"""Registered streaming jobs: the events table read as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.operators import traces as R
from pairlens.plans.contract_queries import (
    CONTRACT_CHECKS,
    CONTRACT_SQL,
    TRACE_COLUMNS,
    contract_columns,
    contracts,
    reason_counts,
    reason_sql,
)
from pairlens.plans.registry import Tables, query
from pairlens.plans.trace_queries import EV_SQL, EVENT_COLUMNS, SW_SQL
from pairlens.session import scratch_path
from pairlens.streaming import jobs as J


def stream(t: Tables) -> DataFrame:
    """The events table as a file stream; the glob names the table's own files."""
    return J.read_events(t.spark, f"{t.folder}/events*.parquet", t.events.schema).withColumn(
        "ts", F.to_timestamp(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    )


TOKEN_COLUMNS = [
    "ts",
    "concat('A', CAST(1 + user_id % 7 AS VARCHAR(9))) AS condition",
    "CASE WHEN event_type = 'view' THEN 'turn.completed' ELSE 'turn.started' END AS type",
    "CAST(floor(value * 100) AS BIGINT) AS input",
    "event_id % 50 AS cached_input",
    "user_id AS output",
]


@query(
    "stream_tokens",
    "WITH e AS (SELECT "
    + ", ".join(TOKEN_COLUMNS)
    + """ FROM events) SELECT strftime(ts, '%Y-%m-%d') AS day, condition, count(*) AS turns, CAST(sum(input) AS BIGINT) AS input,
      CAST(sum(cached_input) AS BIGINT) AS cached_input, CAST(sum(output) AS BIGINT) AS output FROM e WHERE type = 'turn.completed' GROUP BY ALL""",
)
def stream_tokens(t: Tables) -> DataFrame:
    sums = J.running_tokens(stream(t).selectExpr(*TOKEN_COLUMNS), ["condition"])
    rows = J.drain(sums, scratch_path(t.spark, "tokens"), "update")
    final = J.latest(rows, ["window_start", "condition"])
    return final.withColumn("day", F.date_format("window_start", "yyyy-MM-dd")).drop("window_start")


@query(
    "stream_transitions",
    f"""WITH {EV_SQL}, {SW_SQL} SELECT coalesce(previous, 'START') AS source, to_process AS target, count(*) AS n FROM sw GROUP BY ALL""",
)
def stream_transitions(t: Tables) -> DataFrame:
    """Transitions so far; the END rows of closed runs are left to the tests."""
    rows, late = J.drain_transitions(stream(t).selectExpr(*EVENT_COLUMNS), scratch_path(t.spark, "transitions"))
    return J.settled(rows, late).filter(F.col("target") != R.END).groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_trace_quality",
    f"""WITH {EV_SQL}, p AS (SELECT run_id, ts, event_id, CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 13 = 0 THEN ts - INTERVAL 2 HOUR ELSE ts END AS seen_at,
      date_trunc('day', ts) + INTERVAL 1 HOUR AS started, date_trunc('day', ts) + INTERVAL 23 HOUR AS written FROM ev),
    q AS (SELECT *, last_value(seen_at IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_at FROM p)
    SELECT run_id, count(*) AS events, count(*) FILTER (seen_at IS NULL) AS unparseable,
      count(*) FILTER (seen_at < started - INTERVAL 60 SECOND OR seen_at > written + INTERVAL 60 SECOND) AS out_of_window,
      count(*) FILTER (seen_at < prior_at) AS non_monotonic FROM q GROUP BY run_id""",
)
def stream_trace_quality(t: Tables) -> DataFrame:
    seconds = lambda c: F.unix_micros(c) / 1e6
    shifted = F.expr("CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 13 = 0 THEN ts - INTERVAL 2 HOURS ELSE ts END")
    day = F.date_trunc("day", "ts")
    events = stream(t).selectExpr(*EVENT_COLUMNS).select(
        "run_id",
        F.col("event_id").alias("pos"),
        seconds(shifted).alias("at"),
        (seconds(day) + 3600 - 60).alias("low"),
        (seconds(day) + 23 * 3600 + 60).alias("high"),
    )
    rows = J.drain(J.stream_trace_quality(events), scratch_path(t.spark, "quality"), "update")
    return J.latest(rows, ["run_id"])


@query("stream_contract_quarantine", f"WITH {CONTRACT_SQL} " + reason_sql("tc", CONTRACT_CHECKS, "condition"))
def stream_contract_quarantine(t: Tables) -> DataFrame:
    """Event contract on a stream, valid and rejected rows in two tables."""
    folder = scratch_path(t.spark, "quarantine")
    rows = contract_columns(stream(t).selectExpr(*TRACE_COLUMNS, "hour(ts) AS bucket"))
    J.start_quarantine(rows, lambda batch: R.event_reasons(batch, contracts(t)), folder).awaitTermination()
    columns = ["condition", "reject_reasons"]
    valid = t.spark.read.parquet(f"{folder}/valid").select(*columns)
    rejected = t.spark.read.parquet(f"{folder}/rejected").select(*columns)
    return reason_counts(valid.unionByName(rejected), "condition")


@query(
    "stream_sessions",
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events),
    s AS (SELECT user_id, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM e)
    SELECT user_id AS run_id, count(DISTINCT session) AS sessions, count(*) AS events FROM s GROUP BY ALL""",
)
def stream_sessions(t: Tables) -> DataFrame:
    """Idle-gap sessions per user, the batch run of the streaming job."""
    zoned = F.to_timestamp(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    rows = J.idle_sessions(t.events.select(F.col("user_id").alias("run_id"), zoned.alias("ts")))
    return rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("events").alias("events"))
