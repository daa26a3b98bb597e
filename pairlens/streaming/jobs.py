"""Structured Streaming jobs over append-only event files, each with a batch twin.

Checkpoints and outputs live below the folder the caller names, which must be
shared by all executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pairlens.operators.cost import PRICE_KEYS
from pairlens.operators.traces import END, START, SWITCH, ordered_switches

LATENESS = "1 day"
IDLE_MS = 24 * 3600 * 1000


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """Event files as a stream; a batch takes a bounded number of files."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )


def running_tokens(events: DataFrame, keys: list[str], window: str = "1 day") -> DataFrame:
    """Running token sums per key and time window of completed turns.

    No watermark: state is one row per window and key, and late turns count.
    """
    done = events.filter(F.col("type") == "turn.completed")
    return done.groupBy(F.window("ts", window).alias("window"), *keys).agg(
        F.count(F.lit(1)).alias("turns"), *[F.sum(k).alias(k) for k in PRICE_KEYS]
    ).select(F.col("window.start").alias("window_start"), *keys, "turns", *PRICE_KEYS)


#: Groups of a stateful job. A call of Python costs milliseconds, so a group is a share of all runs, worked as columns.
GROUPS = 4096


def _grouped(events: DataFrame) -> GroupedData:
    """Events by the hash of their run."""
    return events.withColumn("_group", F.pmod(F.xxhash64("run_id"), F.lit(GROUPS)).cast("int")).groupBy("_group")


def _coded(rows: pd.DataFrame) -> tuple[pd.DataFrame, list]:
    """Rows with ``_run``, the place of their run in the returned list of runs; null is a run as well."""
    codes, runs = pd.factorize(rows["run_id"].astype(object), use_na_sentinel=False)
    return rows.assign(_run=codes), [None if pd.isna(r) else r for r in runs]


TRANSITION_SCHEMA = "run_id string, source string, target string, ts timestamp, event_id bigint"
STATE_SCHEMA = "runs array<string>, last array<string>, until array<bigint>"


def _run_transitions(
    key: tuple, frames: Iterator[pd.DataFrame], state: GroupState
) -> Iterator[pd.DataFrame]:
    """Transitions of the new switches of a group of runs; END for each run that has gone idle."""
    held = {run: (last, until) for run, last, until in zip(*state.get, strict=True)} if state.exists else {}
    floor = state.getCurrentWatermarkMs()
    fresh, out = {}, None
    if not state.hasTimedOut:
        rows, runs = _coded(pd.concat(list(frames), ignore_index=True).sort_values(["ts", "event_id"]))
        named = rows[(rows["event_type"] == SWITCH) & rows["to_process"].notna()]
        last = [held[run][0] if run in held else None for run in runs]
        earlier = [last[c] or START for c in named["_run"]]
        source = named.groupby("_run")["to_process"].shift().combine_first(pd.Series(earlier, index=named.index, dtype=object))
        for code, name in named.groupby("_run")["to_process"].last().items():
            last[code] = name
        latest = rows.groupby("_run")["ts"].max()
        for code, at in latest.items():
            seen = floor if pd.isna(at) else max(int(at.timestamp() * 1000), floor)
            fresh[runs[code]] = (last[code], seen + IDLE_MS)
        if len(named):
            out = pd.DataFrame(
                {"run_id": named["run_id"], "source": source, "target": named["to_process"], "ts": named["ts"], "event_id": named["event_id"]}
            )
    # a run with new events is not idle, whatever its time was
    idle = {run: last for run, (last, until) in held.items() if run not in fresh and until < floor}
    held = {run: kept for run, kept in held.items() if run not in idle} | fresh
    if held:
        state.update(tuple(map(list, zip(*((run, last, until) for run, (last, until) in held.items()), strict=True))))
        state.setTimeoutTimestamp(max(min(until for _, until in held.values()), floor + 1))
    else:
        state.remove()
    if out is not None:
        yield out
    if idle:
        end = {"run_id": list(idle), "source": [last or START for last in idle.values()], "target": END}
        yield pd.DataFrame({**end, "ts": pd.to_datetime([None] * len(idle)), "event_id": pd.array([None] * len(idle), "Int64")})


def stream_transitions(trace: DataFrame) -> DataFrame:
    """Transition rows as they happen; END follows when a run stays silent.

    The source is the switch seen last, and switches behind the watermark are
    missing; ``drain_transitions`` keeps those and ``settled`` puts both right.
    State is one name and time per open run, in ``GROUPS`` groups. A batch hands
    a group's new events to one call, so the number of files per trigger bounds
    what a call holds.
    """
    events = trace.withWatermark("ts", LATENESS).select("run_id", "ts", "event_id", "event_type", "to_process")
    return _grouped(events).applyInPandasWithState(
        _run_transitions,
        TRANSITION_SCHEMA,
        STATE_SCHEMA,
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


PLACED = ["run_id", "ts", "event_id", "to_process"]


def named_switches(trace: DataFrame) -> DataFrame:
    return trace.filter((F.col("event_type") == SWITCH) & F.col("to_process").isNotNull()).select(
        "run_id", "ts", F.col("event_id").cast("bigint").alias("event_id"), "to_process"
    )


def drain_transitions(trace: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Transition rows of the stream, and the side table of the switches that came too late for it.

    A second stream without state writes every switch; what the first has not
    written is late, and is written below ``late``.
    """
    rows = drain(stream_transitions(trace), f"{folder}/live", "append")
    every = drain(named_switches(trace), f"{folder}/switches", "append")
    taken = rows.filter(F.col("target") != END).withColumnRenamed("target", "to_process")
    every.select(*PLACED).exceptAll(taken.select(*PLACED)).write.mode("overwrite").parquet(f"{folder}/late")
    return rows, trace.sparkSession.read.parquet(f"{folder}/late")


def settled(rows: DataFrame, late: DataFrame) -> DataFrame:
    """(run_id, source, target) in the order of the events, however they came; one END per closed run."""
    taken = rows.filter(F.col("target") != END).withColumnRenamed("target", "to_process")
    switches = taken.select(*PLACED).unionByName(late.select(*PLACED)).withColumns(
        {"bucket": F.date_trunc("hour", "ts"), "event_type": F.lit(SWITCH)}
    )
    steps = ordered_switches(switches).select(
        "run_id", F.coalesce("previous", F.lit(START)).alias("source"), F.col("to_process").alias("target")
    )
    last = switches.groupBy("run_id").agg(F.max_by("to_process", F.struct("ts", "event_id")).alias("_last"))
    closed = rows.filter(F.col("target") == END).select("run_id").distinct().join(last, "run_id", "left")
    return steps.unionByName(
        closed.select("run_id", F.coalesce("_last", F.lit(START)).alias("source"), F.lit(END).alias("target"))
    )


QUALITY_SCHEMA = (
    "run_id string, events bigint, unparseable bigint, out_of_window bigint, non_monotonic bigint"
)
QUALITY_COUNTS = ["events", "unparseable", "out_of_window", "non_monotonic"]
QUALITY_STATE = "runs array<string>, " + ", ".join(f"{c} array<bigint>" for c in QUALITY_COUNTS) + ", before array<double>"


def _run_quality(
    key: tuple, frames: Iterator[pd.DataFrame], state: GroupState
) -> Iterator[pd.DataFrame]:
    """Updated timestamp counts of the runs of a group that have new events; late events are counted, not dropped."""
    held = {run: values for run, *values in zip(*state.get, strict=True)} if state.exists else {}
    rows, runs = _coded(pd.concat(list(frames), ignore_index=True).sort_values("pos"))
    known = rows[rows["at"].notna()]
    before = pd.Series([held[run][-1] if run in held else None for run in runs], dtype="float64")
    previous = known.groupby("_run")["at"].shift()
    previous = previous.fillna(known["_run"].map(before))
    marks = pd.DataFrame(
        {
            "events": 1,
            "unparseable": rows["at"].isna(),
            "out_of_window": rows["at"].notna() & ~rows["at"].between(rows["low"], rows["high"]),
            "non_monotonic": (known["at"] < previous).reindex(rows.index, fill_value=False),
        }
    ).astype("int64")
    added = marks.groupby(rows["_run"]).sum()
    before = known.groupby("_run")["at"].last().reindex(added.index).fillna(before)
    old = pd.DataFrame([held[runs[c]][:-1] if runs[c] in held else [0] * len(QUALITY_COUNTS) for c in added.index], index=added.index, columns=QUALITY_COUNTS)
    total = (added + old).astype("int64")
    for code, counts, at in zip(total.index, total.to_numpy().tolist(), before.tolist(), strict=True):
        held[runs[code]] = [*counts, None if pd.isna(at) else at]
    state.update(tuple(map(list, zip(*((run, *values) for run, values in held.items()), strict=True))))
    yield total.assign(run_id=[runs[c] for c in total.index])[["run_id", *QUALITY_COUNTS]]


def stream_trace_quality(events: DataFrame) -> DataFrame:
    """Timestamp quality per run, updated with every batch.

    ``events(run_id, pos, at, low, high)``: epoch seconds, ``at`` null when the
    timestamp cannot be read; no watermark, so nothing is dropped. State is one
    row of counts per run, in ``GROUPS`` groups.
    """
    return _grouped(events).applyInPandasWithState(
        _run_quality, QUALITY_SCHEMA, QUALITY_STATE, "update", GroupStateTimeout.NoTimeout
    )


def start_quarantine(
    rows: DataFrame, check: Callable[[DataFrame], DataFrame], folder: str
) -> StreamingQuery:
    """Write valid and rejected rows of each batch to two tables.

    The batch number is a folder that a repeated batch overwrites, so a retry
    after a failure leaves no duplicate.
    """

    def write(batch: DataFrame, number: int) -> None:
        checked = check(batch).persist()
        bad = F.size("reject_reasons") > 0
        checked.filter(~bad).write.mode("overwrite").parquet(f"{folder}/valid/batch={number}")
        checked.filter(bad).write.mode("overwrite").parquet(f"{folder}/rejected/batch={number}")
        checked.unpersist()

    return (
        rows.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def idle_sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Activity sessions per run, closed after the gap; as a stream it leaves out events behind the watermark."""
    return (
        events.withWatermark("ts", LATENESS)
        .groupBy(F.session_window("ts", gap).alias("session"), "run_id")
        .agg(F.count(F.lit(1)).alias("events"))
        .select("run_id", F.col("session.start").alias("session_start"), "events")
    )


def drain(stream: DataFrame, folder: str, mode: str) -> DataFrame:
    """Run a stream over all available files and read back what it wrote.

    Each batch overwrites its own folder; ``batch`` tells a later update of a
    row from an earlier one.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = (
        stream.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])
    return stream.sparkSession.read.schema(schema).parquet(f"{folder}/out")


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Newest version of each key of an update-mode output."""
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_v")).select(*keys, "_v.*")
