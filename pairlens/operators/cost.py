"""Token accounting and cost."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRICE_KEYS = ("input", "cached_input", "output")
# The names under which a counter may be recorded, in order
CACHED = ("cached_input_tokens", "cached_tokens", "cache_read_tokens")
INPUT = ("input_tokens", "prompt_tokens")
OUTPUT = ("output_tokens",)
REASONING = ("reasoning_output_tokens", "reasoning_tokens")
JUDGE_CACHED = ("cached_tokens", "cached_input_tokens", "cache_read_tokens")
JUDGE_INPUT = ("prompt_tokens", "input_tokens")
JUDGE_OUTPUT = ("completion_tokens",)


def counter(usage: dict[str, Column], names: Sequence[str]) -> Column:
    """First recorded non-negative counter among the names, else 0."""
    options = [F.when(usage[n] >= 0, usage[n]) for n in names if n in usage]
    return F.coalesce(*options, F.lit(0)).cast("bigint")


def usage_columns(usage: dict[str, Column], judge: bool = False) -> list[Column]:
    """Uncached input, cached input and output tokens of one usage object."""
    cached = counter(usage, JUDGE_CACHED if judge else CACHED)
    asked = counter(usage, JUDGE_INPUT if judge else INPUT)
    produced = (
        counter(usage, JUDGE_OUTPUT)
        if judge
        else counter(usage, OUTPUT) + counter(usage, REASONING)
    )
    return [
        F.greatest(asked - cached, F.lit(0).cast("bigint")).alias("input"),
        cached.alias("cached_input"),
        produced.alias("output"),
    ]


def priced(cells: DataFrame, prices: DataFrame) -> DataFrame:
    """Add the cost of each cell; ``prices`` is one row per million tokens."""
    one = prices.select(*[F.col(k).alias(f"_price_{k}") for k in PRICE_KEYS])
    cost = sum((F.col(k) * F.col(f"_price_{k}") for k in PRICE_KEYS), F.lit(0.0)) / 1e6
    return (
        cells.join(F.broadcast(one))
        .withColumn("cost", cost)
        .drop(*[f"_price_{k}" for k in PRICE_KEYS])
    )


def generation_cost(runs: DataFrame, events: DataFrame, prices: DataFrame) -> DataFrame:
    """Tokens and cost of all canonical runs, failed ones included.

    Events are summed per run before the join, so a run with very many events
    reaches the join as one row.
    """
    per_run = (
        events.filter(F.col("type") == "turn.completed")
        .groupBy("path")
        .agg(*[F.sum(k).alias(k) for k in PRICE_KEYS])
    )
    cells = (
        runs.select("platform", "benchmark", "condition", "path")
        .join(per_run, "path", "left")
        .groupBy("platform", "benchmark", "condition")
        .agg(
            F.count(F.lit(1)).alias("run_count"),
            *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in PRICE_KEYS],
        )
    )
    return priced(cells, prices)


def judge_cost(records: DataFrame, prices: DataFrame) -> DataFrame:
    """Tokens and cost per judge task; reasoning tokens are not added."""
    cells = records.groupBy("task").agg(
        F.countDistinct("source_path").alias("run_count"),
        F.count(F.lit(1)).alias("record_count"),
        *[F.sum(k).alias(k) for k in PRICE_KEYS],
    )
    return priced(cells, prices)


def cost_totals(generation: DataFrame, judge: DataFrame) -> DataFrame:
    """Totals of both cost tables and their sum."""
    columns = [*PRICE_KEYS, "cost"]
    both = generation.select(F.lit("generation").alias("part"), *columns).unionByName(
        judge.select(F.lit("judge").alias("part"), *columns)
    )
    return (
        both.rollup("part")
        .agg(*[F.sum(c).alias(c) for c in columns])
        .withColumn("part", F.coalesce("part", F.lit("total")))
    )


def per_run(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tokens and cost per run as ratios of sums over cells."""
    runs = F.sum("run_count")
    return cells.groupBy(*keys).agg(
        runs.alias("run_count"),
        *[(F.sum(c) / runs).alias(f"{c}_per_run") for c in (*PRICE_KEYS, "cost")],
    )


def strict_token_usage(events: DataFrame, runs: DataFrame) -> DataFrame:
    """Output and reasoning tokens per run; any malformed turn voids the run."""
    turn = F.col("type") == "turn.completed"
    bad = (
        ~F.col("has_usage")
        | F.col("output_tokens").isNull()
        | (F.col("output_tokens") < 0)
        | (F.coalesce("reasoning_output_tokens", F.lit(0)) < 0)
    )
    per = events.filter(turn).groupBy("path").agg(
        F.count(F.lit(1)).alias("turns"),
        F.count_if(bad).alias("bad_turns"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum(F.coalesce("reasoning_output_tokens", F.lit(0))).alias("reasoning_output_tokens"),
    )
    status = (
        F.when(F.col("turns").isNull(), "missing")
        .when(F.col("bad_turns") > 0, "malformed")
        .otherwise("observed")
    )
    good = F.col("status") == "observed"
    return (
        runs.select("path")
        .join(per, "path", "left")
        .withColumn("status", status)
        .select(
            "path",
            "status",
            F.when(good, F.col("output_tokens")).alias("output_tokens"),
            F.when(good, F.col("reasoning_output_tokens")).alias("reasoning_output_tokens"),
            F.when(good, F.col("output_tokens") + F.col("reasoning_output_tokens")).alias(
                "total_tokens"
            ),
        )
    )


#: Stages of a run that are thinned out together before the rest of the run is looked at.
BLOCK = 65_536


def running_budget(stages: DataFrame, limit: int, block: int = BLOCK) -> DataFrame:
    """Greedy output budget over the ordered stages ``(path, pos, units)`` of each run.

    A stage that would overflow is rejected and uses nothing. Units are not negative; a stage without units is rejected,
    one of zero units always fits. If a stage is accepted, so were all equal ones before it, as there was room for each:
    the stages that can be accepted are the first ``limit / units`` of each number of units. So blocks and then
    runs are thinned out by rank, to at most ``limit * (1 + ln(limit))`` stages of a run of any length, and those are folded
    as a sorted stream that carries one number.
    """
    size = F.col("units")
    totals = stages.groupBy("path").agg(F.count(F.lit(1)).alias("stages"), F.count_if(size == 0).alias("_free"))
    open_stages = stages.filter((size > 0) & (size <= limit)).select("path", "pos", size.cast("bigint").alias("units"))
    fits = F.col("_rank") * size <= limit
    in_block = Window.partitionBy("path", "units", F.floor(F.col("pos") / block)).orderBy("pos")
    in_run = Window.partitionBy("path", "units").orderBy("pos")
    for place in (in_block, in_run):
        open_stages = open_stages.withColumn("_rank", F.row_number().over(place)).filter(fits).drop("_rank")
    kind = stages.schema["path"].dataType.simpleString()
    folded = open_stages.repartition("path").sortWithinPartitions("path", "pos").mapInArrow(
        lambda batches: _fold(batches, limit), f"path {kind}, used bigint, _taken bigint"
    )
    taken = F.col("_free") + F.coalesce("_taken", F.lit(0))
    return totals.join(folded, "path", "left").select(
        "path",
        "stages",
        F.coalesce("used", F.lit(0)).cast("bigint").alias("used"),
        taken.alias("accepted"),
        (F.col("stages") - taken).alias("rejected"),
    )


def _fold(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """(path, used, accepted) from batches sorted by path and place; a run may go on in the next batch."""
    path, used, taken = None, 0, 0
    for batch in batches:
        out = []
        for name, units in zip(batch.column("path").to_pylist(), batch.column("units").to_pylist(), strict=True):
            if name != path:
                if path is not None:
                    out.append((path, used, taken))
                path, used, taken = name, 0, 0
            if used + units <= limit:
                used, taken = used + units, taken + 1
        yield _folded(out, batch.schema.field("path").type)
        last = batch.schema.field("path").type
    if path is not None:
        yield _folded([(path, used, taken)], last)


def _folded(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, pa.int64(), pa.int64()), strict=True)], names=["path", "used", "_taken"])
