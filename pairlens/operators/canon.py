"""Canonical runs, completion, job planning and the join of scores to runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.functions.ordering import exact_quantiles, first_by
from pairlens.functions.text import LINE_BREAK, parse_utc_timestamp

RUN_KEY = ["benchmark", "condition", "prompt", "platform"]
GROUP = ["benchmark", "prompt", "platform"]


def canonical_runs(runs: DataFrame, key: Sequence[str] = RUN_KEY) -> DataFrame:
    """Latest completed run per key, else the latest of the others.

    ``max_by`` combines on the map side, so a key with very many attempts
    sends one row per input partition.
    """
    rest = [c for c in runs.columns if c not in key]
    done = (F.col("status") == "completed").alias("done")
    start = F.coalesce(F.col("started_at").cast("string"), F.lit("")).alias("start")
    if dict(runs.dtypes)["started_at"] != "string":
        start = F.col("started_at").alias("start")
    return first_by(runs, key, [done, start, F.col("path")], rest, last=True)


def completed_only(runs: DataFrame, scoring: Column | None = None) -> DataFrame:
    """Completed runs; when scoring states are recorded they must be eligible."""
    kept = runs.filter(F.col("status") == "completed")
    if scoring is not None:
        kept = kept.filter(scoring.isNull() | (scoring == "eligible"))
    return kept


def failure_label(message: Column, error: Column) -> Column:
    """First line of the failure text, at most 120 characters."""
    text = F.coalesce(message, error, F.lit("unknown failure"))
    return F.substring(F.split(text, LINE_BREAK, 2)[0], 1, 120)


def completion(runs: DataFrame) -> DataFrame:
    """Run counts per benchmark, platform and condition."""
    done = F.col("status") == "completed"
    return runs.groupBy("benchmark", "platform", "condition").agg(
        F.count(F.lit(1)).alias("run_count"),
        F.count_if(done).alias("completed_runs"),
        F.count_if(~done).alias("failed_runs"),
    )


def failure_counts(runs: DataFrame) -> DataFrame:
    """Failed runs per cell and failure label, as rows rather than a map."""
    return (
        runs.filter(F.col("status") != "completed")
        .withColumn("label", failure_label(F.col("failure_message"), F.col("failure_error")))
        .groupBy("benchmark", "platform", "condition", "label")
        .agg(F.count(F.lit(1)).alias("runs"))
    )


def contrast_sides(contrasts: DataFrame) -> DataFrame:
    """Contrast table with one row per side; a parameter of a few rows."""
    left = contrasts.select("*", F.col("left_condition").alias("condition"), F.lit("left").alias("side"))
    right = contrasts.select("*", F.col("right_condition").alias("condition"), F.lit("right").alias("side"))
    return left.unionByName(right)


def paired_rows(
    rows: DataFrame, contrasts: DataFrame, unit: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """Both sides of each contrast on one row per unit.

    Each row is tagged with the contrast sides it belongs to and one aggregate
    brings the sides together: a single shuffle in place of a self join. A unit
    stays only when both sides are present. Conditions of contrasts are never
    null; the null-safe join keeps Spark from adding a filter to these rows
    alone, with which it could no longer share a shuffle of theirs with others.
    """
    sides = contrast_sides(contrasts).withColumnRenamed("condition", "_condition")
    tagged = rows.join(F.broadcast(sides), F.col("condition").eqNullSafe(F.col("_condition"))).drop("_condition")
    # a single value fits a hash aggregate, a struct needs a sort
    payload = F.col(values[0]) if len(values) == 1 else F.struct(*values)
    side = lambda s: F.max(F.when(F.col("side") == s, payload))
    both = tagged.groupBy(*unit, "left_condition", "right_condition").agg(
        side("left").alias("_left"),
        side("right").alias("_right"),
        F.max(F.col("side") == "left").alias("_has_left"),
        F.max(F.col("side") == "right").alias("_has_right"),
    )
    of = lambda s, v: F.col(f"_{s}" if len(values) == 1 else f"_{s}.{v}").alias(f"{s}_{v}")
    return both.filter(F.col("_has_left") & F.col("_has_right")).select(
        *unit, "left_condition", "right_condition", *[of(s, v) for s in ("left", "right") for v in values]
    )


def plan_pairs(canon: DataFrame, contrasts: DataFrame, values: Sequence[str] = ("path",)) -> DataFrame:
    """Pairwise jobs: both runs of a contrast exist and are completed."""
    return paired_rows(completed_only(canon), contrasts, GROUP, values)


def pending_jobs(planned: DataFrame, finished: DataFrame, records: DataFrame, key: Sequence[str]) -> DataFrame:
    """Planned jobs with their state.

    ``skipped`` has a finished manifest, ``orphan`` has records without one (to
    be removed and scored again), ``pending`` has neither.
    """
    done = finished.select(*key).distinct().withColumn("_done", F.lit(True))
    written = records.select(*key).distinct().withColumn("_written", F.lit(True))
    state = (
        F.when(F.col("_done"), "skipped").when(F.col("_written"), "orphan").otherwise("pending")
    )
    return (
        planned.join(done, list(key), "left")
        .join(written, list(key), "left")
        .withColumn("state", state)
        .drop("_done", "_written")
    )


def plan_native_jobs(canon: DataFrame, config: DataFrame) -> DataFrame:
    """Completed runs of the benchmarks that have a native task."""
    targets = config.select(F.lower("target").alias("_target"), "task")
    runs = completed_only(canon).withColumn("_target", F.lower("benchmark"))
    return runs.join(targets, "_target").drop("_target")


def digest_key(digest: Column) -> Column:
    """A digest as bytes, the same for equal digests only: lower-case hex in half its length, other text as it is."""
    raw = F.unhex(digest)
    tagged = lambda tag, value: F.concat(F.lit(tag), value)
    return F.when(F.lower(F.hex(raw)) == digest, tagged(b"x", raw)).otherwise(tagged(b"t", F.encode(digest, "utf-8")))


def join_scores_to_runs(
    artifacts: DataFrame, runs: DataFrame, key: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """Artifacts whose every source is a completed canonical run.

    ``artifacts`` has ``source_digests`` in order; the result adds ``sources``,
    an array of run structs in that order. An artifact without sources is
    dropped. Digests are most of what this join shuffles, so they go as bytes.
    """
    exploded = artifacts.select(*key, F.posexplode("source_digests").alias("pos", "digest"))
    exploded = exploded.withColumn("digest", digest_key(F.col("digest")))
    lookup = runs.select(
        digest_key(F.col("manifest_digest")).alias("digest"),
        (F.col("status") == "completed").alias("_done"),
        F.struct(*values).alias("_run"),
    )
    resolved = exploded.join(lookup, "digest", "left").groupBy(*key).agg(
        F.every(F.coalesce("_done", F.lit(False))).alias("_all"),
        F.array_sort(F.collect_list(F.struct("pos", "_run"))).alias("_sources"),
    )
    return resolved.filter("_all").select(
        *key, F.transform("_sources", lambda s: s["_run"]).alias("sources")
    )


def verify_prompt_refs(runs: DataFrame, prompts: DataFrame) -> DataFrame:
    """Reason a run's prompt reference is wrong, or null."""
    known = prompts.select(
        F.col("prompt_id").alias("prompt_ref"),
        F.col("hash").alias("_hash"),
        F.col("manifest_hash").alias("_manifest"),
    )
    reason = (
        F.when(F.col("_hash").isNull(), "unknown_prompt")
        .when(~F.col("manifest_ref_hash").eqNullSafe(F.col("_manifest")), "manifest_hash_mismatch")
        .when(~F.col("prompt_ref_hash").eqNullSafe(F.col("_hash")), "prompt_hash_mismatch")
    )
    return runs.join(known, "prompt_ref", "left").withColumn("reject_reason", reason).drop(
        "_hash", "_manifest"
    )


# The keys that hold an attempt duration
DURATION_KEYS = ("duration", "duration_seconds", "elapsed", "elapsed_seconds")


JSON_TOKEN = r'"(?:[^"\\]|\\.)*"\s*:?|[{}\[\]]|[^\s,:{}\[\]"]+'


def recorded_seconds(attempts_json: Column) -> Column:
    """Sum of the non-negative durations of the attempts text, at any depth but not inside a duration itself.

    One fold over the tokens of the text: ``skip`` is the depth of a container that stands where a duration is
    expected, ``armed`` tells that the last token was the key of a duration. True counts as one, false as zero.
    """
    number = lambda t: F.when(t == "true", 1.0).when(t == "false", 0.0).otherwise(
        F.btrim(t, F.lit('"')).try_cast("double")
    )

    def state(depth: Column, skip: Column, armed: Column, total: Column, found: Column) -> Column:
        names = ("depth", "skip", "armed", "total", "found")
        return F.struct(*[c.alias(n) for n, c in zip(names, (depth, skip, armed, total, found), strict=True)])

    def step(acc: Column, token: Column) -> Column:
        key = F.rtrim(F.rtrim(token, F.lit(":")))
        is_key = token.startswith('"') & token.endswith(":")
        opens, closes = token.isin("{", "["), token.isin("}", "]")
        depth = acc["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        skip = F.when(opens & acc["armed"], depth).when(closes & (acc["skip"] == acc["depth"]), 0).otherwise(acc["skip"])
        armed = is_key & (acc["skip"] == 0) & F.btrim(key, F.lit('"')).isin(*DURATION_KEYS)
        value = F.when(acc["armed"] & ~is_key & ~opens & ~closes, number(token))
        good = F.coalesce((value >= 0) & ~F.isnan(value), F.lit(False))
        total = acc["total"] + F.when(good, value).otherwise(0.0)
        return state(depth, skip, armed, total, acc["found"] | good)

    start = state(F.lit(0), F.lit(0), F.lit(False), F.lit(0.0), F.lit(False))
    tokens = F.regexp_extract_all(attempts_json, F.lit(JSON_TOKEN), F.lit(0))
    return F.aggregate(tokens, start, step, lambda s: F.when(s["found"], s["total"]))


def elapsed_seconds(attempts_json: Column, started: Column, updated: Column) -> Column:
    """Recorded attempt time, else the non-negative span between two timestamps."""
    span = F.timestamp_diff("MICROSECOND", started, updated) / 1e6
    return F.coalesce(recorded_seconds(attempts_json), F.when(span >= 0, span))


def elapsed_from_text(attempts_json: Column, started: Column, updated: Column) -> Column:
    """The same for ISO text, read as UTC when it states no offset."""
    return elapsed_seconds(attempts_json, parse_utc_timestamp(started), parse_utc_timestamp(updated))


def timing(runs: DataFrame, keys: Sequence[str] = ("condition",)) -> DataFrame:
    """Mean and median seconds per condition, rounded half to even."""
    timed = runs.filter(F.col("seconds").isNotNull())
    means = timed.groupBy(*keys).agg(F.avg("seconds").alias("_mean"))
    medians = exact_quantiles(timed, keys, "seconds", {"_median": 0.5})
    return means.join(medians, list(keys)).select(
        *keys,
        F.bround("_mean").cast("bigint").alias("mean_seconds"),
        F.bround("_median").cast("bigint").alias("median_seconds"),
    )
