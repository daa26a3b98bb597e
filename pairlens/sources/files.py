"""Readers of run directories, score artifacts, traces, manifests and sheets.

Each reader has two parts: a file scan that yields text with its path, and a
parser of such text as a DataFrame function, so the same parser serves tables
that already hold the text.

Scans read loose files below roots, and packs: Parquet folders that hold many
small files as rows (path, value), as ``sinks.sink_pack`` writes them. A loose
file costs a file creation, an entry of the driver's file index and an open;
a packed one is a row, so millions of manifests are no more than a table.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairlens.functions.ordering import previous_value, running_count
from pairlens.functions.rows import once
from pairlens.functions.text import LINE_BREAK, sha256_hex
from pairlens.session import written

RUN_SCHEMA = (
    "inputs STRUCT<benchmark_name: STRING, condition_id: STRING, prompt_id: STRING, platform: STRING, "
    "prompt_hash: STRING, prompt_manifest_hash: STRING>, status STRING, started_at STRING, "
    "updated_at STRING, attempts STRING, output_units_used BIGINT, budget_used_tokens BIGINT, "
    "token_accounting STRUCT<status: STRING, output_tokens: BIGINT, reasoning_output_tokens: BIGINT, "
    "total_tokens: BIGINT>, failure STRUCT<message: STRING, error: STRING>, "
    "scoring STRUCT<status: STRING>"
)
SCORE_SCHEMA = (
    "task STRING, judge STRUCT<judge_id: STRING, model: STRING, effort: STRING, seed: BIGINT, "
    "max_output_tokens: BIGINT>, source_runs ARRAY<STRUCT<run_manifest_sha256: STRING, "
    "output_sha256: STRING>>, records ARRAY<STRUCT<line: INT, usage: STRUCT<prompt_tokens: BIGINT, "
    "completion_tokens: BIGINT, reasoning_tokens: BIGINT, cached_tokens: BIGINT>>>, "
    "tournament STRUCT<order_mapping: ARRAY<STRUCT<presentation: STRING, first_output: STRING, "
    "second_output: STRING>>>, family_audit STRUCT<mode: STRING>"
)
RECORD_SCHEMA = (
    "presentation STRING, winner STRING, judge_id STRING, criterion STRING, score DOUBLE, "
    "scores STRUCT<instruction_fulfillment: DOUBLE, organization_global_coherence: DOUBLE, "
    "content_adequacy_depth: DOUBLE, style_voice_audience_fit: DOUBLE, "
    "factuality_constraint_fidelity: DOUBLE>, "
    "checklist_items ARRAY<STRUCT<checklist_id: INT, reason: STRING, evaluation_score: DOUBLE>>"
)
TRACE_SCHEMA = (
    "timestamp STRING, event_type STRING, responsible_agent STRING, process STRING, decision STRING, "
    "evidence ARRAY<STRING>, open_uncertainty ARRAY<STRING>, from_process STRING, to_process STRING, "
    "goal_id STRING, parent_goal_id STRING, artifacts ARRAY<STRING>"
)
OPTIONAL_FIELDS = ("from_process", "to_process", "goal_id", "parent_goal_id", "artifacts")
PROMPT_SCHEMA = (
    "prompt_id STRING, benchmark_name STRING, source_version STRING, prompt_text STRING, "
    "requested_output_constraints ARRAY<STRING>, native_payload STRING, supplied_context STRING, hash STRING"
)
PRICE_KEYS = ("input", "cached_input", "output")
BLOCK_LINES = 4096


def _outer(roots: Sequence[str]) -> list[str]:
    """Roots that lie in no other root, so that a file below two of them is read once."""
    plain = list(dict.fromkeys(r.rstrip("/") for r in roots))
    return [r for r in plain if not any(r != o and r.startswith(o + "/") for o in plain)]


def _with_root(files: DataFrame, roots: Sequence[str]) -> DataFrame:
    """Adds the first listed root that holds the file."""
    root = F.lit(None).cast("string")
    for r in reversed(list(dict.fromkeys(r.rstrip("/") for r in roots))):
        root = F.when(F.contains("path", F.lit(r + "/")), F.lit(r)).otherwise(root)
    return files.select(root.alias("root"), *files.columns)


def _packed(spark: SparkSession, packs: Sequence[str], name: str) -> DataFrame:
    """(path, value) of the packed files of one name."""
    files = spark.read.schema("path STRING, value STRING").parquet(*packs)
    return files.filter(F.substring_index("path", "/", -1).rlike("^" + fnmatch.translate(name)))


def _both(loose: DataFrame | None, packed: DataFrame | None, roots: Sequence[str]) -> DataFrame:
    """Loose and packed files (one of them may be left out) with their roots; packed ones outside the roots have none."""
    if loose is None and packed is None:
        raise ValueError("neither roots nor packs are given")
    files = packed if loose is None else loose if packed is None else loose.unionByName(packed)
    return _with_root(files, roots)


def scan_text(spark: SparkSession, roots: Sequence[str], name: str, packs: Sequence[str] = ()) -> DataFrame:
    """Whole files of one name below the roots or in packs, as (root, path, value): for documents that only make sense whole."""
    loose = spark.read.text(_outer(roots), wholetext=True, recursiveFileLookup=True, pathGlobFilter=name).select(
        F.col("_metadata.file_path").alias("path"), "value"
    ) if roots else None
    return _both(loose, _packed(spark, packs, name) if packs else None, roots)


def scan_paths(spark: SparkSession, roots: Sequence[str], name: str, packs: Sequence[str] = ()) -> DataFrame:
    """(root, path) of the files, also of empty ones; loose ones come from the file index that a read makes, without content."""
    loose = _loose_paths(spark, roots, name) if roots else None
    return _both(loose, _packed(spark, packs, name).select("path") if packs else None, roots)


def _loose_paths(spark: SparkSession, roots: Sequence[str], name: str) -> DataFrame:
    found = spark.read.text(_outer(roots), recursiveFileLookup=True, pathGlobFilter=name).inputFiles()
    # the index writes an empty authority where file metadata leaves it out
    plain = [(re.sub(r"^([A-Za-z0-9+.-]+):///", r"\1:/", path),) for path in found]
    return spark.createDataFrame(plain, "path string")


def scan_lines(spark: SparkSession, roots: Sequence[str], name: str, packs: Sequence[str] = ()) -> DataFrame:
    """Non-blank lines of the files in order, as (root, path, pos, bucket, line); loose files are read in splits.

    A packed file is small and split where it is read. Of loose files, a task reads one stretch of a file at a time. A line's place is its place in the stretch plus the lines of
    all stretches before it, of which there is one small row each; so a file of any size is read by many tasks.
    """
    loose = None
    if roots:
        lines = spark.read.text(_outer(roots), recursiveFileLookup=True, pathGlobFilter=name).select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("_start"),
            F.explode(F.split("value", LINE_BREAK)).alias("line"),
        )
        loose = _placed(lines, F.trim("line") != "")
    packed = split_lines(_packed(spark, packs, name)).withColumn("pos", F.col("pos").cast("bigint")) if packs else None
    return _both(loose, packed, roots)


def _placed(lines: DataFrame, kept: Column) -> DataFrame:
    """(path, pos, bucket, line) of the kept lines from lines in reading order with the start of their stretch."""
    lines = lines.withColumn("_id", F.monotonically_increasing_id())
    stretches = lines.groupBy("path", "_start").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("path").orderBy("_start")) - F.col("_n")
    stretches = stretches.select("path", "_start", "_first", before.alias("_before"))
    place = F.col("_id") - F.col("_first") + F.col("_before")
    # a shuffle would put every line of a stretch into one task; stretches are as many as the tasks of the read
    return lines.filter(kept).join(F.broadcast(stretches), ["path", "_start"]).select(
        "path",
        (place + 1).alias("pos"),
        F.floor(place / BLOCK_LINES).cast("int").alias("bucket"),
        "line",
    )


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def is_object(value: Column) -> Column:
    """The text is a JSON object."""
    return F.coalesce(
        F.try_parse_json(value).isNotNull() & F.ltrim(value).startswith("{"), F.lit(False)
    )


def split_lines(files: DataFrame, keep: Sequence[str] = ("path",)) -> DataFrame:
    """Non-blank lines in order: ``pos`` counts all lines from 1, ``bucket`` blocks of them."""
    lines = files.select(*keep, F.posexplode(F.split("value", LINE_BREAK)).alias("_i", "line"))
    return lines.filter(F.trim("line") != "").select(
        *keep,
        (F.col("_i") + 1).alias("pos"),
        F.floor(F.col("_i") / BLOCK_LINES).cast("int").alias("bucket"),
        "line",
    )


def parse_runs(files: DataFrame, default_platform: str = "codex") -> DataFrame:
    """Run manifests; text that is no object or lacks one of three inputs is skipped."""
    run = F.from_json("value", RUN_SCHEMA)
    text = lambda field: F.schema_of_variant(
        F.try_variant_get(F.try_parse_json("value"), f"$.inputs.{field}", "variant")
    ) == "STRING"
    required = text("benchmark_name") & text("condition_id") & text("prompt_id")
    rest = [c for c in files.columns if c != "value"]
    return (
        files.filter(is_object(F.col("value")) & required)
        .select(*rest, sha256_hex(F.col("value")).alias("_digest"), run.alias("_r"))
        .select(
            *rest,
            F.concat(F.lit("sha256:"), "_digest").alias("manifest_digest"),
            F.col("_r.inputs.benchmark_name").alias("benchmark"),
            F.col("_r.inputs.condition_id").alias("condition"),
            F.col("_r.inputs.prompt_id").alias("prompt"),
            F.coalesce("_r.inputs.platform", F.lit(default_platform)).alias("platform"),
            F.coalesce("_r.status", F.lit("unknown")).alias("status"),
            F.coalesce("_r.started_at", F.lit("")).alias("started_at"),
            F.col("_r.updated_at").alias("updated_at"),
            F.col("_r.attempts").alias("attempts"),
            F.col("_r.output_units_used").alias("output_units_used"),
            F.col("_r.budget_used_tokens").alias("budget_used_tokens"),
            F.col("_r.token_accounting").alias("token_accounting"),
            F.col("_r.failure.message").alias("failure_message"),
            F.col("_r.failure.error").alias("failure_error"),
            F.col("_r.scoring.status").alias("scoring_status"),
        )
    )


def scan_runs(
    spark: SparkSession, roots: Sequence[str], name: str = "run-manifest.json", packs: Sequence[str] = ()
) -> DataFrame:
    files = scan_text(spark, roots, name, packs)
    return parse_runs(files.withColumn("path", folder(F.col("path"))))


def parse_score_manifests(files: DataFrame) -> DataFrame:
    """Score manifests that are JSON objects."""
    rest = [c for c in files.columns if c != "value"]
    return (
        files.filter(is_object(F.col("value")))
        .select(*rest, F.from_json("value", SCORE_SCHEMA).alias("_m"))
        .select(*rest, "_m.*")
    )


def scan_score_manifests(
    spark: SparkSession, roots: Sequence[str], name: str = "scores-manifest.json", packs: Sequence[str] = ()
) -> DataFrame:
    files = scan_text(spark, roots, name, packs)
    return parse_score_manifests(files.withColumn("path", folder(F.col("path"))))


def record_lines(lines: DataFrame, strict: bool) -> DataFrame:
    """Score records of each artifact from its lines.

    Lines that hold no object are dropped. A line that is not JSON drops the
    whole artifact when ``strict``, else only itself.
    """
    broken = F.try_parse_json("line").isNull()
    if strict:
        bad = lines.filter(broken).select("path").distinct()
        lines = lines.join(bad, "path", "left_anti")
    return (
        lines.filter(is_object(F.col("line")))
        .select("path", "pos", F.from_json("line", RECORD_SCHEMA).alias("_r"))
        .select("path", "pos", "_r.*")
    )


def parse_score_records(files: DataFrame, strict: bool) -> DataFrame:
    """The same from a table of whole files."""
    return record_lines(split_lines(files), strict)


def scan_score_records(
    spark: SparkSession, roots: Sequence[str], strict: bool, name: str = "scores.jsonl", packs: Sequence[str] = ()
) -> DataFrame:
    lines = scan_lines(spark, roots, name, packs)
    return record_lines(lines.withColumn("path", folder(F.col("path"))), strict)


def trace_lines(files: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trace events in line order, and the files that are no valid trace.

    A file is refused when a line is no JSON object, or when it has no line.
    ``has_`` columns tell an absent field from a null one.
    """
    lines = lines.withColumn("_ok", is_object(F.col("line")))
    problems = (
        files.select("path")
        .join(lines.groupBy("path").agg(F.every("_ok").alias("_all")), "path", "left")
        .filter(~F.coalesce("_all", F.lit(False)))
        .select("path", F.when(F.col("_all").isNull(), "empty").otherwise("bad_line").alias("reason"))
    )
    keys = F.json_object_keys("line")
    present = [
        F.array_contains(keys, name).alias(f"has_{name}") for name in OPTIONAL_FIELDS
    ]
    events = (
        lines.join(problems.select("path"), "path", "left_anti")
        .select("path", "pos", "bucket", *present, F.from_json("line", TRACE_SCHEMA).alias("_e"))
        .select("path", "pos", "bucket", "_e.*", *[f"has_{n}" for n in OPTIONAL_FIELDS])
    )
    return events, problems


def parse_trace(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same from a table of whole files."""
    return trace_lines(files, split_lines(files))


def scan_trace(
    spark: SparkSession, roots: Sequence[str], name: str = "process.jsonl", packs: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    return trace_lines(scan_paths(spark, roots, name, packs), scan_lines(spark, roots, name, packs).drop("root"))


def scan_attempt_events(
    spark: SparkSession, roots: Sequence[str], name: str = "attempt-*.events.jsonl", packs: Sequence[str] = ()
) -> DataFrame:
    """Lines of the attempt event files: run folder, file, line place and text."""
    lines = scan_lines(spark, roots, name, packs)
    return lines.select(folder(F.col("path")).alias("path"), F.col("path").alias("file"), "pos", "bucket", F.col("line").alias("value"))


def prompt_lines(files: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prompt rows, and one check row per file.

    A file needs at least one row, only object lines, one benchmark, one source
    version and unique ids.
    """
    lines = lines.withColumn("_ok", is_object(F.col("line")))
    rows = lines.filter("_ok").select("path", "pos", F.from_json("line", PROMPT_SCHEMA).alias("_p")).select(
        "path", "pos", "_p.*"
    )
    bad = lines.groupBy("path").agg(F.count_if(~F.col("_ok")).alias("bad_lines"))
    facts = rows.groupBy("path").agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("benchmark_name").alias("benchmarks"),
        F.countDistinct("source_version").alias("versions"),
        F.countDistinct("prompt_id").alias("ids"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    checks = (
        files.select("path")
        .join(bad, "path", "left")
        .join(facts, "path", "left")
        .select("path", *[zero(c).alias(c) for c in ("bad_lines", "rows", "benchmarks", "versions", "ids")])
    )
    valid = (
        (F.col("bad_lines") == 0)
        & (F.col("rows") > 0)
        & (F.col("benchmarks") == 1)
        & (F.col("versions") == 1)
        & (F.col("ids") == F.col("rows"))
    )
    return rows, checks.withColumn("valid", valid)


def parse_prompt_manifest(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same from a table of whole files."""
    return prompt_lines(files, split_lines(files))


def scan_prompt_manifest(
    spark: SparkSession, roots: Sequence[str], name: str = "*.jsonl", packs: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    return prompt_lines(scan_paths(spark, roots, name, packs), scan_lines(spark, roots, name, packs))


def scan_parquet_checked(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Parquet with only the required columns; a missing one is an error.

    Names with dots are read as they are.
    """
    table = spark.read.parquet(path)
    missing = [c for c in columns if c not in table.columns]
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))
    return table.select(*[F.col(f"`{c}`") for c in columns])


OUTSIDE, INSIDE, CLOSED = 0, 1, 2
CSV_FORM = {"escape": '"', "multiLine": "true"}


def _ends_inside(line: Column, inside: bool) -> Column:
    """1 if a quoted field is open behind the line, entered inside a quoted field or at the start of a record.

    The line is cut at its quotes. A quote opens a field only where a field starts, and a quote behind one that
    closed a field opens it again; other quotes are text.
    """
    parts = F.split(line, '"')

    def behind(seen: Column, part: Column) -> Column:
        state = seen["state"]
        after = (
            F.when(state == INSIDE, CLOSED)
            .when(state == CLOSED, F.when((seen["before"] == "") | seen["before"].endswith(","), INSIDE).otherwise(OUTSIDE))
            .otherwise(F.when(seen["before"].endswith(",") | (seen["first"] & (seen["before"] == "")), INSIDE).otherwise(OUTSIDE))
        )
        return F.struct(after.alias("state"), part.alias("before"), F.lit(False).alias("first"))

    start = F.struct(
        F.lit(INSIDE if inside else OUTSIDE).alias("state"), parts[0].alias("before"), F.lit(True).alias("first")
    )
    ended = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), start, behind, lambda seen: (seen["state"] == INSIDE).cast("int"))
    return F.when(F.contains(line, F.lit('"')), ended).otherwise(int(inside))


def csv_records(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Texts of the records of CSV files as (path, pos, head, text), read in splits: the line a record starts on, and that of the file's first.

    Whether a line starts inside a quoted field depends on all lines before it. Every line either keeps that state,
    flips it, or sets it whatever it was; so the state is what the last setting line left, flipped once by each
    flipping line since, and running values over blocks of lines give it. Lines that are a record of their own stay
    where they are, only those of longer records are grouped. Blank lines between records are dropped.
    """
    lines = spark.read.option("lineSep", "\n").text(list(paths)).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_start"), F.col("value").alias("line")
    )
    place = (["path"], ["bucket"], ["pos"])
    lines = _placed(lines, F.lit(True)).withColumn("line", F.when(F.col("pos") == 1, F.regexp_replace("line", "^\ufeff", "")).otherwise(F.col("line")))
    # read by several running values below, so it is computed and kept once
    ends = _ends_inside(F.col("line"), False) + 2 * _ends_inside(F.col("line"), True)
    lines = written(once(lines, "_ends", ends), "csv_lines")
    empty = F.col("line").isin("", "\r")
    # nothing is open before the first line that is not blank
    heads = lines.filter(~empty).groupBy("path").agg(F.min("pos").alias("head"))
    flips, sets = F.col("_ends") == 1, F.col("_ends").isin(0, 3)
    lines = running_count(lines, *place, flips, "_flips")
    left = F.when(sets, (F.when(F.col("_ends") == 3, 1).otherwise(0) + F.col("_flips")) % 2)
    lines = previous_value(lines, *place, left, "_left")
    inside = ((F.coalesce("_left", F.lit(0)) + F.col("_flips") - flips.cast("int")) % 2).cast("int")
    after = F.when(F.col("_inside") == 1, F.floor(F.col("_ends") / 2)).otherwise(F.col("_ends") % 2)
    lines = lines.withColumn("_inside", inside).withColumn("_open", after == 1)
    blank = (F.col("_inside") == 0) & empty
    alone = (F.col("_inside") == 0) & ~F.col("_open")
    single = lines.filter(alone & ~blank).select("path", "pos", "line")
    # lines of longer records follow each other: the record's start is the last one at or before the line
    started = F.when(F.col("_inside") == 0, F.col("pos"))
    several = previous_value(lines.filter(~alone).select("path", "bucket", "pos", "line", "_inside"), *place, started, "_begun")
    parts = F.array_sort(F.collect_list(F.struct("pos", "line")))
    joined = several.groupBy("path", F.coalesce(started, "_begun").alias("_record")).agg(
        F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("line")
    )
    records = single.unionByName(joined.withColumnRenamed("_record", "pos"))
    return records.join(heads, "path").select("path", "pos", "head", F.regexp_replace("line", "\r$", "").alias("text"))


def scan_csv_checked(
    spark: SparkSession, paths: Sequence[str], schema: str, required: Sequence[str]
) -> DataFrame:
    """CSV with a header and a fixed schema; the header must name the required columns.

    Quotes inside a quoted field are doubled; such a field may hold line breaks. Files are read in splits. A value
    that does not fit its type is null. A file whose first record is another header is an error when it is read.
    """
    header = spark.read.options(**CSV_FORM).option("header", True).csv(list(paths)).columns
    missing = [c for c in required if c not in header]
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))
    named = ", ".join(f"`c{i}` STRING" for i in range(len(header)))
    records = once(csv_records(spark, paths), "_r", F.from_csv("text", named, CSV_FORM))
    names = F.array(*[F.col(f"_r.c{i}") for i in range(len(header))])
    wrong = F.raise_error(F.concat(F.lit("the header of this file differs: "), "path")).cast("boolean")
    is_row = F.when(F.col("pos") > F.col("head"), True).when(names == F.array(*map(F.lit, header)), False).otherwise(wrong)
    rows = records.filter(is_row)
    wanted = spark.createDataFrame([], schema).schema
    return rows.select(
        *[
            (F.col(f"_r.c{header.index(f.name)}").try_cast(f.dataType) if f.name in header else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in wanted.fields
        ]
    )


def parse_prices(files: DataFrame) -> DataFrame:
    """Price documents with their validity: three non-negative numbers."""
    found = F.from_json("value", ", ".join(f"{k} DOUBLE" for k in PRICE_KEYS))
    rows = files.withColumn("_p", found).select(
        *[c for c in files.columns if c != "value"], "_p.*"
    )
    valid = F.lit(True)
    for key in PRICE_KEYS:
        valid = valid & F.coalesce(F.col(key) >= 0, F.lit(False))
    return rows.withColumn("valid", valid)


def scan_prices(
    spark: SparkSession, roots: Sequence[str], name: str = "prices.json", packs: Sequence[str] = ()
) -> DataFrame:
    """Price documents below the roots, one a file: (root, path, prices, valid)."""
    return parse_prices(scan_text(spark, roots, name, packs))


def verify_hashes(contents: DataFrame, pinned: DataFrame, key: str = "path") -> DataFrame:
    """Content digest beside the pinned one: matched, mismatched, unpinned or absent."""
    seen = contents.select(key, F.sha2(F.col("content").cast("binary"), 256).alias("observed"))
    status = (
        F.when(F.col("observed").isNull(), "absent")
        .when(F.col("expected").isNull(), "unpinned")
        .when(F.col("observed") == F.col("expected"), "matched")
        .otherwise("mismatched")
    )
    return seen.join(pinned, key, "full").withColumn("status", status)


def verify_source_hashes(spark: SparkSession, path: str, pinned: DataFrame, name: str = "*") -> DataFrame:
    """The same for files of a name below a folder, by their path relative to it."""
    below = re.sub(r"^[a-z0-9]+:/*", "/", path).rstrip("/") + "/"
    relative = F.substring_index(F.regexp_replace("path", r"^[a-z0-9]+:/*", "/"), below, -1)
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", name)
        .load(path)
        .select(relative.alias("path"), "content")
    )
    return verify_hashes(files, pinned)
