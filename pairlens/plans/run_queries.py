"""Registered queries on runs: selection, planning, completion and timing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.functions.stats import round6
from pairlens.functions.text import sha256_hex
from pairlens.operators import canon as C
from pairlens.plans import views as V
from pairlens.plans.registry import Tables, query, r6

RUN_CONTRASTS = (("A4", "A1"), ("A4", "A2"), ("A4", "A3"), ("A4", "A7"), ("A4", "A6"))


def canonical(t: Tables) -> DataFrame:
    return C.canonical_runs(V.runs(t))


@query(
    "canonical_runs",
    f"WITH {V.CANON_SQL} SELECT benchmark, condition, prompt, platform, status, path FROM canon",
)
def canonical_runs(t: Tables) -> DataFrame:
    return canonical(t).select(*C.RUN_KEY, "status", "path")


@query(
    "completed_only",
    f"""WITH {V.CANON_SQL} SELECT benchmark, count(*) AS runs, CAST(sum(run_no) AS BIGINT) AS run_numbers FROM canon
    WHERE status = 'completed' AND run_no % 9 <> 1 GROUP BY ALL""",
)
def completed_only(t: Tables) -> DataFrame:
    no = F.col("run_no") % 9
    scoring = F.when(no == 1, "blocked").when(no < 5, "eligible")
    kept = C.completed_only(canonical(t), scoring)
    return kept.groupBy("benchmark").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("run_no").alias("run_numbers")
    )


@query(
    "completion",
    f"""WITH {V.CANON_SQL} SELECT benchmark, platform, condition, count(*) AS run_count,
      count(*) FILTER (status = 'completed') AS completed_runs, count(*) FILTER (status <> 'completed') AS failed_runs
    FROM canon GROUP BY ALL""",
)
def completion(t: Tables) -> DataFrame:
    return C.completion(canonical(t))


@query(
    "failure_label",
    f"""WITH {V.CANON_SQL} SELECT benchmark, platform, condition,
      substring(split_part(coalesce(failure_message, failure_error, 'unknown failure'), chr(10), 1), 1, 120) AS label,
      count(*) AS runs FROM canon WHERE status <> 'completed' GROUP BY ALL""",
)
def failure_label(t: Tables) -> DataFrame:
    return C.failure_counts(canonical(t))


@query(
    "distinct_keys",
    f"""WITH {V.RUNS_SQL} SELECT benchmark, platform, count(*) AS prompts FROM
      (SELECT DISTINCT benchmark, prompt, platform FROM runs) GROUP BY ALL""",
)
def distinct_keys(t: Tables) -> DataFrame:
    return (
        V.runs(t).select(*C.GROUP).distinct().groupBy("benchmark", "platform").agg(F.count(F.lit(1)).alias("prompts"))
    )


PLAN_SQL = f"""{V.CANON_SQL}, {V.contrast_sql(RUN_CONTRASTS)},
planned AS (SELECT l.benchmark, l.prompt, l.platform, c.left_condition, c.right_condition, l.path AS left_path, r.path AS right_path
  FROM contrasts c JOIN canon l ON l.condition = c.left_condition AND l.status = 'completed'
  JOIN canon r ON r.condition = c.right_condition AND r.status = 'completed'
    AND r.benchmark = l.benchmark AND r.prompt = l.prompt AND r.platform = l.platform)"""


def planned(t: Tables) -> DataFrame:
    return C.plan_pairs(canonical(t), V.contrast_table(t, RUN_CONTRASTS))


@query("plan_pairs", f"WITH {PLAN_SQL} SELECT * FROM planned")
def plan_pairs(t: Tables) -> DataFrame:
    return planned(t)


@query(
    "pending_jobs",
    f"""WITH {PLAN_SQL} SELECT benchmark, platform, left_condition, right_condition,
      CASE WHEN CAST(left_path AS BIGINT) % 3 = 0 THEN 'skipped' WHEN CAST(left_path AS BIGINT) % 3 = 1 THEN 'orphan' ELSE 'pending' END AS state,
      count(*) AS jobs FROM planned GROUP BY ALL""",
)
def pending_jobs(t: Tables) -> DataFrame:
    runs = V.runs(t).select(F.col("path").alias("left_path"), (F.col("run_no") % 3).alias("kind"))
    jobs = C.pending_jobs(
        planned(t), runs.filter("kind = 0"), runs.filter("kind <= 1"), ["left_path"]
    )
    return jobs.groupBy("benchmark", "platform", "left_condition", "right_condition", "state").agg(
        F.count(F.lit(1)).alias("jobs")
    )


@query(
    "plan_native_jobs",
    f"""WITH {V.CANON_SQL} SELECT benchmark, CASE benchmark WHEN '1-URGENT' THEN 'native-pointwise' ELSE 'native-checklist' END AS task,
      count(*) AS jobs FROM canon WHERE status = 'completed' AND benchmark IN ('1-URGENT', '2-HIGH') GROUP BY ALL""",
)
def plan_native_jobs(t: Tables) -> DataFrame:
    config = t.spark.sql(
        "SELECT * FROM VALUES ('1-urgent', 'native-pointwise'), ('2-high', 'native-checklist') AS c(target, task)"
    )
    return C.plan_native_jobs(canonical(t), config).groupBy("benchmark", "task").agg(
        F.count(F.lit(1)).alias("jobs")
    )


@query(
    "join_scores_to_runs",
    f"""WITH {V.CANON_SQL}, art AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag FROM lineitem GROUP BY ALL),
    src AS (SELECT *, l_orderkey AS s1, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_orderkey + 7 * l_linenumber END AS s2 FROM art),
    kept AS (SELECT a.benchmark, a.condition AS first_condition, coalesce(b.condition, '') AS second_condition
      FROM src JOIN canon a ON a.run_no = s1 AND a.status = 'completed'
      LEFT JOIN canon b ON b.run_no = s2 AND b.status = 'completed' WHERE s2 IS NULL OR b.run_no IS NOT NULL)
    SELECT benchmark, first_condition, second_condition, count(*) AS artifacts FROM kept GROUP BY ALL""",
)
def join_scores_to_runs(t: Tables) -> DataFrame:
    digest = lambda c: sha256_hex(F.concat(F.lit("run:"), c.cast("string")))
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"]
    first, second = F.col("l_orderkey"), F.col("l_orderkey") + 7 * F.col("l_linenumber")
    artifacts = t.lineitem.select(*key).distinct().withColumn(
        "source_digests",
        F.when(F.col("l_returnflag") == "R", F.array(digest(first))).otherwise(
            F.array(digest(first), digest(second))
        ),
    )
    # a run is shuffled whole to find the latest one, so only what is read goes there
    columns = V.runs(t).select(*C.RUN_KEY, "status", "started_at", "path", "run_no")
    runs = C.canonical_runs(columns).withColumn("manifest_digest", digest(F.col("run_no")))
    joined = C.join_scores_to_runs(artifacts, runs, key, ["benchmark", "condition"])
    sources = F.col("sources")
    return joined.groupBy(
        sources[0]["benchmark"].alias("benchmark"),
        sources[0]["condition"].alias("first_condition"),
        F.coalesce(F.get(sources, F.lit(1))["condition"], F.lit("")).alias("second_condition"),
    ).agg(F.count(F.lit(1)).alias("artifacts"))


@query(
    "verify_prompt_refs",
    f"""WITH {V.RUNS_SQL} SELECT benchmark, coalesce(CASE WHEN d.doc_id IS NULL THEN 'unknown_prompt'
        WHEN run_no % 11 = 0 THEN 'manifest_hash_mismatch' WHEN run_no % 7 = 0 THEN 'prompt_hash_mismatch' END, 'ok') AS reason,
      count(*) AS runs FROM runs LEFT JOIN documents d ON d.doc_id = CAST(floor(run_no / 10) AS BIGINT) GROUP BY ALL""",
)
def verify_prompt_refs(t: Tables) -> DataFrame:
    hashed = lambda c: sha256_hex(F.concat(F.lit("prompt:"), c.cast("string")))
    prompts = t.documents.select(
        F.col("doc_id").alias("prompt_id"), hashed(F.col("doc_id")).alias("hash"), F.lit("v1").alias("manifest_hash")
    )
    ref = F.floor(F.col("run_no") / 10).cast("bigint")
    runs = V.runs(t).select(
        "benchmark",
        ref.alias("prompt_ref"),
        F.when(F.col("run_no") % 11 == 0, "v0").otherwise("v1").alias("manifest_ref_hash"),
        F.when(F.col("run_no") % 7 == 0, "stale").otherwise(hashed(ref)).alias("prompt_ref_hash"),
    )
    return (
        C.verify_prompt_refs(runs, prompts)
        .groupBy("benchmark", F.coalesce("reject_reason", F.lit("ok")).alias("reason"))
        .agg(F.count(F.lit(1)).alias("runs"))
    )


# attempts text, start and end of a run
TIMED_COLUMNS = [
    *V.RUN_COLUMNS,
    """CASE WHEN o_orderkey % 3 = 0 THEN concat('[{"n": 1, "duration_seconds": ', CAST(o_custkey % 50 AS VARCHAR(9)),
      '.5, "note": "x"}, {"n": 2, "steps": [{"elapsed": ', CAST(o_custkey % 20 AS VARCHAR(9)), '}, {"duration": -4}]}]')
      WHEN o_orderkey % 3 = 1 THEN '[{"n": 1, "steps": []}]' END AS attempts_json""",
    "CAST(floor(o_totalprice) AS BIGINT) % 1000 - 100 AS span",
]
TIMED_SQL = (
    "timed_runs AS (SELECT " + ", ".join(TIMED_COLUMNS) + """ FROM orders),
timed AS (SELECT *, CASE WHEN run_no % 3 = 0 THEN cust % 50 + 0.5 + cust % 20 WHEN span >= 0 THEN CAST(span AS DOUBLE) END AS seconds FROM timed_runs)"""
)


def timed_runs(t: Tables) -> DataFrame:
    columns = [c.replace("timed out\nsee", "timed out\\nsee") for c in TIMED_COLUMNS]
    runs = t.orders.selectExpr(*columns)
    updated = F.expr("timestampadd(SECOND, span, started_at)")
    return runs.withColumn(
        "seconds", C.elapsed_seconds(F.col("attempts_json"), F.col("started_at"), updated)
    )


@query(
    "elapsed_seconds",
    f"""WITH {TIMED_SQL} SELECT benchmark, condition, count(*) AS runs, count(seconds) AS timed_runs,
      {r6('sum(seconds)')} AS total_seconds FROM timed GROUP BY ALL""",
)
def elapsed_seconds(t: Tables) -> DataFrame:
    return timed_runs(t).groupBy("benchmark", "condition").agg(
        F.count(F.lit(1)).alias("runs"),
        F.count("seconds").alias("timed_runs"),
        round6(F.sum("seconds")).alias("total_seconds"),
    )


@query(
    "timing",
    f"""WITH {TIMED_SQL} SELECT condition, CAST(round_even(avg(seconds), 0) AS BIGINT) AS mean_seconds,
      CAST(round_even(quantile_cont(seconds, 0.5), 0) AS BIGINT) AS median_seconds FROM timed WHERE seconds IS NOT NULL GROUP BY ALL""",
)
def timing(t: Tables) -> DataFrame:
    return C.timing(timed_runs(t))


@query(
    "expected_vs_observed_ids",
    """SELECT lang, count(*) AS expected, count(d2.doc_id) AS observed FROM documents d
      LEFT JOIN (SELECT doc_id FROM labels) d2 USING (doc_id) GROUP BY lang""",
)
def expected_vs_observed_ids(t: Tables) -> DataFrame:
    wanted = t.documents.select("doc_id", "lang")
    found = t.labels.select("doc_id").distinct().withColumn("hit", F.lit(1))
    return wanted.join(found, "doc_id", "left").groupBy("lang").agg(
        F.count(F.lit(1)).alias("expected"), F.count("hit").alias("observed")
    )


@query(
    "ordered_report",
    f"""WITH {V.CANON_SQL} SELECT benchmark, platform, condition, count(*) AS run_count FROM canon
      GROUP BY ALL ORDER BY benchmark, platform, condition""",
)
def ordered_report(t: Tables) -> DataFrame:
    cells = C.completion(canonical(t)).select("benchmark", "platform", "condition", "run_count")
    return cells.orderBy("benchmark", "platform", "condition")
