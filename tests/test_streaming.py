import datetime as dt

from pyspark.sql import functions as F

from pairlens.operators import traces as R
from pairlens.streaming import jobs as J

SCHEMA = "run_id string, bucket int, ts timestamp, event_id int, event_type string, to_process string"


def rows(day, run, targets, start=0):
    base = dt.datetime(2024, 1, day)
    return [(run, i // 2, base + dt.timedelta(minutes=i), start + i, R.SWITCH, t) for i, t in enumerate(targets)]


def test_transitions_over_batches_equal_the_batch_twin(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    first = rows(1, "a", ["planning", "translating"]) + rows(1, "b", ["planning", None])
    second = [(r[0], r[1] + 9, r[2] + dt.timedelta(hours=1), r[3] + 50, *r[4:]) for r in rows(1, "a", ["reviewing"])]
    late = rows(9, "z", ["planning"], 100)
    folder = str(tmp_path / "in")
    for part in (first, second, late, rows(20, "y", ["planning"], 200)):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    everything = spark.read.parquet(folder)
    stream = J.read_events(spark, folder, everything.schema, 1)
    out = J.drain(J.stream_transitions(stream), str(tmp_path / "work"), "append")
    got = {(r.run_id, r.source, r.target) for r in out.collect()}
    closed = everything.filter(F.col("run_id").isin("a", "b"))
    want = {(r.run_id, r.source, r.target) for r in R.transitions(closed, ["run_id"]).collect()}
    assert {g for g in got if g[0] in ("a", "b")} == want


def test_quality_counts_late_events(spark, tmp_path):
    folder = str(tmp_path / "in")
    schema = "run_id string, pos int, at double, low double, high double"
    for part in ([("a", 1, 100.0, 50.0, 150.0), ("a", 2, None, 50.0, 150.0)], [("a", 3, 90.0, 50.0, 150.0), ("a", 4, 900.0, 50.0, 150.0)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = J.read_events(spark, folder, spark.read.parquet(folder).schema, 1)
    out = J.latest(J.drain(J.stream_trace_quality(stream), str(tmp_path / "work"), "update"), ["run_id"]).first()
    assert (out.events, out.unparseable, out.out_of_window, out.non_monotonic) == (4, 1, 1, 1)


def test_token_totals_and_quarantine(spark, tmp_path):
    folder = str(tmp_path / "in")
    base = dt.datetime(2024, 1, 1)
    part = [("k", "turn.completed", base + dt.timedelta(hours=i), 1, 2, 3) for i in range(4)]
    schema = "key string, type string, ts timestamp, input bigint, cached_input bigint, output bigint"
    for i in range(2):
        spark.createDataFrame(part[2 * i : 2 * i + 2], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = J.read_events(spark, folder, spark.read.parquet(folder).schema, 1)
    out = J.latest(J.drain(J.running_tokens(stream, ["key"]), str(tmp_path / "tokens"), "update"), ["window_start", "key"])
    row = out.first()
    assert (row.turns, row.input, row.cached_input, row.output) == (4, 4, 8, 12)

    def check(batch):
        late = F.col("ts") > F.lit("2024-01-01 01:30:00").cast("timestamp")
        return batch.withColumn("reject_reasons", F.array_compact(F.array(F.when(late, F.lit("late")))))

    target = str(tmp_path / "q")
    J.start_quarantine(stream, check, target).awaitTermination()
    assert spark.read.parquet(f"{target}/valid").count() == 2
    assert spark.read.parquet(f"{target}/rejected").count() == 2


def test_shuffled_files_give_the_transitions_of_the_batch_twin(spark, tmp_path):
    parts = [rows(1, "a", ["planning", "reviewing"]), rows(9, "z", ["planning"], 100), rows(20, "y", [], 200), rows(21, "y", ["planning"], 201)]
    # "a" again after its end: between and behind its switches; "c" never on time; "y" out of order but not late
    parts.append([("a", 0, dt.datetime(2024, 1, 1, 0, 0, 30), 60, R.SWITCH, "translating"), *rows(2, "c", ["planning", "planning"], 70)])
    parts.append([("y", 0, dt.datetime(2024, 1, 20, 23), 300, R.SWITCH, "reviewing")])
    folder = str(tmp_path / "in")
    for part in filter(None, parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    everything = spark.read.parquet(folder)
    live, late = J.drain_transitions(J.read_events(spark, folder, everything.schema, 1), str(tmp_path / "work"))
    out = J.settled(live, late)
    steps = lambda df: {(r.source, r.target): r.n for r in df.filter(F.col("target") != R.END).collect()}
    assert steps(out.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))) == steps(R.transitions(everything))
    assert {r.run_id for r in late.collect()} == {"a", "c"}
    assert [(r.run_id, r.source) for r in out.filter((F.col("target") == R.END) & (F.col("run_id") == "a")).collect()] == [("a", "reviewing")]


def test_late_turns_are_counted(spark, tmp_path):
    folder = str(tmp_path / "in")
    schema = "key string, type string, ts timestamp, input bigint, cached_input bigint, output bigint"
    for day in (1, 20, 1, 9, 20):
        spark.createDataFrame([("k", "turn.completed", dt.datetime(2024, 1, day, 5), 1, 2, 3)], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = J.read_events(spark, folder, spark.read.parquet(folder).schema, 1)
    out = J.latest(J.drain(J.running_tokens(stream, ["key"]), str(tmp_path / "tokens"), "update"), ["window_start", "key"])
    assert sorted((r.window_start.day, r.turns) for r in out.collect()) == [(1, 2), (9, 1), (20, 2)]


def test_runs_share_calls_and_keep_their_own_state(spark, tmp_path, monkeypatch):
    """One group holds all runs, a null one too: each has its own source, counts and end."""
    monkeypatch.setattr(J, "GROUPS", 1)
    names = ["a", "b", "c", None]
    parts = [
        [r for n in names for r in rows(1, n, ["planning", None])],
        [r for n in names[:2] for r in [(n, 0, dt.datetime(2024, 1, 1, 2), 50, R.SWITCH, "reviewing")]],
        rows(9, "z", ["planning"], 100),
        rows(20, "y", [], 200) or [("y", 0, dt.datetime(2024, 1, 20), 200, R.SWITCH, None)],
    ]
    folder = str(tmp_path / "in")
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    stream = J.read_events(spark, folder, spark.read.parquet(folder).schema, 1)
    out = J.drain(J.stream_transitions(stream), str(tmp_path / "work"), "append").collect()
    ended = {(r.run_id, r.source) for r in out if r.target == R.END}
    assert {("a", "reviewing"), ("b", "reviewing"), ("c", "planning"), (None, "planning")} <= ended
    assert len([r for r in out if r.target == R.END]) == len(ended)
    steps = sorted((str(r.run_id), r.source, r.target) for r in out if r.target != R.END)
    assert steps == sorted([*[(str(n), R.START, "planning") for n in [*names, "z"]], ("a", "planning", "reviewing"), ("b", "planning", "reviewing")])

    seen = stream.select("run_id", F.col("event_id").alias("pos"), (-F.col("event_id")).cast("double").alias("at"), F.lit(-1.0).alias("low"), F.lit(9.0).alias("high"))
    counts = J.latest(J.drain(J.stream_trace_quality(seen), str(tmp_path / "quality"), "update"), ["run_id"]).collect()
    got = {r.run_id: (r.events, r.unparseable, r.out_of_window, r.non_monotonic) for r in counts}
    assert got == {"a": (3, 0, 1, 2), "b": (3, 0, 1, 2), "c": (2, 0, 0, 1), None: (2, 0, 0, 1), "z": (1, 0, 1, 0), "y": (1, 0, 1, 0)}


def test_a_group_of_many_runs_takes_few_calls(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.range(20_000).selectExpr("concat('r', id) AS run_id", "id AS pos", "double(id) AS at", "0D AS low", "1e9 AS high").write.parquet(folder)
    stream = J.read_events(spark, folder, spark.read.parquet(folder).schema)
    groups = J._grouped(spark.read.parquet(folder)).count()
    assert groups.count() <= J.GROUPS < 20_000
    assert J.latest(J.drain(J.stream_trace_quality(stream), str(tmp_path / "work"), "update"), ["run_id"]).count() == 20_000
