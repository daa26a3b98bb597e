import json

import pytest
from pyspark.sql import functions as F

from pairlens.operators import canon as C
from pairlens.operators import transport as N
from pairlens.sources import files as S
from pairlens.sources import sinks as W


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def manifest(condition, status="completed", **inputs):
    return json.dumps(
        {"inputs": {"benchmark_name": "b", "condition_id": condition, "prompt_id": "p", **inputs}, "status": status, "started_at": "2024-01-01"}
    )


def test_scan_runs_and_join_scores(spark, tmp_path):
    write(tmp_path / "a/run-manifest.json", manifest("A1"))
    write(tmp_path / "b/run-manifest.json", manifest("A2", platform="other"))
    write(tmp_path / "c/run-manifest.json", "{broken")
    write(tmp_path / "d/run-manifest.json", json.dumps({"inputs": {"benchmark_name": "b", "condition_id": 3, "prompt_id": "p"}}))
    write(tmp_path / "e/run-manifest.json", manifest("A3", status="failed"))
    runs = S.scan_runs(spark, [str(tmp_path), str(tmp_path / "a")])
    got = {r.condition: r for r in runs.collect()}
    assert sorted(got) == ["A1", "A2", "A3"]
    assert got["A1"].platform == "codex" and got["A2"].platform == "other"

    source = lambda *cs: [{"run_manifest_sha256": got[c].manifest_digest if c else "sha256:none"} for c in cs]
    for name, sources in (("s1", source("A1")), ("s2", source("A1", "A2")), ("s3", source("A1", None)), ("s4", source("A3")), ("s5", [])):
        write(tmp_path / f"scores/{name}/scores-manifest.json", json.dumps({"task": "pairwise", "source_runs": sources}))
    scores = S.scan_score_manifests(spark, [str(tmp_path)]).select(
        F.element_at(F.split("path", "/"), -1).alias("artifact"),
        F.transform("source_runs", lambda s: s["run_manifest_sha256"]).alias("source_digests"),
    )
    joined = C.join_scores_to_runs(scores, runs, ["artifact"], ["condition"])
    assert {r.artifact: [s.condition for s in r.sources] for r in joined.collect()} == {"s1": ["A1"], "s2": ["A1", "A2"]}


def test_digests_are_joined_as_bytes(spark):
    hexed = "00ff" * 16
    texts = [hexed, hexed.upper(), "sha256:none", "0f0", "", "\x00" + hexed, bytes.fromhex("41" * 32).decode(), "41" * 32]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, d string")
    keys = [bytes(r.k) for r in df.select("i", C.digest_key(F.col("d")).alias("k")).orderBy("i").collect()]
    assert len(set(keys)) == len(texts)
    assert len(keys[0]) == 33
    runs = df.select(F.col("d").alias("manifest_digest"), F.lit("completed").alias("status"), "i")
    scores = df.select(F.col("i").alias("artifact"), F.array("d").alias("source_digests"))
    joined = C.join_scores_to_runs(scores, runs, ["artifact"], ["i"]).collect()
    assert sorted((r.artifact, [s.i for s in r.sources]) for r in joined) == [(i, [i]) for i in range(len(texts))]


def test_score_records_strict_and_tolerant(spark, tmp_path):
    good = json.dumps({"presentation": "A|B", "winner": "A"})
    write(tmp_path / "x/scores.jsonl", f"{good}\n[1]\n{good}\n")
    write(tmp_path / "y/scores.jsonl", f"{good}\n{{broken\n")
    assert S.scan_score_records(spark, [str(tmp_path)], True).count() == 2
    assert S.scan_score_records(spark, [str(tmp_path)], False).count() == 3


def test_trace_keeps_line_order_and_reports_bad_files(spark, tmp_path):
    lines = [json.dumps({"event_type": "process_switch", "to_process": x}) for x in ("planning", "translating")]
    write(tmp_path / "ok/process.jsonl", f"\n{lines[0]}\n\n{lines[1]}")
    write(tmp_path / "empty/process.jsonl", "\n \n")
    write(tmp_path / "bad/process.jsonl", f"{lines[0]}\nnope")
    events, problems = S.scan_trace(spark, [str(tmp_path)])
    assert [(r.pos, r.to_process) for r in events.orderBy("pos").collect()] == [(2, "planning"), (4, "translating")]
    reasons = {r.path.split("/")[-2]: r.reason for r in problems.collect()}
    assert reasons == {"empty": "empty", "bad": "bad_line"}


def test_lines_of_a_file_read_in_many_splits_keep_their_places(spark, tmp_path):
    lines = ["" if i % 7 == 3 else f"line {i}\u2028half {i}" if i % 11 == 5 else f"line {i}" for i in range(1, 3001)]
    write(tmp_path / "a/x.log", "\r\n".join(lines) + "\n")
    write(tmp_path / "b/x.log", "one\n\nthree")
    write(tmp_path / "c/x.log", "")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        split = S.scan_lines(spark, [str(tmp_path)], "*.log")
        assert split.rdd.getNumPartitions() > 1
        got = sorted((r.path[-7:], r.pos, r.line) for r in split.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    whole = S.split_lines(S.scan_text(spark, [str(tmp_path)], "*.log"))
    assert got == sorted((r.path[-7:], r.pos, r.line) for r in whole.collect())
    assert S.scan_paths(spark, [str(tmp_path)], "*.log").count() == 3


def test_durations_inside_a_duration_do_not_count(spark):
    from pairlens.operators.canon import recorded_seconds

    cases = [
        ('[{"duration": {"elapsed": 3}, "elapsed": 2}]', 2.0),
        ('{"a": {"b": [{"elapsed_seconds": "1.5"}, [{"duration": true}]]}, "duration": -4}', 2.5),
        ('{"duration": [{"elapsed": 9}], "x": {"duration_seconds": 1e1}}', 10.0),
        ('{"note": "say \\"elapsed\\": 5 {", "elapsed": null}', None),
        ("[]", None),
        (None, None),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = {r.i: r.s for r in df.select("i", recorded_seconds(F.col("t")).alias("s")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]


def test_attempt_events_and_delegation(spark, tmp_path):
    def event(kind, item_id, receivers, status="completed"):
        return json.dumps(
            {"type": kind, "item": {"id": item_id, "type": "collab_tool_call", "tool": "spawn_agent", "status": status, "receiver_thread_ids": receivers}}
        )

    text = "\n".join(
        [event("item.completed", "i1", ["t"]), event("item.completed", "i1", ["t"]), event("item.completed", "i2", []), event("item.started", "i3", ["t"]), "{bad", event("item.completed", " ", ["t"])]
    )
    write(tmp_path / "run/attempt-1.events.jsonl", text)
    row = N.spawn_count(N.parse_lines(S.scan_attempt_events(spark, [str(tmp_path)]))).first()
    assert (row.spawns, row.malformed) == (1, 1)


def test_prompt_manifest_checks(spark, tmp_path):
    row = lambda i, b="x": json.dumps({"prompt_id": i, "benchmark_name": b, "source_version": "v"})
    write(tmp_path / "good.jsonl", f"{row('1')}\n\n{row('2')}\n")
    write(tmp_path / "twice.jsonl", f"{row('1')}\n{row('1')}\n")
    write(tmp_path / "mixed.jsonl", f"{row('1')}\n{row('2', 'y')}\n")
    write(tmp_path / "none.jsonl", "\n")
    _, checks = S.scan_prompt_manifest(spark, [str(tmp_path)])
    valid = {r.path.rsplit("/", 1)[-1]: r.valid for r in checks.collect()}
    assert valid == {"good.jsonl": True, "twice.jsonl": False, "mixed.jsonl": False, "none.jsonl": False}


def test_checked_tables(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "`question.id` int, text string").write.parquet(str(tmp_path / "t"))
    assert S.scan_parquet_checked(spark, str(tmp_path / "t"), ["question.id"]).columns == ["question.id"]
    with pytest.raises(ValueError):
        S.scan_parquet_checked(spark, str(tmp_path / "t"), ["absent"])
    write(tmp_path / "key.csv", "comparison_id,units\nc1,5\nc2,x\n")
    rows = S.scan_csv_checked(spark, [str(tmp_path / "key.csv")], "comparison_id STRING, units INT, more STRING", ["comparison_id"])
    assert [tuple(r) for r in rows.orderBy("comparison_id").collect()] == [("c1", 5, None), ("c2", None, None)]
    with pytest.raises(ValueError):
        S.scan_csv_checked(spark, [str(tmp_path / "key.csv")], "a STRING", ["a"])


def test_prices(spark):
    texts = ['{"input": 1, "cached_input": 0.5, "output": 2}', '{"input": true, "cached_input": 0.5, "output": 2}', '{"input": 1}', '{"input": -1, "cached_input": 0, "output": 0}']
    rows = S.parse_prices(spark.createDataFrame([(t,) for t in texts], "value string")).collect()
    assert [r.valid for r in rows] == [True, False, False, False]


def test_source_hashes(spark, tmp_path):
    import hashlib

    write(tmp_path / "one.txt", "one")
    write(tmp_path / "two.txt", "two")
    pinned = spark.createDataFrame(
        [("one.txt", hashlib.sha256(b"one").hexdigest()), ("two.txt", "0"), ("three.txt", "0")], "path string, expected string"
    )
    got = {r.path: r.status for r in S.verify_source_hashes(spark, str(tmp_path), pinned).collect()}
    assert got == {"one.txt": "matched", "two.txt": "mismatched", "three.txt": "absent"}


def test_source_hashes_tell_folders_apart(spark, tmp_path):
    import hashlib

    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    write(tmp_path / "a" / "same.txt", "one")
    write(tmp_path / "b" / "same.txt", "two")
    pinned = spark.createDataFrame([(f"{d}/same.txt", hashlib.sha256(b"one").hexdigest()) for d in "ab"], "path string, expected string")
    got = {r.path: r.status for r in S.verify_source_hashes(spark, str(tmp_path), pinned).collect()}
    assert got == {"a/same.txt": "matched", "b/same.txt": "mismatched"}


def test_csv_with_another_column_order_is_an_error(spark, tmp_path):
    write(tmp_path / "1.csv", "comparison_id,preference\nc1,A\n")
    write(tmp_path / "2.csv", "preference,comparison_id\nB,c9\n")
    rows = S.scan_csv_checked(spark, [str(tmp_path)], "comparison_id STRING, preference STRING", ["comparison_id"])
    with pytest.raises(Exception, match="(?i)header"):
        rows.collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n int, t string")
    assert W.sink_immutable(df, str(tmp_path / "i")) == "written"
    assert W.sink_immutable(df.orderBy(F.desc("n")), str(tmp_path / "i")) == "unchanged"
    with pytest.raises(FileExistsError):
        W.sink_immutable(df.limit(1), str(tmp_path / "i"))
    assert W.sink_report(df, str(tmp_path / "r")).columns == ["n", "t"]
    with pytest.raises(Exception):
        W.sink_report(df, str(tmp_path / "r"))
    records = spark.createDataFrame(
        [("a", True, 2), ("a", True, 2), ("b", True, 2), ("c", False, 1)], "artifact string, valid boolean, expected int"
    )
    stored = W.sink_score_atomic(records, ["artifact"], "expected", str(tmp_path / "s"))
    assert {r.artifact for r in stored.collect()} == {"a"}


def test_readers_see_the_published_version_only(spark, tmp_path):
    """A writer that dies half-way, or before its manifest, changes nothing for readers."""
    schema, path = "artifact string, valid boolean, expected int", str(tmp_path / "scores")
    first = spark.createDataFrame([("a", True, 1)], schema)
    with pytest.raises(FileNotFoundError):
        W.read_published(spark, path)
    W.sink_score_atomic(first, ["artifact"], "expected", path)
    with pytest.raises(FileExistsError):
        W.sink_score_atomic(first, ["artifact"], "expected", path)

    second = spark.createDataFrame([(x, True, 1) for x in "abcdefgh"], schema).repartition(8)
    dies = second.withColumn("artifact", F.when(F.col("artifact") == "h", F.raise_error(F.lit("lost"))).otherwise(F.col("artifact")))
    with pytest.raises(Exception, match="lost"):
        W.sink_score_atomic(dies, ["artifact"], "expected", path, replace=True)
    second.write.parquet(f"{path}/data-without-manifest")
    (tmp_path / "scores" / "_draft-data-x").write_text("data-without-manifest")
    assert [r.artifact for r in W.read_published(spark, path).collect()] == ["a"]
    assert W.sink_score_atomic(second, ["artifact"], "expected", path, replace=True).count() == 8
    assert W.read_published(spark, path).count() == 8
    with pytest.raises(FileExistsError):
        W._publish(spark, path, 2, "data-of-a-second-writer")
    assert W.read_published(spark, path).count() == 8


def test_final_message(spark):
    said = {"type": "item.completed", "item": {"type": "agent_message", "text": "from item"}}
    outputs = {
        "plain": ["Dear reader,", "", "the end"],
        "empty": [""],
        "document": [json.dumps({"message": "m", "text": 5})],
        "result first": [json.dumps({"message": "m", "text": "t", "result": "r"})],
        "pretty": json.dumps({"note": [{"a": 1}], "message": "line\none"}, indent=1).split("\n"),
        "pretty but broken": json.dumps({"message": "m"}, indent=1).split("\n")[:-1],
        "events": [json.dumps(said), "not json", json.dumps({"result": "done"}), json.dumps({"usage": {}}), "7"],
        "item last": [json.dumps({"text": "early"}), json.dumps(said), json.dumps({"item": {"type": "tool", "text": "no"}})],
        "message key of a line is no event": [json.dumps({"message": "m"}), json.dumps({"message": "n"})],
        "array": [json.dumps([{"text": "t"}])],
        "number is no text": [json.dumps({"text": 5})],
        "blank lines around": ["", json.dumps({"text": "t"}), " "],
    }
    rows = [(k, i, v) for k, lines in outputs.items() for i, v in enumerate(lines)] + [("null", 0, None)]
    lines = spark.createDataFrame(rows, "path string, pos bigint, value string").repartition(4)
    for block in (1000, 2):
        found = {}
        for r in sorted(N.final_message(lines, block).collect(), key=lambda r: r.block):
            found.setdefault(r.path, [r.source, []])[1].append(r.message)
        raw = {k: ["raw", "\n".join(outputs[k])] for k in ("plain", "empty", "pretty but broken", "message key of a line is no event", "array", "number is no text")}
        assert {k: [source, "\n".join(parts)] for k, (source, parts) in found.items()} == {
            **raw,
            "null": ["raw", ""],
            "document": ["document", "m"],
            "result first": ["document", "r"],
            "pretty": ["document", "line\none"],
            "events": ["event", "done"],
            "item last": ["event", "from item"],
            "blank lines around": ["document", "t"],
        }


def test_retrieval_marker_depth_and_exclusions(spark):
    lines = {
        "direct": {"type": "web_search"},
        "deep": {"type": "x", "item": {"payload": [{"data": {"type": "Web-Fetch"}}]}},
        "tool": {"type": "tool_call", "name": "browser"},
        "command": {"type": "x", "item": {"type": "command_execution", "command": "run CURL now"}},
        "error": {"type": "error", "item": {"type": "web_search"}},
        "text": {"type": "message", "text": "use web_search", "note": {"type": "web_search"}},
        "quiet": {"type": "command_execution", "command": "ls", "item": {"type": "web_search"}},
    }
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in lines.items()], "k string, value string")
    got = {r.k: r.marker for r in N.retrieval_flags(df, ["k"]).collect()}
    assert got == {"direct": "web_search", "deep": "Web-Fetch", "tool": "browser", "command": "CURL"}


def test_retrieval_marker_order_and_odd_lines(spark):
    nested = {"type": "web_fetch"}
    for _ in range(400):
        nested = {"data": [nested]}
    lines = {
        "very deep": nested,
        "item before payload": {"payload": {"type": "ssh"}, "item": [{"type": "x"}, {"data": {"type": "nc"}}]},
        "outer before inner": {"type": "tool_call", "method": "wget", "item": {"type": "curl"}},
        "later field": {"type": 5, "event": "quiet", "event_type": "Browser Call"},
        "error by any case": {"Event_Type": "Turn-Failed", "item": {"type": "web_search"}},
        "error inside": {"type": "x", "data": [{"event": "error", "item": {"type": "ssh"}}, {"type": "socat"}]},
        "text like json": {"type": "x", "item": json.dumps({"type": "web_search"})},
        "command as list": {"type": "command_execution", "command": ["curl"], "cmd": "git  clone x"},
        "tool name of another kind": {"type": "x", "tool": "browser"},
        "word inside": {"type": "command_execution", "command": "curls fetcher"},
        "list line": [{"type": "web_search"}],
    }
    rows = [(k, 1, json.dumps(v)) for k, v in lines.items()] + [("null", 1, None), ("broken", 1, "{"), ("empty", 1, "")]
    df = spark.createDataFrame(rows + rows[:1], "k string, marker_no int, _text string").repartition(3)
    got = sorted((r.k, r.marker) for r in N.retrieval_flags(df, ["k", "marker_no"], "_text").collect())
    assert got == sorted([
        ("very deep", "web_fetch"), ("very deep", "web_fetch"), ("item before payload", "nc"), ("outer before inner", "wget"),
        ("later field", "Browser Call"), ("error inside", "socat"), ("command as list", "git  clone"),
    ])


def test_scanned_prices_and_hashes(spark, tmp_path):
    write(tmp_path / "a/prices.json", json.dumps({"input": 1, "cached_input": 0, "output": 2.5}))
    write(tmp_path / "b/prices.json", json.dumps({"input": 1, "output": -1, "cached_input": 0}))
    write(tmp_path / "c/prices.json", "{broken")
    write(tmp_path / "c/other.json", json.dumps({"input": 1, "cached_input": 0, "output": 2}))
    found = {r.path.split("/")[-2]: (r.valid, r.output) for r in S.scan_prices(spark, [str(tmp_path)]).collect()}
    assert found == {"a": (True, 2.5), "b": (False, -1.0), "c": (False, None)}
    pinned = spark.createDataFrame([("a/prices.json", "0"), ("gone", "0")], "path string, expected string")
    status = {r.path: r.status for r in S.verify_source_hashes(spark, str(tmp_path), pinned, "prices.json").collect()}
    assert status == {"a/prices.json": "mismatched", "b/prices.json": "unpinned", "c/prices.json": "unpinned", "gone": "absent"}


def test_csv_records_in_splits_equal_a_plain_reader(spark, tmp_path):
    """Quoted line breaks, doubled and stray quotes, over many small splits and small blocks of lines."""
    import csv
    import io
    import random

    random.seed(5)
    bits = ["a", "b c", "\n", '"', '""', ",", "\r\n", "x" * 40, "", "\n\n", '",', ',"', "é", "\\"]
    for number in range(3):
        rows = [("id", "said", "n")] + [(f"{number}-{i}", "".join(random.choices(bits, k=random.randint(0, 9))), str(i)) for i in range(400)]
        out = io.StringIO()
        csv.writer(out, lineterminator="\r\n" if number == 1 else "\n").writerows(rows)
        text = out.getvalue()
        if number == 2:
            text = "\ufeff" + text + '\n\n2-x,5" tall and "wide",7\n2-y,"open\nbut closed" tail,8\n2-z,""'
        with open(tmp_path / f"{number}.csv", "w", encoding="utf-8", newline="") as file:
            file.write(text)
    want = {}
    for number in range(3):
        with open(tmp_path / f"{number}.csv", encoding="utf-8-sig", newline="") as file:
            read = [row for row in csv.reader(file) if row]
        want.update({row[0]: row[1] for row in read[1:]})
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    blocks, S.BLOCK_LINES = S.BLOCK_LINES, 16
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        records = S.scan_csv_checked(spark, [str(tmp_path)], "id STRING, said STRING, n INT", ["id", "said"])
        got = records.collect()
        texts = {r.path[-5:] for r in S.csv_records(spark, [str(tmp_path)]).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
        S.BLOCK_LINES = blocks
    assert texts == {"0.csv", "1.csv", "2.csv"} and len(got) == len(want) == 1203
    odd = {"2-x", "2-y", "2-z"}
    assert {r.id: r.said or "" for r in got if r.id not in odd} == {k: v for k, v in want.items() if k not in odd}
    assert {r.id for r in got} == set(want)
    assert all(r.n == int(r.id.split("-")[1]) for r in got if r.id not in odd)


def test_packed_files_are_read_like_loose_ones(spark, tmp_path):
    texts = {"a/process.jsonl": '\n{"event_type": "x"}\n\n{"event_type": "y"}\n', "b/process.jsonl": '{"event_type": "x"}\nnope', "c/process.jsonl": "\n \n", "d/process.jsonl.old": "{}"}
    files = {**texts, "a/run-manifest.json": manifest("A1"), "b/run-manifest.json": "[", "a/prices.json": '{"input": 1, "cached_input": 0, "output": 2}', "b/prices.json": "{"}
    for path, text in files.items():
        write(tmp_path / "loose" / path, text)
    rows = spark.createDataFrame([(f"pack:/{k}", v) for k, v in files.items()], "path string, value string")
    pack = W.sink_pack(rows, str(tmp_path / "pack"))
    loose = [str(tmp_path / "loose")]

    def seen(df, *columns):
        return sorted((r.path.rstrip("/").split("/")[-2:] if "." in r.path.split("/")[-1] else r.path.split("/")[-1:], *[r[c] for c in columns]) for r in df.collect())

    for scan, columns in ((S.scan_runs, ["condition", "manifest_digest"]), (S.scan_prices, ["valid"])):
        assert seen(scan(spark, [], packs=[pack]), *columns) == seen(scan(spark, loose), *columns) != []
        assert scan(spark, loose, packs=[pack]).count() == 2 * scan(spark, loose).count()
    (events, problems), (want, refused) = S.scan_trace(spark, [], packs=[pack]), S.scan_trace(spark, loose)
    assert seen(events, "pos", "event_type") == seen(want, "pos", "event_type") != []
    assert seen(problems, "reason") == seen(refused, "reason") != []


def test_queries_over_small_files_create_no_file_per_document(spark, tmp_path, monkeypatch):
    from pairlens.plans import contract_queries, views
    from pairlens.plans.catalog import REGISTRY

    for module in (contract_queries, views):
        monkeypatch.setattr(module, "scratch_path", lambda _, name: str(tmp_path / name))
    for name in ("scan_prices", "scan_score_records"):
        REGISTRY[name](spark, "/root/testdata/sf0.001").collect()
    assert 0 < sum(p.is_file() for p in tmp_path.rglob("*")) < 50


def test_lines_are_placed_where_they_are_read(spark, tmp_path):
    write(tmp_path / "a/x.log", "one\n\nthree\n")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = S.scan_lines(spark, [str(tmp_path)], "*.log")
        plan = lines._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.pos, r.line) for r in lines.collect()) == [(1, "one"), (3, "three")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
