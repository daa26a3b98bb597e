import json

from pyspark.sql import functions as F

from pairlens.functions import text as X
from pairlens.operators import contracts as K
from pairlens.operators import prompts as T
from pairlens.operators import sampling as M
from pairlens.operators.quality import DIMENSIONS


def pointwise(**changes):
    value = {
        "prompt_id": "p", "condition_id": "c", "platform": "x", "judge_id": "j", "judge_family": "f",
        "scores": {d: 3 for d in DIMENSIONS},
        "evidence_quotes": [{"dimension": d, "quote": "a quote"} for d in DIMENSIONS],
        "judge_level_composite": 3.0, "uncertainties": [],
    }
    value.update(changes)
    return json.dumps({k: v for k, v in value.items() if v != "DROP"})


def checked(spark, values):
    meta = {"prompt_id": "p", "condition_id": "c", "platform": "x", "judge_id": "j", "judge_family": "f"}
    df = spark.createDataFrame(list(enumerate(values)), "i int, value string").select(
        "*", F.array(F.lit("here is a quote in text")).alias("texts"), *[F.lit(v).alias(f"expected_{k}") for k, v in meta.items()]
    )
    return [r.reject_reasons for r in K.validate_pointwise(df).orderBy("i").collect()]


def test_pointwise_contract(spark):
    scores = {d: 3 for d in DIMENSIONS}
    first = DIMENSIONS[0]
    got = checked(
        spark,
        [
            pointwise(),
            pointwise(scores={**scores, first: 6}),
            pointwise(scores={**scores, first: True}),
            pointwise(scores={**scores, first: "3"}),
            pointwise(scores={**scores, "more": 1}),
            pointwise(platform="y"),
            pointwise(prompt_id=5),
            pointwise(extra=1),
            pointwise(uncertainties="DROP"),
            pointwise(evidence_quotes=[{"dimension": d, "quote": "absent"} for d in DIMENSIONS]),
            pointwise(judge_level_composite="3"),
            "not json",
        ],
    )
    assert got[0] == []
    assert all(r == ["scores"] for r in got[1:5])
    assert got[5] == ["platform"] and got[6] == ["prompt_id"] and got[7] == ["fields"]
    assert got[8] == ["fields", "uncertainties"] and got[9] == ["quote_not_found"] and got[10] == ["composite"]
    assert "fields" in got[11]


def test_checklists_as_python_literals(spark):
    item = {"checklist_id": 0, "reason": "it's \"so\" \\ [é]\n{x: 'y'}", "evaluation_score": 0.5}
    good = [str([item]), str({"items": [item]}), repr([{**item, "checklist_id": "0"}]), "  [" + repr(item) + ",]  ", repr([{**item, "evaluation_score": "0.5"}])]
    bad = {
        str((item,)): "not_a_list",
        str({"a": [item], "b": []}): "not_a_list",
        "[" + str(item).replace("0.5", "true") + "]": "not_a_list",
        "[" + str(item).replace("0.5", "open('x')") + "]": "not_a_list",
        str([(1, 2)]): "item_fields",
        str([{**item, "evaluation_score": True}]): "evaluation_score",
        str([{**item, "checklist_id": True}]): "checklist_id",
        str([{**item, "reason": None}]): "reason",
        str([{**item, "reason": ("a",)}]): "reason",
        str([{**item, 5: 1}]): "item_fields",
        "[" * 5000: "not_a_list",
    }
    texts = [*good, *bad, str([item]) + " " * 200_000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, value string")
    rows = K.parse_checklist(df).orderBy("i").collect()
    for r in rows[: len(good)]:
        assert r.reject_reasons == [] and tuple(r["items"][0])[:3] == (0, item["reason"], 0.5)
    for r, reason in zip(rows[len(good) : -1], bad.values()):
        assert reason in r.reject_reasons, r
    assert "too_long" in rows[-1].reject_reasons


def test_checklist_forms(spark):
    item = {"checklist_id": 0, "reason": "r", "evaluation_score": 0.5}
    values = [
        json.dumps([item]), json.dumps({"items": [item]}), str([item]), json.dumps([{**item, "checklist_id": "0"}]),
        json.dumps([{**item, "reason": 4}]), json.dumps([{**item, "evaluation_score": True}]), "hello", json.dumps([1]),
    ]
    df = spark.createDataFrame(list(enumerate(values)), "i int, value string")
    rows = K.parse_checklist(df).orderBy("i").collect()
    assert [r.reject_reasons == [] for r in rows] == [True] * 4 + [False] * 4
    assert rows[3]["items"][0].checklist_id == 0
    assert rows[4].reject_reasons == ["reason"] and rows[6].reject_reasons == ["not_a_list"]


def test_text_measures(spark):
    texts = ["one two\nthree", "中文 mixed-script", "pre中post", "a b　c", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.orderBy("i").select(X.output_units(F.col("t")), X.word_count(F.col("t"))).collect()
    assert [r[0] for r in rows] == [3, 3, 3, 3, 0]
    assert [r[1] for r in rows] == [len(t.split()) for t in texts]
    asked = ["write 1,200 words or 900-word", "写500字", "12 words", "3000 Tokens", "x"]
    df = spark.createDataFrame([(i, t, '["at least 2500 words", "800字"]' if i == 4 else "[]") for i, t in enumerate(asked)], "i int, t string, c string")
    got = [r[0] for r in df.orderBy("i").select(X.requested_length(F.col("t"), F.col("c"))).collect()]
    assert got == [1200, 500, 0, 3000, 2500]


def test_ids_and_lists(spark):
    row = spark.range(1).select(
        (X.pair_id(F.lit("a"), F.lit("b")) == X.pair_id(F.lit("b"), F.lit("a"))).alias("same"),
        X.prompt_category(F.lit("hello-open_qa_12")).alias("category"),
        X.numbered_list(F.array(F.lit("one\ntwo"), F.lit("x"))).alias("listed"),
        X.event_name(F.lit("--Web Search!")).alias("name"),
        X.redact(F.lit("Ann and ANN"), {"ann": "someone"}).alias("text"),
    ).first()
    assert row.same and row.category == "open_qa" and row.name == "web_search"
    assert row.listed == "1. one\n   two\n2. x" and row.text == "someone and someone"


def test_leak_lines(spark):
    df = spark.createDataFrame([("p/a", "x\ny\nSecret"), ("p/secret", "none"), ("p/b", "ok")], "path string, text string")
    assert {(r.path, r.line) for r in T.leak_scan(df, ["secret"]).collect()} == {("p/a", 3), ("p/secret", 0)}


def test_leak_scan_against_plain_search(spark):
    texts = ["", "abcabc\n\nAB", "İstanbul\nß ab", "x\n" * 50 + "BCA", None, "a\n\nb c", "ab" * 2000 + "\nca"]
    paths = ["p/AB", "q", None, "bca/ß", "r\n", "s", "İ/t"]
    terms = ["AB", "bca", "ab", "ß", "İ", "\nca", "missing", "", "AB", "b c"]
    df = spark.createDataFrame(list(zip(paths, texts)), "path string, text string").repartition(3)
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    want = []
    for path, text in zip(paths, texts):
        for term in terms:
            at = -1 if text is None else text.translate(fold).find(term.lower())
            if at >= 0:
                want.append((str(path), term, text[:at].count("\n") + 1))
            elif path is not None and term.lower() in path.lower():
                want.append((str(path), term, 0))
    got = sorted((str(r.path), r.term, r.line) for r in T.leak_scan(df, terms).collect())
    assert got == sorted(want)
    assert T.leak_scan(df, []).count() == 0 and T.leak_scan(df.limit(0), terms).count() == 0
    assert T.leak_scan(df, [""]).filter("line = 1").count() == 6


def test_quotas_and_pick(spark):
    rows = [("c", s, f"{s}{i}") for s, n in (("a", 50), ("b", 30), ("d", 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "cell string, s string, u string")
    sizes = df.groupBy("cell", "s").agg(F.count(F.lit(1)).alias("n"))
    quota = {r.s: r.quota for r in M.quotas(sizes, ["cell"], ["s"], 8).collect()}
    assert quota == {"a": 5, "b": 3, "d": 0}
    picked = M.stratified_pick(df, ["cell"], ["s"], "u", 8, 1)
    assert {r.s: r["count"] for r in picked.groupBy("s").count().collect()} == {"a": 5, "b": 3}


def test_disagreement_groups(spark):
    people = ["v", "w", "x", "y", "z"]

    def group(q, opinions, names, launch="launch-123456"):
        said = [(q, f"Is {q}?", launch, "r", p, o, "COMPLETED", i) for i, (p, o) in enumerate(zip(people, opinions))]
        rated = [(q, launch, p, [n], 10 - i) for i, (p, n) in enumerate(zip(people, names))]
        return said, rated

    mixed = ["AGREE", "DISAGREE", "NEUTRAL", "AGREE", "AGREE"]
    good, good_r = group("q1", ["o1", "o2\nmore", "o3", "o4", "o5"], mixed)
    same, same_r = group("q2", ["o1"] * 5, mixed)
    calm, calm_r = group("q3", ["o1", "o2", "o3", "o4", "o5"], ["AGREE"] * 5)
    void, void_r = group("q4", ["o1", "o2", "o3", "o4", "o5"], mixed)
    void.append(("q4", "Is q4?", "launch-123456", "r", "v", T.MISSING_OPINION, "COMPLETED", 99))
    opinions = spark.createDataFrame(
        good + same + calm + void,
        "question_id string, question_text string, launch_id string, round_id string, participant_id string, opinion string, status string, ordinal int",
    )
    ratings = spark.createDataFrame(
        good_r + same_r + calm_r + void_r, "question_id string, launch_id string, participant_id string, agreement array<string>, ordinal int"
    )
    row = T.disagreement_groups(opinions, ratings, 5, 1).collect()
    assert [r.prompt_id for r in row] == ["habermas-q1-launch-1"]
    # raters in the order of their first rating
    assert row[0].supplied_context == "1. o5\n2. o4\n3. o3\n4. o2\n   more\n5. o1"


def test_equal_literals_of_a_batch_are_read_once():
    """Judges repeat short answers; nulls and texts that are no literal keep their places."""
    import pandas as pd

    texts = ["{'a': 1}", None, "[1, (2,)]", "{'a': 1}", "no literal", None, " {'a': 1}"] * 3
    calls = []
    read = K.ast.literal_eval
    try:
        K.ast.literal_eval = lambda text: calls.append(text) or read(text)
        found = list(K.literal_json.func(pd.Series(texts, dtype=object)))
        assert list(K.literal_json.func(pd.Series([None, None], dtype=object))) == [None, None]
    finally:
        K.ast.literal_eval = read
    assert found == ['{"a": 1}', None, '[1, {"literal": "tuple"}]', '{"a": 1}', None, None, '{"a": 1}'] * 3
    assert len(calls) == 4
