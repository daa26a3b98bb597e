import pytest
from pyspark.sql import functions as F

from pairlens.operators import canon as C
from pairlens.operators import models as M
from pairlens.operators import pairs as P

RECORD = (
    "benchmark string, platform string, prompt string, left_condition string, right_condition string, "
    "judge_id string, presentation string, winner string"
)


def records(spark, outcomes, judge="j"):
    """``outcomes`` lists (A|B winner, B|A winner) per prompt; None leaves a side out."""
    rows = []
    for i, pair in enumerate(outcomes):
        for shown, winner in zip(P.PRESENTATIONS, pair):
            if winner:
                rows.append(("b", "x", f"p{i}", "A4", "A1", judge, shown, winner))
    return spark.createDataFrame(rows, RECORD)


def verdicts(df):
    shown = (F.col("winner") == "A") == (F.col("presentation") == "A|B")
    outcome = F.when(F.col("winner") == "tie", "tie").when(shown, F.col("left_condition")).otherwise(F.col("right_condition"))
    return P.pair_verdicts(P.sides(df.withColumn("outcome", outcome)))


def test_collapsed_and_record_counts(spark):
    v = verdicts(records(spark, [("A", "B"), ("B", "A"), ("A", "A"), ("tie", "A")]))
    cell = P.prompt_collapsed(v).first()
    assert (cell.wins, cell.losses, cell.ties, cell.presentation_disagreements) == (1, 1, 2, 2)
    pooled = P.record_pooled(v).first()
    assert (pooled.wins, pooled.losses, pooled.ties) == (3, 4, 1)
    report = {r.estimand: r for r in P.pairwise_report(v).collect()}
    assert report["prompt_collapsed"].p_raw == 1.0
    assert (report["record_pooled"].wins, report["record_pooled"].ties) == (3, 1)
    assert round(report["prompt_collapsed"].wilson_low, 12) == 0.094531205734


def test_winner_with_tie_is_a_tie(spark):
    v = verdicts(records(spark, [("A", "tie")] * 12))
    assert P.prompt_collapsed(v).first().ties == 12
    pooled = P.pairwise_report(v).filter("estimand = 'record_pooled'").first()
    assert (pooled.wins, pooled.losses) == (12, 0)
    assert abs(pooled.p_raw - 0.00048828125) < 1e-15


def test_across_judges(spark):
    one = records(spark, [("A", "B"), ("A", "B"), ("B", "A"), ("A", "B")], "j1")
    two = records(spark, [("A", "B"), ("A", "B"), ("B", "A"), ("B", "A")], "j2")
    cell = P.prompt_collapsed(verdicts(one.unionByName(two))).first()
    assert (cell.wins, cell.losses, cell.ties) == (2, 1, 1)
    assert (cell.judge_disagreements, cell.judge_prompt_observations) == (1, 8)


def test_incomplete_and_repeated_sides_are_dropped(spark):
    df = records(spark, [("A", None), ("A", "B")]).unionByName(records(spark, [(None, None), ("A", None)]))
    assert verdicts(df).count() == 0


def test_flip_symmetry(spark):
    cells = spark.createDataFrame(
        [("b", "x", "A4", "A1", 7, 3, 2, 0.7, 0.4, 0.9)],
        "benchmark string, platform string, left_condition string, right_condition string, wins bigint, losses bigint, ties bigint, win_rate double, wilson_low double, wilson_high double",
    )
    wanted = spark.createDataFrame([("A1", "A4")], "left_condition string, right_condition string")
    row = P.orient(cells, wanted).first()
    assert (row.wins, row.losses, round(row.win_rate, 9), round(row.wilson_low, 9), round(row.wilson_high, 9)) == (3, 7, 0.3, 0.1, 0.6)


def test_order_mapping_rules(spark):
    entry = "struct<presentation:string,first_output:string,second_output:string>"
    rows = [
        ([], "A|B", "A", "x"),
        ([], "B|A", "A", "y"),
        ([("A|B", "compare_run", "first_run")], "A|B", "A", "y"),
        ([("A|B", "compare_run", "first_run")], "B|A", "A", "x"),
        ([], "A|B", "tie", "tie"),
    ]
    df = spark.createDataFrame(rows, f"m array<{entry}>, presentation string, winner string, want string")
    got = df.withColumn(
        "got", P.semantic_winner(F.col("winner"), F.col("presentation"), F.col("m"), F.array(F.lit("x"), F.lit("y")))
    )
    assert got.filter("got <> want").count() == 0
    good = [("A|B", "first_run", "compare_run"), ("B|A", "compare_run", "first_run")]
    cases = [(good, None), (good[:1], "bad"), ([good[0], good[0]], "bad"), ([good[0], ("B|A", "first_run", "compare_run")], "bad"), (None, "bad")]
    checked = spark.createDataFrame(cases, f"m array<{entry}>, want string").withColumn(
        "reason", P.strict_mapping_reason(F.col("m"))
    )
    assert all((r.reason is None) == (r.want is None) for r in checked.collect())


def test_canonical_run_prefers_completed_then_latest(spark):
    rows = [
        ("b", "A1", "p", "x", "failed", "2024-03-01", "r3"),
        ("b", "A1", "p", "x", "completed", "2024-01-01", "r1"),
        ("b", "A1", "p", "x", "completed", "2024-02-01", "r2"),
        ("b", "A2", "p", "x", "failed", "2024-01-01", "r4"),
        ("b", "A2", "p", "x", "unknown", "2024-01-01", "r5"),
    ]
    df = spark.createDataFrame(
        rows, "benchmark string, condition string, prompt string, platform string, status string, started_at string, path string"
    )
    assert {r.condition: r.path for r in C.canonical_runs(df).collect()} == {"A1": "r2", "A2": "r5"}


def test_missing_pairs(spark):
    runs = spark.createDataFrame(
        [("b", "x", "p1")] * 6 + [("b", "x", "p2")], "benchmark string, platform string, prompt string"
    )
    contrasts = spark.createDataFrame([("A4", f"A{i}") for i in range(5)], "left_condition string, right_condition string")
    scored = verdicts(records(spark, [None, ("A", "B")][1:]).withColumn("prompt", F.lit("p1")))
    row = P.missing_pairs(runs, contrasts, scored).first()
    assert (row.expected_pairs, row.scored_pairs, row.missing_pairs) == (10, 1, 9)


def games(spark, rows):
    return spark.createDataFrame(
        [("g", *r) for r in rows], "g string, left_condition string, right_condition string, result string"
    )


def test_bradley_terry(spark):
    rows = [("A4", "A1", "left")] * 2 + [("A1", "A4", "left"), ("A4", "A2", "left"), ("A2", "A4", "left"), ("A4", "A2", "tie")]
    fits = {r.condition: r for r in M.bradley_terry(games(spark, rows), ["g"]).collect()}
    assert {f.status for f in fits.values()} == {"ok"}
    assert fits["A4"].strength > fits["A1"].strength
    only_wins = M.bradley_terry(games(spark, [("A4", "A1", "left")] * 2), ["g"]).collect()
    assert {r.status for r in only_wins} == {"complete separation"}


def test_logistic_meets_the_odds_of_two_groups(spark):
    """With one point at x = 0 and one at x = 1 the fit has a closed form: log odds and their difference."""
    import math

    counts = {("g", 0.0): (30.0, 10.0), ("g", 1.0): (7.0, 21.0), ("h", 0.0): (5.0, 5.0), ("h", 1.0): (8.0, 2.0)}
    rows = [(g, x, y, n) for (g, x), pair in counts.items() for y, n in zip((1.0, 0.0), pair)]
    rows += [("flat", 2.0, 1.0, 3.0), ("flat", 2.0, 0.0, 1.0)]
    fits = {r.g: r for r in M.fit_logistic(spark.createDataFrame(rows, "g string, x double, y double, weight double"), ["g"]).collect()}
    for g in ("g", "h"):
        at = [math.log(counts[g, x][0] / counts[g, x][1]) for x in (0.0, 1.0)]
        assert fits[g].status == "ok"
        assert abs(fits[g].intercept - at[0]) < 1e-6 and abs(fits[g].slope - (at[1] - at[0])) < 1e-6
    assert fits["flat"].status == "singular"


def test_mean_strengths_need_every_judge(spark):
    fits = spark.createDataFrame(
        [("x", "j1", "ok", "A4", 2.0), ("x", "j2", "ok", "A4", 4.0), ("y", "j1", "ok", "A4", 2.0), ("y", "j2", "complete separation", "A4", None)],
        "cell string, judge_id string, status string, condition string, strength double",
    )
    assert {r.cell: r.strength for r in M.mean_strengths(fits, ["cell"]).collect()} == {"x": 3.0, "y": None}


def test_cluster_bootstrap_brackets_the_fit(spark):
    import math
    import random

    rng = random.Random(11)
    rows = []
    for i in range(400):
        x = rng.choice([-0.6, -0.2, 0.3, 0.7])
        rows.append(("A4", "A1", "b", f"p{i // 2}", x, float(rng.random() < 1 / (1 + math.exp(-(0.5 + 1.5 * x))))))
    points = spark.createDataFrame(
        rows, "left_condition string, right_condition string, benchmark string, prompt string, x double, y double"
    )
    row = M.logistic_cluster_bootstrap(points, 20, 3).first()
    assert (row.status, row.decided_pairs, row.prompts) == ("ok", 400, 200)
    assert row.slope_low < row.slope < row.slope_high
    assert row.equal_length_preference_low < row.equal_length_preference < row.equal_length_preference_high


def test_covariate_fit_recovers_a_linear_rule(spark):
    from pairlens.operators import protocol as X

    rows = [(2.0 + (3.0 if c == "a" else 0.0) + 0.5 * x, c, float(x)) for c in "ab" for x in range(10)]
    fit = X.covariate_adjusted_fit(spark.createDataFrame(rows, "y double, c string, x double"), "y", ["c"], ["x"])
    got = {r.term: round(r.coefficient, 6) for r in fit.collect()}
    assert got == {"intercept": 2.0, "c=a": 3.0, "x": 0.5}


def test_covariate_fit_reads_its_rows_once(spark):
    """However many stages the fit has, its input is computed one time; equal rows weigh as often as they occur."""
    from pairlens.operators import protocol as X

    read = spark.sparkContext.accumulator(0)

    def seen(x):
        read.add(1)
        return x

    noise = (0.25, -0.25, 0.0)
    rows = [(2.0 + (3.0 if c == "a" else 0.0) + 0.5 * x + noise[k], c, float(x)) for c in "ab" for x in range(10) for k in (0, 1, 2, 2)]
    df = spark.createDataFrame(rows, "y double, c string, x double")
    counted = df.withColumn("y", F.udf(seen, "double").asNondeterministic()("y"))
    got = {r.term: round(r.coefficient, 6) for r in X.covariate_adjusted_fit(counted, "y", ["c"], ["x"]).collect()}
    assert got == {"intercept": 2.0, "c=a": 3.0, "x": 0.5}
    assert read.value == len(rows)


def test_family_over_run_sets(spark):
    locked = [("A4", "A1"), ("A4", "A2")]
    wrong = [
        (("r1", "r2"), locked, None), (("r1", "r2", "r2"), locked, None), (("r1", "r2", "r3", "r4"), locked, None),
        (("r1", "r2", "r3"), locked[::-1], None), (("r1", "r2", "r3"), locked[:1], None), (("r1", "r2", "r3"), locked, "r9"),
    ]
    for runs, contrasts, current in wrong:
        with pytest.raises(ValueError):
            P.family_members(runs, contrasts, locked, current)
    members = P.family_members(("r1", "r2", "r3"), locked, locked, "r2")
    assert [m[3] for m in members] == [f"run-{i}:A4:{c}" for i in (1, 2, 3) for c in ("A1", "A2")]
    # a whole family, one that lacks a cell, and a cell of a run set outside
    rows = [("full", r, "A4", c, 0.01 * (1 + 2 * i + j)) for i, r in enumerate(("r1", "r2", "r3")) for j, c in enumerate(("A1", "A2"))]
    rows += [("part", "r1", "A4", "A1", 0.02), ("part", "r3", "A4", "A2", 0.5), ("part", "r9", "A4", "A1", 0.001)]
    cells = spark.createDataFrame(rows, "benchmark string, run_set string, left_condition string, right_condition string, p_raw double")
    got = {(r.benchmark, r.member): r for r in P.holm_over_runs(cells, members, ["benchmark"]).collect()}
    assert len(got) == 8
    full = [got["full", m[3]] for m in members]
    assert all(r.complete and r.family_size == 6 for r in full)
    running, want = 0.0, []
    for place, r in enumerate(full):
        running = max(running, min(1.0, (6 - place) * r.p_raw))
        want.append(running)
    assert [r.p_holm for r in full] == pytest.approx(want)
    part = {m: got["part", m] for m in ("run-1:A4:A1", "run-3:A4:A2")}
    assert not any(r.complete for r in part.values()) and {r.family_size for r in part.values()} == {2}
    assert part["run-1:A4:A1"].p_holm == pytest.approx(0.04) and part["run-3:A4:A2"].p_holm == pytest.approx(0.5)
