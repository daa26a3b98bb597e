import random

import pytest
from pyspark.sql import functions as F

from pairlens.operators import agreement as A
from pairlens.operators import traces as R

SCHEMA = "run_id string, bucket int, ts int, event_id int, event_type string, process string, to_process string"
ORDER = list(R.FIXED_ORDER)


def trace(spark, runs):
    rows = []
    for run, targets in runs.items():
        for i, target in enumerate(targets):
            kind = R.REGENERATION if target == "!" else R.SWITCH
            rows.append((run, i // 3, i, i, kind, "own", None if target in ("!", None) else target))
    return spark.createDataFrame(rows, SCHEMA)


def test_transitions_end_once(spark):
    p, t, r = ORDER
    for targets in ([p, t, r, None], [p, t, r, None, None, None]):
        got = {(x.source, x.target): x.n for x in R.transitions(trace(spark, {"a": targets})).collect()}
        assert got == {("START", p): 1, (p, t): 1, (t, r): 1, (r, "END"): 1}
        assert R.run_details(trace(spark, {"a": targets})).first().single_cycle_exact


def brute(targets, lead):
    seq = [x for x in targets if x not in (None, "!")]
    shift = bool(seq and lead == ORDER[0] and seq[0] != ORDER[0])
    full = [lead, *seq] if shift else seq
    collapsed = [x for i, x in enumerate(full) if i == 0 or x != full[i - 1]]
    k = len(ORDER)
    passes = len(collapsed) // k if collapsed and len(collapsed) % k == 0 and collapsed == ORDER * (len(collapsed) // k) else None
    repeated = {x for i, x in enumerate(full) if i and x == full[i - 1]}
    single = collapsed == ORDER and len(repeated) <= 1
    returns = sum(a == "reviewing" and b == "translating" for a, b in zip(seq, seq[1:]))
    return passes, full == ORDER, single, returns, targets.count("!"), shift


def test_run_details_against_brute_force(spark):
    rng = random.Random(5)
    p, t, r = ORDER
    runs = {"a": [p, t, r], "b": [p, p, t, r], "c": [p, p, t, t, r], "d": [t, r], "e": [None], "f": ["!", p, t, r, p, t, r]}
    for i in range(60):
        runs[f"x{i}"] = [rng.choice([p, t, r, r, None, "!"]) for _ in range(rng.randrange(1, 14))]
    lead = {k: rng.choice(["planning", "reviewing", None]) for k in runs}
    delegated = spark.createDataFrame(
        [(k, v) for k, v in lead.items() if v], "run_id string, first_delegated string"
    )
    for row in R.run_details(trace(spark, runs), (), delegated).collect():
        want = brute(runs[row.run_id], lead[row.run_id])
        got = (row.cycle_passes, row.single_cycle_exact, row.single_repeat, row.returns, row.regenerations, row.reconstructed)
        assert got == want, (row.run_id, runs[row.run_id], lead[row.run_id])


def test_regeneration_before_the_first_switch(spark):
    rows = R.regeneration_locations(trace(spark, {"a": ["!", "planning", "!"]})).collect()
    got = sorted((x.active_process, x.sequence_index) for x in rows if x.sequence_index) + [
        (x.active_process, x.sequence_index) for x in rows if x.sequence_index is None
    ]
    assert got == [("planning", 1), ("own", None)]


def test_after_state(spark):
    p, t, r = ORDER
    got = {x.next: (x.events, x.runs) for x in R.after_state(trace(spark, {"a": [p, t, r, t, r], "b": [r, r]})).collect()}
    assert got == {t: (1, 1), r: (1, 1), "termination": (2, 2)}


def whole(rows, *keys):
    """Sequences put together from their blocks, by the given columns."""
    out = {}
    for r in sorted(rows, key=lambda r: r.block):
        out.setdefault(tuple(r[k] for k in keys), []).append(r.sequence)
    return out


@pytest.mark.parametrize("block", [1, 5, 1000])
def test_long_sequences_come_whole(spark, block):
    long = ["planning", "translating"] * 20
    runs = {"a": long, "b": long, "c": long[:-1] + ["reviewing"], "d": ["reviewing"], "e": ["!"], "f": long[:-1]}
    df = trace(spark, runs).withColumn("condition", F.lit("x"))
    found = whole(R.process_sequences(df, block=block).collect(), "run_id", "length")
    assert {k: ">".join(v) for k, v in found.items()} == {(r, sum(x != "!" for x in s)): ">".join(x for x in s if x != "!") for r, s in runs.items()}
    shares = R.sequence_distribution(df, ["condition"], block).collect()
    parts = whole([r for r in shares if r.n == 2], "length", "n")
    assert {k: ">".join(v) for k, v in parts.items()} == {(40, 2): ">".join(long)}
    assert sum(r.n for r in shares if r.block == 0) == 6 and {r.total for r in shares} == {6}
    top = R.top_sequences(df, ["condition"], 4, block).collect()
    ranked = {k: ">".join(v) for k, v in whole(top, "rank").items()}
    assert [ranked[(i,)] for i in range(1, 5)] == [">".join(long), "", "reviewing", ">".join(long[:-1])]


def test_ties_beyond_the_first_block(spark):
    runs = {f"r{i}": ["planning"] * 6 + [name] for i, name in enumerate(["s", "p", "q", "o"])}
    top = R.top_sequences(trace(spark, runs).withColumn("condition", F.lit("x")), ["condition"], 2, 3).collect()
    assert [(r.rank, r.sequence) for r in sorted(top, key=lambda r: (r.rank, r.block)) if r.block == 2] == [(1, "o"), (2, "p")]


def test_timestamps(spark):
    events = spark.createDataFrame(
        [
            ("a", 0, 1, "2024-01-01T10:00:00+00:00"),
            ("a", 0, 2, "2024-01-01T10:00:00"),
            ("a", 0, 3, "2024-01-01T09:00:00+00:00"),
            ("a", 1, 4, "2024-01-01T09:30:00Z"),
            ("a", 1, 5, "nonsense"),
        ],
        "run_id string, bucket int, pos int, timestamp string",
    )
    runs = spark.createDataFrame(
        [("a", "2024-01-01T09:30:30+00:00", "2024-01-01T11:00:00+00:00")],
        "run_id string, started_at string, written_at string",
    )
    row = R.timestamp_plausibility(events, runs).first()
    assert (row.events, row.unparseable, row.out_of_window, row.non_monotonic, row.plausible) == (5, 2, 1, 1, False)


def test_exact_process_order(spark):
    contract = spark.sql(
        "SELECT 'A6' AS condition, array('planning','translating','reviewing') AS processes, array('process_switch') AS allowed, "
        "'forbidden' AS goal_policy, 3 AS min_events, 3 AS max_events, array('planning','translating','reviewing') AS process_order, false AS require_goal"
    )

    def run(name, targets):
        before = [None, *targets[:-1]]
        return [(name, "A6", i + 1, b, x, x) for i, (b, x) in enumerate(zip(before, targets))]

    rows = run("good", ORDER) + run("bad", [ORDER[1], ORDER[0], ORDER[2]]) + run("short", ORDER[:2]) + run("odd", ORDER)
    df = spark.createDataFrame(rows, "run_id string, condition string, pos int, from_process string, to_process string, process string")
    full = df.select(
        "*", F.lit("process_switch").alias("event_type"), F.lit("2024-01-01T00:00:00Z").alias("timestamp"),
        F.lit("m").alias("responsible_agent"), F.lit("d").alias("decision"), F.array(F.lit("e")).alias("evidence"),
        F.array(F.lit("u")).alias("open_uncertainty"), F.lit(None).cast("string").alias("goal_id"),
        *[F.lit(v).alias(f"has_{n}") for n, v in (("from_process", True), ("to_process", True), ("goal_id", False), ("parent_goal_id", False))],
        F.when(F.col("run_id") != "odd", F.array(F.lit("a"))).alias("artifacts"), (F.col("pos") == 2).alias("has_artifacts"),
    )
    got = {r.run_id: r.reject_reasons for r in R.trace_reasons(R.event_reasons(full, contract)).collect()}
    assert got["good"] == [] and got["bad"] == ["process_order"]
    assert set(got["short"]) == {"too_few_events", "process_order"} and got["odd"] == ["bad_event"]
    odd = {r.pos: r.reject_reasons for r in R.event_reasons(full, contract).filter("run_id = 'odd'").collect()}
    assert odd == {1: [], 2: ["artifacts"], 3: []}


def test_rater_coefficients(spark):
    rows = [("u1", v) for v in ("A4", "A4", "tie")] + [("u2", "A1")] * 3
    row = A.rater_agreement(spark.createDataFrame([("k", *r) for r in rows], "k string, u string, v string"), ["k"], "u", "v").first()
    assert abs(row.raw_agreement - 4 / 6) < 1e-12
    assert abs(row.fleiss_kappa - 5 / 11) < 1e-12
    assert abs(row.krippendorff_alpha - 6 / 11) < 1e-12


def test_cohen_kappa(spark):
    df = spark.createDataFrame(
        [("same", "x", "x"), ("same", "y", "y"), ("even", "x", "x"), ("even", "x", "y"), ("even", "y", "x"), ("even", "y", "y"), ("one", "x", "x")],
        "k string, a string, b string",
    )
    got = {r.k: r.kappa for r in A.cohen_kappa(df, ["k"], "a", "b", 1.0).collect()}
    assert got == {"same": 1.0, "even": 0.0, "one": 1.0}


def test_majority(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")], "u string, v string")
    assert {r.u: r.majority for r in A.majority_vote(df, ["u"], "v").collect()} == {"a": "x", "b": "tie"}


def test_cross_judge_golden(spark):
    codes = [((1, 1), (1, 1)), ((2, 2), (1, 1)), ((1, 1), (1, 1)), ((1, 2), (1, 0))]
    verdict = lambda c: {(1, 1): "left", (2, 2): "right"}.get(c, "tie")
    rows = [("A4", "A1", "b", c[0], c[1], r[0], r[1], verdict(c), verdict(r)) for c, r in codes]
    df = spark.createDataFrame(
        rows,
        "left_condition string, right_condition string, benchmark string, cross_code_ab int, cross_code_ba int, reference_code_ab int, reference_code_ba int, cross_verdict string, reference_verdict string",
    )
    row = A.cross_judge_metrics(df, [["left_condition", "right_condition"]]).first()
    assert (row.wins, row.losses, row.ties, row.commit_rate) == (2, 1, 1, 0.75)
    assert (row.presentation_agreement, row.presentation_total, row.collapsed_agreement, row.direction_conflicts) == (5, 8, 3, 1)


def test_cycle_association_per_run_set_and_pooled(spark):
    rows = [("x", "c", "left", True)] * 5 + [("x", "c", "right", False)] * 4 + [("y", "c", "left", False)] * 2 + [("y", "c", "tie", True), (None, "c", "right", True)]
    df = spark.createDataFrame(rows, "root string, contrast string, verdict string, single_cycle_exact boolean")
    got = {r.run_set: r for r in R.cycle_association(df, ["contrast"], "root").collect()}
    cells = ("wins_exact", "losses_exact", "ties_exact", "wins_other", "losses_other", "ties_other")
    assert {k: tuple(r[c] for c in cells) for k, r in got.items()} == {
        "x": (5, 0, 0, 0, 4, 0), "y": (0, 0, 1, 2, 0, 0), "pooled": (5, 1, 1, 2, 4, 0),
    }
    assert abs(got["x"].fisher_p - 1 / 126) < 1e-9


def test_process_profile(spark):
    rows = [("a", 1, 4), ("a", 2, None), ("a", 6, 10), ("b", None, None)]
    df = spark.createDataFrame(rows, "condition string, spawns long, units long")
    got = {r.condition: tuple(r)[1:] for r in R.process_profile(df, ["condition"], ["spawns"], ["spawns", "units"]).collect()}
    assert got == {"a": (3, 3.0, 2.0, 7.0), "b": (1, None, None, None)}
