import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from pairlens.functions import ordering as O
from pairlens.operators import control as L
from pairlens.operators import protocol as X
from pairlens.operators import quality as Q
from pairlens.operators import resampling as B

PAIR = "run_set int, benchmark string, prompt string, left_condition string, right_condition string, left_length bigint, right_length bigint, verdict string"


def pairs(spark, rows):
    df = spark.createDataFrame([(i % 3, "b", f"p{i}", "A4", "A1", *r) for i, r in enumerate(rows)], PAIR)
    return df.select("*", *L.length_columns(F.col("left_length"), F.col("right_length")))


def test_longer_side(spark):
    df = pairs(spark, [(120, 100, "left"), (100, 120, "left"), (100, 100, "right"), (120, 100, "tie")])
    row = L.length_report(df).filter("scope = 'pooled' AND section = 'longer_overall'").first()
    assert (row.pairs, row.wins, row.losses, row.ties, row.equal_length_pairs) == (3, 1, 1, 1, 1)
    focal = L.length_report(df).filter("scope = 'pooled' AND section = 'focal_by_contrast'").first()
    assert (focal.pairs, focal.equal_length_pairs) == (4, 1)


def test_bins_are_half_open(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 1.05, 1.10, 1.25, 1.5, 2.0)], "r double")
    got = [r[0] for r in df.select(L.ratio_bin(F.col("r"), L.LENGTH_BOUNDS, 1.0)).collect()]
    assert got == ["1.00-1.05", "1.05-1.10", "1.10-1.25", "1.25-1.50", "1.50-2.00", "2.00+"]
    df = spark.createDataFrame([(0.5,), (0.8,)], "r double")
    assert [r[0] for r in df.select(L.ratio_bin(F.col("r"), L.COMPUTE_BOUNDS, 0.0)).collect()] == ["0.50-0.67", "0.80-0.91"]


def test_clustered_sign(spark):
    rows = [("b", p, o) for p, o in (("p1", "win"), ("p1", "win"), ("p1", "tie"), ("p2", "win"), ("p2", "loss"), ("p2", "win"))]
    rows[5] = ("b", "p2", "tie")
    df = spark.createDataFrame([("k", *r) for r in rows], "k string, benchmark string, prompt string, outcome string")
    row = L.summarize(df, ["k"]).first()
    assert (row.wins, row.losses, row.ties) == (3, 1, 2)
    assert (row.prompt_wins, row.prompt_losses, row.prompt_ties, row.prompt_sign_test_p) == (1, 0, 1, 1.0)


def test_spearman_and_band(spark):
    df = spark.createDataFrame(
        [("k", t / 100.0, v) for t, v in ((100, "left"), (200, "left"), (300, "right"), (400, "right"))],
        "k string, compute_ratio double, verdict string",
    )
    assert L.spearman(df, ["k"]).first().rho == pytest.approx(-0.8944271909999159)
    assert L.spearman(df.limit(1), ["k"]).first().rho is None


def test_compute_report_keeps_requested_contrasts(spark):
    rows = [(0, "b", "p", "A4", "A1", 100, 100, "left")]
    df = spark.createDataFrame(rows, PAIR).select(
        "*", *L.compute_columns(F.col("left_length"), F.col("right_length"))
    )
    wanted = spark.createDataFrame([("A4", "A1"), ("A4", "A9")], "left_condition string, right_condition string")
    report = {(r.contrast, r.section): r for r in L.compute_report(df, wanted).filter("scope = 'pooled'").collect()}
    assert report[("A4:A9", "focal")].pairs == 0 and report[("A4:A9", "focal")].sign_test_p == 1.0
    assert report[("A4:A1", "compute_matched")].win_rate == 1.0


def test_row_index_and_carry_across_buckets(spark):
    rng = random.Random(1)
    rows = []
    for key, size in (("hot", 500), ("cold", 7)):
        for i in range(size):
            rows.append((key, i // 50, i, rng.choice(["a", "b", None])))
    df = spark.createDataFrame(rows, "k string, bucket int, pos int, v string").repartition(4)
    placed = O.row_index(df, ["k"], ["bucket"], ["pos"])
    assert placed.filter("row_index <> pos + 1").count() == 0
    carried = O.previous_value(df, ["k"], ["bucket"], ["pos"], F.col("v"), "before")
    counted = O.running_count(carried, ["k"], ["bucket"], ["pos"], F.col("v") == "a", "n")
    got = {(r.k, r.pos): (r.before, r.n) for r in counted.collect()}
    for key in ("hot", "cold"):
        before, n = None, 0
        for k, _, pos, v in rows:
            if k != key:
                continue
            n += v == "a"
            assert got[(k, pos)] == (before, n)
            before = v or before


def test_average_rank_and_quantiles(spark):
    rng = random.Random(2)
    values = [round(rng.choice([-1, 1]) * rng.random() * 10, 1) for _ in range(400)]
    df = spark.createDataFrame([("k", v) for v in values], "k string, v double")
    got = O.exact_quantiles(df, ["k"], "v", {"a": 0.025, "m": 0.5, "z": 0.975}).first()
    ordered = sorted(values)

    def want(q):
        place = q * (len(ordered) - 1)
        lo, hi = math.floor(place), math.ceil(place)
        return ordered[lo] + (ordered[hi] - ordered[lo]) * (place - lo)

    assert [got.a, got.m, got.z] == pytest.approx([want(0.025), want(0.5), want(0.975)])
    ranked = O.average_rank(df, ["k"], "v", "rank", O.signed_bucket(F.col("v")))
    for row in ranked.dropDuplicates(["v"]).collect():
        first = ordered.index(row.v) + 1
        assert row.rank == first + (ordered.count(row.v) - 1) / 2


def test_bootstrap_spread_matches_theory_in_one_block_and_many(spark):
    rng = random.Random(4)
    values = [rng.gauss(3, 2) for _ in range(400)]
    df = spark.createDataFrame([("k", f"u{i}", v) for i, v in enumerate(values)], "k string, u string, v double")
    want = statistics.pstdev(values) / math.sqrt(len(values))
    for block in (20_000, 10):
        means = [r["mean"] for r in B.bootstrap_means(df, ["k"], ["u"], "v", 400, 7, block).collect()]
        assert len(means) == 400
        assert statistics.fmean(means) == pytest.approx(statistics.fmean(values), abs=4 * want)
        assert statistics.stdev(means) == pytest.approx(want, rel=0.2)


def test_resample_weights_add_up(spark):
    df = spark.createDataFrame([("k", f"u{i}") for i in range(50)], "k string, u string")
    for block in (20_000, 10):
        sums = B.resample_weights(df, ["k"], ["u"], 60, 3, block).groupBy("b").agg(F.sum("weight").alias("w")).collect()
        assert len(sums) == 60 and {r.w for r in sums} == {50.0}


def test_means_and_weights_are_the_same_draws(spark):
    df = spark.createDataFrame([("k", f"u{i}", float(i * i)) for i in range(50)], "k string, u string, v double")
    for block in (20_000, 10):
        means = {r.b: r["mean"] for r in B.bootstrap_means(df, ["k"], ["u"], "v", 60, 3, block).collect()}
        drawn = B.resample_weights(df, ["k"], ["u"], 60, 3, block).join(df, ["k", "u"])
        want = {r.b: r.m for r in drawn.groupBy("b").agg((F.sum(F.col("weight") * F.col("v")) / 50).alias("m")).collect()}
        assert means == pytest.approx(want)


def test_prompt_level_means(spark):
    rows = [("p1", 1.0), ("p1", 0.5), ("p2", 0.0), ("p2", 1.0), ("p3", 0.0)]
    df = spark.createDataFrame(rows, "p string, s double").groupBy("p").agg(F.avg("s").alias("v"))
    row = df.agg(F.avg("v").alias("rate"), F.count_if(F.col("v") > 0.5).alias("w"), F.count_if(F.col("v") < 0.5).alias("l")).first()
    assert (round(row.rate, 5), row.w, row.l) == (0.41667, 1, 1)


def test_zero_deviation_gives_zero_score(spark):
    rows = [("g", *[float(i)] * 4, 2.0) for i in (1, 2, 3)]
    df = spark.createDataFrame(rows, "g string, " + ", ".join(f"{d} double" for d in Q.DIMENSIONS))
    scores = sorted(r.composite for r in Q.z_composite(df, ["g"]).collect())
    assert scores == pytest.approx([-4 / 5 * math.sqrt(1.5), 0, 4 / 5 * math.sqrt(1.5)])


def test_length_score(spark):
    cases = [(100.0, 100.0, 100.0), (100.0, 400.0, 0.0), (100.0, 250.0, 50.0), (100.0, 50.0, 50.0), (100.0, 0.0, 0.0)]
    df = spark.createDataFrame(cases, "x double, y double, want double")
    for r in df.withColumn("got", X.length_score(F.col("x"), F.col("y"))).collect():
        assert r.got == pytest.approx(r.want)


@pytest.mark.parametrize(("block", "limit"), [(65_536, 50), (4, 50), (1, 7), (3, 0)])
def test_running_budget_agrees_with_brute_force(spark, block, limit):
    from pairlens.operators import cost as K

    rng = random.Random(9)
    runs = {f"r{i}": [rng.choice([0, 1, 3, 7, 20, 60, None]) for _ in range(rng.randrange(1, 40))] for i in range(12)}
    runs["long"] = [rng.choice([45, 44, 20, 2, 1, 3, 51]) for _ in range(12_000)]
    runs["many"] = [rng.randrange(9, 60) for _ in range(9_000)] + [1] * 11_000
    rows = [(k, i, u) for k, us in runs.items() for i, u in enumerate(us)]
    df = spark.createDataFrame(rows, "path string, pos bigint, units bigint").repartition(5)
    found = K.running_budget(df, limit, block).collect()
    assert len(found) == len(runs)
    for r in found:
        used = taken = 0
        for u in runs[r.path]:
            if u is not None and used + u <= limit:
                used, taken = used + u, taken + 1
        assert (r.used, r.accepted, r.stages, r.rejected) == (used, taken, len(runs[r.path]), len(runs[r.path]) - taken)


def _newton(points):
    """(status, intercept, slope) of a plain fit of (x, y, weight)."""
    a = b = 0.0
    for _ in range(50):
        g0 = g1 = h00 = h01 = h11 = 0.0
        for x, y, w in points:
            p = 1 / (1 + math.exp(-(a + b * x)))
            v = w * p * (1 - p)
            g0, g1, h00, h01, h11 = g0 + w * (y - p), g1 + w * (y - p) * x, h00 + v, h01 + v * x, h11 + v * x * x
        det = h00 * h11 - h01 * h01
        if det <= 0:
            return "singular", a, b
        d0, d1 = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        a, b = a + d0, b + d1
        if abs(d0) < 1e-10 and abs(d1) < 1e-10:
            return "ok", a, b
    return "running", a, b


def test_replicates_are_fits_of_the_drawn_clusters(spark):
    """Every replicate equals a plain fit of its weighted points, in one block and many, in one slice and many."""
    from pairlens.operators import models as M

    rng = random.Random(12)
    rows = []
    for p in range(30):
        for _ in range(rng.randrange(1, 5)):
            x = round(rng.gauss(0, 1), 1)
            rows.append(("A", "B", "b", f"p{p}", x, float(rng.random() < 1 / (1 + math.exp(-0.5 - x))), float(rng.randrange(1, 3))))
    rows += [("A", "C", "b", f"q{p}", 0.5, 1.0, 1.0) for p in range(4)]  # no spread of x: singular
    schema = "left_condition string, right_condition string, benchmark string, prompt string, x double, y double, weight double"
    df = spark.createDataFrame(rows, schema).groupBy("left_condition", "right_condition", "benchmark", "prompt", "x", "y").agg(F.sum("weight").alias("weight"))
    unit = ["benchmark", "prompt"]
    for block, slice_rows in ((20_000, 20_000), (7, 5)):
        drawn = B.drawn_points(df, M.CONTRAST, unit, ["x", "y", "weight"], 25, 3, block, slice_rows)
        found = {(r.right_condition, r.b): r for r in M.fit_replicates(drawn, M.CONTRAST, 25, 3).collect()}
        weights = B.resample_weights(df.select(*M.CONTRAST, *unit).distinct(), M.CONTRAST, unit, 25, 3, block)
        joined = weights.withColumnRenamed("weight", "times").join(df, [*M.CONTRAST, *unit]).collect()
        samples = {}
        for r in joined:
            samples.setdefault((r.right_condition, r.b), []).append((r.x, r.y, r.times * r.weight))
        assert len(found) == 50 and set(found) == set(samples)
        for key, points in samples.items():
            status, a, b = _newton(points)
            assert found[key].status == status
            if status == "ok":
                assert (found[key].intercept, found[key].slope) == pytest.approx((a, b), abs=1e-7)


def test_cluster_bootstrap_counts_its_replicates(spark):
    from pairlens.operators import models as M

    rng = random.Random(13)
    rows = [("A", "B", "b", f"p{i}", x := rng.gauss(0, 1), float(rng.random() < 1 / (1 + math.exp(-x)))) for i in range(200)]
    rows += [("A", "C", "b", f"q{i}", float(i), float(i > 1)) for i in range(4)]  # separated: some samples fail
    df = spark.createDataFrame(rows, "left_condition string, right_condition string, benchmark string, prompt string, x double, y double")
    report = {r.right_condition: r for r in M.logistic_cluster_bootstrap(df, 60, 5).collect()}
    assert all(r.replicates + r.failed == 60 for r in report.values())
    b = report["B"]
    assert (b.status, b.failed, b.unsettled, b.decided_pairs, b.prompts) == ("ok", 0, 0, 200, 200)
    assert b.slope_low < b.slope < b.slope_high and b.equal_length_preference_low < b.equal_length_preference < b.equal_length_preference_high
    assert report["C"].failed > 0


def test_score_strata(spark):
    rows = [("x", 1.0, 100, 100), ("x", 3.0, 100, 104), ("x", 5.0, 100, 105), ("x", 7.0, 250, 100), ("x", 9.0, 100, 250), ("x", 11.0, 0, 5), ("x", 13.0, 5, None), ("y", 2.0, None, None)]
    df = spark.createDataFrame(rows, "k string, v double, n int, want int")
    got = {(r.k, r.stratum): (r.scores, r.v) for r in L.score_strata(df, ["k"], ["v"], F.col("n"), F.col("want"), 2).collect()}
    assert got == {("x", "raw"): (7, 7.0), ("x", "1.00-1.05"): (2, 2.0), ("x", "2.00+"): (2, 8.0), ("y", "raw"): (1, 2.0)}


def test_numbers_of_draws_are_shared_by_cells():
    """The numbers do not name a cell: cells of one block and chunk get theirs from one calculation."""
    import numpy as np
    import pandas as pd

    modulus, multipliers = 2147483647, (1103515245, 1664525, 22695477)

    def mix(x, m):
        return (x ^ (x >> 15)) * m % modulus

    def number(seed, b, block, slot):
        key = mix(mix((seed + b * 40503 + block * 15485863) % modulus, multipliers[0]), multipliers[1])
        x = (key + slot * 69069) % modulus
        for m in multipliers:
            x = mix(x, m)
        return x

    for seed, block, first, count in ((20260908, 0, 0, 40), (2**33 + 1, 77, 5, B.TILE + 3)):
        got = B.draw_numbers(seed, np.array([0, 9999]), block, first, count)
        for i, b in enumerate((0, 9999)):
            assert got[i].tolist() == [number(seed, b, block, first + slot) for slot in range(count)]
    asked = []
    made = B.draw_numbers
    cells = [("x", 30), ("y", 25), ("z", 30)]
    values = {k: [float(i * i) for i in range(n)] for k, n in cells}
    rows = [{"k": k, "_block": 2, "_first": 500, "_drawn": [20, 0, n], "_values": values[k]} for k, n in cells]
    try:
        B.draw_numbers = lambda *args: asked.append(args) or made(*args)
        found = pd.concat(B._block_sums(iter([pd.DataFrame(rows)]), ["k"], 7))
    finally:
        B.draw_numbers = made
    assert len(asked) == 1
    for row in found.itertuples():
        n = len(values[row.k])
        want = sum(values[row.k][number(7, row.b, 2, slot) % n] for slot in range(row.drawn))
        assert row.total == want * B.SCALE


def test_stored_records_feed_scores_and_pairs_once(spark):
    """The records of a prompt are shuffled once for moments, scores and pairs; the first record of a run counts."""
    from pairlens.operators import canon as C

    rows = [(0, "b", c, p, *[float(x)] * 5, place) for c, p, x, place in (("A", "p", 1, 2), ("A", "p", 9, 3), ("B", "p", 3, 1), ("A", "q", 5, 1), ("B", "q", 4, 5), ("B", "q", 7, 4))]
    schema = "run_set int, benchmark string, condition string, prompt string, " + ", ".join(f"{d} double" for d in Q.DIMENSIONS) + ", place long"
    scores = Q.prompt_scores(spark.createDataFrame(rows, schema), F.col("place"))
    contrasts = spark.createDataFrame([(0, "A", "B")], "ordinal int, left_condition string, right_condition string")
    pairs = C.paired_rows(scores, contrasts, ["benchmark", "prompt"], ["score"])
    mean, sd = 4.0, math.sqrt(5.0)
    got = {r.prompt: (r.left_score, r.right_score) for r in pairs.collect()}
    assert got["p"] == pytest.approx(((1 - mean) / sd, (3 - mean) / sd)) and got["q"] == pytest.approx(((5 - mean) / sd, (7 - mean) / sd))
    plan = pairs._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("hashpartitioning(benchmark") == plan.count("REPARTITION_BY_COL") and "SortAggregate" not in plan


def test_ranked_values_have_one_row_per_value(spark):
    values = [3.0, 1.0, 1.0, 2.0, 1.0, 3.0]
    df = spark.createDataFrame([("k", v, i) for i, v in enumerate(values)], "k string, v double, i int")
    found = O.ranked_values(df, ["k"], "v", "rank", F.count(F.lit(1)), {"total": F.sum("i")}).collect()
    assert {r.v: (r["rank"], r.rank_ties, r.total) for r in found} == {1.0: (2.0, 3, 7), 2.0: (4.0, 1, 3), 3.0: (5.5, 2, 5)}


def test_newton_sums_ask_for_many_replicates_at_once():
    import numpy as np
    import pandas as pd

    from pairlens.operators import models as M

    n = 40
    x, y = np.linspace(-1, 1, n), np.arange(n) % 2 * 1.0
    row = {"k": "a", "x": x, "y": y, "weight": np.ones(n), "owner": np.arange(n), "_b": np.arange(500, 520), "_intercept": np.full(20, 0.1),
           "_slope": np.full(20, 0.2), "_drawn": np.arange(20) + 30, "_first": 500, "_block": 1, "n_units": n}
    asked, made = [], M.draw_numbers
    try:
        M.draw_numbers = lambda *args: asked.append(args) or made(*args)
        found = pd.concat(M._newton_sums(iter([pd.DataFrame([row])]), ["k"], 3))
    finally:
        M.draw_numbers = made
    assert len(asked) == 1 and len(found) == 20  # one part holds all replicates
    p = 1 / (1 + np.exp(-(0.1 + 0.2 * x)))
    for i, r in enumerate(found.itertuples()):
        times = np.bincount(B.draws(3, r.b, 1, 30 + i, n), minlength=n)
        assert times.sum() == 30 + i and (r.g0, r.h01) == pytest.approx(((times * (y - p)).sum(), (times * p * (1 - p) * x).sum()))
