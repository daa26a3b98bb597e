import math
import random

import pytest
from pyspark.sql import functions as F

from pairlens.functions import stats as S
from pairlens.operators import pairs as P


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def exact_sign(w, l):
    n = w + l
    if n == 0:
        return 1.0
    tail = sum(math.comb(n, k) for k in range(min(w, l) + 1))
    return min(1.0, float(2 * tail / 2**n)) if n < 1000 else min(1.0, 2 * tail / 2**n)


def test_sign_test_matches_exact_integers(spark):
    cases = [(12, 0), (0, 0), (1, 1), (3, 9), (40, 60), (500, 380), (700, 300), (0, 900), (1200, 1100)]
    df = spark.createDataFrame(cases, "w bigint, l bigint")
    for row in df.select("w", "l", S.sign_test_p(F.col("w"), F.col("l")).alias("p")).collect():
        assert row.p == pytest.approx(exact_sign(row.w, row.l), rel=1e-9, abs=1e-300)


def test_sign_test_known_value_and_huge_cells(spark):
    p = lambda w, l: S.sign_test_p(F.lit(w), F.lit(l))
    row = one(spark, a=p(12, 0), b=p(600_000, 598_000), c=p(10**9, 10**9 + 60_000))
    assert row.a == pytest.approx(0.00048828125, rel=1e-12)
    # normal approximation with continuity correction
    for value, w, l in ((row.b, 600_000, 598_000), (row.c, 10**9, 10**9 + 60_000)):
        z = (abs(w - l) - 1) / math.sqrt(w + l)
        assert value == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-3)


def test_wilson(spark):
    low, high = S.wilson_bounds(F.lit(1), F.lit(1))
    none, _ = S.wilson_bounds(F.lit(0), F.lit(0))
    clamped, _ = S.wilson_bounds(F.lit(0), F.lit(5), 1.96, clamp=True)
    row = one(spark, low=low, high=high, none=none, clamped=clamped)
    assert row.low == pytest.approx(0.094531205734)
    assert row.high == pytest.approx(0.905468794266)
    assert row.none is None
    assert row.clamped >= 0


def fisher_brute(a, b, c, d):
    r1, r2, c1, n = a + b, c + d, a + c, a + b + c + d
    if n == 0:
        return 1.0
    mass = lambda x: math.comb(r1, x) * math.comb(r2, c1 - x) / math.comb(n, c1)
    return min(1.0, sum(mass(x) for x in range(max(0, c1 - r2), min(r1, c1) + 1) if mass(x) <= mass(a) + 1e-15))


def test_fisher(spark):
    rng = random.Random(3)
    cases = [(0, 0, 0, 0), (8, 2, 1, 5), (3, 3, 3, 3), (0, 10, 10, 0)]
    cases += [tuple(rng.randrange(0, 40) for _ in range(4)) for _ in range(30)]
    df = spark.createDataFrame(cases, "a bigint, b bigint, c bigint, d bigint")
    rows = df.select("*", S.fisher_exact_p(*[F.col(x) for x in "abcd"]).alias("p")).collect()
    for r in rows:
        assert r.p == pytest.approx(fisher_brute(r.a, r.b, r.c, r.d), rel=1e-8)


def test_binomial_cdf_and_power(spark):
    cases = [(k, n, r) for n in (1, 5, 30, 200) for k in (-1, 0, n // 3, n // 2, n - 1, n) for r in (0.1, 0.5, 0.9)]
    df = spark.createDataFrame(cases, "k bigint, n bigint, r double")
    for row in df.select("*", S.binomial_cdf(F.col("k"), F.col("n"), F.col("r")).alias("p")).collect():
        want = sum(math.comb(row.n, j) * row.r**j * (1 - row.r) ** (row.n - j) for j in range(0, row.k + 1))
        assert row.p == pytest.approx(want, rel=1e-9, abs=1e-12)


def test_power_and_detectable_rate_by_brute_force(spark):
    alpha = 0.05 / 24
    cells = spark.createDataFrame([(n,) for n in (3, 40, 121)], "n bigint").withColumn("cell", F.col("n"))
    rates = F.array(*[F.lit(r) for r in (0.5, 0.63, 0.73, 0.9)])
    for row in P.power_table(cells, ["cell"], rates, alpha).collect():
        want = sum(
            math.comb(row.n, w) * row.rate**w * (1 - row.rate) ** (row.n - w)
            for w in range(row.n + 1)
            if exact_sign(w, row.n - w) <= alpha
        )
        assert row.power == pytest.approx(want, rel=1e-8, abs=1e-12)
    found = {r.n: r.detectable_rate for r in P.detectable_rate(cells, ["cell"], alpha, 0.8).collect()}
    assert found[3] == 1
    assert 0.6 < found[121] < found[40] < 1
    ends = spark.createDataFrame([(n, found[n] + d, d > 0) for n in (40, 121) for d in (-1e-9, 1e-9)], "cell bigint, rate double, enough boolean")
    for row in ends.collect():
        want = sum(
            math.comb(row.cell, w) * row.rate**w * (1 - row.rate) ** (row.cell - w)
            for w in range(row.cell + 1)
            if exact_sign(w, row.cell - w) <= alpha
        )
        assert (want >= 0.8) == row.enough


def test_holm_is_monotone_and_breaks_ties_by_order(spark):
    ps = [0.01, 0.04, 0.03, 0.03, 0.5]
    rows = [("b", "A4", f"A{i}", p) for i, p in enumerate(ps)]
    df = spark.createDataFrame(rows, "benchmark string, left_condition string, right_condition string, p_raw double")
    got = {r.right_condition: r.p_holm for r in P.holm(df, ["benchmark"]).collect()}
    assert [round(got[f"A{i}"], 6) for i in range(5)] == [0.05, 0.12, 0.12, 0.12, 0.5]


def test_normal_tail(spark):
    for z in (0.0, 0.5, 1.96, 4.0):
        assert one(spark, p=S.normal_two_sided_p(F.lit(z))).p == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-6)
