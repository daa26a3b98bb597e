"""Statistics as pure Column builders.

Every builder works on one row of counts, so a report can apply it to any
number of cells without a shuffle, a UDF or a trip to the driver. Sums over a
discrete support are cut where the remaining mass is below double precision,
which bounds the work by the square root of the cell size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054
LN2 = math.log(2.0)
HALF_LOG_2PI = 0.5 * math.log(2.0 * math.pi)
# exp(-2 j^2 / n) < 1e-17 once j > TAIL_WIDTH * sqrt(n)
TAIL_WIDTH = 4.5


def _double(value: Column | float) -> Column:
    column = value if isinstance(value, Column) else F.lit(value)
    return column.cast("double")


def round6(value: Column) -> Column:
    """Six decimals without a negative zero."""
    return F.round(value.cast("double"), 6) + F.lit(0.0)


def _stirling_tail(x: Column) -> Column:
    """Error of Stirling's formula for ln(x!), for x >= 16."""
    inv = F.lit(1.0) / x
    sq = inv * inv
    return inv * (
        F.lit(1 / 12.0) - sq * (F.lit(1 / 360.0) - sq * (F.lit(1 / 1260.0) - sq / 1680.0))
    )


def log_factorial(n: Column) -> Column:
    """ln(n!) for a non-negative count; exact table below 16."""
    n = _double(n)
    table = F.array(*[F.lit(math.lgamma(i + 1.0)) for i in range(16)])
    small = F.element_at(table, F.least(n, F.lit(15.0)).cast("int") + 1)
    big = F.greatest(n, F.lit(16.0))
    return F.when(n < 16, small).otherwise(
        (big + 0.5) * F.log(big) - big + HALF_LOG_2PI + _stirling_tail(big)
    )


def log_choose(n: Column, k: Column) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(_double(n) - _double(k))


def _stirling_error(x: Column) -> Column:
    table = F.array(
        F.lit(0.0),
        *[
            F.lit(math.lgamma(i + 1.0) - (i + 0.5) * math.log(i) + i - HALF_LOG_2PI)
            for i in range(1, 16)
        ],
    )
    small = F.element_at(table, F.least(x, F.lit(15.0)).cast("int") + 1)
    return F.when(x < 16, small).otherwise(_stirling_tail(F.greatest(x, F.lit(16.0))))


def _log_binomial_pmf(k: Column, n: Column, rate: Column) -> Column:
    """Saddle-point form of the binomial log mass; stays accurate for huge n."""
    rest = n - k
    inner_k = F.greatest(k, F.lit(1.0))
    inner_rest = F.greatest(rest, F.lit(1.0))
    inner_n = F.greatest(n, F.lit(1.0))
    # k ln(k / np) written around the mean keeps the cancellation small
    dev_k = inner_k * F.log1p((inner_k - inner_n * rate) / (inner_n * rate))
    dev_rest = inner_rest * F.log1p(
        (inner_rest - inner_n * (1 - rate)) / (inner_n * (1 - rate))
    )
    middle = (
        _stirling_error(n)
        - _stirling_error(k)
        - _stirling_error(rest)
        - dev_k
        - dev_rest
        + 0.5 * F.log(inner_n / (2 * math.pi * inner_k * inner_rest))
    )
    return (
        F.when(k <= 0, n * F.log1p(-rate)).when(rest <= 0, n * F.log(rate)).otherwise(middle)
    )


def _falling_sum(k: Column, n: Column, odds: Column) -> Column:
    """1 + pmf(k-1)/pmf(k) + pmf(k-2)/pmf(k) + ... cut below double precision.

    ``odds`` is (1 - rate) / rate. Steps past zero multiply by zero.
    """
    steps = F.least(k, F.ceil(TAIL_WIDTH * F.sqrt(n)) + 16).cast("bigint") + 1
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def advance(acc: Column, j: Column) -> Column:
        ratio = F.greatest(k - j + 1, F.lit(0.0)) / (n - k + j) * odds
        term = acc["term"] * ratio
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    return F.aggregate(
        F.sequence(F.lit(1).cast("bigint"), steps), start, advance, lambda acc: acc["total"]
    )


def sign_test_p(wins: Column, losses: Column) -> Column:
    """Exact two-sided binomial sign test; ties are already excluded."""
    w, l = _double(wins), _double(losses)
    n = w + l
    k = F.least(w, l)
    lower = F.exp(_log_binomial_pmf(k, n, F.lit(0.5))) * _falling_sum(k, n, F.lit(1.0))
    p = F.least(F.lit(1.0), 2.0 * lower)
    # the logarithm leaves an error near 1e-14, which would decide ties of a later rounding
    return F.when(n == 0, F.lit(1.0)).when(p >= 1e-3, F.round(p, 12)).otherwise(p)


def binomial_cdf(k: Column, n: Column, rate: Column) -> Column:
    """P(X <= k) for X ~ Binomial(n, rate), summed on the lighter side."""
    k, n, rate = _double(k), _double(n), _double(rate)
    inside = F.greatest(F.least(k, n), F.lit(0.0))
    low = F.exp(_log_binomial_pmf(inside, n, rate)) * _falling_sum(
        inside, n, (1 - rate) / rate
    )
    # upper side: mirror the variable, P(X >= k+1) = P(n - X <= n - k - 1)
    mirrored = F.greatest(n - inside - 1, F.lit(0.0))
    high = F.exp(_log_binomial_pmf(mirrored, n, 1 - rate)) * _falling_sum(
        mirrored, n, rate / (1 - rate)
    )
    return (
        F.when(k < 0, F.lit(0.0))
        .when(k >= n, F.lit(1.0))
        .when((rate > 0) & (rate < 1) & (inside <= n * rate), F.least(low, F.lit(1.0)))
        .when(rate <= 0, F.lit(1.0))
        .when(rate >= 1, F.lit(0.0))
        .otherwise(F.greatest(1.0 - high, F.lit(0.0)))
    )


def critical_candidates(n: Column, alpha: float) -> Column:
    """Counts next to the normal approximation of the critical count.

    The exact critical count, the largest k whose two-sided p-value is at most
    alpha, lies among them; the caller tests each one.
    """
    from statistics import NormalDist

    z = NormalDist().inv_cdf(1 - alpha / 2)
    n = _double(n)
    start = F.floor(n / 2 - z * F.sqrt(n) / 2)
    return F.sequence(start - 4, start + 4)


def sign_test_power(n: Column, rate: Column, critical: Column) -> Column:
    """Power of the sign test given its critical count."""
    n, rate, critical = _double(n), _double(rate), _double(critical)
    lower = binomial_cdf(critical, n, rate)
    upper = binomial_cdf(critical, n, 1 - rate)
    return F.when(critical < 0, F.lit(0.0)).otherwise(F.least(lower + upper, F.lit(1.0)))


def wilson_bounds(
    wins: Column, losses: Column, z: float = Z95, clamp: bool = False
) -> tuple[Column, Column]:
    """Wilson score interval of a win rate; null when nothing was decided."""
    w, n = _double(wins), _double(wins) + _double(losses)
    safe = F.when(n > 0, n)
    rate = w / safe
    z2 = z * z
    shrink = 1 + F.lit(z2) / safe
    center = (rate + z2 / (2 * safe)) / shrink
    half = z * F.sqrt(rate * (1 - rate) / safe + z2 / (4 * safe * safe)) / shrink
    low, high = center - half, center + half
    if clamp:
        low, high = F.greatest(low, F.lit(0.0)), F.least(high, F.lit(1.0))
        low, high = F.when(n > 0, low), F.when(n > 0, high)
    return low, high


def win_rate(wins: Column, losses: Column) -> Column:
    n = _double(wins) + _double(losses)
    return F.when(n > 0, _double(wins) / n)


def record_columns(
    wins: str = "wins", losses: str = "losses", suffix: str = ""
) -> list[Column]:
    """Decided count, rate, interval and p-value of one win/loss/tie cell."""
    w, l = F.col(wins), F.col(losses)
    low, high = wilson_bounds(w, l)
    return [
        (w + l).alias("n_non_tie" + suffix),
        win_rate(w, l).alias("win_rate" + suffix),
        low.alias("wilson_low" + suffix),
        high.alias("wilson_high" + suffix),
        sign_test_p(w, l).alias("p_raw" + suffix),
    ]


def fisher_exact_p(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided Fisher test of [[a, b], [c, d]].

    Sums the tables no more likely than the observed one (tolerance 1e-15).
    Only tables within twelve deviations of the mode are visited; the rest have
    no mass in double precision.
    """
    a, b, c, d = (_double(x) for x in (a, b, c, d))
    row1, row2, col1, total = a + b, c + d, a + c, a + b + c + d
    low = F.greatest(F.lit(0.0), col1 - row2)
    high = F.least(row1, col1)
    mode = F.floor((row1 + 1) * (col1 + 1) / (total + 2))
    spread = F.ceil(6.0 * F.sqrt(F.least(row1, col1))) + 40
    first = F.greatest(low, mode - spread).cast("bigint")
    last = F.least(high, mode + spread).cast("bigint")
    base = log_choose(total, col1)

    def mass(x: Column) -> Column:
        return F.exp(log_choose(row1, x) + log_choose(row2, col1 - x) - base)

    observed = mass(a) + 1e-15
    tail = F.aggregate(
        F.sequence(first, F.greatest(first, last)),
        F.lit(0.0),
        lambda acc, x: acc
        + F.when(mass(x.cast("double")) <= observed, mass(x.cast("double"))).otherwise(0.0),
    )
    return F.when(total == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), tail))


# Coefficients of the Chebyshev fit of erfc (relative error 1.2e-7)
ERFC_COEFFICIENTS = (
    -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
    0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
)


def normal_two_sided_p(z: Column) -> Column:
    """P(|Z| >= |z|) for a standard normal variable."""
    x = F.abs(_double(z)) / math.sqrt(2.0)
    t = F.lit(1.0) / (1 + 0.5 * x)
    poly = F.lit(ERFC_COEFFICIENTS[-1])
    for value in reversed(ERFC_COEFFICIENTS[:-1]):
        poly = poly * t + value
    return t * F.exp(-x * x + poly)


def logistic(value: Column) -> Column:
    return F.lit(1.0) / (1.0 + F.exp(-_double(value)))


def seeded_draw(*parts: Column | str | int) -> Column:
    """Reproducible 32-bit draw: the first eight hex digits of an md5."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    text = F.concat_ws(":", *[c.cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


# Modulus and multipliers of the counter-based draws
DRAW_MODULUS = 2147483647
DRAW_MULTIPLIERS = (1103515245, 1664525, 22695477)
BLOCK_STEP = 15485863


def _mix(x: Column, multiplier: int) -> Column:
    return x.bitwiseXOR(F.shiftright(x, 15)) * multiplier % DRAW_MODULUS


def replicate_key(seed: int, replicate: Column, block: Column) -> Column:
    """Start of the draws of one replicate in one block."""
    x = F.lit(seed).cast("bigint") + replicate.cast("bigint") * 40503 + block.cast("bigint") * BLOCK_STEP
    x = x % DRAW_MODULUS
    return _mix(_mix(x, DRAW_MULTIPLIERS[0]), DRAW_MULTIPLIERS[1])


def counter_draw(key: Column, slot: Column) -> Column:
    """Reproducible draw below 2^31 for a slot; integer steps only, so it is cheap
    enough to run once per resampled unit and easy to repeat in another engine."""
    x = (key + slot.cast("bigint") * 69069) % DRAW_MODULUS
    for multiplier in DRAW_MULTIPLIERS:
        x = _mix(x, multiplier)
    return x
