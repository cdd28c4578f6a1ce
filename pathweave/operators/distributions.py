"""Probabilities as column expressions, accurate for counts of any size."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# ln n! - its leading terms, for n where the series below is not yet exact
_SMALL = [math.lgamma(n + 1) - ((n + 0.5) * math.log(n) - n + 0.5 * math.log(2 * math.pi)) if n else 0.0 for n in range(17)]


def _double(value: Column) -> Column:
    return value.cast("double")


def _factorial_error(n: Column) -> Column:
    """ln n! less (n + 1/2) ln n - n + ln sqrt(2 pi), for whole n > 0."""
    m = 1 / (n * n)
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - m / 1188) * m) * m) * m) / n
    return F.when(n <= 16, F.get(F.array(*[F.lit(x) for x in _SMALL]), F.least(n, F.lit(16.0)).cast("int"))).otherwise(series)


def _deviance(x: Column, mean: Column) -> Column:
    """x ln(x / mean) + mean - x, without the cancellation of large terms."""
    d = (x - mean) / mean
    return mean * ((1 + d) * F.log1p(d) - d)


def _log_binomial(x: Column, n: Column, p: Column, q: Column) -> Column:
    """ln of the probability of x among n; p + q = 1."""
    middle = (
        _factorial_error(n) - _factorial_error(x) - _factorial_error(n - x) - _deviance(x, n * p) - _deviance(n - x, n * q)
        + F.log(n / (x * (n - x) * (2 * math.pi))) / 2
    )
    return F.when(n == 0, 0.0).when(x == 0, n * F.log1p(-p)).when(x == n, n * F.log(p)).otherwise(middle)


def hypergeometric(k: Column, drawn: Column, marked: Column, n: Column) -> Column:
    """P(X = k): k marked ones among ``drawn`` of ``n``, ``marked`` of which are marked.

    A ratio of three binomial probabilities, in each of which the large terms cancel before they are computed.
    """
    k, drawn, marked, n = map(_double, (k, drawn, marked, n))
    p, q = drawn / n, (n - drawn) / n
    log_p = _log_binomial(k, marked, p, q) + _log_binomial(drawn - k, n - marked, p, q) - _log_binomial(drawn, n, p, q)
    return F.when((drawn == 0) | (drawn == n), 1.0).otherwise(F.exp(log_p))


def hypergeometric_tails(observed: Column, drawn: Column, marked: Column, n: Column) -> tuple[Column, Column]:
    """P(X <= observed) and P(X >= observed).

    The tail away from the mode is summed outwards, each term from the one before by a ratio; terms beyond ten standard deviations (and
    forty more, for short tails that fall like a Poisson's) are below the precision of the sum.  The other tail is what is left.
    """
    k, d, m, n = map(_double, (observed, drawn, marked, n))
    at = hypergeometric(observed, drawn, marked, n)
    low, high = F.greatest(F.lit(0.0), d + m - n), F.least(d, m)
    below = k <= F.floor((d + 1) * (m + 1) / (n + 2))
    deviation = F.sqrt(d / n * m * ((n - d) / n) * ((n - m) / F.greatest(n - 1, F.lit(1.0))))
    steps = F.least(F.when(below, k - low).otherwise(high - k), F.ceil(10 * deviation) + 40).cast("int")

    def further(state: Column, i: Column) -> Column:
        down, up = k - i + 1, k + i - 1
        ratio = F.when(below, down * (n - m - d + down) / ((m - down + 1) * (d - down + 1))).otherwise(
            (m - up) * (d - up) / ((up + 1) * (n - m - d + up + 1))
        )
        term = state["term"] * ratio
        return F.struct(term.alias("term"), (state["total"] + term).alias("total"))

    one = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    outwards = F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))
    tail = F.least(at * F.aggregate(outwards, one, further, lambda s: s["total"]), F.lit(1.0))
    rest = F.least(F.greatest(1 - tail + at, F.lit(0.0)), F.lit(1.0))
    return F.when(below, tail).otherwise(rest), F.when(below, rest).otherwise(tail)


def erfc(z: Column) -> Column:
    """The complementary error function of z >= 0: a series without cancellation up to 2, a continued fraction beyond."""
    z = _double(z)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(50)),
        F.struct(z.alias("term"), z.alias("total")),
        lambda s, i: F.struct((s["term"] * 2 * z * z / (2 * i + 1)).alias("term"), (s["total"] + s["term"] * 2 * z * z / (2 * i + 1)).alias("total")),
        lambda s: s["total"],
    )
    fraction = F.aggregate(F.sequence(F.lit(80), F.lit(1), F.lit(-1)), z, lambda s, i: z + i / 2 / s)
    density = F.exp(-z * z)
    return F.when(z < 2, 1 - 2 / math.sqrt(math.pi) * density * series).otherwise(density / (math.sqrt(math.pi) * fraction))
