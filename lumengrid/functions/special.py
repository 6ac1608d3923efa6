"""Distribution functions as column expressions: all stays in the JVM, one row at a time.

Continued fractions run as an ``aggregate`` over as many steps as the arguments need.  Null
arguments give null, as do degrees of freedom that are not positive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 1e-300


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0, by Stirling's series ten places up."""
    z = x + 10
    down = F.lit(1.0)
    for k in range(10):
        down = down * (x + k)
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7) + 1 / (1188 * z**9)
    return (z - 0.5) * F.ln(z) - z + 0.9189385332046727 + series - F.ln(down)


def _steps(n: Column) -> Column:
    return F.sequence(F.lit(1), n.cast("int"))


def _state(**values: Column) -> Column:
    return F.struct(*(v.cast("double").alias(k) for k, v in values.items()))


def _away(x: Column) -> Column:
    """Not zero, so that it can be divided by."""
    return F.when(F.abs(x) < _TINY, F.lit(_TINY)).otherwise(x)


def _not_negative(x: Column) -> Column:
    return F.when(x < 0, F.lit(0.0)).otherwise(x)


def _fraction(steps: Column, first: Column, numerator, denominator) -> Column:
    """``1 / (first + n1 / (d1 + n2 / (d2 + ...)))`` from the front, by ratios of successive convergents."""

    def step(s: Column, k: Column) -> Column:
        a, b = numerator(k), denominator(k)
        d = 1 / _away(b + a * s["d"])
        c = _away(b + a / s["c"])
        return _state(c=c, d=d, h=s["h"] * c * d)

    start = 1 / _away(first)
    return F.aggregate(steps, _state(c=F.lit(1 / _TINY), d=start, h=start), step, lambda s: s["h"])


def gamma_upper(a: Column, x: Column) -> Column:
    """Q(a, x), the regularised upper incomplete gamma function, for a > 0 and x >= 0."""
    a, x = a.cast("double"), x.cast("double")
    n = 60 + 12 * F.sqrt(F.greatest(a, x))
    front = F.exp(a * F.ln(x) - x - log_gamma(a))
    series = F.aggregate(_steps(n), _state(t=1 / a, s=1 / a), lambda s, k: _state(t=s["t"] * x / (a + k), s=s["s"] + s["t"] * x / (a + k)), lambda s: s["s"])
    fraction = _fraction(_steps(n), x + 1 - a, lambda k: k.cast("double") * (a - k), lambda k: x + 2 * k + 1 - a)
    return F.when(x <= 0, F.lit(1.0)).when(x < a + 1, 1 - front * series).otherwise(front * fraction)


def beta_lower(a: Column, b: Column, x: Column) -> Column:
    """I_x(a, b), the regularised incomplete beta function, for a, b > 0 and 0 <= x <= 1."""
    a, b, x = a.cast("double"), b.cast("double"), x.cast("double")
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.ln(1 - x))
    n = 60 + 6 * F.sqrt(F.greatest(a, b))

    def tail(a: Column, b: Column, x: Column) -> Column:
        """The fraction converges fast where x is under the mean; terms of odd and even order take turns."""

        def numerator(k: Column) -> Column:
            m = F.floor(k / 2).cast("double")
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            return F.when(k % 2 == 0, even).otherwise(odd)

        return _fraction(_steps(n), F.lit(1.0), numerator, lambda k: F.lit(1.0)) / a

    low = front * tail(a, b, x)
    high = 1 - front * tail(b, a, 1 - x)
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).when(x < (a + 1) / (a + b + 2), low).otherwise(high)


def normal_upper(z: Column) -> Column:
    """P(Z > z)."""
    half = gamma_upper(F.lit(0.5), z * z / 2) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


def chi_square_upper(x: Column, df: Column) -> Column:
    """P(X > x) with ``df`` degrees of freedom."""
    return F.when(df > 0, gamma_upper(df / 2, _not_negative(x) / 2))


def t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| > |t|)."""
    return F.when(df > 0, beta_lower(df / 2, F.lit(0.5), df / (df + t * t)))


def t_upper(t: Column, df: Column) -> Column:
    """P(T > t)."""
    half = t_two_sided(t, df) / 2
    return F.when(t >= 0, half).otherwise(1 - half)


def f_upper(f: Column, df1: Column, df2: Column) -> Column:
    """P(F > f)."""
    return F.when((df1 > 0) & (df2 > 0), beta_lower(df2 / 2, df1 / 2, df2 / (df2 + df1 * _not_negative(f))))


def t_critical(two_sided: float, df: Column) -> Column:
    """The t that |T| exceeds with probability ``two_sided``, by halving an interval of its share df / (df + t^2)."""
    at = lambda x: beta_lower(df / 2, F.lit(0.5), x)

    def step(s: Column, _: Column) -> Column:
        middle = (s["low"] + s["high"]) / 2
        under = at(middle) < two_sided
        return _state(low=F.when(under, middle).otherwise(s["low"]), high=F.when(under, s["high"]).otherwise(middle))

    share = F.aggregate(F.sequence(F.lit(1), F.lit(60)), _state(low=F.lit(0.0), high=F.lit(1.0)), step, lambda s: (s["low"] + s["high"]) / 2)
    return F.when(df > 0, F.sqrt(df * (1 - share) / share))


def signed_rank_upper(w_plus: Column, n: Column) -> Column:
    """P(W+ >= w_plus) for ``n`` differences without ties, by counting the sets of ranks with each sum."""
    # counts of sets by their sum, ranks taken in one by one; halved at each step, so that they are probabilities
    start = F.array(F.lit(1.0))
    zeros = lambda k: F.array_repeat(F.lit(0.0), k)
    law = F.aggregate(_steps(n), start, lambda s, k: F.zip_with(F.concat(s, zeros(k)), F.concat(zeros(k), s), lambda x, y: (x + y) / 2))
    at = F.ceil(w_plus).cast("int")
    tail = F.aggregate(F.slice(law, F.greatest(at, F.lit(0)) + 1, F.size(law)), F.lit(0.0), lambda s, x: s + x)
    return F.when(n >= 1, tail)
