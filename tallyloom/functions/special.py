"""Tail probabilities and quantiles as columns: folds over continued fractions and series, one row a test, any number of rows.

Everything is built from Spark's own functions, so a plan that tests thousands of groups has no step on the driver.  Folds
take as many steps as their parameters need; parameters above ``LARGE`` take the limiting law instead, whose error is of
the order of one over them.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Degrees of freedom and counts from which the limiting law is used.
LARGE = 1e6
TINY, EXACT = 1e-300, 3e-16


def _num(x: Column | float) -> Column:
    return x.cast("double") if isinstance(x, Column) else F.lit(float(x))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def log_gamma(x: Column | float) -> Column:
    """Stirling's series eight steps further up; x > 0."""
    x = _num(x)
    y = x + 8
    steps = x
    for i in range(1, 8):
        steps = steps * (x + i)
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) + 1 / (1188 * y**9) - 691 / (360360 * y**11)
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - F.ln(steps)


def _safe(x: Column) -> Column:
    return F.when(F.abs(x) < TINY, F.lit(TINY)).otherwise(x)


def _fraction(first: Column, steps: Column, term: Callable[[Column], tuple[Column, Column]]) -> Column:
    """Lentz's product for a continued fraction: ``term(k)`` gives its k-th numerator and denominator, ``first`` its start."""
    state = F.struct(_safe(first).alias("c"), F.lit(0.0).alias("d"), _safe(first).alias("h"), F.lit(False).alias("done"))

    def step(s: Column, k: Column) -> Column:
        a, b = term(k.cast("double"))
        cd = lambda v: F.struct(_safe(v["b"] + v["a"] / s["c"]).alias("c"), (1 / _safe(v["b"] + v["a"] * s["d"])).alias("d"))
        on = lambda v: F.struct(v["c"].alias("c"), v["d"].alias("d"), (s["h"] * v["c"] * v["d"]).alias("h"), (F.abs(v["c"] * v["d"] - 1) < EXACT).alias("done"))
        return F.when(s["done"], s).otherwise(_let(_let(F.struct(a.alias("a"), b.alias("b")), cd), on))

    return F.aggregate(F.sequence(F.lit(1), steps), state, step, lambda s: s["h"])


def beta_cdf(x: Column | float, a: Column | float, b: Column | float) -> Column:
    """The regularised incomplete beta function; 0 below and 1 above its range, null where an argument is."""
    x, a, b = _num(x), _num(a), _num(b)

    def inside(s: Column) -> Column:
        side = F.when(s["x"] > (s["a"] + 1) / (s["a"] + s["b"] + 2), F.struct((1 - s["x"]).alias("x"), s["b"].alias("a"), s["a"].alias("b"), F.lit(True).alias("other"))).otherwise(F.struct(s["x"].alias("x"), s["a"].alias("a"), s["b"].alias("b"), F.lit(False).alias("other")))
        return _let(side, tail)

    def tail(s: Column) -> Column:
        x, a, b = s["x"], s["a"], s["b"]
        steps = (40 + 8 * F.sqrt(F.greatest(a, b))).cast("int")

        def term(k: Column) -> tuple[Column, Column]:
            m = F.floor(k / 2)
            even = m * (b - m) * x / ((a + k - 1) * (a + k))
            odd = -(a + m) * (a + b + m) * x / ((a + k - 1) * (a + k))
            return F.when(k % 2 == 0, even).otherwise(odd), F.lit(1.0)

        front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.log1p(-x)) / a
        value = front / _fraction(F.lit(1.0), steps, term)
        return F.when(s["other"], 1 - value).otherwise(value)

    known = F.struct(x.alias("x"), a.alias("a"), b.alias("b"))
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x.isNotNull() & a.isNotNull() & b.isNotNull(), _let(known, inside))


def gamma_upper(a: Column | float, x: Column | float, steps: int = 400) -> Column:
    """The regularised upper incomplete gamma function, by its series below a + 1 and its continued fraction above."""
    a, x = _num(a), _num(x)

    def inside(s: Column) -> Column:
        a, x = s["a"], s["x"]
        front = F.exp(a * F.ln(x) - x - log_gamma(a))
        start = F.struct((1 / a).alias("term"), (1 / a).alias("sum"))
        more = lambda v, k: _let(v["term"] * x / (a + k), lambda t: F.struct(t.alias("term"), (v["sum"] + t).alias("sum")))
        series = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, more, lambda v: v["sum"])
        fraction = _fraction(x + 1 - a, F.lit(steps), lambda k: (k * (a - k), x + 1 - a + 2 * k))
        return F.when(x < a + 1, 1 - front * series).otherwise(front / fraction)

    known = F.struct(a.alias("a"), x.alias("x"))
    return F.when(x <= 0, 1.0).when(x.isNotNull() & a.isNotNull(), _let(known, inside))


def normal_two_sided(z: Column | float) -> Column:
    """Both tails of the normal law beyond z and -z."""
    return gamma_upper(0.5, _num(z) * _num(z) / 2)


def t_two_sided(t: Column | float, df: Column | float) -> Column:
    """Both tails of Student's law; an infinite t has none."""
    t, df = _num(t), _num(df)
    z = t * (1 - 1 / (4 * df)) / F.sqrt(1 + t * t / (2 * df))
    return F.when(F.abs(t) == math.inf, 0.0).when(df > LARGE, normal_two_sided(z)).otherwise(beta_cdf(df / (df + t * t), df / 2, 0.5))


def f_upper(f: Column | float, df1: Column | float, df2: Column | float) -> Column:
    """The upper tail of the F law."""
    f, df1, df2 = _num(f), _num(df1), _num(df2)
    return F.when(f == math.inf, 0.0).when(df2 > LARGE, gamma_upper(df1 / 2, df1 * f / 2)).otherwise(beta_cdf(df2 / (df2 + df1 * f), df2 / 2, df1 / 2))


def even_binomial_two_sided(k: Column | int, n: Column | int) -> Column:
    """Exact two-sided p of k out of n at a chance of one half: all outcomes no likelier than k; null for n = 0."""
    k, n = _num(k), _num(n)
    low = F.least(k, n - k)
    z = (n / 2 - low - 0.5) / F.sqrt(n / 4)
    p = F.when(n > LARGE, normal_two_sided(z)).otherwise(2 * beta_cdf(0.5, n - low, low + 1))
    return F.when(n <= 0, None).when(2 * low >= n, 1.0).otherwise(F.least(F.lit(1.0), p))


def beta_quantile(p: Column | float, a: Column | float, b: Column | float, steps: int = 40) -> Column:
    """The inverse of ``beta_cdf``: Newton's steps, halving the bracket where one would leave it."""
    p, a, b = _num(p), _num(a), _num(b)

    def solve(s: Column) -> Column:
        log_beta = log_gamma(s["a"]) + log_gamma(s["b"]) - log_gamma(s["a"] + s["b"])

        def search(l: Column) -> Column:
            def step(v: Column, _: Column) -> Column:
                x = v["x"]
                density = F.exp((s["a"] - 1) * F.ln(x) + (s["b"] - 1) * F.log1p(-x) - l)
                off = beta_cdf(x, s["a"], s["b"]) - s["p"]
                narrow = lambda o: F.struct(F.when(o <= 0, x).otherwise(v["low"]).alias("low"), F.when(o >= 0, x).otherwise(v["high"]).alias("high"), (x - o / _safe(density)).alias("x"), (F.abs(o) < EXACT).alias("hit"))
                inside = lambda w: F.when((w["x"] >= w["low"]) & (w["x"] <= w["high"]), w["x"]).otherwise((w["low"] + w["high"]) / 2)
                on = lambda w: F.struct(w["low"].alias("low"), w["high"].alias("high"), inside(w).alias("x"), (w["hit"] | (F.abs(inside(w) - x) < EXACT * x)).alias("done"))
                return F.when(v["done"], v).otherwise(_let(_let(off, narrow), on))

            start = F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"), (s["a"] / (s["a"] + s["b"])).alias("x"), F.lit(False).alias("done"))
            return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda v: v["x"])

        return _let(log_beta, search)

    known = F.struct(p.alias("p"), a.alias("a"), b.alias("b"))
    return F.when(p <= 0, 0.0).when(p >= 1, 1.0).when(p.isNotNull() & a.isNotNull() & b.isNotNull(), _let(known, solve))


def jeffreys(hits: Column | float, total: Column | float, level: float = 0.95) -> tuple[Column, Column]:
    """The interval of a proportion under Jeffreys' prior; counts may be weighted; null without observations."""
    hits, total = _num(hits), _num(total)
    a, b, tail = hits + 0.5, F.greatest(total - hits, F.lit(0.0)) + 0.5, (1 - level) / 2
    return F.when(total > 0, beta_quantile(tail, a, b)), F.when(total > 0, beta_quantile(1 - tail, a, b))


def signed_rank_p(w: Column, n: Column, ties: Column, exact_up_to: int = 50, least: int = 9) -> Column:
    """Two-sided p of Wilcoxon's rank sum w of n differences: counted over all signs up to ``exact_up_to`` without ties
    (``ties``: sum of t^3 - t), else normal; null under ``least`` differences."""
    w, ties, count = _num(w), _num(ties), n.cast("int")
    n = _num(n)
    whole = (n * (n + 1) / 2).cast("int")
    start = F.array_repeat(F.lit(0.0), whole + 1)
    ways = F.aggregate(F.sequence(F.lit(1), count), F.transform(start, lambda x, i: F.when(i == 0, 1.0).otherwise(x)), lambda v, r: F.transform(v, lambda x, i: x + F.when(i >= r, F.get(v, i - r)).otherwise(0.0)))
    low = F.least(w, n * (n + 1) / 2 - w).cast("int")
    exact = F.least(F.lit(1.0), 2 * F.aggregate(F.slice(ways, 1, low + 1), F.lit(0.0), lambda s, x: s + x) / F.pow(F.lit(2.0), n))
    variance = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    z = (w - n * (n + 1) / 4) / F.sqrt(variance)
    return F.when(n < least, None).when((n <= exact_up_to) & (ties == 0), exact).when(variance > 0, normal_two_sided(z)).otherwise(1.0)
