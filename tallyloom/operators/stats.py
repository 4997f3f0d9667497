"""Rank correlation, agreement, weighted scores, tests and intervals, all as plans: nothing runs while they are built."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special
from . import scan


def correlation(x: str, y: str) -> Column:
    """Pearson's, null where a column is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def value_ranks(df: DataFrame, value: str, by: Sequence[str] = (), weight: Column | None = None, ranges: int = scan.RANGES) -> DataFrame:
    """(by, value, n, index, rank): average ranks of all rows of a group by value, from counts of its distinct values."""
    out = scan.value_counts(df, value, by, weight, ranges)
    return out.select(*by, value, "n", "index", (F.col("below") + (F.col("n") + 1) / 2.0).alias("rank"))


def _ranked(df: DataFrame, c: str, by: Sequence[str], rank: str, weight: Column | None = None) -> DataFrame:
    """``df`` with the rank of ``c`` in its group and, as ``<rank>_index``, how many values are smaller."""
    right = value_ranks(df, c, by, weight).select(*(F.col(k).alias(f"__b_{k}") for k in (*by, c)), F.col("rank").alias(rank), F.col("index").alias(f"{rank}_index"))
    same = F.lit(True)
    for k in (*by, c):
        same = same & F.col(k).eqNullSafe(F.col(f"__b_{k}"))
    return df.join(right, same).drop(*(f"__b_{k}" for k in (*by, c)))


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = (), rows: int = 5, distinct: int = 3) -> DataFrame:
    """(by, n, rho) over groups of at least ``rows`` pairs with ``distinct`` values of each; without ``by`` of all rows.

    Equal pairs are counted first and ranks come from counts of values, so a group of any size spreads over its values.
    """
    pairs = df.select(*by, x, y).dropna(subset=[x, y]).groupBy(*by, x, y).agg(F.count(F.lit(1)).alias("__m"))
    ranked = _ranked(_ranked(pairs, x, by, "rx", F.col("__m")), y, by, "ry", F.col("__m"))
    m = F.col("__m").cast("double")
    sums = ranked.groupBy(*by).agg(
        F.sum("__m").alias("n"), F.max("rx_index").alias("dx"), F.max("ry_index").alias("dy"),
        *(F.sum(m * F.col(a) * F.col(b)).alias(k) for k, a, b in (("xx", "rx", "rx"), ("yy", "ry", "ry"), ("xy", "rx", "ry"))),
    )
    if by:
        sums = sums.filter((F.col("n") >= rows) & (F.col("dx") + 1 >= distinct) & (F.col("dy") + 1 >= distinct))
    n = F.col("n").cast("double")
    middle = n * (n + 1) * (n + 1) / 4  # n times the square of the mean rank
    return sums.select(*by, "n", F.try_divide(F.col("xy") - middle, F.sqrt((F.col("xx") - middle) * (F.col("yy") - middle))).alias("rho"))


def sign_summary(groups: DataFrame, rho: str, expected: int) -> DataFrame:
    """Median of the groups' correlations and the share with the expected sign; zero has none."""
    known = groups.filter(F.col(rho).isNotNull())
    return known.agg(F.count(F.lit(1)).alias("groups"), F.median(rho).alias("median_rho"), F.avg((F.signum(rho) == expected).cast("double")).alias("as_expected"))


def signed_rank(df: DataFrame, value: str, by: Sequence[str] = (), least: int = 9) -> DataFrame:
    """(by, n, w, p): Wilcoxon's test of each group against zero, zeros dropped; p is null under ``least`` values."""
    known = df.filter(F.col(value).isNotNull() & (F.col(value) != 0)).select(*by, F.abs(value).alias("__size"), (F.col(value) > 0).alias("__up"))
    ups = known.groupBy(*by, "__size").agg(F.count(F.lit(1)).alias("__m"), F.count_if("__up").alias("__ups"))
    ranked = _ranked(ups, "__size", by, "__rank", F.col("__m"))
    m = F.col("__m").cast("double")
    out = ranked.groupBy(*by).agg(F.coalesce(F.sum("__m"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("__ups") * F.col("__rank")), F.lit(0.0)).alias("w"), F.coalesce(F.sum(m * m * m - m), F.lit(0.0)).alias("__ties"))
    return out.select(*by, "n", "w", special.signed_rank_p(F.col("w"), F.col("n"), F.col("__ties"), least=least).alias("p"))


def agreement(df: DataFrame, a: Column, b: Column, weight: Column | None = None) -> DataFrame:
    """Weighted 2x2 table of two true/false answers: n, agree, kappa; rows with a null answer are left out."""
    w = F.lit(1.0) if weight is None else weight
    cell = lambda test: F.coalesce(F.sum(F.when(test, F.col("w"))), F.lit(0.0))
    known = df.select(a.alias("a"), b.alias("b"), w.alias("w")).dropna()
    c = known.agg(cell(F.col("a") & F.col("b")).alias("yy"), cell(F.col("a") & ~F.col("b")).alias("yn"), cell(~F.col("a") & F.col("b")).alias("ny"), cell(~F.col("a") & ~F.col("b")).alias("nn"))
    n = F.col("yy") + F.col("yn") + F.col("ny") + F.col("nn")
    agree = F.try_divide(F.col("yy") + F.col("nn"), n)
    chance = F.try_divide((F.col("yy") + F.col("yn")) * (F.col("yy") + F.col("ny")) + (F.col("nn") + F.col("yn")) * (F.col("nn") + F.col("ny")), n * n)
    return c.select("yy", "yn", "ny", "nn", agree.alias("agree"), F.try_divide(agree - chance, 1 - chance).alias("kappa"))


def evaluable_agreement(df: DataFrame, a: Column, b: Column, evaluable: Column, by: Sequence[str] = ()) -> DataFrame:
    """Records, how often two answers agree over all and over those that ``evaluable`` holds for, and a split whose three
    parts sum to the records: agree, disagree (both evaluable), no counterpart.  A null answer agrees with nothing."""
    rows = df.select(*by, F.coalesce(a == b, F.lit(False)).alias("s"), F.coalesce(evaluable, F.lit(False)).alias("e"))
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("records"), F.count_if("s").alias("__same"), F.count_if("e").alias("evaluable"), F.count_if(F.col("s") & F.col("e")).alias("agree"))
    return out.withColumns({"agreement": F.try_divide("__same", "records"), "agreement_evaluable": F.try_divide("agree", "evaluable"), "disagree": F.col("evaluable") - F.col("agree"), "no_counterpart": F.col("records") - F.col("evaluable")}).drop("__same")


def weighted_scores(df: DataFrame, said: Column, truth: Column, weight: Column, by: Sequence[str] = ()) -> DataFrame:
    """Weighted precision, recall and F1 of ``said`` against ``truth``."""
    rows = df.select(*by, said.alias("s"), truth.alias("t"), weight.alias("w"))
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("w"))), F.lit(0.0))
    sums = rows.groupBy(*by).agg(total(F.col("s") & F.col("t")).alias("tp"), total(F.col("s") & ~F.col("t")).alias("fp"), total(~F.col("s") & F.col("t")).alias("fn"))
    return sums.withColumns({"precision": F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)), "recall": F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0)), "f1": F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))})


def arms_tests(df: DataFrame, arm: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, a, b, difference, t, dof, p, p_corrected): equal-variance t-tests of every two arms of a group, with Bonferroni's
    correction over the group's tests.  Arms of fewer than two values take part in none; p is null where both arms are the
    same constant."""
    per = df.filter(F.col(value).isNotNull()).groupBy(*by, arm).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v")).filter("n > 1")
    arms = per.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(arm).alias("arm"), "n", "m", "v"))).alias("arms"))  # a row an arm
    pairs = F.flatten(F.transform("arms", lambda a, i: F.transform(F.slice("arms", i + 2, F.size("arms")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    rows = arms.select(*by, pairs.alias("pairs")).select(*by, F.size("pairs").alias("__tests"), F.explode("pairs").alias("q")).select(*by, "__tests", "q.a", "q.b")
    dof = F.col("a.n") + F.col("b.n") - 2
    pooled = ((F.col("a.n") - 1) * F.col("a.v") + (F.col("b.n") - 1) * F.col("b.v")) / dof
    difference = F.col("a.m") - F.col("b.m")
    t = F.when(pooled > 0, difference / F.sqrt(pooled * (1 / F.col("a.n") + 1 / F.col("b.n")))).when(difference != 0, F.signum(difference) * math.inf)
    made = rows.select(*by, F.col("a.arm").alias("a"), F.col("b.arm").alias("b"), difference.alias("difference"), t.alias("t"), dof.alias("dof"), "__tests")
    made = made.withColumn("p", special.t_two_sided(F.col("t"), F.col("dof")))
    return made.withColumn("p_corrected", F.least(F.lit(1.0), F.col("p") * F.col("__tests"))).drop("__tests")


def anova(df: DataFrame, arm: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, arms, n, f, p): one-way analysis of variance of each group from sums of its arms; null where it has no spread
    inside arms or only one arm."""
    per = df.filter(F.col(value).isNotNull()).groupBy(*by, arm).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("v"))
    sums = per.groupBy(*by).agg(F.count(F.lit(1)).alias("arms"), F.sum("n").alias("total"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), F.collect_list(F.struct("n", "m", "v")).alias("a"))  # a row an arm
    between = F.aggregate("a", F.lit(0.0), lambda s, x: s + x["n"] * F.pow(x["m"] - F.col("mean"), F.lit(2)))
    within = F.aggregate("a", F.lit(0.0), lambda s, x: s + (x["n"] - 1) * x["v"])
    f = F.when((F.col("arms") > 1) & (within > 0), F.try_divide(between / (F.col("arms") - 1), within / (F.col("total") - F.col("arms"))))
    out = sums.select(*by, "arms", F.col("total").alias("n"), f.alias("f"))
    return out.withColumn("p", special.f_upper(F.col("f"), F.col("arms") - 1, F.col("n") - F.col("arms")))


def mcnemar(df: DataFrame, a: Column, b: Column, truth: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by, pairs, only_a, only_b, p): rows where exactly one of two answers is the true one, and the exact test of whether
    either wins more often; p is null without such rows."""
    rows = df.select(*by, (a == truth).alias("a"), (b == truth).alias("b"))
    out = rows.groupBy(*by).agg(F.count_if(F.col("a") & ~F.col("b")).alias("only_a"), F.count_if(F.col("b") & ~F.col("a")).alias("only_b"))
    return out.select(*by, (F.col("only_a") + F.col("only_b")).alias("pairs"), "only_a", "only_b", special.even_binomial_two_sided(F.col("only_a"), F.col("only_a") + F.col("only_b")).alias("p"))


def proportions(df: DataFrame, hit: Column, by: Sequence[str] = (), level: float = 0.95) -> DataFrame:
    """(by, n, hits, share, low, high): the share of rows that ``hit`` holds for, with Jeffreys' interval."""
    out = df.select(*by, hit.alias("__h")).filter("__h is not null").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if("__h").alias("hits"))
    low, high = special.jeffreys(F.col("hits"), F.col("n"), level)
    return out.withColumns({"share": F.try_divide("hits", "n"), "low": low, "high": high})


def grader_table(decisions: DataFrame, graders: Mapping[str, Column], wrong: Column, weight: Column, sampled: Column, by: Sequence[str] = (), level: float = 0.95) -> DataFrame:
    """One row a grader: how its flags stand against human decisions.

    (by, grader, flagged, right, precision, precision_low, precision_high, recall, recall_low, recall_high, f1, kappa, raw, weighted).
    Flags are censused, so precision counts rows.  Recall, kappa and ``weighted`` agreement weigh them.  Recall's interval
    keeps censused strata exact: only the rate of wrong rows in the ``sampled`` stratum is unknown, and recall falls as it
    rises, so the ends are the recall at the ends of that rate's posterior (what drawing from it would come to).
    """
    rows = decisions.select(*by, F.coalesce(wrong, F.lit(False)).alias("w"), weight.cast("double").alias("m"), F.coalesce(sampled, F.lit(False)).alias("s"), F.explode(F.array(*(F.struct(F.lit(k).alias("grader"), F.coalesce(v, F.lit(False)).alias("f")) for k, v in graders.items()))).alias("g")).select(*by, "w", "m", "s", "g.*")
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("m"))), F.lit(0.0))
    w, f, s = F.col("w"), F.col("f"), F.col("s")
    c = rows.groupBy(*by, "grader").agg(
        F.count(F.lit(1)).alias("n"), F.sum("m").alias("all"), F.count_if(f).alias("flagged"), F.count_if(f & w).alias("right"), F.count_if(f == w).alias("same"), total(f == w).alias("same_w"),
        total(f & w).alias("a"), total(f & ~w).alias("b"), total(~f & w).alias("c"), total(~f & ~w).alias("d"), total(s).alias("pool"), F.count_if(s).alias("drawn"), F.count_if(s & w).alias("drawn_wrong"),
        total(~s & w).alias("census_wrong"), total(~s & w & f).alias("caught"),
    )
    low, high = special.jeffreys(F.col("right"), F.col("flagged"), level)
    rate_low, rate_high = special.jeffreys(F.col("drawn_wrong"), F.col("drawn"), level)
    at = lambda rate: F.col("caught") / F.greatest(F.col("census_wrong") + rate * F.round("pool"), F.lit(1e-9))
    c = c.withColumns({"precision": F.try_divide("right", "flagged"), "precision_low": low, "precision_high": high, "recall": F.try_divide("a", F.col("a") + F.col("c")), "recall_low": at(rate_high), "recall_high": at(rate_low)})
    f1 = F.when((F.col("precision") > 0) & (F.col("recall") > 0), 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    chance = ((F.col("a") + F.col("b")) * (F.col("a") + F.col("c")) + (F.col("c") + F.col("d")) * (F.col("b") + F.col("d"))) / (F.col("all") * F.col("all"))
    kappa = F.when(chance < 1, ((F.col("a") + F.col("d")) / F.col("all") - chance) / (1 - chance))
    c = c.withColumns({"f1": f1, "kappa": kappa, "raw": F.try_divide("same", "n"), "weighted": F.try_divide("same_w", "all")})
    return c.select(*by, "grader", "flagged", "right", "precision", "precision_low", "precision_high", "recall", "recall_low", "recall_high", "f1", "kappa", "raw", "weighted")


#: Largest mean whose Poisson law is summed term by term; above it the law's expansion around the normal one is used.
SUMMED = 64


def poisson(mean: Column, u: Column, v: Column) -> Column:
    """A Poisson draw of whole number from two uniform numbers: by inverse up to ``SUMMED``, else by the normal law of Box
    and Muller with the first correction for skewness."""
    m = F.greatest(mean.cast("double"), F.lit(1e-12))
    steps = (m + 12 * F.sqrt(m) + 20).cast("int")
    start = F.struct(F.exp(-m).alias("p"), F.exp(-m).alias("sum"), F.lit(0).alias("k"))
    more = lambda s, i: F.when(s["sum"] > u, s).otherwise(F.struct((s["p"] * m / i).alias("p"), (s["sum"] + s["p"] * m / i).alias("sum"), (s["k"] + 1).alias("k")))
    summed = F.aggregate(F.sequence(F.lit(1), steps), start, more, lambda s: s["k"].cast("long"))
    z = F.sqrt(-2 * F.ln(F.greatest(u, F.lit(1e-300)))) * F.cos(2 * math.pi * v)
    return F.when(m <= SUMMED, summed).otherwise(F.greatest(F.lit(0), F.floor(m + F.sqrt(m) * z + (z * z - 1) / 6 + 0.5)))


def settled(value: Column, digits: int) -> Column:
    """Rounded half up, where anything within a thousandth of the last digit counts as the half: engines agree on ties."""
    return F.round(value + 10.0 ** -(digits + 3), digits)


def paired_bootstrap(df: DataFrame, before: Column, after: Column, resamples: int = 10_000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """(n, shift, low, high): the mean of after - before over rows with both, and its percentile interval over resamples.

    Rows of one difference are alike, so each difference is drawn as often as a Poisson law with its count as mean says
    (two numbers from the MD5 of seed, difference and resample); the cost is differences times resamples, whatever the rows.
    """
    rows = df.select((after.cast("double") - before.cast("double")).alias("d")).filter("d is not null")
    kinds = rows.groupBy("d").agg(F.count(F.lit(1)).alias("m"))
    drawn = kinds.select("d", "m", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("r"))
    hashed = F.md5(F.concat_ws("|", F.lit(str(seed)), F.format_string("%.6f", "d"), F.col("r").cast("string")))
    part = lambda at: F.conv(F.substring(hashed, at, 12), 16, 10).cast("double") / 2.0**48
    means = drawn.withColumns({"u": part(1), "v": part(13)}).groupBy("r").agg(F.sum(poisson(F.col("m"), F.col("u"), F.col("v"))).alias("w"), F.sum(F.col("d") * poisson(F.col("m"), F.col("u"), F.col("v"))).alias("s"))
    tail = (1 - level) / 2
    edges = scan.percentiles(means.select(F.try_divide("s", "w").alias("mean")), "mean", (tail, 1 - tail)).select(F.col("p0").alias("low"), F.col("p1").alias("high"))
    whole = kinds.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n"), F.try_divide(F.sum(F.col("d") * F.col("m")), F.sum("m")).alias("shift"))
    return whole.crossJoin(F.broadcast(edges))  # one row each


def rolling_median(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, window: int) -> DataFrame:
    """The centred rolling median over ``window`` rows, one more before than after if even; null with fewer than half of them.

    Groups are cut into blocks of equal numbers of rows with the neighbours' borders (``scan.framed``).
    """
    median = lambda w: {"rolling_median": F.when(F.count(value).over(w) >= max(1, window // 2), F.percentile(value, F.lit(0.5)).over(w))}
    return scan.framed(df, by, order, window // 2, (window - 1) // 2, median)


def noise_flag(df: DataFrame, side: Column, hit: Column) -> DataFrame:
    """Difference of two proportions, its standard error and whether it is within two of them."""
    c = df.agg(*(f(F.when(s, hit.cast("double"))).alias(n) for n, f, s in (("p1", F.avg, side), ("n1", F.count, side), ("p2", F.avg, ~side), ("n2", F.count, ~side))))
    se = F.sqrt(F.try_divide(F.col("p1") * (1 - F.col("p1")), F.col("n1")) + F.try_divide(F.col("p2") * (1 - F.col("p2")), F.col("n2")))
    return c.withColumn("difference", F.col("p1") - F.col("p2")).withColumn("se", se).withColumn("noise", F.abs("difference") <= 2 * F.col("se"))
