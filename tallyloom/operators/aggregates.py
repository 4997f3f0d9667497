"""Counts, shares and rollups with ties and zero divisors decided."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan


def counted(df: DataFrame, *by: str | Column) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def modal(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, label, label_n, n): the commonest value of each group (ties to the smaller) and the group's size."""
    per = counted(df, group, value)
    ranked = per.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), value)))
    return ranked.groupBy(group).agg(F.max(F.when(F.col("place") == 1, F.col(value))).alias("label"), F.max(F.when(F.col("place") == 1, F.col("n"))).alias("label_n"), F.sum("n").alias("n"))


def top_and_other(df: DataFrame, value: str, k: int) -> DataFrame:
    """(place, label, n): the k commonest values and one row for the rest."""
    per = counted(df, value)
    top = per.orderBy(F.desc("n"), value).limit(k).withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), value)))
    rest = per.join(F.broadcast(top.select(value)), value, "left_anti").agg(F.count(F.lit(1)).alias("values"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    other = rest.filter("values > 0").select(F.lit(k + 1).alias("place"), F.format_string("other (%d more)", "values").alias("label"), "n")
    return top.select("place", F.col(value).alias("label"), "n").unionByName(other)


def concentration(df: DataFrame, key: str, ks: Sequence[int]) -> DataFrame:
    """(k, held, total, share): what the k largest keys hold of all rows."""
    per = counted(df, key)
    most = max(ks)
    top = per.orderBy(F.desc("n"), key).limit(most).withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), key)))
    held = top.agg(F.array(*(F.struct(F.lit(k).alias("k"), F.coalesce(F.sum(F.when(F.col("place") <= k, F.col("n"))), F.lit(0)).alias("held")) for k in ks)).alias("a")).select(F.inline("a"))
    total = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return held.crossJoin(F.broadcast(total)).withColumn("share", F.try_divide("held", "total"))


def percentages(df: DataFrame, value: str, digits: int = 1) -> DataFrame:
    """(label, n, percent): shares rounded by largest remainder, so that they sum to exactly 100.

    The values are counted first; those with the largest remainders are found by places in ranges, not by one sort.
    """
    unit = 10**digits
    per = counted(df, value)
    total = per.agg(F.sum("n").alias("__total"))
    exact = F.col("n") * (100 * unit) / F.col("__total")
    cut = per.crossJoin(F.broadcast(total)).withColumns({"__floor": F.floor(exact), "__left": F.round(exact - F.floor(exact), 9)})  # total: one row
    short = cut.agg((F.lit(100 * unit) - F.sum("__floor")).alias("__short"))
    placed = scan.positions(cut.withColumn("__less", -F.col("n")), (), ["__left", "__less", value], "__place", descending=True).crossJoin(F.broadcast(short))  # one row
    return placed.select(F.col(value).alias("label"), "n", ((F.col("__floor") + (F.col("__place") < F.col("__short")).cast("int")) / unit).alias("percent"))


def binned(value: Column, edges: Sequence[float], closed: str = "right") -> Column:
    """The 1-based bin of a value between edges, closed on the right or on the left; null outside."""
    out = F.lit(None).cast("int")
    for i in range(len(edges) - 1, 0, -1):
        low, high = F.lit(float(edges[i - 1])), F.lit(float(edges[i]))
        inside = (value > low) & (value <= high) if closed == "right" else (value >= low) & (value < high)
        out = F.when(inside, F.lit(i)).otherwise(out)
    return out


def shares_within(df: DataFrame, group: str, bucket: Column, name: str = "bin") -> DataFrame:
    """(group, bin, n, share) with the share of the group's rows that fall in a bin."""
    per = df.select(group, bucket.alias(name)).dropna().groupBy(group, name).agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(group)))


def crosstab(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts by row, one column for each of ``values``; absent pairs are 0."""
    return df.groupBy(row).pivot(column, list(values)).agg(F.count(F.lit(1))).na.fill(0)


def pareto(df: DataFrame, cost: str, gain: str) -> DataFrame:
    """Distinct points that no point of at most the cost and at least the gain dominates.

    Reduced to the best gain of each cost, then to a running maximum over ranges of costs.
    """
    best = df.groupBy(cost).agg(F.max(gain).alias(gain))
    before = scan.running(best, (), [cost], gain, "__before", "max")
    return before.filter(F.col(gain).isNotNull() & (F.col("__before").isNull() | (F.col(gain) > F.col("__before")))).select(cost, gain)


def steady_mean(value: Column, digits: int = 4) -> Column:
    """The mean of a group, the same in whatever order its rows are added: whole units of ``10 ** -digits`` are summed where
    all values are such decimal numbers; else the plain mean, whose last digit depends on the order."""
    x, unit = value.cast("double"), 10**digits
    units = F.rint(x * unit)
    whole = (F.abs(units) < 2**53) & (units / unit == x)
    total = F.try_sum(F.when(whole, units.cast("long")))
    return F.when((F.count_if(~whole) == 0) & total.isNotNull(), total / (F.count(x) * unit)).otherwise(F.avg(x))


def frontier(runs: DataFrame, arm: Sequence[str], cost: str, gain: str, repeats: int = 3) -> DataFrame:
    """(arm, gain, spread, cost, repeats, on_frontier): arms with at least ``repeats`` runs of known cost, and whether no other
    such arm costs no more and gains no less, one of them strictly.  Equal arms do not beat each other, in whatever order their rows come (``steady_mean``)."""
    arms = runs.filter(F.col(cost).isNotNull()).groupBy(*arm).agg(steady_mean(F.col(gain)).alias(gain), F.stddev_samp(gain).alias("spread"), steady_mean(F.col(cost)).alias(cost), F.count(gain).alias("repeats")).filter(F.col("repeats") >= repeats)
    front = pareto(arms, cost, gain).select(F.col(cost).alias("__cost"), F.col(gain).alias("__gain"))
    met = arms.join(front, (F.col(cost) == F.col("__cost")) & (F.col(gain) == F.col("__gain")), "left")
    return met.withColumn("on_frontier", F.col("__cost").isNotNull()).drop("__cost", "__gain")


def reindexed(df: DataFrame, key: str, order: DataFrame, fills: dict) -> DataFrame:
    """Rows for every key of ``order``, in its order column's sense; missing ones are filled."""
    return order.join(df, key, "left").na.fill(fills)


def reconciled(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, before, after, change) of two count tables, a missing one being 0."""
    both = a.select(key, F.col("n").alias("before")).join(b.select(key, F.col("n").alias("after")), key, "full_outer").na.fill(0, ["before", "after"])
    return both.withColumn("change", F.col("after") - F.col("before"))


def thin_records(df: DataFrame, fields: Sequence[str], side: str, thin: int = 7) -> DataFrame:
    """(side, band, place, n, records, share): how many of ``fields`` a record carries, all below ``thin`` in one band at the
    end; every band of every side has a row, sides being those that occur."""
    held = sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0))
    per = df.groupBy(side).agg(F.count(F.lit(1)).alias("records"), *(F.count_if(held == b).alias(f"b{b}") for b in range(thin, len(fields) + 1)), F.count_if(held < thin).alias("few"))
    bands = [(str(b), len(fields) - b, f"b{b}") for b in range(len(fields), thin - 1, -1)] + [(f"{thin - 1} or fewer", len(fields) - thin + 1, "few")]
    cells = F.explode(F.array(*(F.struct(F.lit(label).alias("band"), F.lit(place).alias("place"), F.col(c).alias("n")) for label, place, c in bands))).alias("c")
    return per.select(side, "records", cells).select(side, "c.*", "records", F.try_divide("c.n", "records").alias("share"))


def clipped_histogram(df: DataFrame, value: str, bins: int = 30, clip: float | None = None, log: bool = False, split: str | None = None) -> DataFrame:
    """(split, bin, low, high, n): ``bins`` edges over the values, so one bin fewer; only bins that hold rows.

    ``clip``: rows above this percentile are dropped; ``log``: edges are equal steps of the logarithm and only values above
    zero count.  A bin holds its lower edge, the last one both.  Percentiles are exact and no task holds the values.
    """
    rows = df.select(*([split] if split else []), F.col(value).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    if clip is not None:
        ceiling = scan.percentiles(rows, "v", (clip,)).select(F.col("p0").alias("__ceiling"))
        rows = rows.crossJoin(F.broadcast(ceiling)).filter("v <= __ceiling").drop("__ceiling")  # one row
    if log:
        rows = rows.filter("v > 0")
    axis = (lambda c: F.log10(c)) if log else (lambda c: c)
    back = (lambda c: F.pow(F.lit(10.0), c)) if log else (lambda c: c)
    ends = rows.agg(F.min("v").alias("a"), F.max("v").alias("b"))
    step = (axis(F.col("b")) - axis(F.col("a"))) / (bins - 1)
    inner = F.transform(F.sequence(F.lit(1), F.lit(bins - 2)), lambda i: back(axis(F.col("a")) + i * step)) if bins > 2 else F.array().cast("array<double>")
    edges = ends.select(F.concat(F.array("a"), inner, F.array("b")).alias("__edges"))
    at = F.least(F.size(F.filter("__edges", lambda e: e <= F.col("v"))), F.lit(bins - 1))
    dealt = rows.crossJoin(F.broadcast(edges)).withColumns({"bin": at - 1, "low": F.get("__edges", at - 1), "high": F.get("__edges", at)})  # edges: one row
    return dealt.groupBy(*([split] if split else []), "bin", "low", "high").agg(F.count(F.lit(1)).alias("n"))
