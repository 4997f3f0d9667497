"""Order without one task: ranges, prefix sums over them, and windows inside.

A running value over a hot group (or over a whole table) needs an order, and a window alone would sort the group in one
task.  Here rows are dealt to ``RANGES`` ranges of the first order column, by approximate quantiles that travel as one row;
each (group, range) is summed, the at most ``RANGES`` sums of a group are added up in order, and windows run inside ranges
only.  A group with nine tenths of the rows sets the quantiles and so spreads over nine tenths of the ranges.  Rows that
are equal in the first order column stay in one range; where values repeat a lot, count them first (``value_ranks`` does).

Everything is a lazy plan; nulls in the first order column come first.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 200
#: Rows up to which a group is ordered in one range, where the caller lets it.
HOT = 500_000


def order_number(df: DataFrame, column: str) -> Column:
    """The column as a number that sorts like it: numbers, dates, time stamps with or without a zone."""
    kind = dict(df.dtypes)[column]
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return F.unix_micros(F.col(column).cast("timestamp")).cast("double")
    if kind in ("string", "binary", "boolean") or kind.startswith(("array", "map", "struct")):
        raise TypeError(f"{column} is {kind}; ranges need a number or a time")
    return F.col(column).cast("double")


def ranged(df: DataFrame, by: Sequence[str], column: str, ranges: int = RANGES, name: str = "__range", descending: bool = False, hot: int = 0) -> DataFrame:
    """``df`` with the range of each row, from 0 on; the same value is always in the same range.

    ``hot``: groups of ``by`` with at most so many rows are one range, which saves the search of their values.
    """
    several = bool(by) and hot > 0
    if several:  # at most the number of rows over ``hot`` groups
        big = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__rows")).filter(F.col("__rows") > hot).select(*(F.col(c).alias(f"__k_{c}") for c in by), F.lit(True).alias("__hot"))
        same = F.lit(True)
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
        df = df.join(F.broadcast(big), same, "left").drop(*(f"__k_{c}" for c in by))
    value = order_number(df, column)
    cuts = F.array(*(F.lit(i / ranges) for i in range(1, ranges)))
    edges = (df.filter("__hot") if several else df).agg(F.coalesce(F.array_distinct(F.percentile_approx(value, cuts, F.lit(20 * ranges))), F.array().cast("array<double>")).alias("__edges"))
    # binary search over the sorted edges: how many are below the value
    steps = max(1, ranges.bit_length() + 1)
    half = lambda s: F.floor((s["low"] + s["high"]) / 2).cast("int")
    go = lambda s: F.when(s["low"] >= s["high"], s).when(F.get(F.col("__edges"), half(s)) < F.col("__value"), F.struct((half(s) + 1).alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), half(s).alias("high")))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0).alias("low"), F.size("__edges").alias("high")), lambda s, _: go(s), lambda s: s["low"])
    place = F.when(F.col("__value").isNull(), -1).otherwise(found)
    place = F.when(F.col("__hot"), place).otherwise(0) if several else place
    out = df.withColumn("__value", value).crossJoin(F.broadcast(edges)).withColumn(name, -place if descending else place)  # edges: one row
    return out.drop("__edges", "__value", "__hot")


def offsets(dealt: DataFrame, by: Sequence[str], sums: dict[str, Column], range_: str = "__range", of: Callable[[Column], Column] = F.sum) -> DataFrame:
    """(by, range, names of ``sums``): each aggregate combined over the earlier ranges of the group, null in the first."""
    per = dealt.groupBy(*by, range_).agg(*(v.alias(k) for k, v in sums.items()))
    before = Window.partitionBy(*by).orderBy(range_).rowsBetween(Window.unboundedPreceding, -1)
    return per.select(*by, range_, *(of(F.col(k)).over(before).alias(k) for k in sums))


def _joined(dealt: DataFrame, found: DataFrame, by: Sequence[str], range_: str) -> DataFrame:
    """``dealt`` with the offsets of its group and range; null groups meet too."""
    right = found.select(*(F.col(c).alias(f"__k_{c}") for c in (*by, range_)), *(c for c in found.columns if c not in (*by, range_)))
    same = F.lit(True)
    for c in (*by, range_):
        same = same & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    return dealt.join(right, same, "left").drop(*(f"__k_{c}" for c in (*by, range_)))


def positions(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "position", ranges: int = RANGES, descending: bool = False) -> DataFrame:
    """``df`` with each row's place in its group from 0 on, in the order of ``order`` (of which ``descending`` turns the first)."""
    dealt = ranged(df, by, order[0], ranges, descending=descending, hot=HOT)
    below = offsets(dealt, by, {"__below": F.count(F.lit(1))})
    first = F.desc_nulls_last(order[0]) if descending else F.asc_nulls_first(order[0])
    inside = F.row_number().over(Window.partitionBy(*by, "__range").orderBy(first, *order[1:])) - 1
    out = _joined(dealt.withColumn("__inside", inside), below, by, "__range")
    return out.withColumn(name, F.col("__inside") + F.coalesce("__below", F.lit(0))).drop("__inside", "__below", "__range")


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, name: str, how: str = "sum", ranges: int = RANGES) -> DataFrame:
    """``df`` with the sum (or max, min) of ``value`` over the rows before this one in its group; null where there is none."""
    f = {"sum": F.sum, "max": F.max, "min": F.min}[how]
    dealt = ranged(df, by, order[0], ranges)
    before = offsets(dealt, by, {"__before": f(value)}, of=f)
    inside = f(F.col(value)).over(Window.partitionBy(*by, "__range").orderBy(F.asc_nulls_first(order[0]), *order[1:]).rowsBetween(Window.unboundedPreceding, -1))
    out = _joined(dealt.withColumn("__inside", inside), before, by, "__range")
    both = {"sum": F.coalesce(F.col("__inside") + F.col("__before"), "__inside", "__before"), "max": F.greatest("__inside", "__before"), "min": F.least("__inside", "__before")}[how]
    return out.withColumn(name, both).drop("__inside", "__before", "__range")


def value_counts(df: DataFrame, value: str, by: Sequence[str] = (), weight: Column | None = None, ranges: int = RANGES) -> DataFrame:
    """(by, value, n, index, below): how often each value occurs in its group (or the sum of ``weight``), how many values of
    the group are smaller, and how many rows."""
    per = df.groupBy(*by, value).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n"))
    dealt = ranged(per, by, value, ranges, hot=HOT)
    below = offsets(dealt, by, {"__index": F.count(F.lit(1)), "__below": F.sum("n")})
    w = Window.partitionBy(*by, "__range").orderBy(F.asc_nulls_first(value))
    inside = {"__i": F.row_number().over(w) - 1, "__b": F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1))}
    out = _joined(dealt.withColumns(inside), below, by, "__range")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(*by, value, "n", (F.col("__i") + zero("__index")).alias("index"), (zero("__b") + zero("__below")).alias("below"))


def percentiles(df: DataFrame, value: str, shares: Sequence[float], by: Sequence[str] = (), weight: Column | None = None, ranges: int = RANGES) -> DataFrame:
    """(by, n, p0, p1, ...): exact percentiles with linear interpolation between neighbours, without holding a group's values;
    with ``weight`` (whole numbers) each row stands for so many."""
    known = df.select(*by, value, (F.lit(1) if weight is None else weight).alias("__w")).filter(F.col(value).isNotNull())
    total = known.groupBy(*by).agg(F.sum("__w").alias("__n"))
    met = _joined_on(value_counts(known, value, by, F.col("__w"), ranges), total, by)
    picks = []
    for i, p in enumerate(shares):
        at = (F.col("__n") - 1) * F.lit(float(p))
        hit = lambda k: F.max(F.when((F.col("below") <= k) & (k < F.col("below") + F.col("n")), F.col(value).cast("double")))
        picks += [hit(F.floor(at)).alias(f"__low{i}"), hit(F.ceil(at)).alias(f"__high{i}"), F.max(at - F.floor(at)).alias(f"__part{i}")]
    out = met.groupBy(*by).agg(F.max("__n").alias("n"), *picks)
    return out.select(*by, "n", *((F.col(f"__low{i}") + (F.col(f"__high{i}") - F.col(f"__low{i}")) * F.col(f"__part{i}")).alias(f"p{i}") for i in range(len(shares))))


def _joined_on(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    if not by:
        return left.crossJoin(F.broadcast(right))  # one row
    right = right.select(*(F.col(c).alias(f"__k_{c}") for c in by), *(c for c in right.columns if c not in by))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    return left.join(right, same).drop(*(f"__k_{c}" for c in by))


def framed(df: DataFrame, by: Sequence[str], order: Sequence[str], before: int, after: int, made: Callable[[Window], dict[str, Column]], rows: int = 4096, ranges: int = RANGES) -> DataFrame:
    """``df`` with the columns that ``made`` computes over a frame of ``before`` rows before and ``after`` after each row.

    Rows are numbered in their group and cut into blocks of equal numbers of rows; the rows at a border are copied into the
    neighbouring block too, so each block has its frames whole and a hot group is as many tasks as it has blocks.
    """
    size = max(rows, 4 * (before + after))
    placed = positions(df, by, order, "__at", ranges)
    own = F.floor(F.col("__at") / size)
    halo = F.explode(F.array_distinct(F.array(own, F.floor((F.col("__at") + before) / size), F.greatest(F.floor((F.col("__at") - after) / size), F.lit(0).cast("long")))))
    blocks = placed.withColumn("__block", halo)
    w = Window.partitionBy(*by, "__block").orderBy("__at").rowsBetween(-before, after)
    return blocks.withColumns(made(w)).filter(F.col("__block") == own).drop("__block", "__at")
