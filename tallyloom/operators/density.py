"""Kernel densities on a grid: rows become counts of cells, and each cell is spread over the offsets of the kernel.

The rows are read for their moments and for the counts; from there on everything has the size of the grid.  Cells take
the place of the values in them, so a density is that of the values rounded to the grid.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan

#: Standard deviations of the kernel after which its weight counts as none.
REACH = 6.0


def _cell(value: Column, view: tuple[float, float], cells: int) -> Column:
    """The cell of a value, from 0 on; cells go on outside the view."""
    return F.floor((value - view[0]) * cells / (view[1] - view[0])).cast("long")


def _known(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    good = df.select(*by, *(F.col(c).cast("double").alias(c) for c in columns))
    for c in columns:
        good = good.filter(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != math.inf))
    return good


def plane(df: DataFrame, x: str, y: str, view_x: tuple[float, float], view_y: tuple[float, float], by: Sequence[str] = (), cells: int = 60, enclose: float = 0.9) -> DataFrame:
    """(by, i, j, n, density, inside): the Gaussian density of each group's points at the centres of cells, by Scott's rule over
    the full covariance, and the smallest region that encloses a share of the group's points.

    The region's level is the percentile 1 - ``enclose`` of the density at the points, so it follows the kernel out of the
    view until no weight is left.  Groups of fewer than three points, or on one line, have no density and no rows.
    """
    wide, high = (view_x[1] - view_x[0]) / cells, (view_y[1] - view_y[0]) / cells
    known = _known(df, [x, y], by)
    counts = known.groupBy(*by, _cell(F.col(x), view_x, cells).alias("i"), _cell(F.col(y), view_y, cells).alias("j")).agg(F.count(F.lit(1)).alias("n"))
    moments = known.groupBy(*by).agg(F.count(F.lit(1)).alias("__all"), F.var_samp(x).alias("__xx"), F.var_samp(y).alias("__yy"), F.covar_samp(x, y).alias("__xy"))
    scott = F.pow("__all", F.lit(-1 / 3))  # the square of n^(-1/6)
    moments = moments.filter("__all > 2").withColumns({c: F.col(c) * scott for c in ("__xx", "__yy", "__xy")})
    moments = moments.withColumn("__det", F.col("__xx") * F.col("__yy") - F.col("__xy") * F.col("__xy")).filter(F.col("__det") > 1e-12 * F.col("__xx") * F.col("__yy"))
    steps = lambda var, size: F.ceil(REACH * F.sqrt(var) / size).cast("int")
    met = scan._joined_on(counts, moments, by)  # one row a group
    met = met.withColumn("__a", F.explode(F.sequence(-steps(F.col("__xx"), wide), steps(F.col("__xx"), wide)))).withColumn("__b", F.explode(F.sequence(-steps(F.col("__yy"), high), steps(F.col("__yy"), high))))
    dx, dy = F.col("__a") * wide, F.col("__b") * high
    squared = (F.col("__yy") * dx * dx - 2 * F.col("__xy") * dx * dy + F.col("__xx") * dy * dy) / F.col("__det")
    met = met.filter(squared <= REACH * REACH).withColumn("__w", F.exp(-squared / 2) / (2 * math.pi * F.sqrt("__det") * F.col("__all")))
    field = met.groupBy(*by, (F.col("i") + F.col("__a")).alias("i"), (F.col("j") + F.col("__b")).alias("j")).agg(F.sum(F.col("n") * F.col("__w")).alias("density"))
    seen = counts.select(*(F.col(c).alias(f"__k_{c}") for c in (*by, "i", "j")), "n")
    same = F.lit(True)
    for c in (*by, "i", "j"):
        same = same & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    field = field.join(seen, same, "left").select(*by, "i", "j", F.coalesce("n", F.lit(0)).alias("n"), "density")
    level = scan.percentiles(field.filter("n > 0"), "density", (1 - enclose,), by, weight=F.col("n")).select(*by, F.col("p0").alias("__level"))
    return scan._joined_on(field, level, by).withColumn("inside", F.col("density") >= F.col("__level")).drop("__level")


def curve(df: DataFrame, value: str, view: tuple[float, float], by: Sequence[str] = (), cells: int = 200) -> DataFrame:
    """(by, i, at, density): the Gaussian density of each group's values inside ``view`` at the centres of its cells, by Scott's
    rule; each group's curve is its own distribution.  Groups of one value, or of equal values, have no rows."""
    size = (view[1] - view[0]) / cells
    known = _known(df, [value], by).filter(F.col(value).between(*view))
    counts = known.groupBy(*by, F.least(_cell(F.col(value), view, cells), F.lit(cells - 1)).alias("i")).agg(F.count(F.lit(1)).alias("n"))
    moments = known.groupBy(*by).agg(F.count(F.lit(1)).alias("__all"), F.var_samp(value).alias("__v")).filter("__v > 0").withColumn("__s", F.sqrt("__v") * F.pow("__all", F.lit(-1 / 5)))
    reach = F.least(F.ceil(REACH * F.col("__s") / size), F.lit(cells)).cast("int")
    met = scan._joined_on(counts, moments, by).withColumn("__a", F.explode(F.sequence(-reach, reach)))  # one row a group
    weight = F.exp(-F.pow(F.col("__a") * size / F.col("__s"), F.lit(2)) / 2) / (math.sqrt(2 * math.pi) * F.col("__s") * F.col("__all"))
    out = met.groupBy(*by, (F.col("i") + F.col("__a")).alias("i")).agg(F.sum(F.col("n") * weight).alias("density")).filter(F.col("i").between(0, cells - 1))
    return out.select(*by, "i", (view[0] + (F.col("i") + 0.5) * size).alias("at"), "density")
