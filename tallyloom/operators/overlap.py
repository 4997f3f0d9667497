"""Why a record that one data set holds is missing from another: twins by substance, equal rows, and a band join on numbers."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .match import within_slack

#: Below this a number counts as this large, so that zeros have a tolerance too.
SMALLEST = 1e-9
#: Reasons in the order in which they are tried; the second stands for two, by what equal rows of the group are.
REASONS = {
    "excluded": "an excluded name", "repeat": "a repeat of a run curated once", "twice": "the same run tabulated twice", "name": "a name not curated",
    "missed": "the same run, missed by the matcher", "condition": "a condition not curated",
}


def _shared(a: Sequence[Column], b: Sequence[Column], slack: float) -> Column:
    """All numbers that both sides hold agree, and they hold at least one together."""
    some = functools.reduce(lambda x, y: x | y, (x.isNotNull() & y.isNotNull() for x, y in zip(a, b)))
    return some & functools.reduce(lambda x, y: x & y, (F.coalesce(within_slack(x, y, slack), F.lit(True)) for x, y in zip(a, b)))


def band_pairs(left: DataFrame, right: DataFrame, on: Sequence[str], fields: Sequence[str], slack: float) -> DataFrame:
    """Pairs of ``left`` and ``right`` (columns l_ and r_, and those of ``on``) with equal keys, nulls equal, whose ``fields``
    agree within ``slack`` wherever both are known, at least one being known on both sides.

    Numbers within a share of the larger one are at most one bucket of their logarithms apart.  Each row is dealt once by
    every field that it holds; a pair meets by the first field that both hold, so blanks cost no cross product and a hot key
    is spread over its buckets.
    """
    width = -math.log1p(-slack) if slack else None
    size = lambda c: F.greatest(F.abs(c), F.lit(SMALLEST))
    bucket = (lambda c: F.floor(F.log(size(c)) / width)) if slack else (lambda c: F.xxhash64(c + 0.0))

    def dealt(df: DataFrame, side: str, wide: bool) -> DataFrame:
        df = df.select(*(F.col(c).alias(f"{side}_{c}") for c in df.columns))
        df = df.withColumns({f"{side}_{f}": F.nanvl(F.col(f"{side}_{f}").cast("double"), F.lit(None).cast("double")) for f in fields})
        near = lambda b: F.array(b - 1, b, b + 1) if wide and slack else F.array(b)
        none = F.array().cast("array<bigint>")
        buckets = lambda f: F.when(F.col(f"{side}_{f}").isNull(), none).otherwise(near(bucket(F.col(f"{side}_{f}"))))
        numbered = lambda f, i: F.transform(buckets(f), lambda b: F.struct(F.lit(i).alias("field"), b.alias("bucket")))
        cells = F.flatten(F.array(*(numbered(f, i) for i, f in enumerate(fields))))
        return df.withColumn(f"__{side}", F.explode(cells))

    a, b = dealt(left, "l", False), dealt(right, "r", True)
    known = lambda f: F.col(f"l_{f}").isNotNull() & F.col(f"r_{f}").isNotNull()
    first = F.lit(True)
    for i in range(1, len(fields)):  # met by field i: none of the earlier ones is known on both sides
        clash = functools.reduce(lambda x, y: x | y, (known(f) for f in fields[:i]))
        first = first & ~((F.col("__l.field") == i) & clash)
    keys = functools.reduce(lambda x, y: x & y, (F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")) for c in on))
    met = (F.col("__l.field") == F.col("__r.field")) & (F.col("__l.bucket") == F.col("__r.bucket"))
    return a.join(b, keys & met & first & _shared([F.col(f"l_{f}") for f in fields], [F.col(f"r_{f}") for f in fields], slack)).drop("__l", "__r")


def gap_reasons(
    records: DataFrame, key: str, group: str, category: str, names: tuple[Column, Column], conditions: Sequence[str], outcomes: Sequence[str], excluded: Column, repeated: Column,
    sides: tuple[str, str] = ("theirs_", "ours_"), slack: float = 0.02, both: str = "both", ours: str = "ours", reasons: dict[str, str] = REASONS,
) -> DataFrame:
    """(key, group, reason) of every row of category ``ours``: why the other data set does not have it.

    ``names``: the folded names of the other side and of ours, null read as empty.  In this order:

    * ``excluded`` holds: an excluded name;
    * another row of ours in the group has the same name, the same blanks and the same numbers: a repeat where ``repeated``
      holds for the group, else tabulated twice;
    * the other side has no row of that name in the group: a name not curated;
    * it has one under the same conditions and outcomes that is matched to none of ours: missed by the matcher;
    * it has one under the same conditions: a repeat; else a condition not curated.
    """
    theirs_, ours_ = sides
    every = [*conditions, *outcomes]
    name = lambda c: F.coalesce(c, F.lit(""))
    numbers = lambda side: [F.nanvl(F.col(side + f).cast("double"), F.lit(None).cast("double")).alias(f) for f in every]
    mine = records.filter(F.col(category).isin(both, ours)).select(F.col(key).alias("__key"), F.col(group).alias("__group"), F.col(category).alias("__category"), name(names[1]).alias("__name"), *numbers(ours_), F.coalesce(excluded, F.lit(False)).alias("__excluded"), F.coalesce(repeated, F.lit(False)).alias("__repeated"))
    others = records.filter((F.col(category) != ours) & F.col(category).isNotNull()).select(F.col(group).alias("__group"), name(names[0]).alias("__name"), *numbers(theirs_), (F.col(category) != both).alias("__alone"))

    same = ["__group", "__name", *every]
    twins = mine.groupBy(*same).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").filter(functools.reduce(lambda x, y: x | y, (F.col(f).isNotNull() for f in every)))
    twins = twins.select(*(F.col(c).alias(f"t_{c}") for c in same))
    asked = mine.filter(F.col("__category") == ours)
    out = asked.join(twins, functools.reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"t_{c}")) for c in same)), "left").withColumn("__identical", F.col("t___name").isNotNull()).drop(*twins.columns)

    there = others.select(F.col("__group").alias("o_group"), F.col("__name").alias("o_name")).distinct()
    out = out.join(there, F.col("__group").eqNullSafe(F.col("o_group")) & (F.col("__name") == F.col("o_name")), "left").withColumn("__named", F.col("o_name").isNotNull()).drop("o_group", "o_name")

    met = band_pairs(asked.select("__key", "__group", "__name", *every), others, ["__group", "__name"], conditions, slack)
    listed = F.col("r___alone") & _shared([F.col(f"r_{f}").cast("double") for f in outcomes], [F.col(f"l_{f}").cast("double") for f in outcomes], slack)
    met = met.groupBy(F.col("l___key").alias("m_key")).agg(F.max(F.coalesce(listed, F.lit(False))).alias("__listed"))
    out = out.join(met, F.col("__key").eqNullSafe(F.col("m_key")), "left")

    reason = (
        F.when(F.col("__excluded"), reasons["excluded"]).when(F.col("__identical"), F.when(F.col("__repeated"), reasons["repeat"]).otherwise(reasons["twice"]))
        .when(~F.col("__named"), reasons["name"]).when(F.col("__listed"), reasons["missed"]).when(F.col("m_key").isNotNull(), reasons["repeat"]).otherwise(reasons["condition"])
    )
    return out.select(F.col("__key").alias(key), F.col("__group").alias(group), reason.alias("reason"))
