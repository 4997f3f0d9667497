"""A mix of sources by target weights, by thresholds on hashes that nested histograms find.

A document's size is its number of ``[^\\x20\\x09-\\x0D]+`` words.  Sources in code-point order, null last, weigh ``weights``
over and over; they share 100 % of all sizes by weight, none above ``most`` times its own size, the excess shared again by
weight.  The shares are those of a water level: in order of ``most * size / weight``, sources below the level are full,
and the first that is not sets it.

A source takes each of its documents floor(target / size) times and, of its documents in order of a hash of
(seed, id, size), as many once more as come nearest to the rest.  No document is sorted for that: words are summed by source
and the hash's leading ``BITS`` bits, the rest of the target falls into one of these buckets, and only the documents of
that bucket are summed by the next bits, until the bucket holds one document; its hash is the threshold, below which
documents are taken by a filter.  A round leaves one bucket in 2^BITS, so the tables shrink by that factor.

Thresholds are nested: a document that is taken k times is taken k - 1 times under every smaller target of its source.

Defined results: a null or empty text has size 0 and is taken as 0 words; a null id reads as empty; rows with
equal id and size share a hash and are told apart by row numbers, which are written once; such rows look alike, so reruns
agree whatever the numbers; a source of size 0 has target 0; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._io import numbered, release, stored

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = 13
#: Bits of the hash that a histogram goes by, and bits of each of the two hashes.
BITS, HASH_BITS = 10, 60


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hash_of(seed: int, id: Column, size: Column) -> Column:
    """The leading 60 bits of MD5, which SQL can say too."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(id.cast("string"), F.lit("")), size.cast("string"))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) by the water level; the windows see one row a source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*(F.lit(int(w)) for w in weights)), (F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1) % len(weights) + 1)
    per = per.withColumn("w", weight.cast("long")).withColumn("full_at", most * F.col("source_size") / F.col("w"))
    before = Window.orderBy("full_at", "source").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({"full": F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0)), "full_w": F.coalesce(F.sum("w").over(before), F.lit(0)), "all": F.sum("source_size").over(everything), "all_w": F.sum("w").over(everything)})
    per = per.withColumns({"left": F.col("all") - F.col("full"), "left_w": F.col("all_w") - F.col("full_w")})
    # the level is set by the first source that it does not fill
    level = F.when(F.col("left") / F.col("left_w") <= F.col("full_at"), F.struct("full_at", "source", "left", "left_w"))
    per = per.withColumn("level", F.min(level).over(everything))
    return per.select("source", "source_size", F.least(F.col("w") * F.col("level.left") / F.col("level.left_w"), (most * F.col("source_size")).cast("double")).alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame, bits: int = BITS) -> DataFrame:
    """(source, cut, cut2, cut_in): of ``rows`` (source, h, h2, size > 0), those below (cut, cut2), and at it where
    ``cut_in``, sum up to the nearest of ``budgets`` (source, budget), which lie between 0 and the source's sum."""
    left = rows.join(budgets.select(F.col("source").alias("_s"), "budget", F.lit(0).cast("long").alias("below")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    done = []
    steps = [(c, max(at, 0)) for c in ("h", "h2") for at in range(HASH_BITS - bits, -bits, -bits)]
    for number, (column, at) in enumerate(steps):
        bucket = F.shiftright(F.col(column), at)
        held = left.withColumn("bucket", bucket).groupBy("source", "bucket").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("m"), F.max("h").alias("cut"), F.max("h2").alias("cut2"), F.max("budget").alias("budget"), F.max("below").alias("below"))
        upto = F.col("below") + F.sum("s").over(Window.partitionBy("source").orderBy("bucket"))
        crossing = held.withColumn("upto", upto).filter(F.col("upto") >= F.col("budget")).withColumn("first", F.row_number().over(Window.partitionBy("source").orderBy("bucket"))).filter("first = 1")
        crossing = stored(crossing.select("source", "bucket", "m", "cut", "cut2", "budget", "upto", (F.col("upto") - F.col("s")).alias("start")))
        last = number + 1 == len(steps)
        found = crossing if last else crossing.filter("m = 1")
        done.append(found.select("source", "cut", "cut2", (F.col("upto") - F.col("budget") <= F.col("budget") - F.col("start")).alias("cut_in")))
        if last or crossing.filter("m > 1").isEmpty():
            break
        on = crossing.filter("m > 1").select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), F.col("start"))
        inside = left.drop("below").withColumn("bucket", bucket).join(on, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
        inside = stored(inside.select("source", "h", "h2", "size", "budget", F.col("start").alias("below")))
        release(left)
        left = inside
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def mixed(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = SEED, bits: int = BITS) -> DataFrame:
    """id, size, source_size, target, taken of every document."""
    rows = numbered(docs, docs[id].alias("_id"), docs[source].alias("source"), size_of(docs[text].cast("string")).alias("size"))
    rows = rows.withColumns({"h": hash_of(seed, F.col("_id"), F.col("size")), "h2": F.shiftrightunsigned(F.xxhash64("rid"), 64 - HASH_BITS)})
    plan = targets(rows, weights, most).withColumn("times", F.floor(F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))))
    plan = stored(plan.withColumn("budget", F.col("target") - F.col("times") * F.col("source_size")))
    cuts = thresholds(rows.filter("size > 0").select("source", "h", "h2", "size"), plan.filter("budget > 0"), bits)
    plan = plan.join(cuts.withColumnRenamed("source", "_c"), F.col("source").eqNullSafe(F.col("_c")), "left").drop("_c").withColumnRenamed("source", "_s")
    below = (F.col("h") < F.col("cut")) | (F.col("h") == F.col("cut")) & ((F.col("h2") < F.col("cut2")) | (F.col("h2") == F.col("cut2")) & F.col("cut_in"))
    times = F.col("times") + F.coalesce(below, F.lit(False)).cast("long")
    out = rows.join(plan, F.col("source").eqNullSafe(F.col("_s")), "left")
    return out.select(F.col("_id").alias(id), "size", "source_size", "target", (F.col("size") * times).alias("taken"))
