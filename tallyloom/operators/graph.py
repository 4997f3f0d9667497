"""Connected parts of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import release, stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, part): the smallest node of each connected part, by rounds of least neighbours and pointer jumps, each stored.

    The number of rounds grows with the logarithm of the longest path.
    """
    both = stored(edges.select(F.col(a).alias("node"), F.col(b).alias("near")).union(edges.select(b, a)).distinct())
    labels = stored(both.groupBy("node").agg(F.least(F.first("node"), F.min("near")).alias("part")))
    while True:
        least = both.join(labels.select(F.col("node").alias("near"), "part"), "near").groupBy("node").agg(F.min("part").alias("least"))
        lower = labels.join(least, "node").select("node", F.col("part").alias("old"), F.least("part", "least").alias("part"))
        up = labels.select(F.col("node").alias("part"), F.col("part").alias("above"))
        new = stored(lower.join(up, "part", "left").select("node", F.least("part", F.coalesce("above", "part")).alias("part"), "old"))
        release(labels)
        labels = new
        if new.filter("part <> old").isEmpty():
            release(both)
            return labels.select("node", "part")
