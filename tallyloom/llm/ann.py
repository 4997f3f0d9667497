"""Approximate nearest neighbours: stable projections indexed by a kd-tree, with a chi-square stopping test.

Vectors are projected to ``M`` dimensions with Gaussian (2-stable) entries: the squared projected distance over
the squared distance is chi-square with M degrees of freedom.  The top levels of a kd-tree over the projected
space, fitted to a sample of at most ``SAMPLE`` vectors, deal *all* vectors into cells; inside a cell a kd-tree
of small leaves is built.  A query takes leaves by increasing projected distance and verifies their vectors by
exact distance, nearest in projection first, until the next one is so far, against the distance of the k-th vector
found, that a nearer vector has a projected distance this large with probability at most 1 - ``CONFIDENCE``.  So each
true neighbour is found with that probability.  A query searches its own cell first, and then only those cells which
the test does not rule out under the distance it has found.  ``n_verified`` and ``n_cells`` say what a query has cost:
little where vectors lie in clusters; where all distances are alike, as for directions drawn at random, no test on
projections can rule much out.

Equal vectors are one class with its k + 1 smallest ids, which is all that any answer can hold, so hot vectors
cost no more than others; the same holds for equal query vectors.

Defined results: vectors that are null, empty, all zero or hold null or non-finite components take no part, as
queries or as candidates; vectors of other lengths are compared among themselves; of vectors found at one distance those
with smaller ids come first; a query has fewer answers if there are fewer candidates; repeated rows with one id are one candidate; null ids take no part; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._io import release, stored

M = 8
CONFIDENCE = 0.95
SEED = 7
SAMPLE = 20_000
CELL = 8_192
LEAF = 32


def chi_square_quantile(p: float, m: int = M) -> float:
    """Where the chi-square distribution of an even ``m`` reaches ``p``."""
    cdf = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
    low, high = 0.0, 1000.0
    for _ in range(100):
        low, high = (low, (low + high) / 2) if cdf((low + high) / 2) >= p else ((low + high) / 2, high)
    return high


def projection(dim: int, m: int = M) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, m))


def _halves(points: np.ndarray, rows: np.ndarray) -> tuple[int, float]:
    """The widest dimension and its median."""
    axis = int(np.ptp(points[rows], axis=0).argmax())
    return axis, float(np.median(points[rows, axis]))


class Cells:
    """Top of the kd-tree: boxes of the projected space and how to find a point's own."""

    def __init__(self, sample: np.ndarray, n_cells: int):
        m = sample.shape[1] if len(sample) else M
        self.tree: list = []
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        everywhere = np.full(m, np.inf)
        self._split(sample, np.arange(len(sample)), n_cells, -everywhere, everywhere)
        self.low_at, self.high_at = np.array(self.low), np.array(self.high)

    def _split(self, points, rows, n, low, high) -> int:
        me = len(self.tree)
        self.tree.append(None)
        if n <= 1 or len(rows) < 2 or np.ptp(points[rows], axis=0).max() == 0:
            self.tree[me] = (-1, len(self.low), 0, 0)
            self.low.append(low)
            self.high.append(high)
            return me
        axis, middle = _halves(points, rows)
        left, right = rows[points[rows, axis] <= middle], rows[points[rows, axis] > middle]
        below, above = high.copy(), low.copy()
        below[axis] = above[axis] = middle
        self.tree[me] = (axis, middle, self._split(points, left, n // 2, low, below), self._split(points, right, n - n // 2, above, high))
        return me

    def of(self, points: np.ndarray) -> np.ndarray:
        out, todo = np.empty(len(points), np.int64), [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            axis, value, left, right = self.tree[node]
            if axis < 0:
                out[rows] = value
            else:
                low = points[rows, axis] <= value
                todo += [(left, rows[low]), (right, rows[~low])]
        return out

    def gaps(self, point: np.ndarray) -> np.ndarray:
        """Squared distance from a point to each box."""
        return (np.maximum(0, np.maximum(self.low_at - point, point - self.high_at)) ** 2).sum(1)


class Tree:
    """The kd-tree of one cell: leaves with their boxes."""

    def __init__(self, vectors: np.ndarray, matrix: np.ndarray):
        self.vectors, self.points = vectors, vectors @ matrix
        points = self.points
        self.leaves, todo = [], [np.arange(len(points))]
        while todo:
            rows = todo.pop()
            if len(rows) > LEAF and np.ptp(points[rows], axis=0).max() > 0:
                axis, _ = _halves(points, rows)
                order = rows[np.argpartition(points[rows, axis], len(rows) // 2)]
                todo += [order[: len(rows) // 2], order[len(rows) // 2 :]]
            elif len(rows):
                self.leaves.append(rows)
        self.low = np.array([points[r].min(0) for r in self.leaves])
        self.high = np.array([points[r].max(0) for r in self.leaves])

    def nearest(self, vector: np.ndarray, point: np.ndarray, k: int, bound: float, stop: float) -> tuple[np.ndarray, np.ndarray, int]:
        """(rows, squared distances, number verified) of the nearest ``k`` found; ``bound``: a squared distance known to hold k."""
        gaps = (np.maximum(0, np.maximum(self.low - point, point - self.high)) ** 2).sum(1)
        order = np.argsort(gaps)
        rows, far, at, step, seen = np.empty(0, np.int64), np.empty(0), 0, 2, 0
        while at < len(order) and gaps[order[at]] <= stop * bound:
            some = np.concatenate([self.leaves[i] for i in order[at : at + step]])
            projected = ((self.points[some] - point) ** 2).sum(1)
            some = some[np.argsort(projected)][: np.count_nonzero(projected <= stop * bound)]
            for low in range(0, len(some), 2 * LEAF):  # the bound falls while nearer ones are verified
                own = some[low : low + 2 * LEAF]
                own = own[((self.points[own] - point) ** 2).sum(1) <= stop * bound]
                if not len(own):
                    break
                seen += len(own)
                rows = np.concatenate([rows, own])
                far = np.concatenate([far, ((self.vectors[own] - vector) ** 2).sum(1)])
                if len(far) > k:
                    best = np.argpartition(far, k - 1)[:k]
                    rows, far = rows[best], far[best]
                if len(far) >= k:
                    bound = min(bound, float(far.max()))
            at, step = at + step, min(16, 2 * step)
        return rows, far, seen


def usable(vector: str | Column) -> Column:
    v = F.col(vector) if isinstance(vector, str) else vector
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(good, F.lit(False)) & F.exists(v, lambda x: x != 0)


def nearest(rows: DataFrame, asks: Column, k: int = 10, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, the id and the score (Euclidean distance) of the k nearest found of each row where ``asks`` holds, n_verified, n_cells."""
    spark = rows.sparkSession
    all_rows = rows.filter(usable(rows[vector]) & rows[id].isNotNull()).select(rows[id].cast("long").alias("id"), rows[vector].cast("array<double>").alias("v"), F.coalesce(asks, F.lit(False)).alias("asks")).dropDuplicates(["id", "v"])
    all_rows = stored(all_rows)
    place = Window.partitionBy("v").orderBy("id")
    classes = all_rows.withColumn("n", F.row_number().over(place)).filter(F.col("n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.min("id").alias("rep"))
    classes = stored(classes.withColumn("dim", F.size("v")))
    queries = stored(all_rows.filter("asks").groupBy("v").agg(F.min("id").alias("q")).withColumn("dim", F.size("v")))
    counts = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().collect()}  # one row a vector length
    cells = {}
    for dim, n in counts.items():
        of = classes.filter(F.col("dim") == dim)
        some = of.orderBy(F.xxhash64("rep")).select("v").limit(SAMPLE).toPandas()["v"]
        cells[dim] = Cells(np.stack(some.to_numpy()) @ projection(dim), -(-n // CELL))
    shared, stop = spark.sparkContext.broadcast(cells), chi_square_quantile(CONFIDENCE)

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, g in b.groupby("dim"):
                yield g.assign(cell=shared.value[dim].of(np.stack(g["v"].to_numpy()) @ projection(dim)))

    # a cell that the sample misjudged is split by hash, so a group stays near CELL vectors
    placed = classes.mapInPandas(dealt, "v array<double>, ids array<long>, rep long, dim int, cell long")
    placed = stored(placed)
    release(classes)
    parts = stored(placed.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(2 * CELL)).cast("long").alias("parts")))
    whole, placed = placed, stored(placed.join(parts, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts"))))
    release(whole)

    def search(keys, cell: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(cell) or not len(asked):
            return pd.DataFrame(columns=["q", "ids", "far", "seen"])
        vectors, matrix = np.stack(cell["v"].to_numpy()), projection(int(keys[0]))
        tree, ids, out = Tree(vectors, matrix), cell["ids"].to_numpy(), []
        for q, v, bound in zip(asked["q"], asked["v"], asked["bound"]):
            found, far, seen = tree.nearest(v, v @ matrix, k + 1, bound, stop)
            out += [(q, ids[r], d, 0) for r, d in zip(found, far)] + [(q, None, None, seen)]
        return pd.DataFrame(out, columns=["q", "ids", "far", "seen"])

    def searched(asked: DataFrame) -> DataFrame:
        groups = asked.join(parts, ["dim", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        on = ["dim", "cell", "part"]
        return placed.groupBy(*on).cogroup(groups.groupBy(*on)).applyInPandas(search, "q long, ids array<long>, far double, seen long")

    fields = "q long, v array<double>, dim int, cell long, bound double"
    home = queries.mapInPandas(lambda bs: (g[["q", "v", "dim", "cell"]].assign(bound=np.inf) for g in dealt(bs)), fields)
    top = Window.partitionBy("q").orderBy("far", F.col("ids")[0])
    best = lambda df: df.withColumn("n", F.row_number().over(top)).filter(F.col("n") <= k + 1).drop("n")
    own_cell = stored(searched(home))
    first = stored(best(own_cell.filter("ids is not null")))
    bounds = first.groupBy("q").agg(F.when(F.count(F.lit(1)) > k, F.max("far")).otherwise(F.lit(float("inf"))).alias("bound"))

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for q, v, dim, bound in zip(b["q"], b["v"], b["dim"], b["bound"]):
                point = v @ projection(dim)
                gaps = shared.value[dim].gaps(point)
                own = shared.value[dim].of(point[None])[0]
                near = gaps <= stop * bound if np.isfinite(bound) else np.ones(len(gaps), bool)
                out += [(q, v, dim, c, bound) for c in np.flatnonzero(near) if c != own]
            yield pd.DataFrame(out, columns=["q", "v", "dim", "cell", "bound"])

    other_cells = stored(searched(queries.join(bounds, "q", "left").fillna(float("inf"), ["bound"]).mapInPandas(others, fields)))
    cost = own_cell.unionByName(other_cells).filter("ids is null").groupBy("q").agg(F.sum("seen").alias("n_verified"), F.count(F.lit(1)).alias("n_cells"))
    found = best(first.unionByName(other_cells.filter("ids is not null"))).select("q", "far", F.explode("ids").alias("id"))
    found = found.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("far", "id"))).filter(F.col("n") <= k + 1)
    lists = found.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("far", "id"))).alias("all")).join(cost, "q")
    asked = all_rows.filter("asks").join(queries.select("v", "q"), "v").select(F.col("id").alias("query_id"), "q")
    release(placed, parts)
    near = asked.join(lists, "q").select("query_id", "n_verified", "n_cells", F.posexplode(F.slice(F.filter("all", lambda x: x["id"] != F.col("query_id")), 1, k)).alias("place", "one"))
    return near.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("one.id").alias(id), F.sqrt("one.far").alias("score"), "n_verified", "n_cells")
