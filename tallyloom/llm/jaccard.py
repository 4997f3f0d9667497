"""Near-duplicate join: five-word shingles, Jaccard similarity of at least 0.8, by a MinHash LSH forest.

1. Each text becomes its set of hashed shingles (fewer than five words: all of them are one shingle).  Texts of
   equal sets are one class, represented once.
2. A class has one signature of ``TREES * DEPTH`` minima.  Tree t orders the minima by rotation, from its own
   ``DEPTH`` on, so the sorted signatures of a tree form a prefix trie.  The matched prefix starts long and is shortened
   until the chance that a pair at the threshold shares it in some tree reaches ``RECALL``: that is the prefix
   which is used.  A node of more than ``NODE`` classes is cut into blocks of ``NODES * NODE``, and every pair of blocks is
   a task, so crowded parts of the trie lose no pair.
3. Inside a node the similarities are estimated from the whole signature.  Pairs that could reach the threshold are
   candidates; where they are dense (over ``DENSE`` a class) a star of them stands for the cluster.
4. Candidates are verified exactly: all pairs of a component of at most ``BLOCK`` classes at once; of a larger
   component, all pairs of each dense cluster, a pair of blocks a task, and every other candidate pair by itself.

Links and groups are exact up to the candidates' recall: 0.999 for a pair at the threshold, whatever the
size of its node.  A crowded node costs all pairs of its classes, in bounded memory.  ``n_links`` counts all links in components of at
most ``BLOCK`` classes and in dense clusters, and the links among candidates elsewhere in larger components.  A template
whose copies are about as similar as the threshold makes dense clusters, whose pairs are all compared, block by block.

Defined results: texts without words (null, empty, white space) are alone in their class and have no links;
ties go to the smallest id, then the first row; repeated rows are copies; null ids are allowed (a group's id is
the smallest id in it, null if none has one); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from . import _text as T
from ._arrow import trimmed
from ._io import numbered, release, stored, text_column

SHINGLE = 5
THRESHOLD = 0.8
TREES, DEPTH = 20, 12
RECALL = 0.999
#: Estimated similarity from which a pair may reach the threshold: four standard deviations below it.
LIKELY = THRESHOLD - 4 * (THRESHOLD * (1 - THRESHOLD) / (TREES * DEPTH)) ** 0.5
#: A node of more than ``NODE`` classes is compared by itself, in blocks of ``NODES`` times as many.
NODES = 8
NODE, DENSE, BLOCK = 512, 8, 1024
_SEEDS = np.random.default_rng(11).integers(0, 2**63, (2, TREES * DEPTH), dtype=np.uint64)


def matched_depth(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix whose matches reach the recall at the threshold."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def shingle_sets(texts: list[str], n: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a slice."""
    at, hashes, owner = _shingles(texts, n)
    return np.split(hashes, np.searchsorted(owner, np.arange(1, len(texts)))) if len(texts) else []


def _shingles(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w = T.words_of(texts)
    at, hashes = T.windows_of(w, n)
    owner = w.text[at]
    first = np.cumsum(w.counts) - w.counts
    short = [(i, T.window_hashes(w.hashes[first[i] : first[i] + w.counts[i]], int(w.counts[i]))[0]) for i in np.flatnonzero((w.counts > 0) & (w.counts < n))]
    if short:
        owner, hashes = np.append(owner, [i for i, _ in short]), np.append(hashes, np.array([h for _, h in short], np.uint64))
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.append(True, (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])) if len(owner) else np.empty(0, bool)
    return at, hashes[new], owner[new]


def _signed(texts: list[str], depth: int) -> dict[str, np.ndarray]:
    """Set hashes, set sizes, prefix keys of each tree, and signatures of a slice of texts."""
    _, hashes, owner = _shingles(texts, SHINGLE)
    n = np.bincount(owner, minlength=len(texts))
    full = np.flatnonzero(n)
    begin = np.cumsum(n[full]) - n[full]
    minima = np.zeros((len(texts), TREES * DEPTH), np.uint32)
    sets = np.zeros((2, len(texts)), np.uint64)
    if len(full):
        for j, (a, b) in enumerate(_SEEDS.T):
            minima[full, j] = np.minimum.reduceat((hashes * (a | np.uint64(1)) + b) >> np.uint64(32), begin)
        sets[0, full] = np.add.reduceat(T.mix(hashes), begin)
        sets[1, full] = np.bitwise_xor.reduceat(T.mix(hashes ^ np.uint64(0x5DEECE66D)), begin)
    keys = np.zeros((TREES, len(texts)), np.uint64)
    for t in range(TREES):
        keys[t] = np.uint64(t + 1)
        for j in range(depth):
            keys[t] = T.mix(keys[t] * np.uint64(0x9E3779B97F4A7C15) + minima[:, t * DEPTH + j])
    return {"n": n, "sets": sets, "keys": keys.T, "signatures": minima.astype(np.uint8)}


def signatures(rows: DataFrame, depth: int) -> DataFrame:
    """rid, h1, h2, n, keys, signature of ``rows`` (rid, _text)."""
    schema = S.StructType([S.StructField("rid", S.LongType()), S.StructField("h1", S.LongType()), S.StructField("h2", S.LongType()), S.StructField("n", S.IntegerType()), S.StructField("keys", S.ArrayType(S.LongType())), S.StructField("signature", S.BinaryType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b["_text"].to_pylist()
            for s in T.slices(texts):
                found = _signed(texts[s], depth)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(0, (s.stop - s.start + 1) * TREES, TREES), pa.int32()), pa.array(found["keys"].reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [b["rid"][s.start : s.stop], pa.array(found["sets"][0].view(np.int64)), pa.array(found["sets"][1].view(np.int64)), pa.array(found["n"].astype(np.int32)), keys, pa.array([x.tobytes() for x in found["signatures"]], pa.binary())], names
                )

    return rows.mapInArrow(trimmed(run), schema)


def _roots(n: int, edges: Iterator[tuple[int, int]]) -> list[int]:
    """The smallest member of each member's group."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def _agreeing(table: np.ndarray, row: np.ndarray) -> np.ndarray:
    """How many bytes of each row of ``table`` equal those of ``row``; at most 255 times eight of them."""
    return (table == row).view(np.uint64).sum(1).view(np.uint8).reshape(-1, 8).sum(1)


def candidates(part: pd.DataFrame, dense_at: int = DENSE) -> pd.DataFrame:
    """(a, b, star) among the classes of each trie node in ``part`` (key, rid, signature) that may reach the threshold.

    With columns ``block``, ``i`` and ``j`` the part is a pair of blocks of one node: only pairs across them, if they differ.
    """
    out: list[tuple[int, int, bool]] = []
    paired = "block" in part and len(part) > 0
    part = part.sort_values(["key", *(["block"] if paired else []), "signature", "rid"], kind="stable")
    rids, keys = part["rid"].to_numpy(np.int64), part["key"].to_numpy(np.int64)
    across = int((part["block"] == part["i"]).sum()) if paired and part["i"].iloc[0] != part["j"].iloc[0] else None
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    table = np.frombuffer(b"".join(part["signature"]), np.uint8).reshape(len(part), -1)
    least = LIKELY * table.shape[1]
    for a, z in zip(np.append(0, cuts), np.append(cuts, len(part))):
        own, found = table[a:z], []
        for i in range(z - a - 1 if across is None else across):
            begin = i + 1 if across is None else across
            found += [(i, begin + int(j)) for j in np.flatnonzero(_agreeing(own[begin:], own[i]) >= least)]
        roots = np.array(_roots(z - a, iter(found)), np.int64)
        pairs = np.bincount(np.array([roots[i] for i, _ in found], np.int64), minlength=z - a)
        dense = pairs > dense_at * np.bincount(roots, minlength=z - a)
        out += [(rids[a + i], rids[a + j], False) for i, j in found if not dense[roots[i]]]
        hubs = np.full(z - a, np.iinfo(np.int64).max)
        np.minimum.at(hubs, roots, rids[a:z])  # the smallest number, so that other trees give the same edges
        out += [(hubs[r], rids[a + i], True) for i, r in enumerate(roots) if dense[r] and hubs[r] != rids[a + i]]
    made = pd.DataFrame(out, columns=["a", "b", "star"]).astype({"a": np.int64, "b": np.int64, "star": bool})
    low = made[["a", "b"]].min(axis=1)
    return made.assign(b=made[["a", "b"]].max(axis=1), a=low)


def forest_edges(classes: DataFrame) -> DataFrame:
    """Candidate edges (a, b, star) of ``classes`` (rep, keys, signature), stored; each pair once."""
    nodes = classes.select(F.col("rep").alias("rid"), F.posexplode("keys").alias("tree", "key"))
    signs = classes.select(F.col("rep").alias("rid"), "signature")
    live = stored(_crowded(nodes).join(signs, "rid"))
    dense_at, edge = DENSE, "a long, b long, star boolean"
    small, large = live.filter(F.col("size") <= NODE), live.filter(F.col("size") > NODE)
    slots = max(1, -(-small.count() // 8_192))
    found = [stored(small.withColumn("slot", F.pmod(F.xxhash64("key"), F.lit(slots))).groupBy("slot").applyInPandas(lambda part: candidates(part, dense_at), edge))]
    if not large.isEmpty():
        blocks = F.ceil(F.col("size") / (NODES * NODE)).cast("long")
        pair = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("block")).alias("i"), F.greatest(x, F.col("block")).alias("j"))))
        dealt = large.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rid"), "blocks")).withColumn("p", pair).select("key", "rid", "signature", "block", "p.i", "p.j")
        found.append(stored(dealt.groupBy("key", "i", "j").applyInPandas(lambda part: candidates(part, dense_at), edge)))
    edges = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    edges = stored(edges.groupBy("a", "b").agg(F.max("star").alias("star")))
    release(live, *found)
    return edges


def _crowded(nodes: DataFrame) -> DataFrame:
    """``nodes`` whose key others share, with the number of its classes."""
    sizes = nodes.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    return nodes.join(sizes, "key")


def components(edges: DataFrame) -> DataFrame:
    """(rid, root): the smallest member of each connected component, by rounds of minima and pointer jumps."""
    both = stored(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).filter("a <> b").distinct())
    labels = stored(both.groupBy(F.col("a").alias("rid")).agg(F.least(F.first("a"), F.min("b")).alias("root")))
    while True:
        near = both.join(labels.select(F.col("rid").alias("b"), "root"), "b").groupBy(F.col("a").alias("rid")).agg(F.min("root").alias("near"))
        lower = labels.select("rid", "root").join(near, "rid").select("rid", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        up = labels.select(F.col("rid").alias("root"), F.col("root").alias("above"))
        new = stored(lower.join(up, "root", "left").select("rid", F.least("root", F.coalesce("above", "root")).alias("root"), "old"))
        release(labels)
        labels = new
        if new.filter("root <> old").isEmpty():
            release(both)
            return labels


def _counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of ``a`` with every set of ``b``, by products of 0/1 blocks."""
    every = np.concatenate([*a, *b])
    values, seen = np.unique(every, return_counts=True)
    values = values[seen > 1]
    out = np.zeros((len(a), len(b)), np.float32)
    places = [[np.searchsorted(values, x[np.isin(x, values, assume_unique=True)]) for x in side] for side in (a, b)]
    for low in range(0, len(values), 2048):
        dense = []
        for side in places:
            m = np.zeros((len(side), min(2048, len(values) - low)), np.float32)
            for i, p in enumerate(side):
                m[i, p[np.searchsorted(p, low) : np.searchsorted(p, low + 2048)] - low] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out


def verified(part: pd.DataFrame, threshold: float = THRESHOLD) -> pd.DataFrame:
    """Links of each class with the others of its block pair, and a star edge to the first it is linked with."""
    out: list[tuple[int, int, int]] = []
    for (_, i, j), g in part.groupby(["comp", "i", "j"], sort=False):
        g = g.sort_values("rid", kind="stable")
        sets = [np.frombuffer(x, np.uint64) for x in g["shingles"]]
        rids, side = g["rid"].to_numpy(np.int64), g["block"].to_numpy(np.int64)
        left = np.flatnonzero(side == i)
        right = left if i == j else np.flatnonzero(side == j)
        if not len(left) or not len(right):
            continue
        sizes = np.array([len(s) for s in sets], np.float64)
        both = _counts([sets[x] for x in left], [sets[x] for x in right]).astype(np.float64)
        linked = both >= threshold * (sizes[left][:, None] + sizes[right][None, :] - both) - 1e-9
        if i == j:
            np.fill_diagonal(linked, False)
        roots = _roots(len(g), ((int(left[x]), int(right[y])) for x, y in zip(*np.nonzero(linked))))
        links = np.zeros(len(g), np.int64)
        links[left] += linked.sum(1)
        if i != j:
            links[right] += linked.sum(0)
        out += [(r, n, rids[k]) for r, n, k in zip(rids, links, roots)]
    return pd.DataFrame(out, columns=["rid", "links", "root"], dtype=np.int64)


def linked_pairs(pairs: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The ``pairs`` (a, b) whose ``sets`` (rid, shingles) reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b["x"].to_pylist(), b["y"].to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= threshold * (len(x) + len(y) - both) - 1e-9)
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda key, name: sets.select(F.col("rid").alias(key), F.col("shingles").alias(name))
    return pairs.select("a", "b").join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(trimmed(run), "a long, b long")


def verified_links(edges: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((rid, links) with a row a task, edges (a, b) of linked classes): candidates ``edges`` held to the texts of ``rows``."""
    roots = components(edges)
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    labels = stored(roots.join(sizes, "root").select("rid", "root", "size"))
    large = labels.filter(F.col("size") > BLOCK).select("rid", "root")
    members, apart = labels.filter(F.col("size") <= BLOCK).select("rid", F.col("root").alias("comp"), "size"), None
    if not large.isEmpty():
        inside = edges.join(large.select(F.col("rid").alias("a")), "a", "left_semi")
        clusters = components(inside.filter("star"))
        counts = clusters.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
        dense = stored(clusters.join(counts, "root").select("rid", F.col("root").alias("comp"), "size"))
        of = lambda key, name: dense.select(F.col("rid").alias(key), F.col("comp").alias(name))
        apart = inside.filter("not star").join(of("a", "ca"), "a", "left").join(of("b", "cb"), "b", "left").filter("ca is null or cb is null or ca <> cb").select("a", "b")
        rest = large.join(dense, "rid", "left_anti").select("rid", F.lit(None).cast("long").alias("comp"), F.lit(0).cast("long").alias("size"))
        members = members.unionByName(dense).unionByName(rest)
    blocks = F.ceil(F.col("size") / BLOCK).cast("long")
    members = members.select("rid", "comp", F.pmod(F.xxhash64("rid"), F.greatest(blocks, F.lit(1))).alias("block"), blocks.alias("blocks"))
    sets = stored(_sets(rows.select("rid", "_text").join(members.hint("merge"), "rid").select("rid", "comp", "block", "blocks", "_text")))
    found = stored(_dealt(sets.filter("blocks > 0")).groupBy("slot").applyInPandas(lambda part: verified(part), "rid long, links long, root long"))
    links, ties = found.select("rid", "links"), found.filter("rid <> root").select(F.col("rid").alias("a"), F.col("root").alias("b"))
    if apart is not None:
        more = stored(linked_pairs(apart, sets))
        links = links.unionByName(more.select(F.explode(F.array("a", "b")).alias("rid"), F.lit(1).cast("long").alias("links")))
        ties = ties.unionByName(more)
    release(sets, labels)
    return links, ties


def near_duplicates(rows: DataFrame) -> DataFrame:
    """One row for each of ``rows`` (rid, _id, _text; a stored table): rid, id, copy_of, n_copies, n_links, class_id, kept.

    ``copy_of`` and ``n_copies``: the smallest id and the number of documents with the same shingles; ``n_links``:
    other such classes at the threshold; ``class_id``: smallest id of the group that links tie together; ``kept``:
    true for one document of each group.
    """
    signed = stored(signatures(rows.select("rid", "_text"), matched_depth()))
    wordy = signed.filter("n > 0")
    classes = stored(wordy.groupBy("h1", "h2", "n").agg(F.min("rid").alias("rep"), F.first("keys").alias("keys"), F.first("signature").alias("signature")))
    edges = forest_edges(classes)
    links, ties = verified_links(edges, rows)
    links = links.groupBy("rid").agg(F.sum("links").alias("links"))
    final = components(ties).select("rid", "root")
    owners = wordy.select("rid", "h1", "h2", "n").join(classes.select("h1", "h2", "n", "rep"), ["h1", "h2", "n"]).select("rid", "rep")
    grouped = rows.select("rid", "_id").join(owners, "rid", "left").select("rid", "_id", F.coalesce("rep", "rid").alias("rep"))
    grouped = grouped.join(links.withColumnRenamed("rid", "rep"), "rep", "left").join(final.withColumnRenamed("rid", "rep"), "rep", "left")
    grouped = stored(grouped.select("rid", "_id", "rep", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "rep").alias("root")))
    release(signed, classes, edges)
    order = F.struct(F.col("_id").isNull(), F.col("_id"), F.col("rid"))
    # tables of their own: Spark then splits the joins of large groups
    heads = stored(grouped.groupBy("root").agg(F.min("_id").alias("class_id"), F.min(order).getField("rid").alias("head")))
    copies = stored(grouped.groupBy("rep").agg(F.min("_id").alias("copy_of"), F.count(F.lit(1)).alias("n_copies")))
    out = grouped.join(heads, "root").join(copies, "rep")
    return out.select("rid", "_id", "copy_of", "n_copies", "n_links", "class_id", (F.col("rid") == F.col("head")).alias("kept"))


def _dealt(sets: DataFrame) -> DataFrame:
    """``sets`` (comp, rid, block, blocks, shingles) once for each pair of blocks (i, j) of their component, by slot.

    A slot is one pair of blocks, or the components of one block, of about ``2 * BLOCK`` sets either way.
    """
    pair = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("block")).alias("i"), F.greatest(x, F.col("block")).alias("j")))).alias("p")
    small = max(1, -(-sets.filter("blocks = 1").count() // (2 * BLOCK)))
    slot = F.when(F.col("blocks") > 1, F.xxhash64("comp", "p.i", "p.j")).otherwise(F.pmod(F.xxhash64("comp"), F.lit(small)))
    return sets.select("comp", "rid", "block", "blocks", "shingles", pair).select("comp", "rid", "block", "shingles", "p.i", "p.j", slot.alias("slot"))


def _sets(rows: DataFrame) -> DataFrame:
    """``rows`` with the shingle hashes of _text instead of it."""
    schema = S.StructType([*(f for f in rows.schema if f.name != "_text"), S.StructField("shingles", S.BinaryType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b["_text"].to_pylist()
            found = [x.tobytes() for s in T.slices(texts) for x in shingle_sets(texts[s])]
            yield pa.RecordBatch.from_arrays([*(b[n] for n in names[:-1]), pa.array(found, pa.binary())], names)

    return rows.mapInArrow(trimmed(run), schema)


def join(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``near_duplicates`` of ``docs``: id, copy_of, n_copies, n_links, class_id, kept."""
    rows = numbered(docs, F.col(id).alias("_id"), text_column(docs, text).alias("_text"))
    return near_duplicates(rows).drop("rid").withColumnRenamed("_id", id)


def first_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` of which one a group is kept, with their own columns."""
    rows = numbered(docs, *(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)))
    own = {c: F.col(f"_c{i}") for i, c in enumerate(docs.columns)}
    keep = near_duplicates(rows.select("rid", own[id].alias("_id"), F.coalesce(own[text].cast("string"), F.lit("")).alias("_text"))).filter("kept").select("rid")
    return rows.join(keep, "rid", "left_semi").select(*(x.alias(c) for c, x in own.items()))
