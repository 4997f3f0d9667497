"""How far each source of a language is from the others, by two-dimensional tiles of groups.

Terms are matches of ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased; a language keeps the V terms that at least
``LEAST_DOCS`` of its documents hold.  A group is a (language, source) that occurs.  The share of a term in a group (or the
whole language) is p = 1 + floor(10^9 (count + 2) / (N + 2 V)), N being the count's sum over kept terms, and two shares
differ by f = floor((p - q)^2 / (p + q)).  Everything is whole numbers: shares by decimals of 38 digits, the rest in 64 bits.

Tasks count terms by group and documents by term; two shuffles combine them and drop terms that are too rare.  Terms are
dealt to chunks of about ``CHUNK`` by hash, and a group's counts in a chunk are packed into two arrays (place, share).  The
packed vectors of a block of ``BLOCK`` groups are sent once to each tile that the block takes part in, i.e. G / BLOCK times;
a task walks the chunks of a tile one after the other and adds up the tile's submatrix, holding one chunk of two blocks.
Within a chunk only places that one of the groups holds are computed; all others give one constant for a pair, which is
added once, times V.  A tile's chunks are split into spans of ``SPAN`` chunks, whose submatrices Spark adds, so the work of a
language with few groups and many terms still spreads.

Part ``pair`` has every other source of the language by sum over all kept terms, part ``term`` the terms that set the group
apart from its language (p > q), first ten.  Ranks go by value from the largest, ties by item in UTF-8 order.

Defined results: null text, language and source read as empty; a group without terms still has pairs; a language
without kept terms has pairs of value 0; repeated rows count again; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._io import release, stored

LEAST_DOCS = 10
TOP = 10
#: Terms of a chunk, groups of a block and chunks of a span.
CHUNK, BLOCK, SPAN = 4096, 32, 16
#: (group, term) counts that a task holds before it passes them on.
HELD_TERMS = 400_000
_TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_LOOK = 64


def term_counts(docs: DataFrame, text: str = "_text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group."""
    names = ["lang", "source", "term", "n", "docs"]

    def rows(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, in_docs) in held.items():
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array([source] * len(n)), pa.array(list(n)), pa.array(list(n.values()), pa.int64()), pa.array([in_docs[t] for t in n], pa.int64())], names)
        held.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        seen = 0
        for b in batches:
            for lang, source, t in zip(b["_lang"].to_pylist(), b["_source"].to_pylist(), b[text].to_pylist()):
                terms = _TERM.findall(t.encode().lower().decode())  # bytes lower A-Z alone
                n, in_docs = held.setdefault((lang, source), (Counter(), Counter()))
                n.update(terms)
                in_docs.update(set(terms))
                seen += 1
                if seen % _LOOK == 0 and sum(len(x) for x, _ in held.values()) + len(held) > HELD_TERMS:
                    yield from rows(held)
        yield from rows(held)

    made = docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 kept)), exact; 1 where nothing is kept."""
    by = (total + 2 * kept).cast("decimal(20,0)")
    whole = F.call_function("div", (count + 2).cast("decimal(20,0)") * F.lit(1_000_000_000).cast("decimal(10,0)"), F.nullif(by, F.lit(0).cast("decimal(20,0)")))
    return 1 + F.coalesce(whole, F.lit(0)).cast("long")


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _submatrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each tile and span over rows sorted by (lang, bi, bj, span, chunk); chunk -1 names the tile's groups."""
    at, groups, chunk, sums = None, {}, None, None

    def put(key: tuple, rows: list[tuple]) -> None:
        nonlocal groups, sums
        if key[-1] < 0:
            groups = {}
            for block in set(key[1:3]):
                own = sorted((r[1], r[2], r[3]) for r in rows if r[0] == block)
                groups[block] = ({g: i for i, (g, _, _) in enumerate(own)}, np.array([p for _, p, _ in own], np.int64), own[0][2])
            (_, p, kept), (_, q, _) = groups[key[1]], groups[key[2]]
            still = (p[:, None] - q) ** 2 // (p[:, None] + q)
            sums = [still, still * (kept if key[3] == 0 else 0)]
            return
        places = np.unique(np.concatenate([r[4] for r in rows]))
        dense = {block: np.repeat(p[:, None], len(places), 1) for block, (_, p, _) in groups.items()}
        for r in rows:
            dense[r[0]][groups[r[0]][0][r[1]], np.searchsorted(places, r[4])] = r[5]
        a, b = dense[key[1]], dense[key[2]]
        for i in range(len(a)):
            first = i + 1 if key[1] == key[2] else 0
            other = b[first:]
            sums[1][i, first:] += ((a[i] - other) ** 2 // (a[i] + other)).sum(1) - len(places) * sums[0][i, first:]

    def tile(key: tuple) -> pa.RecordBatch:
        names = [{i: g for g, i in groups[block][0].items()} for block in key[1:3]]
        pairs = [(names[0][i], names[1][j], int(sums[1][i, j])) for i in range(len(names[0])) for j in range(i + 1 if key[1] == key[2] else 0, len(names[1]))]
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(pairs), pa.string()), *(pa.array([x[k] for x in pairs], pa.int64()) for k in range(3))], ["lang", "g", "h", "value"])

    rows: list[tuple] = []
    for batch in batches:
        columns = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
        keys = list(zip(*(columns[c].to_pylist() for c in ("lang", "bi", "bj", "span", "chunk"))))
        plain = list(zip(*(columns[c].to_pylist() for c in ("block", "g", "p0", "kept"))))
        idx, p = columns["places"], columns["shares"]
        for k, key in enumerate(keys):
            if key != chunk and chunk is not None:
                put(chunk, rows)
                rows = []
                if key[:4] != chunk[:4]:
                    yield tile(chunk)
            chunk = key
            rows.append((*plain[k], idx[k].values.to_numpy() if key[-1] >= 0 else None, p[k].values.to_numpy() if key[-1] >= 0 else None))
    if chunk is not None:
        put(chunk, rows)
        yield tile(chunk)


def pair_sums(packed: DataFrame, groups: DataFrame, block: int = BLOCK, span: int = SPAN) -> DataFrame:
    """(lang, g, h, value) of all pairs of groups g < h of a language.

    ``packed``: (lang, g, chunk, places, shares); ``groups``: (lang, g, p0, kept, chunks, n_groups) of all groups.
    """
    named = groups.withColumns({"block": F.floor(F.col("g") / block), "blocks": F.ceil(F.col("n_groups") / block)})
    tiles = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    place = (F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))
    spans = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("chunks") / span), F.lit(1)) - 1)).alias("span")
    heads = named.select("lang", "g", "p0", "kept", "block", tiles, "chunks").select("lang", "g", "p0", "kept", "block", *place, spans)
    none = F.array().cast("array<bigint>")
    rows = packed.join(named.select("lang", "g", "block", "blocks"), ["lang", "g"]).select("lang", "g", "chunk", "places", "shares", "block", tiles)
    rows = rows.select("lang", "g", F.lit(0).cast("long").alias("p0"), F.lit(0).cast("long").alias("kept"), "block", *place, F.floor(F.col("chunk") / span).alias("span"), "chunk", "places", "shares")
    rows = rows.unionByName(heads.select("*", F.lit(-1).cast("long").alias("chunk"), none.alias("places"), none.alias("shares")))
    key = ["lang", "bi", "bj", "span"]
    dealt = rows.repartition(*key).sortWithinPartitions(*key, "chunk")
    return dealt.mapInArrow(_submatrices, "lang string, g long, h long, value long").groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP, chunk: int = CHUNK, block: int = BLOCK, span: int = SPAN) -> DataFrame:
    """lang, source, part, item, value, rank: pairs of sources by divergence, and terms that set a source apart."""
    blank = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    rows = docs.select(blank(lang).alias("_lang"), blank(source).alias("_source"), blank(text).alias("_text"))
    of_term = Window.partitionBy("lang", "term")
    counts = term_counts(rows).withColumns({"in_docs": F.sum("docs").over(of_term), "of_lang": F.sum("n").over(of_term)})
    cells = stored(counts.filter(F.col("in_docs") >= least_docs).select("lang", "source", "term", "n", "of_lang"))
    langs = cells.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n").alias("lang_total"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select(F.col("_lang").alias("lang"), F.col("_source").alias("source")).distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "kept", "lang_total"])
    of_lang = Window.partitionBy("lang")
    groups = stored(groups.withColumns({"g": (F.row_number().over(of_lang.orderBy("source")) - 1).cast("long"), "n_groups": F.count(F.lit(1)).over(of_lang), "p0": _share(F.lit(0), F.col("total"), F.col("kept")), "chunks": F.ceil(F.col("kept") / chunk)}))
    shared = cells.join(groups.select("lang", "source", "g", "total", "kept", "lang_total", "chunks"), ["lang", "source"])
    shared = shared.select("lang", "source", "g", "term", "of_lang", "kept", "lang_total", _share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), F.pmod(F.xxhash64("term"), F.col("chunks")).alias("chunk"))

    q = _share(F.col("of_lang"), F.col("lang_total"), F.col("kept"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = shared.withColumn("q", q).filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top)

    place = (F.dense_rank().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1).cast("long")
    placed = shared.select("lang", "g", "chunk", place.alias("place"), "p")
    packed = placed.groupBy("lang", "g", "chunk").agg(F.collect_list(F.struct("place", "p")).alias("v")).select("lang", "g", "chunk", F.col("v.place").alias("places"), F.col("v.p").alias("shares"))
    sums = stored(pair_sums(packed, groups.select("lang", "g", "p0", "kept", "chunks", "n_groups"), block, span))
    names = groups.select("lang", "g", "source")
    ends = sums.join(names, ["lang", "g"]).withColumnRenamed("source", "a").join(names.select("lang", F.col("g").alias("h"), F.col("source").alias("b")), ["lang", "h"])
    both = ends.select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("e"))
    pairs = both.select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value").withColumn("rank", F.row_number().over(by_value))
    return pairs.unionByName(terms)
