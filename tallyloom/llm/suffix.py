"""Repeated passages by sparse suffix arrays: suffixes at minimisers, sorted, compared with neighbours, extended both ways.

A passage is repeated if it has ``LEAST`` or more words (runs of ``[^\\x20\\x09-\\x0D]+``) and occurs before, in
another document or in the same one; documents are ordered by row.  Every window of LEAST words has one
*minimiser*: the place of its smallest hash of ``GRAM`` words, the leftmost of equals.  Equal windows have theirs
at the same place, so only the suffixes that start at minimisers, about one word in eighteen, are kept.

1. Suffixes that no other one shares the first GRAM words with are dropped.
2. A suffix stands for the run of windows that chose it.  Its context is the text of that run, from the first
   word of its first window to the last word of its last one.  Equal contexts are repeated as a whole; all but the
   first go, and the first stands for them in what follows.
3. Where suffixes share the first words but not the context, the match ends inside it.  A window with ``o`` words left
   of the minimiser repeats if ``o`` words to the left and ``LEAST - o`` to the right agree.  For each half of the
   offsets (``HALVES``) the words that all its windows hold are the key; suffixes are range-partitioned by key and
   sorted by the words right of it, so equal right parts are neighbours.  Each suffix is compared with its neighbour
   (the longest common prefix), which gives the runs that match to the right by any number of words; inside a run the
   match is extended to the left word by word, and the earliest stays.
4. A key with more than ``GROUP`` different contexts is settled window by window, by a sum that Spark combines before
   it shuffles, so no task holds an unbounded group.

All comparisons are of hashes of words (64 bits for keys, 32 more for each word compared one by one).

Defined results: null and empty texts, and those with fewer than LEAST words, have nothing removed; of repeated
rows the first keeps its text; null ids are allowed; an empty table gives no rows; other columns are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from . import _text as T
from ._arrow import trimmed
from ._io import numbered, release, stored

LEAST, GRAM = 50, 16
#: Offsets of windows from their minimiser, by halves; all windows of a half hold the words from -low to LEAST - high.
HALVES = ((0, 17), (18, LEAST - GRAM))
WIDTH = 17
GROUP = 20_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_DOWN = np.ones(1, np.uint64)


def _inverse_powers(n: int) -> np.ndarray:
    global _DOWN
    if len(_DOWN) < n:
        more = np.full(max(n, 2 * len(_DOWN), 256), _INVERSE, np.uint64)
        more[0] = 1
        _DOWN = np.multiply.accumulate(more)
    return _DOWN


class Spans:
    """Hashes of any run of consecutive words, by prefix sums."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * T.powers(n + 1)[:n], out=self.sums[1:])

    def of(self, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
        ends = starts + lengths
        return T.mix((self.sums[ends] - self.sums[starts]) * _inverse_powers(len(self.sums))[starts] + np.asarray(lengths, np.uint64) * _BASE)


def minimisers(w: T.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first window, last window) for each run of windows, as places among the words of the slice."""
    empty = np.empty(0, np.int64)
    windows = len(w.hashes) - LEAST + 1
    if windows < 1:
        return empty, empty, empty
    grams = T.window_hashes(w.hashes, GRAM)
    bits = np.uint64(max(1, int(len(grams)).bit_length()))
    least = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)  # ties: the leftmost
    span = LEAST - GRAM + 1
    have = 1
    while have < span:  # minima of runs of 1, 2, 4 ... grams
        step = min(have, span - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    chosen = (least[:windows] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    inside = w.text[:windows] == w.text[LEAST - 1 : LEAST - 1 + windows]
    at = np.flatnonzero(inside)
    if not len(at):
        return empty, empty, empty
    new = np.append(True, (chosen[at][1:] != chosen[at][:-1]) | (at[1:] != at[:-1] + 1))
    first = at[new]
    last = np.append(at[np.flatnonzero(new)[1:] - 1], at[-1])
    return chosen[first], first, last


_SUFFIX = S.StructType([S.StructField(n, t) for n, t in (("rid", S.LongType()), ("gram", S.LongType()), ("context", S.LongType()), ("start", S.IntegerType()), ("length", S.IntegerType()), ("at", S.IntegerType()))])


def suffixes(rows: DataFrame) -> DataFrame:
    """(rid, gram, context, start, length, at) of the suffixes at minimisers of ``rows`` (rid, _text); at: words of the context before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, rids = b["_text"].to_pylist(), b["rid"].to_numpy()
            for s in T.slices(texts):
                w = T.words_of(texts[s])
                place, first, last = minimisers(w)
                spans = Spans(w.hashes)
                lengths = last - first + LEAST
                begin = (np.cumsum(w.counts) - w.counts)[w.text[first]]
                columns = (rids[s][w.text[first]], spans.of(place, GRAM).view(np.int64), spans.of(first, lengths).view(np.int64), (first - begin).astype(np.int32), lengths.astype(np.int32), (place - first).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], _SUFFIX.names)

    return rows.mapInArrow(trimmed(run), _SUFFIX)


_SORTED = S.StructType([S.StructField(n, t) for n, t in (("low", S.IntegerType()), ("key", S.LongType()), ("right", S.BinaryType()), ("left", S.BinaryType()), ("rid", S.LongType()), ("place", S.IntegerType()), ("least", S.IntegerType()), ("most", S.IntegerType()))])


def _words_at(hashes: np.ndarray, places: np.ndarray) -> list[bytes]:
    """32 bits of the words at each row of ``places``; what lies outside is 0 and belongs to no window."""
    inside = (places >= 0) & (places < len(hashes))
    found = (hashes[np.where(inside, places, 0)] >> np.uint64(32)).astype(">u4")
    found[~inside] = 0
    return [row.tobytes() for row in found]


def placed(rows: DataFrame) -> DataFrame:
    """(low, key, right, left, rid, place, least, most) for each half of the windows of ``runs`` (start, length, at) in each _text.

    ``key``: hash of the words that the windows of the half share; ``right`` and ``left``: the words beyond them,
    nearest first; ``least`` and ``most``: offsets of the windows that the run has in this half.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, runs, rids = b["_text"].to_pylist(), b["runs"].to_pylist(), b["rid"].to_numpy()
            for s in T.slices(texts):
                w = T.words_of(texts[s])
                spans, begin = Spans(w.hashes), np.cumsum(w.counts) - w.counts
                own = np.array([(i, r["start"], r["length"], r["at"]) for i, rs in enumerate(runs[s]) for r in rs], np.int64).reshape(-1, 4)
                for low, high in HALVES:
                    least, most = np.maximum(own[:, 3] - (own[:, 2] - LEAST), low), np.minimum(own[:, 3], high)
                    of = own[least <= most]
                    place = of[:, 1] + of[:, 3]
                    at, steps = place + begin[of[:, 0]], np.arange(WIDTH)
                    right = _words_at(w.hashes, at[:, None] + LEAST - high + steps)
                    left = _words_at(w.hashes, at[:, None] - low - 1 - steps)
                    columns = (np.full(len(of), low, np.int32), spans.of(at - low, LEAST - high + low).view(np.int64), right, left, rids[s][of[:, 0]], place.astype(np.int32), least[least <= most].astype(np.int32), most[least <= most].astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], _SORTED.names)

    return rows.mapInArrow(trimmed(run), _SORTED)


_ARROW = [pa.field(n, t) for n, t in (("low", pa.int32()), ("key", pa.int64()), ("right", pa.binary()), ("left", pa.binary()), ("rid", pa.int64()), ("place", pa.int32()), ("least", pa.int32()), ("most", pa.int32()))]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u4").reshape(-1, WIDTH).astype(np.uint64)


def repeated_offsets(low: np.ndarray, key: np.ndarray, right: np.ndarray, left: np.ndarray, rid: np.ndarray, place: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """(offset - low, suffix): whether the window repeats an earlier one; suffixes are sorted by low, key and right."""
    n = len(key)
    equal = (right[1:] == right[:-1]).cumprod(1).sum(1)  # longest common prefix with the neighbour
    equal[(key[1:] != key[:-1]) | (low[1:] != low[:-1])] = -1
    high = np.where(low == HALVES[0][0], HALVES[0][1], HALVES[1][1])
    out, lefts = np.zeros((WIDTH + 1, n), bool), np.zeros(n, np.uint64)
    order = np.lexsort((place, rid))
    for a in range(WIDTH + 1):
        if a:
            lefts = T.mix(lefts * _BASE + left[:, a - 1])
        offset = low + a
        runs = np.append(0, np.cumsum(equal < (high - offset)[1:]))
        ours = order[((offset >= least) & (offset <= most))[order]]
        groups = T.mix(lefts[ours] ^ T.mix(runs[ours].astype(np.uint64)))
        _, first = np.unique(groups, return_index=True)  # the earliest, as ``ours`` is in order of place
        again = np.ones(len(ours), bool)
        again[first] = False
        out[a, ours[again]] = True
    return out


_SPAN = S.StructType([S.StructField("rid", S.LongType()), S.StructField("start", S.IntegerType()), S.StructField("end", S.IntegerType())])


def compared(suffix_rows: DataFrame) -> DataFrame:
    """(rid, start, end) that repeat among ``suffix_rows`` (as ``placed``): sorted by prefix, neighbours compared."""

    def spans_of(t: pa.Table) -> pa.RecordBatch:
        low, key, rid, place, least, most = (t[c].to_numpy() for c in ("low", "key", "rid", "place", "least", "most"))
        found = repeated_offsets(low, key, _matrix(t["right"]), _matrix(t["left"]), rid, place, least, most)
        edge = np.zeros((1, len(key)), bool)
        step = np.diff(np.concatenate([edge, found, edge]).astype(np.int8), axis=0)  # runs of offsets make one span
        (a, i), (z, k) = np.nonzero((step == 1).T)[::-1], np.nonzero((step == -1).T)[::-1]
        return pa.RecordBatch.from_arrays([pa.array(rid[i]), pa.array((place[i] - low[i] - z + 1).astype(np.int32)), pa.array((place[i] - low[i] - a + LEAST).astype(np.int32))], _SPAN.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            keys = b["key"].to_numpy()
            cut_at = int(np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))[-1])  # the last key may go on
            if held and (cut_at or keys[0] != held[-1]["key"][-1].as_py()):
                yield spans_of(pa.Table.from_batches([*held, b.slice(0, cut_at)]))
                held = []
            elif cut_at:
                yield spans_of(pa.Table.from_batches([b.slice(0, cut_at)]))
            held.append(b.slice(cut_at))
        if held:
            yield spans_of(pa.Table.from_batches(held))

    return suffix_rows.repartitionByRange("low", "key").sortWithinPartitions("low", "key", "right").mapInArrow(trimmed(run), _SPAN)


_WINDOW = S.StructType([S.StructField(n, t) for n, t in (("rid", S.LongType()), ("hash", S.LongType()), ("start", S.IntegerType()))])


def one_by_one(suffix_rows: DataFrame) -> DataFrame:
    """As ``compared``, for keys of any size: every window by its hash, combined in tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low, key, rid, place, least, most = (b[c].to_numpy() for c in ("low", "key", "rid", "place", "least", "most"))
            high = np.where(low == HALVES[0][0], HALVES[0][1], HALVES[1][1])
            right, left = (np.zeros((WIDTH + 1, len(key)), np.uint64) for _ in range(2))
            for j, (r, f) in enumerate(zip(_matrix(b["right"]).T, _matrix(b["left"]).T), 1):
                right[j], left[j] = T.mix(right[j - 1] * _BASE + r), T.mix(left[j - 1] * _BASE + f)
            for a in range(WIDTH + 1):
                at = np.flatnonzero((low + a >= least) & (low + a <= most))
                hashes = T.mix(T.mix(key[at].view(np.uint64) ^ T.mix((low[at] + a).astype(np.uint64))) * _BASE + left[a, at] * _INVERSE + right[(high - low - a)[at], at])
                yield pa.RecordBatch.from_arrays([pa.array(rid[at]), pa.array(hashes.view(np.int64)), pa.array((place[at] - low[at] - a).astype(np.int32))], _WINDOW.names)

    windows = stored(suffix_rows.mapInArrow(trimmed(run), _WINDOW))
    place = F.struct("rid", "start")
    firsts = windows.groupBy("hash").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash", "first")
    return windows.join(firsts, "hash").filter(place != F.col("first")).select("rid", "start", (F.col("start") + LEAST).alias("end"))


def repeats(rows: DataFrame) -> DataFrame:
    """(rid, spans), stored: word ranges [start, end) of ``rows`` (rid, _text; a stored table) that occurred before."""
    found = stored(suffixes(rows))
    shared = stored(found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram"))  # a table of its own: Spark then splits hot grams
    near = stored(found.join(shared, "gram"))
    release(found, shared)
    place = F.struct("rid", "start")
    contexts = stored(near.groupBy("gram", "context").agg(F.min(place).alias("first"), F.first("length").alias("length"), F.first("at").alias("at"), F.count(F.lit(1)).alias("n")))
    again = near.join(contexts.filter("n > 1").select("context", "gram", "first"), ["gram", "context"]).filter(place != F.col("first"))
    whole = stored(again.select("rid", "start", (F.col("start") + F.col("length")).alias("end")))
    release(near)
    mixed = stored(contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram"))
    open_runs = contexts.join(mixed, "gram").groupBy(F.col("first.rid").alias("rid")).agg(F.collect_list(F.struct(F.col("first.start").alias("start"), "length", "at")).alias("runs"))
    suffix_rows = stored(placed(rows.join(open_runs.hint("merge"), "rid")))
    sizes = stored(suffix_rows.groupBy("low", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    of = lambda some: suffix_rows.join(sizes.filter(some).select("low", "key"), ["low", "key"])
    spans = [whole, stored(compared(of(F.col("n") <= GROUP)))]
    if not sizes.filter(F.col("n") > GROUP).isEmpty():
        spans.append(one_by_one(of(F.col("n") > GROUP)))
    every = spans[0]
    for more in spans[1:]:
        every = every.unionByName(more)
    out = stored(every.groupBy("rid").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans")))
    release(contexts, mixed, suffix_rows, sizes, *spans)
    return out


def cut(text: str, spans: list[dict] | None) -> tuple[str, list[tuple[int, int]], int]:
    """(text without the spans, the spans merged, number of words)."""
    w = T.words_of([text], hashed=False)
    merged: list[list[int]] = []
    for s in sorted((s["start"], s["end"]) for s in spans or ()):
        if merged and s[0] <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], s[1])
        else:
            merged.append([*s])
    out, at = [], 0
    for a, z in merged:
        out.append(text[at : w.starts[a]])
        at = int(w.starts[z]) if z < len(w.starts) else len(text)
    return "".join(out) + text[at:], [(a, z) for a, z in merged], len(w.starts)


def deduplicated(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut from the text, and n_words, n_removed, spans (of words, as they were).

    A span goes with the white space after it.  Columns of ``docs`` named like the added ones are replaced.
    """
    row, spans = "__tallyloom_row", "__tallyloom_spans"
    added = [S.StructField("n_words", S.LongType()), S.StructField("n_removed", S.LongType()), S.StructField("spans", S.ArrayType(S.StructType([S.StructField("start", S.IntegerType()), S.StructField("end", S.IntegerType())])))]
    rows = numbered(docs, *(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)))
    read = rows.select("rid", F.coalesce(F.col(f"_c{docs.columns.index(text)}").cast("string"), F.lit("")).alias("_text"))
    own = rows.select(F.col("rid").alias(row), *(F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)))
    marked = own.join(repeats(read).select(F.col("rid").alias(row), F.col("spans").alias(spans)).hint("merge"), row, "left").drop(row)
    keep = [f for f in docs.schema if f.name not in {a.name for a in added}]
    schema = S.StructType([*keep, *added])
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(t, *cut(t or "", s)[1:]) if not s else cut(t, s) for t, s in zip(b[text].to_pylist(), b[spans].to_pylist())]
            new = {
                text: [f[0] for f in found], "n_words": [f[2] for f in found], "n_removed": [sum(z - a for a, z in f[1]) for f in found],
                "spans": [[{"start": a, "end": z} for a, z in f[1]] for f in found],
            }
            yield pa.RecordBatch.from_arrays([pa.array(new[f.name], type=k) if f.name in new else b.column(b.schema.get_field_index(f.name)) for f, k in zip(schema, kinds)], schema.names)

    return marked.mapInArrow(trimmed(run), schema)
