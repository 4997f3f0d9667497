"""Vector best-fit packing of token pieces into sequences.

A sequence has three capacities: tokens, documents and attention cost (the sum of squared piece lengths).  The
pieces of a shard are placed by decreasing length; among the open sequences with room under *every* capacity,
the one with the least weighted norm of what would be left takes the piece (``score="norm"``), or the one with
the largest weighted dot product of need and room (``score="dot"``).  A capacity's weight is the total need over it.

Shards hold about ``SHARD_PIECES`` pieces whatever the size of the table, so a group is bounded and costs at
most a few part-filled sequences.  Pieces of full length fill a sequence and are numbered without a shuffle.

Defined results: a null text is an empty one and gives one piece, the end token; repeated rows and repeated or
null ids are packed as so many documents; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import exploded
from ._io import stored, text_column
from .bpe import encoder

SHARD_PIECES = 16_384
SIZE = 1024


def pieces_of(docs: DataFrame, path: str, size: int = SIZE, end_id: int = 2, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's ids and the end id, cut into pieces of ``size`` tokens of which the first may be shorter."""

    def make(b: pa.RecordBatch) -> tuple[list[int], dict]:
        e, end = encoder(path), np.array([end_id], "<u4").tobytes()
        rows: list[int] = []
        out: dict[str, list] = {"piece": [], "start": [], "length": [], "ids_crc32": []}
        for row, t in enumerate(b["_text"].to_pylist()):
            ids = e.encode_spaced(t) + end
            n = len(ids) // 4
            starts = [0, *range(n % size or size, n, size)]
            for k, (a, z) in enumerate(zip(starts, [*starts[1:], n])):
                rows.append(row)
                for name, value in zip(out, (k, a, z - a, zlib.crc32(ids[4 * a : 4 * z]))):
                    out[name].append(value)
        return rows, out

    return exploded(docs.select(docs[id], text_column(docs, text).alias("_text")), ("_text",), "piece int, start long, length long, ids_crc32 long", make)


def best_fit(lengths: np.ndarray, tokens: int, documents: int, attention: int, score: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece."""
    n = len(lengths)
    caps = np.array([tokens, documents, attention], float)
    need = np.stack([lengths, np.ones(n), lengths.astype(float) ** 2], 1) / caps
    if n and (need > 1).any():
        raise ValueError("a piece is larger than a capacity")
    weight = need.sum(0)
    weight /= weight.sum() or 1
    where, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    room, used, ids, live, made = np.empty((3, n)), np.zeros(n, np.int64), np.empty(n, np.int64), 0, 0
    least = lengths.min() / tokens - 1e-12 if n else 0.0
    for i in np.argsort(-lengths, kind="stable"):
        want = need[i]
        at = np.flatnonzero(room[0, :live] >= want[0] - 1e-12)
        at = at[(room[1, at] >= want[1] - 1e-12) & (room[2, at] >= want[2] - 1e-12)]
        if len(at):
            left = room[:, at]
            value = weight @ (left - want[:, None]) ** 2 if score == "norm" else -((weight * want) @ left)
            at = at[np.argmin(value)]
        else:
            at, live = live, live + 1
            room[:, at], used[at], ids[at] = 1.0, 0, made
            made += 1
        where[i], offset[i] = ids[at], used[at]
        used[at] += lengths[i]
        room[:, at] -= want
        if room[0, at] < least or room[1, at] <= 1e-12:  # full: the last open one takes its place
            live -= 1
            room[:, at], used[at], ids[at] = room[:, live], used[live], ids[live]
    return where, offset


def pack(pieces: DataFrame, tokens: int = SIZE, documents: int = SIZE, attention: int = SIZE * SIZE, score: str = "norm") -> DataFrame:
    """``pieces`` (with a ``length``; written once, so that their order is fixed) with sequence_id and offset."""
    pieces = stored(pieces)
    part = F.col("length") < tokens
    shards = max(1, math.ceil(pieces.filter(part).count() / SHARD_PIECES))
    numbered = pieces.withColumn("_row", F.monotonically_increasing_id())
    whole = numbered.filter(~part).withColumns({"sequence_id": F.lit(-1) - F.col("_row"), "offset": F.lit(0).cast("long")}).drop("_row")
    fields = whole.schema

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_row", kind="stable")
        where, offset = best_fit(group["length"].to_numpy(np.int64), tokens, documents, attention, score)
        group["sequence_id"], group["offset"] = (group["_shard"].to_numpy(np.int64) << 20) + where, offset
        return group[fields.names]

    dealt = numbered.filter(part).withColumn("_shard", F.pmod(F.xxhash64("_row"), F.lit(shards)))
    return dealt.groupBy("_shard").applyInPandas(run, fields).unionByName(whole)


def packed(docs: DataFrame, path: str, size: int = SIZE, end_id: int = 2, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenise, cut and pack ``docs``: id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces_of(docs, path, size, end_id, id, text), size, size, size * size)
