"""Sentences and chunks of plain text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import uuid5


def sentences(text: Column) -> Column:
    """The sentences of a text: split after . ! ? before white space, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda x: x != "")


# Fixed value: the length from which a block is split, and where sentences end (above).
def packed_sentences(text: Column, most: int = 2800) -> Column:
    """Runs of sentences joined by a space, each at most ``most`` characters unless one sentence is longer."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(s: Column, x: Column) -> Column:
        joined = F.when(s["open"] == "", x).otherwise(F.concat_ws(" ", s["open"], x))
        fits = F.length(joined) <= most
        return F.struct(F.when(fits | (s["open"] == ""), s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))).alias("done"), F.when(fits | (s["open"] == ""), joined).otherwise(x).alias("open"))

    return F.aggregate(sentences(text), start, step, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))


def split_long(text: Column, most: int = 2800) -> Column:
    """A block of text as it is if it is short enough or holds a table, whose rows must stay with their header; else runs of
    its sentences.  Blank text gives none."""
    table = F.ltrim(text).startswith("|") | F.contains(text, F.lit("\n| "))
    return F.when(text.isNull() | (F.trim(text) == ""), F.array().cast("array<string>")).when((F.length(text) <= most) | table, F.array(text)).otherwise(packed_sentences(text, most))


def chunked(docs: DataFrame, key: str, text: str, most: int = 2800) -> DataFrame:
    """(key, pos, chunk_id, text); the id is named after key, position and text."""
    rows = docs.select(key, F.posexplode(split_long(F.col(text), most)).alias("pos", "text"))
    return rows.select(key, "pos", uuid5(F.concat_ws("|", F.col(key).cast("string"), F.col("pos").cast("string"), F.substring("text", 1, 200))).alias("chunk_id"), "text")


def chunk_file(rows: DataFrame, key: str) -> DataFrame:
    """(key, text) with the chunks of each key written as ``ID:`` blocks in order."""
    block = F.struct("pos", F.concat(F.lit("ID: "), F.col("chunk_id"), F.lit("\n"), F.col("text"), F.lit("\n")).alias("b"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda x: x["b"]), "\n").alias("text"))
