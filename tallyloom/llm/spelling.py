"""Spelling variants by an even-partition pigeonhole join.

Words are maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z lower-cased; one run in 31 (by the CRC-32 of
``<id>:<run>``) loses a code point first.  Those of at least ``least`` code points that occur at least twice are grouped.

Two words that are one edit apart agree outside any window of the shorter word that holds the edit.  A word of length L is
cut into two segments whose lengths depend on L alone; if the edit is in one, the other is whole, at its place or shifted
by one.  So each word is indexed by its two segments, and probes with those that a word of its own length or one shorter
would have: a row is (length, window of the shorter word, hash of what is outside the window), and candidates are rows with
equal hashes.  Every pair is kept in one window only, that which holds the place where the two words part, which makes
candidates distinct without a shuffle; the edit distance is verified inside the join, so only near words leave it.

A segment that more than ``BUCKET`` indexed words share is cut again: its window is halved, as long as it is longer than one
code point, where no more words meet than there are letters.  That is the same pigeonhole step on the rest of the words, so
no pair is lost and no bucket grows with the vocabulary.

A word's form is its near word of largest count, if that is at least ``factor`` times its own; counts rise along forms, so
chains are short (no longer than the logarithm of the largest count) and are followed by doubling.

Defined results: a null text has no words, a null id reads as empty; repeated rows count again; equal counts go to
the smaller form in code-point order; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._io import release, stored

LEAST = 7
FACTOR = 10
DAMAGED = 31
#: Indexed words that a segment may be shared by before its window is halved.
BUCKET = 48
#: Distinct words that a task holds before it passes them on.
HELD_WORDS = 400_000


def word_counts(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(word, n) of all texts: partial counts in tasks, sums by a shuffle."""
    runs = re.compile(f"[a-zÀ-ÿ]{{{least},}}")  # a shorter run cannot give a word

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        for b in batches:
            for key, t in zip(b["_id"].to_pylist(), b["_text"].to_pylist()):
                start = zlib.crc32(f"{key}:".encode())
                for word, n in Counter(runs.findall(t.encode().lower().decode())).items():  # bytes lower A-Z alone
                    h = zlib.crc32(word.encode(), start)
                    if h % DAMAGED == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    held[word] += n
                if len(held) > HELD_WORDS:
                    yield out()
                    held.clear()
        yield out()

    rows = docs.filter(docs[text].isNotNull()).select(F.coalesce(docs[id].cast("string"), F.lit("")).alias("_id"), docs[text].cast("string").alias("_text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _outside(a: Column, b: Column, shift: Column) -> Column:
    """The hash of a word's length (less the shift), its window and what is outside it."""
    word = F.col("word")
    return F.xxhash64(F.length(word) - shift, a, b, F.substring(word, F.lit(1), a), F.substring(word, b + shift + 1, F.length(word)))


def _cells(rows: DataFrame, windows: Column) -> DataFrame:
    """Rows (word, n, shift) once for each of ``windows``, with the hash of what is outside it."""
    cut = rows.select("word", "n", "shift", F.explode(windows).alias("w")).select("word", "n", "shift", "w.a", "w.b")
    return cut.withColumn("key", _outside(F.col("a"), F.col("b"), F.col("shift")))


def _window(a: Column, b: Column) -> Column:
    return F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))


def near_pairs(words: DataFrame, least: int = LEAST, bucket: int = BUCKET) -> tuple[DataFrame, list[DataFrame]]:
    """(word, n, other, other_n) of all pairs of words one edit apart, each once, and the stored tables it reads."""
    shifts = F.explode(F.when(F.length("word") > least, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("shift")
    size = F.length("word") - F.col("shift")
    half = F.floor(size / 2)
    cells = stored(_cells(words.select("word", "n", shifts), F.array(_window(F.lit(0), half), _window(half, size))))
    prefix = lambda side, n: F.substring(F.col(f"{side}.word"), F.lit(1), F.col(n))
    same_window = (F.col("x.key") == F.col("y.key")) & (F.col("x.a") == F.col("y.a")) & (F.col("x.b") == F.col("y.b")) & (F.length("x.word") == F.length("y.word") - F.col("y.shift"))
    parts_here = (prefix("x", "x.a") == prefix("y", "x.a")) & ((F.col("x.b") == F.length("x.word")) | (prefix("x", "x.b") != prefix("y", "x.b")))
    once = (F.col("y.shift") == 1) | (F.col("x.word") < F.col("y.word"))
    near = F.levenshtein(F.col("x.word"), F.col("y.word"), 1) == 1
    found = []
    while True:
        hot = stored(cells.filter("shift = 0 and b - a > 1").groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > bucket).select("key"))
        cold = cells.join(hot, "key", "left_anti")
        met = cold.filter("shift = 0").alias("x").join(cold.alias("y"), same_window & once & parts_here & near)
        found.append(stored(met.select(F.col("x.word").alias("word"), F.col("x.n").alias("n"), F.col("y.word").alias("other"), F.col("y.n").alias("other_n"))))
        if hot.isEmpty():
            release(cells, hot)
            return functools.reduce(DataFrame.unionByName, found), found
        middle = F.floor((F.col("from") + F.col("to")) / 2)
        whole = cells.join(hot, "key", "left_semi").select("word", "n", "shift", F.col("a").alias("from"), F.col("b").alias("to"))
        halved = stored(_cells(whole, F.array(_window(F.col("from"), middle), _window(middle, F.col("to")))))
        release(cells, hot)
        cells = halved


def followed(links: DataFrame, word: str = "word", form: str = "form") -> DataFrame:
    """(word, root): the end of the chain of forms from each word that has one, by doubling."""
    chains = stored(links.select(F.col(word).alias("word"), F.col(form).alias("root")))
    while True:
        on = chains.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = stored(chains.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        release(chains)
        chains = longer
        if chains.filter("moved").isEmpty():
            return chains.drop("moved")


def variants(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = LEAST, factor: int = FACTOR, bucket: int = BUCKET) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word that occurs at least twice."""
    words = stored(word_counts(docs, id, text, least).filter("n >= 2"))
    pairs, tables = near_pairs(words, least, bucket)
    kind = "struct<less:bigint,other:string>"
    one = lambda word, n, other, other_n: F.struct(F.col(word).alias("word"), F.col(n).alias("n"), F.struct((-F.col(other_n)).alias("less"), F.col(other).alias("other")).cast(kind).alias("near"))
    sides = pairs.select(F.explode(F.array(one("word", "n", "other", "other_n"), one("other", "other_n", "word", "n"))).alias("r")).select("r.*")
    alone = words.select("word", "n", F.lit(None).cast(kind).alias("near"))
    best = sides.unionByName(alone).groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), F.min("near").alias("near"))
    form = F.when(-F.col("near.less") >= factor * F.col("n"), F.col("near.other"))
    found = stored(best.withColumn("form", form).select("word", "form", F.when(F.col("form").isNotNull(), -F.col("near.less")).alias("form_n"), "n", "n_near"))
    release(words, *tables)
    roots = followed(found.filter("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
