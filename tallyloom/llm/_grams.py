"""Counts of character n-grams by language, as Spark jobs: partial counts in tasks, sums by a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._arrow import trimmed

#: Distinct grams that a task holds before it sends its partial counts on.
HELD_GRAMS = 1_000_000


def distinct_words(texts: list[str], letters: bool = False) -> tuple[T.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a slice, one place of each distinct word, which distinct word each is, and counts."""
    w = T.words_of(texts, letters=letters)
    _, first, inverse, counts = np.unique(w.hashes, return_index=True, return_inverse=True, return_counts=True)
    return w, first, inverse, counts


def slice_grams(texts: list[str], letters: bool, order: int = 4, bits: int = 16) -> tuple[np.ndarray, np.ndarray]:
    w, first, _, counts = distinct_words(texts, letters)
    grams, word = T.char_grams(w.codes, w.starts[first], w.ends[first], order, bits)
    return T.sums_by(grams, counts[word].astype(np.int64))


def gram_counts(docs: DataFrame, letters: bool = False, order: int = 4, bits: int = 16) -> DataFrame:
    """(lang, gram, n) over all texts of ``docs`` (lang, text; neither null)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}
        size = 0

        def sums() -> Iterator[pd.DataFrame]:
            for lang, parts in held.items():
                grams, n = T.sums_by(*(np.concatenate(x) for x in zip(*parts)))
                yield pd.DataFrame({"lang": lang, "gram": grams.view(np.int64), "n": n})

        for b in batches:
            for lang, group in b.groupby("lang"):
                texts = group["text"].tolist()
                for s in T.slices(texts):
                    part = slice_grams(texts[s], letters, order, bits)
                    parts = held.setdefault(lang, [])
                    parts.append(part)
                    size += len(part[0])
                    if len(parts) > 8:  # sums of sums stay as small as the distinct grams
                        size -= sum(len(p[0]) for p in parts)
                        held[lang] = [T.sums_by(*(np.concatenate(x) for x in zip(*parts)))]
                        size += len(held[lang][0][0])
            if size > HELD_GRAMS:
                yield from sums()
                held, size = {}, 0
        yield from sums()

    return docs.select("lang", "text").mapInPandas(trimmed(run), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
