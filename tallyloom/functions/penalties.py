"""Penalties between two values: 0 agrees, 1 is wrong."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import normalised

#: Thresholds of the scorer: a pair counts below ACCEPT, names agree from GATE, numbers are wrong TOLERANCE off.
ACCEPT, GATE, TOLERANCE = 0.30, 0.60, 0.20
SAME_NUMBER = 0.01
#: Pairs of names whose ratio a task remembers.
REMEMBERED = 100_000


def numeric(a: Column, b: Column, tolerance: Column | float = TOLERANCE) -> Column:
    """Both null: 0, one null: 1, within SAME_NUMBER: 0, else the relative difference over the tolerance, at most 1."""
    a, b = a.cast("double"), b.cast("double")
    apart = F.abs(a - b)
    share = F.try_divide(apart, F.greatest(F.abs(a), F.abs(b)))
    return (
        F.when(a.isNull() & b.isNull(), 0.0).when(a.isNull() | b.isNull(), 1.0).when(apart <= SAME_NUMBER, 0.0)
        .otherwise(F.least(share / (F.lit(tolerance) if isinstance(tolerance, float) else tolerance), F.lit(1.0)))
    )


def numeric_of(a: np.ndarray, no_a: np.ndarray, b: np.ndarray, no_b: np.ndarray, tolerance: float = TOLERANCE) -> np.ndarray:
    """``numeric`` of two arrays with the masks of their nulls."""
    with np.errstate(all="ignore"):
        apart = np.abs(a - b)
        share = np.fmin(apart / np.maximum(np.abs(a), np.abs(b)) / tolerance, 1.0)
    return np.where(no_a & no_b, 0.0, np.where(no_a | no_b, 1.0, np.where(apart <= SAME_NUMBER, 0.0, share)))


def equality(a: Column, b: Column) -> Column:
    return F.when(a.eqNullSafe(b), 0.0).otherwise(1.0)


class Ratios:
    """Similarities of names that a task remembers, up to ``REMEMBERED`` pairs."""

    def __init__(self) -> None:
        self.known: dict[tuple[str, str], float] = {}

    def of(self, x: Iterable[str], y: Iterable[str]) -> list[float]:
        """The ratio of ordered matching blocks of each pair; two empty names have ratio 1, one empty name ratio 0."""
        out, known = [], self.known
        for pair in zip(x, y):
            if pair not in known:
                if len(known) >= REMEMBERED:
                    known.clear()
                p, q = pair
                known[pair] = 1.0 if p == q else SequenceMatcher(None, p, q).ratio() if p and q else 0.0
            out.append(known[pair])
        return out


def with_string_ratio(pairs: DataFrame, left: str, right: str, name: str = "ratio") -> DataFrame:
    """``pairs`` with the similarity of two normalised names, computed once for each distinct pair that a task remembers.

    The ratio depends on the order of its arguments, and has no SQL form.  Nothing is shuffled.
    """

    @F.pandas_udf("double")
    def ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        ratios = Ratios()
        for x, y in batches:
            yield pd.Series(ratios.of(x, y), dtype="float64")

    return pairs.withColumn(name, ratio(normalised(F.col(left)), normalised(F.col(right))))
