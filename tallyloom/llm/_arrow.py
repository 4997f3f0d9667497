"""Columns computed from Arrow batches, the other columns passed through untouched (nulls and types included)."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as S
from pyspark.sql.pandas.types import to_arrow_type


def give_back() -> None:
    """Return memory that Arrow and the C library hold but do not use; a worker lives on between the tasks of many stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over the batches of a task, which gives memory back at the task's end."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return whole


TYPES = {"long": S.LongType(), "int": S.IntegerType(), "double": S.DoubleType(), "string": S.StringType(), "boolean": S.BooleanType(), "binary": S.BinaryType()}


def fields(ddl: str) -> list[S.StructField]:
    """``"a long, b string"`` as fields."""
    return [S.StructField(*(name, TYPES[kind])) for name, kind in (x.split() for x in ddl.split(","))]


def with_columns(df: DataFrame, drop: tuple[str, ...], added: str, make: Callable[[pa.RecordBatch], dict]) -> DataFrame:
    """``df`` without ``drop`` and with the columns ``added`` that ``make`` computes for each batch."""
    kept = [f for f in df.schema if f.name not in drop]
    new = fields(added)
    kinds = [to_arrow_type(f.dataType) for f in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = make(b)
            arrays = [b.column(b.schema.get_field_index(f.name)) for f in kept]
            arrays += [pa.array(made[f.name], type=k) for f, k in zip(new, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, [f.name for f in (*kept, *new)])

    return df.mapInArrow(trimmed(run), S.StructType([*kept, *new]))


def exploded(df: DataFrame, drop: tuple[str, ...], added: str, make: Callable[[pa.RecordBatch], tuple[list[int], dict]]) -> DataFrame:
    """As ``with_columns``, but ``make`` also says which row of the batch each new row repeats."""
    kept = [f for f in df.schema if f.name not in drop]
    new = fields(added)
    kinds = [to_arrow_type(f.dataType) for f in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, made = make(b)
            rows = pa.array(rows, type=pa.int64())
            arrays = [b.column(b.schema.get_field_index(f.name)).take(rows) for f in kept]
            arrays += [pa.array(made[f.name], type=k) for f, k in zip(new, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, [f.name for f in (*kept, *new)])

    return df.mapInArrow(trimmed(run), S.StructType([*kept, *new]))
