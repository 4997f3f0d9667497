"""A registry of metrics that declare their inputs: one table of name, value, inputs and operation."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce
from string import Template

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Metric:
    """``make`` turns the named inputs into a one-row frame whose ``value`` is the metric."""

    name: str
    inputs: tuple[str, ...]
    operation: str
    make: Callable[..., DataFrame]


def collected(metrics: list[Metric], tables: dict[str, DataFrame]) -> DataFrame:
    """(name, value, formatted, inputs, operation) of all metrics, as one plan."""
    rows = [
        m.make(*(tables[i] for i in m.inputs)).select(
            F.lit(m.name).alias("name"), F.col("value").cast("double").alias("value"), F.array(*map(F.lit, m.inputs)).alias("inputs"), F.lit(m.operation).alias("operation")
        )
        for m in metrics
    ]
    table = reduce(DataFrame.unionByName, rows)
    small = F.when(F.col("value") == F.floor("value"), F.format_number("value", 0)).otherwise(F.format_number("value", 3))
    return table.withColumn("formatted", small)


def lineage(metrics: list[Metric]) -> dict[str, tuple[str, ...]]:
    """Which metrics depend on each input."""
    out: dict[str, tuple[str, ...]] = {}
    for m in metrics:
        for i in m.inputs:
            out[i] = (*out.get(i, ()), m.name)
    return out


def macro_lines(table: DataFrame, used: dict[str, str] | None = None) -> DataFrame:
    """(value): one LaTeX definition a metric, with its operation and inputs as a comment; names keep their letters only.

    ``used`` renames metrics.  Written with ``write.text``, it is what ``macros`` reads.
    """
    renamed = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in (used or {"": ""}).items() for x in kv)), F.col("name")), F.col("name"))
    words = F.transform(F.filter(F.split(renamed, "[^A-Za-z]+"), lambda w: w != ""), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000)))
    value = F.regexp_replace("formatted", r"([%&#_$])", r"\\$1")
    return table.select(F.concat(F.lit("\\newcommand{\\"), F.array_join(words, ""), F.lit("}{"), value, F.lit("} % "), F.col("operation"), F.lit(" of "), F.array_join("inputs", ", ")).alias("value"))


def macros(lines: DataFrame, column: str = "value") -> DataFrame:
    """(name, value, derivation) of the LaTeX definitions in lines of text."""
    part = lambda i: F.regexp_extract(column, r"^\s*\\newcommand\{\\([A-Za-z]+)\}\{(.*?)\}\s*(?:%\s*(.*))?$", i)
    return lines.select(part(1).alias("name"), F.regexp_replace(part(2), r"\\([%&#_$])", "$1").alias("value"), F.coalesce(part(3), F.lit("")).alias("derivation")).filter("name <> ''")


def card(table: DataFrame, title: str, about: str = "") -> DataFrame:
    """(value): a dataset card in Markdown, one line a row in order: title, text and a table of the metrics."""
    head = [f"# {title}", "", *([about, ""] if about else []), "| metric | value | from |", "|-|-|-|"]
    top = table.sparkSession.createDataFrame([(i, line) for i, line in enumerate(head)], "place long, value string")
    rows = table.select(F.lit(len(head)).cast("long").alias("place"), F.concat(F.lit("| "), "name", F.lit(" | "), "formatted", F.lit(" | "), "operation", F.lit(" of "), F.array_join("inputs", ", "), F.lit(" |")).alias("value"))
    return top.unionByName(rows).orderBy("place", "value").select("value")


def config(path: str, environment: Mapping[str, str]) -> dict:
    """A run's configuration from YAML or JSON with ``${NAME}`` taken from ``environment``; an unknown name is an error."""
    with open(path, encoding="utf-8") as f:
        text = Template(f.read()).substitute(environment)
    if path.endswith(".json"):
        return json.loads(text)
    import yaml  # only needed for YAML

    found = yaml.safe_load(text)
    if not found:
        raise ValueError(f"{path} holds no configuration")
    return found
