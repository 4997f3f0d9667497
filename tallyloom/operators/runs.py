"""Comparing runs, arms and datasets: pairing by name, coverage, parity, and what each paper holds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.penalties import SAME_NUMBER
from ..functions.rules import normalised
from . import stats


def paired_by_name(runs: DataFrame, run: str, pattern: str = r"^judge_(.+)_on_(.+)$") -> DataFrame:
    """``runs`` whose name fits, with ``judge`` and ``extraction`` read from it; a repeated pair fails while running."""
    fit = runs.filter(F.col(run).rlike(pattern)).withColumns({"judge": F.regexp_extract(run, pattern, 1), "extraction": F.regexp_extract(run, pattern, 2)})
    n = F.count(F.lit(1)).over(Window.partitionBy("judge", "extraction"))
    return fit.withColumn("__n", F.when(n > 1, F.raise_error(F.lit("a judge has two runs on one extraction")).cast("long")).otherwise(n)).filter("__n = 1").drop("__n")


def judge_matrix(labels: DataFrame, verdicts: DataFrame, on: Sequence[str], extraction: str = "extraction", run: str = "run", metric: str = "metric", judge: str = "judge", situation: str = "situation", alone: str = "no counterpart") -> DataFrame:
    """One row a judge and extraction: how often the judge says what the metric says, from the runs to the rates in one plan.

    ``labels`` (extraction, on, metric, situation) of all extractions, ``verdicts`` (run, on, judge) of all judge runs, named
    ``judge_<judge>_on_<extraction>``; a run of another name or of an unknown extraction is left out.  (judge, extraction,
    records, agreement, evaluable, agreement_evaluable, agree, disagree, no_counterpart); agree, disagree and no counterpart
    sum to records.
    """
    named = paired_by_name(verdicts.select(F.col(run).alias("__run")).distinct(), "__run")
    said = verdicts.join(named.select("__run", F.col("judge").alias("__judge"), F.col("extraction").alias("__on")), F.col(run) == F.col("__run")).select("__judge", "__on", *(F.col(c).alias(f"__{c}") for c in on), F.col(judge).alias("__said"))
    same = F.col(extraction) == F.col("__on")
    for c in on:
        same = same & (F.col(c) == F.col(f"__{c}"))
    met = labels.join(said, same).select(F.col("__judge").alias("judge"), F.col("__on").alias("extraction"), F.col(metric).alias("__metric"), "__said", (F.col(situation) != alone).alias("__evaluable"))
    return stats.evaluable_agreement(met, F.col("__metric"), F.col("__said"), F.col("__evaluable"), ["judge", "extraction"])


def states(planned: DataFrame, extracted: DataFrame, evaluated: DataFrame, key: str) -> DataFrame:
    """``planned`` with ``state``: planned, extracted or evaluated."""
    mark = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(True))
    out = planned.join(mark(extracted, "__x"), key, "left").join(mark(evaluated, "__e"), key, "left")
    return out.withColumn("state", F.when(F.col("__e"), "evaluated").when(F.col("__x"), "extracted").otherwise("planned")).drop("__x", "__e")


def common_arm(runs: DataFrame, model: str, arm: str) -> DataFrame:
    """(arm, models, repeats) of the arms that every model has, the most repeated first."""
    models = runs.agg(F.countDistinct(model).alias("__all"))
    per = runs.groupBy(arm).agg(F.countDistinct(model).alias("models"), F.count(F.lit(1)).alias("repeats"))
    return per.crossJoin(F.broadcast(models)).filter(F.col("models") == F.col("__all")).drop("__all").orderBy(F.desc("repeats"), arm)


def papers(records: DataFrame, verdicts: DataFrame, chunks: DataFrame, doc: str, index: str, cited: str, chunk: str) -> DataFrame:
    """One row a document: its records in order with verdict, cited chunks present and missing, and counts by state.

    The arrays hold one document's records and chunks, which bound them.
    """
    have = chunks.groupBy(doc).agg(F.collect_set(chunk).alias("__have"))
    rows = records.join(verdicts.select(doc, index, "verdict"), [doc, index], "left").join(have, doc, "left")
    ids, have_ = F.coalesce(F.col(cited), F.array().cast("array<string>")), F.coalesce(F.col("__have"), F.array().cast("array<string>"))
    rows = rows.withColumns({"present": F.array_intersect(ids, have_), "missing": F.array_except(ids, have_), "verdict": F.coalesce("verdict", F.lit("unjudged"))})
    one = F.struct(index, "verdict", "present", "missing")
    return rows.groupBy(doc).agg(F.array_sort(F.collect_list(one)).alias("records"), F.count_if(F.col("verdict") == "correct").alias("correct"), F.count_if(F.col("verdict") == "incorrect").alias("incorrect"), F.count_if(F.col("verdict") == "unjudged").alias("unjudged"))


def judge_recall(records: DataFrame, constraints: Mapping[str, Column], verdicts: DataFrame, on: Sequence[str]) -> DataFrame:
    """(constraint, n, caught, recall): records that break a hard constraint and how many the judge rejects; no verdict counts as correct."""
    rows = records.join(verdicts.select(*on, "verdict"), list(on), "left").withColumn("verdict", F.coalesce("verdict", F.lit("correct")))
    cells = [F.struct(F.lit(k).alias("constraint"), F.count_if(v).alias("n"), F.count_if(v & (F.col("verdict") != "correct")).alias("caught")) for k, v in constraints.items()]
    return rows.agg(F.array(*cells).alias("a")).select(F.inline("a")).withColumn("recall", F.try_divide("caught", "n"))


def parity(pairs: DataFrame, fields: Sequence[str], left: str, right: str, points: float = 2.0) -> DataFrame:
    """(field, n, same, close, close_share): both known, equal, and within ``points``."""
    long = pairs.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(left + f).cast("double").alias("a"), F.col(right + f).cast("double").alias("b")) for f in fields))).alias("x")).select("x.*").dropna()
    out = long.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") == F.col("b")).alias("same"), F.count_if(F.abs(F.col("a") - F.col("b")) <= points).alias("close"))
    return out.withColumn("close_share", F.col("close") / F.col("n"))


def field_agreement(pairs: DataFrame, fields: Sequence[str], left: str, right: str, texts: Sequence[str] = (), apart: float = SAME_NUMBER) -> DataFrame:
    """(field, n, agree): share of the pairs with both known that agree: numbers at most ``apart``, ``texts`` by normalised equality."""
    number = lambda f: F.abs(F.col(left + f).cast("double") - F.col(right + f).cast("double")) <= apart
    text = lambda f: F.when(F.col(left + f).isNotNull() & F.col(right + f).isNotNull(), normalised(F.col(left + f)) == normalised(F.col(right + f)))
    cells = [F.struct(F.lit(f).alias("field"), test(f).alias("ok")) for test, own in ((number, fields), (text, texts)) for f in own]
    long = pairs.select(F.explode(F.array(*cells)).alias("x")).select("x.*").dropna()
    return long.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("ok").cast("double")).alias("agree"))


def conditions(df: DataFrame, x: str, y: str, log: Sequence[str] = ()) -> DataFrame:
    """(x, y) of rows where both are known; axes in ``log`` as log10, of positive values only."""
    axis = lambda c: (F.log10(c) if c in log else F.col(c)).alias(c)
    shown = lambda c: F.col(c) > 0 if c in log else F.col(c).isNotNull()
    return df.filter(shown(x) & shown(y)).select(axis(x), axis(y))


def runner_up(df: DataFrame, arm: str, value: str, setting: Column | None = None) -> DataFrame:
    """(best, second, meet): of the runs at one setting, where the worst of the best arm by mean meets the best of the next one.

    ``meet`` is the smaller of the two.
    """
    per = (df if setting is None else df.filter(setting)).groupBy(arm).agg(F.avg(value).alias("mean"), F.min(value).alias("worst"), F.max(value).alias("top"))
    top = per.orderBy(F.desc("mean"), arm).limit(2).withColumn("place", F.row_number().over(Window.orderBy(F.desc("mean"), arm)))
    at = lambda c, p: F.max(F.when(F.col("place") == p, F.col(c)))
    return top.agg(at(arm, 1).alias("best"), at(arm, 2).alias("second"), F.least(at("worst", 1), at("top", 2)).alias("meet"))


def artifact_digest(files: DataFrame) -> DataFrame:
    """One hash over (path, size) of files, however they are listed: lanes of row hashes are summed."""
    from ..sources.sinks import digest

    return digest(files, ["path", "size"])
