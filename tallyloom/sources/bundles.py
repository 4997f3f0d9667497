"""Readers of record bundles: one JSON document a paper, chunked text, and CSV dimensions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S

CHUNK_ID = r"ID: ([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})"


def documents(spark: SparkSession, path: str, schema: T.StructType, key: str = "doi") -> DataFrame:
    """JSON documents by key; of several files with one key the last by path is taken."""
    read = spark.read.schema(schema).json(path, multiLine=True).withColumn("__path", F.col("_metadata.file_path"))
    rest = [c for c in schema.names if c != key]
    return read.groupBy(key).agg(F.max_by(F.struct(*rest), "__path").alias("d")).select(key, "d.*")


def records(spark: SparkSession, path: str) -> DataFrame:
    """One row a record: doi, index (its position) and the fields."""
    docs = documents(spark, path, S.EXTRACTION)
    return docs.select("doi", F.posexplode("records").alias("index", "r")).select("doi", "index", "r.*")


def curated(spark: SparkSession, path: str) -> DataFrame:
    """One row a curated experiment: doi, index and the fields."""
    docs = spark.read.schema(S.CURATED).json(path, multiLine=True)
    return docs.select("doi", F.posexplode("extracted_experiments.experiment_data").alias("index", "r")).select("doi", "index", "r.*")


def verdicts(spark: SparkSession, path: str) -> DataFrame:
    """Parsed verdicts; anything but "correct" is incorrect."""
    rows = documents(spark, path, S.VERDICTS).select("doi", F.inline("verdicts")).filter(F.coalesce("parsed_ok", F.lit(False)))
    return rows.withColumn("verdict", F.when(F.col("verdict") == "correct", "correct").otherwise("incorrect")).withColumnRenamed("extracted_index", "index")


def fixes(verdict_rows: DataFrame) -> DataFrame:
    """doi, index, place, field, value, evidence of every proposed fix."""
    return verdict_rows.select("doi", "index", F.posexplode("fixes").alias("place", "f")).select("doi", "index", "place", "f.*")


def experiments(spark: SparkSession, path: str) -> DataFrame:
    """One row a paper: doi and its records in order; a paper without records has an empty array."""
    docs = documents(spark, path, S.EXTRACTION)
    return docs.select("doi", F.coalesce("records", F.array().cast(S.EXTRACTION["records"].dataType)).alias("records"))


def runs(spark: SparkSession, path: str, configs: DataFrame | None = None) -> DataFrame:
    """Run metadata of ``path``/<run>/ and ``path``/<folder>/<run>/ with ``run`` as the path below ``path``; only runs whose own or
    whose folder's name ``configs`` (run) still holds, if given."""
    read = spark.read.schema(S.RUN).option("recursiveFileLookup", True).option("pathGlobFilter", "run_meta.json").json(path, multiLine=True)
    root = spark._jvm.org.apache.hadoop.fs.Path(path).toUri().getPath().rstrip("/")
    below = F.split(F.element_at(F.split("_metadata.file_path", re.escape(f"{root}/"), 2), 2), "/")
    depth = F.size(below) - 1
    read = read.withColumns({"run": F.array_join(F.slice(below, 1, depth), "/"), "__own": F.get(below, depth - 1), "__above": F.when(depth > 1, below[0])}).filter(depth.isin(1, 2))
    if configs is not None:
        names = configs.select(F.col("run").alias("__config")).distinct()
        read = read.join(names, F.array_contains(F.array("__own", "__above"), F.col("__config")), "left_semi")
    return read.drop("__own", "__above")


def labelled(labels: DataFrame, scored: DataFrame, old: tuple[str, str] = ("judge", "metric"), rubric: str = "judge_v4") -> DataFrame:
    """Human labels with both graders' answers: columns of older rubrics give way to ``rubric`` and to the scorer's own answer.

    ``labels`` (doi, extracted_index, human, ...), ``scored`` (doi, index, metric, situation); labels of unscored records are left out.
    """
    rows = labels.drop(*old).withColumnRenamed(rubric, "judge").withColumnRenamed("extracted_index", "index")
    return rows.join(scored.select("doi", "index", "metric", "situation"), ["doi", "index"])


def chunks(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, chunk_id, text) of the ``ID: uuid`` blocks of each text, in order."""
    ids = F.regexp_extract_all(text, F.lit(f"(?m)^{CHUNK_ID}$"), F.lit(1))
    bodies = F.slice(F.split(text, f"(?m)^{CHUNK_ID}$"), 2, 2_000_000_000)
    rows = texts.select(key, F.posexplode(F.arrays_zip(ids.alias("chunk_id"), bodies.alias("text"))).alias("pos", "c"))
    return rows.select(key, "pos", F.col("c.chunk_id").alias("chunk_id"), F.trim(F.regexp_replace("c.text", r"^\n|\n$", "")).alias("text"))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(key, text) of whole text files, the key read from the file name."""
    from ..functions.rules import key_of_file

    return spark.read.text(path, wholetext=True).select(key_of_file(F.col("_metadata.file_path")).alias("key"), F.col("value").alias("text"))


def csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Search hits with ``keep`` as a boolean and the queries as an array."""
    return csv(spark, path, S.CANDIDATES).withColumns({"keep": F.lower("keep") == "true", "queries": F.split("queries", r"\|")})


def source_formats(spark: SparkSession, path: str) -> DataFrame:
    """(doi, format): the format a paper arrived in; dois in lower case."""
    return csv(spark, path, S.FORMATS).withColumn("doi", F.lower("doi"))


def open_access(spark: SparkSession, path: str) -> DataFrame:
    """(doi, is_oa): whether a paper is open; dois trimmed and in lower case, anything but "true" is not."""
    return csv(spark, path, S.ACCESS).select(F.lower(F.trim("doi")).alias("doi"), F.coalesce(F.lower(F.trim("is_oa")) == "true", F.lit(False)).alias("is_oa"))


def yield_basis(spark: SparkSession, path: str) -> DataFrame:
    """(doi, yield_basis): what a paper's yields are shares of; blank is null."""
    return csv(spark, path, S.BASIS).withColumn("yield_basis", F.nullif("yield_basis", F.lit("")))


def lookup(spark: SparkSession, path: str) -> DataFrame:
    """(kind, name, value, note): structures by kind and name; a blank one is a refusal."""
    return csv(spark, path, S.LOOKUP).withColumnRenamed("smiles", "value")


def overlap(spark: SparkSession, path: str, theirs: str = "theirs_") -> DataFrame:
    """Two data sets' records side by side: doi, category, rule_said, and each field of both with its prefix.  ``theirs`` is
    what the file calls the other side's columns; blanks are null."""
    sides = [T.StructField(f"{side}{f.name}", f.dataType) for side in (theirs, "ours_") for f in S.RECORD if f.name in S.SCORED]
    read = spark.read.option("enforceSchema", False).csv(path, header=True, multiLine=True, escape='"')
    kinds = {"doi": T.StringType(), "category": T.StringType(), "rule_said": T.StringType()} | {f.name: f.dataType for f in sides}
    have = {c: F.nullif(F.trim(F.col(c)), F.lit("")) for c in read.columns}
    return read.select(*((have[c].try_cast(k) if c in have else F.lit(None).cast(k)).alias(c.replace(theirs, "theirs_", 1) if c.startswith(theirs) else c) for c, k in kinds.items()))


def corpus(wanted: DataFrame, available: DataFrame, done: DataFrame, key: str, chunk_rows: DataFrame, least: int = 5) -> DataFrame:
    """Keys that are wanted, available, not done and have at least ``least`` chunks."""
    enough = chunk_rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select(key)
    return wanted.join(available, key, "left_semi").join(done, key, "left_anti").join(enough, key, "left_semi")
