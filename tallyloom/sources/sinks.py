"""Writers: keyed documents, releases with a digest, deposits and metric tables."""

from __future__ import annotations

import functools
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import stored


#: Folders of keys beside the data, by hash.
BUCKETS = 256


def _children(spark: SparkSession, path: str) -> set[str]:
    """Names of the appends in a folder that were written to the end."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return set()
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    done = lambda n: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(where, f"{n}/_SUCCESS"))
    return {n for n in names if n.startswith("append=") and done(n)}


def _index(keys: DataFrame, key: str, path: str, name: str) -> None:
    bucketed = keys.select(F.col(key).cast("string").alias("key")).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)))
    bucketed.repartition("bucket").write.mode("overwrite").option("parquet.bloom.filter.enabled#key", "true").partitionBy("bucket").parquet(f"{path}/{name}")


def append_new(df: DataFrame, path: str, key: str, partition: str | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Append the rows whose key is not stored yet, as JSON, one a key; returns what was written.

    ``path``/data holds one folder an append, ``path``/keys the keys of each by bucket of their hash, so an append reads only
    the buckets of its own keys and never the data.  Of rows with one key the first by ``order`` is kept, ties by content.
    Data are written before their keys: an append that was lost in between is indexed by the next one.  A null key is
    never stored.
    """
    spark = df.sparkSession
    data, keys = f"{path}/data", f"{path}/keys"
    for name in sorted(_children(spark, data) - _children(spark, keys)):
        _index(spark.read.json(f"{data}/{name}").select(key), key, keys, name)
    content = F.to_json(F.struct(*(F.col(c) for c in sorted(df.columns))))
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order, content))
    new = df.filter(F.col(key).isNotNull()).withColumns({"__first": first, "__key": F.col(key).cast("string")}).filter("__first = 1").drop("__first")
    known = sorted(_children(spark, keys))
    if known:
        wanted = new.select(F.pmod(F.xxhash64("__key"), F.lit(BUCKETS)).alias("b")).distinct().collect()  # at most BUCKETS rows
        have = spark.read.schema("key string, bucket int").option("basePath", keys).parquet(*(f"{keys}/{n}" for n in known)).filter(F.col("bucket").isin([r["b"] for r in wanted]))
        new = new.join(have.select(F.col("key").alias("__key")), "__key", "left_anti")
    new = stored(new.drop("__key").select(df.columns))
    if not new.isEmpty():
        name = f"append={time.strftime('%Y%m%d%H%M%S', time.gmtime())}-{uuid.uuid4().hex[:12]}"
        writer = new.write
        (writer.partitionBy(partition) if partition else writer).json(f"{data}/{name}")
        _index(new, key, keys, name)
    return new


def appended(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All rows that ``append_new`` stored."""
    names = sorted(_children(spark, f"{path}/data"))
    parts = [spark.read.schema(schema).json(f"{path}/data/{n}") for n in names]
    return functools.reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def digest(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: rows and a digest that does not depend on their order or on partitions.

    Row hashes are summed in 16 lanes of 32 bits and hashed again, so nothing is gathered.
    """
    names = sorted(columns or df.columns)
    row = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in names)), 512)
    lanes = [F.coalesce(F.sum(F.conv(F.substring(row, 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string") for i in range(16)]
    return df.agg(F.count(F.lit(1)).alias("n"), F.sha2(F.concat_ws("|", *lanes), 256).alias("digest"))


def release(df: DataFrame, path: str, columns: Sequence[str], shards: int = 1) -> dict:
    """Published columns as Parquet and CSV under ``path``; missing columns are an error, others are reported."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    out = df.select(*columns)
    flat = out.select(*(F.array_join(c, ";").alias(c) if k.startswith("array<string") else F.col(c) for c, k in out.dtypes))
    out.repartition(shards).write.mode("overwrite").parquet(f"{path}/parquet")
    flat.repartition(shards).write.mode("overwrite").csv(f"{path}/csv", header=True)
    row = digest(flat).first()
    return {"rows": row["n"], "digest": row["digest"], "dropped": [c for c in df.columns if c not in columns]}


def deposit(docs: DataFrame, licensed: DataFrame, key: str, text: str) -> DataFrame:
    """Documents with the text kept only for licensed keys."""
    flag = licensed.select(key).distinct().withColumn("__licensed", F.lit(True))
    return docs.join(flag, key, "left").withColumn(text, F.when(F.col("__licensed"), F.col(text))).drop("__licensed")


def versioned(df: DataFrame, root: str, version: str) -> str:
    """Write a new version beside the old ones; an existing version is never replaced."""
    path = f"{root}/version={version}"
    df.write.mode("error").parquet(path)
    return path
