"""Tables that a job writes once and reads again: lineage is cut and lost executors cost no recomputation."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

#: Tables that are still there, with the session that wrote them.
_KEPT: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset a local session gets a temporary one, a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tallyloom-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read from there, until it is released or the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallyloom/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _KEPT[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._tallyloom_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete stored tables whose readers have all been stored themselves."""
    for df in tables:
        _delete(getattr(df, "_tallyloom_path", None))


def _delete(path: str | None) -> None:
    spark = _KEPT.pop(path, None)
    if spark is not None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _delete_all() -> None:
    for path in list(_KEPT):
        try:
            _delete(path)
        except Exception:  # noqa: BLE001  the session has ended before
            return


def numbered(docs: DataFrame, *columns) -> DataFrame:
    """``columns`` of ``docs`` with a row number ``rid``, written once: whoever reads it again sees the same numbers."""
    return stored(docs.select(F.monotonically_increasing_id().alias("rid"), *columns))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_column(df: DataFrame, text: str):
    """The text column as a string, null read as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))
