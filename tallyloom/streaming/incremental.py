"""Work done once as files arrive: what a stage has finished is remembered by its checkpoint, not by scanning outputs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.calls import called
from ..storage import release, stored


def resume(spark: SparkSession, source: str, schema: T.StructType, step: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, kind: str = "json") -> StreamingQuery:
    """Apply ``step`` to the files of ``source`` that were not processed yet, append to ``target``, and stop."""
    read = spark.readStream.schema(schema).format(kind)
    if kind == "json":
        read = read.option("multiLine", True)
    return step(read.load(source)).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, time: str, by: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by event-time window; time stamps without a zone are read in the session's."""
    timed = events.withColumn("__time", F.col(time).cast("timestamp")).withWatermark("__time", late)
    return timed.groupBy(F.window("__time", window), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), by, "n")


def persisted_calls(spark: SparkSession, source: str, schema: T.StructType, key: str, prompt: str, client: Callable[[str], str], target: str, checkpoint: str, at_once: int = 16, files_per_batch: int = 1, **how) -> StreamingQuery:
    """Call a client once for each key in the prompt files of ``source`` and keep every reply as it lands, under ``target``.

    Files that were not processed yet are taken ``files_per_batch`` at a time, and their prompts ``at_once`` at a time: each
    such part is asked, written and committed before the next is, and a part first drops the keys that have a reply.  So
    what a lost executor or driver costs are the calls in flight, never one whose part had ended.  Calls that failed
    are written beside the replies and asked again when their key is seen again; nulls are not keys.
    """
    replies, errors = f"{target}/replies", f"{target}/errors"
    ddl = f"{key} {schema[key].dataType.simpleString()}, reply string, error string"

    def keep(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        wanted = stored(batch.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(prompt).alias(prompt)))
        parts = max(1, -(-wanted.count() // at_once))
        for part in range(parts):
            todo = wanted.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == part)
            if _exists(session, replies):
                todo = todo.join(session.read.schema(ddl).parquet(f"{replies}/*").select(key), key, "left_anti")
            asked = stored(called(todo.repartition(min(at_once, 64)), key, prompt, client, **how))
            for path, rows in ((replies, asked.filter("error is null")), (errors, asked.filter("error is not null"))):
                rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={number}-{part}-{uuid.uuid4().hex[:8]}")
            release(asked)
        release(wanted)

    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(source)
    return read.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
