"""Model calls as a Spark stage: prompts in, replies out, with an injected client; replies become typed records."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import seeded_order
from ..functions.rules import salvaged_json


def exemplars(targets: DataFrame, pool: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """(key, exemplar): ``n`` of the pool's keys for each target, never itself, in hash order.

    The first n + 1 of the pool in an order seeded by a target's bucket serve all targets of that bucket, so the
    pool is ranked 64 times and not once a target.
    """
    order = Window.partitionBy("bucket").orderBy(seeded_order(seed, F.col("bucket"), F.col("exemplar")), "exemplar")
    ranked = pool.select(F.col(key).alias("exemplar")).distinct().withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(63)))).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n + 1)
    dealt = targets.select(key).distinct().withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(64)).cast("int"))
    met = dealt.join(F.broadcast(ranked), "bucket").filter(F.col(key) != F.col("exemplar"))
    again = F.row_number().over(Window.partitionBy(key).orderBy("place"))
    return met.withColumn("place", again).filter(F.col("place") <= n).select(key, "place", "exemplar")


def called(prompts: DataFrame, key: str, prompt: str, client: Callable[[str], str], attempts: int = 5, wait: float = 1.0) -> DataFrame:
    """(key, reply, error): one call a row; a failing row is retried with growing pauses and then reported, never fatal."""
    kind = prompts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, p in zip(b[key], b[prompt]):
                reply = error = None
                for n in range(attempts):
                    try:
                        reply, error = client(p), None
                        break
                    except Exception as e:  # noqa: BLE001  whatever the client raises becomes data
                        error = f"{type(e).__name__}: {e}"
                        if n + 1 < attempts:
                            time.sleep(wait * 2**n * (0.5 + random.random() / 2))
                out.append((k, reply, error))
            yield pd.DataFrame(out, columns=[key, "reply", "error"])

    return prompts.select(key, prompt).mapInPandas(run, f"{key} {kind}, reply string, error string")


def parsed(replies: DataFrame, schema: T.StructType, reply: str = "reply") -> DataFrame:
    """``replies`` with ``parsed`` (null if the reply holds no such JSON) and ``parsed_ok``."""
    out = replies.withColumn("parsed", F.from_json(salvaged_json(F.col(reply)), schema))
    return out.withColumn("parsed_ok", F.col("parsed").isNotNull() & F.exists(F.array(*(F.col(f"parsed.{f}").isNotNull() for f in schema.names)), lambda x: x))


def completed_verdicts(records: DataFrame, verdicts: DataFrame, on: list[str]) -> DataFrame:
    """A verdict row for every record; records that the judge left out have parsed_ok false."""
    return records.select(*on).join(verdicts, on, "left").withColumn("parsed_ok", F.coalesce("parsed_ok", F.lit(False)))


def costs(runs: DataFrame, price_in: float, price_out: float) -> DataFrame:
    """Run metadata with cost_usd filled from token counts where it is missing."""
    return runs.withColumn("cost_usd", F.coalesce("cost_usd", (F.col("prompt_tokens") * price_in + F.col("completion_tokens") * price_out) / 1e6))
