"""The audit of an extraction as one plan: score, fix, split, and count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.rules import SOLVENT_ALIASES, aliased, normalised
from ..operators import match, quality, review


def scored(curated: DataFrame, records: DataFrame) -> DataFrame:
    """Labels of the records against the key, solvents compared by their canonical names without spaces and hyphens."""
    same = lambda df: df.withColumn("solvent", normalised(aliased(F.col("solvent"), SOLVENT_ALIASES)))
    return match.evaluate(same(curated), same(records), "doi", "index", "catalyst", [f for f in S.SCORED if f in S.NUMBER_FIELDS], ["solvent"])


def corrected(records: DataFrame, verdict_rows: DataFrame, fix_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records without dropped ones and with fixes applied, changelog)."""
    dropped = verdict_rows.filter(F.coalesce("drop_record", F.lit(False))).select("doi", "index")
    kinds = {f: "string" for f in S.TEXT_FIELDS} | {f: "double" for f in S.NUMBER_FIELDS}
    kept = records.join(dropped, ["doi", "index"], "left_anti")
    return review.apply_fixes(kept, fix_rows, ["doi", "index"], kinds, S.NUMBER_FIELDS)


def released(records: DataFrame, order: str) -> DataFrame:
    """Records with duplicates of the scored fields and quality flags marked."""
    return quality.release_split(records, order, ["doi", *S.SCORED], {"no outcome": F.col("yield_percent").isNull() & F.col("conversion_percent").isNull()}, quality.record_rules())
