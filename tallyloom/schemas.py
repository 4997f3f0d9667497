"""Explicit schemas of the record bundles; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

# Field names as the files have them, here and below.
TEXT_FIELDS = ("catalyst", "solvent")
NUMBER_FIELDS = ("temperature_c", "reaction_time_min", "catalyst_amount_g", "PET_amount_g", "solvent_amount_g", "yield_percent", "selectivity_percent", "conversion_percent", "pressure_atm")
#: The fields that are scored; the pressure is not.
SCORED = TEXT_FIELDS + NUMBER_FIELDS[:-1]
RECORD = T.StructType([*(T.StructField(f, T.StringType()) for f in TEXT_FIELDS), *(T.StructField(f, T.DoubleType()) for f in NUMBER_FIELDS), T.StructField("source_chunk_ids", T.ArrayType(T.StringType()))])


def without(*names: str) -> T.StructType:
    """The record for an ablation arm."""
    return T.StructType([f for f in RECORD if f.name not in names])


_S, _D, _I, _B = T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType()


def _of(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


EXTRACTION = _of(doi=_S, records=T.ArrayType(RECORD))
FIX = _of(field=_S, value=_S, evidence=_S)
VERDICT = _of(extracted_index=_I, parsed_ok=_B, critique=_S, bad_fields=T.ArrayType(_S), verdict=_S, fixes=T.ArrayType(FIX), drop_record=_B)
VERDICTS = _of(doi=_S, verdicts=T.ArrayType(VERDICT))
RAW = _of(doi=_S, messages=T.ArrayType(_of(role=_S, content=_S)), response_content=_S)
CURATED = _of(doi=_S, title=_S, full_text=_S, extracted_experiments=T.ArrayType(_of(experiment_data=RECORD)))
RUN = _of(seed=_I, model=_S, git_commit=_S, started_at=_S, finished_at=_S, n_papers=_I, prompt_tokens=T.LongType(), completion_tokens=T.LongType(), cost_usd=_D, parse_failed_papers=_I)
CANDIDATES = _of(doi=_S, keep=_S, reason=_S, title=_S, journal=_S, queries=_S, abstract=_S)
LOOKUP = _of(kind=_S, name=_S, smiles=_S, note=_S)
DECISIONS = _of(generated=_S, sample=_of(records=_I), decisions=T.ArrayType(_of(doi=_S, extracted_index=_I, human=_S, stratum=_S, carried_over=_B, note=_S)))
FORMATS = _of(doi=_S, format=_S)
ACCESS = _of(doi=_S, is_oa=_S)
BASIS = _of(doi=_S, yield_basis=_S)
