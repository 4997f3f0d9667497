"""Resolving names against a curated table: lookup, refusal, a second kind, mixtures; and how well a name is supported."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import bare_name


# Names that say that nothing was used or reported, what joins the parts of a mixture, and why there is no value.
NOTHING = {"none": "no catalyst was used", "n/a": "not reported", "na": "not reported", "-": "not reported"}
MIXTURE = r"\s*(?:/|:|\+|,|\band\b|\bwith\b)\s*"
UNKNOWN_PART, UNKNOWN_NAME = "unknown: mixture with an unrecognised component", "unknown: name not in the lookup"


def resolved(df: DataFrame, name: str, kind: Column, table: DataFrame, separator: str = MIXTURE, fallback: tuple[str, str, str] | None = None, nothing: Mapping[str, str] = NOTHING) -> DataFrame:
    """``df`` with ``value`` and ``origin`` of each name, resolved once for each distinct (kind, name).

    ``table`` (kind, name, value, note): a null or blank value is a refusal with its note.  In this order: no name ("not
    reported"), a word for nothing or a refusal ("unmappable: note"), the kind's entry ("lookup"), the entry of another kind
    (``fallback``: the kind that may, the kind it falls back to, what it is then called), a mixture all of whose parts between
    ``separator`` have entries (values joined by points, sorted); else ``UNKNOWN_PART`` for a mixture, ``UNKNOWN_NAME`` for a name.
    """
    t = table.select(F.col("kind").alias("__k"), bare_name(F.col("name")).alias("__n"), F.nullif(F.trim(F.col("value")), F.lit("")).alias("__v"), F.coalesce("note", F.lit("ambiguous")).alias("__note"))
    t = t.groupBy("__k", "__n").agg(F.min("__v").alias("__v"), F.min(F.when(F.col("__v").isNull(), F.col("__note"))).alias("__refused"))
    key = bare_name(F.col(name))
    said = F.create_map(*(F.lit(x) for kv in nothing.items() for x in kv)) if nothing else F.create_map().cast("map<string,string>")
    names = df.select(kind.alias("__kind"), F.col(name).alias("__name"), key.alias("__key")).distinct()
    own = t.select(F.col("__k").alias("__kind"), F.col("__n").alias("__key"), F.col("__v").alias("__own"), "__refused")
    out = names.join(own, ["__kind", "__key"], "left")
    if fallback:
        second = t.filter(F.col("__k") == fallback[1]).select(F.col("__n").alias("__key"), F.when(F.col("__v").isNotNull(), F.col("__v")).alias("__other"))
        out = out.join(second, "__key", "left").withColumn("__other", F.when(F.col("__kind") == fallback[0], F.col("__other")))
    else:
        out = out.withColumn("__other", F.lit(None).cast("string"))
    parts = names.select("__kind", "__key").distinct().select("__kind", "__key", F.posexplode(F.filter(F.split("__key", separator), lambda p: p != "")).alias("__at", "__part"))
    found = parts.join(t.select(F.col("__k").alias("__kind"), F.col("__n").alias("__part"), "__v"), ["__kind", "__part"], "left")
    mixed = found.groupBy("__kind", "__key").agg(F.count(F.lit(1)).alias("__parts"), F.count("__v").alias("__found"), F.array_join(F.sort_array(F.collect_list("__v")), ".").alias("__mixture"))
    out = out.join(mixed, ["__kind", "__key"], "left")
    whole = (F.col("__parts") > 1) & (F.col("__parts") == F.col("__found"))
    empty = F.col("__name").isNull() | (F.trim(F.col("__name")) == "")
    void = F.try_element_at(said, F.col("__key"))
    origin = F.when(empty, "not reported").when(void.isNotNull(), F.concat(F.lit("unmappable: "), void)).when(F.col("__refused").isNotNull(), F.concat(F.lit("unmappable: "), F.col("__refused"))).when(F.col("__own").isNotNull(), "lookup")
    origin = origin.when(F.col("__other").isNotNull(), fallback[2] if fallback else "").when(whole, "mixture").when(F.col("__parts") > 1, UNKNOWN_PART).otherwise(UNKNOWN_NAME)
    value = F.when(empty | void.isNotNull() | F.col("__refused").isNotNull(), None).otherwise(F.coalesce("__own", "__other", F.when(whole, F.col("__mixture"))))
    done = out.select("__kind", "__name", value.alias("value"), origin.alias("origin"))
    return df.withColumn("__kind_", kind).join(done, F.col("__kind_").eqNullSafe(F.col("__kind")) & F.col(name).eqNullSafe(F.col("__name")), "left").drop("__kind", "__name", "__kind_")


def tolerant_join(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``df`` with the columns of ``table`` (one row a key) found by the key as written, else by the key in lower case."""
    extra = [c for c in table.columns if c != key]
    at = lambda k, row: table.select(F.col(key).alias(k), F.struct(*extra).alias(row))
    out = df.join(at("__key", "__row"), F.col(key) == F.col("__key"), "left").drop("__key")
    out = out.withColumn("__folded", F.when(F.col("__row").isNull(), F.lower(key)))
    out = out.join(at("__low", "__second"), F.col("__folded") == F.col("__low"), "left")
    found = F.coalesce("__row", "__second")
    return out.select(*(F.col(c) for c in df.columns), *(found[c].alias(c) for c in extra))


def mappability(name: Column, nothing: list[str], material: str) -> Column:
    """"nothing to map", "no structure" where the pattern finds a material or preparation, else "not yet mapped"."""
    text = F.trim(F.coalesce(name.cast("string"), F.lit("")))
    return F.when((text == "") | F.lower(text).isin(*nothing), "nothing to map").when(text.rlike(material), "no structure").otherwise("not yet mapped")


# Spelling that only stands in the way of a nomenclature.
PLAINER = (
    (r"(?i)\bsulph", "sulf"), (r"(?i)\baluminium\b", "aluminum"), (r"(?i)\bcaesium\b", "cesium"), (r"(?i)\bglycerine\b", "glycerol"),
    (r"(?i)\b(?:distilled|deionised|deionized|demineralized|di|ultrapure)\s+water\b", "water"),
)


def cleaned(name: Column) -> Column:
    """The bare name in the spelling that a nomenclature reads; which substance is meant does not change."""
    text = bare_name(name)
    for pattern, plain in PLAINER:
        text = F.regexp_replace(text, pattern, plain)
    return F.trim(text)


def tier(origin: Column, value: Column, derived: Column, mappable: Column) -> Column:
    """How well a value is supported: "confirmed" by a derivation of its own (also one that writes it differently), "LLM written"
    by the table alone, "no catalyst" where the paper reports that none was used, "not reported" for other refusals and
    blanks, "impossible" for what has no single structure, else "unclear"."""
    return (
        F.when(origin.startswith("not reported"), "not reported").when(origin.startswith("unmappable") & origin.contains("no catalyst"), "no catalyst").when(origin.startswith("unmappable"), "not reported")
        .when(derived.isNotNull(), "confirmed").when(value.isNotNull(), "LLM written").when(mappable == "no structure", "impossible").otherwise("unclear")
    )
