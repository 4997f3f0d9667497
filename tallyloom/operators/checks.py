"""Checks of a release: what a name denotes, what was inferred from it, faults of an answer key; long tables of counts."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules
from . import scan

# What a catalyst's name gives away.
HYDRATE_IN_NAME = r"(?i)H2O|hydrate|·\s*\d|\.\s*\d\s*H2O"
WATER_IN_STRUCTURE = r"\.O\b|O\.O"
SEVERAL = r"\s/\s|\s\+\s|,\s|\sand\s"
LOADING_IN_NAME = r"\d\s*(%|wt|mol|M\b|mM\b)"
SOLID_IN_NAME = r"(?i)\bZnO\b|TiO2|Al2O3|Fe3O4|SiO2|CeO2|\bMgO\b|\bCaO\b|Sb2O3|ZrO2|Mn3O4|Co3O4|\bCuO\b|\bNiO\b|zeolit|enzym|lipase|cutinase|PETase|hydrolase"
ALKALI_BASE = r"\bna\s*oh\b|\bk\s*oh\b|\bli\s*oh\b|sodium hydroxide|potassium hydroxide|lithium hydroxide"
NOT_NAMED = ("", "none", "no catalyst", "n/a", "na", "without catalyst")
# Spellings of one solvent, abbreviations that a cascade on full names does not see, alcohols beside methanol.
SOLVENT_FAMILIES = {
    "water": r"^(water|h2o|distilled water|deionis?zed water|di water)$",
    "ethylene glycol": r"^(eg|ethylene glycol|ethyleneglycol|mono ?ethylene glycol|meg)$",
    "methanol": r"^(methanol|meoh|ch3oh)$",
}
UNSEEN = ("DEG", "H2O", "PG", "TEG", "MEG", "CH3OH", "H₂O")
ALCOHOL = r"(?i)^(?:et(?:h)?anol|EtOH|\d-?(?:butan|pentan|hexan|octan|propan)ol|isodecyl|benzyl alcohol|glycerol)"
# Why a paper gave no records, read off its title, first match wins.
EMPTY_REASONS = (
    ("enzymatic or biological", r"enzym|petase|cutinase|hydrolase|esterase|lipase|bacter|microb|biolog|biodegrad|fungal|biocatal|whole-cell|coli"),
    ("review article", r"\breview\b|recent advance|advances in|perspective|outlook|progress in|state of the art"),
    ("other route or material", r"pyrolys|incinerat|combust|gasific|composite|membrane|fib(er|re)|elastomer|resin|coating|adsorb|electrode|microplastic|migration|copolyester|nanocage"),
)
LONGEST_MINUTES = 10_080


def _long(df: DataFrame, tests: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """(check, n, total): rows that a test and its denominator hold for, in one pass; nulls do not hold."""
    cells = [F.struct(F.lit(k).alias("check"), F.count_if(test).alias("n"), F.count_if(of).alias("total")) for k, (test, of) in tests.items()]
    return df.agg(F.array(*cells).alias("a")).select(F.inline("a"))


def evidence(df: DataFrame, tests: Mapping[str, Column], order: Sequence[str], shown: Sequence[str], n: int = 5) -> DataFrame:
    """(check, place, row): the first ``n`` rows in ``order`` that each test holds for, as JSON of the columns ``shown``."""
    hits = F.array_compact(F.array(*(F.when(t, F.lit(k)) for k, t in tests.items())))
    rows = df.select(F.explode(hits).alias("check"), F.struct(*order).alias("__order"), F.to_json(F.struct(*shown)).alias("row"))
    place = F.row_number().over(Window.partitionBy("check").orderBy("__order", "row"))
    return rows.withColumn("place", place).filter(F.col("place") <= n).select("check", "place", "row")


def modelable(df: DataFrame, needed: Sequence[str], paper: str) -> DataFrame:
    """(rows, papers, total): rows with every needed field and the papers that they come from."""
    whole = F.lit(True)
    for c in needed:
        whole = whole & F.col(c).isNotNull()
    per = df.groupBy(paper).agg(F.count_if(whole).alias("n"), F.count(F.lit(1)).alias("m"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_if((F.col("n") > 0) & F.col(paper).isNotNull()).alias("papers"), F.coalesce(F.sum("m"), F.lit(0)).alias("total"))


def identity(df: DataFrame, name: str, structure: str, solvent: str, source: str, unverified: str = "LLM written", contradicts: Column | None = None) -> DataFrame:
    """(check, n, total) of what a name denotes: synonyms, structures of several names, structures that contradict the name
    (``contradicts``, where a chemistry toolkit says so), hydrates without water, several substances or a loading in one
    cell, structures that nothing verified, and solvent spellings that three families would bring together.

    Synonyms are distinct names less distinct structures; a family that does not occur counts -1, as one spelling is kept.
    """
    n, s = F.col(name), F.coalesce(F.col(structure), F.lit(""))
    tests = {
        "hydrate without water": (n.rlike(HYDRATE_IN_NAME) & ~s.rlike(WATER_IN_STRUCTURE), n.rlike(HYDRATE_IN_NAME)), "several in one cell": (n.rlike(SEVERAL), F.lit(True)),
        "loading in the name": (n.rlike(LOADING_IN_NAME), F.lit(True)), "unverified structure": (F.col(source) == unverified, F.lit(True)),
    }
    if contradicts is not None:
        tests["structure contradicts the name"] = (contradicts, F.lit(True))
    pairs = df.groupBy(name, structure).agg(F.lit(1).alias("__one"))
    per_name = pairs.filter(n.isNotNull()).groupBy(name).agg(F.lit(1).alias("__one")).agg(F.count(F.lit(1)).alias("names"))
    per_structure = pairs.filter(F.col(structure).isNotNull()).groupBy(structure).agg(F.count(name).alias("m")).agg(F.count(F.lit(1)).alias("structures"), F.count_if(F.col("m") > 1).alias("several"))
    both = per_name.crossJoin(F.broadcast(per_structure))  # one row each
    synonyms = both.select(F.inline(F.array(F.struct(F.lit("synonyms").alias("check"), (F.col("names") - F.col("structures")).alias("n"), F.col("names").alias("total")), F.struct(F.lit("structures of several names").alias("check"), F.col("several").alias("n"), F.col("structures").alias("total")))))
    spelled = df.filter(F.col(solvent).isNotNull()).groupBy(solvent).agg(F.lit(1).alias("__one"))
    text = F.lower(F.trim(F.col(solvent)))
    kept = sum((F.count_if(text.rlike(p)) - 1 for p in SOLVENT_FAMILIES.values()), F.lit(0))
    solvents = spelled.agg(F.lit("solvent spellings").alias("check"), kept.alias("n"), F.count(F.lit(1)).alias("total"))
    return _long(df, tests).unionByName(synonyms).unionByName(solvents)


def inference(df: DataFrame, name: str, solvent: str, route: Column) -> DataFrame:
    """(check, n, total) of what was read off a solvent or a name: routes missed for an abbreviation (of the rows without a
    route, which can be fewer), solvents that two rules fire on, routes the scheme has no slot for, solids among the dissolved."""
    s, other = F.col(solvent), F.coalesce(route == rules.OTHER_ROUTE, F.lit(False))
    alcohol = F.coalesce(s.rlike(ALCOHOL), F.lit(False))
    return _long(df, {
        "unseen abbreviation": (F.trim(s).isin(*UNSEEN), other), "two rules fire": (rules.rules_fired(F.lower(s), rules.SOLVENT_ROUTES) > 1, F.lit(True)),
        "no slot for the route": (alcohol | other & s.isNotNull(), F.lit(True)), "solid among the dissolved": (F.col(name).rlike(SOLID_IN_NAME), F.lit(True)),
    })


def key_faults(df: DataFrame, paper: str, name: str, fields: Sequence[str], outcomes: Sequence[str], amounts: Sequence[str], cited: str) -> DataFrame:
    """(fault, n) of a curated key: its size, rows entered twice, no outcome, outcomes outside 0 to 100 and negative amounts (by
    cell), and no chunk cited."""
    cells = lambda cs, bad: sum((F.coalesce(bad(F.col(c)).cast("int"), F.lit(0)) for c in cs), F.lit(0))
    none = F.lit(True)
    for c in outcomes:
        none = none & F.col(c).isNull()
    per = df.groupBy(paper, *fields).agg(F.count(F.lit(1)).alias("__n"), F.sum(F.when(F.coalesce(F.size(cited), F.lit(0)) < 1, 1).otherwise(0)).alias("__uncited"))
    n = F.col("__n")
    of_paper = per.groupBy(paper).agg(
        F.sum(n).alias("experiments"), F.sum(n - 1).alias("entered twice"), F.sum(F.when(none, n).otherwise(0)).alias("no outcome at all"), F.sum(n * cells(outcomes, lambda c: (c < 0) | (c > 100))).alias("percentage outside 0-100"),
        F.sum(n * cells(amounts, lambda c: c < 0)).alias("negative amount"), F.sum("__uncited").alias("citing no source chunk"),
    )
    counts = ["experiments", "entered twice", "no outcome at all", "percentage outside 0-100", "negative amount", "citing no source chunk"]
    whole = of_paper.agg(F.count(paper).alias("papers"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts))
    names = per.filter(F.col(name).isNotNull()).groupBy(name).agg(F.lit(1).alias("__one")).agg(F.count(F.lit(1)).alias("distinct names"))
    row = whole.crossJoin(F.broadcast(names))  # one row each
    return row.select(F.inline(F.array(*(F.struct(F.lit(c).alias("fault"), F.col(c).alias("n")) for c in ("papers", "distinct names", *counts)))))


def implied_error(df: DataFrame, yield_: str, conversion: str, selectivity: str) -> DataFrame:
    """(n, mean, std, min, p25, median, p75, max) of how far yields are from conversion times selectivity, where all are known."""
    error = F.abs(F.col(yield_) - F.col(conversion) * F.col(selectivity) / 100)
    rows = df.select(error.alias("e")).filter("e is not null")
    quarters = scan.percentiles(rows, "e", (0.0, 0.25, 0.5, 0.75, 1.0)).select(*(F.col(f"p{i}").alias(c) for i, c in enumerate(("min", "p25", "median", "p75", "max"))))
    out = rows.agg(F.count("e").alias("n"), F.avg("e").alias("mean"), F.stddev_samp("e").alias("std")).crossJoin(F.broadcast(quarters))  # one row each
    return out.select("n", "mean", "std", "min", "p25", "median", "p75", "max")


def reagent_bases(df: DataFrame, name: str, part: str, whole: str, scale: float = 100.0) -> DataFrame:
    """(records, named, median): records whose catalyst is an alkali base, which the reaction uses up, of those that name a
    catalyst at all, and the median of their loading; loadings on a mass of zero are left out."""
    text = F.lower(F.trim(F.coalesce(F.col(name), F.lit(""))))
    base, named = text.rlike(ALKALI_BASE), ~text.isin(*NOT_NAMED)
    counts = df.agg(F.count_if(base).alias("records"), F.count_if(named).alias("named"))
    loading = F.try_divide(F.col(part).cast("double") * scale, F.col(whole))
    known = df.filter(base).select(loading.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") != math.inf))
    return counts.crossJoin(F.broadcast(scan.percentiles(known, "v", (0.5,)).agg(F.max("p0").alias("median"))))  # one row each


def empty_reasons(papers: DataFrame, title: Column, records: Column) -> DataFrame:
    """(reason, n): why papers without records have none, read off their titles; the rest is "no extractable data"."""
    rows = papers.filter(F.coalesce(records, F.lit(0)) == 0)
    reason = rules.cascade(F.lower(F.coalesce(title, F.lit(""))), EMPTY_REASONS, "no extractable data")
    return rows.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def reproduced(recomputed: DataFrame, published: DataFrame, on: Sequence[str], numbers: Sequence[str], apart: float = 1e-9) -> DataFrame:
    """(on, ok, worst): whether every number of a published run is what recomputing it gives; a run that one side lacks is not,
    and two nulls agree."""
    a = recomputed.select(*on, F.struct(*numbers).alias("__a"))
    b = published.select(*on, F.struct(*numbers).alias("__b"))
    both = a.join(b, list(on), "full_outer")
    off = lambda c: F.when(F.col(f"__a.{c}").isNull() & F.col(f"__b.{c}").isNull(), 0.0).otherwise(F.coalesce(F.abs(F.col(f"__a.{c}") - F.col(f"__b.{c}")), F.lit(math.inf)))
    met = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    worst = F.when(met, F.greatest(*(off(c) for c in numbers)) if len(numbers) > 1 else off(numbers[0]))
    return both.select(*on, worst.alias("worst")).withColumn("ok", F.coalesce(F.col("worst") < apart, F.lit(False)))
