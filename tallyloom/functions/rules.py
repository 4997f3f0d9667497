"""Names, rule tables and parsing, as column expressions.  Rules are data: (label, pattern) pairs or mappings."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of one solvent, and the routes a solvent implies, first match wins.
SOLVENT_ALIASES = {
    "eg": "ethylene glycol", "deg": "diethylene glycol", "peg": "polyethylene glycol", "bdo": "1,4-butanediol", "dpg": "dipropylene glycol",
    "npg": "neopentyl glycol", "h2o": "water", "distilled water": "water", "deionized water": "water", "deionised water": "water", "di water": "water",
    "meoh": "methanol", "etoh": "ethanol", "iproh": "isopropanol", "2-propanol": "isopropanol", "thf": "tetrahydrofuran",
    "dmso": "dimethyl sulfoxide", "dmf": "dimethylformamide",
}
SOLVENT_ROUTES = (
    ("glycolysis", r"ethylene glycol|\beg\b|glycol(?!ic)|diethylene|propylene glycol"),
    ("methanolysis", r"methanol|\bmeoh\b"),
    ("hydrolysis", r"water|aqueous|\bnaoh\b|\bkoh\b|h2so4|h3po4|acid solution|steam"),
)
OTHER_ROUTE = "other/unclear"
# Names of one substance that spelling rules do not bring together.
SAME_SUBSTANCE = {
    "1,3-dimethylimidazolium acetate": "[DMIM]Ac", "[TMG]Cl/ZnCl2": "[TMG]ZnCl3", "[C6 TMG]Cl/2ZnCl2": "[C6TMG](ZnCl3)2",
    "Cu(OAc)2-[Bmim][OAc]": "[BMIM]Cu(Ac)3", "Zn(OAc)2-[Bmim][OAc]": "[BMIM]Zn(Ac)3",
}
# The product of a route, and what a name says about itself.
ROUTE_PRODUCTS = {"glycolysis": "bhet", "methanolysis": "dmt", "hydrolysis": "tpa"}
NAME_KINDS = (("mixture of two", r"/|\+|(?i: and )"), ("supported on a carrier", "@"), ("code the paper coined", "(?i)^(?:pil|cat-|il-|des)"))
# What is stripped from a compound's name before it is looked up.
HYDRATE = r"(?i)\s*[.·‧*]\s*\d*\s*h2o\b|\s*\b(?:mono|di|tri|tetra|penta|hexa|hepta)?hydrate\b"
QUALIFIERS = r"(?i)\(.*?\)|\b\d+(?:\.\d+)?\s*(?:m|mm|wt\.?%|vol\.?%|%|v/v|w/w|mol/l)\b|\b\d+\s*:\s*\d+\b|\baqueous\b|\bsolution\b|\bsoln\b|\banhydrous\b|\bdry\b"


def normalised(name: Column) -> Column:
    """Lower case without spaces, hyphens and at signs; null is empty."""
    return F.translate(F.lower(F.trim(F.coalesce(name.cast("string"), F.lit("")))), " -@", "")


def folded(name: Column) -> Column:
    """Lower case with single spaces; null is empty."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(name.cast("string"), F.lit("")), r"\s+", " ")))


def aliased(name: Column, aliases: Mapping[str, str]) -> Column:
    """The folded name, or what ``aliases`` calls it."""
    text = folded(name)
    table = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv)) if aliases else None
    return F.coalesce(F.try_element_at(table, text), text) if aliases else text


def canonical_field(name: Column, fields: Mapping[str, str] | Iterable[str]) -> Column:
    """The field that a name or alias means, by lower case; null if none."""
    pairs = dict(fields) if isinstance(fields, Mapping) else {f: f for f in fields}
    table = F.create_map(*(F.lit(x) for k, v in pairs.items() for x in (k.lower(), v)))
    return F.try_element_at(table, F.lower(F.trim(name)))


def cascade(value: Column, rules: Iterable[tuple[str, str]], default: str | None = None) -> Column:
    """The label of the first rule whose pattern is found in the value."""
    out = None
    for label, pattern in rules:
        out = F.when(value.rlike(pattern), label) if out is None else out.when(value.rlike(pattern), label)
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def rules_fired(value: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """How many rules match: over one, the cascade's order decides."""
    return sum((F.coalesce(value.rlike(p), F.lit(False)).cast("int") for _, p in rules), F.lit(0))


def route_of(solvent: Column) -> Column:
    return cascade(aliased(solvent, SOLVENT_ALIASES), SOLVENT_ROUTES, OTHER_ROUTE)


def bare_name(name: Column) -> Column:
    """A compound's name without water of crystallisation, qualifiers and wrapping brackets."""
    text = F.regexp_replace(F.regexp_replace(F.lower(name.cast("string")), HYDRATE, " "), QUALIFIERS, " ")
    text = F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"^[ .,;:-]+|[ .,;:-]+$", "")
    return F.when(text.rlike(r"(?s)^\[[^\[]*\]$"), F.trim(F.regexp_replace(text, r"^\[|\]$", ""))).otherwise(text)


def canonical_name(name: Column) -> Column:
    """A compound's name in one spelling: solvent aliases, no square brackets or spaces, acetates written one way."""
    text = F.translate(aliased(name, SOLVENT_ALIASES), "[] ", "")
    for a, b in (("(ac)", "(oac)"), ("ac", "oac"), ("ooac", "oac")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def substance(name: Column, same: Mapping[str, str] = SAME_SUBSTANCE) -> Column:
    """``canonical_name`` folded further, so that two data sets' spellings of one substance meet; null is empty."""
    table = F.create_map(*(F.lit(x) for kv in same.items() for x in kv))
    text = F.translate(canonical_name(F.coalesce(F.try_element_at(table, F.trim(name)), name)), "()", "")
    return F.when(name.isNull(), "").otherwise(F.replace(F.replace(text, F.lit("dimim"), F.lit("dmim")), F.lit("m-o"), F.lit("o")))


def name_kind(name: Column) -> Column:
    """Whether anything could look a name up: a mixture, a supported material, a code of the paper's own, or a plain name."""
    return cascade(F.coalesce(name.cast("string"), F.lit("None")), NAME_KINDS, "plain chemical name")


def product_of(route: Column) -> Column:
    """The monomer that a route yields, in capitals; null for other routes."""
    table = F.create_map(*(F.lit(x) for kv in ROUTE_PRODUCTS.items() for x in kv))
    return F.upper(F.try_element_at(table, F.lower(F.trim(route))))


def coerced_number(value: Column) -> Column:
    """A number as it is, ``"1.5e-05"`` too; ``"190 C"`` as 190.0: digits, points and signs kept; null if that is no number."""
    text = F.trim(value.cast("string"))
    plain = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))
    return F.coalesce(plain, F.regexp_replace(text, r"[^0-9.\-]", "").try_cast("double"))


def decided(passes: Iterable[tuple[str, Column, str, str]], default: tuple[str, str, str]) -> Column:
    """struct(label, reason, decided_by) of the first pass (decided_by, test, label, reason) whose test holds."""
    made = lambda label, reason, by: F.struct(F.lit(label).alias("label"), F.lit(reason).alias("reason"), F.lit(by).alias("decided_by"))
    return F.coalesce(*(F.when(test, made(label, reason, by)) for by, test, label, reason in passes), made(*default))


def ratio(a: Column, b: Column, digits: int | None = None) -> Column:
    """a / b, null for a zero or null divisor."""
    out = F.try_divide(a.cast("double"), b.cast("double"))
    return out if digits is None else F.round(out, digits)


def file_name(key: Column) -> Column:
    return F.replace(key, F.lit("/"), F.lit("@"))


def key_of_file(name: Column) -> Column:
    return F.replace(F.regexp_replace(name, r"^.*/|\.[A-Za-z0-9]+$", ""), F.lit("@"), F.lit("/"))


def cited_ids(text: Column) -> Column:
    """Chunk ids in prose, typographic hyphens read as plain ones."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(text, "[‐-―]", "-")), F.lit(r"([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})"), F.lit(1))


def title_of(text: Column, least: int = 20, most: int = 180) -> Column:
    """The first line of more than ``least`` characters, cut at ``most``."""
    return F.substring(F.try_element_at(F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x)) > least), F.lit(1)), 1, most)


def verdict_state(parsed: Column, dropped: Column, n_fixes: Column) -> Column:
    """unjudged, drop, fixed or ok."""
    return F.when(~F.coalesce(parsed, F.lit(False)), "unjudged").when(F.coalesce(dropped, F.lit(False)), "drop").when(F.coalesce(n_fixes, F.lit(0)) > 0, "fixed").otherwise("ok")


def stratum_of(metric: Column, judge: Column) -> Column:
    """Which graders accept a record: both, metric only, judge only, neither."""
    return F.when(metric & judge, "both").when(metric, "metric only").when(judge, "judge only").otherwise("neither")


def _salvaged(text: str | None) -> str | None:
    """The JSON value in a model's reply: fences, prose around braces, // comments and trailing commas removed."""
    if not text:
        return None
    fenced = re.search(r"```(?:json)?\s*(.*?)```", text, re.S)
    body = fenced[1] if fenced else text
    for opening, closing in ("{}", "[]"):
        a, z = body.find(opening), body.rfind(closing)
        if a < 0 or z <= a:
            continue
        kept = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*', lambda m: m[1] or "", body[a : z + 1])
        kept = re.sub(r'("(?:\\.|[^"\\])*")|,(\s*[}\]])', lambda m: m[1] or m[2], kept)
        try:
            return json.dumps(json.loads(kept), sort_keys=True)
        except ValueError:
            continue
    return None


def salvaged_json(text: Column) -> Column:
    """Valid JSON text out of a model's reply, or null."""

    @F.pandas_udf("string")
    def salvage(values: pd.Series) -> pd.Series:
        return values.map(_salvaged)

    return salvage(text)
