"""Row flags, duplicates, fill rates and reports: rows are marked and counted, never dropped."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flags(rules: Mapping[str, Column]) -> Column:
    """Names of the rules that hold, as an array; a null test does not hold."""
    return F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in rules.items())))


def record_rules(yield_="yield_percent", conversion="conversion_percent", selectivity="selectivity_percent", temperature="temperature_c", mass="PET_amount_g", catalyst="catalyst_amount_g") -> dict[str, Column]:
    """The rules of the release table: percentages in range, no more yield than conversion, plausible amounts."""
    # The flags as they are published.
    rules: dict[str, Column] = {}
    for name, c in (("yield", yield_), ("conversion", conversion), ("selectivity", selectivity)):
        rules[f"{name} above 100%"] = F.col(c) > 100
        rules[f"{name} negative"] = F.col(c) < 0
    rules["yield above conversion"] = F.col(yield_) > F.col(conversion) + 1.0
    rules["temperature above 350C -- pyrolysis, not solvolysis"] = F.col(temperature) > 350
    rules["PET mass beyond bench or pilot scale"] = F.col(mass) > 1000
    rules["more catalyst than PET"] = (F.col(mass) > 0) & (F.try_divide(F.col(catalyst), F.col(mass)) > 1)
    return rules


def report(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, n, total, share) of each rule, in one pass."""
    counts = [F.struct(F.lit(k).alias("rule"), F.count_if(v).alias("n"), F.count(F.lit(1)).alias("total")) for k, v in rules.items()]
    return df.agg(F.array(*counts).alias("a")).select(F.inline("a")).withColumn("share", F.try_divide("n", "total"))


def first_of_duplicates(df: DataFrame, keys: Sequence[str | Column], order: str, name: str = "duplicate_of") -> DataFrame:
    """The ``order`` value of the first row with equal keys (nulls equal); null for the first row itself."""
    keyed = df.withColumns({f"__key{i}": F.col(k) if isinstance(k, str) else k for i, k in enumerate(keys)})
    names = [f"__key{i}" for i in range(len(keys))]
    firsts = keyed.groupBy(*names).agg(F.min(order).alias("__first"), F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("__first", *(F.col(n).alias(f"{n}_") for n in names))
    same = [F.col(n).eqNullSafe(F.col(f"{n}_")) for n in names]
    out = keyed.join(firsts, same, "left").withColumn(name, F.when(F.col("__first") < F.col(order), F.col("__first")))
    return out.select(*(c for c in df.columns if c != name), name)


def duplicate_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """extra: rows beyond the first of their key; involved: rows of keys that occur more than once."""
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("involved"))


def fill_rates(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, field, filled): share of rows with a value, in long form."""
    wide = df.groupBy(*by).agg(*(F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns))
    return wide.unpivot(list(by), list(columns), "field", "filled")


def reach(units: DataFrame, rows: str, by: str) -> DataFrame:
    """(by, units, yielding, rows, percent): how many units have any row, by kind; units of no known kind are left out."""
    n = F.coalesce(F.col(rows), F.lit(0))
    out = units.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("units"), F.count_if(n > 0).alias("yielding"), F.sum(n).alias("rows"))
    return out.withColumn("percent", F.rint(F.try_divide(100 * F.col("yielding"), "units")))


def pass_rates(df: DataFrame, changed: Column, by: str) -> DataFrame:
    """(by, records, changed, pass_rate): percent of the records that need no change, by kind; a null test is no change."""
    out = df.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("records"), F.count_if(changed).alias("changed"))
    return out.withColumn("pass_rate", F.round(100 - F.try_divide(100 * F.col("changed"), "records"), 1))


def filled_fields(columns: Sequence[str]) -> Column:
    return sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))


def funnel(df: DataFrame, steps: Mapping[str, Column]) -> DataFrame:
    """(place, step, n): rows that pass each step and all before it."""
    passed, parts = F.lit(True), []
    for i, (name, test) in enumerate(steps.items()):
        passed = passed & F.coalesce(test, F.lit(False))
        parts.append(F.struct(F.lit(i).alias("place"), F.lit(name).alias("step"), F.count_if(passed).alias("n")))
    return df.agg(F.array(*parts).alias("a")).select(F.inline("a"))


def release_split(df: DataFrame, order: str, keys: Sequence[str], exclusions: Mapping[str, Column], rules: Mapping[str, Column]) -> DataFrame:
    """All rows with excluded_because (first that holds, or null) and, for those included, duplicate_of and quality_flags."""
    reason = F.coalesce(*(F.when(v, F.lit(k)) for k, v in exclusions.items()), F.lit(None).cast("string"))
    out = df.withColumn("excluded_because", reason)
    kept = F.col("excluded_because").isNull()
    out = first_of_duplicates(out, [*keys, kept], order)
    return out.withColumns({"duplicate_of": F.when(kept, F.col("duplicate_of")), "quality_flags": F.when(kept, F.array_join(flags(rules), "; "))})


def screened(df: DataFrame, rules: Mapping[str, Column], passed: str = "keep") -> DataFrame:
    """``df`` with ``keep`` and ``reason``: the first rule, in order, that holds turns a row away; the others have the reason ``passed``."""
    reason = F.coalesce(*(F.when(test, F.lit(name)) for name, test in rules.items()), F.lit(passed))
    return df.withColumn("reason", reason).withColumn("keep", F.coalesce(*(F.when(test, F.lit(False)) for test in rules.values()), F.lit(True)))


def mechanical(df: DataFrame, key: Sequence[str], outcomes: Sequence[str], needed: Sequence[str], absurd: Mapping[str, float], part: str, whole: str, hot: str, time: str, most: float = 350.0, longest: float = 10_080.0) -> DataFrame:
    """(check, n, total) of what is wrong on its face: repeated rows, no outcome, too little to model, shares over 100, yields
    above conversions (the first two outcomes), absurd amounts, more of ``part`` than of ``whole``, temperatures over ``most``,
    times of zero or less or over ``longest``.  ``checks.modelable`` and ``checks.evidence`` have the papers and the rows."""
    per = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    known = lambda cs: F.greatest(*(F.col(c).isNotNull().cast("int") for c in cs)) if len(cs) > 1 else F.col(cs[0]).isNotNull().cast("int")
    any_of = lambda tests: F.greatest(*(F.coalesce(t.cast("int"), F.lit(0)) for t in tests), F.lit(0)) == 1
    share = F.when(F.col(whole) > 0, F.try_divide(F.col(part), F.col(whole)))
    tests = {
        "no outcome": (known(outcomes) == 0, F.lit(True)),
        "incomplete": (any_of([F.col(c).isNull() for c in needed]), F.lit(True)),
        "above 100%": (any_of([F.col(c) > 100 for c in outcomes]), F.lit(True)),
        "yield above conversion": (F.col(outcomes[0]) > F.col(outcomes[1]) + 1.0, F.col(outcomes[0]).isNotNull() & F.col(outcomes[1]).isNotNull()),
        "absurd amounts": (any_of([F.col(c) > v for c, v in absurd.items()]), F.lit(True)),
        "part outweighs whole": (share > 1, share.isNotNull()),
        "too hot": (F.col(hot) > most, F.col(hot).isNotNull()),
        "no time or over a week": ((F.col(time) <= 0) | (F.col(time) > longest), F.col(time).isNotNull()),
    }
    cells = [F.struct(F.lit(k).alias("check"), F.count_if(t).alias("n"), F.count_if(of).alias("total")) for k, (t, of) in tests.items()]
    twice = per.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return df.agg(F.array(*cells).alias("a")).select(F.inline("a")).unionByName(twice.select(F.lit("repeated").alias("check"), "n", "total"))


def built(df: DataFrame, phase: Column, keep: Sequence[str], part: str, whole: str, several: Column, structures: Sequence[str], basis: DataFrame, on: str) -> DataFrame:
    """The rows of a release: those of the phases in ``keep``, with loading (rounded to four places; null for a whole of zero),
    the ``basis`` of their document (blank is null), single_component, and the structure blanked where a cell names several."""
    out = df.withColumn("phase", phase).filter(F.col("phase").isin(*keep))
    out = out.withColumns({"loading": F.round(F.try_divide(F.col(part), F.nullif(F.col(whole), F.lit(0.0))), 4), "single_component": ~F.coalesce(several, F.lit(False))})
    out = out.withColumns({c: F.when(F.col("single_component"), F.col(c)) for c in structures})
    extra = [c for c in basis.columns if c != on]
    return out.join(basis.select(on, *(F.nullif(F.col(c), F.lit("")).alias(c) for c in extra)), on, "left")
