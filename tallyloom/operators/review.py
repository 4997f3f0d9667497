"""Corrections, review samples, several annotators' answers, and citations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import seeded_order
from ..functions.rules import canonical_field, coerced_number


def apply_fixes(records: DataFrame, fixes: DataFrame, on: Sequence[str], fields: Mapping[str, str], numeric: Sequence[str], aliases: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(corrected records, changelog).

    ``fixes``: the keys, ``place`` (order), ``field``, ``value`` (text).  Names are resolved through ``fields`` and
    ``aliases``, the last fix of a field wins, numbers are read out of text, unknown fields are ignored, and only
    values that differ (nulls compared) are logged.  ``fields`` maps stored names to their types.
    """
    names = {f: f for f in fields} | dict(aliases or {})
    known = fixes.withColumn("field", canonical_field(F.col("field"), names)).filter(F.col("field").isNotNull())
    last = known.groupBy(*on, "field").agg(F.max_by(F.struct("value"), "place")["value"].alias("value"))
    wide = last.groupBy(*on).pivot("field", list(fields)).agg(F.first(F.struct("value")))
    joined = records.join(wide.select(*on, *(F.col(f).alias(f"__fix_{f}") for f in fields)), list(on), "left")
    new, log = {}, []
    for f, kind in fields.items():
        fix = F.col(f"__fix_{f}")
        value = coerced_number(fix["value"]) if f in numeric else fix["value"]
        new[f"__new_{f}"] = F.when(fix.isNull(), F.col(f)).otherwise(value.cast(kind))
        log.append(F.when(~F.col(f).eqNullSafe(F.col(f"__new_{f}")), F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("was"), F.col(f"__new_{f}").cast("string").alias("to"))))
    done = joined.withColumns(new)
    changes = done.select(*on, F.explode(F.array_compact(F.array(*log))).alias("c")).select(*on, "c.*")
    return done.select(*(F.col(f"__new_{c}").alias(c) if c in fields else c for c in records.columns)), changes


def applied_verdicts(records: DataFrame, verdicts: DataFrame, on: Sequence[str], fields: Mapping[str, str], numeric: Sequence[str], aliases: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, changelog) after a judge: rows that it drops go, rows that it fixes are corrected, rows without a parsed verdict stay.

    ``verdicts`` (on, parsed_ok, drop_record, critique, fixes: array of (field, value, evidence)), one a record.  A record's
    fixes are taken in order: names are resolved through ``fields`` and ``aliases``, unknown ones are ignored, numbers are read
    out of text, and a fix counts as a change where it differs from what stands there by then (nulls compared).  The
    changelog has (on, action, critique, changes): "dropped", or "repaired" with field, was, to and evidence of each change in
    the order of the fields.  Everything happens inside one row, so one join is all that is shuffled.
    """
    names = {f: f for f in fields} | dict(aliases or {})
    v = F.struct("parsed_ok", "drop_record", "critique", "fixes").alias("__v")
    out = records.join(verdicts.select(*on, v), list(on), "left")
    ok = F.coalesce(F.col("__v.parsed_ok"), F.lit(False))
    fixes = F.when(ok, F.coalesce(F.col("__v.fixes"), F.array().cast(verdicts.schema["fixes"].dataType)))
    out = out.withColumns({"__drop": ok & F.coalesce(F.col("__v.drop_record"), F.lit(False)), "__fixes": fixes})
    for f, kind in fields.items():
        value = (lambda x: coerced_number(x).cast("double")) if f in numeric else (lambda x: x)
        stored = F.col(f).cast("double") if f in numeric else F.col(f).cast("string")
        mine = F.filter("__fixes", _of_field(names, f))
        steps = F.concat(F.array(F.struct(stored.alias("value"), F.lit(None).cast("string").alias("evidence"))), F.coalesce(F.transform(mine, _step(value)), F.array()))
        out = out.withColumn(f"__s_{f}", steps)
    changes = F.concat(*(_changes(f) for f in fields))
    out = out.withColumn("__changes", changes)
    kept = out.filter(~F.col("__drop"))
    new = {f: F.when(F.size(f"__s_{f}") > 1, F.element_at(f"__s_{f}", -1)["value"].cast(kind)).otherwise(F.col(f)) for f, kind in fields.items()}
    log = out.filter(F.col("__drop") | (F.size("__changes") > 0)).select(*on, F.when(F.col("__drop"), "dropped").otherwise("repaired").alias("action"), F.coalesce("__v.critique", F.lit("")).alias("critique"), F.when(F.col("__drop"), F.array().cast(out.schema["__changes"].dataType)).otherwise(F.col("__changes")).alias("changes"))
    return kept.select(*(new[c].alias(c) if c in new else F.col(c) for c in records.columns)), log


def _of_field(names: Mapping[str, str], field: str):
    return lambda x: canonical_field(x["field"], names) == F.lit(field)


def _step(value):
    return lambda x: F.struct(value(x["value"]).alias("value"), x["evidence"].alias("evidence"))


def _changes(field: str) -> Column:
    """The steps of a field that differ from the one before."""
    steps = F.col(f"__s_{field}")
    text = lambda x: x.cast("string")
    every = F.transform(F.slice(steps, 2, F.greatest(F.size(steps) - 1, F.lit(0))), lambda x, i: F.struct(F.lit(field).alias("field"), text(F.get(steps, i)["value"]).alias("was"), text(x["value"]).alias("to"), x["evidence"].alias("evidence")))
    return F.filter(every, lambda c: ~c["was"].eqNullSafe(c["to"]))


def changed_cells(before: DataFrame, after: DataFrame, on: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(field, n): cells that differ between two versions, nulls compared."""
    both = before.select(*on, *(F.col(f).alias(f"b_{f}") for f in fields)).join(after.select(*on, *(F.col(f).alias(f"a_{f}") for f in fields)), list(on))
    return both.agg(F.array(*(F.struct(F.lit(f).alias("field"), F.count_if(~F.col(f"b_{f}").eqNullSafe(F.col(f"a_{f}"))).alias("n")) for f in fields)).alias("x")).select(F.inline("x"))


def stratified_sample(df: DataFrame, stratum: str, key: Sequence[str], n: int, seed: int) -> DataFrame:
    """``n`` rows of each stratum in hash order, with ``weight`` = rows of the stratum / rows drawn; a small stratum is a census.

    The window keeps n rows a task before it shuffles, so a large stratum costs no more than a small one.
    """
    order = seeded_order(seed, *(F.col(k) for k in key))
    drawn = df.withColumn("__order", order).withColumn("__place", F.row_number().over(Window.partitionBy(stratum).orderBy("__order", *key))).filter(F.col("__place") <= n)
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("__all"))
    return drawn.join(F.broadcast(sizes), stratum).withColumn("weight", F.col("__all") / F.least(F.col("__all"), F.lit(n))).drop("__order", "__place", "__all")


def quotas(sizes: DataFrame, field: str, n: str, size: int) -> DataFrame:
    """(field, quota): ``size`` shared equally over fields of ``n`` rows; what a field cannot use goes to the others, and what
    does not divide evenly goes one each to the largest (ties to the smaller name).

    The shares are a water level, found by windows over one row a field: the smallest fields are full, and the first that
    is not sets the level.
    """
    everything = Window.partitionBy()
    by_size = Window.orderBy(n, field)
    before = by_size.rowsBetween(Window.unboundedPreceding, -1)
    rows = sizes.select(field, F.col(n).cast("long").alias("n")).withColumns({"full": F.coalesce(F.sum("n").over(before), F.lit(0)), "open": F.count(F.lit(1)).over(everything) - F.row_number().over(by_size) + 1})
    rows = rows.withColumn("level", F.floor((F.lit(size) - F.col("full")) / F.col("open")))
    rows = rows.withColumn("level", F.min(F.when(F.col("level") < F.col("n"), F.struct("n", F.col(field), "level"))).over(everything)["level"])
    taken = F.coalesce(F.least("n", "level"), F.col("n"))
    rest = F.lit(size) - F.sum(taken).over(everything)
    place = F.row_number().over(Window.orderBy(F.desc("n"), field))
    return rows.select(field, (taken + F.coalesce((place <= rest) & (F.col("n") > F.col("level")), F.lit(False)).cast("long")).alias("quota"))


def equal_shares(df: DataFrame, field: str, key: Sequence[str], size: int, seed: int, filled: str | None = None) -> DataFrame:
    """``size`` rows (all, if there are fewer) with equal shares of each field's pool; see ``quotas``.

    Inside a field the fullest records come first, then hash order.  A task keeps ``size`` rows of a field before it
    shuffles, and nothing is gathered.
    """
    order = [F.desc(filled)] if filled else []
    place = F.row_number().over(Window.partitionBy(field).orderBy(*order, seeded_order(seed, *(F.col(k) for k in key)), *key))
    drawn = df.withColumn("__place", place).filter(F.col("__place") <= size)
    most = quotas(df.groupBy(field).agg(F.count(F.lit(1)).alias("n")), field, "n", size).withColumnRenamed(field, "__field")
    return drawn.join(most, F.col(field).eqNullSafe(F.col("__field"))).filter(F.col("__place") <= F.col("quota")).drop("__place", "__field", "quota")


def settled_answers(answers: DataFrame, key: Sequence[str], who: str, answer: str, active: str) -> DataFrame:
    """(key, answer, conflict, deciders): active answers beat carried-over ones; if those left differ, null and conflict."""
    best = answers.groupBy(*key).agg(F.max(F.col(active).cast("int")).alias("__best"))
    kept = answers.join(best, list(key)).filter(F.col(active).cast("int") == F.col("__best"))
    out = kept.groupBy(*key).agg(F.countDistinct(answer).alias("__n"), F.min(answer).alias("__a"), F.array_sort(F.collect_set(who)).alias("deciders"))
    return out.select(*key, F.when(F.col("__n") == 1, F.col("__a")).alias(answer), (F.col("__n") > 1).alias("conflict"), "deciders")


def annotator_overlap(first: DataFrame, second: DataFrame, key: Sequence[str], answer: str, carried: str) -> DataFrame:
    """(total, shared, carried_by_both, independent, agreement) of two annotators' decisions, one a key: a decision carried
    over by neither is independent; ``agreement`` is the share of shared keys with equal answers (nulls equal), null if none."""
    side = lambda df, s: df.select(*key, F.struct(F.col(answer).alias("answer"), F.coalesce(F.col(carried), F.lit(False)).alias("carried")).alias(s))
    a, b = F.col("__a"), F.col("__b")
    both = side(first, "__a").join(side(second, "__b"), list(key), "full_outer")
    shared = a.isNotNull() & b.isNotNull()
    out = both.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(shared).alias("shared"), F.count_if(shared & a["carried"] & b["carried"]).alias("carried_by_both"),
        F.count_if(shared & ~a["carried"] & ~b["carried"]).alias("independent"), F.count_if(shared & a["answer"].eqNullSafe(b["answer"])).alias("__same"),
    )
    return out.withColumn("agreement", F.try_divide("__same", "shared")).drop("__same")


def resolved_citations(cited: DataFrame, own: DataFrame, examples: DataFrame, doc: str, chunk: str) -> DataFrame:
    """``cited`` (doc, chunk) with ``found``: own, example or unknown; documents without chunks are left out.

    ``own`` has (doc, chunk), ``examples`` (chunk).
    """
    have = own.select(doc).distinct()
    mine = own.select(doc, chunk).distinct().withColumn("__own", F.lit(True))
    theirs = examples.select(chunk).distinct().withColumn("__example", F.lit(True))
    out = cited.join(have, doc, "left_semi").join(mine, [doc, chunk], "left").join(theirs, chunk, "left")
    return out.withColumn("found", F.when(F.col("__own"), "own").when(F.col("__example"), "example").otherwise("unknown")).drop("__own", "__example")


def grown_key(key: DataFrame, promoted: DataFrame, policies: Mapping[str, str]) -> DataFrame:
    """The key and, for each policy (name: SQL condition on ``promoted``), the promoted rows it takes; column ``policy``."""
    out = None
    for name, condition in policies.items():
        part = key.unionByName(promoted.filter(condition).select(key.columns)).withColumn("policy", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def rescued(key: DataFrame, candidates: DataFrame, identity: Sequence[str], digits: int = 3) -> DataFrame:
    """Candidates that the key does not hold yet, one for each identity (numbers rounded, nulls equal)."""
    kinds = dict(candidates.dtypes)
    form = lambda df: [F.coalesce((F.round(F.col(c), digits) if kinds[c] in ("double", "float") else F.col(c)).cast("string"), F.lit("\0")).alias(f"__{c}") for c in identity]
    ids = [f"__{c}" for c in identity]
    new = candidates.select("*", *form(candidates)).join(key.select(*form(key)).distinct(), ids, "left_anti")
    return new.dropDuplicates(ids).drop(*ids)


def pending(wanted: DataFrame, done: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """What is not done yet."""
    return wanted.join(done, key, "left_anti")


def seconded(runs: DataFrame, key: Sequence[str], judge: str) -> DataFrame:
    """(key, votes): how many judges name a record."""
    return runs.groupBy(*key).agg(F.countDistinct(judge).alias("votes"))


def eligible(records: DataFrame, fields: Sequence[str], least: int, rules: Sequence[Column] = ()) -> DataFrame:
    """Records worth a reviewer's screen, with ``filled``: at least ``least`` of ``fields`` known and every rule true (null is not)."""
    filled = sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0))
    out = records.withColumn("filled", filled).filter(F.col("filled") >= least)
    for rule in rules:
        out = out.filter(F.coalesce(rule, F.lit(False)))
    return out


def decided_fresh(decisions: DataFrame, annotators: DataFrame, key: Sequence[str], deciders: str, who: str, carried: str) -> DataFrame:
    """``decisions`` with ``fresh``: false where all deciders that have an answer of their own only carried it over.

    ``annotators`` (key, who, carried): each annotator's answers; a null flag was not carried over, the last of repeated
    answers cannot be told, so one that was made anew counts.
    """
    flags = annotators.groupBy(*key, who).agg(F.min(F.coalesce(F.col(carried), F.lit(False)).cast("int")).alias("__carried"))
    asked = decisions.select(*key, F.explode(F.array_distinct(deciders)).alias(who)).distinct()
    seen = asked.join(flags, [*key, who]).groupBy(*key).agg(F.min("__carried").alias("__all"))
    return decisions.join(seen, list(key), "left").withColumn("fresh", F.coalesce(F.col("__all"), F.lit(0)) == 0).drop("__all")


# What a correction asks for, and what reviewers said of it.
CORRECTION_KINDS = ("fill", "empty", "substance", "number")
OUTCOMES = ("caught", "both defensible", "rejected")


def correction_kind(field: Column, was: Column, to: Column, identity: Sequence[str]) -> Column:
    """fill a blank, empty a value, or change what it names (``identity`` fields) or a number."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit("")) == ""
    return F.when(blank(was) & ~blank(to), "fill").when(~blank(was) & blank(to), "empty").when(field.isin(*identity), "substance").otherwise("number")


def review_outcome(answers: Column) -> Column:
    """"both" among the answers wins over "judge"; everything else is a rejection; null without answers."""
    return F.when(F.coalesce(F.size(answers), F.lit(0)) < 1, None).when(F.array_contains(answers, "both"), OUTCOMES[1]).when(F.array_contains(answers, "judge"), OUTCOMES[0]).otherwise(OUTCOMES[2])


def outcome_table(rows: DataFrame, kind: str, outcome: str, outcomes: Sequence[str] = OUTCOMES) -> DataFrame:
    """(kind, one column an outcome, cases, share of the first): counts by kind.  An outcome that is not listed fails while
    running, so the columns always sum to the cases; rows without an outcome are left out."""
    known = rows.filter(F.col(outcome).isNotNull())
    counts = known.groupBy(kind).agg(*(F.count_if(F.col(outcome) == o).alias(o) for o in outcomes), F.count(F.lit(1)).alias("cases"))
    whole = sum((F.col(f"`{o}`") for o in outcomes), F.lit(0))
    checked = F.when(whole == F.col("cases"), F.col("cases")).otherwise(F.raise_error(F.lit("an outcome is not listed")).cast("long"))
    return counts.withColumn("cases", checked).withColumn("share", F.try_divide(F.col(f"`{outcomes[0]}`"), "cases"))
