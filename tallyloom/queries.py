"""The queries of the library's own operators over the relational tables, by name.  Their DuckDB twins are in ``oracle``."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import ids, penalties, rules, special
from .operators import aggregates as A
from .operators import checks, density, match, names, overlap, quality, review, runs, scan, stats
from .oracle import SQL
from .sources import markup, text

PART_RULES = (("ring", "ring"), ("fastener", "bolt|nut|screw"), ("red", "^red"), ("small", "^small|^tiny"))
SOURCE_RULES = (("main", "^src0$"), ("teens", "^src1[0-9]$"))
SEGMENTS = {"automobile": "vehicle", "machinery": "industry", "building": "industry"}


def _t(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def route_cascade_counts(spark, d):
    df = _t(spark, d, "part", "p_name").select(rules.cascade(F.col("p_name"), PART_RULES, "other").alias("label"))
    src = _t(spark, d, "documents", "source").select(rules.cascade(F.col("source"), SOURCE_RULES, "other").alias("label"))
    return A.counted(df, "label").withColumn("of", F.lit("part")).unionByName(A.counted(src, "label").withColumn("of", F.lit("document")))


def canonical_alias_counts(spark, d):
    df = _t(spark, d, "customer", "c_mktsegment", "c_nationkey").withColumn("name", rules.aliased(F.col("c_mktsegment"), SEGMENTS))
    return df.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("c_mktsegment").alias("spellings"), F.countDistinct("c_nationkey").alias("nations"))


def rules_fired_ambiguous(spark, d):
    return _t(spark, d, "part", "p_name").groupBy(rules.rules_fired(F.col("p_name"), PART_RULES).alias("fired")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("p_name").alias("names"))


def _line_rules() -> dict:
    return {"top discount": F.col("l_discount") >= 0.1, "small quantity": F.col("l_quantity") < 3, "no tax": F.col("l_tax") == 0, "cheap": F.col("l_extendedprice") / F.col("l_quantity") < 500}


def quality_flags_lineitem(spark, d):
    df = _t(spark, d, "lineitem", "l_discount", "l_quantity", "l_tax", "l_extendedprice").select(F.array_join(quality.flags(_line_rules()), "; ").alias("flags"))
    return A.counted(df, "flags")


def quality_report_lineitem(spark, d):
    return quality.report(_t(spark, d, "lineitem"), _line_rules()).withColumn("share", F.round("share", 6))


def duplicate_of_first(spark, d):
    return quality.first_of_duplicates(_t(spark, d, "documents", "doc_id", "text").withColumn("key", F.md5("text")), ["key"], "doc_id").filter("duplicate_of is not null").select("doc_id", "duplicate_of")


def duplicate_rows(spark, d):
    return quality.duplicate_counts(_t(spark, d, "events", "user_id", "event_type", "ts").withColumn("day", F.to_date("ts")), ["user_id", "event_type", "day"])


def fill_rate_by_group(spark, d):
    df = _t(spark, d, "events", "event_type", "user_id", "value", "props").withColumns({"user": F.nullif(F.col("user_id") % 7, F.lit(0)), "amount": F.when(F.col("value") > 5, F.col("value")), "k": F.get_json_object("props", "$.k")})
    return quality.fill_rates(df, ["user", "amount", "k"], ["event_type"]).withColumn("filled", F.round("filled", 6))


def within_group_spearman(spark, d):
    return stats.spearman(_t(spark, d, "lineitem", "l_suppkey", "l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice", ["l_suppkey"]).withColumn("rho", F.round("rho", 6))


def pooled_vs_within(spark, d):
    df = _t(spark, d, "lineitem", "l_suppkey", "l_quantity", "l_discount")
    pooled = stats.spearman(df, "l_quantity", "l_discount").select(F.col("n").alias("pooled_n"), F.round("rho", 6).alias("pooled"))
    within = stats.sign_summary(stats.spearman(df, "l_quantity", "l_discount", ["l_suppkey"]), "rho", 1)
    return pooled.crossJoin(within).withColumns({"median_rho": F.round("median_rho", 6), "as_expected": F.round("as_expected", 6)})


def numeric_penalty_bands(spark, d):
    o = _t(spark, d, "orders", "o_orderkey", "o_totalprice")
    sums = _t(spark, d, "lineitem", "l_orderkey", "l_extendedprice").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("lines"))
    p = o.join(sums, "o_orderkey", "left").select(penalties.numeric(F.col("o_totalprice"), F.col("lines")).alias("p"))
    return p.groupBy(F.floor(F.round(F.col("p") * 10, 6)).cast("long").alias("band")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 6).alias("mean_penalty"))


def tolerance_band_join(spark, d):
    p = _t(spark, d, "part", "p_partkey", "p_brand", "p_type", "p_size", "p_retailprice").withColumn("p_size", F.nullif(F.col("p_size"), F.lit(7)).cast("double"))
    pairs = match.tolerance_join(p, p, ["p_brand", "p_type"], ["p_size", "p_retailprice"], 0.05).filter("p_partkey_l < p_partkey_r")
    return pairs.select("p_brand", "p_type", "p_partkey_l", "p_partkey_r")


def semi_anti_resume(spark, d):
    docs, labels = _t(spark, d, "documents", "doc_id", "lang"), _t(spark, d, "labels", "doc_id")
    left = A.counted(review.pending(docs, labels, "doc_id"), "lang").withColumn("state", F.lit("pending"))
    return left.unionByName(A.counted(docs.join(labels, "doc_id", "left_semi"), "lang").withColumn("state", F.lit("done")))


def key_overlap(spark, d):
    docs, labels = _t(spark, d, "documents", "doc_id"), _t(spark, d, "labels", "doc_id").distinct()
    both = docs.withColumn("d", F.lit(1)).join(labels.withColumn("l", F.lit(1)), "doc_id", "full_outer")
    return both.agg(F.count_if(F.col("l").isNull()).alias("only_documents"), F.count_if(F.col("d").isNull()).alias("only_labels"), F.count_if((F.col("d") == 1) & (F.col("l") == 1)).alias("both"))


def agreement_kappa(spark, d):
    out = stats.agreement(_t(spark, d, "labels"), F.col("quality") == 1, F.col("toxic") == 0)
    return out.select(*(F.col(c).cast("long").alias(c) for c in ("yy", "yn", "ny", "nn")), F.round("agree", 6).alias("agree"), F.round("kappa", 6).alias("kappa"))


def weighted_prf(spark, d):
    out = stats.weighted_scores(_t(spark, d, "labels"), F.col("quality") == 1, F.col("toxic") == 0, (F.col("doc_id") % 5 + 1).cast("double"))
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


def verdict_partition(spark, d):
    e = _t(spark, d, "events", "event_type", "user_id")
    test = lambda *v: F.count_if(F.col("event_type").isin(*v))
    out = e.groupBy((F.col("user_id") % 10).alias("bucket")).agg(test("purchase", "signup").alias("accepted"), test("error").alias("rejected"), test("view", "click").alias("open"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("whole", F.col("accepted") + F.col("rejected") + F.col("open") == F.col("n"))


def explode_counter(spark, d):
    words = _t(spark, d, "documents", "text").select(F.explode(F.split(F.regexp_replace("text", "[^ a-zA-Z]", " "), " +")).alias("w")).filter("w <> ''")
    return A.counted(words, F.length("w").alias("length"))


def pareto_frontier(spark, d):
    return A.pareto(_t(spark, d, "part", "p_size", "p_retailprice"), "p_size", "p_retailprice")


def threshold_sweep(spark, d):
    o = _t(spark, d, "orders", "o_totalprice", "o_orderkey").select((F.col("o_orderkey") % 3 != 0).alias("gate"), penalties.numeric(F.col("o_totalprice"), F.lit(250000.0), 1.0).alias("penalty"))
    return match.sweep(o, (0.1, 0.2, 0.3, 0.5, 1.0)).withColumn("mean_penalty", F.round("mean_penalty", 6))


def largest_remainder(spark, d):
    return A.percentages(_t(spark, d, "part", "p_brand"), "p_brand")


def top_k_other(spark, d):
    return A.top_and_other(_t(spark, d, "part", "p_brand"), "p_brand", 8)


def binned_share_within_group(spark, d):
    li = _t(spark, d, "lineitem", "l_returnflag", "l_quantity")
    return A.shares_within(li, "l_returnflag", A.binned(F.col("l_quantity"), [0, 10, 25, 40, 60])).withColumn("share", F.round("share", 6))


def left_closed_bins(spark, d):
    li = _t(spark, d, "lineitem", "l_linestatus", "l_quantity")
    return A.shares_within(li, "l_linestatus", A.binned(F.col("l_quantity"), [0, 10, 25, 40, 60], "left")).withColumn("share", F.round("share", 6))


def crosstab_pivot(spark, d):
    return A.crosstab(_t(spark, d, "orders", "o_orderstatus", "o_orderpriority"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


def hash_stratified_sample(spark, d):
    out = review.stratified_sample(_t(spark, d, "orders", "o_orderkey", "o_orderpriority"), "o_orderpriority", ["o_orderkey"], 25, 17)
    return out.withColumn("weight", F.round("weight", 6))


def fingerprint_sample_id(spark, d):
    rows = _t(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus").select("o_custkey", ids.fingerprint(F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")).alias("fp"))
    return rows.groupBy("o_custkey").agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list("fp")), ","), 256), 1, 12).alias("sample"), F.count(F.lit(1)).alias("n"))


def chunk_sentences(spark, d):
    s = _t(spark, d, "documents", "doc_id", "text").select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("pos", "sentence"))
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("sentence")).cast("long").alias("longest"), F.sum(F.length("sentence")).cast("long").alias("chars"))


def chunk_ids(spark, d):
    name = F.concat_ws("|", F.col("item_id").cast("string"), F.substring("text", 1, 200))
    return _t(spark, d, "benchmark").select("item_id", ids.uuid5(name).alias("chunk_id"))


def chunk_documents(spark, d):
    return text.chunked(_t(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


def page_blocks(spark, d):
    return markup.blocks(_t(spark, d, "pages", "page_id", "html"), "page_id", "html")


def citation_resolution(spark, d):
    def sentences(df, key):
        return df.select(F.col(key).alias("doc"), F.explode(text.sentences(F.col("text"))).alias("chunk"))

    docs = _t(spark, d, "documents", "doc_id", "text")
    own = sentences(docs.filter("doc_id % 2 = 0"), "doc_id").withColumn("doc", F.floor(F.col("doc") / 2).cast("long"))
    cited = sentences(docs.filter("doc_id % 2 = 1"), "doc_id").withColumn("doc", F.floor(F.col("doc") / 2).cast("long"))
    examples = sentences(_t(spark, d, "benchmark"), "item_id").select("chunk")
    found = review.resolved_citations(cited, own, examples, "doc", "chunk")
    return found.groupBy("found").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc").alias("docs"))


def _fixed(spark, d):
    e = _t(spark, d, "events", "event_id", "event_type", "value", "props")
    fix = e.filter(F.col("event_id") % 3 == 0).select("event_id", F.lit(0).alias("place"), F.lit("Value").alias("field"), F.concat(F.get_json_object("props", "$.k"), F.lit(" C")).alias("value"))
    more = e.filter(F.col("event_id") % 6 == 0).select("event_id", F.lit(1).alias("place"), F.lit("kind").alias("field"), F.lit("fixed").alias("value"))
    return review.apply_fixes(e, fix.unionByName(more), ["event_id"], {"value": "double", "event_type": "string"}, ["value"], {"kind": "event_type"})


def apply_fixes_overlay(spark, d):
    out, _ = _fixed(spark, d)
    return out.select("event_id", "event_type", "value")


def fixes_changelog(spark, d):
    return A.counted(_fixed(spark, d)[1], "field")


def verdict_changelog(spark, d):
    """What a judge's verdicts on events drop and repair, change by change."""
    e = _t(spark, d, "events", "event_id", "event_type", "value", "props")
    fix = lambda field, value, why: F.struct(F.lit(field).alias("field"), value.alias("value"), F.lit(why).alias("evidence"))
    fixes = F.array(fix("VALUE ", F.concat(F.get_json_object("props", "$.k"), F.lit(" C")), "table"), fix("kind", F.lit("fixed"), "text"), fix("colour", F.lit("red"), "none"), fix("value", F.when(F.col("event_id") % 2 == 0, F.col("value").cast("string")), "figure"))
    verdicts = e.filter("event_id % 3 <> 1").select("event_id", (F.col("event_id") % 7 != 0).alias("parsed_ok"), (F.col("event_id") % 11 == 0).alias("drop_record"), F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("critique"), F.when(F.col("event_id") % 3 == 0, fixes).alias("fixes"))
    kept, log = review.applied_verdicts(e.drop("props"), verdicts, ["event_id"], {"value": "double", "event_type": "string"}, ["value"], {"kind": "event_type"})
    said = log.select("event_id", "action", "critique", F.explode_outer("changes").alias("c")).select("event_id", "action", "critique", "c.field", "c.evidence", F.when(F.col("c.field") == "value", F.round(F.col("c.to").cast("double"), 6)).alias("to"))
    left = kept.filter("event_id % 3 = 0").select("event_id", F.lit("kept").alias("action"), F.col("event_type").alias("critique"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("evidence"), F.round("value", 6).alias("to"))
    return said.unionByName(left)


def correction_outcomes(spark, d):
    """What reviewers said of corrections to orders, by what the correction asks for."""
    o = _t(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    field = F.when(F.col("o_orderkey") % 3 == 0, "name").otherwise("heat")
    kind = review.correction_kind(field, F.when(F.col("o_custkey") % 4 != 0, F.col("o_orderstatus")).otherwise(""), F.when(F.col("o_custkey") % 5 != 0, F.col("o_orderpriority")), ["name"])
    answers = F.array_compact(F.array(F.when(F.col("o_orderstatus") == "F", "judge"), F.when(F.col("o_orderpriority") < "3", "both"), F.when(F.col("o_orderkey") % 7 == 0, "neither")))
    out = review.outcome_table(o.select(kind.alias("kind"), review.review_outcome(answers).alias("outcome")), "kind", "outcome")
    return out.select("kind", F.col("caught"), F.col("`both defensible`").alias("both"), "rejected", "cases", F.round("share", 6).alias("share"))


def first_active_answer(spark, d):
    c = _t(spark, d, "conversations", "conv_id", "turn", "role", "text").select("conv_id", F.col("role").alias("who"), F.when(F.length("text") > 200, "long").otherwise("short").alias("answer"), (F.col("turn") < 2).alias("active"))
    return review.settled_answers(c, ["conv_id"], "who", "answer", "active").withColumn("deciders", F.array_join("deciders", ","))


def modal_label_group(spark, d):
    return A.modal(_t(spark, d, "part", "p_type", "p_brand"), "p_type", "p_brand")


def topk_concentration(spark, d):
    return A.concentration(_t(spark, d, "orders", "o_custkey"), "o_custkey", [1, 10, 100]).withColumn("share", F.round("share", 6))


def rolling_median(spark, d):
    return stats.rolling_median(_t(spark, d, "events", "event_id", "event_type", "ts", "value"), ["event_type"], ["ts", "event_id"], "value", 9).select("event_id", F.round("rolling_median", 6).alias("rolling_median"))


def funnel(spark, d):
    orders = _t(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderstatus")
    items = _t(spark, d, "lineitem", "l_orderkey").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("lines"))
    per = orders.join(items, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"), F.max(F.coalesce("lines", F.lit(0))).alias("lines"), F.max((F.col("o_orderstatus") == "F").cast("int")).alias("closed"))
    steps = {"customer": F.lit(True), "ordered": F.col("orders") > 0, "many orders": F.col("orders") >= 8, "closed": F.col("closed") == 1, "long order": F.col("lines") >= 8}
    return quality.funnel(_t(spark, d, "customer", "c_custkey").join(per, "c_custkey", "left"), steps)


def pairwise_votes(spark, d):
    e = _t(spark, d, "events", "user_id", "event_type")
    return A.counted(review.seconded(e.filter("event_type <> 'view'"), ["user_id"], "event_type"), "votes")


def reconciled_counts(spark, d):
    o = _t(spark, d, "orders", "o_orderstatus", "o_orderpriority")
    return A.reconciled(A.counted(o.filter("o_orderstatus = 'F'"), "o_orderpriority"), A.counted(o.filter("o_orderstatus <> 'F'"), "o_orderpriority"), "o_orderpriority")


def noise_between_groups(spark, d):
    out = stats.noise_flag(_t(spark, d, "lineitem", "l_returnflag", "l_discount"), F.col("l_returnflag") == "R", F.col("l_discount") > 0.05)
    return out.select(*(F.round(c, 6).alias(c) for c in ("p1", "p2", "difference", "se")), "n1", "n2", "noise")


def release_digest(spark, d):
    return quality.release_split(_t(spark, d, "part"), "p_partkey", ["p_name", "p_brand", "p_type"], {"unsized": F.col("p_size") > 45}, {"large": F.col("p_size") > 40, "dear": F.col("p_retailprice") > 1000}).select("p_partkey", "excluded_because", "duplicate_of", "quality_flags")


def verified_decisions(spark, d):
    o = _t(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_custkey")
    decided = o.select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, "F").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), (F.col("o_custkey") % 2).alias("answer"))
    out = match.verified_join(o, decided, ["o_orderkey"], ["o_orderstatus"])
    return out.groupBy("accepted", "answer").agg(F.count(F.lit(1)).alias("n"))


def grown_policies(spark, d):
    c = _t(spark, d, "customer", "c_custkey", "c_mktsegment", "c_acctbal")
    grown = review.grown_key(c.filter("c_acctbal > 5000"), c.filter("c_acctbal <= 5000"), {"none": "false", "some": "c_acctbal > 0", "all": "true"})
    return grown.groupBy("policy").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("c_mktsegment").alias("segments"))


def rescued_rows(spark, d):
    p = _t(spark, d, "part", "p_partkey", "p_name", "p_brand", "p_size")
    new = review.rescued(p.filter("p_partkey % 2 = 0"), p.filter("p_partkey % 2 = 1"), ["p_name", "p_brand"])
    return new.select("p_name", "p_brand")


def parity_by_field(spark, d):
    li = _t(spark, d, "lineitem", "l_quantity", "l_discount", "l_tax", "l_suppkey")
    pairs = li.select(F.col("l_quantity").alias("a_q"), (F.col("l_quantity") + F.col("l_suppkey") % 5).alias("b_q"), F.col("l_discount").alias("a_r"), F.nullif(F.col("l_tax"), F.lit(0.0)).alias("b_r"))
    return runs.parity(pairs, ["q", "r"], "a_", "b_").withColumn("close_share", F.round("close_share", 6))


def constraint_recall(spark, d):
    o = _t(spark, d, "orders", "o_orderkey", "o_totalprice", "o_orderpriority")
    said = o.filter("o_orderkey % 3 <> 0").select("o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", "incorrect").otherwise("correct").alias("verdict"))
    out = runs.judge_recall(o, {"dear": F.col("o_totalprice") > 400000, "odd": F.col("o_orderkey") % 2 == 1}, said, ["o_orderkey"])
    return out.withColumn("recall", F.round("recall", 6))


def run_states(spark, d):
    c, o = _t(spark, d, "customer", "c_custkey"), _t(spark, d, "orders", "o_custkey", "o_orderstatus").withColumnRenamed("o_custkey", "c_custkey")
    return A.counted(runs.states(c, o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'P'"), "c_custkey"), "state")


def extraction(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A key (lines of each order, with their part's name) and an extraction of it with known faults."""
    lines = _t(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount").join(_t(spark, d, "part", "p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount")) - 1
    key = lines.select("l_orderkey", place.cast("long").alias("index"), "p_name", "l_quantity", "l_extendedprice", "l_discount", "l_partkey", "l_suppkey")
    found = key.filter(F.col("l_suppkey") % 11 != 0).select(
        "l_orderkey", (F.col("index") * 7 % 1000).alias("index"), F.when(F.col("l_partkey") % 5 == 0, F.concat("p_name", F.lit("s"))).when(F.col("l_partkey") % 13 == 0, "unknown").otherwise(F.col("p_name")).alias("p_name"),
        F.when(F.col("l_suppkey") % 3 == 0, F.col("l_quantity") * 1.5).otherwise(F.col("l_quantity")).alias("l_quantity"), (F.col("l_extendedprice") * 1.001).alias("l_extendedprice"), F.when(F.col("l_partkey") % 4 == 0, None).otherwise(F.col("l_discount")).alias("l_discount"),
    )
    return key.drop("l_partkey", "l_suppkey"), found


def assignment_match(spark, d):
    """A label for every record of the synthetic extraction: TP, MISMATCH, FN or FP."""
    key, found = extraction(spark, d)
    return match.evaluate(key, found, "l_orderkey", "index", "p_name", ["l_quantity", "l_extendedprice", "l_discount"]).drop("wrong")


def assignment_score(spark, d):
    """Precision, recall and F1 of the synthetic extraction."""
    return match.totals(assignment_match(spark, d))


def sparse_assignment(spark, d):
    """Least-cost matchings of pairs with equal names only, connected parts apart: pairs and cost of each order."""
    key, found = extraction(spark, d)
    pairs = match.gated_pairs(key, found, "l_orderkey", "index", "p_name", ["l_quantity", "l_extendedprice", "l_discount"])
    return match.sparse_matched(pairs, "l_orderkey", split=True).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.sum("cost"), 6).alias("cost"))


def paired_rest(spark, d):
    """How many records of each order are left over after closest pairs of equal names and pair up in order."""
    key, found = extraction(spark, d)
    pairs = match.gated_pairs(key, found, "l_orderkey", "index", "p_name", ["l_quantity"])
    rest = match.paired_rest(key, found, match.sparse_matched(pairs, "l_orderkey"), "l_orderkey", "index")
    return rest.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("pairs"))


def greedy_match(spark, d):
    key, found = extraction(spark, d)
    return match.closest(key, found, "l_orderkey", "index", "p_name", ["l_quantity", "l_extendedprice", "l_discount"]).drop("wrong")


def string_ratio(spark, d):
    names = _t(spark, d, "part", "p_name", "p_type").distinct()
    both = names.select("p_type", F.col("p_name").alias("a")).join(names.select("p_type", F.col("p_name").alias("b")), "p_type").filter("a < b")
    return penalties.with_string_ratio(both.select("a", "b").distinct(), "a", "b").withColumn("ratio", F.round("ratio", 6))


def bootstrap_shift(spark, d):
    labels = _t(spark, d, "labels").filter("doc_id % 4 = 0")
    out = stats.paired_bootstrap(labels, F.col("quality") == 1, F.col("toxic") == 0, 10_000, 3)
    return out.select("n", *(stats.settled(F.col(c), 6).alias(c) for c in ("shift", "low", "high")))


def even_rolling_median(spark, d):
    return stats.rolling_median(_t(spark, d, "events", "event_id", "event_type", "ts", "value"), ["event_type"], ["ts", "event_id"], "value", 20).select("event_id", F.round("rolling_median", 6).alias("rolling_median"))


def coerced_numbers(spark, d):
    size = F.col("p_size").cast("string")
    text = F.when(F.col("p_partkey") % 5 == 0, F.concat(size, F.lit(" C"))).when(F.col("p_partkey") % 5 == 1, F.concat(size, F.lit("e-05"))).when(F.col("p_partkey") % 5 == 2, F.concat(F.lit("-"), size, F.lit(".5 g"))).when(F.col("p_partkey") % 5 == 3, "none").otherwise(F.concat(F.lit("["), size, F.lit("]")))
    return _t(spark, d, "part", "p_partkey", "p_size").select("p_partkey", rules.coerced_number(text).alias("value"), rules.bare_name(text).alias("name"))


def field_agreement(spark, d):
    li = _t(spark, d, "lineitem", "l_quantity", "l_suppkey", "l_partkey", "l_returnflag", "l_linestatus")
    pairs = li.select(F.col("l_quantity").alias("a_q"), (F.col("l_quantity") + (F.col("l_suppkey") % 3) * 0.004).alias("b_q"), F.concat(F.lit("Flag-"), "l_returnflag").alias("a_f"), F.when(F.col("l_partkey") % 7 != 0, F.concat(F.lit("flag "), F.when(F.col("l_linestatus") == "O", F.col("l_returnflag")).otherwise("x"))).alias("b_f"))
    return runs.field_agreement(pairs, ["q"], "a_", "b_", ["f"]).withColumn("agree", F.round("agree", 6))


def condition_points(spark, d):
    p = _t(spark, d, "part", "p_size", "p_retailprice", "p_partkey").select((F.col("p_size") - 25).alias("x"), F.nullif(F.col("p_retailprice") - F.col("p_partkey") % 3 * 1000, F.lit(0.0)).alias("y"))
    return runs.conditions(p, "x", "y", ["y"]).groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("y"), 6).alias("y"))


def runner_up(spark, d):
    out = runs.runner_up(_t(spark, d, "orders", "o_orderpriority", "o_totalprice", "o_orderstatus"), "o_orderpriority", "o_totalprice", F.col("o_orderstatus") == "F")
    return out.withColumn("meet", F.round("meet", 6))


def _spellings(spark, d):
    """Part names as papers spell them, and a table of structures made of the names that occur."""
    p, k = _t(spark, d, "part", "p_partkey", "p_name", "p_type"), F.col("p_partkey") % 12
    name = (
        F.when(k == 0, F.concat(F.upper("p_name"), F.lit(" dihydrate"))).when(k == 1, F.concat("p_name", F.lit(" (99%)"))).when(k == 2, F.concat("p_name", F.lit(" / hot ring"))).when(k == 3, F.concat("p_name", F.lit(" + steel")))
        .when(k == 4, F.lit("None")).when(k == 5, F.lit("N/A")).when(k == 6, F.lit("  ")).when(k == 7, F.concat(F.lit("["), "p_name", F.lit("]"))).when(k == 8, F.concat(F.lower("p_type"), F.lit(" zeolite"))).otherwise(F.col("p_name"))
    )
    names_ = p.select("p_name").distinct()
    known = F.when(F.length("p_name") % 4 != 0, F.upper(F.replace("p_name", F.lit(" "), F.lit("-"))))
    table = names_.filter("p_name not like 'blue%'").select(F.when(F.col("p_name").like("old%"), "oxide").otherwise("catalyst").alias("kind"), F.col("p_name").alias("name"), known.alias("value"), F.when(F.length("p_name") % 8 == 0, "a material").alias("note"))
    return p.select("p_partkey", name.alias("name")), table


def resolved_names(spark, d):
    """Structures, where they come from and how well they are supported, counted by spelling."""
    given, table = _spellings(spark, d)
    out = names.resolved(given, "name", F.lit("catalyst"), table, fallback=("catalyst", "oxide", "lookup: an oxide"))
    mappable = names.mappability(F.col("name"), list(names.NOTHING), "(?i)zeolite|steel")
    derived = F.when(F.col("name").like("small%"), "DERIVED")
    return A.counted(out.select("name", "value", "origin", mappable.alias("mappable"), names.tier(F.col("origin"), F.col("value"), derived, mappable).alias("tier")), "name", "value", "origin", "mappable", "tier")


def _named(spark, d):
    """Parts as records: a catalyst's name, its structure and where that comes from, and a solvent."""
    p, k = _t(spark, d, "part", "p_partkey", "p_name", "p_type", "p_size", "p_retailprice"), F.col("p_partkey") % 11
    name = F.when(k == 0, F.concat("p_name", F.lit(" hydrate"))).when(k == 1, F.concat("p_name", F.lit(" / "), "p_type")).when(k == 2, F.concat(F.lit("5 wt% "), "p_name")).when(k == 3, F.concat(F.lit("ZnO "), "p_name")).when(k == 4, "KOH").when(k == 5, F.concat(F.lit("Sodium hydroxide "), "p_type")).when(k == 6, "none").when(k != 7, F.col("p_name"))
    solvents = ("EG", "ethylene glycol", "MEG", "H2O", "water", "ethanol", "1-butanol", "water / ethylene glycol", "DEG", "CH3OH", "MeOH")
    solvent = F.when(F.col("p_size") % 13 < 11, F.element_at(F.array(*map(F.lit, solvents)), (F.col("p_size") % 13 + 1).cast("int"))).when(F.col("p_size") % 13 == 11, F.lower("p_type"))
    structure = F.when(F.col("p_partkey") % 5 != 0, F.concat(F.upper(F.substring("p_name", 1, 6)), F.when(F.col("p_partkey") % 2 == 0, ".O").otherwise("")))
    return p.select("p_partkey", name.alias("name"), structure.alias("structure"), F.when(F.col("p_partkey") % 3 == 0, "LLM written").when(F.col("p_partkey") % 3 == 1, "confirmed").alias("source"), solvent.alias("solvent"), F.col("p_size").cast("double").alias("part"), F.when(F.col("p_partkey") % 6 != 0, F.col("p_retailprice")).otherwise(0.0).alias("whole"))


def identity_checks(spark, d):
    return checks.identity(_named(spark, d), "name", "structure", "solvent", "source")


def inference_checks(spark, d):
    df = _named(spark, d)
    return checks.inference(df, "name", "solvent", rules.route_of(F.col("solvent")))


def reagent_bases(spark, d):
    return checks.reagent_bases(_named(spark, d), "name", "part", "whole").withColumn("median", F.round("median", 6))


def answer_key_faults(spark, d):
    li = _t(spark, d, "lineitem", "l_orderkey", "l_returnflag", "l_quantity", "l_discount", "l_tax").select(
        F.col("l_orderkey").alias("paper"), F.concat("l_returnflag", F.nullif(F.col("l_quantity") % 3, F.lit(0.0)).cast("int").cast("string")).alias("name"), F.when(F.col("l_quantity") > 3, F.col("l_quantity") * 2.1).alias("yield"),
        F.when(F.col("l_tax") > 0.01, F.col("l_tax") * 1300 - 20).alias("conversion"), (F.col("l_discount") - 0.01).alias("mass"), F.when(F.col("l_quantity") % 7 != 0, F.slice(F.array(F.lit("a"), F.lit("b")), F.lit(1), (F.col("l_quantity") % 3).cast("int"))).alias("cited"),
    )
    return checks.key_faults(li, "paper", "name", ["name", "yield", "conversion", "mass"], ["yield", "conversion"], ["mass", "conversion"], "cited")


def implied_error(spark, d):
    li = _t(spark, d, "lineitem", "l_quantity", "l_discount", "l_tax").select((F.col("l_quantity") * 2).alias("y"), F.nullif(F.col("l_discount"), F.lit(0.0)).alias("c"), (F.col("l_tax") * 1000).alias("s"))
    out = checks.implied_error(li, "y", "c", "s")
    return out.select("n", *(F.round(c, 6).alias(c) for c in out.columns[1:]))


def modelable_core(spark, d):
    df = _named(spark, d)
    return checks.modelable(df.withColumn("paper", F.nullif(F.col("p_partkey") % 40, F.lit(7))), ["name", "structure", "solvent"], "paper")


def check_evidence(spark, d):
    df = _named(spark, d)
    return checks.evidence(df, {"heavy": F.col("part") > 45, "base": F.lower("name").rlike(checks.ALKALI_BASE)}, ["p_partkey"], ["p_partkey", "name"], 4)


def empty_paper_reasons(spark, d):
    docs = _t(spark, d, "documents", "doc_id", "text")
    return checks.empty_reasons(docs, F.substring("text", 1, 400), F.when(F.col("doc_id") % 3 == 0, 1))


def reproduced_scores(spark, d):
    """Scores by bucket, recomputed and as published; one was published wrong and one not at all."""
    rows = _t(spark, d, "labels").withColumn("bucket", F.col("doc_id") % 6)
    scores = stats.weighted_scores(rows, F.col("quality") == 1, F.col("toxic") == 0, F.lit(1.0), ["bucket"]).select("bucket", "precision", "recall", "f1")
    counts = rows.groupBy("bucket").agg(F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("tp"), F.count_if(F.col("quality") == 1).alias("said"), F.count_if(F.col("toxic") == 0).alias("true"))
    published = counts.select("bucket", (F.col("tp") / F.col("said")).alias("precision"), (F.col("tp") / F.col("true") + F.when(F.col("bucket") == 2, 1e-6).otherwise(0.0)).alias("recall"), (2 * F.col("tp") / (F.col("said") + F.col("true"))).alias("f1")).filter("bucket <> 4")
    return checks.reproduced(scores, published, ["bucket"], ["precision", "recall", "f1"]).select("bucket", "ok")


def judge_matrix(spark, d):
    """Two judges on three extractions of the orders, of which one run has another name."""
    o = _t(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")
    labels = o.withColumn("extraction", F.explode(F.array(F.lit("x"), F.lit("y")))).select("extraction", "o_custkey", "o_orderkey", F.when((F.col("o_orderstatus") == "F") | (F.col("extraction") == "y") & (F.col("o_orderkey") % 5 == 0), "correct").otherwise("incorrect").alias("metric"), F.when(F.col("o_orderkey") % 4 == 0, "no counterpart").otherwise("accepted").alias("situation"))
    verdicts = o.withColumn("run", F.explode(F.array(*map(F.lit, ("judge_a_on_x", "judge_b_on_x", "judge_a_on_y", "judge_a_on_z", "warm up"))))).filter(F.col("o_orderkey") % 7 != F.length("run") % 7)
    verdicts = verdicts.select("run", "o_custkey", "o_orderkey", F.when((F.col("o_orderpriority") < F.lit("3")) | F.col("run").contains("_b_"), "correct").otherwise("incorrect").alias("judge"))
    out = runs.judge_matrix(labels, verdicts, ["o_custkey", "o_orderkey"])
    return out.withColumns({c: F.round(c, 6) for c in ("agreement", "agreement_evaluable")})


def phase_cascade(spark, d):
    name = F.col("p_name")
    passes = (
        ("tier", F.col("p_size") == 1, "uncatalysed", "none reported"), ("curated", name.isin("red bolt", "blue ring"), "heterogeneous", "decided by hand"),
        ("solid", name.rlike("bolt|nut"), "heterogeneous", "a solid"), ("soluble", name.rlike("ring"), "homogeneous", "dissolves"),
    )
    said = _t(spark, d, "part", "p_name", "p_size").select(rules.decided(passes, ("unknown", "no rule matched", "none")).alias("s")).select("s.*")
    return A.counted(said, "label", "reason", "decided_by")


def release_build(spark, d):
    p = _t(spark, d, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    basis = p.groupBy("p_type").agg(F.when(F.length("p_type") % 2 == 0, "").otherwise("molar").alias("basis"))
    phase = rules.cascade(F.col("p_brand"), (("homogeneous", "[13]$"), ("uncatalysed", "5$")), "heterogeneous")
    out = quality.built(p.withColumn("mass", F.when(F.col("p_partkey") % 9 == 0, 0.0).otherwise(F.col("p_retailprice"))), phase, ["homogeneous", "uncatalysed"], "p_size", "mass", F.col("p_partkey") % 4 == 0, ["p_name"], basis, "p_type")
    return out.select("p_partkey", "phase", "p_name", "loading", "single_component", "basis")


def mechanical_checks(spark, d):
    li = _t(spark, d, "lineitem", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice").select(
        "l_partkey", "l_suppkey", F.when(F.col("l_quantity") < 48, F.col("l_quantity") * 2.2).alias("yield"), F.when(F.col("l_tax") > 0.01, F.col("l_tax") * 1300).alias("conversion"),
        F.col("l_discount").alias("part"), (F.col("l_quantity") - 1).alias("whole"), (F.col("l_extendedprice") / 200).alias("heat"), F.nullif((F.col("l_quantity") - 5) * 250, F.lit(2500.0)).alias("time"),
    )
    return quality.mechanical(li, ["l_partkey", "l_suppkey"], ["yield", "conversion"], ["yield", "heat"], {"yield": 105.0, "part": 0.095}, "part", "whole", "heat", "time")


def screen_reasons(spark, d):
    rules_ = {"no text": F.coalesce(F.length("text"), F.lit(0)) == 0, "short": F.col("n_chars") < 300, "other language": F.col("lang") != "en"}
    return A.counted(quality.screened(_t(spark, d, "documents", "text", "n_chars", "lang"), rules_), "keep", "reason")


def evaluable_agreement(spark, d):
    rows = _t(spark, d, "labels").withColumn("bucket", F.col("doc_id") % 4)
    out = stats.evaluable_agreement(rows, F.col("quality") == 1, F.col("toxic") == 0, F.col("doc_id") % 3 != 0, ["bucket"])
    return out.withColumns({c: F.round(c, 6) for c in ("agreement", "agreement_evaluable")})


def annotator_overlap(spark, d):
    o = _t(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    first = o.filter("o_orderkey % 2 = 0").select("o_orderkey", F.col("o_orderstatus").alias("human"), (F.col("o_custkey") % 3 == 0).alias("carried"))
    second = o.filter("o_orderkey % 3 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "F").otherwise(F.col("o_orderstatus")).alias("human"), (F.col("o_custkey") % 2 == 0).alias("carried"))
    return review.annotator_overlap(first, second, ["o_orderkey"], "human", "carried").withColumn("agreement", F.round("agreement", 6))


def reach_by_kind(spark, d):
    n = _t(spark, d, "orders", "o_custkey").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return quality.reach(_t(spark, d, "customer", "c_custkey", "c_mktsegment").join(n, "c_custkey", "left"), "n", "c_mktsegment")


def pass_rates_by_kind(spark, d):
    return quality.pass_rates(_t(spark, d, "orders", "o_orderpriority", "o_orderstatus"), F.col("o_orderstatus") == "F", "o_orderpriority")


def case_tolerant_keys(spark, d):
    p = _t(spark, d, "part", "p_partkey", "p_type", "p_size")
    table = p.groupBy(F.lower("p_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    table = table.unionByName(table.filter("n % 2 = 0").select(F.upper("kind").alias("kind"), (-F.col("n")).alias("n")))
    given = p.select("p_partkey", F.when(F.col("p_size") % 3 == 0, F.upper("p_type")).when(F.col("p_size") % 3 == 1, F.concat("p_type", F.lit("?"))).otherwise(F.lower("p_type")).alias("kind"))
    return names.tolerant_join(given, table, "kind")


def thin_records(spark, d):
    p = _t(spark, d, "part").select("p_brand", "p_name", F.nullif(F.col("p_size") % 4, F.lit(0)).alias("size"), F.when(F.col("p_retailprice") > 950, F.col("p_retailprice")).alias("price"), F.nullif(F.col("p_partkey") % 3, F.lit(1)).alias("third"), F.nullif(F.col("p_partkey") % 5, F.lit(2)).alias("fifth"))
    return A.thin_records(p, ["p_name", "size", "price", "third", "fifth"], "p_brand", 3).withColumn("share", F.round("share", 6))


def clipped_histogram(spark, d):
    out = A.clipped_histogram(_t(spark, d, "lineitem", "l_extendedprice", "l_returnflag"), "l_extendedprice", 20, 0.9, split="l_returnflag")
    return out.withColumns({c: F.round(c, 4) for c in ("low", "high")})


def log_histogram(spark, d):
    out = A.clipped_histogram(_t(spark, d, "events", "value"), "value", 15, 0.99, log=True)
    return out.withColumns({c: F.round(c, 4) for c in ("low", "high")})


def grouped_percentiles(spark, d):
    out = scan.percentiles(_t(spark, d, "lineitem", "l_returnflag", "l_extendedprice"), "l_extendedprice", (0.0, 0.25, 0.5, 0.9, 1.0), ["l_returnflag"])
    return out.select("l_returnflag", "n", *(F.round(f"p{i}", 4).alias(f"p{i}") for i in range(5)))


def running_totals(spark, d):
    """What each customer had ordered before each order, and how much of everything came before it."""
    o = _t(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    mine = scan.running(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "cents", "before")
    return scan.running(mine, (), ["o_orderkey"], "cents", "before_all").select("o_orderkey", "before", "before_all")


def frontier_arms(spark, d):
    out = A.frontier(_t(spark, d, "lineitem", "l_suppkey", "l_extendedprice", "l_quantity"), ["l_suppkey"], "l_extendedprice", "l_quantity", 3)
    return out.withColumns({c: F.round(c, 6) for c in ("l_extendedprice", "l_quantity", "spread")})


def arm_tests(spark, d):
    """Every two return flags of each supplier, by quantity."""
    out = stats.arms_tests(_t(spark, d, "lineitem", "l_suppkey", "l_returnflag", "l_quantity"), "l_returnflag", "l_quantity", ["l_suppkey"])
    return out.select("l_suppkey", "a", "b", "dof", *(F.round(c, 6).alias(c) for c in ("difference", "t", "p", "p_corrected")))


def arm_anova(spark, d):
    out = stats.anova(_t(spark, d, "lineitem", "l_suppkey", "l_returnflag", "l_extendedprice"), "l_returnflag", "l_extendedprice", ["l_suppkey"])
    return out.select("l_suppkey", "arms", "n", F.round("f", 6).alias("f"), F.round("p", 6).alias("p"))


def grouped_signed_rank(spark, d):
    li = _t(spark, d, "lineitem", "l_suppkey", "l_quantity").select("l_suppkey", (F.col("l_quantity") - 26).alias("v"))
    out = stats.signed_rank(li, "v", ["l_suppkey"])
    return out.withColumns({c: F.round(c, 6) for c in ("w", "p")})


def proportion_intervals(spark, d):
    e = _t(spark, d, "events", "event_type", "user_id", "value").withColumn("bucket", F.col("user_id") % 10)
    out = stats.proportions(e, F.col("value") > 60, ["event_type", "bucket"])
    return out.withColumns({c: F.round(c, 6) for c in ("share", "low", "high")})


def answers_apart(spark, d):
    """McNemar's test of two answers on labels, by bucket."""
    rows = _t(spark, d, "labels").withColumn("bucket", F.col("doc_id") % 5)
    out = stats.mcnemar(rows, F.col("toxic") == 1, F.col("doc_id") % 7 == 0, F.col("quality") == 0, ["bucket"])
    return out.withColumn("p", F.round("p", 6))


def grader_table(spark, d):
    """Two graders against the labels: rows that neither flags are a sample, which stands for four rows each."""
    rows = _t(spark, d, "labels").withColumn("bucket", F.col("doc_id") % 3)
    metric, judge = F.col("toxic") == 1, F.col("doc_id") % 7 == 0
    drawn = ~metric & ~judge
    out = stats.grader_table(rows, {"metric": metric, "judge": judge}, F.col("quality") == 0, F.when(drawn, 4.0).otherwise(1.0), drawn, ["bucket"])
    return out.select("bucket", "grader", "flagged", "right", *(F.round(c, 6).alias(c) for c in out.columns[4:]))


def _overlap(spark, d):
    """Lines as two data sets' records of one run: the other side rounds, renames, leaves blanks and misses some."""
    li = _t(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount")
    li = li.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount")).alias("r")).select("l_orderkey", "l_linenumber", "r.*")  # the pair is not a key
    n = F.col("l_partkey") + F.col("l_linenumber")
    heat, mass = F.nullif(F.floor(F.col("l_quantity") / 5) * 10, F.lit(0)).cast("double"), F.when(n % 7 != 0, F.round(F.col("l_extendedprice") / 20000) * 10)
    share = F.when(n % 5 != 0, F.round(F.col("l_discount") * 50))
    return li.select(
        (F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("record"), F.col("l_suppkey").alias("paper"), F.when(n % 3 == 0, "both").when(n % 3 == 1, "ours").otherwise("theirs").alias("category"),
        F.concat(F.lit("[Zn] "), (F.col("l_partkey") % 11).cast("string")).alias("ours_name"), F.when(n % 13 != 0, F.concat(F.lit("zn"), (F.col("l_partkey") % 11).cast("string"))).alias("theirs_name"),
        heat.alias("ours_heat"), (heat * (1 + (n % 5) * 0.01)).alias("theirs_heat"), mass.alias("ours_mass"), F.when(n % 2 == 0, mass).alias("theirs_mass"), share.alias("ours_share"), F.round(F.col("l_discount") * 50).alias("theirs_share"),
    )


def gap_reasons(spark, d):
    """Why lines of ours are missing from the other side, counted by reason and paper."""
    df = _overlap(spark, d)
    names_ = (rules.canonical_name(F.col("theirs_name")), rules.canonical_name(F.col("ours_name")))
    out = overlap.gap_reasons(df, "record", "paper", "category", names_, ["heat", "mass"], ["share"], F.col("ours_name") == "[Zn] 3", F.col("paper") % 2 == 0)
    return out.groupBy("paper", "reason").agg(F.count(F.lit(1)).alias("n"), F.sum("record").alias("records"))


def equal_shares(spark, d):
    o = _t(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice").withColumn("field", F.least(F.col("o_custkey") % 40, F.lit(12)))
    o = o.withColumn("filled", (F.col("o_totalprice") > 150000).cast("int"))
    return review.equal_shares(o, "field", ["o_orderkey"], 777, 5, "filled").groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("orders"), F.sum("filled").alias("filled"))


def density_plane(spark, d):
    """The region that holds nine tenths of the lines by quantity and price, of each return flag."""
    li = _t(spark, d, "lineitem", "l_returnflag", "l_quantity", "l_extendedprice")
    out = density.plane(li, "l_quantity", "l_extendedprice", (0, 60), (0, 120000), ["l_returnflag"], 20)
    return out.select("l_returnflag", "i", "j", "n", F.round(F.col("density") * 1e6, 6).alias("density"), "inside")


def density_curve(spark, d):
    out = density.curve(_t(spark, d, "events", "event_type", "value"), "value", (0, 100), ["event_type"], 50)
    return out.withColumn("density", F.round("density", 8))


def eligible_records(spark, d):
    li = _t(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag").withColumns({"l_tax": F.nullif("l_tax", F.lit(0.0)), "l_discount": F.nullif("l_discount", F.lit(0.0)), "l_quantity": F.when(F.col("l_quantity") > 5, F.col("l_quantity"))})
    return A.counted(review.eligible(li, ["l_quantity", "l_discount", "l_tax"], 2, [F.col("l_returnflag") != "R", F.nullif(F.col("l_linenumber"), F.lit(3)) < 6]), "filled", "l_returnflag")


def decided_fresh(spark, d):
    c = _t(spark, d, "conversations", "conv_id", "turn", "role")
    answers = c.select("conv_id", F.concat("role", (F.col("turn") % 2).cast("string")).alias("who"), F.nullif(F.col("turn") % 3, F.lit(1)).alias("t")).select("conv_id", "who", (F.col("t") == 0).alias("carried"))
    decisions = c.groupBy("conv_id").agg(F.array_sort(F.collect_set(F.concat("role", (F.col("turn") % 2).cast("string")))).alias("deciders")).withColumn("deciders", F.when(F.col("conv_id") % 4 != 0, F.slice("deciders", 1, 2)))
    return review.decided_fresh(decisions, answers, ["conv_id"], "deciders", "who", "carried").select("conv_id", "fresh")


def name_kinds(spark, d):
    p = _t(spark, d, "part", "p_name", "p_type", "p_partkey")
    name = F.when(F.col("p_partkey") % 5 == 0, F.concat("p_name", F.lit(" and "), "p_type")).when(F.col("p_partkey") % 5 == 1, F.concat(F.lit("IL-"), "p_type")).when(F.col("p_partkey") % 5 == 2, F.concat("p_type", F.lit("@C"))).otherwise(F.col("p_name"))
    return A.counted(p.select(rules.name_kind(name).alias("kind"), rules.substance(F.concat(F.lit("["), "p_type", F.lit("] (Ac)"))).alias("substance")), "kind", "substance")


def exact_tests(spark, d):
    """Tests on events: arms pairwise, analysis of variance, signed ranks and a binomial with its interval; one lazy plan."""
    e = _t(spark, d, "events", "event_type", "value")
    errors = stats.proportions(e.filter(F.col("event_type").isin("error", "click")), F.col("event_type") == "error")
    row = lambda df, name, value: df.select(name.alias("name"), value.alias("value"))
    parts = [
        row(stats.arms_tests(e, "event_type", "value"), F.concat_ws(" vs ", "a", "b"), F.col("p_corrected")),
        row(stats.anova(e, "event_type", "value"), F.lit("anova"), F.col("p")),
        row(stats.signed_rank(e.select((F.col("value") - 30.0).alias("v")), "v"), F.lit("signed rank"), F.col("p")),
        row(errors, F.lit("binomial"), special.even_binomial_two_sided(F.col("hits"), F.col("n"))),
        row(errors, F.lit("jeffreys low"), F.col("low")), row(errors, F.lit("jeffreys high"), F.col("high")),
    ]
    return functools.reduce(DataFrame.unionByName, parts).withColumn("value", F.round("value", 6))


ROWS_ONLY = (assignment_match, assignment_score, greedy_match, string_ratio, page_blocks)
QUERIES = (
    route_cascade_counts, canonical_alias_counts, rules_fired_ambiguous, quality_flags_lineitem, quality_report_lineitem, duplicate_of_first, duplicate_rows,
    fill_rate_by_group, within_group_spearman, pooled_vs_within, numeric_penalty_bands, tolerance_band_join, semi_anti_resume, key_overlap, agreement_kappa,
    weighted_prf, verdict_partition, explode_counter, pareto_frontier, threshold_sweep, largest_remainder, top_k_other, binned_share_within_group,
    left_closed_bins, chunk_documents, crosstab_pivot, hash_stratified_sample, fingerprint_sample_id, chunk_sentences, chunk_ids, citation_resolution, apply_fixes_overlay,
    fixes_changelog, verdict_changelog, correction_outcomes, first_active_answer, modal_label_group, topk_concentration, rolling_median, funnel, pairwise_votes, reconciled_counts,
    noise_between_groups, release_digest, verified_decisions, grown_policies, rescued_rows, parity_by_field, constraint_recall, run_states,
    bootstrap_shift, even_rolling_median, coerced_numbers, field_agreement, condition_points, runner_up, resolved_names, phase_cascade, release_build, mechanical_checks,
    screen_reasons, thin_records, clipped_histogram, log_histogram, grouped_percentiles, running_totals, frontier_arms, arm_tests, arm_anova, grouped_signed_rank,
    proportion_intervals, answers_apart, grader_table, exact_tests, gap_reasons, sparse_assignment, paired_rest, equal_shares, density_plane, density_curve, identity_checks, inference_checks, reagent_bases, answer_key_faults, implied_error, modelable_core, check_evidence, empty_paper_reasons, reproduced_scores, judge_matrix,
    eligible_records, decided_fresh, name_kinds, evaluable_agreement, annotator_overlap, reach_by_kind, pass_rates_by_kind, case_tolerant_keys,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (*QUERIES, *ROWS_ONLY)}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: SQL[f.__name__] for f in QUERIES}
