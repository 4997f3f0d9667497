import itertools
import math
import uuid
from difflib import SequenceMatcher

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom import schemas
from tallyloom.functions import ids, penalties, rules
from tallyloom.functions import numerics as N
from tallyloom.operators import aggregates, calls, match, names, quality, review, runs, stats
from tallyloom.plans import audit, metrics
from tallyloom.sources import bundles, markup, sinks, text
from tallyloom.streaming import incremental


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10_000))
def test_assignment_is_optimal_and_no_worse_than_greedy(n, m, seed):
    cost = np.random.default_rng(seed).integers(0, 6, (n, m)).astype(float)
    total = lambda pairs: sum(cost[p] for p in pairs)
    wide = cost if n <= m else cost.T
    best = min(sum(wide[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(max(n, m)), min(n, m)))
    assert total(N.assignment(cost)) == pytest.approx(best) and len(N.assignment(cost)) == min(n, m)
    assert total(N.closest_first(cost)) >= best - 1e-9


def test_uncontested_groups_are_optimal():
    rng = np.random.default_rng(2)
    for _ in range(100):
        shapes = [tuple(map(int, rng.integers(1, 5, 2))) for _ in range(4)]
        costs = [rng.integers(0, 9, s).astype(float) for s in shapes]
        rows = [(g, a, b, costs[g][a, b]) for g, s in enumerate(shapes) for a in range(s[0]) for b in range(s[1])]
        g, i, j, c = (np.array(x) for x in zip(*rows))
        chosen, left = match.uncontested(g, i, j, c)
        for k in set(range(4)) - set(left.tolist()):
            got = [(i[x], j[x]) for x in chosen if g[x] == k]
            assert len(got) == min(shapes[k]) == len({a for a, _ in got}) == len({b for _, b in got})
            assert sum(costs[k][p] for p in got) == sum(costs[k][p] for p in N.assignment(costs[k]))


def test_tail_probabilities():
    assert N.binomial_p_value(43, 51) == pytest.approx(6.867e-07, rel=1e-3)
    assert N.beta_cdf(0.3, 2, 3) == pytest.approx(0.3483)
    assert N.t_p_value(2.0, 10) == pytest.approx(0.07339, abs=1e-5)
    assert N.f_p_value(3.0, 2, 10) == pytest.approx(0.09537, abs=1e-5)
    low, high = N.jeffreys(4, 15)
    assert N.beta_cdf(low, 4.5, 11.5) == pytest.approx(0.025) and N.beta_cdf(high, 4.5, 11.5) == pytest.approx(0.975)
    assert math.isnan(N.jeffreys(0, 0)[0])
    assert N.signed_rank_p_value(0, 9) == pytest.approx(2 / 512)


def test_penalties(spark):
    rows = [(None, None, 0.0), (None, 1.0, 1.0), (0.0, 0.0, 0.0), (1.0, 1.0099, 0.0), (100.0, 90.0, 0.5), (100.0, 10.0, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double, want double")
    for r in df.withColumn("got", penalties.numeric(F.col("a"), F.col("b"))).collect():
        assert r["got"] == pytest.approx(r["want"])
    names = spark.createDataFrame([("Zn(OAc)2", "zn(oac) 2"), ("a", None), (None, None), ("ZnCl2", "FeCl3")], "a string, b string")
    got = {(r["a"], r["b"]): r["ratio"] for r in penalties.with_string_ratio(names, "a", "b").collect()}
    assert got["Zn(OAc)2", "zn(oac) 2"] == 1.0 and got["a", None] == 0.0 and got[None, None] == 1.0
    assert got["ZnCl2", "FeCl3"] == pytest.approx(SequenceMatcher(None, "zncl2", "fecl3").ratio())


def test_matching_degenerate_sides_and_the_gate(spark):
    key = spark.createDataFrame([("a", 0, "x", 1.0), ("a", 1, "y", 2.0), ("b", 0, "x", 1.0), ("none", 0, "x", 1.0)], "doc string, index long, name string, v double")
    got = spark.createDataFrame([("a", 0, "y", 2.0), ("a", 1, "x", 1.005), ("a", 2, "x", 50.0), ("b", 0, "other", 1.0), ("c", 0, "x", 1.0)], "doc string, index long, name string, v double")
    labels = match.evaluate(key, got, "doc", "index", "name", ["v"])
    rows = {(r["doc"], r["i"], r["j"]): (r["verdict"], r["reason"]) for r in labels.collect()}
    assert rows == {("a", 0, 1): ("TP", None), ("a", 1, 0): ("TP", None), ("a", None, 2): ("FP", "no counterpart"), ("b", 0, 0): ("MISMATCH", "names differ"), ("c", None, 0): ("FP", "no counterpart")}
    score = match.totals(labels).first()
    assert (score["tp"], score["fp"], score["fn"]) == (2, 3, 1) and score["f1"] == pytest.approx(4 / 8)
    at = spark.createDataFrame([("a", 0, "x", 100.0)], key.schema)
    edge = match.evaluate(at, spark.createDataFrame([("a", 0, "x", 88.0)], key.schema), "doc", "index", "name", ["v"], accept=0.3)
    assert edge.first()["verdict"] == "MISMATCH"  # (0 + 0.6) / 2 is not below 0.3
    assert match.evaluate(key, got.limit(0), "doc", "index", "name", ["v"]).count() == 0  # nothing says that a document was read
    read = spark.createDataFrame([("a",), ("none",)], "doc string")
    empty = match.evaluate(key, got.limit(0), "doc", "index", "name", ["v"], documents=read)
    assert {(r["doc"], r["i"], r["verdict"]) for r in empty.collect()} == {("a", 0, "FN"), ("a", 1, "FN"), ("none", 0, "FN")}
    assert match.totals(empty).first()["fn"] == 3


def test_rules(spark):
    df = spark.createDataFrame([(" EG ",), ("Deionized  Water",), ("glycolic acid",), ("MeOH",), (None,), ("toluene",)], "s string")
    assert [r[0] for r in df.select(rules.route_of(F.col("s"))).collect()] == ["glycolysis", "hydrolysis", "other/unclear", "methanolysis", "other/unclear", "other/unclear"]
    v = spark.createDataFrame([("190 C",), ("-3.5",), ("none",), (None,)], "s string").select(rules.coerced_number(F.col("s"))).collect()
    assert [r[0] for r in v] == [190.0, -3.5, None, None]
    v = spark.createDataFrame([("1.5e-05",), ("2E3",), (" 7 ",), ("a-b",)], "s string").select(rules.coerced_number(F.col("s"))).collect()
    assert [r[0] for r in v] == [1.5e-05, 2000.0, 7.0, None]
    long = "[" + "x" * 12_000 + "]"
    b = spark.createDataFrame([("[ZnCl2]",), ("[a][b]",), (long,)], "s string").select(rules.bare_name(F.col("s"))).collect()
    assert [r[0] for r in b] == ["zncl2", "[a][b]", long[1:-1]]
    j = ['```json\n{"a": 1,}\n```', 'so: {"u": "http://x", "b": [1, 2,],} // done', "nothing", None, '{"a": ']
    got = [r[0] for r in spark.createDataFrame([(x,) for x in j], "s string").select(rules.salvaged_json(F.col("s"))).collect()]
    assert got == ['{"a": 1}', '{"b": [1, 2], "u": "http://x"}', None, None, None]
    assert spark.range(1).select(rules.bare_name(F.lit("ZnSO4·7H2O (dry)"))).first()[0] == "znso4"
    cited = spark.range(1).select(rules.cited_ids(F.lit("see 0123ABCD‐0000-1111-2222-0123456789ab."))).first()[0]
    assert cited == ["0123abcd-0000-1111-2222-0123456789ab"]


def test_ids(spark):
    df = spark.createDataFrame([("a|0|é",), ("",)], "s string")
    for r in df.select("s", ids.uuid5(F.col("s")).alias("u")).collect():
        assert r["u"] == str(uuid.uuid5(uuid.NAMESPACE_URL, r["s"]))
    assert ids.config_hash({"a": 1, "api_key": "x"}) == ids.config_hash({"a": 1})


def test_flags_duplicates_and_split(spark):
    rows = [("d", 0, "c", 100.0, 99.0, 20.0), ("d", 1, "c", 101.0, None, None), ("d", 2, None, 50.0, 49.0, 400.0), ("d", 3, None, 50.0, 49.0, 400.0), ("e", 4, None, None, None, None)]
    df = spark.createDataFrame(rows, "doi string, id int, catalyst string, yield_percent double, conversion_percent double, temperature_c double").withColumns({"selectivity_percent": F.lit(None).cast("double"), "PET_amount_g": F.lit(0.0), "catalyst_amount_g": F.lit(1.0)})
    got = {r["id"]: r for r in quality.release_split(df, "id", ["doi", "catalyst", "yield_percent", "temperature_c"], {"no outcome": F.col("yield_percent").isNull()}, quality.record_rules()).collect()}
    assert got[0]["quality_flags"] == "" and got[1]["quality_flags"] == "yield above 100%" and got[2]["quality_flags"] == "temperature above 350C -- pyrolysis, not solvolysis"
    assert got[3]["duplicate_of"] == 2 and got[2]["duplicate_of"] is None and got[4]["excluded_because"] == "no outcome" and got[4]["quality_flags"] is None
    n = quality.duplicate_counts(df, ["doi", "catalyst", "yield_percent"]).first()
    assert (n["extra"], n["involved"]) == (1, 2)


def test_fixes_are_idempotent_and_logged(spark):
    rec = spark.createDataFrame([("a", 0, 1.0, "x"), ("a", 1, None, None), ("b", 0, 5.0, "y")], "doi string, index int, t double, s string")
    fix = spark.createDataFrame([("a", 0, 0, "T", "190 C"), ("a", 0, 1, "temp", "200 C"), ("a", 1, 0, "s", None), ("b", 0, 0, "t", "5.0"), ("b", 0, 1, "unknown", "1")], "doi string, index int, place int, field string, value string")
    how = (["doi", "index"], {"t": "double", "s": "string"}, ["t"], {"temp": "t"})
    out, log = review.apply_fixes(rec, fix, *how)
    assert {(r["doi"], r["index"]): (r["t"], r["s"]) for r in out.collect()} == {("a", 0): (200.0, "x"), ("a", 1): (None, None), ("b", 0): (5.0, "y")}
    assert [(r["doi"], r["field"], r["was"], r["to"]) for r in log.collect()] == [("a", "t", "1.0", "200.0")]
    assert review.apply_fixes(out, fix, *how)[1].count() == 0
    assert {r["field"]: r["n"] for r in review.changed_cells(rec, out, ["doi", "index"], ["t", "s"]).collect()} == {"t": 1, "s": 0}


def test_answers_citations_and_samples(spark):
    a = spark.createDataFrame([("r1", "p", "yes", False), ("r1", "q", "no", True), ("r2", "p", "yes", True), ("r2", "q", "no", True), ("r3", "p", "yes", False), ("r3", "q", "yes", False)], "k string, who string, human string, active boolean")
    got = {r["k"]: (r["human"], r["conflict"], r["deciders"]) for r in review.settled_answers(a, ["k"], "who", "human", "active").collect()}
    assert got == {"r1": ("no", False, ["q"]), "r2": (None, True, ["p", "q"]), "r3": ("yes", False, ["p", "q"])}
    cited = spark.createDataFrame([("a", "1"), ("a", "9"), ("a", "5"), ("z", "1")], "doc string, chunk string")
    own = spark.createDataFrame([("a", "1"), ("b", "9")], "doc string, chunk string")
    assert {r["chunk"]: r["found"] for r in review.resolved_citations(cited, own, spark.createDataFrame([("5",)], "chunk string"), "doc", "chunk").collect()} == {"1": "own", "9": "unknown", "5": "example"}
    pool = spark.range(100).withColumn("s", F.when(F.col("id") < 10, "few").otherwise("many"))
    drawn = review.stratified_sample(pool, "s", ["id"], 20, 3)
    assert {r["s"]: (r["n"], r["w"]) for r in drawn.groupBy("s").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()} == {"few": (10, 10.0), "many": (20, 90.0)}
    assert {r["s"]: r["count"] for r in review.equal_shares(pool, "s", ["id"], 40, 3).groupBy("s").count().collect()} == {"few": 10, "many": 30}


def test_verified_and_one_to_one_joins(spark):
    rows = spark.createDataFrame([("a", 0, "x"), ("a", 1, None)], "doi string, index int, s string")
    dec = spark.createDataFrame([("a", 0, "y", 1), ("a", 1, None, 2), ("q", 0, "x", 3)], "doi string, index int, s string, answer int")
    assert {r["answer"]: r["accepted"] for r in match.verified_join(rows, dec, ["doi", "index"], ["s"]).collect()} == {1: False, 2: True, 3: False}
    assert match.one_to_one(rows, dec.select("doi", "index", "answer"), ["doi", "index"]).count() == 2
    with pytest.raises(Exception, match="repeated"):
        match.one_to_one(rows, dec.union(dec).select("doi", "index", "answer"), ["doi", "index"]).collect()


def test_statistics(spark):
    import pandas as pd

    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 300), "x": rng.integers(0, 20, 300).astype(float), "y": rng.integers(0, 9, 300).astype(float)})
    df = spark.createDataFrame(pdf)
    assert stats.spearman(df, "x", "y").first()["rho"] == pytest.approx(pdf["x"].rank().corr(pdf["y"].rank()), abs=1e-9)
    for r in stats.spearman(df, "x", "y", ["g"]).collect():
        part = pdf[pdf.g == r["g"]]
        assert r["rho"] == pytest.approx(part["x"].rank().corr(part["y"].rank()), abs=1e-9)
    few = spark.createDataFrame([(1, float(i), 1.0) for i in range(9)] + [(2, 1.0, 2.0)] * 4, "g int, x double, y double")
    assert stats.spearman(few, "x", "y", ["g"]).count() == 0
    k = stats.agreement(spark.createDataFrame([(True, True)] * 40 + [(True, False)] * 10 + [(False, True)] * 20 + [(False, False)] * 30, "a boolean, b boolean"), F.col("a"), F.col("b")).first()
    assert k["agree"] == pytest.approx(0.7) and k["kappa"] == pytest.approx(0.4)
    w = stats.signed_rank(spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 5, 6, 7, 8, 9)], "v double"), "v").first()
    assert w["w"] == 45 and w["p"] == pytest.approx(2 / 512)


def test_rollups(spark):
    df = spark.createDataFrame([(b,) for b, n in (("a", 230), ("b", 16), ("c", 39)) for _ in range(n)], "v string")
    shares = {r["label"]: r["percent"] for r in aggregates.percentages(df, "v").collect()}
    assert shares == {"a": 80.7, "b": 5.6, "c": 13.7}
    assert [r["label"] for r in aggregates.top_and_other(df, "v", 1).orderBy("place").collect()] == ["a", "other (2 more)"]
    points = spark.createDataFrame([(1.0, 1.0), (2.0, 0.5), (2.0, 3.0), (3.0, 3.0)], "cost double, gain double")
    assert {tuple(r) for r in aggregates.pareto(points, "cost", "gain").collect()} == {(1.0, 1.0), (2.0, 3.0)}


def test_bundles_chunks_and_audit(spark, tmp_path):
    import json

    (tmp_path / "x").mkdir()
    rec = {"catalyst": "ZnCl2", "solvent": "EG", "temperature_c": 190, "yield_percent": 80.0}
    (tmp_path / "x" / "10.1@a.json").write_text(json.dumps({"doi": "10.1/a", "records": [rec, rec | {"temperature_c": 150}], "extra": 1}))
    got = bundles.records(spark, str(tmp_path / "x"))
    assert {(r["index"], r["temperature_c"]) for r in got.collect()} == {(0, 190.0), (1, 150.0)}
    key = got.withColumn("solvent", F.lit("ethylene glycol"))
    assert {r["verdict"] for r in audit.scored(key, got).collect()} == {"TP"}
    assert audit.released(got, "index").filter("quality_flags = ''").count() == 2
    assert schemas.without("solvent").names[1] == "temperature_c"
    one, two = uuid.uuid4(), uuid.uuid4()
    texts = spark.createDataFrame([("k", f"ID: {one}\nfirst\nline\n\nID: {two}\nsecond\n")], "k string, t string")
    assert [(r["pos"], r["chunk_id"], r["text"]) for r in bundles.chunks(texts, "k", "t").collect()] == [(0, str(one), "first\nline"), (1, str(two), "second")]
    docs = spark.createDataFrame([("k", "One. Two! " + "x" * 30 + " Three?"), ("e", ""), ("n", None)], "k string, t string")
    parts = text.chunked(docs, "k", "t", 12)
    assert {r["text"] for r in parts.collect()} == {"One. Two!", "x" * 30 + " Three?"}
    page = spark.createDataFrame([(1, "<h1>T</h1><p>a <b>b</b><table><tr><th>x|y</th></tr><tr><td>1</td><td>2</td></tr></table>"), (2, None)], "k int, h string")
    assert [(r["kind"], r["text"]) for r in markup.blocks(page, "k", "h").collect()] == [("heading", "T"), ("text", "a b"), ("table", "| x\\|y |  |\n| --- | --- |\n| 1 | 2 |")]


def test_tables_keep_all_their_text(spark):
    page = lambda h: [(r["kind"], r["text"]) for r in markup.blocks(spark.createDataFrame([(1, h)], "k int, h string"), "k", "h").orderBy("pos").collect()]
    assert page("<table><caption>Cap</caption><tr><td>1</td></tr>loose<tr><td>2</td></tr></table>") == [("heading", "Cap"), ("text", "loose"), ("table", "| 1 |\n| --- |\n| 2 |")]
    assert page("<p>a</p><table><tr><td>1</td><td>2 <p>after") == [("text", "a"), ("table", "| 1 | 2 after |\n| --- | --- |")]
    assert page("<table><tr><td>1</td></tr><p>later") == [("text", "later"), ("table", "| 1 |\n| --- |")]
    assert page("<table><tr><td>x<table><tr><td>in</td></tr></table>y</td><td>z</td></tr></table>") == [("table", "| in |\n| --- |"), ("table", "| xy | z |\n| --- | --- |")]


def test_sinks_metrics_and_resume(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], None), (2, [], "x")], "id int, tags array<string>, s string")
    assert sinks.digest(df.repartition(3)).first() == sinks.digest(df.orderBy(F.desc("id"))).first()
    out = sinks.release(df, str(tmp_path / "r"), ["id", "tags"])
    assert out["rows"] == 2 and out["dropped"] == ["s"]
    with pytest.raises(ValueError):
        sinks.release(df, str(tmp_path / "r"), ["nope"])
    path = str(tmp_path / "j")
    flat = df.select("id", "s")
    sinks.append_new(flat, path, "id")
    sinks.append_new(flat.union(spark.createDataFrame([(3, "y")], "id int, s string")), path, "id")
    assert sinks.appended(spark, path, flat.schema).count() == 3
    m = [metrics.Metric("rows", ("t",), "count", lambda t: t.agg(F.count("*").alias("value")))]
    assert metrics.collected(m, {"t": df}).first()["formatted"] == "2" and metrics.lineage(m) == {"t": ("rows",)}
    src, target, mark = (str(tmp_path / x) for x in ("src", "target", "mark"))
    flat.write.parquet(src)
    for n in (2, 2):
        incremental.resume(spark, src, flat.schema, lambda s: s.withColumn("done", F.lit(True)), target, mark, "parquet").awaitTermination()
        assert spark.read.parquet(target).count() == n


def test_calls(spark):
    def client(prompt):
        if "bad" in prompt:
            raise ValueError("no")
        return '```json\n{"verdict": "' + prompt + '",}\n```'

    df = spark.createDataFrame([("a", "fine"), ("b", "bad"), ("c", None)], "k string, p string").filter("p is not null")
    from pyspark.sql import types as T

    replies = calls.called(df, "k", "p", client, attempts=2, wait=0.0)
    got = {r["k"]: (r["parsed_ok"], r["error"]) for r in calls.parsed(replies, T.StructType([T.StructField("verdict", T.StringType())])).collect()}
    assert got == {"a": (True, None), "b": (False, "ValueError: no")}
    keys = spark.createDataFrame([(f"k{i}",) for i in range(12)], "k string")
    drawn = calls.exemplars(keys, keys, "k", 3, 1).collect()
    assert len(drawn) == 36 and all(r["k"] != r["exemplar"] for r in drawn)
    done = calls.completed_verdicts(keys.withColumn("index", F.lit(0)), spark.createDataFrame([("k1", 0, True)], "k string, index int, parsed_ok boolean"), ["k", "index"])
    assert done.filter("parsed_ok").count() == 1 and done.count() == 12
    assert abs(N.power_table([1.0], [17], 1.0, 4000)[0]["power"] - 0.807) < 0.04
    low, high = N.posterior_recall(40.0, 50.0, 50, 2, 200.0)
    assert 0.5 < low < 40 / (50 + 2.5 / 51 * 200) < high < 0.8


def test_runs(spark):
    r = spark.createDataFrame([("judge_a_on_x", 1), ("judge_b_on_x", 2), ("other", 3)], "run string, n int")
    assert {(x["judge"], x["extraction"]) for x in runs.paired_by_name(r, "run").collect()} == {("a", "x"), ("b", "x")}
    with pytest.raises(Exception, match="two runs"):
        runs.paired_by_name(r.union(r), "run").collect()
    arms = spark.createDataFrame([("m1", 0, 0.5), ("m2", 0, 0.6), ("m1", 1, 0.9), ("m1", 0, 0.7)], "model string, shots int, f1 double")
    assert [x["shots"] for x in runs.common_arm(arms, "model", "shots").collect()] == [0]
    up = runs.runner_up(arms, "shots", "f1").first()
    lo, hi = (f([r["f1"] for r in arms.collect() if r["shots"] == up[k]]) for f, k in ((min, "best"), (max, "second")))
    assert up["best"] == 1 and up["meet"] == pytest.approx(min(lo, hi))
    rec = spark.createDataFrame([("d", 0, ["1", "9"]), ("d", 1, None)], "doi string, index int, ids array<string>")
    got = runs.papers(rec, spark.createDataFrame([("d", 0, "correct")], "doi string, index int, verdict string"), spark.createDataFrame([("d", "1")], "doi string, chunk string"), "doi", "index", "ids", "chunk").first()
    assert (got["correct"], got["incorrect"], got["unjudged"]) == (1, 0, 1) and got["records"][0]["missing"] == ["9"]
    assert runs.conditions(spark.createDataFrame([(100.0, 1.0), (0.0, 1.0)], "x double, y double"), "x", "y", ["x"]).first()["x"] == 2.0
    agree = runs.field_agreement(spark.createDataFrame([(1.0, 1.005), (1.0, 2.0), (None, 1.0)], "a_v double, b_v double"), ["v"], "a_", "b_").first()
    assert (agree["n"], agree["agree"]) == (2, 0.5)


def test_names_are_scored_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(penalties, "REMEMBERED", 2)
    rows = [("Zinc oxide", "zinc-oxide"), ("", None), (None, "x"), ("abcd", "bcde"), ("bcde", "abcd"), ("abcd", "bcde"), ("ab", "cd")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string")
    scored = penalties.with_string_ratio(df, "a", "b")
    assert [r["ratio"] for r in scored.orderBy("i").collect()] == [1.0, 1.0, 0.0, 0.75, 0.75, 0.75, 0.0]
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString()


def test_matcher_takes_pairs_where_the_join_left_them(spark):
    left = spark.createDataFrame([(g, i, f"n{i}", float(i)) for g in range(40) for i in range(3)], "g int, i long, name string, x double")
    for ratio, exchanges in ((False, 2), (True, 3)):  # Spark forgets the partitioning after Python
        made = match.matched(match.pairs(left.hint("merge"), left, "g", "i", "name", ["x"], ratio=ratio), "g")
        assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == exchanges
        assert made.filter("i = j and gate and penalty = 0").count() == made.count() == 120


def test_overlap_reach_and_keys_with_nulls_and_without_rows(spark):
    rows = spark.createDataFrame([(1, "a", True), (2, None, None), (3, "b", False)], "k int, human string, carried boolean")
    other = spark.createDataFrame([(1, "b", True), (2, None, False), (4, "b", False)], "k int, human string, carried boolean")
    got = review.annotator_overlap(rows, other, ["k"], "human", "carried").first()
    assert (got["total"], got["shared"], got["carried_by_both"], got["independent"], got["agreement"]) == (4, 2, 1, 1, 0.5)
    none = review.annotator_overlap(rows, other.limit(0), ["k"], "human", "carried").first()
    assert (none["total"], none["shared"], none["agreement"]) == (3, 0, None)
    units = spark.createDataFrame([("xml", 0), ("xml", 3), ("pdf", None), (None, 7)], "kind string, n int")
    assert {tuple(r) for r in quality.reach(units, "n", "kind").collect()} == {("xml", 2, 1, 3, 50.0), ("pdf", 1, 0, 0, 0.0)}
    rates = {r["kind"]: r["pass_rate"] for r in quality.pass_rates(units, F.col("n") > 0, "kind").collect()}
    assert rates == {"xml": 50.0, "pdf": 100.0}
    split = stats.evaluable_agreement(units, F.col("kind"), F.lit("xml"), F.col("n") > 0).first()
    assert (split["records"], split["agree"], split["disagree"], split["no_counterpart"]) == (4, 1, 1, 2)
    table = spark.createDataFrame([("10.1/ab", 1), ("10.1/CD", 2), ("10.1/cd", 3)], "doi string, v int")
    keys = spark.createDataFrame([("10.1/AB",), ("10.1/CD",), ("x",), (None,)], "doi string")
    assert {tuple(r) for r in names.tolerant_join(keys, table, "doi").collect()} == {("10.1/AB", 1), ("10.1/CD", 2), ("x", None), (None, None)}
