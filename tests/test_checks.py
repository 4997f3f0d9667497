"""Names, tiers, release checks, readers and verdicts on small cases."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import checks, names, quality, review, runs
from tallyloom.sources import bundles


def test_names_resolve_with_reasons_and_tiers(spark):
    table = spark.createDataFrame([("catalyst", "ZnCl2", "Cl[Zn]Cl", None), ("catalyst", "NaOH", "[Na+].[OH-]", None), ("oxide", "MgO", "[Mg+2].[O-2]", None), ("catalyst", "clay", None, "a material")], "kind string, name string, value string, note string")
    given = ["[ZnCl2]", "ZnCl2 / NaOH", "zncl2 and zncl2", "ZnCl2 with steel", "steel", "MgO", "clay (dry)", "none", "N/A", " ", None]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(given)], "i int, name string")
    out = names.resolved(df, "name", F.lit("catalyst"), table, fallback=("catalyst", "oxide", "lookup: an oxide"))
    mappable = names.mappability(F.col("name"), list(names.NOTHING), "(?i)steel|zeolite")
    rows = out.withColumn("tier", names.tier(F.col("origin"), F.col("value"), F.when(F.col("i") == 0, "other spelling"), mappable)).orderBy("i").collect()
    assert [r["origin"] for r in rows] == ["lookup", "mixture", "mixture", names.UNKNOWN_PART, names.UNKNOWN_NAME, "lookup: an oxide", "unmappable: a material", "unmappable: no catalyst was used", "unmappable: not reported", "not reported", "not reported"]
    assert rows[1]["value"] == "Cl[Zn]Cl.[Na+].[OH-]" and rows[2]["value"] == "Cl[Zn]Cl.Cl[Zn]Cl"
    assert [r["tier"] for r in rows] == ["confirmed", "LLM written", "LLM written", "impossible", "impossible", "LLM written", "not reported", "no catalyst", "not reported", "not reported", "not reported"]
    assert spark.range(1).select(names.cleaned(F.lit("Aluminium sulphate dihydrate"))).first()[0] == "aluminum sulfate"


def test_mechanical_checks_have_all_eight_and_their_evidence(spark):
    rows = [(1, "p", 50.0, 60.0, 1.0, 2.0, 100.0, 60.0), (1, "p", 50.0, 60.0, 1.0, 2.0, 100.0, 60.0), (2, "p", 120.0, 60.0, 5.0, 2.0, 400.0, 0.0), (3, "q", None, None, None, 0.0, None, 20000.0), (4, None, 1.0, 2.0, 1.0, 2.0, 3.0, None)]
    df = spark.createDataFrame(rows, "k int, paper string, y double, c double, part double, whole double, heat double, time double")
    got = {r["check"]: (r["n"], r["total"]) for r in quality.mechanical(df, ["k"], ["y", "c"], ["y", "heat", "time"], {"part": 4.0}, "part", "whole", "heat", "time").collect()}
    assert got == {"no outcome": (1, 5), "incomplete": (2, 5), "above 100%": (1, 5), "yield above conversion": (1, 4), "absurd amounts": (1, 5), "part outweighs whole": (1, 4), "too hot": (1, 4), "no time or over a week": (2, 4), "repeated": (1, 5)}
    assert tuple(checks.modelable(df, ["y", "heat", "time"], "paper").first()) == (3, 1, 5)
    shown = checks.evidence(df, {"hot": F.col("heat") > 50, "none": F.col("y").isNull()}, ["k"], ["k"], 2).orderBy("check", "place").collect()
    assert [(r["check"], r["place"], json.loads(r["row"])["k"]) for r in shown] == [("hot", 1, 1), ("hot", 2, 1), ("none", 1, 3)]


def test_identity_inference_and_bases(spark):
    rows = [
        ("ZnSO4·7H2O", "S.O", "confirmed", "water"), ("zinc hydrate", "S", "LLM written", "H2O"), ("a / b", "X", None, "EG"), ("5 wt% c", None, "LLM written", "ethanol"), (None, "X", None, None),
        ("Zeolite", "X", None, "water/ethylene glycol"), ("KOH", None, None, "methanol"), ("K OH", None, None, "MeOH"), (" none ", None, None, "benzyl alcohol"),
    ]
    df = spark.createDataFrame(rows, "name string, structure string, source string, solvent string").withColumns({"part": F.lit(2.0), "whole": F.when(F.col("name") == "K OH", 0.0).otherwise(8.0)})
    got = {r["check"]: (r["n"], r["total"]) for r in checks.identity(df, "name", "structure", "solvent", "source", contradicts=F.col("name") == "a / b").collect()}
    assert got == {"hydrate without water": (1, 2), "several in one cell": (1, 9), "loading in the name": (1, 9), "unverified structure": (2, 9), "structure contradicts the name": (1, 9), "synonyms": (8 - 3, 8), "structures of several names": (1, 3), "solvent spellings": (2, 8)}
    from tallyloom.functions import rules

    found = {r["check"]: (r["n"], r["total"]) for r in checks.inference(df, "name", "solvent", rules.route_of(F.col("solvent"))).collect()}
    assert found["unseen abbreviation"] == (1, 3) and found["two rules fire"] == (1, 9) and found["no slot for the route"] == (2, 9) and found["solid among the dissolved"] == (1, 9)
    assert tuple(checks.reagent_bases(df, "name", "part", "whole").first()) == (2, 7, 25.0)
    assert checks.reagent_bases(df.limit(0), "name", "part", "whole").first()["records"] == 0


def test_key_faults_and_implied_yields(spark):
    rows = [("p", "a", 50.0, 80.0, 60.0, 1.0, ["x"]), ("p", "a", 50.0, 80.0, 60.0, 1.0, []), ("q", None, None, None, None, -1.0, None), ("q", "b", 101.0, -3.0, 5.0, 2.0, ["y"])]
    df = spark.createDataFrame(rows, "paper string, name string, y double, c double, s double, mass double, cited array<string>")
    got = {r["fault"]: r["n"] for r in checks.key_faults(df, "paper", "name", ["name", "y", "c", "s", "mass"], ["y", "c", "s"], ["mass", "c"], "cited").collect()}
    assert got == {"papers": 2, "distinct names": 2, "experiments": 4, "entered twice": 1, "no outcome at all": 1, "percentage outside 0-100": 2, "negative amount": 2, "citing no source chunk": 2}
    e = checks.implied_error(df, "y", "c", "s").first()
    assert e["n"] == 3 and e["min"] == pytest.approx(2.0) and e["max"] == pytest.approx(101.15) and e["median"] == pytest.approx(2.0)
    papers = spark.createDataFrame([("A Review of fibres", 0), ("Lipase in fibre", None), ("plain", 0), ("Lipase", 3)], "title string, n int")
    assert {r["reason"]: r["n"] for r in checks.empty_reasons(papers, F.col("title"), F.col("n")).collect()} == {"review article": 1, "enzymatic or biological": 1, "no extractable data": 1}


def test_published_runs_are_held_to_recomputed_ones(spark):
    a = spark.createDataFrame([("x", 0.5, None), ("y", 0.5, 0.1), ("z", 0.5, 0.1), ("only", 0.5, 0.1)], "run string, p double, r double")
    b = spark.createDataFrame([("x", 0.5 + 1e-12, None), ("y", 0.5, 0.1 + 1e-8), ("z", 0.5, None), ("other", 0.5, 0.1)], "run string, p double, r double")
    assert {r["run"]: r["ok"] for r in checks.reproduced(a, b, ["run"], ["p", "r"]).collect()} == {"x": True, "y": False, "z": False, "only": False, "other": False}


def test_one_plan_from_runs_to_agreement(spark):
    labels = spark.createDataFrame([("x", "d", 0, "correct", "accepted"), ("x", "d", 1, "incorrect", "no counterpart"), ("x", "d", 2, "correct", "numbers differ")], "extraction string, doi string, index int, metric string, situation string")
    said = spark.createDataFrame([("judge_a_on_x", "d", 0, "correct"), ("judge_a_on_x", "d", 1, "incorrect"), ("judge_a_on_x", "d", 2, "incorrect"), ("judge_a_on_none", "d", 0, "correct"), ("odd", "d", 0, "correct")], "run string, doi string, index int, judge string")
    r = runs.judge_matrix(labels, said, ["doi", "index"]).collect()
    assert len(r) == 1 and (r[0]["records"], r[0]["evaluable"], r[0]["agree"], r[0]["disagree"], r[0]["no_counterpart"]) == (3, 2, 1, 1, 1)
    assert r[0]["agreement"] == pytest.approx(2 / 3) and r[0]["agreement_evaluable"] == 0.5


def test_readers_of_runs_labels_and_dimensions(spark, tmp_path):
    for run, cost in (("a", 1.0), ("sweep/b", 2.0), ("sweep/c", 3.0), ("x/y/deep", 4.0), ("gone", 5.0)):
        (tmp_path / "runs" / run).mkdir(parents=True)
        (tmp_path / "runs" / run / "run_meta.json").write_text(json.dumps({"model": "m", "cost_usd": cost}))
    read = bundles.runs(spark, str(tmp_path / "runs"))
    assert {r["run"]: r["cost_usd"] for r in read.collect()} == {"a": 1.0, "sweep/b": 2.0, "sweep/c": 3.0, "gone": 5.0}
    configs = spark.createDataFrame([("a",), ("sweep",), ("c",)], "run string")
    assert {r["run"] for r in bundles.runs(spark, str(tmp_path / "runs"), configs).collect()} == {"a", "sweep/b", "sweep/c"}
    labels = spark.createDataFrame([("d", 1, "correct", "old", "old", "incorrect"), ("d", 2, "correct", "old", "old", "correct")], "doi string, extracted_index int, human string, judge string, metric string, judge_v4 string")
    scored = spark.createDataFrame([("d", 1, "correct", "accepted", 0.1)], "doi string, index int, metric string, situation string, penalty double")
    assert [r.asDict() for r in bundles.labelled(labels, scored).collect()] == [{"doi": "d", "index": 1, "human": "correct", "judge": "incorrect", "metric": "correct", "situation": "accepted"}]
    write = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    assert [tuple(r) for r in bundles.source_formats(spark, write("f.csv", "doi,format\n10.1/AB,PDF\n")).collect()] == [("10.1/ab", "PDF")]
    assert [tuple(r) for r in bundles.open_access(spark, write("o.csv", "doi,is_oa\n 10.1/AB ,True\nx,\n")).collect()] == [("10.1/ab", True), ("x", False)]
    assert [tuple(r) for r in bundles.yield_basis(spark, write("y.csv", "doi,yield_basis\na,molar\nb,\"\"\n")).collect()] == [("a", "molar"), ("b", None)]
    assert [tuple(r) for r in bundles.lookup(spark, write("l.csv", "kind,name,smiles,note\ncatalyst,ZnO,O=[Zn],\n")).collect()] == [("catalyst", "ZnO", "O=[Zn]", None)]
    over = bundles.overlap(spark, write("g.csv", "doi,category,rule_said,ext_catalyst,ours_catalyst,ext_temperature_c,ours_temperature_c\nd,both,r,Zn,ZnO,190,n/a\n"), "ext_").first()
    assert (over["theirs_catalyst"], over["ours_catalyst"], over["theirs_temperature_c"], over["ours_temperature_c"], over["ours_yield_percent"]) == ("Zn", "ZnO", 190.0, None, None)
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "1.json").write_text(json.dumps({"doi": "d", "records": []}))
    (tmp_path / "e" / "2.json").write_text(json.dumps({"doi": "f", "records": [{"catalyst": "a"}, {"catalyst": "b"}]}))
    assert {r["doi"]: [x["catalyst"] for x in r["records"]] for r in bundles.experiments(spark, str(tmp_path / "e")).collect()} == {"d": [], "f": ["a", "b"]}


def test_verdicts_drop_repair_and_leave(spark):
    records = spark.createDataFrame([(i, 1.0 if i != 4 else None, "old") for i in range(1, 7)], "k int, heat double, name string")
    kind = "k int, parsed_ok boolean, drop_record boolean, critique string, fixes array<struct<field:string,value:string,evidence:string>>"
    verdicts = spark.createDataFrame([
        (1, True, True, "not in the paper", [("heat", "9", "x")]), (2, True, False, "c", [("Temperature", "190 C", "t1"), ("heat", "1", "t2"), ("colour", "red", "n"), ("NAME", "old", "same")]),
        (3, False, True, "garbled", [("heat", "5", "x")]), (4, True, None, None, [("heat", None, "blank"), ("heat", "none", "blank")]), (5, True, False, "fine", None),
    ], kind)
    kept, log = review.applied_verdicts(records, verdicts, ["k"], {"heat": "double", "name": "string"}, ["heat"], {"temperature": "heat"})
    assert sorted((r["k"], r["heat"], r["name"]) for r in kept.collect() if r["k"] != 4) == [(2, 1.0, "old"), (3, 1.0, "old"), (5, 1.0, "old"), (6, 1.0, "old")] and kept.filter("k = 4 and heat is null").count() == 1
    got = {r["k"]: r for r in log.collect()}
    assert set(got) == {1, 2} and (got[1]["action"], got[1]["critique"], got[1]["changes"]) == ("dropped", "not in the paper", [])
    assert [tuple(c) for c in got[2]["changes"]] == [("heat", "1.0", "190.0", "t1"), ("heat", "190.0", "1.0", "t2")]
    assert math.isclose(kept.filter("k = 2").first()["heat"], 1.0)
