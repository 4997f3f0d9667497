"""Splitting, macros, cards, configurations and outcomes."""

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import review
from tallyloom.plans import metrics
from tallyloom.sources import text


def test_tables_and_short_blocks_are_not_split(spark):
    table = "| a | b |\n| - | - |\n" + "| one. two. | 3 |\n" * 40
    blocks = [table, "See:\n" + table, "Short  one. Two.", "First here. Second here. Third.", " ", None]
    got = [r[0] for r in spark.createDataFrame([(i, b) for i, b in enumerate(blocks)], "i int, b string").orderBy("i").select(text.split_long(F.col("b"), 24)).collect()]
    assert got == [[table], ["See:\n" + table], ["Short  one. Two."], ["First here. Second here.", "Third."], [], []]


def test_macros_round_trip_and_cards(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n int, s string")
    m = [metrics.Metric("rows in all", ("t",), "count", lambda t: t.agg(F.count("*").alias("value"))), metrics.Metric("share_of_s", ("t",), "fill rate", lambda t: t.agg((F.count("s") / F.count("*")).alias("value")))]
    table = metrics.collected(m, {"t": df}).withColumn("formatted", F.concat("formatted", F.when(F.col("name") == "share_of_s", " %").otherwise("")))
    path = str(tmp_path / "m")
    metrics.macro_lines(table, {"share_of_s": "SShare"}).write.text(path)
    got = {r["name"]: (r["value"], r["derivation"]) for r in metrics.macros(spark.read.text(path)).collect()}
    assert got == {"RowsInAll": ("2", "count of t"), "SShare": ("0.500 %", "fill rate of t")}
    assert [r[0] for r in metrics.card(table, "Data", "About it.").collect()] == ["# Data", "", "About it.", "", "| metric | value | from |", "|-|-|-|", "| rows in all | 2 | count of t |", "| share_of_s | 0.500 % | fill rate of t |"]
    (tmp_path / "c.yaml").write_text("run_name: ${NAME}\nllm_params: {model: m}\n")
    assert metrics.config(str(tmp_path / "c.yaml"), {"NAME": "x"})["run_name"] == "x"
    with pytest.raises(KeyError):
        metrics.config(str(tmp_path / "c.yaml"), {})


def test_outcomes_partition_the_cases(spark):
    df = spark.createDataFrame([("a", ["judge"]), ("a", ["judge", "both"]), ("a", ["neither"]), ("b", []), ("b", None), ("b", ["extractor"])], "k string, answers array<string>")
    rows = df.select("k", review.review_outcome(F.col("answers")).alias("o"))
    got = {r["k"]: r for r in review.outcome_table(rows, "k", "o").collect()}
    assert tuple(got["a"]) == ("a", 1, 1, 1, 3, 1 / 3) and tuple(got["b"]) == ("b", 0, 0, 1, 1, 0.0)
    with pytest.raises(Exception, match="not listed"):
        review.outcome_table(rows, "k", "o", ["caught", "rejected"]).collect()
    kinds = spark.createDataFrame([("x", "", "1"), ("x", "1", None), ("name", "a", "b"), ("x", "a", "b"), ("name", None, "")], "f string, w string, t string").select(review.correction_kind(F.col("f"), F.col("w"), F.col("t"), ["name"]))
    assert [r[0] for r in kinds.collect()] == ["fill", "empty", "substance", "number", "substance"]


def test_the_scorer_reads_each_side_once(spark):
    from tallyloom import queries as Q

    plan = Q.assignment_score(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("l_extendedprice") and sum("FileScan" in line and "l_orderkey" in line for line in plan.splitlines()) <= 2
    below = plan[plan.index("MapInArrow"):]
    assert "Exchange" not in below[: below.index("Join")]  # pairs are not shuffled between the join and the matcher
