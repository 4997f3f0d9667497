"""Every registered query with SQL against DuckDB on the smallest tables; the others run and keep their invariants."""

import pytest
from oracle_check import compare

from tallyloom import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(Q.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert compare(spark, SF, name, Q.queries()[name], Q.oracle_sql()[name]) == ""


def test_labels_partition_both_sides(spark):
    key, found = Q.extraction(spark, SF)
    labels = Q.assignment_match(spark, SF).toPandas()
    seen = {r[0] for r in found.select("l_orderkey").distinct().collect()}
    n_key = sum(r[0] in seen for r in key.select("l_orderkey").collect())
    tp, mm, fn, fp = ((labels.verdict == v).sum() for v in ("TP", "MISMATCH", "FN", "FP"))
    assert tp + mm + fn == n_key and tp + mm + fp == found.count()
    assert labels.penalty.dropna().between(0, 1).all()


def test_entry(spark):
    import __spark_entry__ as e

    row = e.entry(spark).first()
    assert 0 < row["f1"] <= 1 and {"bootstrap_shift", "string_ratio"} <= set(e.queries())
