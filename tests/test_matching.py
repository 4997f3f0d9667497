"""Sparse matching, connected parts, band joins and the reasons of a gap, against brute force."""

import collections
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom import queries
from tallyloom.functions import numerics as N
from tallyloom.functions import rules
from tallyloom.operators import graph, match, overlap


def best(n, m, cost):
    """Least cost over all ways to match, a row without a pair costing 10."""
    return min(sum(min(cost.get((i, j), 10.0), 10.0) if j < m else 10.0 for i, j in enumerate(p)) for p in itertools.permutations(range(m + n), n))


def test_sparse_matching_is_optimal_up_to_seven_records(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for g in range(60):
        n, m = (int(x) for x in rng.integers(1, 5, 2)) if g else (3, 7)
        cost = {(i, j): float(rng.integers(0, 5)) / 5 for i in range(n) for j in range(m) if rng.random() < 0.5}
        rows += [(g, i, j, c) for (i, j), c in cost.items()]
        if cost:
            want[g] = best(n, m, cost) - 10 * (n - len({i for i, _ in cost})) - 10 * len({i for i, _ in cost})
    df = spark.createDataFrame([*rows, (None, 0, 0, 0.1)], "g int, i int, j int, cost double").repartition(5)
    for split in (False, True):
        got = match.sparse_matched(df, "g", split).collect()
        assert all(max(collections.Counter((r["g"], r[c]) for r in got).values()) == 1 for c in "ij")
        total = collections.Counter()
        for r in got:
            total[r["g"]] += r["cost"] - 10
        assert {g: pytest.approx(total[g]) for g in want} == want
    dense = match.matched(spark.createDataFrame([(0, i, j, cost) for i, j, cost in ((0, 0, 0.1), (0, 1, 0.2), (1, 0, 0.2), (1, 1, 10.0))], "g int, i int, j int, cost double"), "g").agg(F.sum("cost")).first()[0]
    assert dense == pytest.approx(0.4)


def test_one_group_of_many_records_in_bounded_memory(spark):
    n = 20_000
    rng = np.random.default_rng(2)
    i = np.repeat(np.arange(n), 10)
    j = np.minimum(i + rng.integers(-4, 6, len(i)), n - 1).clip(0)
    pairs = {(int(a), int(b)) for a, b in zip(i, j) if a // 50 == b // 50}  # 400 parts
    df = spark.createDataFrame([("g", a, b, float(rng.random())) for a, b in pairs], "g string, i int, j int, cost double").repartition(8)
    parts = graph.components(df.select(F.concat(F.lit("i"), "i").alias("a"), F.concat(F.lit("j"), "j").alias("b")))
    assert parts.select("part").distinct().count() >= 400
    got = match.sparse_matched(df, "g", split=True)
    tasks = got.select(F.spark_partition_id().alias("p")).distinct().count()
    rows = got.collect()
    assert tasks > 1 and len({r["i"] for r in rows}) == len(rows) == len({r["j"] for r in rows}) > 0.97 * n
    block = [(a, b) for a, b in pairs if a < 50]
    cost = {(r["i"], r["j"]): r["cost"] for r in df.filter("i < 50").collect()}
    dense = np.full((50, 100), 10.0)
    for a, b in block:
        dense[a, b] = cost[a, b]
    assert sum(r["cost"] for r in rows if r["i"] < 50) + 10 * (50 - sum(r["i"] < 50 for r in rows)) == pytest.approx(sum(dense[p] for p in N.assignment(dense)))


def test_left_over_records_pair_in_order(spark):
    a = spark.createDataFrame([("g", i) for i in (1, 3, 5, 7)] + [("h", 1)], "g string, index int")
    b = spark.createDataFrame([("g", i) for i in (2, 4, 6)], "g string, index int")
    done = spark.createDataFrame([("g", 3, 4)], "g string, i int, j int")
    assert {tuple(r) for r in match.paired_rest(a, b, done, "g", "index").collect()} == {("g", 1, 2), ("g", 5, 6)}


def test_band_pairs_equal_all_pairs_within_tolerance(spark):
    rng = np.random.default_rng(3)
    value = lambda: None if rng.random() < 0.3 else float(rng.choice([0.0, 1e-12, 100.0, 102.0, 104.1, -100.0, float("nan"), round(float(rng.normal(100, 3)), 1)]))
    make = lambda n: [(int(k), None if rng.random() < 0.1 else "ab"[int(rng.random() < 0.9)], value(), value()) for k in range(n)]
    left, right = make(150), make(150)
    ddl = "k int, g string, x double, y double"
    ok = lambda v: v is not None and v == v

    def agree(a, b, slack):
        shared = [(p, q) for p, q in zip(a[2:], b[2:]) if ok(p) and ok(q)]
        return a[1] == b[1] and bool(shared) and all(abs(p - q) <= slack * max(abs(p), abs(q), 1e-9) for p, q in shared)

    for slack in (0.02, 0.0):
        got = sorted((r["l_k"], r["r_k"]) for r in overlap.band_pairs(spark.createDataFrame(left, ddl), spark.createDataFrame(right, ddl), ["g"], ["x", "y"], slack).collect())
        assert got == sorted((a[0], b[0]) for a in left for b in right if agree(a, b, slack)) and got


def test_a_hot_key_of_the_band_join_spreads_over_its_buckets(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, "hot", float(v)) for i, v in enumerate(np.exp(rng.uniform(0, 12, 4000)))], "k int, g string, x double")
    pairs = overlap.band_pairs(df, df, ["g"], ["x"], 0.001)
    values = sorted(r["x"] for r in df.collect())
    assert pairs.count() == sum(abs(a - b) <= 0.001 * max(a, b) for i, a in enumerate(values) for b in values[max(0, i - 60) : i + 61])
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "bucket" in plan.split("Join")[1].split("\n")[0]  # an equi key


def test_each_reason_of_the_gap(spark):
    row = lambda k, paper, category, ours=None, o=(None, None), theirs=None, t=(None, None): (k, paper, category, ours, theirs, *o, *t)
    rows = [
        row(1, "p", "ours", "none", (1.0, 2.0)),
        row(2, "p", "ours", "Zn(Ac)2", (190.0, 80.0)), row(3, "p", "both", "Zn (Ac)2", (190.0, 80.0), "x", (190.0, 80.0)),
        row(4, "q", "ours", "ZnO", (100.0, None)), row(5, "q", "ours", "ZnO", (100.0, None)), row(6, "q", "ours", "ZnO", (100.0, 5.0)),
        row(7, "r", "ours", "[Bmim]Cl", (180.0, 40.2)), row(8, "r", "rule", None, (None, None), "[BMIM] Cl", (181.0, 40.0)),
        row(9, "r", "ours", "[Bmim]Cl", (180.0, 60.0)), row(10, "r", "ours", "[Bmim]Cl", (150.0, 40.0)), row(11, "r", "ours", "[Bmim]Cl", (None, 40.0)),
        row(12, "s", "ours", None, (5.0, None)), row(13, "s", "both", "a", (9.0, 9.0), None, (5.0, 1.0)),
    ]
    df = spark.createDataFrame(rows, "k int, paper string, category string, ours_name string, theirs_name string, ours_heat double, ours_share double, theirs_heat double, theirs_share double")
    args = ("k", "paper", "category", (rules.substance(F.col("theirs_name")), rules.substance(F.col("ours_name"))), ["heat"], ["share"], F.col("ours_name") == "none", F.col("paper") == "p")
    r = overlap.REASONS
    want = {1: r["excluded"], 2: r["repeat"], 4: r["twice"], 5: r["twice"], 6: r["name"], 7: r["missed"], 9: r["repeat"], 10: r["condition"], 11: r["condition"], 12: r["repeat"]}
    got = overlap.gap_reasons(df, *args)
    assert {x["k"]: x["reason"] for x in got.collect()} == want and got.count() == len(want)
    assert overlap.gap_reasons(df.limit(0), *args).count() == 0


def test_spellings_of_one_substance_meet(spark):
    names = ["[TMG]Cl/ZnCl2", "[TMG] ZnCl3", "1,3-dimethylimidazolium acetate", "[dimim]Ac", "(m-O)-[Zn]", "H2O", None]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(rules.substance(F.col("n"))).collect()]
    assert got[0] == got[1] and got[2] == got[3] == "dmimoac" and got[4:] == ["o-zn", "water", ""]
    kinds = [r[0] for r in spark.createDataFrame([("a/b",), ("A and B",), ("x@y",), ("PIL-3",), ("Cat-1",), ("zinc acetate",), (None,)], "n string").select(rules.name_kind(F.col("n"))).collect()]
    assert kinds == ["mixture of two", "mixture of two", "supported on a carrier", "code the paper coined", "code the paper coined", "plain chemical name", "plain chemical name"]
    assert [r[0] for r in spark.createDataFrame([(" Glycolysis",), ("other",), (None,)], "n string").select(rules.product_of(F.col("n"))).collect()] == ["BHET", None, None]


def test_tolerance_join_spreads_a_hot_key_and_equals_all_pairs(spark):
    nan, inf = float("nan"), float("inf")
    odd = [None, 0.0, -3.0, 19.0, 20.0, 20.5, 1e300, nan, inf]
    rows = [("g", n, x, y) for n, (x, y) in enumerate((x, y) for x in odd for y in (None, 1.0, 2.0, inf))]
    df = spark.createDataFrame(rows, "k string, id int, x double, y double")
    for slack in (0.05, 0.0, 1.5):
        pairs = match.tolerance_join(df, df, ["k"], ["x", "y"], slack)
        both = df.selectExpr("k", "id id_l", "x x_l", "y y_l").join(df.selectExpr("k", "id id_r", "x x_r", "y y_r"), "k")
        near = "coalesce(abs({0}_l - {0}_r) <= {1}D * greatest(abs({0}_l), abs({0}_r), 1e-9D), true)"
        want = both.filter("x_l is not null and x_r is not null or y_l is not null and y_r is not null").filter(near.format("x", slack)).filter(near.format("y", slack))
        ids = lambda t: sorted((r["id_l"], r["id_r"]) for r in t.collect())
        assert ids(pairs) == ids(want)
    hot = spark.range(3000).selectExpr("'g' k", "id", "cast(1 + id % 50 as double) x", "900D + id % 100 y")
    found = match.tolerance_join(hot, hot, ["k"], ["x", "y"], 0.05)
    assert found.groupBy(F.spark_partition_id()).count().count() > 10  # equal keys alone left all pairs to one task


def test_the_scorer_sends_no_pairs_to_the_matcher(spark):
    """Rows that reach the matcher are groups, whatever the number of pairs, and its labels are those of the pair table."""
    nan, inf = float("nan"), float("inf")
    numbers = [None, 0.0, 1.0, 1.005, 1.1, -5.0, nan, inf]
    key = spark.createDataFrame([(g, n, "zinc" if n % 3 else None, "a" if n % 2 else None, x) for g in range(4) for n, x in enumerate(numbers[g:])], "g int, index int, name string, s string, v double")
    got = spark.createDataFrame([(g, 2 * n, "zincs" if n % 2 else "tin", "a", x) for g in range(1, 6) for n, x in enumerate(reversed(numbers))] + [(None, 7, "zinc", "a", 1.0)], key.schema)
    out = match.evaluate(key, got, "g", "index", "name", ["v"], ["s"])
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()  # pairs were sorted before
    made = match.labels(key, got, match.matched(match.pairs(key, got, "g", "index", "name", ["v"], ["s"]), "g"), "g", "index")
    plain = lambda t: sorted(map(str, t.select("g", "verdict", "i", "j", "penalty", "reason", F.sort_array("wrong").alias("wrong")).collect()))
    assert plain(out) == plain(made)


def test_only_large_groups_are_split_into_parts(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(g, int(i), int(j), float(rng.integers(0, 9))) for g, n in ((1, 40), (2, 4), (None, 3)) for i in range(n) for j in {i, int(rng.integers(0, n)), int(rng.integers(0, n))}]
    gated = spark.createDataFrame(rows, "g int, i long, j long, cost double")
    calls, real = [], match.components
    monkeypatch.setattr(match, "components", lambda edges: calls.append(edges.count()) or real(edges))
    cost = lambda: {r["g"]: (r["n"], r["c"]) for r in match.sparse_matched(gated, "g", split=True).groupBy("g").agg(F.count("i").alias("n"), F.sum("cost").alias("c")).collect()}
    together = cost()
    assert not calls  # every pair went through the rounds before
    monkeypatch.setattr(match, "TOGETHER", 20)
    assert cost() == together and set(together) == {1, 2} and calls[0] == sum(r[0] == 1 for r in rows)


def test_closest_pairs_are_chosen_without_a_table_of_pairs(spark, monkeypatch):
    """Equal to the greedy matching of the pair table, to the last digit, with ties, odd numbers and groups in several slices."""
    rng = np.random.default_rng(5)
    numbers = [None, 0.0, 1.0, 1.1, 1.13, -5.0, float("nan"), float("inf")]
    some = lambda of: of[int(rng.integers(len(of)))]
    side = lambda few, many: [(g, 3 * n, some(["zinc", "zincs", "tin", None]), some(["a", None]), some(numbers), some(numbers)) for g in range(30) for n in range(int(rng.integers(few, many)))]
    schema = "g int, index int, name string, s string, v double, w double"
    key = spark.createDataFrame([*side(0, 7), (None, 0, "zinc", "a", 1.0, 1.0), *((99, n, "zinc", "a", 1.0, 1.0) for n in range(12))], schema)
    got = spark.createDataFrame([*side(0, 9), (None, 0, "zinc", "a", 1.0, 1.0), *((99, n, "zinc", "a", 1.0, 1.0) for n in range(15))], schema)
    fields = ("g", "index", "name", ["v", "w"], ["s"])
    monkeypatch.setattr(match, "PAIRS", 40)
    plain = lambda t: sorted(map(str, t.select("g", "i", "j", "gate", "penalty", "cost", F.sort_array("wrong").alias("wrong")).collect()))
    for ratio in (True, False):
        want = plain(match.matched(match.pairs(key, got, *fields, ratio=ratio), "g", greedy=True))
        assert plain(match.closest(key, got, *fields, ratio=ratio)) == want and len(want) > 60
    assert match.closest(key, got.limit(0), *fields).count() == 0
    plan = queries.queries()["greedy_match"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(l_orderkey") == 2 and "ArrowEvalPython" not in plan  # pairs were compared one by one, sent and sorted before
    cost = rng.integers(0, 4, (9, 14)).astype(float)
    at = np.flatnonzero(rng.random(126) < 0.7)
    wide = np.full((9, 14), 100.0)
    wide.flat[at] = cost.flat[at]
    chosen = N.closest_pairs(*np.divmod(at, 14), cost.flat[at])
    assert sorted(divmod(int(k), 14) for k in at[chosen]) == [(i, j) for i, j in N.closest_first(wide) if wide[i, j] < 100]
