"""Order, percentiles and tests without one task a group: equal to brute force, spread when a group holds nearly all rows."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyloom.functions import numerics as N
from tallyloom.functions import special
from tallyloom.operators import aggregates, scan, stats


@pytest.fixture(scope="module")
def hot(spark):
    """Nine tenths of the rows in one group, many ties, some nulls."""
    rng = np.random.default_rng(1)
    rows = [(i, "hot" if i % 10 else f"g{i % 30}", float(rng.integers(0, 2000)) if i % 17 else None, float(rng.normal())) for i in range(20_000)] + [(20_000, None, 5.0, 1.0), (20_001, None, 7.0, 2.0)]
    return spark.createDataFrame(rows, "id int, g string, x double, y double").repartition(8).cache()


def frame(df):
    return df.toPandas()


def spread(df, column="__range"):
    """Rows of the fullest range against the mean."""
    n = [r["count"] for r in df.groupBy("g", column).count().filter("g = 'hot'").collect()]
    return max(n) / (sum(n) / len(n)), len(n)


def test_positions_and_running_values_equal_windows(hot):
    pdf = frame(hot).sort_values(["x", "id"], na_position="first", kind="stable")
    want = pdf.groupby("g", dropna=False).cumcount()
    got = frame(scan.positions(hot, ["g"], ["x", "id"])).set_index("id")["position"]
    assert (got.loc[pdf["id"]].to_numpy() == want.to_numpy()).all()
    assert (frame(scan.positions(hot, (), ["id"])).set_index("id")["position"].sort_index().to_numpy() == np.arange(20_002)).all()
    back = frame(scan.positions(hot.filter("x is not null"), (), ["x", "id"], descending=True)).sort_values("position")
    assert (np.diff(back["x"]) <= 0).all() and (back["position"].to_numpy() == np.arange(len(back))).all()
    assert {r["x"] is None: r["position"] for r in scan.positions(hot.sparkSession.createDataFrame([(None, 1), (2.0, 2)], "x double, id int"), (), ["x", "id"], descending=True).collect()} == {False: 0, True: 1}
    for how, f in (("sum", "cumsum"), ("max", "cummax"), ("min", "cummin")):
        run = frame(scan.running(hot, ["g"], ["x", "id"], "id", "before", how)).set_index("id")["before"].loc[pdf["id"]]
        assert (run.fillna(-1).to_numpy() == getattr(pdf.groupby("g", dropna=False)["id"], f)().groupby(pdf["g"], dropna=False).shift().fillna(-1).to_numpy()).all(), how
    most, parts = spread(scan.ranged(hot.filter("x is not null"), ["g"], "x"))
    assert most < 2 and parts > 100
    assert scan.positions(hot.limit(0), ["g"], ["x"]).count() == 0
    with pytest.raises(TypeError):
        scan.ranged(hot, ["g"], "g")


def test_ranks_percentiles_and_correlations_of_a_hot_group(hot):
    pdf = frame(hot)
    ranks = frame(stats.value_ranks(hot.filter("x is not null"), "x", ["g"])).set_index(["g", "x"])
    for g, part in pdf[pdf["x"].notna()].groupby("g"):
        want = part["x"].rank()
        assert np.allclose(ranks["rank"].loc[g].loc[part["x"]].to_numpy(), want.to_numpy())
        assert ranks["index"].loc[g].max() + 1 == part["x"].nunique()
    rho = {r["g"]: r["rho"] for r in stats.spearman(hot, "x", "y", ["g"]).collect()}
    for g, part in pdf.dropna().groupby("g"):
        assert rho[g] == pytest.approx(part["x"].rank().corr(part["y"].rank()), abs=1e-9)
    p = {r["g"]: r for r in scan.percentiles(hot, "y", (0.0, 0.1, 0.5, 0.975, 1.0), ["g"]).collect()}
    for g, part in pdf.groupby("g", dropna=False):
        r = p[None if g != g or g is None else g]
        assert [r[f"p{i}"] for i in range(5)] == pytest.approx(list(np.quantile(part["y"], (0, 0.1, 0.5, 0.975, 1)))) and r["n"] == len(part)
    assert scan.percentiles(hot.limit(0), "y", (0.5,)).collect()[0]["p0"] is None if scan.percentiles(hot.limit(0), "y", (0.5,)).count() else True


def test_frames_copy_borders_and_no_block_is_larger_than_the_others(hot):
    pdf = frame(hot).sort_values(["g", "y", "id"])
    for window in (5, 8):
        got = frame(stats.rolling_median(hot, ["g"], ["y", "id"], "x", window)).set_index("id")["rolling_median"]
        for g, part in pdf.groupby("g"):
            x = part["x"].to_numpy()
            want = [np.nanmedian(w) if np.isfinite(w := x[max(0, i - window // 2) : i + (window - 1) // 2 + 1]).sum() >= window // 2 else np.nan for i in range(len(x))]
            assert np.allclose(got.loc[part["id"]].to_numpy(), want, equal_nan=True)
    counted = scan.framed(hot, ["g"], ["y", "id"], 2, 2, lambda w: {"n": F.count(F.lit(1)).over(w)}, rows=100)
    assert counted.count() == 20_002 and counted.filter("g = 'hot'").groupBy("n").count().orderBy("n").collect()[-1]["count"] == 18_000 - 4


def test_no_window_runs_over_all_rows_in_one_task(hot):
    """The only single partitions are those of one-row tables."""
    for df in (aggregates.percentages(hot, "x"), aggregates.pareto(hot, "x", "y"), stats.spearman(hot, "x", "y"), scan.percentiles(hot, "x", (0.5,)), stats.rolling_median(hot, ["g"], ["y"], "x", 5)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        for at in plan.split("Exchange SinglePartition")[1:]:
            above = at.strip().splitlines()[1]
            assert "partial_" in above or "Aggregate" in above or "Project" in above and "keys=[__range" in at.split("Exchange")[0] or "HashAggregate(keys=[__range" in at[:2500], above


def test_special_functions_equal_the_small_numerics(spark):
    rng = np.random.default_rng(2)
    rows = [(float(rng.random()), float(a), float(b)) for a in (0.5, 1, 3.5, 40, 3000) for b in (0.5, 2, 60.5, 900)]
    df = spark.createDataFrame(rows, "x double, a double, b double")
    for r in df.withColumns({"p": special.beta_cdf(F.col("x"), F.col("a"), F.col("b")), "g": special.log_gamma(F.col("a")), "q": special.beta_quantile(0.3, F.col("a"), F.col("b"))}).collect():
        assert r["p"] == pytest.approx(N.beta_cdf(r["x"], r["a"], r["b"]), abs=1e-11) and r["g"] == pytest.approx(math.lgamma(r["a"]), rel=1e-13, abs=1e-13)
        assert N.beta_cdf(r["q"], r["a"], r["b"]) == pytest.approx(0.3, abs=1e-10)
    tests = spark.createDataFrame([(2.0, 10.0), (0.1, 3.0), (-30.0, 5.0), (1.5, 1e7), (math.inf, 4.0), (None, 4.0)], "t double, df double")
    got = [r[0] for r in tests.select(special.t_two_sided(F.col("t"), F.col("df"))).collect()]
    assert got[:4] == pytest.approx([N.t_p_value(*x) for x in ((2, 10), (0.1, 3), (-30, 5), (1.5, 1e7))], abs=1e-7) and got[4:] == [0.0, None]
    one = spark.range(1).select(special.even_binomial_two_sided(43, 51).alias("m"), special.even_binomial_two_sided(0, 0).alias("none"), special.even_binomial_two_sided(5, 10).alias("even"), special.normal_two_sided(8.0).alias("z"), special.f_upper(3.0, 2, 10).alias("f"), special.beta_cdf(0.0, 1, 1).alias("low"), special.beta_cdf(1.0, 1, 1).alias("high")).first()
    assert one["m"] == pytest.approx(6.867e-07, rel=1e-3) and one["none"] is None and one["even"] == 1.0
    assert one["z"] == pytest.approx(math.erfc(8 / math.sqrt(2)), rel=1e-10) and one["f"] == pytest.approx(N.f_p_value(3, 2, 10), abs=1e-11) and (one["low"], one["high"]) == (0.0, 1.0)


def test_signed_rank_counts_all_signs_or_takes_the_normal_law(spark):
    rng = np.random.default_rng(3)
    rows = [("none", float(v)) for v in rng.permutation(np.arange(1, 13)) * rng.choice([-1, 1], 12)] + [("ties", float(v)) for v in rng.integers(-4, 6, 60)] + [("few", float(v)) for v in range(1, 5)] + [("zero", 0.0)] * 20
    got = {r["g"]: r for r in stats.signed_rank(spark.createDataFrame(rows, "g string, v double"), "v", ["g"]).collect()}
    x = np.array([v for g, v in rows if g == "none"])
    w = sum(r for r, v in zip(pd.Series(np.abs(x)).rank(), x) if v > 0)
    every = [sum(r for r, s in zip(range(1, 13), signs) if s) for signs in itertools.product((0, 1), repeat=12)]
    low = min(w, 78 - w)
    assert got["none"]["w"] == w and got["none"]["p"] == pytest.approx(min(1.0, 2 * sum(e <= low for e in every) / 4096))
    y = np.array([v for g, v in rows if g == "ties" and v])
    r = pd.Series(np.abs(y)).rank()
    ties = sum(t**3 - t for t in pd.Series(np.abs(y)).value_counts())
    assert got["ties"]["p"] == pytest.approx(N.signed_rank_p_value(float(r[y > 0].sum()), len(y), float(ties)), abs=1e-9)
    assert got["few"]["p"] is None and "zero" not in got


def test_tests_of_many_groups_are_one_plan(spark):
    rng = np.random.default_rng(4)
    rows = [(int(g), f"arm{a}", float(rng.normal(a * (g % 3)))) for g in range(300) for a in range(3) for _ in range(4)] + [(999, "arm0", 1.0), (999, "arm1", 1.0), (998, "arm0", 1.0), (998, "arm0", 1.0), (998, "arm1", 2.0), (998, "arm1", 2.0)]
    df = spark.createDataFrame(rows, "g int, arm string, v double")
    status = spark.sparkContext.statusTracker()
    before = len(status.getJobIdsForGroup())
    t, f = stats.arms_tests(df, "arm", "v", ["g"]), stats.anova(df, "arm", "v", ["g"])
    assert len(status.getJobIdsForGroup()) == before  # nothing ran
    t, f = frame(t), frame(f).set_index("g")
    assert len(t) == 300 * 3 + 1 and t[t.g == 998]["p"].tolist() == [0.0]
    pdf = pd.DataFrame(rows, columns=["g", "arm", "v"])
    for g in (0, 1, 7, 299):
        a, b = (pdf[(pdf.g == g) & (pdf.arm == k)]["v"] for k in ("arm0", "arm2"))
        pooled = (3 * a.var() + 3 * b.var()) / 6
        want = N.t_p_value((a.mean() - b.mean()) / math.sqrt(pooled / 2), 6)
        row = t[(t.g == g) & (t.a == "arm0") & (t.b == "arm2")].iloc[0]
        assert row["p"] == pytest.approx(want, abs=1e-10) and row["p_corrected"] == pytest.approx(min(1, 3 * want), abs=1e-10)
        parts = [pdf[(pdf.g == g) & (pdf.arm == k)]["v"] for k in ("arm0", "arm1", "arm2")]
        mean = np.concatenate(parts).mean()
        ratio = (sum(4 * (p.mean() - mean) ** 2 for p in parts) / 2) / (sum(3 * p.var() for p in parts) / 9)
        assert f.loc[g, "p"] == pytest.approx(N.f_p_value(ratio, 2, 9), abs=1e-10)
    assert f.loc[999, "p"] != f.loc[999, "p"]


def test_recall_interval_is_what_simulation_comes_to(spark):
    rows = [("both", True, True, True, 1.0, False)] * 30 + [("one", True, False, True, 1.0, False)] * 9 + [("one", False, True, False, 1.0, False)] * 12 + [("none", w, False, False, 4.0, True) for w in [True] * 2 + [False] * 45]
    df = spark.createDataFrame(rows, "stratum string, wrong boolean, metric boolean, judge boolean, weight double, drawn boolean")
    got = {r["grader"]: r for r in stats.grader_table(df, {"metric": F.col("metric"), "judge": F.col("judge")}, F.col("wrong"), F.col("weight"), F.col("drawn")).collect()}
    for name, caught in (("metric", 30.0), ("judge", 39.0)):
        low, high = N.posterior_recall(caught, 39.0, 47, 2, 188.0, draws=400_000)
        assert got[name]["recall_low"] == pytest.approx(low, abs=2e-3) and got[name]["recall_high"] == pytest.approx(high, abs=2e-3)
        assert got[name]["recall"] == pytest.approx(caught / (39 + 8))
    assert (got["judge"]["precision_low"], got["judge"]["precision_high"]) == pytest.approx(N.jeffreys(39, 39), abs=1e-9) and got["metric"]["flagged"] == 42
    m = stats.mcnemar(df, F.col("judge"), F.col("metric"), F.col("wrong")).first()
    assert (m["pairs"], m["only_a"]) == (21, 21) and m["p"] == pytest.approx(N.binomial_p_value(21, 21))


def test_bootstrap_cost_is_differences_times_resamples(spark):
    rng = np.random.default_rng(5)
    rows = [(bool(a), bool(b)) for a, b in zip(rng.random(30_000) < 0.6, rng.random(30_000) < 0.65)] + [(None, True)]
    df = spark.createDataFrame(rows, "a boolean, b boolean")
    r = stats.paired_bootstrap(df, F.col("a"), F.col("b"), 4000, 1).first()
    d = np.array([float(b) - float(a) for a, b in rows if a is not None])
    se = d.std() / math.sqrt(len(d))
    assert r["n"] == 30_000 and r["shift"] == pytest.approx(d.mean())
    assert r["low"] == pytest.approx(d.mean() - 1.96 * se, abs=se / 5) and r["high"] == pytest.approx(d.mean() + 1.96 * se, abs=se / 5)
    numbers = spark.createDataFrame(pd.DataFrame(rng.random((20_000, 2)), columns=["u", "v"]))
    draws = numbers.select(*(stats.poisson(F.lit(m), F.col("u"), F.col("v")).alias(f"m{i}") for i, m in enumerate((0.7, 40.0, 5000.0)))).toPandas()
    for i, m in enumerate((0.7, 40.0, 5000.0)):
        assert draws[f"m{i}"].mean() == pytest.approx(m, abs=5 * math.sqrt(m / 20_000)) and draws[f"m{i}"].var() == pytest.approx(m, rel=0.06)


def test_histogram_drops_what_is_over_the_percentile(spark):
    rng = np.random.default_rng(6)
    values = np.append(np.exp(rng.normal(2, 2, 3000)), [0.0, -1.0])
    df = spark.createDataFrame([(float(v), "ab"[i % 2]) for i, v in enumerate(values)] + [(None, "a")], "v double, s string")
    kept = values[values <= np.quantile(values, 0.9)]
    for log in (False, True):
        part = kept[kept > 0] if log else kept
        edges = np.logspace(np.log10(part.min()), np.log10(part.max()), 30) if log else np.linspace(part.min(), part.max(), 30)
        edges[0], edges[-1] = part.min(), part.max()
        want = np.histogram(part, edges)[0]
        got = {r["bin"]: r["n"] for r in aggregates.clipped_histogram(df, "v", 30, 0.9, log).collect()}
        assert [got.get(i, 0) for i in range(29)] == want.tolist()
    both = aggregates.clipped_histogram(df, "v", 30, 0.9, split="s").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    assert sum(r["n"] for r in both) == len(kept)


def test_thin_records_pool_the_lower_tail(spark):
    df = spark.createDataFrame([("x", 1, 1, 1), ("x", 1, None, None), ("x", None, None, None), ("y", 1, 1, None)], "s string, a int, b int, c int")
    got = {(r["s"], r["band"]): (r["n"], r["share"]) for r in aggregates.thin_records(df, ["a", "b", "c"], "s", 2).collect()}
    assert got == {("x", "3"): (1, 1 / 3), ("x", "2"): (0, 0.0), ("x", "1 or fewer"): (2, 2 / 3), ("y", "3"): (0, 0.0), ("y", "2"): (1, 1.0), ("y", "1 or fewer"): (0, 0.0)}


def test_frontier_needs_repeats_and_lets_equal_arms_stand(spark):
    runs = [("cheap", 1.0, 0.5), ("even", 2.0, 0.7), ("same", 2.0, 0.7), ("dear", 3.0, 0.6)]
    rows = [r for r in runs for _ in range(3)] + [("once", 0.1, 0.99), ("unpaid", None, 0.9)]
    got = {r["arm"]: r["on_frontier"] for r in aggregates.frontier(spark.createDataFrame(rows, "arm string, cost double, f1 double"), ["arm"], "cost", "f1").collect()}
    assert got == {"cheap": True, "even": True, "same": True, "dear": False}


def test_equal_arms_stay_equal_in_any_order_of_rows(spark):
    one, two = [0.1, 0.2, 0.3], [0.3, 0.2, 0.1]
    assert (0.1 + 0.2) + 0.3 != (0.3 + 0.2) + 0.1
    rows = [(arm, x, 0.5) for arm, xs in (("a", one), ("b", two)) for x in xs] + [("c", x, 0.4) for x in (1.0, 2.0, None, float("inf"), 1e-9)]
    got = {r["arm"]: r for r in aggregates.frontier(spark.createDataFrame(rows, "arm string, cost double, f1 double").coalesce(1), ["arm"], "cost", "f1").collect()}
    assert got["a"]["cost"] == got["b"]["cost"] == pytest.approx(0.2) and got["c"]["cost"] == float("inf")
    assert [got[k]["on_frontier"] for k in "abc"] == [True, True, False]


def test_small_groups_stay_in_one_range(spark, monkeypatch):
    df = spark.range(900).selectExpr("if(id % 9 = 0, if(id % 2 = 0, null, 'few'), 'most') g", "id * 7919 % 1000 / 4 x")
    seen = {r["g"]: r["n"] for r in scan.ranged(df, ["g"], "x", hot=100).groupBy("g").agg(F.countDistinct("__range").alias("n")).collect()}
    assert seen["few"] == seen[None] == 1 and seen["most"] > 50
    places = []
    for hot in (10**6, 100, 1):  # all, some and no groups in one range
        monkeypatch.setattr(scan, "HOT", hot)
        places.append(sorted(map(str, scan.positions(df, ["g"], ["x"], "at").collect() + scan.value_counts(df, "x", ["g"]).collect())))
    assert places[0] == places[1] == places[2]
