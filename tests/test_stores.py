"""Keyed appends, calls that persist, shares of a draw and densities."""

import json
import math
import os
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.operators import density, review
from tallyloom.sources import sinks
from tallyloom.streaming import incremental


def loop_quotas(sizes, size):
    """Round after round an equal share of what is left, largest pools first."""
    left, fields = dict(sizes), sorted(sizes, key=lambda f: (-sizes[f], f))
    out = dict.fromkeys(sizes, 0)
    while size > 0 and fields:
        share = max(1, size // len(fields))
        for f in list(fields):
            take = min(share, left[f], size)
            out[f] += take
            left[f] -= take
            size -= take
            if not left[f]:
                fields.remove(f)
            if size <= 0:
                break
    return out


def test_quotas_equal_the_loop(spark):
    rng = np.random.default_rng(1)
    for _ in range(25):
        sizes = {f"f{i}": int(rng.integers(1, 60)) for i in range(int(rng.integers(1, 9)))}
        size = int(rng.integers(1, 200))
        df = spark.createDataFrame(list(sizes.items()), "f string, n int").coalesce(1)
        assert {r["f"]: r["quota"] for r in review.quotas(df, "f", "n", size).collect()} == loop_quotas(sizes, size), (sizes, size)
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else "a", i % 2) for i in range(30)], "id int, f string, filled int")
    drawn = review.equal_shares(rows, "f", ["id"], 8, 1, "filled")
    assert drawn.count() == 8 and drawn.filter("f is null").count() == 4 and drawn.filter("filled = 0").isEmpty()
    assert review.equal_shares(rows.limit(0), "f", ["id"], 8, 1).count() == 0


def test_an_append_reads_only_the_buckets_of_its_keys(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = lambda *r: spark.createDataFrame(list(r), "id string, place int, text string")
    first = sinks.append_new(rows(*((f"k{i}", 0, "x") for i in range(500)), ("k1", -1, "earlier"), (None, 0, "no key")), path, "id", order=["place"])
    assert first.count() == 500 and first.filter("id = 'k1'").first()["text"] == "earlier"
    again = sinks.append_new(rows(("k1", 0, "y"), ("new", 2, "b"), ("new", 2, "a")), path, "id", order=["place"])
    assert [tuple(r) for r in again.collect()] == [("new", 2, "a")]
    assert sinks.append_new(rows(("new", 0, "z")), path, "id").isEmpty()
    stored = sinks.appended(spark, path, first.schema)
    assert stored.count() == 501 and stored.filter("id = 'new'").count() == 1
    # an append whose keys were lost is indexed by the next one
    name = sorted(os.listdir(tmp_path / "s" / "keys"))[-1]
    os.rename(tmp_path / "s" / "keys" / name, tmp_path / "lost")
    assert sinks.append_new(rows(("new", 9, "c")), path, "id").isEmpty()
    buckets = len([d for d in os.listdir(tmp_path / "s" / "keys" / sorted(os.listdir(tmp_path / "s" / "keys"))[0]) if d.startswith("bucket=")])
    assert 100 < buckets <= sinks.BUCKETS


def test_calls_survive_a_lost_worker_and_are_paid_once(spark, tmp_path):
    source, paid, stop = tmp_path / "in", tmp_path / "paid", tmp_path / "stop"
    source.mkdir()
    paid.mkdir()
    stop.touch()
    for f in range(4):
        (source / f"{f}.json").write_text("\n".join(json.dumps({"k": f"p{f}-{i}", "text": f"ask {i}"}) for i in range(6)) + "\n" + json.dumps({"k": "p0-0", "text": "ask 0"}))
    folder, flag = str(paid), str(stop)

    def client(prompt):
        if os.path.exists(flag) and len(os.listdir(folder)) >= 9:
            os._exit(7)  # the worker is gone in the middle of a call
        open(f"{folder}/{prompt.split()[1]}-{uuid.uuid4().hex}", "w").close()
        if prompt == "ask 5":
            raise ValueError("refused")
        return f"reply to {prompt}"

    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("text", T.StringType())])
    args = (spark, str(source), schema, "k", "text", client, str(tmp_path / "out"), str(tmp_path / "mark"))
    with pytest.raises(Exception):  # noqa: B017, PT011  whatever Spark says when a worker dies
        incremental.persisted_calls(*args, at_once=3, attempts=1).awaitTermination()
    before = len(os.listdir(folder))
    kept = spark.read.parquet(f"{args[6]}/replies/*").count()
    assert 0 < kept < 20 and before == 9
    stop.unlink()
    incremental.persisted_calls(*args, at_once=3, attempts=1).awaitTermination()
    replies, errors = (spark.read.parquet(f"{args[6]}/{x}/*") for x in ("replies", "errors"))
    assert replies.count() == 20 == replies.select("k").distinct().count()  # 24 prompts, of which 4 are refused
    assert errors.select("k").distinct().count() == 4 and errors.filter("error not like '%refused%'").isEmpty()
    assert len(os.listdir(folder)) <= 24 + 2 * 3  # the calls in flight when the worker died, and refused ones of its batch
    incremental.persisted_calls(*args, at_once=3, attempts=1).awaitTermination()
    assert replies.count() == 20


def test_the_region_holds_its_share_and_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(50, 9, 3000), rng.normal(20, 4, 3000)
    y += 0.3 * (x - 50)
    rows = [("a", float(p), float(q)) for p, q in zip(x, y)] + [("line", float(i), 2.0 * i) for i in range(20)] + [("one", 1.0, 1.0), ("a", None, 1.0), ("a", float("nan"), 1.0)]
    got = density.plane(spark.createDataFrame(rows, "g string, x double, y double"), "x", "y", (0, 100), (0, 40), ["g"], 50).toPandas()
    assert set(got["g"]) == {"a"}
    assert got["density"].sum() * 2.0 * 0.8 == pytest.approx(1, abs=1e-3)
    inside = got[got["inside"]]
    assert 0.9 <= inside["n"].sum() / 3000 < 0.92 and inside["density"].min() >= got[~got["inside"]]["density"].max()
    cx, cy = np.floor(x / 2) * 2 + 1, np.floor(y / 0.8) * 0.8 + 0.4
    inverse = np.linalg.inv(np.cov(x, y) * 3000 ** (-1 / 3))
    for _, r in got.sample(30, random_state=1).iterrows():
        d = np.stack([2 * r["i"] + 1 - cx, 0.8 * r["j"] + 0.4 - cy])
        q = np.einsum("in,ij,jn->n", d, inverse, d)
        want = np.exp(-q[q <= 36] / 2).sum() * math.sqrt(np.linalg.det(inverse)) / (2 * math.pi * 3000)
        assert r["density"] == pytest.approx(want, rel=1e-6)


def test_each_curve_is_its_own_distribution(spark):
    rng = np.random.default_rng(3)
    rows = [("big", float(v)) for v in rng.normal(40, 5, 4000)] + [("small", float(v)) for v in rng.normal(60, 8, 50)] + [("flat", 5.0)] * 9 + [("big", 8000.0)]
    got = density.curve(spark.createDataFrame(rows, "g string, v double"), "v", (0, 100), ["g"], 200).toPandas()
    assert set(got["g"]) == {"big", "small"}
    for _, part in got.groupby("g"):
        assert part["density"].sum() * 0.5 == pytest.approx(1, abs=0.01)
    assert got[got.g == "big"].sort_values("density")["at"].iloc[-1] == pytest.approx(40, abs=1.5)


def test_eligible_and_fresh(spark):
    df = spark.createDataFrame([(1, 1, 1, "x"), (2, 1, None, "x"), (3, 1, 1, None), (4, 1, 1, "y")], "k int, a int, b int, c string")
    assert [r["k"] for r in review.eligible(df, ["a", "b"], 2, [F.col("c") == "x"]).collect()] == [1]
    decisions = spark.createDataFrame([(1, ["u", "v"]), (2, ["u"]), (3, ["w"]), (4, None), (5, ["u", "u"])], "k int, by array<string>")
    answers = spark.createDataFrame([(1, "u", True), (1, "v", True), (2, "u", True), (2, "v", False), (3, "u", True), (5, "u", True), (5, "u", None)], "k int, who string, carried boolean")
    assert {r["k"]: r["fresh"] for r in review.decided_fresh(decisions, answers, ["k"], "by", "who", "carried").collect()} == {1: False, 2: False, 3: True, 4: True, 5: True}
