"""Spelling variants, source divergence and source mixing against brute force, with nulls, ties, repeats and empty tables."""

import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle_check import compare
from pyspark.sql import functions as F

from tallyloom.llm import divergence, mixing, spelling
from tallyloom.llm import queries as Q

SF = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, lang string, source string, word string, n long, term string, size long, rid int, value string, target string"


def table(spark, rows):
    """(doc_id, text, lang, source) with columns whose names clash with those that operators make."""
    return spark.createDataFrame([(*r, "w", 1, "t", 2, 3, "v", "x") for r in rows], DDL)


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    return a != b and (len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1 or len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b))))


def spelled(rows):
    """The contract, word by word and pair by pair."""
    lower = {i: i + 32 for i in range(65, 91)}
    held = Counter()
    for key, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            held[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    words = {w: n for w, n in held.items() if len(w) >= 7 and n >= 2}
    near = {w: [o for o in words if one_edit(w, o)] for w in words}
    best = {w: min(near[w], key=lambda o: (-words[o], o), default=None) for w in words}
    form = {w: o if o and words[o] >= 10 * words[w] else None for w, o in best.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


def found(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


@pytest.mark.parametrize("bucket", [spelling.BUCKET, 1])
def test_spelling_variants_equal_brute_force(spark, bucket):
    rng = np.random.default_rng(3)
    stems = ["".join(rng.choice(list("abcé"), rng.integers(7, 10))) for _ in range(60)]
    rows = []
    for i in range(300):
        words = []
        for _ in range(25):
            w = stems[min(int(rng.exponential(6)), 59)]
            at, kind = int(rng.integers(len(w))), int(rng.integers(12))
            words.append({0: w[:at] + w[at + 1 :], 1: w[:at] + "z" + w[at:], 2: w[:at] + "ö" + w[at + 1 :], 3: w.upper(), 4: w + w[-1]}.get(kind, w))
        rows.append((i, " ".join(words), None, None))
    rows += [(None, "aaaaaaa aaaaaaa aaaaaaaa aaaaaaaa aaaaaaab bbbbbbb", None, None), (7, None, None, None), (8, "", None, None), (9, "b" * 5000 + " " + "b" * 5001, None, None)] * 2
    want = spelled(rows)
    assert found(spelling.variants(table(spark, rows), bucket=bucket)) == want
    assert any(r[1] for r in want) and any(r[4] > 1 for r in want)
    assert spelling.variants(table(spark, [])).count() == 0


def test_forms_are_followed_to_the_last_and_ties_go_to_the_smaller(spark):
    sizes = {"carousel": 2, "carousal": 25, "carnusal": 25, "carousels": 400, "garousels": 400, "garouselt": 5000}
    rows = [(10_000 + i, " ".join([w] * n), None, None) for i, (w, n) in enumerate(sizes.items())]
    rows = [(next(k for k in itertools.count(r[0]) if zlib.crc32(f"{k}:{r[1].split()[0]}".encode()) % 31), *r[1:]) for r in rows]
    got = {r["word"]: r for r in spelling.variants(table(spark, rows)).collect()}
    assert (got["carousel"]["form"], got["carousel"]["root"], got["carousel"]["n_near"]) == ("carousels", "carousels", 2)
    assert (got["garousels"]["form"], got["garousels"]["root"], got["garousels"]["form_n"]) == ("garouselt", "garouselt", 5000)
    assert found(spelling.variants(table(spark, rows))) == spelled(rows)
    chain = spark.createDataFrame([(chr(97 + i), chr(98 + i)) for i in range(9)], "word string, form string")
    assert {tuple(r) for r in spelling.followed(chain).collect()} == {(chr(97 + i), "j") for i in range(9)}


def test_no_segment_gathers_a_vocabulary(spark):
    """3,000 words with one first half: without halving, every pair of them would be a candidate."""
    rng = np.random.default_rng(5)
    words = sorted({"commonstart" + "".join(rng.choice(list("abcdefghijklmnop"), 11)) for _ in range(3000)})
    df = spark.createDataFrame([(w, 2) for w in words] + [(words[0][:-1] + "z", 2)], "word string, n long")
    pairs, _ = spelling.near_pairs(df)
    assert [tuple(sorted((r["word"], r["other"]))) for r in pairs.collect()] == [tuple(sorted((words[0], words[0][:-1] + "z")))]


def diverging(rows, least, top=10):
    lower = {i: i + 32 for i in range(65, 91)}
    docs = [(r[2] or "", r[3] or "", [t.translate(lower) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r[1] or "")]) for r in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        kept = [t for t, n in Counter(t for d in mine for t in set(d[2])).items() if n >= least]
        counts = defaultdict(Counter)
        for _, source, terms in mine:
            counts[source].update(t for t in terms if t in kept)
        everything = sum(counts.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        q = share(everything)
        for source, c in counts.items():
            p = share(c)
            pair = {o: sum(f(p[t], share(counts[o])[t]) for t in kept) for o in counts if o != source}
            term = {t: f(p[t], q[t]) for t in kept if c[t] and p[t] > q[t]}
            for part, values in (("pair", pair), ("term", term)):
                for rank, item in enumerate(sorted(values, key=lambda x: (-values[x], x.encode())), 1):
                    if part == "pair" or rank <= top:
                        out.add((lang, source, part, item, values[item], rank))
    return out


@pytest.mark.parametrize("sizes", [{}, {"chunk": 5, "block": 2, "span": 2}])
def test_divergence_equals_brute_force(spark, sizes):
    rng = np.random.default_rng(4)
    terms = ["Der", "die", "DAS", "日本", "é", "x" * 3000, "a", "b", "c", "über", "Z"]
    rows = [(i, ", ".join(rng.choice(terms, 12)) + " 12 \x00", ["de", "fr", None][i % 3], [f"s{i % 7}", None, "ß"][i % 5 % 3]) for i in range(200)]
    rows += [(1, None, "de", "mute"), (1, "", "de", "mute"), (2, "seldom", "rare", "a"), (2, "words", "rare", "b"), (3, "alone", "single", "a")]
    got = divergence.audit(table(spark, rows), least_docs=4, **sizes)
    assert {tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect()} == diverging(rows, 4)
    assert dict(got.dtypes)["value"] == "bigint" and dict(got.dtypes)["rank"] == "int"
    assert divergence.audit(table(spark, [])).count() == 0


def test_shares_are_exact_beyond_64_bits(spark):
    df = spark.createDataFrame([(9_000_000_000_123, 9_000_000_000_999, 1_000_003), (0, 0, 0), (5, 5, 1)], "n long, total long, kept long")
    got = [r[0] for r in df.select(divergence._share(F.col("n"), F.col("total"), F.col("kept"))).collect()]
    assert got == [1 + 10**9 * (9_000_000_000_125) // (9_000_000_000_999 + 2_000_006), 1, 10**9 + 1]


@pytest.mark.parametrize("bits", [mixing.BITS, 4])
def test_mix_comes_near_its_targets(spark, bits):
    rng = np.random.default_rng(6)
    rows = [(i, "w " * int(rng.integers(0, 60)), "en", [f"s{int(rng.exponential(2))}", None][i % 6 == 0]) for i in range(2000)]
    rows += [(5, "same words here", "en", "again")] * 300 + [(None, "x y", "en", "nameless")] * 41 + [(6, None, "en", "mute"), (7, "", "en", None)]
    got = mixing.mixed(table(spark, rows), bits=bits).toPandas()
    n = Counter()
    for r in rows:
        n[r[3]] += len((r[1] or "").split())
    order = sorted((s for s in n if s is not None), key=str.encode) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    full, target = set(), {}
    while True:
        left, w = sum(n.values()) - sum(3 * n[s] for s in full), sum(weight[s] for s in order if s not in full)
        target = {s: 3 * n[s] if s in full else left * weight[s] / w for s in order}
        over = {s for s in order if target[s] > 3 * n[s] * (1 + 1e-12)}
        if not over:
            break
        full |= over
    assert len(got) == len(rows)
    source = lambda r: next(s for s in order if n[s] == r)
    assert len(set(n.values())) == len(n)  # so that a source is known by its size
    for size, g in got.groupby("source_size"):
        assert g["target"].iloc[0] == pytest.approx(target[source(size)]) and g["target"].nunique() == 1
        assert abs(g["taken"].sum() - target[source(size)]) <= max(g["size"].max() / 2, 1e-6)
    assert (got["taken"] <= 3 * got["size"]).all() and (got["taken"][got["size"] > 0] % got["size"][got["size"] > 0] == 0).all()
    again = mixing.mixed(table(spark, rows).repartition(7), bits=bits).toPandas()
    key = lambda df: sorted(df.fillna(-1).itertuples(index=False, name=None))
    assert key(again) == key(got)
    assert mixing.mixed(table(spark, [])).count() == 0


def test_smaller_mixes_are_nested(spark):
    rows = [(i, "w " * (i % 9 + 1), "en", "ab"[i % 2]) for i in range(400)]
    one, two = (mixing.mixed(table(spark, rows), weights=w).toPandas().set_index("doc_id")["taken"] for w in ((1, 3), (1, 2)))
    a = [i for i in range(0, 400, 2)]
    assert (one[a] <= two[a]).all() and one[a].sum() < two[a].sum()


@pytest.mark.parametrize("name", ["op12_source_divergence", "op13_source_mixing"])
def test_query_equals_its_sql(spark, name):
    assert compare(spark, SF, name, Q.queries()[name], Q.oracle_sql()[name]) == ""


def test_registered_spelling_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = Q.op11_spelling_variants(spark, SF)
    some = {r[0] for r in found(got)}
    assert len(some) == got.count() and dict(got.dtypes)["form_n"] == "bigint"
    few = [(i, t, None, None) for i, t in docs[:20]]
    assert found(spelling.variants(table(spark, few))) == spelled(few)
