"""Quality rules: fixed counts, and perplexity bands for each language under a character n-gram model.

The model is an interpolated modified Kneser-Ney model of character five-grams inside words (the end of a word is
predicted too).  Spark counts the five-grams of *all* texts; lower orders use continuation counts, and each order
has the three discounts of its own counts of counts.  One model serves all languages, so that a text which mixes them
is not odd; the bands are those of its ``lang`` (null counts as a language of its own, ``""``).  A five-gram that occurs
once in the corpus is scored as the rest of the corpus would, so that no text is judged by what only it has taught.

Every five-gram of the texts was counted, so its log probability is all that scoring needs.  These are kept as arrays
sorted by the gram's 64-bit hash (a bijection, so equal hash means equal gram) and looked up by binary search.  They
reach the tasks in blocks of about ``BLOCK`` grams, each in a pass of its own over the texts, whose partial sums Spark adds:
no task, and not the driver, ever holds more than a block (16 bytes a gram), however large the model grows.

A text has two perplexities: for each symbol and for each word.  Symbols stuck to words make words dear;
lists of words between separators make words cheap and symbols dear.  The bands of a language lie the deviations in
``BANDS`` below and above the median over all its texts that pass the fixed rules; the deviation is the one observed
(from quartiles), wider for short texts, whose means vary more.  A text outside any band is rejected.

Defined results: a null text counts as empty (no words, so it fails the fixed rules); texts that fail them get
no verdict from the model; a language with fewer than ``SPREAD_TEXTS`` other texts shows no spread, so its bands are null
and reject nothing; repeated rows and ids are judged one by one; an empty table gives an empty result; other columns are
passed on by ``keep`` and not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._arrow import with_columns
from ._grams import distinct_words, gram_counts
from ._io import numbered, release, stored, text_column

ORDER, BITS = 5, 12
MIN_WORDS = 10
REPEAT_PERCENT = 20
#: Deviations from the median to the lower and upper band of each perplexity.
BANDS = {"symbol": (6.0, 3.5), "word": (3.5, 6.0)}
SHORT_WORDS = 50.0  # words at which the bands are sqrt(2) times as wide
LEAST_SPREAD = 1e-3
SPREAD_TEXTS = 20
#: Grams of the model that are held at once.
BLOCK = 4_000_000
_SPREAD = np.uint64(0x9E3779B97F4A7C15)  # odd: a bijection of 64-bit integers
_SYMBOLS = np.zeros(128, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
ADDED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, symbols long, log_p double"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_counts(w: T.Words) -> dict[str, np.ndarray]:
    """The fixed counts of each text of a slice."""
    n = len(w.text_ends)
    begin = np.append(0, w.text_ends[:-1])
    symbol = _SYMBOLS[np.minimum(w.codes, 127)] & (w.codes < 128)
    breaks = np.flatnonzero(w.codes == 10)
    first = np.append(0, breaks[:-1] + 1)
    full = np.searchsorted(w.starts, breaks) > np.searchsorted(w.starts, first)
    first, breaks = first[full], breaks[full]
    owner = np.searchsorted(w.text_ends, first, side="right")
    keys = T.mix(T.run_hashes(w.codes, first, breaks) ^ T.mix(owner))
    _, distinct = np.unique(keys, return_index=True)
    at, hashes = T.windows_of(w, 5)
    keys = T.mix(hashes ^ T.mix(w.text[at]))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(w.starts) + 1, np.int32)
    cover[at[twice]] += 1
    cover[at[twice] + 5] -= 1
    repeated = np.cumsum(cover[:-1]) > 0
    return {
        "n_words": w.counts.astype(np.int64),
        "word_chars": np.bincount(w.text, (w.ends - w.starts), n).astype(np.int64),
        "n_symbols": np.add.reduceat(symbol, begin, dtype=np.int64) if n else np.empty(0, np.int64),
        "n_dup_lines": np.bincount(owner, minlength=n) - np.bincount(owner[distinct], minlength=n),
        "n_repeat_words": np.bincount(w.text[repeated], minlength=n).astype(np.int64),
    }


def _low(key: F.Column, order: int) -> F.Column:
    return key.bitwiseAND(F.lit((1 << BITS * order) - 1))


def _discount(counts: DataFrame) -> F.Column:
    """What is taken off a count n, from the counts of counts of all rows."""
    got = counts.agg(*(F.count_if(F.col("n") == i) for i in (1, 2, 3, 4))).first()
    y = got[0] / (got[0] + 2 * got[1]) if got[0] else 0.0
    d = [min(max(i - (i + 1) * y * got[i] / got[i - 1] if got[i - 1] else i / 2, 0.1), i - 0.1) for i in (1, 2, 3)]
    return F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])


def kneser_ney(grams: DataFrame, leave_out: bool = True) -> DataFrame:
    """(key, value), stored: the log probability of the last character of each gram of ``grams`` (key, n) after the others.

    With ``leave_out`` a gram that occurs once in the corpus gets the probability that the rest of the corpus gives it.
    """
    counts = {ORDER: stored(grams.select("key", "n"))}
    for o in range(ORDER - 1, 0, -1):
        counts[o] = stored(counts[o + 1].groupBy(_low(F.col("key"), o).alias("key")).agg(F.count(F.lit(1)).alias("n")))
    below = None
    for o in range(1, ORDER + 1):
        rows = counts[o].withColumns({"ctx": F.shiftrightunsigned("key", BITS), "cut": _discount(counts[o])})
        sums = rows.groupBy("ctx").agg(F.sum("n").alias("all"), F.sum("cut").alias("freed"))
        rows = rows.join(sums, "ctx")
        if below is None:
            rows = rows.withColumns({"p_low": F.lit(1.0 / (counts[o].count() + 1)), "q_low": F.lit(1.0 / (counts[o].count() + 1))})
        else:
            rows = rows.withColumn("low", _low(F.col("key"), o - 1)).join(below.select(F.col("key").alias("low"), F.col("p").alias("p_low"), F.col("q").alias("q_low")), "low")
        weight = F.col("freed") / F.col("all")
        p = (F.col("n") - F.col("cut")) / F.col("all") + weight * F.col("p_low")
        q = F.when(F.col("n") > 1, p).when(F.col("all") > 1, weight * F.col("q_low")).otherwise(F.col("q_low"))
        before, below = below, stored(rows.select("key", p.alias("p"), q.alias("q")))
        release(*([before] if before is not None else []), counts[o])
    return below.select("key", F.log("q" if leave_out else "p").alias("value"))


class SortedBlock:
    """Log probabilities of a block of grams in arrays sorted by hash; other grams count as 0."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        hashes = keys.view(np.uint64) * _SPREAD
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], values[order]

    def log_p(self, grams: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(grams))
        hashes = grams * _SPREAD
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.values[at], 0.0)


def _scored(texts: list[str], block: SortedBlock, counted: bool) -> dict[str, np.ndarray]:
    """Sum of the log probabilities of a block and, in the first pass, fixed counts and symbols of each text of a slice."""
    w, first, inverse, _ = distinct_words(texts)
    n, lengths = len(texts), w.ends[first] - w.starts[first] + 1
    out = base_counts(w) | {"symbols": np.bincount(w.text, w.ends - w.starts + 1, n).astype(np.int64)} if counted else {}
    out["log_p"] = np.zeros(n)
    if len(first):
        grams, _ = T.char_grams(w.codes, w.starts[first], w.ends[first], ORDER, BITS)
        by_word = np.add.reduceat(block.log_p(grams), np.cumsum(lengths) - lengths)
        out["log_p"] = np.bincount(w.text, by_word[inverse], n)
    return out


def _pass(rows: DataFrame, block: SortedBlock, counted: bool) -> DataFrame:
    """``rows`` with what ``_scored`` says of _text instead of it, stored."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def make(b: pa.RecordBatch) -> dict:
        texts = b["_text"].to_pylist()
        parts = [_scored(texts[s], shared.value, counted) for s in T.slices(texts)]
        return {k: np.concatenate([p[k] for p in parts]) if parts else [] for k in (*BASE, "symbols", "log_p")[0 if counted else -1 :]}

    out = stored(with_columns(rows, ("_text",), ADDED if counted else "log_p double", make))
    shared.destroy()
    return out


def _base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def scores(rows: DataFrame) -> DataFrame:
    """rid, _id, _lang, the counts, and symbol and word (negative mean log probabilities) of ``rows`` (rid, _id, _text, _lang), stored."""
    counted = gram_counts(rows.select(F.lit("").alias("lang"), F.col("_text").alias("text")), order=ORDER, bits=BITS)
    model = kneser_ney(counted.select(F.col("gram").alias("key"), "n"))
    blocks = max(1, -(-model.count() // BLOCK))
    made = []
    for i in range(blocks):
        part = model.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == i).toArrow()  # a block at a time
        of = rows.select("rid", "_text", *([] if made else ["_id", "_lang"]))
        made.append(_pass(of, SortedBlock(part["key"].to_numpy(), part["value"].to_numpy()), not made))
    sums = made[0].select("rid", "log_p")
    for more in made[1:]:
        sums = sums.unionByName(more)
    sums = sums.groupBy("rid").agg(F.sum("log_p").alias("log_p"))
    out = made[0].drop("log_p").join(sums, "rid")
    out = stored(out.withColumns({"symbol": F.when(F.col("symbols") > 0, -F.col("log_p") / F.col("symbols")), "word": F.when(F.col("n_words") > 0, -F.col("log_p") / F.col("n_words"))}))
    release(*made)
    return out


def judged(rows: DataFrame) -> DataFrame:
    """``scores`` of ``rows`` with base_failed, kept and the bands (logarithms) each text is held to."""
    scored = scores(rows)
    fit = scored.filter(~_base_failed())
    quartiles = [F.percentile_approx(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(10_000)).alias(c) for c in BANDS]
    fit = fit.groupBy("_lang").agg(F.count(F.lit(1)).alias("texts"), *quartiles).filter(F.col("texts") >= SPREAD_TEXTS)
    unit = lambda c: F.greatest((F.col(c)[2] - F.col(c)[0]) / 1.349, F.lit(LEAST_SPREAD))
    bands = stored(fit.select("_lang", *(x for c in BANDS for x in (F.col(c)[1].alias(f"{c}_middle"), unit(c).alias(f"{c}_unit")))))
    out, inside = scored.join(bands, "_lang", "left").withColumn("base_failed", F.coalesce(_base_failed(), F.lit(True))), F.lit(True)
    wider = F.sqrt(1 + SHORT_WORDS / F.greatest(F.col("n_words"), F.lit(1)))
    for c, (below, above) in BANDS.items():
        out = out.withColumns({f"{c}_lower": F.col(f"{c}_middle") - below * F.col(f"{c}_unit") * wider, f"{c}_upper": F.col(f"{c}_middle") + above * F.col(f"{c}_unit") * wider})
        inside &= F.coalesce(F.col(c).between(F.col(f"{c}_lower"), F.col(f"{c}_upper")), F.lit(True))
    return out.withColumn("kept", ~F.col("base_failed") & inside)


def judge(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """A verdict for every row: id, the fixed counts, base_failed, kept, both perplexities, and the bands they were held to."""
    rows = numbered(docs, docs[id].alias("_id"), text_column(docs, text).alias("_text"), F.coalesce(docs[lang].cast("string"), F.lit("")).alias("_lang"))
    said = [F.exp(c + end).alias(c + (end or "_perplexity")) for c in BANDS for end in ("", "_lower", "_upper")]
    out = judged(rows).select(F.col("_id").alias(id), *BASE, "base_failed", "kept", *said)
    release(rows)
    return out


def keep(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns."""
    rows = numbered(docs, *(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)))
    own = {c: F.col(f"_c{i}") for i, c in enumerate(docs.columns)}
    read = rows.select("rid", own[id].alias("_id"), F.coalesce(own[text].cast("string"), F.lit("")).alias("_text"), F.coalesce(own[lang].cast("string"), F.lit("")).alias("_lang"))
    return rows.join(judged(read).filter("kept").select("rid"), "rid", "left_semi").select(*(x.alias(c) for c, x in own.items()))
