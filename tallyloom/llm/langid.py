"""Language identification by bit-sliced Bloom filters of character n-grams.

Learning: Spark counts the four-grams of letters inside words of each language.  A language has a gram if the gram's share of
its grams is at least ``1 / NOISE`` of the largest share that it has in any language, so a few foreign words in texts of a language
do not teach it theirs, whatever the size of the corpus; every gram is in some filter.  All languages share one
table of slots of eight bits (a plane for each eight languages): the slot at each of a gram's ``HASHES`` hashes
has the bit of every language that has it, so one probe of a gram, the AND of its slots, gives the mask of all languages
that hold it.  The table has at least ``ROOM`` slots for each gram of the language with the most, which keeps the rate of false hits
under 0.03 whatever the corpus.  Tasks set the bits of the grams that Spark finds, and Spark ORs the set words of the
table, so the driver gets the table and no grams.  Four letters make a bounded number of grams in an alphabet; a
table of more than ``MOST_BYTES`` is an error and not a worse filter.

Deciding: a text's grams are counted by language over the masks.  If a share f of a language's slots is set, a
gram it lacks still hits with probability f ** HASHES; the hits are corrected to the share of grams that the
language really holds, (hits - n fp) / (n (1 - fp)).  The largest share wins, ties to the smaller name.

Defined results: ``und`` with score 0 if a text is null, has no letter, or nothing was learned; rows without a
language or text teach nothing; a null id counts as the empty text, whose remainder is 0; repeated rows and ids
are predicted one by one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._arrow import with_columns
from ._grams import distinct_words, gram_counts
from ._io import release, stored, text_column

ORDER, BITS = 4, 16
HASHES = 4
NOISE = 10.0
#: Slots a gram, the least number of slots, and the largest table that is sent to workers.
ROOM, LEAST_SLOTS, MOST_BYTES = 8, 1 << 16, 1 << 31


def slots_for(grams: int, room: float = ROOM) -> int:
    """The power of two from ``room`` slots a gram on."""
    return max(LEAST_SLOTS, 1 << (max(1, int(grams * room)) - 1).bit_length())


def slots_of(grams: np.ndarray, k: int, slots: int) -> np.ndarray:
    """The slot of each gram by the k-th hash; ``slots`` is a power of two."""
    return (T.mix(grams ^ np.uint64(0xA0761D6478BD642F * (k + 1) % (1 << 64))) >> np.uint64(64 - (slots.bit_length() - 1))).astype(np.int64)


class MaskFilter:
    """Bit-sliced Bloom filters: ``table[plane, slot]`` holds a bit for each of eight languages."""

    def __init__(self, langs: list[str], table: np.ndarray):
        self.langs, self.table = langs, table
        fill = [np.count_nonzero(table[i // 8] >> (i % 8) & 1) / table.shape[1] for i in range(len(langs))]
        self.false_hits = np.array(fill) ** HASHES

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """For each plane, the mask of languages that hold each gram."""
        slots = [slots_of(grams, k, self.table.shape[1]) for k in range(HASHES)]
        return np.stack([np.bitwise_and.reduce([plane[s] for s in slots]) for plane in self.table])

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        w, first, inverse, _ = distinct_words(texts, letters=True)
        n = np.bincount(w.text, w.ends - w.starts + 1, len(texts))
        if not len(first):
            return ["und"] * len(texts), np.zeros(len(texts))
        grams, _ = T.char_grams(w.codes, w.starts[first], w.ends[first], ORDER, BITS)
        lengths = w.ends[first] - w.starts[first] + 1
        begin = np.cumsum(lengths) - lengths
        masks = self.masks(grams)
        share = np.empty((len(self.langs), len(texts)))
        for i, fp in enumerate(self.false_hits):
            bit = masks[i // 8] >> (i % 8) & 1
            hits = np.bincount(w.text, np.add.reduceat(bit.astype(np.int64), begin)[inverse], len(texts))
            share[i] = (hits - n * fp) / np.maximum(n * (1 - fp), 1e-9)
        best = share.argmax(0)
        score = np.where(n > 0, np.clip(share[best, np.arange(len(texts))], 0, 1), 0.0)
        return [self.langs[b] if k else "und" for b, k in zip(best, n)], score


def learn(rows: DataFrame, lang: str = "lang", text: str = "text", room: float = ROOM) -> MaskFilter:
    """The filters of the languages in ``rows``; null texts and languages teach nothing."""
    read = rows.select(rows[lang].cast("string").alias("lang"), rows[text].cast("string").alias("text")).dropna()
    counts = stored(gram_counts(read, letters=True, order=ORDER, bits=BITS))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    langs = [r["lang"] for r in totals.orderBy("lang").collect()]  # one row a language
    shares = stored(counts.join(totals, "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("share")))
    most = shares.groupBy("gram").agg(F.max("share").alias("most"))
    grams = stored(shares.join(most, "gram").filter(F.col("share") * NOISE >= F.col("most")).select("lang", "gram"))
    slots = slots_for(max((r["count"] for r in grams.groupBy("lang").count().collect()), default=0), room)  # one row a language
    planes = max(1, -(-len(langs) // 8))
    if planes * slots > MOST_BYTES:
        raise ValueError(f"filters of {len(langs)} languages need {planes} times {slots} bytes, more than {MOST_BYTES}: learn fewer languages at once")
    number = {lang: i for i, lang in enumerate(langs)}

    def set_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = np.array([number[x] for x in b["lang"].to_pylist()], np.int64)
            keys = b["gram"].to_numpy().view(np.uint64)
            at = np.concatenate([(own // 8) * slots + slots_of(keys, k, slots) for k in range(HASHES)])
            bits = np.tile(np.uint64(1) << (own % 8).astype(np.uint64), HASHES) << (at % 8 * 8).astype(np.uint64)
            order = np.argsort(at // 8, kind="stable")
            words, bits = (at // 8)[order], bits[order]
            first = np.flatnonzero(np.append(True, words[1:] != words[:-1])) if len(words) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(words[first]), pa.array((np.bitwise_or.reduceat(bits, first) if len(words) else bits).view(np.int64))], ["word", "bits"])

    words = grams.mapInArrow(set_words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most the table
    table = np.zeros(planes * slots // 8, np.uint64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    release(counts, shares, grams)
    return MaskFilter(langs, table.view(np.uint8).reshape(-1, slots))


def predict(docs: DataFrame, filters: MaskFilter, text: str = "text") -> DataFrame:
    """``docs`` without ``text`` and with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def make(b: pa.RecordBatch) -> dict:
        texts = [t or "" for t in b[text].to_pylist()]
        langs, scores = [], []
        for s in T.slices(texts):
            found = shared.value.predict(texts[s])
            langs += found[0]
            scores.append(found[1])
        return {"lang_pred": langs, "score": np.concatenate(scores) if scores else []}

    return with_columns(docs, (text,), "lang_pred string, score double", make)


def identify(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learn from the rows whose crc32(id) mod 5 is not 0 and predict all: id, held_out, lang_pred, score."""
    out = F.crc32(F.coalesce(docs[id].cast("string"), F.lit("")).cast("binary")) % 5 == 0
    filters = learn(docs.filter(~out), lang, text)
    rows = docs.select(docs[id], out.alias("held_out"), text_column(docs, text).alias("_text"))
    return predict(rows, filters, "_text")
