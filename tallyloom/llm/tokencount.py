"""Token counts under a unigram model, by dynamic programming over a trie of distinct pre-tokens.

A pre-token is ``▁`` and a word of ``[^\\x20\\x09-\\x0D]+``.  Its tokens are the pieces of the segmentation with
the highest sum of piece scores; of several, the one with the fewest pieces.  The best score and count up to a
place depend on the characters before it alone, so distinct pre-tokens are walked in sorted order, which is the
depth-first order of their trie: the forward scores of a shared prefix are computed once and stay on a stack, and the
count at the end of each pre-token is stored.  A character that no piece covers costs its UTF-8 bytes, one token each.

Vocabulary files come without unigram probabilities, so these are fitted: Spark counts the distinct words of the whole
corpus and range-partitions them, so a task walks one part of the corpus' trie; the pieces of the best segmentations,
times the words' counts, are summed by piece (at most one row a piece for the driver), and a piece scores the log of its
share, one added to each count.  ``ROUNDS`` rounds start from Zipf's law by rank (hard expectation maximisation).

Texts are then counted in place: a task walks the trie of the words that are new to it and remembers their counts,
since a join of every word with a table of counts would shuffle the corpus.

Defined results: a null or empty text has no tokens; a word's count is remembered in bounded memory and
computed again after that; a corpus without words leaves the scores of the start; every row gives one row, repeated or
not; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import with_columns
from ._io import release, stored, text_column

RANK_SHIFT = 2.7
MEMO_WORDS = 400_000
ROUNDS = 2
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Unigram:
    def __init__(self, scores: dict[str, float], byte_score: float):
        self.scores, self.byte_score = scores, byte_score
        self.ends: dict[str, float | None] = {p[i:]: None for p in scores for i in range(1, len(p))}  # the ends of pieces
        self.ends.update(scores)
        self.known: dict[str, int] = {}

    @staticmethod
    def from_pieces(path: str) -> Unigram:
        """Pieces of a sentencepiece file by rank; bytes score below every piece."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(sp.vocab_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        return Unigram({sp.id_to_piece(i): -math.log(r + RANK_SHIFT) for r, i in enumerate(plain, 1)}, -2 * math.log(sp.vocab_size()))

    def walk(self, words: list[str]) -> Iterator[tuple[str, int, list[int]]]:
        """(word, tokens, where the last piece before each place starts) of distinct words by one walk over their trie.

        The list is the walk's own stack, to be read before the next word; a byte fallback is the complement of its start.
        """
        get, byte_score = self.ends.get, self.byte_score
        best, count, back, path = [0.0], [0], [0], ""
        for word in sorted(words):
            token = "▁" + word
            shared, most = 0, min(len(path), len(token))
            while shared < most and path[shared] == token[shared]:
                shared += 1
            del best[shared + 1 :], count[shared + 1 :], back[shared + 1 :]
            for end in range(shared + 1, len(token) + 1):
                n_bytes = len(token[end - 1].encode("utf-8", "surrogatepass"))
                top, fewest, last = best[end - 1] + n_bytes * byte_score, count[end - 1] + n_bytes, -end
                for start in range(end - 1, -1, -1):
                    score = get(token[start:end], False)
                    if score is False:  # no piece ends like this, so no longer one does
                        break
                    if score is not None:
                        score += best[start]
                        if score > top or score == top and count[start] + 1 < fewest:
                            top, fewest, last = score, count[start] + 1, start
                best.append(top)
                count.append(fewest)
                back.append(last)
            yield word, count[-1], back
            path = token

    def trie_counts(self, words: list[str]) -> dict[str, int]:
        """Token counts of distinct words."""
        return {word: n for word, n, _ in self.walk(words)}

    def piece_counts(self, words: dict[str, int]) -> Counter[str]:
        """How often each piece is in the best segmentations of ``words``, which occur so many times."""
        out: Counter[str] = Counter()
        for word, _, back in self.walk(list(words)):
            token, end, n = "▁" + word, len(word) + 1, words[word]
            while end:
                start = back[end]
                if start >= 0:
                    out[token[start:end]] += n
                end = start if start >= 0 else ~start
        return out

    def fitted(self, counts: dict[str, int]) -> Unigram:
        """The same pieces with the log of their shares of ``counts``, one added to each."""
        total = sum(counts.values()) + len(self.scores)
        return Unigram({p: math.log((counts.get(p, 0) + 1) / total) for p in self.scores}, -2 * math.log(total))

    def count_texts(self, texts: list[str]) -> tuple[list[int], list[int]]:
        """(pre-tokens, tokens) of each text."""
        words = [_WORD.findall(t) for t in texts]
        if len(self.known) > MEMO_WORDS:
            self.known.clear()
        known = self.known
        new = {w for ws in words for w in ws if w not in known}
        known.update(self.trie_counts(list(new)))
        return [len(ws) for ws in words], [sum(map(known.__getitem__, ws)) for ws in words]


def word_counts(docs: DataFrame, text: str = "_text") -> DataFrame:
    """(word, n) of all texts: partial counts in tasks, sums by a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        row = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        for b in batches:
            for t in b[text].to_pylist():
                held.update(_WORD.findall(t))
                if len(held) > MEMO_WORDS:
                    yield row()
                    held.clear()
        yield row()

    return docs.select(text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, start: Unigram, rounds: int = ROUNDS, text: str = "_text") -> Unigram:
    """``start`` with the scores that ``rounds`` rounds over the words of ``docs`` give."""
    words = stored(word_counts(docs, text).repartitionByRange("word").sortWithinPartitions("word"))
    model = start
    for _ in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = shared.value.piece_counts(dict(zip(b["word"].to_pylist(), b["n"].to_pylist())))
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["piece", "n"])

        found = words.mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()  # at most one row a piece
        if not found.num_rows:
            break
        model = model.fitted(dict(zip(found["piece"].to_pylist(), found["n"].to_pylist())))
    release(words)
    return model


def token_counts(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """id, n_pretokens, n_tokens of every whole text under the pieces of ``path``, with scores fitted to ``docs``."""
    from ._text import slices

    rows = docs.select(docs[id], text_column(docs, text).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(fit(rows, Unigram.from_pieces(path), rounds))

    def make(b: pa.RecordBatch) -> dict:
        texts, model = b["_text"].to_pylist(), shared.value
        parts = [model.count_texts(texts[s]) for s in slices(texts)]
        return {"n_pretokens": [n for p in parts for n in p[0]], "n_tokens": [n for p in parts for n in p[1]]}

    return with_columns(rows, ("_text",), "n_pretokens long, n_tokens long", make)
