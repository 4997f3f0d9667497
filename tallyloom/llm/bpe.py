"""BPE encoding with content-defined chunk reuse, and decoding.

A text is cut where a rolling hash over its characters says so, so equal passages of different documents are
cut alike.  Each distinct chunk is encoded once while a worker remembers it; what the cut may have changed,
the word that straddles it, is encoded again, widened until white space stands on both sides.  Both supported
pre-tokenizers never join or look across the boundary in front of a word, so there the two encodings agree
exactly and the repair ends.

Defined results: a null text counts as empty and gives no tokens; every input row gives one output row, so
repeated rows and repeated or null ids give repeated rows; an empty table gives an empty result; columns other
than the id and the text are not read.  Texts are never cut short: chunks and words are remembered within a
bounded memory, and one text is held at a time.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _text as T
from ._arrow import with_columns
from ._io import text_column

MEMO_WORDS = 800_000
MEMO_CHARS = 4_000_000
CHUNK_CHARS = 256  # mean
CHUNK_LEAST = 32
WINDOW = 16
_END = b"\xff"  # never part of UTF-8; stands for the end-of-word mark
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
#: Latin letters, and ASCII punctuation but the apostrophe and the underscore.
_L, _P = "A-Za-zÀ-ÖØ-öø-ɏ", r"!-&(-/:-@\[-\^`{-~"
#: Text whose pre-tokens are plain: runs of letters, runs of punctuation, single line ends between them.
_PLAIN = re.compile(rf"(?!\n)(?:[{_L}{_P}]|\n(?!\n|\Z))+")
_PARTS = re.compile(rf"[{_L}]+|[{_P}]+|\n")


class Memo(dict):
    """What ``make`` gives for each key, remembered."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        found = self[key] = self.make(key)
        return found


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 stays, other bytes follow from 256 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + n): b for n, b in enumerate(hidden)}


class WordEncoder:
    """Encodes words of one vocabulary file exactly as the tokenizers library does, and remembers them.

    Plain words go straight to a byte-pair merge over the file's own ranks (only if each merge's rank is its
    id's order, which is checked); any other word, and any special token, goes through the library.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        model, self.chunks, self.chunk_chars = spec["model"], {}, 0
        self.suffix = model.get("end_of_word_suffix") or ""
        self.words = Memo(self._new if self.suffix else self._new_spaced)
        vocab, letters = model["vocab"], byte_alphabet()
        ids = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        base = len(set(vocab) - set(self.special)) - len(ids)  # ids of single bytes come first, then merges in order
        ordered = ids == list(range(base, base + len(ids)))
        self.piece = None
        if ordered:
            ranks = {}
            for token, i in vocab.items():
                if token not in self.special:
                    whole = bool(self.suffix) and token.endswith(self.suffix)
                    ranks[bytes(letters[c] for c in (token[: -len(self.suffix)] if whole else token)) + _END * whole] = i
            self.piece = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.tokens: list[bytes] = [b""] * self.tokenizer.get_vocab_size(with_added_tokens=True)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.tokens[i] = token.encode()
        self.plain_decoder = spec.get("decoder") is None

    def _library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _pieces(self, pieces: Iterator[bytes]) -> bytes:
        out: list[int] = []
        for p in pieces:
            out += self.piece(p)
        return array("I", out).tobytes()

    def _new(self, word: str) -> bytes:
        """For files that mark the end of a word: a word without white space."""
        if self.piece is not None and word.isascii() and word.isalpha():
            return array("I", self.piece(word.lower().encode() + _END)).tobytes()
        if self.piece is None or "İ" in word or not _PLAIN.fullmatch(word) or any(t in word for t in self.special):
            return self._library(word)
        return self._pieces(p.lower().encode() + _END for p in _PARTS.findall(word))

    def _new_first(self, word: str) -> bytes:
        """For byte-level files: what stands before the first single space."""
        if self.piece is None or not _PLAIN.fullmatch(word):
            return self._library(word)
        return self._pieces(p.encode() for p in _PARTS.findall(word))

    def _new_spaced(self, word: str) -> bytes:
        """For byte-level files: a word with the space before it."""
        if self.piece is not None and word.isalpha():
            return array("I", self.piece(b" " + word.encode())).tobytes()
        if self.piece is None or not _PLAIN.fullmatch(word):
            return self._library(" " + word)
        first, *rest = _PARTS.findall(word)
        return self._pieces([b" " + first.encode(), *(p.encode() for p in rest)])

    def _joined(self, words: list[str]) -> bytes:
        if len(self.words) > MEMO_WORDS:
            self.words.clear()
        return b"".join(map(self.words.__getitem__, words))

    def encode_spaced(self, text: str) -> bytes:
        """Ids of a whole text under a byte-level file, as little-endian 32-bit integers.

        The boundary before " x" (one space, then no white space) is one of the pre-tokenizer, so words split
        at single spaces are encoded apart.  Texts with other runs of spaces or with special tokens are not.
        """
        if not text:
            return b""
        if self.suffix or text[-1] == " " or "  " in text or any(t in text for t in self.special):
            return self._library(text)
        first, *rest = text.split(" ")
        return (self._new_first(first) if first else b"") + self._joined(rest)

    def _chunk(self, chunk: str) -> tuple[str, bytes | None, str]:
        """(word begun before the chunk, ids of the words inside or None if no white space, word not ended)."""
        found = self.chunks.get(chunk)
        if found is None:
            pieces = _SPACE.split(chunk)
            found = (chunk, None, "") if len(pieces) == 1 else (pieces[0], self._joined(pieces[1:-1]), pieces[-1])
            if self.chunk_chars > MEMO_CHARS:
                self.chunks.clear()
                self.chunk_chars = 0
            self.chunks[chunk] = found
            self.chunk_chars += len(chunk)
        return found

    def encode_chunked(self, text: str) -> bytes:
        """Ids of a whole text under a file whose pre-tokenizer drops white space, by chunks."""
        if not self.suffix:
            return self._library(text)
        out, open_word = [], ""
        for chunk in chunks_of(text):
            head, inside, tail = self._chunk(chunk)
            open_word += head
            if inside is not None:  # white space: the straddling word is whole and is encoded again
                if open_word:
                    out.append(self._joined([open_word]))
                out.append(inside)
                open_word = tail
        if open_word:
            out.append(self._joined([open_word]))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the library's ``decode(ids, skip_special_tokens=False)``."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        if self.plain_decoder:  # the library then joins tokens by a space
            return b" ".join(map(self.tokens.__getitem__, numbers))
        return self.tokenizer.decode(numbers, skip_special_tokens=False).encode()


def cut_points(text: str, window: int = WINDOW, mean: int = CHUNK_CHARS, least: int = CHUNK_LEAST) -> list[int]:
    """Places where the rolling hash of the ``window`` characters before them is 0 modulo ``mean``."""
    if len(text) <= least:
        return []
    hashes = T.window_hashes(T.code_points(text), window)
    cuts, last = [], 0
    for at in (np.flatnonzero(hashes % np.uint64(mean) == 0) + window).tolist():
        if at - last >= least and at < len(text):
            cuts.append(at)
            last = at
    return cuts


def chunks_of(text: str) -> Iterator[str]:
    last = 0
    for at in cut_points(text):
        yield text[last:at]
        last = at
    if last < len(text):
        yield text[last:]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder a worker process; its memory of words and chunks outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids binary: little-endian 32-bit) of every text."""

    def make(b: pa.RecordBatch) -> dict:
        e = encoder(path)
        return {"ids": [e.encode_chunked(t) for t in b["_text"].to_pylist()]}

    return with_columns(docs.select(docs[id], text_column(docs, text).alias("_text")), ("_text",), "ids binary", make)


def round_trips(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of encoding and decoding every text: id, n_tokens, ids_sha256, decoded_sha256."""

    def make(b: pa.RecordBatch) -> dict:
        e = encoder(path)
        out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for t in b["_text"].to_pylist():
            ids = e.encode_chunked(t)
            out["n_tokens"].append(len(ids) // 4)
            out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(e.decode(ids)).hexdigest())
        return out

    return with_columns(docs.select(docs[id], text_column(docs, text).alias("_text")), ("_text",), "n_tokens long, ids_sha256 string, decoded_sha256 string", make)
