"""Numpy helpers over batches of texts, used inside tasks.

A *slice* is a run of texts of about ``SLICE_CHARS`` characters; one longer text is a slice of its own, so
memory follows the longest text and never the batch.  Words are runs of ``[^\\x20\\x09-\\x0D]``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

SLICE_CHARS = 1_500_000
BOUNDARY = 0x20
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_POWERS = np.ones(1, np.uint64)


def slices(texts: list[str], limit: int = SLICE_CHARS) -> Iterator[slice]:
    """Consecutive slices of ``texts`` of at most ``limit`` characters, or of one text."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield slice(start, i)
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield slice(start, len(texts))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _B
    x ^= x >> np.uint64(27)
    x *= _C
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = max(n, 2 * len(_POWERS), 256)
        more = np.full(size, _A, np.uint64)
        more[0] = 1
        _POWERS = np.multiply.accumulate(more)
    return _POWERS


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def run_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs ``codes[starts[i]:ends[i]]`` (sorted, not overlapping)."""
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    first = int(starts[0])
    position = np.arange(first, int(ends[-1]), dtype=np.int64)
    spans = np.diff(np.append(starts, ends[-1]))
    position -= np.repeat(starts, spans)
    inside = position < np.repeat(lengths, spans)
    position[~inside] = 0
    value = codes[first : int(ends[-1])].astype(np.uint64)
    value += np.uint64(0x51)
    value *= _B
    value ^= value >> np.uint64(29)
    value *= powers(int(lengths.max()))[position]
    value[~inside] = 0
    sums = np.add.reduceat(value, starts - first)
    sums[lengths == 0] = 0
    return mix(sums + lengths.astype(np.uint64) * _A)


@dataclass
class Words:
    """Words of a slice of texts: code points, word bounds, the text of each word and its hash."""

    codes: np.ndarray
    text_ends: np.ndarray  # exclusive, one separator counted
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    hashes: np.ndarray
    counts: np.ndarray  # words of each text


_LETTERS: list[np.ndarray] = []


def letters_table() -> np.ndarray:
    """For each code point its lower-case letter, or a space if it is no letter."""
    if not _LETTERS:
        lower = (c.lower() if (c := chr(i)).isalpha() else " " for i in range(0x110000))
        _LETTERS.append(np.fromiter((ord(c[0]) for c in lower), np.uint32, 0x110000))
    return _LETTERS[0]


def words_of(texts: list[str], hashed: bool = True, letters: bool = False) -> Words:
    """The words of a slice; with ``letters`` all but letters counts as white space, and case is folded."""
    codes = code_points("\n".join(texts) + "\n")
    if letters:
        codes = letters_table()[codes]
    text_ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    space = (codes == 32) | ((codes >= 9) & (codes <= 13))
    before = np.empty_like(space)
    before[0] = True
    before[1:] = space[:-1]
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    text = np.searchsorted(text_ends, starts, side="right")
    hashes = run_hashes(codes, starts, ends) if hashed else np.empty(0, np.uint64)
    return Words(codes, text_ends, starts, ends, text, hashes, np.bincount(text, minlength=len(texts)))


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the windows of ``n`` consecutive word hashes; empty if there are fewer words."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    m = len(hashes) - n + 1
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out *= _A
        out += hashes[j : j + m]
    return mix(out)


def windows_of(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the ``n``-word windows that lie inside one text."""
    hashes = window_hashes(words.hashes, n)
    at = np.flatnonzero(words.text[: len(hashes)] == words.text[n - 1 :]) if len(hashes) else np.empty(0, np.int64)
    return at, hashes[at]


def folded(codes: np.ndarray, bits: int) -> np.ndarray:
    """Code points in ``bits`` bits: all but the last eighth are themselves, those beyond are hashed into it."""
    room = 1 << bits - 3
    own = np.uint64((1 << bits) - room)
    out = codes.astype(np.uint64)
    high = out >= own
    if high.any():
        out[high] = own + ((out[high] * np.uint64(2654435761)) >> np.uint64(16)) % np.uint64(room)
    return out


def char_grams(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, order: int = 4, bits: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of characters inside words, the end of the word included: (packed gram, index of the word).

    A gram is ``order`` characters of ``bits`` bits, oldest highest; places before the word hold ``BOUNDARY``.
    """
    lengths = ends - starts + 1
    total = int(lengths.sum())
    word = np.repeat(np.arange(len(starts)), lengths)
    place = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = place + starts[word]
    last = place == lengths[word] - 1
    char = folded(codes[np.minimum(at, len(codes) - 1)], bits)
    char[last] = BOUNDARY
    gram = char.copy()
    for j in range(1, order):
        earlier = np.full(total, BOUNDARY, np.uint64)
        inside = place >= j
        earlier[inside] = char[np.flatnonzero(inside) - j]
        gram |= earlier << np.uint64(bits * j)
    return gram, word


def sums_by(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sum of the weights of each."""
    if not len(keys):
        return keys, weights
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(weights, first)
