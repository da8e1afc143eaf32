"""Words and word shingles of many texts at once, as numpy arrays of 64-bit hashes.

A word is a maximal run of letters and digits (``str.isalnum``), compared in lower case. A shingle is
five consecutive words; a text of one to four words has one shingle of all its words, a text without
words (or null) has none.
"""

from __future__ import annotations

import functools

import numpy as np

WORDS_PER_SHINGLE = 5
#: Characters handled at a time, so that the arrays of one step stay in the tens of MB.
CHUNK_CHARS = 1_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)


@functools.lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: whether it is alphanumeric, and its lower case where that is one character."""
    alnum = np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)
    lower = np.arange(0x110000, dtype=np.uint32)
    for i in np.flatnonzero(alnum):
        low = chr(i).lower()
        if len(low) == 1:
            lower[i] = ord(low)
    return alnum, lower


_KEPT_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """At least n powers of base; a worker keeps one array for each base."""
    if len(_KEPT_POWERS.get(base, ())) < n:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        _KEPT_POWERS[base] = np.cumprod(out, dtype=np.uint64)
    return _KEPT_POWERS[base]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of ``x``."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def slices(sizes: list, limit: int):
    """Slices (start, end) of items of these sizes with about ``limit`` in all at most, one item at least."""
    start = size = 0
    for i, n in enumerate(sizes):
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes)


def chunks(texts: list, limit: int = CHUNK_CHARS):
    """Slices (start, end) of ``texts`` of at most about ``limit`` characters, one text at least."""
    return slices([len(text or "") for text in texts], limit)


def code_points(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, each text ended by a line feed, and where each text starts (n + 1 numbers)."""
    joined = "".join([x for text in texts for x in (text or "", "\n")])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(text or "") + 1 for text in texts], out=starts[1:])
    return points, starts


def span_hashes(points: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of code points; equal spans have equal hashes wherever they stand."""
    n = 1 << max(12, int(len(points)).bit_length())
    terms = (points.astype(np.uint64) + np.uint64(7)) * _MIX
    terms ^= terms >> np.uint64(29)
    terms *= _powers(_BASE, n)[: len(points)]
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(terms, out=total[1:])
    return mix((total[end] - total[first]) * _powers(_INVERSE, n)[np.minimum(first, n - 1)] + (end - first).astype(np.uint64))


def run_hashes(word: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; of words of different texts too."""
    total = np.zeros(max(0, len(word) - n + 1), np.uint64)
    for i in range(n):
        total += word[i : i + len(total)] * np.uint64(((2 * i + 1) * 0x9FB21C651E98DF25) % (1 << 64))
    return mix(total)


def words(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words; where each text's words start (n + 1); each word's first and last-plus-one code point."""
    alnum, lower = _tables()
    points, starts = code_points(texts)
    inside = alnum[points]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edges = np.concatenate(([0], edges))
    first, end = edges[0::2], edges[1::2]
    return span_hashes(lower[points], first, end), np.searchsorted(first, starts), first, end


def shingles(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all shingles; where each text's shingles start (n + 1); the word hashes; each shingle's first word."""
    word, at, _, _ = words(texts)
    k = WORDS_PER_SHINGLE
    per_text = np.diff(at)
    count = np.where(per_text >= k, per_text - k + 1, np.minimum(per_text, 1))
    out_at = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=out_at[1:])
    start = np.arange(out_at[-1]) - np.repeat(out_at[:-1] - at[:-1], count)
    length = np.repeat(np.minimum(per_text, k), count)
    padded = np.concatenate((word, np.zeros(k, np.uint64)))
    total = np.zeros(len(start), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            total += np.where(length > i, padded[start + i], np.uint64(0)) * np.uint64(((2 * i + 1) * 0x9FB21C651E98DF25) % (1 << 64))
    return mix(total), out_at, word, start
