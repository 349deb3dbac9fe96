"""Hashed words and word shingles of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import WORD_TABLE

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_BASE = int(_rng.integers(1, 1 << 62)) * 8 + 5
_MASK = (1 << 64) - 1
#: Texts are hashed in stretches of about so many bytes.
STRETCH = 1 << 20
_powers = np.zeros(0, np.uint64)
_inverses = np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(by)
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        n = max(n, STRETCH + (STRETCH >> 2))
        _powers = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _BASE, np.uint64)])
        _inverses = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, pow(_BASE, -1, 1 << 64), np.uint64)])


def _hash_stretch(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of bytes in which spaces separate words."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    _tables(len(b) + 1)
    edge = np.diff(np.r_[np.int8(0), (b != 32).view(np.int8), np.int8(0)])
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.empty(len(b) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[b] * _powers[: len(b)], out=sums[1:])
    return start, mix((sums[end] - sums[start]) * _inverses[start] + (end - start).astype(np.uint64))


def word_hashes(texts: list[bytes]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(number of the first text, word hashes of it and the texts after it), stretch by stretch."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < STRETCH):
            size += len(texts[end]) + 1
            end += 1
        if end == at + 1 and size > STRETCH:
            yield at, [long_hashes(texts[at])]
        else:
            start, h = _hash_stretch(b" ".join(texts[at:end]).translate(WORD_TABLE))
            first = np.cumsum([0, *(len(t) + 1 for t in texts[at:end])])
            cut = np.searchsorted(start, first)
            yield at, [h[a:b] for a, b in zip(cut[:-1], cut[1:])]
        at = end


def long_hashes(text: bytes) -> np.ndarray:
    """Word hashes of one text of any length, in stretches that end between words."""
    out, at = [], 0
    while at < len(text):
        part = text[at : at + STRETCH].translate(WORD_TABLE)
        end = at + len(part)
        if end < len(text) and (cut := part.rfind(b" ")) > 0:
            end, part = at + cut, part[:cut]
        while end < len(text) and cut <= 0:  # a word longer than a stretch
            more = text[end : end + STRETCH].translate(WORD_TABLE)
            cut = more.find(b" ")
            part, end = part + (more if cut < 0 else more[:cut]), end + (len(more) if cut < 0 else cut)
            if cut == 0:
                break
        out.append(_hash_stretch(part)[1])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of each run of size words; of all words together where there are fewer; none without words."""
    n = len(words)
    if not n:
        return words
    width = min(size, n)
    h = words[: n - width + 1] * _PLACE[0]
    for j in range(1, width):
        h = h + words[j : n - width + 1 + j] * _PLACE[j]
    return mix(h + np.uint64(width))


def counted(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order and their counts."""
    s = np.sort(hashes)
    if not len(s):
        return s, np.zeros(0, np.int64)
    at = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    return s[at], np.diff(np.r_[at, len(s)])


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of smaller over sum of larger counts; 1 for two empty sets."""
    total = int(a[1].sum() + b[1].sum())
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (total - both) if total else 1.0
