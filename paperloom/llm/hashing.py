"""Vectorised hashes of words and word shingles, for use inside Arrow batches.

Words are ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes. A word's hash depends on its bytes alone, so it is the same in every
task and on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_SPACE = np.zeros(256, np.bool_)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_AS_IS = np.arange(256, dtype=np.uint8)
_LOWER = _AS_IS.copy()
_LOWER[65:91] += 32
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.int64).view(np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Bytes hashed at once; eight-byte arrays of this length are the working memory.
SEGMENT = 1 << 18
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: np.uint64 = _P) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd ``base`` and of its inverse, modulo 2**64."""
    size, held = 1 << max(n - 1, 1).bit_length(), _powers.get(int(base))
    if held is None or len(held[0]) < size:
        one = np.ones(1, np.uint64)
        inverse = np.uint64(pow(int(base), -1, 2**64))
        held = tuple(np.concatenate([one, np.cumprod(np.full(size - 1, p, np.uint64), dtype=np.uint64)]) for p in (base, inverse))
        if size <= 4 * SEGMENT:
            _powers[int(base)] = held
    return held[0][:n], held[1][:n]


def range_hashes(values: np.ndarray, begins: np.ndarray, ends: np.ndarray, base: np.uint64 = _P) -> np.ndarray:
    """Polynomial hashes of values[begins[i]:ends[i]]; equal ranges have equal hashes wherever they lie."""
    up, down = powers(len(values) + 1, base)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[:-1], dtype=np.uint64)])
    return mix((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(np.uint64) * _STEP)


def _segments(buf: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Pieces of about SEGMENT bytes that end at white space; a longer word stays whole."""
    at = 0
    while at < len(buf):
        end = at + SEGMENT
        while end < len(buf):
            cut = np.flatnonzero(_SPACE[buf[end : end + 4096]])
            if len(cut):
                end += int(cut[0])
                break
            end += 4096
        yield at, buf[at : min(end, len(buf))]
        at = end


def word_spans(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, hashes, starts, ends, first) of all words in order, in the texts put behind each other with a line end
    after each: text i has the words first[i] to first[i + 1]."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    hashes, begins, stops = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for at, seg in _segments(buf):
        edges = np.diff(np.concatenate([[True], _SPACE[seg], [True]]).astype(np.int8))
        starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
        hashes.append(range_hashes(_BYTE[(_LOWER if lower else _AS_IS)[seg]], starts, ends))
        begins.append(starts + at)
        stops.append(ends + at)
    starts = np.concatenate(begins)
    first = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    return buf, np.concatenate(hashes), starts, np.concatenate(stops), first


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, first): text i has the words first[i] to first[i + 1]."""
    _, hashes, _, _, first = word_spans(texts, lower)
    return hashes, first


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, in order."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = words[:n].copy()
    for j in range(1, k):
        out *= _STEP
        out += words[j : j + n]
    return mix(out)


def shingle_sets(texts: list[bytes], k: int = 5, lower: bool = False) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; fewer words make one shingle, none make none."""
    words, first = word_hashes(texts, lower)
    runs = shingles(words, k)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            yield np.unique(runs[a : b - k + 1])
        elif b > a:
            yield mix(shingles(words[a:b], int(b - a)) + np.uint64(b - a))
        else:
            yield np.empty(0, np.uint64)


def groups(texts: list[bytes], size: int = SEGMENT) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes together."""
    begin, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
