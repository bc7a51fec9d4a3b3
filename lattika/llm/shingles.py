"""Hashed word shingles of a slice of texts, in numpy, without a Python step per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_STEP, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit permutation (the finalizer of splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(256, dtype=np.uint64))
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z


#: Bytes that are hashed at a time; a longer word is hashed as a whole.
CHUNK = 1 << 18
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    out = _POWERS.get(base)
    if out is None or len(out) < n:
        out = np.full(max(n, CHUNK), base, np.uint64)
        out[0] = 1
        out = np.multiply.accumulate(out)
        if len(out) <= 4 * CHUNK:  # those of a very long word are not kept
            _POWERS[base] = out
    return out[:n]


def _chunk_hashes(raw: np.ndarray, edges: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of some bytes; `edges`: where texts begin and end in them; `between`: which bytes part words."""
    space = between[raw]
    border = np.zeros(len(raw) + 1, bool)
    border[edges] = True
    before = np.concatenate([[True], space[:-1]]) | border[:-1]
    after = np.concatenate([space[1:], [True]]) | border[1:]
    start, end = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _powers(_STEP, len(raw)), out=sums[1:])
    return mix((sums[end] - sums[start]) * _powers(_BACK, len(raw))[start] + (end - start).astype(np.uint64)), start


def word_hashes(texts: pa.Array, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of all texts (words: runs of bytes that are not `between`, else without space, tab or line break; A-Z lower-cased), and words per text."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    edges = offsets - offsets[0]
    hashes, starts, at = [], [], 0
    while at < len(raw):
        end = min(at + CHUNK, len(raw))
        while end < len(raw) and not between[raw[end]]:  # to the end of a word
            near = np.flatnonzero(between[raw[end : end + CHUNK]])
            end += int(near[0]) if len(near) else min(CHUNK, len(raw) - end)
        a, b = np.searchsorted(edges, [at, end + 1])
        found, start = _chunk_hashes(raw[at:end], edges[a:b] - at, between)
        hashes.append(found)
        starts.append(start + at)
        at = end
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(starts), edges))


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed k-word shingles of each text, sorted, one text after the other, and how many each has.

    A text of fewer than k words has its whole sequence as its one shingle; a text without words has none.
    """
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    short = (counts > 0) & (counts < k)
    hashed = np.full(max(0, len(words) - k + 1), k, np.uint64)
    for j in range(k):
        hashed = mix(hashed * np.uint64(_STEP) + words[j : j + len(hashed)])
    n = np.where(short, 1, np.maximum(counts - k + 1, 0))
    out, at, unique = np.empty(int(n.sum()), np.uint64), 0, np.zeros(len(counts), np.int64)
    for i in range(len(counts)):
        if not n[i]:
            continue
        first = ends[i] - counts[i]
        if short[i]:
            one = np.full(1, counts[i], np.uint64)
            for w in words[first : ends[i]]:
                one = mix(one * np.uint64(_STEP) + w)
        else:
            one = np.sort(hashed[first : first + n[i]])
            one = one[np.concatenate([[True], one[1:] != one[:-1]])]
        out[at : at + len(one)] = one
        at += len(one)
        unique[i] = len(one)
    return out[:at], unique
