"""Words and word shingles of Arrow string columns as 64-bit hashes, in numpy.

A word is a run of `[^\\x20\\x09-\\x0D]` with A-Z in lower case. Hashes are polynomial sums over a table of random byte
values, mixed; two different words or shingles share one by chance about once in 2^64 pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.default_rng(20240607)
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_VALUE[65:91] = _VALUE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 2**64)
WINDOW = 1 << 20
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    while len(_powers[0]) < n:
        m = len(_powers[0])
        for i, b in ((0, _BASE), (1, _INVERSE)):
            _powers[i] = np.concatenate([_powers[i], _powers[i] * U(pow(b, m, 2**64))])
    return _powers[0], _powers[1]


def words(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, its first byte's place). breaks: sorted places where a new text starts."""
    solid = ~_SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = breaks[(breaks > 0) & (breaks < len(data))]
    first[inner], last[inner - 1] = solid[inner], solid[inner - 1]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * up[: len(data)], out=total[1:])
    return mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64)), start


def text_words(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and where each text's words begin (one more entry than texts). Null: none."""
    if not len(texts):
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(raw) else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    hashes, counts, at = [], np.zeros(len(texts), np.int64), 0
    while at < len(data):
        end = min(len(data), at + WINDOW)
        if end < len(data):  # cut a window at white space or at a text's end
            cut = np.flatnonzero(_SPACE[data[at:end]])
            later = offsets[(offsets > at) & (offsets <= end)]
            end = max(at + int(cut[-1]) + 1 if len(cut) else 0, int(later[-1]) if len(later) else 0)
            while end <= at or (end < len(data) and end not in offsets and not _SPACE[data[end - 1]]):  # a word longer than a window
                end = at + WINDOW if end <= at else end + 1
                end = min(end, len(data))
        h, place = words(data[at:end], offsets - at)
        hashes.append(h)
        counts += np.bincount(np.searchsorted(offsets, place + at, "right") - 1, minlength=len(texts))[: len(texts)]
        at = end
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(counts)])


def shingle_sets(texts: pa.StringArray, size: int = 3) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles of `size` words; fewer words make one shingle, none an empty set."""
    w, begin = text_words(texts)
    n = max(0, len(w) - size + 1)
    whole = np.zeros(n, np.uint64)
    for k in range(size):
        whole = whole * U(0x9E3779B97F4A7C15) + w[k : k + n]
        whole = whole ^ (whole >> U(29))
    whole = mix(whole)
    out = []
    for a, b in zip(begin[:-1], begin[1:], strict=True):
        if b - a >= size:
            s = np.sort(whole[a : b - size + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            short = np.array([b - a], np.uint64)
            for x in w[a:b]:
                short = mix(short * U(0x9E3779B97F4A7C15) + x)
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
