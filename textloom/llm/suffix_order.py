"""Order of all suffixes by linear grouping, and with it the repeated windows of a block of texts.

Suffixes are first grouped by their first symbol. Groups are taken from the greatest down; each of their suffixes points to the
nearest one before it that stands in a smaller group, and suffixes that are pointed to form greater groups of their own, the greater the
more often. In the end a group holds the suffixes with one longest Lyndon prefix. Then suffixes are put in place from the smallest
on: each puts those before it, as far as they are greater, on the next place of their group. There is no renaming and no recursion.

Texts are not ordered byte by byte but by pieces of some thirty bytes: a piece ends where the four bytes that follow hash to
certain values, so it depends on nothing before it, and pieces together with these four bytes are never a beginning of one another. The order
of pieces is thus the order of the texts, and where a window starts inside a piece, the rest of the piece is compared besides.
"""

from __future__ import annotations

import numpy as np

#: Bytes that decide on the end of a piece, and one in how many places is an end: the first (of powers of two) for which pieces are short enough; 1 stands for single bytes.
TRIGGER, ONE_IN = 4, (32, 8, 1)
FACTOR = np.uint32(0x9E3779B1)


def suffix_order(symbols: list[int]) -> list[int]:
    """Starts of the suffixes of `symbols` (positive numbers) in ascending order; a suffix that is the beginning of another comes before it."""
    n = len(symbols)
    if not n:
        return []
    s = np.asarray(symbols)
    first = np.argsort(s, kind="stable")
    heads = np.flatnonzero(np.r_[True, s[first][1:] != s[first][:-1]])
    sizes = np.diff(np.r_[heads, n])
    group_at = np.empty(n, np.int64)
    group_at[first] = np.repeat(heads, sizes)
    place_of = np.empty(n, np.int64)
    place_of[first] = np.arange(n)
    ends = np.zeros(n + 1, np.int64)
    ends[heads] = heads + sizes
    order, group, place, end = first.tolist(), group_at.tolist(), place_of.tolist(), ends.tolist()
    smaller = [-1] * n
    high = n
    while high > 0:
        low = group[order[high - 1]]
        if high - low == 1:
            i = order[low]
            j = i - 1
            while j >= 0 and group[j] >= low:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                g = group[j]
                last = end[g] - 1
                if last > g:  # j leaves its group upwards
                    other, at = order[last], place[j]
                    order[at], order[last] = other, j
                    place[other], place[j] = at, last
                    end[last], end[g] = last + 1, last
                    group[j] = last
        else:
            pointed: dict[int, int] = {}
            for i in sorted(order[low:high]):
                j = i - 1
                while j >= 0 and group[j] >= low:
                    j = smaller[j]
                smaller[i] = j
                if j >= 0:
                    pointed[j] = pointed.get(j, 0) + 1
            by_count: dict[int, list[int]] = {}
            for j, c in pointed.items():
                by_count.setdefault(c, []).append(j)
            for c in sorted(by_count, reverse=True):
                before: dict[int, int] = {}
                for j in by_count[c]:
                    g = group[j]
                    last = end[g]
                    before.setdefault(g, last)
                    last -= 1
                    other, at = order[last], place[j]
                    order[at], order[last] = other, j
                    place[other], place[j] = at, last
                    end[g] = last
                for j in by_count[c]:
                    group[j] = end[group[j]]
                for g, until in before.items():
                    end[end[g]] = until
        high = low
    out, put = [-1] * n, [False] * n
    free = list(range(n + 1))
    i, k = n, 0
    while True:
        j = i - 1
        while j >= 0 and not put[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            put[j] = True
            j = smaller[j]
        if k == n:
            return out
        i = out[k]
        k += 1


def ends_of_pieces(data: np.ndarray, one_in: int) -> np.ndarray:
    """Whether a piece may end before each byte: decided by this byte and the next three alone, never by four zeros unless pieces are single bytes."""
    if one_in == 1:
        return np.ones(len(data), bool)
    h = np.zeros(len(data), np.uint32)
    padded = np.r_[data, np.zeros(TRIGGER, np.uint8)].astype(np.uint32)
    for i in range(TRIGGER):
        h = h * np.uint32(257) + padded[i : i + len(data)]
    return ((h * FACTOR) >> np.uint32(16)) & np.uint32(one_in - 1) == 1


def longest_piece(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, one_in: int) -> np.ndarray:
    """For each of the texts data[start : start + len], which lie one after the other, the bytes of its longest piece."""
    cuts = np.unique(np.r_[np.flatnonzero(ends_of_pieces(data, one_in)), starts, starts + lens])
    gaps = np.diff(cuts)
    return np.maximum.reduceat(gaps, np.searchsorted(cuts, starts)) if len(starts) else np.zeros(0, np.int64)


def repeated(texts: list[bytes], n_starts: np.ndarray, weights: np.ndarray, window: int, one_in: int) -> np.ndarray:
    """For the first n_starts places of each text, one after the other: whether the window there occurs at another such place or its text counts as more than one.

    Text i holds at least n_starts[i] + window - 1 bytes. Pieces, cut at one in one_in places, must have at most window - TRIGGER bytes.
    """
    lens = np.array([len(t) for t in texts], np.int64)
    gap = b"\0" * TRIGGER
    raw = gap.join(texts) + gap
    data = np.frombuffer(raw, np.uint8)
    begin = np.r_[0, np.cumsum(lens + TRIGGER)[:-1]]
    rule = ends_of_pieces(data, one_in)
    rule[begin] = True
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, begin, 1)
    np.add.at(inside, begin + lens, -1)
    cuts = np.flatnonzero(rule & (np.cumsum(inside[:-1]) > 0))
    more = 0 if one_in == 1 else TRIGGER
    stops = np.r_[cuts[1:], len(data)]
    last = np.r_[np.isin(cuts[1:], begin), True]
    stops = np.where(last, stops, stops + more)
    pieces = [raw[a:b] for a, b in zip(cuts.tolist(), stops.tolist(), strict=True)]
    names = {p: i for i, p in enumerate(sorted(set(pieces)), 1)}
    order = np.array(suffix_order([names[p] for p in pieces]), np.int64)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    common = _common(np.r_[data, np.zeros(window + 8, np.uint8)], cuts[order], window)

    of = np.repeat(np.arange(len(texts)), n_starts)
    places = np.repeat(begin, n_starts) + np.arange(len(of)) - np.repeat(np.cumsum(n_starts) - n_starts, n_starts)
    behind = np.searchsorted(cuts, places, "right")
    rest = cuts[np.minimum(behind, len(cuts) - 1)] - places  # bytes up to the next piece
    out = np.zeros(len(of), bool)
    by_rest = np.argsort(rest, kind="stable")
    bounds = np.searchsorted(rest[by_rest], np.arange(window + 1))
    left, before = np.zeros(len(cuts), np.uint64), np.r_[np.zeros(window, np.uint64), data.astype(np.uint64) + np.uint64(1)]
    for n in range(1, window):
        left = left * np.uint64(0x100000001B3) + before[cuts + (window - n)]
        sel = by_rest[bounds[n] : bounds[n + 1]]
        if bounds[n] == len(by_rest):
            break
        if not len(sel):
            continue
        # suffixes that agree in their first window - n bytes lie together
        same = np.cumsum(common < window - n)[rank[behind[sel]]]
        key = left[behind[sel]]
        near = np.lexsort((key, same))
        sel, same, key = sel[near], same[near], key[near]
        equal = (same[1:] == same[:-1]) & (key[1:] == key[:-1])
        pairs = np.flatnonzero(equal)
        for a in range(0, len(pairs), 1 << 14):
            p = pairs[a : a + (1 << 14)]
            span = np.arange(n)
            equal[p] = (data[places[sel[p]][:, None] + span] == data[places[sel[p + 1]][:, None] + span]).all(1)
        heads = np.flatnonzero(np.r_[True, ~equal])
        counts = np.add.reduceat(weights[of[sel]], heads)
        out[sel] = np.repeat(counts > 1, np.diff(np.r_[heads, len(sel)]))
    return out


def _common(data: np.ndarray, places: np.ndarray, most: int) -> np.ndarray:
    """Bytes, up to `most`, that the text from each place shares with the one from the place before it in the list; 0 for the first.

    Eight bytes at a time, only of those that have been equal so far; data goes on for most + 8 bytes behind the last place.
    """
    eights = np.ndarray((len(data) - 7,), np.dtype("<u8"), data, 0, (1,))
    out = np.zeros(len(places), np.int64)
    now = np.arange(1, len(places))
    for k in range(0, most, 8):
        apart = eights[places[now] + k] ^ eights[places[now - 1] + k]
        equal = apart == 0
        low = apart[~equal]
        out[now[~equal]] = k + (np.bitwise_count((low & -low) - np.uint64(1)) >> 3)  # zero bits below the lowest one
        now = now[equal]
    out[now] = most
    return np.minimum(out, most)
