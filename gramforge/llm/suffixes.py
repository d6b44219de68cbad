"""Repeated substrings by interval expansion on a Burrows-Wheeler transform, in memory.

``repeated`` takes sequences of symbols (bytes, or numbers) and tells for each of their positions
whether the ``least`` symbols from there on occur at another position too, and which one of
equal ones comes first. The sequences are
joined by separators of their own, their suffixes sorted as deep as ``least``
needs, and the transform is searched breadth first: the interval of the empty string is
extended backward by every symbol; all intervals of strings of length l are
expanded before those of length l + 1, so the first time that an interval ends at
a place, l is the common prefix there with the next suffix. The search
stops at ``least``: places that got no value have common prefixes of that length or longer.
"""

from __future__ import annotations

import numpy as np


def _heads(new: np.ndarray) -> np.ndarray:
    """For each place the first place of its group; new marks these."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new), dtype=np.int32), np.int32(0)))


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first depth symbols at least; symbols is 0 at a string's end, and these ends sort by place."""
    n = len(symbols)
    bits = int(symbols.max()).bit_length()
    h = min(depth, 62 // bits)  # symbols in the first key
    padded = np.append(symbols, np.zeros(h, symbols.dtype))
    key, ends = np.zeros(n, np.int64), np.zeros(n, bool)
    for k in range(h):
        at = padded[k : k + n]
        ends |= at == 0
        key = key << bits | np.where(ends, 0, at)
    # equal keys stay in order of place, which is that of the ends in them
    order = np.argsort(key, kind="stable").astype(np.int32)
    key = key[order]
    new = np.append(True, key[1:] != key[:-1]) | ends[order]
    head = _heads(new)
    rank = np.empty(n + 1, np.int32)
    rank[order], rank[n] = head, -1
    places = np.flatnonzero(~(new & np.append(new[1:], True))).astype(np.int32)
    head = head[places]
    # suffixes that are apart keep their places and ranks; only tied ones are sorted on
    while h < depth and len(places):
        where = order[places]
        both = head.astype(np.int64) * (n + 1) + rank[np.minimum(where + h, n)]
        by = np.argsort(both)
        both = both[by]
        where = where[by]
        new = np.append(True, both[1:] != both[:-1])
        head = places[_heads(new)]
        order[places], rank[where] = where, head
        tied = ~(new & np.append(new[1:], True))
        places, head = places[tied], head[tied]
        h *= 2
    return order


def short_prefixes(symbols: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """For places 0 to n of the order: whether the common prefix with the place before is shorter than least."""
    n = len(symbols)
    bwt, kinds = symbols[order - 1], int(symbols.max()) + 1
    # LF mapping: separators first, each a symbol of its own, then the symbols in order
    by = np.argsort(bwt.astype(np.uint16) if kinds <= 1 << 16 else bwt, kind="stable").astype(np.int32)
    lf = np.empty(n, np.int32)
    lf[by] = np.arange(n, dtype=np.int32)
    s = bwt[by]
    same = s[1:] == s[:-1]
    following, preceding = np.full(n, n, np.int32), np.full(n, -1, np.int32)
    following[by[:-1][same]] = by[1:][same]
    preceding[by[1:][same]] = by[:-1][same]
    known = np.zeros(n + 1, bool)
    ends = np.arange((symbols == 0).sum(), dtype=np.int32)  # the suffixes that begin with a separator, intervals of one
    known[: len(ends) + 1] = True
    known[n] = True
    lo, hi = np.zeros(1, np.int32), np.full(1, n - 1, np.int32)
    wide = bwt.astype(np.int64)
    for length in range(least):
        if not len(lo):
            break
        size = hi - lo + 1
        owner = np.repeat(np.arange(len(lo), dtype=np.int32), size)
        place = np.arange(len(owner), dtype=np.int32) + np.repeat(lo - (np.cumsum(size, dtype=np.int32) - size), size)
        byte = bwt[place] > 0
        owner, place = owner[byte], place[byte]
        last = following[place] > hi[owner]
        head = preceding[place] < lo[owner]
        a, b = place[head], place[last]
        if size.max() > 1:
            # heads and lasts of an interval pair up by symbol
            ka, kb = owner[head] * np.int64(kinds) + wide[a], owner[last] * np.int64(kinds) + wide[b]
            a, b = a[np.argsort(ka)], b[np.argsort(kb)]
        i, j = lf[a], lf[b]
        fresh = ~known[j + 1]
        i, j = i[fresh], j[fresh]
        known[j + 1] = True
        lo, hi = (i, j) if length else (np.append(i, ends), np.append(j, ends))
    return known


def _joined(strings: list) -> tuple[np.ndarray, np.ndarray]:
    """All symbols as numbers from 1 on, with a 0 after each sequence, and the lengths with it."""
    parts = [np.frombuffer(x, np.uint8) if isinstance(x, bytes) else x for x in strings]
    size = np.array([len(x) + 1 for x in parts], np.int64)
    whole = np.concatenate(parts)
    codes = whole.astype(np.int32) if whole.dtype == np.uint8 else np.unique(whole, return_inverse=True)[1]
    out = np.zeros(int(size.sum()), np.int32)
    inside = np.ones(len(out), bool)
    inside[np.cumsum(size) - 1] = False
    out[inside] = codes + 1
    return out, size


def repeated(strings: list, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each sequence, for each of its first len - least + 1 positions: whether the least symbols from there occur elsewhere too, and whether they are the first of equal ones."""
    if not strings:
        return []
    joined, size = _joined(strings)
    order = suffix_order(joined, least) if joined.any() else np.arange(len(joined))
    short = short_prefixes(joined, order, least)
    twice, first = np.empty(len(joined), bool), np.empty(len(joined), bool)
    twice[order] = ~short[:-1] | ~short[1:]
    first[order] = short[:-1]
    starts = np.cumsum(size) - size
    return [(twice[a : a + max(0, n - least)], first[a : a + max(0, n - least)]) for a, n in zip(starts.tolist(), size.tolist())]
