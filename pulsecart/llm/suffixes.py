"""Suffix arrays by induced sorting, with numpy doing whole buckets at a time."""

from __future__ import annotations

import numpy as np


def _small_types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last suffix counts as smaller."""
    n = len(s)
    smaller = np.ones(n, dtype=bool)
    if n > 1:
        differs = np.append(s[:-1] != s[1:], True)
        # For equal neighbours the next place that differs decides.
        at = np.where(differs, np.arange(n), n - 1)
        at = np.minimum.accumulate(at[::-1])[::-1]
        up = np.append(s[:-1] < s[1:], True)
        smaller = up[at]
    return smaller


def _put(sa: np.ndarray, ends: np.ndarray, chars: np.ndarray, places: np.ndarray, step: int) -> None:
    """Append places to the buckets of their characters, in order; ends are moved on."""
    order = np.argsort(chars, kind="stable")
    chars, places = chars[order], places[order]
    first = np.flatnonzero(np.append(True, chars[1:] != chars[:-1]))
    count = np.diff(np.append(first, len(chars)))
    rank = np.arange(len(chars)) - np.repeat(first, count)
    if step > 0:
        sa[ends[chars] + rank] = places
    else:
        sa[ends[chars] - 1 - rank] = places
    ends[chars[first]] += step * count


def _induce(s: np.ndarray, smaller: np.ndarray, sizes: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Order of all suffixes from the order of the leftmost-smaller ones."""
    n = len(s)
    stop = np.cumsum(sizes)
    start = stop - sizes
    sa = np.full(n, -1, dtype=np.int64)
    tails = stop.copy()
    _put(sa, tails, s[lms[::-1]], lms[::-1], -1)
    lms_from = tails.copy()
    heads = start.copy()
    used = np.flatnonzero(sizes)

    def larger_before(places: np.ndarray) -> np.ndarray:
        before = places[places > 0] - 1
        return before[~smaller[before]]

    for c in used:
        lo = start[c]
        while lo < heads[c]:  # a run of one character goes on in its own bucket
            hi = heads[c]
            before = larger_before(sa[lo:hi])
            if len(before):
                _put(sa, heads, s[before], before, 1)
            lo = hi
        if lms_from[c] < stop[c]:
            before = larger_before(sa[lms_from[c] : stop[c]])
            if len(before):
                _put(sa, heads, s[before], before, 1)
    tails = stop.copy()

    def smaller_before(places: np.ndarray) -> np.ndarray:
        before = places[places > 0] - 1
        return before[smaller[before]]

    for c in used[::-1]:
        hi = stop[c]
        while tails[c] < hi:
            lo = tails[c]
            before = smaller_before(sa[lo:hi][::-1])
            if len(before):
                _put(sa, tails, s[before], before, -1)
            hi = lo
        if start[c] < heads[c]:
            before = smaller_before(sa[start[c] : heads[c]][::-1])
            if len(before):
                _put(sa, tails, s[before], before, -1)
    sa[0] = n - 1  # the end mark has no suffix behind it that could induce it
    return sa


def _doubled(s: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling, for strings of many names whose buckets are too small for
    whole-bucket steps. Only places that still share their rank with others are sorted again."""
    n, width = len(s), 1
    order = np.argsort(s)
    fresh = np.append(True, s[order][1:] != s[order][:-1])
    rank = np.empty(n, dtype=np.int64)  # the first place in order of those with equal prefixes
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    slots = np.arange(n)
    while True:
        slots = slots[~fresh | ~np.append(fresh[1:], True)]
        if not len(slots):
            return order
        places = order[slots]
        ahead = places + width
        behind = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[places] * (n + 1) + behind
        by = np.argsort(key)
        places, key = places[by], key[by]
        fresh = np.append(True, key[1:] != key[:-1])
        order[slots] = places
        rank[places] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))]
        width *= 2


def _packed(s: np.ndarray) -> tuple[np.ndarray, int]:
    """At each place as many of the next numbers as fit into 64 bits, the nearest lowest, and how many."""
    most = int(s.max(initial=0))
    step = 8 if most < 1 << 8 else 4 if most < 1 << 16 else 1
    packed = s.astype(np.uint64)
    have = 1
    while have < step:
        packed[:-have] |= packed[have:] << np.uint64(have * (64 // step))
        have *= 2
    return packed, step


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of numbers of which the last is the only smallest one."""
    n = len(s)
    sizes = np.bincount(s)
    if n < 64 or n < 64 * np.count_nonzero(sizes):
        return _doubled(s)
    if len(sizes) <= 1 << 16:
        s = s.astype(np.uint16)  # short numbers are sorted by their digits
    smaller = _small_types(s)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    sa = _induce(s, smaller, sizes, lms)
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    ordered = sa[is_lms[sa]]
    # Names of the substrings from one leftmost-smaller suffix to the next, equal for equal ones.
    following = np.zeros(n, dtype=np.int64)
    following[lms] = np.append(lms[1:], n - 1)
    length = following - np.arange(n) + 1
    a, b = ordered[:-1], ordered[1:]
    same = length[a] == length[b]
    left, i = np.flatnonzero(same), 0
    packed, step = _packed(s)
    # Of the last numbers of a substring those that are its own.
    own = np.array([(1 << (64 // step * k)) - 1 for k in range(step + 1)], dtype=np.uint64)
    while len(left):
        rest = length[a[left]] - i
        fits = (packed[a[left] + i] ^ packed[b[left] + i]) & own[np.minimum(rest, step)] == 0
        same[left[~fits]] = False
        left = left[fits & (rest > step)]
        i += step
    name = np.cumsum(np.append(0, ~same)) if len(ordered) else np.zeros(0, dtype=np.int64)
    if len(ordered) and name[-1] < len(ordered) - 1:
        names = np.zeros(n, dtype=np.int64)
        names[ordered] = name
        ordered = lms[suffix_array(names[lms])]
        sa = _induce(s, smaller, sizes, ordered)
    return sa


def common_prefixes(raw: np.ndarray, sa: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Permuted common prefixes: of each suffix with the one before it in order, up to the room that
    both have before the end of their strings.

    A suffix with the same character before it as its predecessor has one less in common than the
    suffix one place further left; only the others are compared.
    """
    n = len(sa)
    before = np.full(n, -1, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    limit = np.where(before >= 0, np.minimum(room, room[before]), 0)
    reducible = np.zeros(n, dtype=bool)
    at = np.flatnonzero(before > 0)
    at = at[at > 0]
    reducible[at] = (limit[at - 1] > 0) & (before[at - 1] == before[at] - 1) & (raw[at - 1] == raw[before[at] - 1])
    common = np.zeros(n, dtype=np.int64)
    left, i = np.flatnonzero(~reducible & (limit > 0)), 0
    packed, step = _packed(raw)
    bits = 64 // step
    while len(left):
        differs = packed[left + i] ^ packed[before[left] + i]
        fits = differs == 0
        lowest = differs[~fits]
        lowest &= ~lowest + np.uint64(1)
        ends = left[~fits]
        common[ends] = np.minimum(i + np.log2(lowest.astype(np.float64)).astype(np.int64) // bits, limit[ends])
        left = left[fits]
        i += step
        full = limit[left] <= i
        common[left[full]] = limit[left[full]]
        left = left[~full]
    # Behind an irreducible place the common prefix shrinks by one with each character.
    places = np.arange(n)
    from_ = np.maximum.accumulate(np.where(reducible, 0, places))
    return np.where(reducible, common[from_] - (places - from_), common)
