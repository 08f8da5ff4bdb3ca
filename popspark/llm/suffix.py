"""Suffix arrays by induced sorting, on NumPy arrays small enough for one task.

``suffix_array`` classifies the suffixes into smaller-type and larger-type, sorts the leftmost
smaller-type (LMS) substrings by induction, names them, orders the LMS suffixes recursively over
the string of names and induces the whole array from them.  Both inductions go through the first
characters in order, one NumPy step for what a character's bucket holds at that moment, so the
work is linear in the text and no step is per suffix.  The recursion names pairs of names (the
alphabet of names is too large for one step a bucket), and stops as soon as every name is unique
or the names cover ``horizon`` characters: suffixes that agree that far are left in any order.

``common_prefixes`` gives the permuted common prefixes: in text order, how many bytes (up to ``span``)
a suffix shares with the suffix before it in the array.
"""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one (the last suffix counts as smaller)."""
    n = len(t)
    small = np.ones(n, bool)
    if n > 1:
        rises = t[:-1] < t[1:]
        stops = np.where(t[:-1] != t[1:], np.arange(n - 1, dtype=np.int32), np.int32(n - 2))
        stops = np.minimum.accumulate(stops[::-1])[::-1]
        small[:-1] = rises[stops]
    return small


def _induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """The suffix array that follows from the LMS suffixes in the order of ``lms``."""
    n = len(t)
    counts = np.bincount(t, minlength=size)
    ends = np.cumsum(counts)
    starts = ends - counts
    # What stands before each position: its character, and whether it is of the larger type.
    before = np.zeros(n, np.int16)
    before[1:] = t[:-1]
    larger = np.zeros(n, bool)
    larger[1:] = ~small[:-1]
    smaller = np.zeros(n, bool)
    smaller[1:] = small[:-1]

    sa = np.empty(n, np.int32)
    head = starts.copy()

    def push_larger(batch: np.ndarray) -> None:
        batch = batch[larger[batch]]
        if not len(batch):
            return
        chars = before[batch]
        order = np.argsort(chars, kind="stable")
        chars = chars[order]
        some, first, many = np.unique(chars, return_index=True, return_counts=True)
        place = np.repeat(head[some] - first, many) + np.arange(len(chars))
        sa[place] = batch[order] - 1
        head[some] += many

    of = t[lms]
    cut = np.searchsorted(of, np.arange(size + 1))
    present = np.flatnonzero(counts)
    for c in present:
        done = starts[c]
        while done < head[c]:
            batch = sa[done : head[c]]
            done = head[c]
            push_larger(batch)
        if cut[c] < cut[c + 1]:
            push_larger(lms[cut[c] : cut[c + 1]])

    tail = ends.copy()
    filled = head  # the larger-type part of each bucket stays

    def push_smaller(batch: np.ndarray) -> None:
        """batch: in the array's order; it is gone through from its end."""
        batch = batch[::-1]
        batch = batch[smaller[batch]]
        if not len(batch):
            return
        chars = before[batch]
        order = np.argsort(chars, kind="stable")
        chars = chars[order]
        some, first, many = np.unique(chars, return_index=True, return_counts=True)
        place = np.repeat(tail[some] + first, many) - np.arange(len(chars)) - 1
        sa[place] = batch[order] - 1
        tail[some] -= many

    sa[0] = n - 1
    tail[t[n - 1]] = 0
    filled[t[n - 1]] = 0
    push_smaller(sa[:1])
    for c in present[::-1]:
        if c == t[n - 1]:
            continue
        done = ends[c]
        while tail[c] < done:
            batch = sa[tail[c] : done]
            done = tail[c]
            push_smaller(batch)
        if starts[c] < filled[c]:
            push_smaller(sa[starts[c] : filled[c]])
    return sa


def _order_names(names: np.ndarray, steps: int) -> np.ndarray:
    """Indices of ``names`` in the order of the suffixes of that string, as far as ``steps`` names."""
    n = len(names)
    counts = np.bincount(names)
    rank = (np.cumsum(counts) - counts)[names]  # how many suffixes are smaller for certain
    reach = 1
    tied = np.flatnonzero(counts[names] > 1)
    while len(tied) and reach < steps:
        follow = np.zeros(len(tied), np.int64)
        inside = tied + reach < n
        follow[inside] = rank[tied[inside] + reach] + 1
        key = rank[tied] * np.int64(n + 1) + follow
        order = np.argsort(key)
        key, tied = key[order], tied[order]
        old = rank[tied]
        new_old = np.r_[True, old[1:] != old[:-1]]
        new_key = np.r_[True, key[1:] != key[:-1]]
        at = np.arange(len(tied))
        base = np.maximum.accumulate(np.where(new_old, at, 0))
        sub = np.maximum.accumulate(np.where(new_key, at, 0))
        rank[tied] = old + sub - base
        single = new_key & np.r_[new_key[1:], True]
        tied = tied[~single]
        reach *= 2
    return np.argsort(rank, kind="stable")


def suffix_array(t: np.ndarray, horizon: int | None = None) -> np.ndarray:
    """The suffix array of ``t``: small non-negative integers, the last one 0 and nowhere else.

    Suffixes that agree in their first ``horizon`` characters come in any order (None: the full
    order).  An array of length 1 gives [0].
    """
    t = np.ascontiguousarray(t, np.int16)
    n = len(t)
    if n <= 1:
        return np.zeros(n, np.int32)
    size = int(t.max()) + 1
    small = _types(t)
    is_lms = np.zeros(n, bool)
    is_lms[1:] = small[1:] & ~small[:-1]
    lms = np.flatnonzero(is_lms).astype(np.int32)
    by_first = lms[np.argsort(t[lms], kind="stable")]
    sa = _induce(t, small, by_first, size)
    ranked = sa[is_lms[sa]]
    # Name the LMS substrings: neighbours in the order share a name if they are equal.
    until = np.empty(n, np.int32)
    until[lms] = np.r_[lms[1:], n - 1]
    a, b = ranked[:-1], ranked[1:]
    length = until[a] - a
    same = length == until[b] - b
    active, k = np.flatnonzero(same), 0
    while len(active):
        differ = t[a[active] + k] != t[b[active] + k]
        same[active[differ]] = False
        k += 1
        active = active[~differ]
        active = active[length[active] >= k]
    until[ranked] = np.r_[0, np.cumsum(~same)]
    names = until[lms]
    del sa, by_first, until, a, b, length, same
    if int(names.max()) + 1 < len(names):
        steps = len(names) if horizon is None else horizon // 2 + 2  # LMS positions are two apart at least
        ranked = lms[_order_names(names.astype(np.int64), steps)]
    return _induce(t, small, ranked, size)


def words_at(data: np.ndarray) -> np.ndarray:
    """For each offset of ``data`` (bytes, 8 more at the end) the eight bytes there as one integer."""
    return np.ndarray((len(data) - 7,), np.dtype("<u8"), buffer=data, strides=(1,))


def common_prefixes(data: np.ndarray, starts: np.ndarray, sa: np.ndarray, span: int) -> np.ndarray:
    """Permuted common prefixes: for each position, how many of its first ``span`` (8 or more) bytes it
    shares with the position before it in ``sa``; 0 unless both begin a string (``starts``).

    data: the bytes, with at least ``span`` + 8 more at the end.
    """
    n = len(sa)
    ahead = np.empty(n, np.int32)
    ahead[sa[1:]] = sa[:-1]
    ahead[sa[0]] = -1
    here = np.flatnonzero(starts[:n] & (ahead >= 0))
    here = here[starts[ahead[here]]]
    words = words_at(data)
    out = np.zeros(n, np.int16)
    done = 0
    for k in [*range(0, span - 7, 8), *([span - 8] if span % 8 else [])]:
        differ = words[here + k] ^ words[ahead[here] + k]
        ends = differ != 0
        low = differ[ends]
        # The lowest set bit lies in the first byte that differs.
        out[here[ends]] = k + (np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1)) >> 3)
        here, done = here[~ends], k + 8
    out[here] = done
    return out
