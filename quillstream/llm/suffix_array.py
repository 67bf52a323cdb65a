"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

Induced sorting moves through the buckets of first characters; what one bucket induces is
handled as arrays (in waves where a bucket induces into itself), not suffix by suffix.
"""

from __future__ import annotations

import numpy as np


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last (sentinel) counts as such."""
    d = np.diff(s.astype(np.int32))
    at = np.where(d != 0, np.arange(len(d)), len(s))
    nxt = np.minimum.accumulate(at[::-1])[::-1]  # the next place where neighbours differ
    return np.append(d[np.minimum(nxt, len(d) - 1)] > 0, True)


def _push(sa: np.ndarray, s: np.ndarray, at: np.ndarray, wanted: np.ndarray, pointer: np.ndarray, step: int) -> None:
    """Put the predecessors of the suffixes ``at`` that are ``wanted`` into their buckets."""
    j = at[at > 0] - 1
    j = j[wanted[j]]
    if not len(j):
        return
    c = s[j]
    order = np.argsort(c, kind="stable")
    j, c = j[order], c[order]
    first = np.flatnonzero(np.diff(c, prepend=-1))
    sizes = np.diff(first, append=len(c))
    place = np.arange(len(c)) - np.repeat(first, sizes)
    sa[pointer[c] + step * place + min(step, 0)] = j
    pointer[c[first]] += step * sizes


def _induce(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in the order that the leftmost-smaller ones, as ordered, induce."""
    width = int(s.max()) + 1
    count = np.bincount(s, minlength=width)
    end = np.cumsum(count)
    start = end - count
    sa = np.full(len(s), -1, np.int64)
    c = s[lms]
    order = np.argsort(c, kind="stable")
    held = np.bincount(c, minlength=width)
    place = np.arange(len(lms)) - np.repeat(np.cumsum(held) - held, held)
    sa[(end - held)[c[order]] + place] = lms[order]
    larger = ~smaller
    used = np.flatnonzero(count)
    pointer = start.copy()
    for k in used.tolist():
        low = int(start[k])
        while low < (high := int(pointer[k])):
            _push(sa, s, sa[low:high], larger, pointer, 1)
            low = high
        if held[k]:
            _push(sa, s, sa[end[k] - held[k] : end[k]], larger, pointer, 1)
    large_end = pointer.copy()
    pointer = end.copy()
    for k in used[::-1].tolist():
        if k == 0:
            sa[0] = len(s) - 1
            break
        high = int(end[k])
        while high > (low := int(pointer[k])):
            _push(sa, s, sa[low:high][::-1], smaller, pointer, -1)
            high = low
        _push(sa, s, sa[start[k] : large_end[k]][::-1], smaller, pointer, -1)
    return sa


def _named(s: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Names (ranks) of the leftmost-smaller substrings, in text order; equal ones share one."""
    length = np.empty(len(s), np.int64)
    length[lms] = np.diff(lms, append=len(s) - 1) + 1
    a, b = ordered[:-1], ordered[1:]
    same = length[a] == length[b]
    live = np.flatnonzero(same)
    k = 0
    while len(live):
        equal = s[a[live] + k] == s[b[live] + k]
        same[live[~equal]] = False
        k += 1
        live = live[equal & (length[a[live]] > k)]
    name = np.empty(len(s), np.int64)
    name[ordered] = np.concatenate([[0], np.cumsum(~same)])
    return name[lms]


def _sorted_names(name: np.ndarray) -> np.ndarray:
    """Suffixes of a string of names in order: each level sorts names of twice the length."""
    rank, h = name, 1
    while True:
        key = rank * (len(rank) + 1)
        key[:-h] += rank[h:] + 1
        order = np.argsort(key)
        new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty_like(rank)
        rank[order] = new
        if new[-1] == len(rank) - 1 or h >= len(rank):
            return order
        h *= 2


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``text`` (values of at least 1) in order."""
    if not len(text):
        return np.zeros(0, np.int64)
    s = np.append(text, 0).astype(np.int32 if text.max() > 65_535 else np.uint16)
    smaller = _types(s)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    is_lms = np.zeros(len(s), bool)
    is_lms[lms] = True
    sa = _induce(s, smaller, lms)
    ordered = sa[is_lms[sa]]
    name = _named(s, lms, ordered)
    if name.max() < len(lms) - 1:
        ordered = lms[_sorted_names(name)]
    return _induce(s, smaller, ordered)[1:]


def common_prefixes(data: np.ndarray, sa: np.ndarray, room: np.ndarray) -> np.ndarray:
    """For each position, the common prefix with its predecessor in ``sa``, in text order.

    ``room[i]`` limits a prefix that starts at i. Along a diagonal of predecessors prefixes
    shrink by one a step, so only the first place of each diagonal is compared.
    """
    n = len(data)
    before = np.empty(n, np.int64)
    before[sa[1:]], before[sa[0]] = sa[:-1], -1
    head = np.ones(n, bool)
    head[1:] = (before[1:] != before[:-1] + 1) | (before[1:] <= 0) | (room[1:] != room[:-1] - 1) | (data[:-1] != data[before[1:] - 1])
    i = np.flatnonzero(head & (before >= 0))
    j = before[i]
    limit = np.minimum(room[i], room[j])
    padded = np.concatenate([data.astype(np.uint8), np.zeros(16, np.uint8)])
    word = np.ndarray((n + 9,), "<u8", padded.data, strides=(1,))
    found = np.zeros(len(i), np.int64)
    live = np.flatnonzero(limit > 0)
    while len(live):
        x = word[i[live] + found[live]] ^ word[j[live] + found[live]]
        low = x & (~x + np.uint64(1))
        step = np.where(x == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // 8)
        found[live] += step
        live = live[(step == 8) & (found[live] < limit[live])]
    start = np.zeros(n, np.int64)
    start[i] = np.minimum(found, limit)
    where = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    return np.where(before >= 0, np.minimum(np.maximum(0, start[where] - (np.arange(n) - where)), room), 0)
