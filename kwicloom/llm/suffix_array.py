"""Suffix arrays by induced sorting and permuted common prefixes, as array operations.

Suffixes are classified as L or S; leftmost S suffixes (LMS) are sorted by recursion on the names of their
substrings; L suffixes are induced from them bucket by bucket from the left, S suffixes from the right. Within
a bucket, everything that one wave of entries induces is placed at once, so work is linear and the number of
array operations is that of buckets and of equal-character runs. Where a level has many names for its length,
waves are short, and suffixes are induced one by one, in the same order.
"""

from __future__ import annotations

import numpy as np

#: A level is induced in waves if it has at least so many suffixes to a name, else one by one.
PER_NAME = 64


def types(s: np.ndarray) -> np.ndarray:
    """True for S suffixes; the last suffix is S."""
    n = len(s)
    step = np.sign(np.diff(s.astype(np.int64)))
    at = np.where(step != 0, np.arange(n - 1), n - 1)
    nearest = np.minimum.accumulate(at[::-1])[::-1]  # the next place where neighbours differ
    out = np.ones(n, bool)
    inner = nearest < n - 1
    out[:-1][inner] = step[nearest[inner]] > 0
    return out


def place(sa: np.ndarray, heads: np.ndarray, who: np.ndarray, chars: np.ndarray, forward: bool) -> None:
    """Append ``who``, in order, to the buckets of ``chars``, at their heads or backwards from their tails."""
    order = np.argsort(chars, kind="stable")
    c = chars[order]
    first = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
    size = np.diff(np.append(first, len(c)))
    rank = np.arange(len(c)) - np.repeat(first, size)
    if forward:
        sa[heads[c] + rank] = who[order]
        heads[c[first]] += size
    else:
        sa[heads[c] - rank] = who[order]
        heads[c[first]] -= size


def induce(s: np.ndarray, is_s: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The suffix array that the given order of LMS suffixes induces."""
    n = len(s)
    sa = np.full(n, -1, np.int64)
    starts = np.cumsum(sizes) - sizes
    ends = np.cumsum(sizes) - 1
    tails = ends.copy()
    place(sa, tails, lms[::-1], s[lms[::-1]], False)
    lms_from = tails + 1  # LMS suffixes of bucket c lie in [lms_from, ends]
    heads = starts.copy()
    if not is_s[n - 1]:
        raise ValueError("the text must end with its least character")
    used = np.flatnonzero(sizes)
    for c in used.tolist():
        at = int(starts[c])
        while at < heads[c]:
            wave = sa[at : int(heads[c])]
            at = int(heads[c])
            before = wave[wave > 0] - 1
            before = before[~is_s[before]]
            if len(before):
                place(sa, heads, before, s[before], True)
        wave = sa[int(lms_from[c]) : int(ends[c]) + 1]
        before = wave[wave > 0] - 1
        before = before[~is_s[before]]
        if len(before):
            place(sa, heads, before, s[before], True)
    l_end = heads  # L suffixes of bucket c lie in [starts, l_end)
    tails = ends.copy()
    for c in used[::-1].tolist():
        at = int(ends[c])
        while at > tails[c]:
            wave = sa[int(tails[c]) + 1 : at + 1][::-1]
            at = int(tails[c])
            before = wave[wave > 0] - 1
            before = before[is_s[before]]
            if len(before):
                place(sa, tails, before, s[before], False)
        wave = sa[int(starts[c]) : int(l_end[c])][::-1]
        before = wave[wave > 0] - 1
        before = before[is_s[before]]
        if len(before):
            place(sa, tails, before, s[before], False)
    sa[0] = n - 1
    return sa


def induce_singly(s: np.ndarray, is_s: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """As ``induce``, one suffix after the other: for levels of so many names that waves would be short."""
    n = len(s)
    ends = np.cumsum(sizes) - 1
    starts = (ends + 1 - sizes).tolist()
    char, small = s.tolist(), is_s.tolist()
    sa = [-1] * n
    tails = ends.tolist()
    for i in lms[::-1].tolist():
        c = char[i]
        sa[tails[c]] = i
        tails[c] -= 1
    for at in range(n):
        i = sa[at] - 1
        if i >= 0 and not small[i]:
            c = char[i]
            sa[starts[c]] = i
            starts[c] += 1
    tails = ends.tolist()
    for at in range(n - 1, -1, -1):
        i = sa[at] - 1
        if i >= 0 and small[i]:
            c = char[i]
            sa[tails[c]] = i
            tails[c] -= 1
    sa[0] = n - 1
    return np.array(sa, np.int64)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The suffix array of small whole numbers that end with a 0 which occurs nowhere else; induced at every level."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    s = s.astype(np.int64)
    sigma = int(s.max()) + 1
    induced = induce if n >= sigma * PER_NAME else induce_singly
    is_s = types(s)
    sizes = np.bincount(s, minlength=sigma)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    sa = induced(s, is_s, lms, sizes)
    if len(lms) < 2:
        return sa
    flag = np.zeros(n, bool)
    flag[lms] = True
    ranked = sa[flag[sa]]
    following = np.zeros(n, np.int64)
    following[lms] = np.append(lms[1:], n - 1)
    length = following[ranked] - ranked + 1
    a, b = ranked[:-1], ranked[1:]
    same = length[1:] == length[:-1]
    live, k = np.flatnonzero(same), 0
    while len(live):  # compare neighbours' substrings character by character
        differ = s[a[live] + k] != s[b[live] + k]
        same[live[differ]] = False
        k += 1
        live = live[~differ]
        live = live[k < length[live]]
    names = np.append(0, np.cumsum(~same))
    name = np.empty(n, np.int64)
    name[ranked] = names
    reduced = name[lms]
    if names[-1] == len(lms) - 1:
        order = ranked
    else:
        order = lms[suffix_array(reduced)]
    return induced(s, is_s, order, sizes)


def permuted_common_prefixes(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each suffix, the length it shares with the suffix before it in ``sa``.

    Where the characters before both are equal, the value is the previous position's less one; the others are
    compared directly, all at once, character by character.
    """
    n = len(s)
    previous = np.full(n, -1, np.int64)
    previous[sa[1:]] = sa[:-1]
    at = np.arange(n)
    reducible = np.zeros(n, bool)
    inner = (previous > 0) & (at > 0)
    reducible[inner] = s[at[inner] - 1] == s[previous[inner] - 1]
    own = np.flatnonzero(~reducible)
    value = np.zeros(n, np.int64)
    live = own[previous[own] >= 0]
    k = 0
    while len(live):
        fits = (live + k < n) & (previous[live] + k < n)
        live = live[fits]
        live = live[s[live + k] == s[previous[live] + k]]
        value[live] += 1
        k += 1
    last = np.maximum.accumulate(np.where(reducible, -1, at))
    return value[last] - (at - last)
