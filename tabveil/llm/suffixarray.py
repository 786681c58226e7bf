"""Suffix arrays by induced sorting, and their permuted common prefixes, on numpy arrays.

Suffixes are of type S if smaller than the next one, else L; a leftmost S (LMS) begins a substring that ends at the
next LMS. Sorting these substrings by induction names them, the string of names is sorted recursively, and two more
linear scans induce the order of all suffixes, one bucket at a time with array operations. A recursion ends at a string
of so many different names that buckets are small: there ties are refined, by twice as many names each time.
"""

from __future__ import annotations

import numpy as np

SMALL = 1024


def types(s: np.ndarray) -> np.ndarray:
    """True for each suffix of type S; the last symbol is the only smallest one."""
    n = len(s)
    sign = np.sign(s[1:].astype(np.int64) - s[:-1])
    at = np.where(sign != 0, np.arange(n - 1), n - 1)
    following = np.minimum.accumulate(at[::-1])[::-1]  # where the next change is
    out = np.ones(n, dtype=bool)
    out[:-1] = np.append(sign, 1)[following] > 0
    return out


def suffix_array(s: np.ndarray, k: int) -> np.ndarray:
    """The order of the suffixes of s, symbols 0 to k - 1, whose last symbol 0 occurs only there."""
    n = len(s)
    if n <= 2:
        return np.arange(n)[::-1].copy()
    if k > SMALL:
        return ranked(s)
    kind = types(s)
    lms = np.flatnonzero(kind[1:] & ~kind[:-1]) + 1
    if len(lms) > 1:
        order = induced(s, k, kind, lms)
        is_lms = np.zeros(n, dtype=bool)
        is_lms[lms] = True
        order = order[is_lms[order]]
        names = name_substrings(s, lms, order)
        if names.max() + 1 < len(lms):
            lms = lms[suffix_array(names, int(names.max()) + 1)]
        else:
            lms = order
    return induced(s, k, kind, lms)


def name_substrings(s: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each LMS in text order the number of its substring among the different ones, given their order."""
    rank = np.empty(len(s), np.int64)
    rank[lms] = np.arange(len(lms))
    end = np.append(lms[1:], len(s) - 1)
    size = end - lms + 1
    a, b = order[:-1], order[1:]
    differ = size[rank[a]] != size[rank[b]]
    live, step = np.flatnonzero(~differ), 0
    while len(live):
        live = live[step < size[rank[a[live]]]]
        bad = s[a[live] + step] != s[b[live] + step]
        differ[live[bad]] = True
        live = live[~bad]
        step += 1
    names = np.empty(len(lms), np.int64)
    names[rank[order]] = np.concatenate([[0], np.cumsum(differ)])
    return names


def induced(s: np.ndarray, k: int, kind: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, given the LMS in order (or, to sort their substrings, in any)."""
    n = len(s)
    sa = np.full(n, -1, np.int64)
    size = np.bincount(s, minlength=k)
    stop = np.cumsum(size)
    start = stop - size
    n_lms = np.bincount(s[lms], minlength=k)
    by_symbol = lms[np.argsort(s[lms], kind="stable")]
    at = np.arange(len(lms)) - np.repeat(np.cumsum(n_lms) - n_lms, n_lms)
    sa[np.repeat(stop - n_lms, n_lms) + at] = by_symbol
    head = start.copy()

    def send(q: np.ndarray, where: np.ndarray, step: int) -> None:
        symbol = s[q]
        order = np.argsort(symbol, kind="stable")
        q, symbol = q[order], symbol[order]
        first = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]])) if len(q) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(q)))
        nth = np.arange(len(q)) - np.repeat(first, count)
        if step > 0:
            sa[where[symbol] + nth] = q
            where[symbol[first]] += count
        else:
            sa[where[symbol] - 1 - nth] = q
            where[symbol[first]] -= count

    present = np.flatnonzero(size).tolist()
    for c in present:  # L from left to right
        lo = start[c]
        q = sa[lo : head[c]]
        while len(q):
            p = q[q > 0] - 1
            q = p[s[p] == c]
            sa[head[c] : head[c] + len(q)] = q
            head[c] += len(q)
        q = np.concatenate([sa[lo : head[c]], sa[stop[c] - n_lms[c] : stop[c]]])
        p = q[q > 0] - 1
        send(p[s[p] > c], head, 1)
    tail = stop.copy()
    tail[0] = start[0]  # the last suffix keeps its place
    sa[0] = n - 1
    for c in present[::-1]:  # S from right to left
        hi = stop[c]
        q = sa[tail[c] : hi][::-1]
        while len(q) and c:
            p = q[q > 0] - 1
            q = p[s[p] == c]
            sa[tail[c] - len(q) : tail[c]] = q[::-1]
            tail[c] -= len(q)
        q = np.concatenate([sa[tail[c] : hi][::-1], sa[start[c] : head[c]][::-1]])
        p = q[q > 0] - 1
        send(p[s[p] < c], tail, -1)
    return sa


def ranked(s: np.ndarray) -> np.ndarray:
    """The order of the suffixes of a string of many different symbols: by one symbol, then only ties, by twice as many each time."""
    order = np.argsort(s, kind="stable")
    new = np.append(True, s[order[1:]] != s[order[:-1]])
    rank = np.empty(len(s), np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    tied, known = np.flatnonzero(~(new & np.append(new[1:], True))), 1
    while len(tied):
        i = order[tied]
        key = rank[i] * len(s) + rank[i + known]  # the last symbol occurs once, so no tie reaches it
        by = np.argsort(key, kind="stable")
        i, key = i[by], key[by]
        order[tied] = i
        new = np.append(True, key[1:] != key[:-1])
        rank[i] = np.maximum.accumulate(np.where(new, tied, 0))
        tied = tied[~(new & np.append(new[1:], True))]
        known *= 2
    return order


def permuted_prefixes(s: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each suffix, in text order, what it has in common with the one before it in sa, up to `most` symbols."""
    n = len(s)
    before = np.empty(n, np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    wide = np.zeros(n + most + 16, np.uint16)
    wide[:n] = s
    four = wide.astype(np.uint64)
    four = four[:-3] | four[1:-2] << np.uint64(16) | four[2:-1] << np.uint64(32) | four[3:] << np.uint64(48)
    out = np.zeros(n, np.int64)
    live = np.flatnonzero(before >= 0)
    done = 0
    while len(live) and done < most:
        live = live[(live + done < n) & (before[live] + done < n)]
        x, y = four[live + done], four[before[live] + done]
        same = x == y
        rest = np.flatnonzero(~same)
        d = x[rest] ^ y[rest]
        out[live[rest]] = done + (d & np.uint64(0xFFFF) == 0) + (d & np.uint64(0xFFFFFFFF) == 0) + (d & np.uint64(0xFFFFFFFFFFFF) == 0)
        live = live[same]
        done += 4
        out[live] = done
    return np.minimum(out, most)
