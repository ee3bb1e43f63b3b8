"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy."""

from __future__ import annotations

import numpy as np

from postlens.llm.shared import by_value

by_value(__name__)


def classify(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it (S-type); the closing symbol is S-type."""
    n = len(s)
    small = np.ones(n, bool)
    if n > 1:
        step = np.sign(s[1:] - s[:-1])
        # In a run of equal symbols the types are that of the run's end.
        ends = np.where(step != 0, np.arange(n - 1), n - 2)
        small[:-1] = step[np.minimum.accumulate(ends[::-1])[::-1]] > 0
    return small


def _back_places(s: np.ndarray, order: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of suffixes, in order, at the backs of their buckets; and where those parts begin."""
    symbols = s[order]
    by = np.argsort(symbols, kind="stable")
    values, first, number = np.unique(symbols[by], return_index=True, return_counts=True)
    low = ends.copy()
    low[values] -= number
    return by, np.repeat(low[values] - first, number) + np.arange(len(by)), low


def _induce_buckets(s: np.ndarray, small: np.ndarray, counts: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Induce for few symbols: all known entries of a bucket are taken at once, and those that they put into the
    same bucket are the next wave; so the steps follow the runs of equal symbols, not the length."""
    ends = np.cumsum(counts)
    starts, sa = ends - counts, np.full(len(s), -1, np.int64)
    by, places, low = _back_places(s, order, ends)
    sa[places] = order[by]
    head, tail, used = starts.copy(), ends.copy(), np.flatnonzero(counts)

    def push(part: np.ndarray, front: bool) -> None:
        before = part[part > 0] - 1
        before = before[small[before] != front]
        if not len(before):
            return
        symbols = s[before]
        by = np.argsort(symbols, kind="stable")
        values, first, number = np.unique(symbols[by], return_index=True, return_counts=True)
        rank = np.arange(len(by)) - np.repeat(first, number)
        if front:
            sa[np.repeat(head[values], number) + rank] = before[by]
            head[values] += number
        else:
            sa[np.repeat(tail[values], number) - 1 - rank] = before[by]
            tail[values] -= number

    for c in used:
        done = starts[c]
        while head[c] > done:
            part, done = sa[done : head[c]].copy(), head[c]
            push(part, True)
        push(sa[low[c] : ends[c]].copy(), True)
    for c in used[::-1]:
        done = ends[c]
        while tail[c] < done:
            part, done = sa[tail[c] : done][::-1].copy(), tail[c]
            push(part, False)
        push(sa[starts[c] : head[c]][::-1].copy(), False)
    sa[0] = len(s) - 1
    return sa


def _induce_entries(s: np.ndarray, small: np.ndarray, counts: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Induce for many symbols, entry by entry."""
    ends = np.cumsum(counts)
    sa = np.full(len(s), -1, np.int64)
    by, places, _ = _back_places(s, order, ends)
    sa[places] = order[by]
    text, kinds, out = s.tolist(), small.tolist(), sa.tolist()
    head = (ends - counts).tolist()
    for i in range(len(out)):
        j = out[i] - 1
        if j >= 0 and not kinds[j]:
            c = text[j]
            out[head[c]] = j
            head[c] += 1
    tail = ends.tolist()
    for i in range(len(out) - 1, -1, -1):
        j = out[i] - 1
        if j >= 0 and kinds[j]:
            c = text[j]
            tail[c] -= 1
            out[tail[c]] = j
    out[0] = len(s) - 1
    return np.array(out, np.int64)


def _names(s: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Ranks of the leftmost-smaller substrings in `ordered`; equal substrings share one."""
    length = np.zeros(len(s), np.int64)
    length[lms[:-1]] = np.diff(lms)
    a, b = ordered[:-1], ordered[1:]
    differ = length[a] != length[b]
    left, step = np.flatnonzero(~differ), 0
    while len(left):
        x, y = a[left], b[left]
        unequal = s[x + step] != s[y + step]
        differ[left[unequal]] = True
        left = left[~unequal & (step < length[x])]
        step += 1
    return np.concatenate([[0], np.cumsum(differ)])


def _sort(s: np.ndarray) -> np.ndarray:
    """Suffix array of symbols that end in a single 0, their smallest."""
    if len(s) < 2:
        return np.zeros(len(s), np.int64)
    small = classify(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    counts = np.bincount(s)
    induce = _induce_buckets if len(counts) <= 1024 else _induce_entries
    sa = induce(s, small, counts, lms)
    if len(lms) > 1:
        leftmost = np.zeros(len(s), bool)
        leftmost[lms] = True
        ordered = sa[leftmost[sa]]
        names = _names(s, lms, ordered)
        if names[-1] + 1 < len(lms):
            rank = np.zeros(len(s), np.int64)
            rank[ordered] = names
            ordered = lms[_sort(rank[lms])]
        sa = induce(s, small, counts, ordered)
    return sa


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of non-negative symbols in ascending order."""
    return _sort(np.append(symbols.astype(np.int64) + 1, 0))[1:]


def permuted_prefixes(symbols: np.ndarray, sa: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """(before, plcp) in text order: the suffix before each one in the suffix array, and the length of the prefix
    that the two share, counted up to `cap`. The first suffix has itself before it and 0."""
    n = len(symbols)
    before = np.zeros(n, np.int64)
    if not n:
        return before, before.copy()
    before[sa[1:]], before[sa[0]] = sa[:-1], sa[0]
    padded = np.concatenate([symbols.astype(np.uint16) + 1, np.zeros(cap + 4, np.uint16)])
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 4)).view("<u8").ravel()
    plcp, left = np.zeros(n, np.int64), np.flatnonzero(before != np.arange(n))
    for step in range(0, cap, 4):
        apart = words[left + step] ^ words[before[left] + step]
        same = apart == 0
        low = apart[~same] & (~apart[~same] + np.uint64(1))
        plcp[left[~same]] = step + np.log2(low.astype(float)).astype(np.int64) // 16
        left = left[same]
    plcp[left] = cap
    return before, np.minimum(plcp, cap)


def repeated_starts(symbols: np.ndarray, length: int) -> np.ndarray:
    """True where the `length` symbols from there occur at another start, too (the end counts as a symbol)."""
    sa = suffix_array(symbols)
    before, plcp = permuted_prefixes(symbols, sa, length)
    out = plcp >= length
    out[before[plcp >= length]] = True
    return out
