"""Suffix arrays by induced sorting, and permuted common prefixes, as array passes.

``suffix_arrays`` sorts the suffixes of many strings, each for itself.  It classifies
suffixes as larger (L) or smaller (S) than the next one, sorts the leftmost-smaller
(LMS) substrings by one round of inducing, names them, sorts the strings of names
recursively, and induces the whole arrays from the sorted LMS suffixes.

All strings go through a round side by side: a scan of one character's bucket is one
array step over that bucket of every string.  All entries that are there already pass
on their predecessors at once, and entries that fall into the same bucket (runs of one
character) form the next step.  So a round takes as many steps as the string with most
characters (or names) has of them, and strings are best taken together that are about
as long as each other and not too long.
"""

from __future__ import annotations

import numpy as np


class _Strings:
    """Strings end to end, each followed by a sentinel, 0; characters are numbered by string, so that buckets are."""

    def __init__(self, symbols: np.ndarray, begin: np.ndarray):
        k, n = len(begin) - 1, len(symbols) + len(begin) - 1
        last = begin[1:] + np.arange(k)
        self.text = np.zeros(n, np.uint16 if symbols.max(initial=0) < 65535 else np.int32)
        inside = np.ones(n, bool)
        inside[last] = False
        self.text[inside] = symbols
        self.text[inside] += 1
        self.sigma = int(self.text.max()) + 1
        self.owner = np.repeat(np.arange(k, dtype=np.int32), np.diff(begin) + 1)
        #: Bucket of each character: all strings' of one character follow each other.
        self.key = self.text.astype(np.int32 if k * self.sigma < 1 << 31 else np.int64) * k + self.owner
        # S where the next different character is larger; sentinels are S.
        differs = np.flatnonzero(self.text[1:] != self.text[:-1])
        after = np.diff(np.append(differs, n - 1), prepend=-1)
        self.is_s = np.repeat(np.append(self.text[differs + 1] > self.text[differs], True), after)[: n - 1]
        self.is_s = np.append(self.is_s, True)
        self.is_s[last] = True
        self.lms = np.flatnonzero(self.is_s[1:] & ~self.is_s[:-1]) + 1
        count = np.bincount(self.key, minlength=k * self.sigma).reshape(self.sigma, k)
        self.tails = np.cumsum(count, axis=0)
        self.tails += begin[:-1] + np.arange(k) - 1
        self.heads = self.tails - count + 1
        #: Whether the entry before belongs to the string, and is L or S.
        first = np.zeros(n, bool)
        first[np.append(0, last[:-1] + 1)] = True
        before_s = np.empty(n, bool)
        before_s[0], before_s[1:] = False, self.is_s[:-1]
        self.l_before, self.s_before = ~first & ~before_s, ~first & before_s

    def deal(self, sa: np.ndarray, place: np.ndarray, items: np.ndarray, step: int) -> None:
        """Put items, in order, at their characters' next free places, which move by ``step``."""
        key, m = self.key[items], len(items)
        if m <= FEW:
            for i, c in zip(items.tolist(), key.tolist(), strict=True):
                at = place[c]
                sa[at] = i
                place[c] = at + step
            return
        order = key.argsort(kind="stable")
        key = key[order]
        new = np.ones(m + 1, bool)
        np.not_equal(key[1:], key[:-1], out=new[1:-1])
        first = new.nonzero()[0]
        to = np.arange(m)
        to -= first[:-1].repeat(first[1:] - first[:-1])
        to *= step
        to += place[key]
        sa[to] = items[order]
        last = first[1:] - 1
        place[key[last]] = to[last] + step

    def induce(self, lms: np.ndarray) -> np.ndarray:
        """The suffix arrays that these LMS suffixes, in this order within each string, induce."""
        sa = np.full(len(self.text), -1, np.int32)
        back = self.tails.copy()
        self.deal(sa, back.reshape(-1), lms[::-1], -1)
        is_lms_place = sa >= 0
        smaller = self.tails - back
        some_lms = smaller.any(axis=1).tolist()
        head = self.heads.copy()
        flat = head.reshape(-1)
        for c in range(self.sigma):
            at = self.heads[c]
            while (items := _between(sa, at, head[c])) is not None:
                at = head[c].copy()
                items = items[self.l_before[items]]
                if len(items):
                    self.deal(sa, flat, items - 1, 1)
            if some_lms[c]:
                items = _between(sa, back[c] + 1, self.tails[c] + 1)
                items = items[self.l_before[items]]
                if len(items):
                    self.deal(sa, flat, items - 1, 1)
        # S suffixes are found anew; the sentinels, first of all, stay.
        is_lms_place[self.heads[0]] = False
        sa[is_lms_place] = -1
        tail = self.tails.copy()
        flat = tail.reshape(-1)
        for c in range(self.sigma - 1, 0, -1):
            at = self.tails[c]
            while (items := _between(sa, tail[c] + 1, at + 1)) is not None:
                at = tail[c].copy()
                items = items[self.s_before[items]]
                if len(items):
                    self.deal(sa, flat, items[::-1] - 1, -1)
            items = _between(sa, self.heads[c], head[c])
            if items is not None:
                items = items[self.s_before[items]]
                if len(items):
                    self.deal(sa, flat, items[::-1] - 1, -1)
        return sa


#: Items that are put in their places one by one.
FEW = 40


def _between(sa: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray | None:
    """What is in these ranges, end to end; None if nothing."""
    size = end - begin
    some = size.nonzero()[0]
    if len(some) <= 1:
        return sa[begin[some[0]] : end[some[0]]] if len(some) else None
    size, upto = size[some], size[some].cumsum()
    return sa[np.arange(upto[-1]) + (begin[some] - upto + size).repeat(size)]


def suffix_arrays(symbols: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Suffix arrays (int32) of the strings of non-negative integers that ``begin`` (one more than there are) parts, end to end.

    A suffix that is a prefix of another comes first.  No string may be empty.
    """
    t = _Strings(symbols, begin)
    lms = t.lms
    sa = t.induce(lms)
    is_lms = np.zeros(len(sa), bool)
    is_lms[lms] = True
    order = sa[is_lms[sa]].astype(np.int64)
    following = np.zeros(len(sa), np.int64)
    following[lms[:-1]] = lms[1:]
    # From an LMS suffix to the next one; a sentinel's ends with itself.
    length = np.where(t.text[order] > 0, following[order] - order + 1, 1)
    owner = t.owner[order]
    new = owner[1:] != owner[:-1]
    name = np.concatenate([[0], np.cumsum(~(~new & _equal_spans(t.text, order[:-1], order[1:], length[:-1], length[1:])))])
    first = np.flatnonzero(np.concatenate([[True], new]))
    count = np.diff(np.append(first, len(order)))
    name -= np.repeat(name[first], count)
    # Strings whose names all differ are in order.
    again = name[first + count - 1] < count - 1
    if again.any():
        named = np.empty(len(sa), np.int64)
        named[order] = name
        left = np.repeat(again, count)
        part = lms[left]
        order[left] = part[suffix_arrays(named[part], np.concatenate([[0], np.cumsum(count[again])]))]
    if (count > 1).any():
        sa = t.induce(order)
    inside = t.text > 0
    # Places without the sentinels, which each come first of their string.
    sa = sa[t.text[sa] > 0]
    return (np.cumsum(inside) - 1).astype(np.int32)[sa]


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix array (int32) of one string."""
    return suffix_arrays(symbols, np.array([0, len(symbols)])) if len(symbols) else np.zeros(0, np.int32)


def _equal_spans(text: np.ndarray, a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    same = la == lb
    left = np.flatnonzero(same)
    k = 0
    while len(left):
        ok = text[a[left] + k] == text[b[left] + k]
        same[left[~ok]] = False
        k += 1
        left = left[ok]
        left = left[la[left] > k]
    return same


def permuted_lcp(text: np.ndarray, sa: np.ndarray, most: int, fresh: np.ndarray | None = None, begin: np.ndarray | None = None) -> np.ndarray:
    """Common prefix of each suffix, by text position, with the one before it in the array, up to ``most``.

    The first suffix of each string, of those that ``begin`` parts, has none before it.

    Only irreducible values are compared character by character, those whose left
    neighbours differ; each other one is its left neighbour's less one.  A value
    compared up to ``most`` counts as ``most``, so what follows from it is a lower
    bound: positions in ``fresh`` start a new comparison, and between two of them
    a value is exact up to ``most`` less the distance.
    """
    n = len(text)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    if begin is not None:
        phi[sa[begin[:-1]]] = -1
    at = np.arange(n)
    reducible = (at > 0) & (phi > 0)
    reducible[1:] &= text[:-1] == text[np.maximum(phi[1:] - 1, 0)]
    if fresh is not None:
        reducible[fresh] = False
    if begin is not None:
        starts = np.zeros(n + 1, bool)
        starts[begin] = True
        reducible &= ~starts[phi]
    start = np.flatnonzero(~reducible)
    value = np.zeros(n, np.int64)
    left = start[phi[start] >= 0]
    other = phi[left]
    padded = np.concatenate([text.astype(np.uint16) + 1, np.zeros(most + 8, np.uint16)])
    words = np.ndarray((len(padded) - 3,), np.uint64, padded, strides=(2,))
    k = 0
    while len(left) and k < most:
        ok = words[left + k] == words[other + k]
        ended = ~ok
        if ended.any():
            i, j = left[ended], other[ended]
            more = np.zeros(len(i), np.int64)
            live = np.ones(len(i), bool)
            for d in range(4):
                a, b = padded[i + k + d], padded[j + k + d]
                live &= (a == b) & (a > 0)
                more += live
            value[i] = np.minimum(k + more, most)
        left, other = left[ok], other[ok]
        k += 4
    value[left] = most
    source = np.maximum.accumulate(np.where(reducible, 0, at))
    return np.maximum(value[source] - (at - source), 0)
