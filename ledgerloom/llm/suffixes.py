"""Suffix arrays by induced sorting, and permuted common prefixes, in whole-array steps."""

from __future__ import annotations

import numpy as np


def _classify(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it; the last one is not."""
    n = len(text)
    smaller = np.zeros(n, bool)
    if n < 2:
        return smaller
    change = np.flatnonzero(text[:-1] != text[1:])
    # Every place takes the class of the next place where the text changes.
    ahead = np.searchsorted(change, np.arange(n - 1))
    known = ahead < len(change)
    at = change[ahead[known]]
    smaller[:-1][known] = text[at] < text[at + 1]
    return smaller


class _Buckets:
    """A suffix array under construction; one bucket for each first symbol."""

    def __init__(self, text: np.ndarray, smaller: np.ndarray, symbols: int):
        self.text, self.smaller = text, smaller
        self.size = np.bincount(text, minlength=symbols)
        self.begin = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.end = self.begin + self.size
        self.order = np.full(len(text), -1, np.int64)

    def induce(self, seeds: np.ndarray) -> np.ndarray:
        """The order of all suffixes from the given order of the leftmost-smaller ones.

        ``seeds`` lie at their buckets' ends. Larger-type suffixes follow from left to right,
        smaller-type ones from right to left; a bucket is taken in whole steps, again for what
        it adds to itself.
        """
        text, smaller, order = self.text, self.smaller, self.order
        symbols = np.flatnonzero(self.size)
        seed_symbol = text[seeds]
        seed_count = np.bincount(seed_symbol, minlength=len(self.size))
        seed_begin = np.concatenate([[0], np.cumsum(seed_count)[:-1]])
        sorted_seeds = seeds[np.argsort(seed_symbol, kind="stable")]
        fill = self.begin.copy()

        def put_front(places: np.ndarray) -> None:
            before = places[places > 0] - 1
            before = before[~smaller[before]]
            if not len(before):
                return
            symbol = text[before]
            by = np.argsort(symbol, kind="stable")
            before, symbol = before[by], symbol[by]
            first = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
            many = np.diff(np.append(first, len(symbol)))
            rank = np.arange(len(symbol)) - np.repeat(first, many)
            order[fill[symbol] + rank] = before
            fill[symbol[first]] += many

        # The last suffix is of the larger type and comes from beyond the end of the text.
        last = len(text) - 1
        order[fill[text[last]]] = last
        fill[text[last]] += 1
        for c in symbols:
            done = self.begin[c]
            while done < fill[c]:
                some = order[done:fill[c]].copy()
                done = fill[c]
                put_front(some)
            if seed_count[c]:
                put_front(sorted_seeds[seed_begin[c]:seed_begin[c] + seed_count[c]])
        larger_end = fill.copy()

        fill = self.end.copy()

        def put_back(places: np.ndarray) -> None:
            """``places`` come from right to left."""
            before = places[places > 0] - 1
            before = before[smaller[before]]
            if not len(before):
                return
            symbol = text[before]
            by = np.argsort(symbol, kind="stable")
            before, symbol = before[by], symbol[by]
            first = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
            many = np.diff(np.append(first, len(symbol)))
            rank = np.arange(len(symbol)) - np.repeat(first, many)
            order[fill[symbol] - 1 - rank] = before
            fill[symbol[first]] -= many

        for c in symbols[::-1]:
            done = self.end[c]
            while done > fill[c]:
                some = order[fill[c]:done][::-1].copy()
                done = fill[c]
                put_back(some)
            put_back(order[self.begin[c]:larger_end[c]][::-1].copy())
        return order


def _names(text: np.ndarray, sorted_lms: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """A number for each leftmost-smaller substring, in their order; equal ones share it."""
    after = np.empty(len(text) + 1, np.int64)
    after[lms] = np.append(lms[1:], len(text) - 1)
    length = after[sorted_lms] - sorted_lms + 1
    same = length[1:] == length[:-1]
    alive = np.flatnonzero(same)
    step = 0
    while len(alive):
        alive = alive[length[alive] > step]
        if not len(alive):
            break
        equal = text[sorted_lms[alive] + step] == text[sorted_lms[alive + 1] + step]
        same[alive[~equal]] = False
        alive = alive[equal]
        step += 1
    # The last substring runs to the end of the text and equals no other.
    final = np.flatnonzero(sorted_lms == lms[-1])[0]
    if final > 0:
        same[final - 1] = False
    if final < len(same):
        same[final] = False
    return np.concatenate([[0], np.cumsum(~same)])


def _by_doubling(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a string of names by their first ``depth`` names.

    A string of names has too many symbols for bucket steps, so ranks are doubled. Ties keep
    their order in the text.
    """
    n = len(names)
    rank, reach = names.astype(np.int64), 1
    while True:
        order = np.argsort(rank, kind="stable")
        ranked = rank[order]
        fresh = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if reach >= depth or fresh[-1] == n - 1:
            return order
        second = np.zeros(n, np.int64)
        if reach < n:
            second[:-reach] = rank[reach:] + 1
        rank = rank * (n + 1) + second
        reach *= 2


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of all suffixes of a byte string, ordered by at least their first ``depth`` bytes.

    Suffixes are classified; the leftmost-smaller substrings are sorted by one round of
    induction and named; the string of names is sorted; that order induces all the others.
    """
    if len(text) < 3:
        return np.array(sorted(range(len(text)), key=lambda i: text[i:].tolist()), np.int64)
    text = text.astype(np.uint8)
    smaller = _classify(text)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if not len(lms):
        return _Buckets(text, smaller, 256).induce(lms)
    rough = _Buckets(text, smaller, 256).induce(lms)
    is_lms = np.zeros(len(text), bool)
    is_lms[lms] = True
    sorted_lms = rough[is_lms[rough]]
    names = _names(text, sorted_lms, lms)
    if names[-1] < len(lms) - 1:
        number = np.empty(len(text), np.int64)
        number[sorted_lms] = names
        sorted_lms = lms[_by_doubling(number[lms], depth)]
    return _Buckets(text, smaller, 256).induce(sorted_lms)


def permuted_prefixes(text: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """For each place, the prefix it shares with its left neighbour in the order, at most ``cap``.

    In text order, places whose neighbours also follow each other form chains: one comparison
    at each place tells where all of a chain's prefixes end, and only what runs beyond a
    chain's end is compared further.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    place = np.arange(n)
    linked = np.zeros(n, bool)
    linked[1:] = (before[1:] == before[:-1] + 1) & (before[:-1] >= 0)
    differs = (before < 0) | (text != text[before])
    ends = np.flatnonzero(np.append(~linked[1:], True))
    more = np.zeros(len(ends), np.int64)
    alive = np.flatnonzero(before[ends] >= 0)
    step = 1
    while len(alive) and step <= cap:
        left, right = ends[alive] + step, before[ends[alive]] + step
        inside = (left < n) & (right < n)
        alive, left, right = alive[inside], left[inside], right[inside]
        alive = alive[text[left] == text[right]]
        more[alive] += 1
        step += 1
    chain = np.searchsorted(ends, place)
    stop = np.where(differs, place, n + cap)
    chain_stop = np.minimum.accumulate(stop[::-1])[::-1]
    end = ends[chain]
    shared = np.where(chain_stop <= end, chain_stop - place, end + 1 + more[chain] - place)
    return np.minimum(shared, cap)


def repeated_windows(text: np.ndarray, width: int) -> np.ndarray:
    """True at each place whose next ``width`` bytes also start at another place."""
    order = suffix_array(text, width)
    shared = permuted_prefixes(text, order, width) >= width
    found = shared.copy()
    left = order[:-1][shared[order[1:]]]
    found[left] = True
    return found
