"""Suffix trees of integer sequences, and longest common extensions from them.

Ukkonen's construction reads a sequence once, from left to right.  The Euler tour of the finished tree visits the leaves in the order of
their suffixes; between two leaves the shallowest node on the tour is their lowest common ancestor, and its depth is the length of the
common beginning of the two suffixes.  A sparse table over the tour answers that in constant time, for whole arrays of pairs.
"""

from __future__ import annotations

import numpy as np


class SuffixTree:
    """The tree of ``word``, a list of integers from 1 on; an end mark of 0 is added, so that each suffix has a leaf."""

    def __init__(self, word: list[int]):
        text = [*word, 0]
        self.n = n = len(text)
        self.width = width = max(text) + 1
        first, last, link, child = [0], [0], [0], {}
        node = edge = length = rest = 0
        for i, c in enumerate(text):
            rest += 1
            fresh = 0
            while rest:
                if not length:
                    edge = i
                key = node * width + text[edge]
                below = child.get(key)
                if below is None:
                    child[key] = len(first)
                    first.append(i)
                    last.append(n)
                    link.append(0)
                    if fresh:
                        link[fresh] = node
                        fresh = 0
                else:
                    at = first[below]
                    size = last[below] - at
                    if length >= size and last[below] != n:
                        node = below
                        edge += size
                        length -= size
                        continue
                    if text[at + length] == c:
                        length += 1
                        if fresh:
                            link[fresh] = node
                        break
                    split = len(first)
                    first += (at, i)
                    last += (at + length, n)
                    link += (0, 0)
                    first[below] = at + length
                    child[key] = split
                    child[split * width + c] = split + 1
                    child[split * width + text[at + length]] = below
                    if fresh:
                        link[fresh] = split
                    fresh = split
                rest -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - rest + 1
        self.first, self.last = first, last
        keys = np.fromiter(child.keys(), np.int64, len(child))
        ends = np.fromiter(child.values(), np.int64, len(child))
        parents, symbols = keys // width, keys % width
        self.falling = self._children(parents, symbols, ends)
        # the end mark comes before all symbols in both orders
        self.rising = self._children(parents, np.where(symbols > 0, width - symbols, 0), ends)

    def _children(self, parents: np.ndarray, symbols: np.ndarray, ends: np.ndarray) -> tuple[list[int], list[int]]:
        """(children by parent, first place of each parent's), last child first, as a stack takes them."""
        order = np.lexsort((-symbols, parents))
        return ends[order].tolist(), np.searchsorted(parents[order], np.arange(len(self.first) + 1)).tolist()

    def tour(self, reverse: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(suffixes in order, depth of the shallowest node between each and the one before); ``reverse`` turns the order of the symbols round."""
        n, first, last = self.n, self.first, self.last
        children, places = self.rising if reverse else self.falling
        suffixes, lows = [], []
        low, resumed = 0, True
        stack = [(x, 0) for x in children[places[0] : places[1]]]
        while stack:
            node, above = stack.pop()
            if resumed:
                low, resumed = above, False
            if last[node] == n and places[node] == places[node + 1]:
                suffixes.append(first[node] - above)
                lows.append(low)
                resumed = True
            else:
                depth = above + last[node] - first[node]
                stack += [(x, depth) for x in children[places[node] : places[node + 1]]]
        return np.array(suffixes), np.array(lows)


def ranks(suffixes: np.ndarray) -> np.ndarray:
    found = np.empty(len(suffixes), np.int64)
    found[suffixes] = np.arange(len(suffixes))
    return found


class Extensions:
    """Lengths of the longest common beginnings of suffixes."""

    def __init__(self, suffixes: np.ndarray, lows: np.ndarray):
        self.rank = ranks(suffixes)
        self.table = [lows.astype(np.int32)]
        while 2 << (len(self.table) - 1) <= len(lows):
            half = 1 << (len(self.table) - 1)
            self.table.append(np.minimum(self.table[-1][:-half], self.table[-1][half:]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For unlike places ``i`` and ``j``, at most the length of the sequence."""
        a, b = self.rank[i], self.rank[j]
        lo, hi = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        found = np.zeros(len(lo), np.int64)
        for k in np.unique(level):
            own = level == k
            found[own] = np.minimum(self.table[k][lo[own]], self.table[k][hi[own] - (1 << int(k))])
        return found


def lyndon_lengths(rank: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word from each place: the distance to the next smaller suffix."""
    order = rank.tolist()
    n = len(order) - 1
    found, stack = [0] * n, [n]
    for i in range(n - 1, -1, -1):
        own = order[i]
        while order[stack[-1]] > own:
            stack.pop()
        found[i] = stack[-1] - i
        stack.append(i)
    return np.array(found, np.int64)


def repetitions(word: list[int], exponent: int = 2, least: int = 2) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of the maximal repetitions of ``word`` of at least ``exponent`` periods and ``least`` symbols, by start, then period.

    Each has a Lyndon root: a place where its period is the longest Lyndon word, in one of the two orders of the symbols.  So the
    candidates are as many as the places, twice; extended to both sides, those long enough are the repetitions.
    """
    n = len(word)
    if n < max(least, exponent):
        return []
    tree = SuffixTree(word)
    suffixes, lows = tree.tour()
    right = Extensions(suffixes, lows)
    left = Extensions(*SuffixTree(word[::-1]).tour())
    at = np.tile(np.arange(n), 2)
    period = np.concatenate((lyndon_lengths(right.rank), lyndon_lengths(ranks(tree.tour(reverse=True)[0]))))
    fits = (exponent * period <= n) & (at + period < n)
    at, period = at[fits], period[fits]
    end = at + period + right(at, at + period)
    start = at - left(n - at, n - at - period)
    held = end - start >= np.maximum(least, exponent * period)
    return sorted(set(zip(start[held].tolist(), (end - start)[held].tolist(), period[held].tolist(), strict=True)), key=lambda x: (x[0], x[2]))
