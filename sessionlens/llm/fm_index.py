"""A bidirectional FM-index over delimited words, searched for many words at once.

The text is ``$w1$w2$...$wn$`` of sorted words, a second one holds the reversed words, sorted
too.  Delimiters rank in order, so a suffix is compared up to the next delimiter only and
the last-to-first mapping holds.  ``below[i, c]`` counts the symbols under ``c`` before rank
``i``: one table gives both the occurrences of a symbol and of all smaller ones, which keeps
the intervals of a pattern in step in both texts while it grows to either side.
"""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray, longest: int) -> np.ndarray:
    """Suffixes of delimited words (symbol 0 delimits) in order, by prefix doubling."""
    n = len(symbols)
    delimiter = symbols == 0
    rank = symbols.astype(np.int64) + int(delimiter.sum())
    rank[delimiter] = np.arange(int(delimiter.sum()))
    width = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - width)] = rank[width:] + 1
        key = rank * (n + int(symbols.max(initial=0)) + 2) + after
        order = np.argsort(key, kind="stable")
        if width > longest:
            return order
        key = key[order]
        fresh = np.r_[False, key[1:] != key[:-1]]
        rank[order] = np.cumsum(fresh)
        width *= 2


class Half:
    """One of the two texts: extending a pattern to its left."""

    def __init__(self, raw: np.ndarray, lengths: np.ndarray, code: np.ndarray, size: int):
        ends = np.cumsum(lengths + 1)
        text = np.zeros(int(ends[-1]) + 1, np.uint8)
        inside = np.ones(len(text), bool)
        inside[0] = inside[ends] = False
        text[inside] = code[raw]
        order = suffix_order(text, int(lengths.max()))
        before = text[order - 1].copy()
        # the text is no circle: nothing stands before its first delimiter
        before[0] = 255
        counts = np.zeros((len(text) + 1, size + 1), np.int32)
        counts[np.arange(1, len(text) + 1)[before < size], before[before < size] + 1] = 1
        np.cumsum(counts, axis=0, out=counts)
        self.below = np.cumsum(counts, axis=1, out=counts)
        self.starts = np.r_[0, np.cumsum(np.bincount(text, minlength=size))]
        self.total = len(text)

    def extend(self, low: np.ndarray, other: np.ndarray, count: np.ndarray, symbol: np.ndarray):
        """Intervals of ``symbol + pattern``: own rank, rank in the other text, size."""
        a, b = self.below[low, symbol], self.below[low + count, symbol]
        up = self.below[low, symbol + 1] - a
        size = self.below[low + count, symbol + 1] - b - up
        return self.starts[symbol] + up, other + (b - a), size


class FMIndex:
    """Distinct words of 8-bit symbols; ``raw`` holds them one after the other."""

    def __init__(self, words: list[bytes]):
        self.words = sorted(words)
        backward = sorted(w[::-1] for w in words)
        used = np.unique(np.frombuffer(b"".join(self.words), np.uint8))
        self.code = np.zeros(256, np.uint8)
        self.code[used] = np.arange(1, len(used) + 1)
        self.size = len(used) + 1
        self.known = np.zeros(256, bool)
        self.known[used] = True
        self.left, self.right = (
            Half(np.frombuffer(b"".join(w), np.uint8), np.array([len(x) for x in w]), self.code, self.size) for w in (self.words, backward)
        )
        self.backward = backward

    def near(self, queries: list[bytes], half: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """Words one edit from a query that begin with its first ``half`` symbols, of which each
        query has one at least: query numbers and words, each pair once.

        The half is matched from its last symbol to the left, up to the delimiter; the other
        half is then matched to the right, with one symbol replaced, added or left out.  All
        queries move in step, a place a round.
        """
        lengths = np.array([len(q) for q in queries], np.int64)
        flat = np.frombuffer(b"".join(queries), np.uint8)
        # a symbol that no word has can only be replaced or left out
        symbols = np.where(self.known[flat], self.code[flat], self.size).astype(np.int64)
        at = np.cumsum(lengths) - lengths
        total = self.right.total
        query = np.arange(len(queries))
        # before the first delimiter stands nothing, so it is missing among the smaller symbols
        low, other, count = (np.full(len(queries), v, np.int64) for v in (0, 1, total))
        for step in range(int(half.max(initial=0)) + 1):
            symbol = np.where(step < half[query], symbols[at[query] + np.maximum(half[query] - 1 - step, 0)], 0)
            going = (step <= half[query]) & (symbol < self.size)
            done = step > half[query]
            new = self.left.extend(low[going], other[going], count[going], symbol[going])
            low[going], other[going], count[going] = new
            keep = (going & (count > 0)) | done
            query, low, other, count = query[keep], low[keep], other[keep], count[keep]
        # from here on only the text of reversed words is walked
        exact = (query, half[query], other, count)
        edited = tuple(np.zeros(0, np.int64) for _ in exact)
        found_query, found_rank = [], []
        while len(exact[0]) or len(edited[0]):
            ended = edited[1] == lengths[edited[0]]
            final = self._step(tuple(v[ended] for v in edited), np.zeros(int(ended.sum()), np.int64), 0)
            found_query.append(final[0])
            found_rank.append(final[2])
            going = tuple(v[~ended] for v in edited)
            going = self._step(going, symbols[at[going[0]] + going[1]], 1)
            branches = self._branches(exact, at, lengths, symbols)
            inner = exact[1] < lengths[exact[0]]
            exact = tuple(v[inner] for v in exact)
            exact = self._step(exact, symbols[at[exact[0]] + exact[1]], 1)
            edited = tuple(np.concatenate(v) for v in zip(going, *branches, strict=True))
        query = np.concatenate(found_query) if found_query else np.zeros(0, np.int64)
        rank = np.concatenate(found_rank) if found_rank else np.zeros(0, np.int64)
        # the rank of a delimiter is the number of the word after it
        pairs = np.unique(np.stack([query, rank]), axis=1)
        return pairs[0], [self.backward[k][::-1] for k in pairs[1].tolist()]

    def _step(self, state, symbol: np.ndarray, move: int):
        query, at, low, count = state
        known = symbol < self.size
        query, at, low, count, symbol = query[known], at[known], low[known], count[known], symbol[known]
        low, _, count = self.right.extend(low, low, count, symbol)
        some = count > 0
        return query[some], at[some] + move, low[some], count[some]

    def _branches(self, exact, at, lengths, symbols):
        """States after one edit at the place of each exact state."""
        query, place, low, count = exact
        rows = self.right.below[low + count] - self.right.below[low]
        size = np.diff(rows, axis=1)
        size[:, 0] = 0
        state, symbol = np.nonzero(size)
        added = (
            query[state], place[state],
            self.right.starts[symbol] + self.right.below[low[state], symbol + 1] - self.right.below[low[state], symbol],
            size[state, symbol].astype(np.int64),
        )
        inner = place < lengths[query]
        left_out = query[inner], place[inner] + 1, low[inner], count[inner]
        own = np.full(len(query), -1, np.int64)
        own[inner] = symbols[at[query[inner]] + place[inner]]
        other = inner[state] & (symbol != own[state])
        replaced = tuple(v[other] for v in (added[0], added[1] + 1, added[2], added[3]))
        return added, left_out, replaced
