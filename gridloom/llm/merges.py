"""Merge rounds of byte-pair encoding, over the symbols of many words at once."""

from __future__ import annotations

import heapq

import numpy as np

#: Words of more symbols than this are merged by themselves, place by place, as a round passes over all of a word.
LONG = 256


class Memory:
    """Values by key for about ``most`` keys: those met lately stay, the rest go.

    Keys live in two generations. A key that is met again moves to the young
    one; when that is half of ``most``, it becomes the old one, which goes.
    """

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def missing(self, keys: set[str]) -> list[str]:
        """The keys without a value; all others are in ``young`` afterwards."""
        if len(self.young) > self.most // 2:
            self.old, self.young = self.young, {}
        absent = keys.difference(self.young)
        known = absent.intersection(self.old)
        self.young.update((k, self.old[k]) for k in known)
        return list(absent - known)


_NONE = np.iinfo(np.int64).max


class MergeRounds:
    """Merges by least rank, then from the left, until no pair is left.

    ``pairs`` maps (left, right) to (rank, merged). Symbols are numbers from 0;
    negative ones never merge.
    """

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        self.width = 1 + max((max(a, b) for a, b in pairs), default=0)
        keys = np.array([a * self.width + b for a, b in pairs], dtype=np.int64)
        by = np.argsort(keys)
        self.keys = keys[by]
        self.ranks = np.array([r for r, _ in pairs.values()], dtype=np.int64)[by]
        self.merged = np.array([m for _, m in pairs.values()], dtype=np.int64)[by]
        next_to: dict[int, int] = {}
        for (a, b), (r, _) in pairs.items():
            for s in (a, b):
                next_to[s] = min(next_to.get(s, _NONE), r)
        # Merging all places of a pair at once is the same as one after another,
        # unless the new symbol itself takes part in a pair of as good a rank.
        best = [next_to.get(m, _NONE) for m in self.merged.tolist()]
        self.at_once = np.array(best, dtype=np.int64) > self.ranks
        self.table: dict[int, tuple[int, int]] = {a * self.width + b: x for (a, b), x in pairs.items()}

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where each pair is in the table; -1 if it is no pair."""
        key = left * self.width + right  # out of range or negative: checked below
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        at[(self.keys[at] != key) | (left < 0) | (right < 0) | (right >= self.width)] = -1
        return at

    def merge(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols of all words, and how many each has.

        ``symbols`` are those of the first word, then of the second, and so on.
        """
        done_sym, done_word = [], []
        sym, word = symbols, np.repeat(np.arange(len(sizes)), sizes)
        if len(sizes) and sizes.max() > LONG:
            ends = np.cumsum(sizes)
            for w in np.flatnonzero(sizes > LONG).tolist():
                done_sym.append(self._merge_long(symbols[ends[w] - sizes[w] : ends[w]]))
                done_word.append(np.full(len(done_sym[-1]), w))
            short = (sizes <= LONG)[word]
            sym, word = sym[short], word[short]
        at = np.full(len(sym), -1)
        if len(sym) > 1:
            at[:-1] = np.where(word[1:] == word[:-1], self._pairs(sym[:-1], sym[1:]), -1)
        while len(sym):
            rank = np.where(at >= 0, self.ranks[at], _NONE)
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.r_[start, len(word)])
            least = np.minimum.reduceat(rank, start)
            if (least == _NONE).any():
                over = np.repeat(least == _NONE, size)
                done_sym.append(sym[over])
                done_word.append(word[over])
                sym, word, at, rank = sym[~over], word[~over], at[~over], rank[~over]
                if not len(sym):
                    break
                start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
                size = np.diff(np.r_[start, len(word)])
                least = least[least != _NONE]
            hit = np.flatnonzero(rank == np.repeat(least, size))
            # Of places that overlap in a row, every second from the left.
            fresh = np.r_[True, hit[1:] != hit[:-1] + 1]
            head = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            alone = np.r_[True, word[hit[1:]] != word[hit[:-1]]]
            hit = hit[alone | (self.at_once[at[hit]] & ((np.arange(len(hit)) - head) % 2 == 0) & self._all_at_once(hit, word, at))]
            sym[hit] = self.merged[at[hit]]
            keep = np.ones(len(sym), dtype=bool)
            keep[hit + 1] = False
            new_at = np.cumsum(keep) - 1
            sym, word, at = sym[keep], word[keep], at[keep]
            merged = new_at[hit]
            touched = np.zeros(len(sym) + 1, dtype=bool)
            touched[merged] = touched[merged - 1] = True  # -1 is the spare place at the end
            changed = np.flatnonzero(touched[:-1])
            inner = changed[changed < len(sym) - 1]
            inner = inner[word[inner] == word[inner + 1]]
            at[changed] = -1
            at[inner] = self._pairs(sym[inner], sym[inner + 1])
        out, of = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_sym, done_word))
        by = np.argsort(of, kind="stable")
        return out[by], np.bincount(of, minlength=len(sizes))

    def _merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """One word's final symbols, by a heap of (rank, place): time grows hardly faster than its length."""
        n = len(symbols)
        sym, at = symbols.tolist(), self._pairs(symbols[:-1], symbols[1:])
        rank = np.where(at >= 0, self.ranks[at], _NONE).tolist() + [_NONE]
        heap = [r * n + i for i, r in enumerate(rank) if r != _NONE]
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        width, table, none = self.width, self.table, (_NONE, 0)

        def seen(i: int, j: int) -> None:
            a, b = sym[i], sym[j]
            r = table.get(a * width + b, none)[0] if 0 <= a and 0 <= b < width else _NONE
            rank[i] = r
            if r != _NONE:
                heapq.heappush(heap, r * n + i)

        while heap:
            r, i = divmod(heapq.heappop(heap), n)
            if rank[i] != r:
                continue  # the pair at this place has changed since
            gone = after[i]
            sym[i] = table[sym[i] * width + sym[gone]][1]
            rank[gone] = rank[i] = _NONE
            sym[gone] = None
            j = after[i] = after[gone]
            if j < n:
                before[j] = i
                seen(i, j)
            if before[i] >= 0:
                seen(before[i], i)
        return np.array([x for x in sym if x is not None], dtype=np.int64)

    def _all_at_once(self, hit: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """False for the places of words in which one place must go first."""
        single = ~self.at_once[at[hit]]
        if not single.any():
            return np.ones(len(hit), dtype=bool)
        has_single = np.zeros(word[-1] + 1, dtype=bool)
        has_single[word[hit[single]]] = True
        return ~has_single[word[hit]]
