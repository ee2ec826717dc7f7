"""Sorted words as a trie, worked on depth by depth with all nodes of one depth at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from . import _tokens as T

#: Characters of a word that goes into a trie.
WIDEST = 40
BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.array([pow(int(BASE), k, 1 << 64) for k in range(WIDEST + 1)], np.uint64)


class Table:
    """64-bit keys and their numbers; lookups of many at once."""

    BITS = 22

    def __init__(self, keys: np.ndarray, numbers: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.numbers = keys[order], numbers[order]
        self.maybe = np.zeros(1 << self.BITS, bool)
        self.maybe[T.mix(self.keys) >> np.uint64(64 - self.BITS)] = True

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 if it has none."""
        out = np.full(len(keys), -1, np.int64)
        if len(self.keys):
            some = np.flatnonzero(self.maybe[T.mix(keys) >> np.uint64(64 - self.BITS)])
            at = np.minimum(np.searchsorted(self.keys, keys[some]), len(self.keys) - 1)
            hit = self.keys[at] == keys[some]
            out[some[hit]] = self.numbers[at[hit]]
        return out


def scrambled(text: str) -> np.ndarray:
    """A 64-bit number of each character."""
    return T.mix(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1))


def hash_of(text: str) -> np.uint64:
    out = np.uint64(0)
    with np.errstate(over="ignore"):
        for c in scrambled(text):
            out = out * BASE + c
    return out


class Trie:
    """The trie of words that come sorted, none empty or longer than WIDEST; node[d][w] is the node of the first d characters of word w."""

    def __init__(self, words: list[str], pieces: Table, longest: int):
        self.pieces, self.longest = pieces, longest
        self.n = np.fromiter(map(len, words), np.int64, len(words))
        self.wide = int(self.n.max())
        chars = np.zeros((len(words), self.wide), np.uint64)
        chars[np.arange(self.wide) < self.n[:, None]] = scrambled("".join(words))
        same = np.zeros(chars.shape, bool)
        same[1:] = np.logical_and.accumulate((chars[1:] == chars[:-1]) & (chars[1:] > 0), axis=1)
        # hashes of the beginnings of each word; that of a part follows from two of them
        self.hashes = [np.zeros(len(words), np.uint64)]
        self.node, self.heads = [np.zeros(len(words), np.int32)], [np.zeros(1, np.int64)]
        with np.errstate(over="ignore"):
            for d in range(1, self.wide + 1):
                self.hashes.append(self.hashes[-1] * BASE + chars[:, d - 1])
                has = self.n >= d
                new = has & ~same[:, d - 1]
                self.node.append(np.where(has, np.cumsum(new, dtype=np.int32) - 1, -1))
                self.heads.append(np.flatnonzero(new))

    def arcs(self, d: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Pieces that end at nodes of depth d, the longest first: (length, nodes, nodes where they begin, pieces)."""
        head = self.heads[d]
        for k in range(min(d, self.longest), 0, -1):
            with np.errstate(over="ignore"):
                i = self.pieces.find(self.hashes[d][head] - self.hashes[d - k][head] * _POWERS[k])
            at = np.flatnonzero(i >= 0)
            yield k, at, self.node[d - k][head[at]], i[at]

    def before(self, d: int, nodes: np.ndarray) -> np.ndarray:
        """The nodes one character before."""
        return self.node[d - 1][self.heads[d][nodes]]
