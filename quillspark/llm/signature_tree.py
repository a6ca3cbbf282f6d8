"""A signature tree over sets, and its self-join by dual traversal. It runs inside a task, over one bounded tile of documents.

A leaf holds up to FAN sets, an inner node up to FAN nodes. A node keeps the OR of its sets' token bitmaps, the range of their
sizes, and the most tokens of a set that share a bit with another of its own (its slack). Tokens that two sets have in common lie in bits that
both have, so no two sets below nodes A and B share more than popcount(OR_A and OR_B) + slack tokens, nor more than the smaller of the
largest sizes; where that is less than the smallest sizes need, the pair of nodes is pruned with all below it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FAN, BITS = 16, 2048
#: Columns of an incidence matrix that are multiplied at a time.
WIDE = 1 << 16


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """uint64 [sets, BITS / 64]."""
    out = np.zeros((len(sets), BITS // 8), dtype=np.uint8)
    for k, tokens in enumerate(sets):
        bits = np.zeros(BITS, dtype=np.uint8)
        bits[(tokens % np.uint64(BITS)).astype(np.int64)] = 1
        out[k] = np.packbits(bits)
    return out.view(np.uint64)


class SignatureTree:
    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sets, self.percent = sets, percent
        self.size = np.array([len(x) for x in sets], dtype=np.int64)
        self.bits = bitmaps(sets)
        self.slack = self.size - np.bitwise_count(self.bits).sum(axis=1).astype(np.int64)
        # neighbours in the tree are of like size and, where they share their least token, of like content
        least = np.array([x[0] if len(x) else 0 for x in sets], dtype=np.uint64)
        step = np.floor(np.log(np.maximum(1, self.size)) / np.log(100 / percent)).astype(np.int64)
        self.order = np.lexsort((self.size, least, step))
        self.levels = [[self.order[i : i + FAN] for i in range(0, len(sets), FAN)]]  # level 0: rows of sets; above: rows of nodes
        self.nodes = [self._summed(self.bits, self.size, self.size, self.slack, self.levels[0])]
        while len(self.levels[-1]) > 1:
            below = self.nodes[-1]
            groups = [np.arange(i, min(i + FAN, len(self.levels[-1]))) for i in range(0, len(self.levels[-1]), FAN)]
            self.levels.append(groups)
            self.nodes.append(self._summed(*below, groups))

    @staticmethod
    def _summed(bits: np.ndarray, low: np.ndarray, high: np.ndarray, slack: np.ndarray, groups: list[np.ndarray]) -> tuple:
        return (
            np.array([np.bitwise_or.reduce(bits[g], axis=0) for g in groups]),
            np.array([low[g].min() for g in groups]), np.array([high[g].max() for g in groups]), np.array([slack[g].max() for g in groups]),
        )

    def possible(self, one: tuple, many: tuple) -> np.ndarray:
        """For one node (or set) against many: may sets below them be similar?"""
        (bits, low, high, slack), (bits2, low2, high2, slack2) = one, many
        common = np.bitwise_count(bits[None, :] & bits2).sum(axis=1).astype(np.int64)
        most = np.minimum(np.minimum(common + slack, common + slack2), np.minimum(high, high2))
        # intersection / union >= p/100 means intersection * (100 + p) >= p * (size + size2); and sizes differ by p/100 at most
        return (most * (100 + self.percent) >= self.percent * (low + low2)) & (100 * high >= self.percent * low2) & (100 * high2 >= self.percent * low)

    def _at(self, level: int, k: int) -> tuple:
        return tuple(x[k] for x in self.nodes[level])

    def leaf_pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of leaves (rows of sets) that the dual traversal could not prune; a leaf also meets itself."""
        if not len(self.sets):
            return
        stack = [(len(self.levels) - 1, 0, 0)]
        while stack:
            level, a, b = stack.pop()
            if not level:
                yield self.levels[0][a], self.levels[0][b]
                continue
            below, right = self.levels[level][a], self.levels[level][b]
            many = tuple(x[right] for x in self.nodes[level - 1])
            for k in below:
                for m in right[self.possible(self._at(level - 1, k), many)]:
                    if a != b or m >= k:
                        stack.append((level - 1, int(k), int(m)))

    def _incidence(self, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct tokens of a leaf's sets, and a row for each set with 1 where it has the token."""
        tokens, at = np.unique(np.concatenate([self.sets[k] for k in leaf]), return_inverse=True)
        has = np.zeros((len(leaf), len(tokens)), dtype=np.float32)
        has[np.repeat(np.arange(len(leaf)), self.size[leaf]), at] = 1
        return tokens, has

    def _shared(self, known: tuple[np.ndarray, np.ndarray], right: np.ndarray) -> np.ndarray:
        """Tokens that each set of a leaf (its incidence) has in common with each set of another one."""
        tokens, has = known
        out = np.zeros((len(has), len(right)), dtype=np.int64)
        theirs = np.concatenate([self.sets[k] for k in right])
        if not len(tokens) or not len(theirs):
            return out
        owner, at = np.repeat(np.arange(len(right)), self.size[right]), np.searchsorted(tokens, theirs)
        hit = tokens[np.minimum(at, len(tokens) - 1)] == theirs
        owner, at = owner[hit], at[hit]
        for low in range(0, len(tokens), WIDE):  # sums of at most WIDE ones are exact in 32 bits
            mine = has[:, low : low + WIDE]
            inside = slice(None) if len(tokens) <= WIDE else (at >= low) & (at < low + WIDE)
            other = np.zeros((len(right), mine.shape[1]), dtype=np.float32)
            other[owner[inside], at[inside] - low] = 1
            out += (mine @ other.T).astype(np.int64)
        return out

    def joined(self, weights: np.ndarray | None = None, group: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
        """The join of the sets with each other: for each set the weights of all sets that are similar to it, summed up, and links that hold
        together what is similar (a spanning forest of all links). With `group`, only sets of different groups are joined."""
        parent = np.arange(len(self.sets))
        weights = np.ones(len(self.sets), dtype=np.int64) if weights is None else weights
        counts = np.zeros(len(self.sets), dtype=np.int64)

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        links, last, known = [], None, None
        for left, right in self.leaf_pairs():
            if last is not left:
                last, known = left, self._incidence(left)
            shared = self._shared(known, right)
            similar = (shared > 0) & (100 * shared >= self.percent * (self.size[left][:, None] + self.size[right][None, :] - shared))
            if left is right:
                similar = np.triu(similar, 1)
            if group is not None:
                similar &= group[left][:, None] != group[right][None, :]
            if not similar.any():
                continue
            counts[left] += similar @ weights[right]
            counts[right] += weights[left] @ similar
            roots = [np.array([root(x) for x in leaf]) for leaf in (left, right)]
            for i, j in np.argwhere(similar & (roots[0][:, None] != roots[1][None, :])):
                x, y = root(left[i]), root(right[j])
                if x != y:
                    parent[y] = x
                    links.append((int(left[i]), int(right[j])))
        return links, counts
