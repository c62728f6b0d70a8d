"""A trie over globally ordered n-gram sets, and the self-join that traverses it."""

from __future__ import annotations

import numpy as np


class Node:
    """A path of tokens, shared by the records lo..hi (in the order of their token sequences)."""

    __slots__ = ("children", "ends", "end", "fewest", "hi", "label", "lo", "longest", "path")


class Trie:
    """Records are ascending arrays of token ranks. sizes: of the whole sets, tokens that no other set has included."""

    def __init__(self, records: list[np.ndarray], sizes: list[int], percent: int):
        self.percent = percent
        keys = [r.astype(">u4").tobytes() for r in records]
        self.order = sorted(range(len(records)), key=keys.__getitem__)
        self.records = [records[i] for i in self.order]
        self.sizes = np.array([sizes[i] for i in self.order], np.int64)
        self.lengths = np.array([len(r) for r in self.records], np.int64)
        self.ranks = int(max((r[-1] for r in self.records if len(r)), default=-1)) + 1
        self.common = np.zeros(len(records) + 1, np.int64)
        for i in range(1, len(records)):
            a, b = self.records[i - 1], self.records[i]
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[:n] != b[:n])
            self.common[i] = differ[0] if len(differ) else n
        self.parent = list(range(len(records)))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def union(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.parent[max(i, j)] = min(i, j)

    def linked(self, overlap: int, i: int, j: int) -> bool:
        """100 * overlap >= percent * union, in whole numbers."""
        return (100 + self.percent) * overlap >= self.percent * int(self.sizes[i] + self.sizes[j])

    def neighbours(self) -> None:
        """Join each record with the one before it: near copies sort together."""
        for i in range(1, len(self.records)):
            n = self.common[i]
            if self.find(i) != self.find(i - 1):
                a, b = self.records[i - 1][n:], self.records[i][n:]
                if self.linked(n + len(np.intersect1d(a, b, assume_unique=True)), i - 1, i):
                    self.union(i - 1, i)

    def build(self) -> Node:
        root = self._node(0, len(self.records), 0)
        todo = [root]
        while todo:
            node = todo.pop()
            cuts = [node.ends, *(i for i in range(node.ends + 1, node.hi) if self.common[i] == node.end), node.hi]
            node.children = [self._node(a, b, node.end) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]
            todo += [x for x in node.children if x.ends < x.hi]
        return root

    def _node(self, lo: int, hi: int, depth: int) -> Node:
        node = Node()
        node.lo, node.hi = lo, hi
        node.end = int(self.common[lo + 1 : hi].min()) if hi - lo > 1 else int(self.lengths[lo])
        node.path = self.records[lo][depth : node.end]
        node.ends = lo  # records lo..ends end here
        while node.ends < hi and self.lengths[node.ends] == node.end:
            node.ends += 1
        node.longest, node.fewest = int(self.lengths[lo:hi].max()), int(self.sizes[lo:hi].min())
        labels = {self.find(i) for i in range(lo, hi)}
        node.label = labels.pop() if len(labels) == 1 else -1
        node.children = []
        return node

    def join(self) -> None:
        """Link all records that are similar, components at a time: what is linked already is not compared again.

        Each record outside the largest component is a probe: the overlap with a path is counted once for
        all records below it, and a subtree goes when even all tokens left on either side are too few.
        """
        self.neighbours()
        labels = [self.find(i) for i in range(len(self.records))]
        counts = dict.fromkeys(labels, 0)
        for x in labels:
            counts[x] += 1
        if len(counts) < 2:
            return
        largest = max(counts, key=lambda x: (counts[x], -x))
        root = self.build()
        held = np.zeros(self.ranks, bool)
        for probe in (i for i, x in enumerate(labels) if x != largest):
            record = self.records[probe]
            held[record] = True
            todo = [(root, 0)]
            while todo:
                node, overlap = todo.pop()
                if node.label >= 0 and self.find(node.label) == self.find(probe):
                    continue
                overlap += int(np.count_nonzero(held[node.path]))
                left = len(record) - (int(np.searchsorted(record, node.path[-1], "right")) if len(node.path) else 0)
                most = overlap + min(left, node.longest - node.end)
                if (100 + self.percent) * most < self.percent * (int(self.sizes[probe]) + node.fewest):
                    continue
                for i in range(node.lo, node.ends):
                    if self.linked(overlap, probe, i):
                        self.union(probe, i)
                todo += [(x, overlap) for x in node.children]
            held[record] = False


def similar(tokens: list[np.ndarray], sizes: list[int], percent: int, known: list | None = None) -> list[int]:
    """For each record the number of the least record that it is linked with, over any chain of links.

    tokens: ascending keys in the global order, without those that only one set has; sizes: of the whole sets.
    known: a label for each; records with one label count as linked.
    """
    ranks = np.unique(np.concatenate(tokens)) if tokens else np.zeros(0, np.uint64)
    trie = Trie([np.searchsorted(ranks, t).astype(np.int64) for t in tokens], sizes, percent)
    if known is not None:
        first: dict = {}
        for i, original in enumerate(trie.order):
            trie.union(i, first.setdefault(known[original], i))
    trie.join()
    least: dict[int, int] = {}
    for i, original in enumerate(trie.order):
        r = trie.find(i)
        least[r] = min(least.get(r, original), original)
    out = [0] * len(tokens)
    for i, original in enumerate(trie.order):
        out[original] = least[trie.find(i)]
    return out
