"""Links between sets by a prefix tree of their elements in one global order."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np


class _Node:
    __slots__ = ("segment", "last", "children", "ends", "least", "most", "deepest", "same", "leaf")

    def __init__(self, segment: list[int]):
        self.segment, self.last = frozenset(segment), segment[-1] if segment else -1
        self.children: list[_Node] = []
        self.ends: list[int] = []
        self.least = self.most = self.deepest = 0
        self.same, self.leaf = False, -1


class LinkTrie:
    """Stores sets, elements in order of falling frequency, so that like sets share long paths; nodes with one child are
    one segment. A set walks down the tree carrying its overlap with the path, which all sets below share. A subtree is
    left when the overlap that the remaining lengths allow is too small for the smallest set in it, when no size in it
    fits, or when all in it are already connected with the set. known names the component of each set, where that is
    known from before.
    """

    def __init__(self, sets: list[np.ndarray], percent: int = 80, known: list[bytes] | None = None):
        self.sizes, self.percent = [len(s) for s in sets], percent
        flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        values, at, counts = np.unique(flat, return_inverse=True, return_counts=True)
        rank = np.empty(len(values), np.int64)
        rank[np.lexsort((values, -counts))] = np.arange(len(values))
        ranks, shared = rank[at], counts[at] > 1  # an element of one set only adds to its size
        self.paths: list[list[int]] = []
        weight, i = [], 0
        for n in self.sizes:
            own = ranks[i : i + n][shared[i : i + n]]
            weight.append(counts[at[i : i + n]].sum() / max(n, 1))
            self.paths.append(np.sort(own).tolist())
            i += n
        self.central = np.argsort(-np.array(weight), kind="stable").tolist()
        self.parent = list(range(len(sets)))
        self.nodes: list[_Node] = []
        self.root = self._build()
        if known:
            first: dict[bytes, int] = {}
            for x, name in enumerate(known):
                self.parent[x] = first.setdefault(name, x)
            self._mark()

    def _build(self) -> _Node:
        order = sorted(range(len(self.paths)), key=self.paths.__getitem__)
        top = _Node([])
        work = [(top, 0, len(order), 0)] if order else []
        while work:  # each entry: children of a node from a run of sorted paths that share depth elements
            node, lo, hi, depth = work.pop()
            while lo < hi and len(self.paths[order[lo]]) == depth:
                node.ends.append(order[lo])
                lo += 1
            while lo < hi:
                first, stop = self.paths[order[lo]], lo + 1
                while stop < hi and self.paths[order[stop]][depth] == first[depth]:
                    stop += 1
                last, upto = self.paths[order[stop - 1]], depth + 1
                most = min(len(first), len(last))
                while upto < most and first[upto] == last[upto]:
                    upto += 1
                child = _Node(first[depth:upto])
                node.children.append(child)
                work.append((child, lo, stop, upto))
                lo = stop
        stack = [top]
        while stack:
            self.nodes.append(n := stack.pop())
            stack += n.children
        for n in reversed(self.nodes):
            sizes = [self.sizes[e] for e in n.ends]
            n.least = min([*sizes, *(c.least for c in n.children)], default=0)
            n.most = max([*sizes, *(c.most for c in n.children)], default=0)
            n.deepest = max((len(c.segment) + c.deepest for c in n.children), default=0)
            n.leaf = n.ends[0] if n.ends else n.children[0].leaf if n.children else -1
        return top

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def _mark(self) -> None:
        """Note the subtrees whose sets are all connected."""
        for n in reversed(self.nodes):
            if not n.same:
                root = self.find(n.leaf)
                n.same = all(c.same and self.find(c.leaf) == root for c in n.children) and all(self.find(e) == root for e in n.ends)

    def links(self) -> list[tuple[int, int]]:
        """Pairs with percent or more of their union in common, as many as connect what such pairs connect."""
        found: list[tuple[int, int]] = []
        new = 0
        for x in self.central:
            before = len(found)
            self._walk(x, found)
            new += len(found) - before
            if new > max(4, len(self.sizes) // 64):
                self._mark()
                new = 0
        return found

    def _walk(self, x: int, found: list[tuple[int, int]]) -> None:
        n, path, own, percent = self.sizes[x], self.paths[x], frozenset(self.paths[x]), self.percent
        least, find = -(-percent * n // 100), self.find
        stack = [(self.root, 0)]
        while stack:
            node, overlap = stack.pop()
            if node.most < least or node.least * percent > 100 * n or node.same and find(node.leaf) == find(x):
                continue
            overlap += len(node.segment & own)
            rest = len(path) - bisect_right(path, node.last)
            if (100 + percent) * (overlap + min(rest, node.deepest)) < percent * (n + max(node.least, least)):
                continue
            for y in node.ends:
                if y != x and (100 + percent) * overlap >= percent * (n + self.sizes[y]) and (a := find(x)) != (b := find(y)):
                    self.parent[max(a, b)] = min(a, b)
                    found.append((x, y))
            for c in node.children:
                stack.append((c, overlap))
