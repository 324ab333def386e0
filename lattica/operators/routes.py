"""Distances between the nodes of a metric graph without a matrix of all of them.

Nodes of one neighbour are taken off, again and again, so that trees hang from a core that has none. Searches run over the
core only, when they are asked for; ways in a tree are differences of depths. Nodes out of reach are infinitely far.
"""

from __future__ import annotations

import math
from heapq import heappop, heappush

import numpy as np

#: Bytes of rows of core distances that are remembered; others are searched again.
REMEMBERED = 1 << 28


def distances_from(around: list[list[tuple[int, float]]], source: int) -> np.ndarray:
    """Distances of all nodes from one, by settling the nearest open node; around holds (neighbour, length) of every node."""
    d = [math.inf] * len(around)
    d[source] = 0.0
    waiting = [(0.0, source)]
    while waiting:
        far, node = heappop(waiting)
        if far > d[node]:
            continue  # settled by a shorter way
        for other, length in around[node]:
            if far + length < d[other]:
                d[other] = far + length
                heappush(waiting, (d[other], other))
    return np.array(d)


class Routes:
    """routes[i, j] is a distance, routes[i] those to all nodes, to(i, nodes) those to some."""

    def __init__(self, n: int, edges) -> None:
        near: list[dict[int, float]] = [{} for _ in range(n)]
        for u, v, length in edges:
            if u != v and length < near[u].get(v, math.inf):
                near[u][v] = near[v][u] = length
        parent, up, gone = [-1] * n, [0.0] * n, []
        leaves = [x for x in range(n) if len(near[x]) == 1]
        while leaves:
            x = leaves.pop()
            if len(near[x]) != 1:
                continue  # the last of its tree, which stays
            (p, length), = near[x].items()
            parent[x], up[x] = p, length
            gone.append(x)
            near[x].clear()
            del near[p][x]
            if len(near[p]) == 1:
                leaves.append(p)
        size = [1] * n
        for x in gone:
            size[parent[x]] += size[x]
        # Places in an order where every subtree is a run.
        root, depth, first, free, at, own = list(range(n)), [0.0] * n, [0] * n, [0] * n, 0, [-1] * n
        core = [x for x in range(n) if parent[x] < 0]
        for k, x in enumerate(core):
            own[x], first[x], free[x] = k, at, at + 1
            at += size[x]
        for x in reversed(gone):
            p = parent[x]
            root[x], depth[x], first[x] = root[p], depth[p] + up[x], free[p]
            free[p] += size[x]
            free[x] = first[x] + 1
        self.core = np.array(core, np.int64)
        self.parent, self.size, self.first, self.root, self.depth, self.own = parent, size, first, root, depth, own
        self.roots, self.depths, self.places = np.array(root, np.int64), np.array(depth), np.array(first, np.int64)
        self.owns = np.array(own, np.int64)[self.roots]
        self.around = [[(own[y], length) for y, length in near[x].items()] for x in core]
        self.rows: dict[int, np.ndarray] = {}
        self.everyone = np.arange(n)

    def __len__(self) -> int:
        return len(self.parent)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "rows": {}}

    def core_row(self, k: int) -> np.ndarray:
        """Distances of the core's nodes from its k-th."""
        if (row := self.rows.get(k)) is None:
            row = distances_from(self.around, k)
            if (len(self.rows) + 1) * row.nbytes > REMEMBERED:
                self.rows.pop(next(iter(self.rows)), None)
            self.rows[k] = row
        return row

    def between(self, i: int, j: int) -> float:
        if self.root[i] != self.root[j]:
            return self.depth[i] + float(self.core_row(self.own[self.root[i]])[self.own[self.root[j]]]) + self.depth[j]
        a, place = i, self.first[j]
        while not self.first[a] <= place < self.first[a] + self.size[a]:
            a = self.parent[a]
        return self.depth[i] - self.depth[a] + (self.depth[j] - self.depth[a])

    def to(self, i: int, nodes: np.ndarray) -> np.ndarray:
        d = self.depth[i] + self.core_row(self.own[self.root[i]])[self.owns[nodes]] + self.depths[nodes]
        # Within the own tree ways turn round at the deepest node above both.
        left = np.flatnonzero(self.roots[nodes] == self.root[i])
        a = i
        while len(left):
            place = self.places[nodes[left]]
            below = (place >= self.first[a]) & (place < self.first[a] + self.size[a])
            met = left[below]
            d[met] = self.depth[i] - self.depth[a] + (self.depths[nodes[met]] - self.depth[a])
            left, a = left[~below], self.parent[a]
        return d

    def __getitem__(self, key):
        return self.between(*key) if isinstance(key, tuple) else self.to(key, self.everyone)

    def reach(self) -> tuple[np.ndarray, float]:
        """The greatest depth of the tree at every node of the core, and the longest way inside a tree."""
        deep, longest = [0.0] * len(self), 0.0
        for x in sorted(self.everyone.tolist(), key=lambda x: -self.first[x]):  # below first
            if (p := self.parent[x]) >= 0:
                arm = deep[x] + self.depth[x] - self.depth[p]
                longest = max(longest, deep[p] + arm)
                deep[p] = max(deep[p], arm)
        return np.array(deep)[self.core], longest
