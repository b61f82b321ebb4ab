"""Similarity join of globally ordered sets stored in a prefix tree with compressed edges."""

from __future__ import annotations

import numpy as np


class Trie:
    """Sets in the order of their sequences; a node covers a range of them.

    A node is (first leaf, last leaf + 1, depth above, depth below, children): all its sets share
    their elements up to the depth below, and the node's own label is the part between the depths.
    """

    def __init__(self, sets: list[np.ndarray]):
        # Big-endian bytes compare as the sequences do.
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.sets = [sets[i] for i in self.order]
        self.sizes = np.array([len(s) for s in self.sets])
        self.root = self._build()

    def _build(self):
        shared = []
        for a, b in zip(self.sets, self.sets[1:]):
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[:n] != b[:n])
            shared.append(int(differ[0]) if len(differ) else n)
        shared = np.array(shared, dtype=np.int64)
        root = [0, len(self.sets), 0, 0, []]
        todo = [root]
        while todo:
            node = todo.pop()
            lo, hi, _, depth, children = node
            cuts = [lo, *(np.flatnonzero(shared[lo : hi - 1] <= depth) + lo + 1).tolist(), hi]
            for a, b in zip(cuts, cuts[1:]):
                below = len(self.sets[a]) if b - a == 1 else int(shared[a : b - 1].min())
                child = [a, b, depth, below, []]
                children.append(child)
                if b - a > 1:
                    todo.append(child)
        return root

    def links(self, percent: int, group: np.ndarray) -> list[tuple[int, int]]:
        """Links that join different groups: a spanning forest of all links over the groups.

        Each set runs through the tree once with the overlap it shares with the path so far. A
        subtree is left when what remains of either side can't reach the overlap needed, when its
        sizes are too far off, or when all of it is in the set's own group already.
        """
        found = []
        group = group[self.order].copy()
        sizes = self.sizes
        for i, x in enumerate(self.sets):
            n = len(x)
            if n == 0:
                continue
            todo = [(c, 0, 0) for c in self.root[4]]
            while todo:
                (lo, hi, above, below, children), overlap, at = todo.pop()
                if hi <= i + 1:
                    continue
                start = max(lo, i + 1)
                if (group[start:hi] == group[i]).all():
                    continue
                least, most = int(sizes[start:hi].min()), int(sizes[start:hi].max())
                if 100 * n < percent * least or 100 * most < percent * n:
                    continue
                if below > above:
                    label = self.sets[lo][above:below]
                    rest = x[at:]
                    where = np.searchsorted(rest, label)
                    inside = where < len(rest)
                    overlap += int((rest[where[inside]] == label[inside]).sum())
                    at += int(np.searchsorted(rest, label[-1], side="right"))
                reach = overlap + min(n - at, most - below)
                # |x & y| >= p / (100 + p) * (|x| + |y|), smallest for the smallest set.
                if (100 + percent) * reach < percent * (n + least):
                    continue
                todo.extend((c, overlap, at) for c in reversed(children))
                if not children and hi - lo == 1 and group[lo] != group[i]:
                    if 100 * overlap >= percent * (n + int(sizes[lo]) - overlap):
                        found.append((self.order[i], self.order[lo]))
                        group[group == group[lo]] = group[i]
        return found
