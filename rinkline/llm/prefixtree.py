"""One part of a prefix tree over globally ordered sets, walked in memory.

A set is laid out as its labels, rarest first. A pair of sets meets along the path of its shared labels: the first shared
one is a node of the first level, the first two a node of the second, and so on. A set may pass over no more labels than
the required overlap leaves it, so at depth ``d`` it stands only in nodes of its first ``n - overlap + d`` labels (the
remaining-length bound); all of its other subtrees are pruned. Nodes with few sets are compared pair by pair, wide ones
are parted by the next shared label. Where a node is left for comparing is a matter of cost, not of results.

A part holds about 300 bytes a set of 40 labels. The first level is laid out for some of its labels at a time and pairs
are given out as they come, so what is held besides does not grow with the part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

DEPTH = 5  # levels of the tree; a node this deep is compared whatever its width
WIDE = 6_000  # a node with more than WIDE * WIDE pairs is parted further
_SMALL = 2_000  # nodes with fewer pairs are compared together
_CHUNK = 500_000  # pairs gathered at a time
_TILE = 65_536  # pairs of a wide node compared in one step
_ENTRIES = 2_000_000  # entries of the first level laid out at a time, about
_ROWS = 4_096  # sets read at a time
_FOUND = 1_000_000  # pairs held before they are given out

Pairs = Iterator[tuple[np.ndarray, np.ndarray]]


def probe_length(n: np.ndarray, threshold: float) -> np.ndarray:
    """How many first labels may hold the first one shared with a smaller set that reaches the threshold."""
    return n - np.ceil(n * threshold - 1e-9).astype(n.dtype) + 1


def index_length(n: np.ndarray, threshold: float) -> np.ndarray:
    """The same where the other set is as large or larger."""
    return n - np.ceil(n * (2 * threshold / (1 + threshold)) - 1e-9).astype(n.dtype) + 1


class Part:
    """The sets of one part of the tree; :meth:`pairs` gives the pairs whose bit sets do not rule the threshold out. With
    ``side``, a truth value for each set, only pairs of sets of different sides."""

    def __init__(self, node: np.ndarray, n: np.ndarray, bits: np.ndarray, labels: np.ndarray, lengths: np.ndarray, threshold: float, side: np.ndarray | None = None):
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else np.zeros(0, dtype=np.int64)
        _, once = np.unique(node, return_index=True)
        once = once[np.argsort(n[once], kind="stable")]  # by size, so that of two sets the first is the smaller
        self.node, self.n, self.bits = node[once], n[once].astype(np.int64), bits[once].view(np.uint64)
        self.labels, self.starts, self.lengths = labels, starts[once], lengths[once]
        self.side = None if side is None else side[once]
        self.threshold, self.c = threshold, threshold / (1 + threshold)
        self.probe, self.index = probe_length(self.n, threshold), index_length(self.n, threshold)
        self.spare = self.n - np.concatenate([np.zeros(0, dtype=np.int64), *(np.bitwise_count(self.bits[k : k + _ROWS]).sum(axis=1).astype(np.int64) for k in range(0, len(self.n), _ROWS))])
        self.need = self.n * self.c
        self.found: list[np.ndarray] = []
        self.held = 0

    def pairs(self, part: int, parts: int, hot_from: int) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of the part, each once."""
        none = np.zeros((2, 0), dtype=np.int64)
        return tuple(np.unique(np.concatenate([none, *map(np.stack, self.batches(part, parts, hot_from))], axis=1), axis=1))

    def batches(self, part: int, parts: int, hot_from: int) -> Pairs:
        """The pairs as they are found; one that meets in several nodes may come again in a later batch."""
        passes = max(1, -(-int(np.minimum(self.lengths, self.probe).sum()) // (parts * _ENTRIES)))
        for k in range(passes):
            row, pos, label = self._first_level(lambda x, k=k: (x < hot_from) & (x % parts == part) & (x // parts % passes == k))
            yield from self._level(row, pos, label, 1)
        if hot_from <= self.labels.max(initial=-1):  # nodes too large for one part are shared out by their second label
            r, p, first = self._first_level(lambda x: x >= hot_from)
            for x in np.unique(first):
                at = first == x
                row2, pos2, label2 = self._after(r[at], p[at], 2)
                mine = path_part(x, label2, parts) == part
                yield from self._level(row2[mine], pos2[mine], label2[mine], 2)
        yield from self._given()

    def _given(self) -> Pairs:
        if self.found:
            both = np.unique(np.concatenate(self.found))
            self.found, self.held = [], 0
            yield self.node[both // len(self.n)], self.node[both % len(self.n)]

    def _first_level(self, wanted) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The entries of the first level whose labels are wanted."""
        out = [np.zeros((3, 0), dtype=np.int32)]
        for k in range(0, len(self.n), _ROWS):
            rows = np.arange(k, min(k + _ROWS, len(self.n)))
            row, pos, label = self._after(rows, np.full(len(rows), -1), 1)
            at = wanted(label)
            out.append(np.stack((row[at], pos[at], label[at])).astype(np.int32))
        row, pos, label = np.concatenate(out, axis=1)
        return row, pos, label

    def _after(self, row: np.ndarray, pos: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All labels behind ``pos`` that may be the ``depth``-th shared one."""
        count = np.maximum(np.minimum(self.lengths[row], self.probe[row] + depth - 1) - pos - 1, 0)
        rows = np.repeat(row, count)
        at = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(pos + 1, count)
        return rows, at, self.labels[self.starts[rows] + at]

    def _level(self, row: np.ndarray, pos: np.ndarray, label: np.ndarray, depth: int) -> Pairs:
        """The nodes of one level below one node: compared, or parted again."""
        if not len(row):
            return
        order = np.lexsort((row, label))
        row, pos, label = row[order], pos[order], label[order]
        first = np.flatnonzero(np.concatenate(([True], label[1:] != label[:-1])))
        size = np.diff(np.concatenate((first, [len(row)])))
        indexed = pos < self.index[row] + depth - 1
        within = np.add.reduceat(indexed.astype(np.int64), first) * (size - 1)
        cost = within
        if self.side is not None:
            side = self.side[row]
            ones, ones_indexed = (np.add.reduceat(x.astype(np.int64), first) for x in (side, side & indexed))
            cost = ones_indexed * (size - ones) + (np.add.reduceat(indexed.astype(np.int64), first) - ones_indexed) * ones
        wide = (cost > WIDE * WIDE) & (depth < DEPTH)
        small = (cost > 0) & (within <= _SMALL)
        skipped = pos - (depth - 1)  # labels passed over on the way
        yield from self._small_nodes(row, skipped, indexed, first[small], size[small])
        compared = (cost > 0) & (within > _SMALL) & ~wide
        for f, m in zip(first[compared], size[compared], strict=True):
            if self.side is None:
                yield from self._node(row[f : f + m], skipped[f : f + m], row[f : f + m])
                continue
            mine = side[f : f + m]
            for x in (mine, ~mine):
                yield from self._node(row[f : f + m][x], skipped[f : f + m][x], row[f : f + m][~x])
        for f, m in zip(first[wide], size[wide], strict=True):
            yield from self._level(*self._after(row[f : f + m], pos[f : f + m], depth + 1), depth + 1)

    def _small_nodes(self, row: np.ndarray, skipped: np.ndarray, indexed: np.ndarray, first: np.ndarray, size: np.ndarray) -> Pairs:
        """Nodes of few sets, pair by pair, many nodes at a time."""
        if not len(first):
            return
        entries = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
        left = np.repeat(first + size, size) - entries - 1  # later entries of the same node
        left[~indexed[entries]] = 0
        upto = np.cumsum(left)
        begin = 0
        while begin < len(entries):
            end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + _CHUNK, side="right")))
            e, k = entries[begin:end], left[begin:end]
            i = np.repeat(e, k)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k)
            a, b = row[i], row[j]
            least = self.need[a] + self.need[b] - 1e-6
            keep = (a != b) & (self.n[a] - skipped[i] >= least) & (self.n[b] - skipped[j] >= least)
            if self.side is not None:
                keep &= self.side[a] != self.side[b]
            self._compare(a[keep], b[keep])
            if self.held > _FOUND:
                yield from self._given()
            begin = end

    def _node(self, row: np.ndarray, skipped: np.ndarray, larger: np.ndarray) -> Pairs:
        """A node of many sets: runs of larger sets against the smaller ones that may still skip so much. Bit sets have at
        most 255 bits, so one byte holds a count."""
        room = self.n[row] - self.need[row] - skipped + 1e-6
        indexed = room >= self.n[row] * self.c
        left, left_room = row[indexed], room[indexed]
        small, bits, spare, need = self.n[left], self.bits[left], self.spare[left], self.need[left]
        step = max(32, _TILE // max(1, len(left)))
        for k in range(0, len(larger), step):
            right = larger[k : k + step]
            low = self.n[right[0]]
            fits = np.flatnonzero((left_room >= low * self.c) & (small >= self.threshold * low - 1e-9) & (left < right[-1]))
            if not len(fits):
                continue
            floor = np.ceil(need[fits] + self.need[right[0]] - np.minimum(spare[fits], self.spare[right].max()) - 1e-6)
            own, other = bits[fits], self.bits[right]
            shared = np.bitwise_count(own[:, :1] & other[:, 0])
            for w in range(1, bits.shape[1]):
                shared += np.bitwise_count(own[:, w : w + 1] & other[:, w])
            i, j = np.nonzero(shared >= np.clip(floor, 0, 255).astype(np.uint8)[:, None])
            a, b = left[fits[i]], right[j]
            keep = a < b
            self._compare(a[keep], b[keep])
            if self.held > _FOUND:
                yield from self._given()

    def _compare(self, a: np.ndarray, b: np.ndarray) -> None:
        """Keeps the pairs that the bit sets do not rule out: a bit only one has is a word only it has."""
        if not len(a):
            return
        shared = np.bitwise_count(self.bits[a] & self.bits[b]).sum(axis=1)
        keep = (shared + np.minimum(self.spare[a], self.spare[b]) >= self.need[a] + self.need[b] - 1e-6) & (self.n[a] >= self.threshold * self.n[b] - 1e-9)
        if keep.any():
            self.found.append(np.unique(a[keep].astype(np.int64) * len(self.n) + b[keep]))
            self.held += len(self.found[-1])


def path_part(first, second, parts: int):
    """The part that holds the node of two labels, the first being hot."""
    return (np.asarray(first, dtype=np.int64) * 1_000_003 + second) % parts
