"""Task-side helpers for nearest-neighbour search: box cells and block distances.

Distances are the square root of the squared gaps added in feature order, the
value the equivalent SQL expression gives. Rounding is monotone, so a cell's
nearest possible distance, computed the same way, never exceeds the distance of a
row inside it, and skipping cells by that bound loses nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BLOCK = 200_000  # distances held at once; a block stays in the processor cache
PAIRS = 200_000  # (row, box) pairs whose distances are held at once
LEAF = 512  # rows aimed at in a cell of an index
QUERIES = 2048  # queries that an index answers at once
LARGEST = np.finfo(float).max  # infinite and missing distances are not found


@dataclass
class Cells:
    """Complete binary tree of cuts; node ``n`` has children ``2n+1`` and ``2n+2``."""

    depth: int
    dims: np.ndarray
    cuts: np.ndarray
    low: np.ndarray = field(default=None)
    high: np.ndarray = field(default=None)
    count: np.ndarray = field(default=None)
    most: np.ndarray = field(default=None)

    @property
    def leaves(self) -> int:
        return 1 << self.depth

    def state(self) -> tuple:
        """Plain values to send to tasks; ``Cells(*state)`` puts them back."""
        return self.depth, self.dims, self.cuts, self.low, self.high, self.count, self.most

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Cell of every row of ``x``."""
        node = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.dims[node]] > self.cuts[node])
        return node - (self.leaves - 1)

    def set_boxes(self, cell: np.ndarray, low: np.ndarray, high: np.ndarray, count: np.ndarray, most: np.ndarray) -> None:
        """Boxes and row counts of the stored rows per cell, carried up the tree; cells without rows are never near.

        ``most`` is the largest number of rows of one group in a cell; its sums bound that of a larger box.
        """
        total, width = 2 * self.leaves - 1, low.shape[1]
        self.low = np.full((total, width), np.inf)
        self.high = np.full((total, width), -np.inf)
        self.count, self.most = np.zeros(total, np.int64), np.zeros(total, np.int64)
        for table, values in ((self.low, low), (self.high, high), (self.count, count), (self.most, most)):
            table[self.leaves - 1 + cell] = values
        for node in range(self.leaves - 2, -1, -1):
            left, right = 2 * node + 1, 2 * node + 2
            self.low[node] = np.minimum(self.low[left], self.low[right])
            self.high[node] = np.maximum(self.high[left], self.high[right])
            self.count[node] = self.count[left] + self.count[right]
            self.most[node] = self.most[left] + self.most[right]

    def enclosing(self, cell: np.ndarray, grouped: np.ndarray, k: int) -> np.ndarray:
        """Node of the smallest box around every cell with k rows that a row may meet, the root if there are fewer.

        ``grouped`` rows may not meet those of one group.
        """
        node = cell + (self.leaves - 1)
        while True:
            few = (node > 0) & (self.count[node] - np.where(grouped, self.most[node], 0) < k)
            if not few.any():
                return node
            node = np.where(few, (node - 1) // 2, node)

    def under(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First cell below every node, and the one after the last."""
        below = self.depth + 1 - np.frexp(node + 1.0)[1]
        first = ((node + 1) << below) - self.leaves
        return first, first + (1 << below)

    def reach(self, x: np.ndarray, cell: np.ndarray, grouped: np.ndarray, k: int) -> np.ndarray:
        """A distance within which every row of ``x`` has its k nearest permitted rows, or all if there are fewer.

        It is that of the far corner of the smallest box around the row's cell with k rows that the row may meet.
        """
        node = self.enclosing(cell, grouped, k)
        gap = np.maximum(np.abs(x - self.low[node]), np.abs(self.high[node] - x))
        far = np.zeros(len(x))
        for j in range(x.shape[1]):
            far += gap[:, j] * gap[:, j]
        return np.minimum(np.sqrt(far), LARGEST)

    def within(self, x: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(row, cell)`` pairs whose box comes as near as the row's radius.

        Goes down the tree by at most ``PAIRS`` boxes at a time, so besides the pairs found it holds
        little, however many rows or boxes there are.
        """
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        waiting = [(0, np.arange(len(x)), np.zeros(len(x), dtype=np.int64))]
        while waiting:
            level, row, node = waiting.pop()
            if len(row) > PAIRS:
                half = len(row) // 2
                waiting += [(level, row[half:], node[half:]), (level, row[:half], node[:half])]
                continue
            near = np.zeros(len(row))
            for j in range(x.shape[1]):
                gap = np.maximum(self.low[node, j] - x[row, j], x[row, j] - self.high[node, j])
                np.maximum(gap, 0.0, out=gap)
                near += gap * gap
            near = np.sqrt(near)
            keep = np.isfinite(near) & (near <= radius[row])
            row, node = row[keep], node[keep]
            if level == self.depth:
                found.append((row, node - (self.leaves - 1)))
            elif len(row):
                waiting.append((level + 1, np.repeat(row, 2), np.column_stack([2 * node + 1, 2 * node + 2]).ravel()))
        return tuple(np.concatenate(parts) for parts in zip(*found))


def depth_for(rows: int, cell_rows: int) -> int:
    """Levels of halving that bring ``rows`` down to ``cell_rows`` per cell."""
    return max(0, int(np.ceil(np.log2(max(rows, 1) / cell_rows))))


def build_cells(sample: np.ndarray, depth: int) -> Cells:
    """Halve each cell of the sample at the median of its widest feature.

    The sample only decides where the cuts lie, never what is found.
    """
    inner = (1 << depth) - 1
    cells = Cells(depth, np.zeros(inner, dtype=np.int64), np.zeros(inner))
    node = np.zeros(len(sample), dtype=np.int64)
    rows = np.arange(len(sample))
    for level in range(depth):
        first, count = (1 << level) - 1, 1 << level
        slot = node - first
        size = np.bincount(slot, minlength=count)
        safe = np.maximum(size, 1)
        spread = np.empty((count, sample.shape[1]))
        for j in range(sample.shape[1]):
            mean = np.bincount(slot, sample[:, j], minlength=count) / safe
            away = sample[:, j] - mean[slot]
            spread[:, j] = np.bincount(slot, away * away, minlength=count) / safe
        dim = spread.argmax(axis=1)
        value = sample[rows, dim[slot]]
        order = np.lexsort((value, slot))
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        held = size > 0
        cut, top = np.zeros(count), np.zeros(count)
        cut[held] = value[order][start[held] + (size[held] - 1) // 2]
        top[held] = value[order][start[held] + size[held] - 1]
        below = value < top[slot]
        under = np.full(count, -np.inf)
        np.maximum.at(under, slot[below], value[below])
        cut = np.where((cut == top) & np.isfinite(under), under, cut)
        cells.dims[first : first + count] = dim
        cells.cuts[first : first + count] = cut
        node = 2 * node + 1 + (value > cut[slot])
    return cells


@dataclass
class Rows:
    """Reference rows: features, id, label, and the group a query must avoid."""

    x: np.ndarray
    id: np.ndarray
    label: np.ndarray
    apart: np.ndarray

    def take(self, index) -> "Rows":
        return Rows(self.x[index], self.id[index], self.label[index], self.apart[index])

    def __len__(self) -> int:
        return len(self.id)


def first_k(query: np.ndarray, dist: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest ``(dist, id)`` of every query, in order."""
    order = np.lexsort((ids, dist, query))
    sorted_query = query[order]
    rank = np.arange(len(order)) - np.searchsorted(sorted_query, sorted_query)
    return order[rank < k]


def nearest(x: np.ndarray, apart: np.ndarray, rows: Rows, k: int, radius: np.ndarray | None = None):
    """``(query, row, dist)`` of the k nearest rows of every query and of all ties with the k-th.

    With ``radius``, only rows that near. Unordered within a query.
    """
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    grouped = np.isin(apart, rows.apart).any()
    step = max(1, BLOCK // max(1, len(rows)))
    for begin in range(0, len(x), step):
        part = x[begin : begin + step]
        dist = np.zeros((len(part), len(rows)))
        for j in range(x.shape[1]):
            gap = part[:, j, None] - rows.x[None, :, j]
            dist += gap * gap
        np.sqrt(dist, out=dist)
        if grouped:
            dist[apart[begin : begin + step, None] == rows.apart[None, :]] = np.inf
        limit = np.full(len(part), LARGEST) if radius is None else np.minimum(radius[begin : begin + step], LARGEST)
        within = dist <= limit[:, None]
        crowded = np.flatnonzero(within.sum(axis=1) > k)
        if len(crowded):
            kth = np.partition(dist[crowded], k - 1, axis=1)[:, k - 1]
            within[crowded] = dist[crowded] <= kth[:, None]
        query, row = np.nonzero(within)
        found.append((query + begin, row, dist[query, row]))
    return tuple(np.concatenate(parts) for parts in zip(*found))


def kth_distance(query: np.ndarray, dist: np.ndarray, n: int, k: int) -> np.ndarray:
    """Distance of the k-th neighbour per query, infinite where fewer were found."""
    size = np.bincount(query, minlength=n)
    far = np.full(n, np.inf)
    last = np.cumsum(size) - 1
    full = size >= k
    far[full] = dist[last[full]]
    return far


class Index:
    """Reference rows that fit in a task, grouped by small cells of their own; at most ``block_rows`` of them meet queries at once."""

    def __init__(self, cells: Cells, rows: Rows, start: np.ndarray, block_rows: int = BLOCK):
        self.cells, self.rows, self.start, self.block_rows = cells, rows, start, block_rows

    @classmethod
    def build(cls, rows: Rows, leaf_rows: int = LEAF, block_rows: int = BLOCK) -> "Index":
        cells = build_cells(rows.x, depth_for(len(rows), leaf_rows))
        cell = cells.assign(rows.x)
        order = np.argsort(cell, kind="stable")
        rows = rows.take(order)
        start = np.searchsorted(cell[order], np.arange(cells.leaves + 1))
        used = np.flatnonzero(np.diff(start))
        low, high = (f.reduceat(rows.x, start[used]) if len(used) else rows.x for f in (np.minimum, np.maximum))
        groups, size = np.unique(np.column_stack([cell[order], rows.apart]), axis=0, return_counts=True)
        most = np.zeros(cells.leaves, np.int64)
        np.maximum.at(most, groups[:, 0], np.where(groups[:, 1] < 0, 0, size))
        cells.set_boxes(used, low, high, np.diff(start)[used], most[used])
        return cls(cells, rows, start, block_rows)

    def state(self) -> tuple:
        rows = self.rows
        return self.cells.state(), (rows.x, rows.id, rows.label, rows.apart), self.start

    @classmethod
    def restore(cls, state: tuple) -> "Index":
        cells, rows, start = state
        return cls(Cells(*cells), Rows(*rows), start)

    def _visit(self, x, apart, query, cell, k, radius=None):
        """Nearest rows for ``(query, cell)`` pairs, one cell or block of a cell at a time."""
        order = np.argsort(cell, kind="stable")
        query, cell = query[order], cell[order]
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        edges = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]])
        for first, last in zip(edges[:-1], edges[1:]):
            if first == last:
                continue
            mine = query[first:last]
            reach = None if radius is None else radius[mine]
            end = self.start[cell[first] + 1]
            for begin in range(self.start[cell[first]], end, self.block_rows):
                block = self.rows.take(slice(begin, min(begin + self.block_rows, end)))
                q, r, d = nearest(x[mine], apart[mine], block, k, reach)
                found.append((mine[q], r + begin, d))
        return tuple(np.concatenate(parts) for parts in zip(*found))

    def search(self, x: np.ndarray, apart: np.ndarray, k: int, radius: np.ndarray | None = None, queries: int = QUERIES):
        """``(query, row, dist)`` of the k nearest rows, nearest first.

        With ``radius``, only rows that near. Without, the query's own cell gives the radius, or, if it has
        fewer than k rows to meet, those of the smallest box around it that has them. ``queries`` at a time.
        """
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for begin in range(0, len(x), queries):
            part = slice(begin, begin + queries)
            query, row, dist = self._search(x[part], apart[part], k, None if radius is None else radius[part])
            found.append((query + begin, row, dist))
        return tuple(np.concatenate(parts) for parts in zip(*found))

    def _search(self, x: np.ndarray, apart: np.ndarray, k: int, radius: np.ndarray | None):
        first = last = np.zeros(len(x), np.int64)  # cells from first to before last have been visited
        known = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        if radius is None:
            home = self.cells.assign(x)
            known = self._first(self._visit(x, apart, np.arange(len(x)), home, k), k)
            if self.cells.depth == 0:
                return known
            first, last = home, home + 1
            radius = kth_distance(known[0], known[2], len(x), k)
            short = np.isinf(radius)
            if short.any():
                node = np.where(short, self.cells.enclosing(home, apart >= 0, k), home + (self.cells.leaves - 1))
                first, last = self.cells.under(node)
                query = np.repeat(np.arange(len(x)), last - first)
                cell = np.arange(len(query)) - np.repeat(np.cumsum(last - first) - last, last - first)
                other = cell != home[query]
                known = self._joined(known, self._visit(x, apart, query[other], cell[other], k), k)
                radius = kth_distance(known[0], known[2], len(x), k)
                short = np.flatnonzero(np.isinf(radius))
                radius[short] = self.cells.reach(x[short], home[short], apart[short] >= 0, k)
        near, cell = self.cells.within(x, radius)
        other = (cell < first[near]) | (cell >= last[near])
        return self._joined(known, self._visit(x, apart, near[other], cell[other], k, radius), k)

    def _joined(self, known, more, k: int):
        return self._first(tuple(np.concatenate(parts) for parts in zip(known, more)), k)

    def _first(self, found, k: int):
        query, row, dist = found
        keep = first_k(query, dist, self.rows.id[row], k)
        return query[keep], row[keep], dist[keep]
