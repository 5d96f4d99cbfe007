"""Least-cost paths on large graphs in memory by cells: what a path may cost between the borders of a cell is known before, so a search climbs by cells instead of walking arc by arc.

Cells are runs of vertices in the order of their ids, two of them make one of the level above.  A cell knows the least cost from each
arc that leads in to each that leads out, within it.  A cell of two also knows the least costs between the arcs that cross from one half to
the other.  Costs are whole numbers that hold the number of arcs as well (:data:`HOP`), so that sums are exact and paths are found again from equal sums.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from waymark.functions.geo import OFFSET_MAX
from waymark.operators.routing import Compact, Places

HOP, FAR = 1 << 20, 1 << 61
#: Vertices of the smallest cells, and arcs at the borders of one up to which cells are worth it.
CELL = 512
BORDER = 256
#: Arcs of paths between borders that a task keeps.
KEPT = 20_000_000


def least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least sums over the middle of two tables of costs."""
    out = np.full((a.shape[0], b.shape[1]), FAR, np.int64)
    for k in range(a.shape[1]):
        np.minimum(out, a[:, k, None] + b[None, k, :], out=out)
    return out


class Borders:
    """The arcs of a graph by where they lead in and out of runs of vertices."""

    def __init__(self, g: Compact, size: int = CELL):
        self.g, self.size = g, size
        a = g.arrays
        self.start = np.repeat(np.arange(len(g.vertices)), a["end"] - a["first"])
        self.into = np.argsort(a["to"], kind="stable")
        self.heads = a["to"][self.into]
        self.count = max(1, -(-len(g.vertices) // size))
        self.top = max(0, (self.count - 1).bit_length())

    def reach(self, level: int, n: int) -> tuple[int, int]:
        width = self.size << level
        return n * width, min((n + 1) * width, len(self.g.vertices))

    def entering(self, level: int, n: int) -> np.ndarray:
        lo, hi = self.reach(level, n)
        return self.into[np.searchsorted(self.heads, lo) : np.searchsorted(self.heads, hi)]

    def ends(self, level: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Arcs that lead into a cell and out of it, by number."""
        lo, hi = self.reach(level, n)
        if lo >= hi:
            return np.array([], np.int64), np.array([], np.int64)
        came = self.entering(level, n)
        came = np.sort(came[(self.start[came] < lo) | (self.start[came] >= hi)])
        gone = np.arange(self.g.arrays["first"][lo], self.g.arrays["end"][hi - 1])
        to = self.g.arrays["to"][gone]
        return came, gone[(to < lo) | (to >= hi)]

    def steps(self, n: int) -> dict[int, list[tuple[int, int]]]:
        """What follows each arc that ends in a smallest cell: (arc, its cost and that of the turn)."""
        g, out = self.g, {}
        for a in self.entering(0, n).tolist():
            v, edge = g.to[a], g.arc[a] >> 1
            out[a] = [(b, int(g.cost[b] + t) * HOP + 1) for b in range(g.first[v], g.end[v]) if (into := g.arc[b] >> 1) != edge and (t := g.turns.get((v, edge, into), 0)) < math.inf]
        return out


def settle(steps: dict[int, list[tuple[int, int]]], starts: list[tuple[int, int]]) -> tuple[dict[int, int], dict[int, int]]:
    """(cost, arc before or -1) by arc from starts (cost, arc) by the steps of a cell."""
    heap, done, before = [(c, a, -1) for c, a in starts], {}, {}
    heapq.heapify(heap)
    while heap:
        c, a, previous = heapq.heappop(heap)
        if a in done:
            continue
        done[a], before[a] = c, previous
        for b, step in steps.get(a, ()):
            if b not in done:
                heapq.heappush(heap, (c + step, b, a))
    return done, before


def small_cell(b: Borders, n: int) -> np.ndarray:
    steps, (came, gone) = b.steps(n), b.ends(0, n)
    costs = np.full((len(came), len(gone)), FAR, np.int64)
    for i, a in enumerate(came.tolist()):
        done, _ = settle(steps, [(0, a)])
        costs[i] = [done.get(o, FAR) if o != a else FAR for o in gone.tolist()]
    return costs


class Joint:
    """Two cells as one: crossing arcs, their closure, and the way from those that lead in and to those that lead out."""

    def __init__(self, came, gone, halves):
        (ci, co, cd), (di, do, dd) = halves
        x1, x2 = np.intersect1d(co, di), np.intersect1d(do, ci)
        self.x = np.concatenate([x1, x2])
        n1, n, table = len(x1), len(self.x), lambda r, c: np.full((r, c), FAR, np.int64)
        self.n1 = n1
        at = np.searchsorted
        self.s, self.left, self.right = table(n, n), table(len(came), n), table(n, len(gone))
        self.s[:n1, n1:], self.s[n1:, :n1] = dd[np.ix_(at(di, x1), at(do, x2))], cd[np.ix_(at(ci, x2), at(co, x1))]
        in1, out1 = np.isin(came, ci), np.isin(gone, co)
        self.in1, self.out1 = in1, out1
        self.left[np.ix_(in1, np.arange(n) < n1)] = cd[np.ix_(at(ci, came[in1]), at(co, x1))]
        self.left[np.ix_(~in1, np.arange(n) >= n1)] = dd[np.ix_(at(di, came[~in1]), at(do, x2))]
        self.right[np.ix_(np.arange(n) < n1, ~out1)] = dd[np.ix_(at(di, x1), at(do, gone[~out1]))]
        self.right[np.ix_(np.arange(n) >= n1, out1)] = cd[np.ix_(at(ci, x2), at(co, gone[out1]))]
        self.direct = table(len(came), len(gone))
        self.direct[np.ix_(in1, out1)] = cd[np.ix_(at(ci, came[in1]), at(co, gone[out1]))]
        self.direct[np.ix_(~in1, ~out1)] = dd[np.ix_(at(di, came[~in1]), at(do, gone[~out1]))]

    def close(self) -> np.ndarray:
        k = self.s.copy()
        np.fill_diagonal(k, 0)
        for i in range(len(k)):
            np.minimum(k, k[:, i, None] + k[None, i, :], out=k)
        return k


class Cells:
    """Costs between the borders of all cells: ``costs`` and, of cells of two, ``closed``, by (level, number)."""

    def __init__(self, size: int, costs: dict, closed: dict):
        self.size, self.costs, self.closed = size, costs, closed


def build(spark, graph, size: int | None = None):
    """Broadcast of the :class:`Cells` of a broadcast graph; None where its borders are too long, or costs too high, for them."""
    size = CELL if size is None else size
    b = Borders(graph.value, size)
    some = range(0, b.count, max(1, b.count // 64))
    if not len(graph.value.arc) or graph.value.sequences or np.mean([len(b.ends(0, n)[1]) for n in some]) > BORDER:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for batch in batches:
            known = known or Borders(graph.value, size)
            ids = batch.column("id").to_pylist()
            yield pa.record_batch({"id": pa.array(ids, pa.int64()), "costs": pa.array([pickle.dumps(small_cell(known, n)) for n in ids], pa.binary())})

    tasks = min(b.count, 4 * spark.sparkContext.defaultParallelism)
    costs = {(0, r.id): pickle.loads(r.costs) for r in spark.range(0, b.count, 1, tasks).mapInArrow(run, "id long, costs binary").collect()}
    closed = {}
    for level in range(1, b.top + 1):
        for n in range((b.count + (1 << level) - 1) >> level):
            ends = b.ends(level, n)
            if len(ends[0]) > 4 * BORDER:
                return None
            halves = [(*b.ends(level - 1, m), costs.get((level - 1, m), np.full((0, 0), FAR, np.int64))) for m in (2 * n, 2 * n + 1)]
            j = Joint(*ends, halves)
            closed[level, n] = j.close()
            costs[level, n] = np.minimum(j.direct, least(least(j.left, closed[level, n]), j.right))
    for table in (*costs.values(), *closed.values()):
        if ((table >= FAR // 4) & (table < FAR)).any():
            return None
    return spark.sparkContext.broadcast(Cells(size, costs, closed))


def climb(g: Compact, cells: Cells) -> Climb:
    """The searches of a worker: its next task goes on with the paths that are known."""
    if not hasattr(cells, "_climb"):
        cells._climb = Climb(g, cells)
    return cells._climb


class Climb:
    """Searches between places over cells, in one task."""

    def __init__(self, g: Compact, cells: Cells):
        self.g, self.cells, self.b, self.places = g, cells, Borders(g, cells.size), Places(g)
        self._ends, self._joints, self._steps, self._paths, self._kept = {}, {}, {}, {}, 0
        self._sides: dict[tuple, tuple] = {}

    def ends(self, level: int, n: int):
        if (level, n) not in self._ends:
            self._ends[level, n] = self.b.ends(level, n)
        return self._ends[level, n]

    def joint(self, level: int, n: int) -> Joint:
        if (level, n) not in self._joints:
            if len(self._joints) > 500:
                self._joints.clear()
            halves = [(*self.ends(level - 1, m), self.cells.costs.get((level - 1, m), np.full((0, 0), FAR, np.int64))) for m in (2 * n, 2 * n + 1)]
            self._joints[level, n] = Joint(*self.ends(level, n), halves)
        return self._joints[level, n]

    def steps(self, n: int):
        """Steps of a smallest cell forward, and backward between arcs that end in it."""
        if n not in self._steps:
            if len(self._steps) > 150:
                self._steps.clear()
            ahead, back = self.b.steps(n), {}
            for a, after in ahead.items():
                for o, step in after:
                    if o in ahead:
                        back.setdefault(o, []).append((a, step))
            self._steps[n] = (ahead, back)
        return self._steps[n]

    def side(self, arc: int, forward: bool):
        """Costs from the end of an arc, or from the ends of others to it, in its cell and all cells above."""
        if (arc, forward) in self._sides:
            return self._sides[arc, forward]
        if len(self._sides) > 500:
            self._sides.clear()
        g, vertex = self.g, self.g.to[arc] if forward else int(self.b.start[arc])
        n = vertex // self.b.size
        ahead, back = self.steps(n)
        if forward:
            done, tree = settle(ahead, [(0, arc)])
        else:
            done, tree = settle(back, [(step, a) for a, after in ahead.items() if g.to[a] == vertex for o, step in after if o == arc])
            # Without what the arc itself costs: only its turn and its place in the count.
            done = {a: c - int(g.cost[arc]) * HOP for a, c in done.items()}
        edge = self.ends(0, n)[1 if forward else 0]
        at = np.array([done.get(o, FAR) if not forward or o != arc else FAR for o in edge.tolist()], np.int64)
        levels = [(n, at, None, None)]
        for level in range(1, self.b.top + 1):
            half, up = n & 1, n >> 1
            j, k = self.joint(level, up), self.cells.closed[level, up]
            first = np.full(len(j.x), FAR, np.int64)
            mine = slice(0, j.n1) if (half == 0) == forward else slice(j.n1, None)
            first[mine] = at[np.searchsorted(edge, j.x[mine])]
            whole = (first[:, None] + k).min(0, initial=FAR) if forward else (k + first[None, :]).min(1, initial=FAR)
            over = self.ends(level, up)[1 if forward else 0]
            own = (j.out1 if forward else j.in1) == (half == 0)
            now = np.full(len(over), FAR, np.int64)
            now[own] = at[np.searchsorted(edge, over[own])]
            if len(j.x) and len(over):
                now = np.minimum(now, (whole[:, None] + j.right).min(0) if forward else (j.left + whole[None, :]).min(1))
            n, edge, at = up, over, now
            levels.append((n, at, first, whole))
        self._sides[arc, forward] = (levels, done, tree)
        return self._sides[arc, forward]

    def between(self, level: int, n: int, i: int, o: int) -> np.ndarray:
        """Arcs after ``i``, which leads into a cell, up to ``o``, which leads out."""
        key = (level, n, i, o)
        if key in self._paths:
            return self._paths[key]
        if level == 0:
            _, tree = settle(self.steps(n)[0], [(0, i)])
            for x in self.ends(0, n)[1].tolist():
                if x in tree and x != i:
                    self._keep((0, n, i, x), self._back(tree, x)[1:])
            return self._paths[key]
        j, k, (came, gone) = self.joint(level, n), self.cells.closed[level, n], self.ends(level, n)
        r, c = np.searchsorted(came, i), np.searchsorted(gone, o)
        if j.direct[r, c] == self.cells.costs[level, n][r, c]:
            return self._keep(key, self.between(level - 1, 2 * n + (not j.in1[r]), i, o))
        x, y = np.unravel_index(np.argmin(np.minimum(j.left[r][:, None] + k, FAR) + j.right[None, :, c][0][None, :]), k.shape)
        parts = [self.between(level - 1, 2 * n + (not j.in1[r]), i, int(j.x[x])), *self.crossings(level, n, x, y), self.between(level - 1, 2 * n + int(y < j.n1), int(j.x[y]), o)]
        return self._keep(key, np.concatenate(parts))

    def _keep(self, key: tuple, path) -> np.ndarray:
        path = np.asarray(path, np.int32)
        if self._kept > KEPT:
            self._paths.clear()
            self._kept = 0
        self._kept += len(path)
        self._paths[key] = path
        return path

    def _back(self, tree: dict[int, int], a: int) -> list[int]:
        out = []
        while a >= 0:
            out.append(a)
            a = tree[a]
        return out[::-1]

    def crossings(self, level: int, n: int, x: int, y: int) -> list[np.ndarray]:
        """Paths from one crossing arc to another, from half to half."""
        j, k, out = self.joint(level, n), self.cells.closed[level, n], []
        while x != y:
            sums = j.s[x] + k[:, y]
            sums[x] = 2 * FAR
            z = int(np.argmin(sums))
            out.append(self.between(level - 1, 2 * n + int(x < j.n1), int(j.x[x]), int(j.x[z])))
            x = z
        return out

    def out(self, side, level: int, o: int) -> list[np.ndarray]:
        """Path of a forward side to an arc that leads out of its cell at a level, without the first arc."""
        levels, _, tree = side
        if level == 0:
            return [np.array(self._back(tree, o)[1:], np.int32)]
        n, at, _, whole = levels[level]
        j, c = self.joint(level, n), np.searchsorted(self.ends(level, n)[1], o)
        below, was, _, _ = levels[level - 1]
        if bool(j.out1[c]) == (below & 1 == 0) and was[np.searchsorted(self.ends(level - 1, below)[1], o)] == at[c]:
            return self.out(side, level - 1, o)
        x = int(np.argmin(whole + j.right[:, c]))
        return [*self.across(side, level, x), self.between(level - 1, 2 * n + int(x < j.n1), int(j.x[x]), o)]

    def across(self, side, level: int, x: int) -> list[np.ndarray]:
        n, _, first, _ = side[0][level]
        y = int(np.argmin(first + self.cells.closed[level, n][:, x]))
        return [*self.out(side, level - 1, int(self.joint(level, n).x[y])), *self.crossings(level, n, y, x)]

    def come(self, side, level: int, i: int) -> list[np.ndarray]:
        """Path of a backward side from an arc that leads into its cell, without that arc and the last."""
        levels, _, tree = side
        if level == 0:
            return [np.array(self._back(tree, i)[::-1][1:], np.int32)]
        n, at, _, whole = levels[level]
        j, r = self.joint(level, n), np.searchsorted(self.ends(level, n)[0], i)
        below, was, _, _ = levels[level - 1]
        if bool(j.in1[r]) == (below & 1 == 0) and was[np.searchsorted(self.ends(level - 1, below)[0], i)] == at[r]:
            return self.come(side, level - 1, i)
        x = int(np.argmin(j.left[r] + whole))
        return [self.between(level - 1, 2 * n + (not j.in1[r]), i, int(j.x[x])), *self.met(side, level, x)]

    def met(self, side, level: int, x: int) -> list[np.ndarray]:
        n, _, first, _ = side[0][level]
        y = int(np.argmin(self.cells.closed[level, n][x] + first))
        return [*self.crossings(level, n, x, y), *self.come(side, level - 1, int(self.joint(level, n).x[y]))]

    def path(self, origin: tuple, target: tuple, limit: float | None = None) -> tuple | None:
        """As :meth:`Places.paths` for one target."""
        g, best, options = self.g, None, []
        for k, s in self.places.ends(*origin):
            for t, e in self.places.ends(*target):
                if k == t and e >= s:
                    options.append(((e - s) * g.cost[k], 1, k, t, s, e, None))
                f, b = self.side(k, True), self.side(t, False)
                found = (b[1].get(k, FAR), 0, -1)
                for level in range(1, self.b.top + 1):
                    (n, _, _, there), (m, _, _, back) = f[0][level], b[0][level]
                    if n == m and len(there):
                        sums = there + back
                        x = int(np.argmin(sums))
                        found = min(found, (int(sums[x]), level, x))
                if found[0] < FAR:
                    options.append(((1 - s) * g.cost[k] + found[0] // HOP + e * g.cost[t], 1 + found[0] % HOP, k, t, s, e, found))
        options = [o for o in options if limit is None or o[0] <= limit]
        first = min((o[:2] for o in options), default=None)
        for cost, hops, k, t, s, e, found in options:
            if (cost, hops) != first:
                continue
            path = [k]
            if found is not None:
                f, b, (_, level, x) = self.side(k, True), self.side(t, False), found
                parts = [np.array(self._back(b[2], k)[::-1][1:], np.int32)] if level == 0 else [*self.across(f, level, x), *self.met(b, level, x)]
                path = np.concatenate([[k], *parts, [t]])
            option = (cost, hops, g.arrays["arc"][path], s, e)
            if best is None or option[2].tolist() < best[2].tolist():
                best = option
        return best
