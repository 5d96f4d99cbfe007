"""Costs between many places, turns paid, by cells: from all sources down to the targets of a cell instead of a search for each source.

The cells are those of :mod:`overlay`.  A source knows what it costs to the arcs that cross within each cell above it.  A task goes from the whole graph
down to the cells of its own targets, with the costs from all sources to the arcs that lead into each, and at the end over the few arcs within.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from waymark.functions.geo import OFFSET_MAX
from waymark.operators import overlay
from waymark.operators.overlay import FAR, HOP
from waymark.operators.routing import Compact

#: From so many sources on, and up to so many, whose costs upward every task gets; and sources that go down together.
FEW, MANY, BLOCK = 32, 25_000, 4096
#: Rows that are given out at once.
ROWS = 200_000


def _ends(g: Compact, edges: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the place, arc, share of it behind the place) for each direction of travel, in the order of the places."""
    share = offsets / OFFSET_MAX
    n, arcs, share = np.tile(np.arange(len(edges)), 2), np.concatenate([2 * edges, 2 * edges + 1]), np.concatenate([share, 1 - share])
    at = np.minimum(np.searchsorted(g.arrays["arc"], arcs, sorter=g.order), len(g.order) - 1)
    k = g.order[at]
    ok = g.arrays["arc"][k] == arcs
    order = np.argsort(n[ok], kind="stable")
    return n[ok][order], k[ok][order], share[ok][order]


def _least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """:func:`overlay.least` for many rows."""
    return np.concatenate([overlay.least(a[i : i + 512], b) for i in range(0, len(a), 512)] or [np.full((0, b.shape[1]), FAR, np.int64)])


class Asked:
    """What all tasks know: places and their ends, and costs upward of sources by (level, cell): (rows, table)."""

    def __init__(self, sources: pa.Table, targets: pa.Table, starts, goals, ups: dict):
        self.sources, self.targets, self.starts, self.goals, self.ups = sources, targets, starts, goals, ups


class Down:
    """Costs from a block of sources (rows: their arcs) to the arcs that lead into cells."""

    def __init__(self, climb: overlay.Climb, ups: dict, arcs: np.ndarray, lo: int):
        self.climb, self.arcs, self.known, self.leaves = climb, arcs, {}, {}
        self.ups = {}
        for cell, (rows, table) in ups.items():
            i, j = np.searchsorted(rows, (lo, lo + len(arcs)))
            if i < j:
                self.ups[cell] = rows[i:j] - lo, table[i:j]
        self.ending = np.array([climb.g.to[k] for k in arcs.tolist()], np.int64) // climb.b.size

    def into(self, level: int, n: int) -> np.ndarray:
        c = self.climb
        if level == c.b.top:
            return np.full((len(self.arcs), len(c.ends(level, n)[0])), FAR, np.int64)
        if (level, n) in self.known:
            return self.known[level, n]
        up, half = n >> 1, n & 1
        above, came, over, j = self.into(level + 1, up), c.ends(level, n)[0], c.ends(level + 1, up)[0], c.joint(level + 1, up)
        mine = slice(j.n1, None) if half == 0 else slice(0, j.n1)
        crossed = _least(above, overlay.least(j.left, c.cells.closed[level + 1, up][:, mine]))
        if (level + 1, up) in self.ups:
            rows, table = self.ups[level + 1, up]
            crossed[rows] = np.minimum(crossed[rows], table[:, mine])
        out = np.full((len(self.arcs), len(came)), FAR, np.int64)
        own = j.in1 == (half == 0)
        out[:, np.searchsorted(came, over[own])] = above[:, own]
        out[:, np.searchsorted(came, j.x[mine])] = crossed
        while len(self.known) > 3 * c.b.top:
            del self.known[next(iter(self.known))]
        self.known[level, n] = out
        return out

    def leaf(self, n: int) -> tuple:
        """(first arc of a smallest cell, costs from each arc that leads in to those that start there, rows of the sources there, and costs from them), without what the last arc itself costs."""
        if n not in self.leaves:
            c = self.climb
            lo, hi = c.b.reach(0, n)
            first, last = int(c.g.first[lo]), int(c.g.end[hi - 1])
            ahead = c.steps(n)[0]
            rows = np.flatnonzero(self.ending == n)

            def table(arcs: np.ndarray) -> np.ndarray:
                out = np.full((len(arcs), last - first), FAR, np.int64)
                for i, a in enumerate(arcs.tolist()):
                    done, _ = overlay.settle(ahead, [(0, a)])
                    # Back to the arc itself: no cost of nothing.
                    done[a] = min((done[p] + step for p, after in ahead.items() if p in done for o, step in after if o == a), default=FAR) if first <= a < last else FAR
                    for o, cost in done.items():
                        if first <= o < last and cost < FAR:
                            out[i, o - first] = cost - c.g.cost[o] * HOP
                return out

            while len(self.leaves) > 3:
                del self.leaves[next(iter(self.leaves))]
            self.leaves[n] = first, table(c.ends(0, n)[0]), rows, table(self.arcs[rows])
        return self.leaves[n]

    def costs(self, n: int, goals: np.ndarray) -> np.ndarray:
        """From all rows to the beginning of arcs that start in a smallest cell, with the turns into them."""
        first, inward, rows, near = self.leaf(n)
        found = _least(self.into(0, n), inward[:, goals - first])
        found[rows] = np.minimum(found[rows], near[:, goals - first])
        return found


def between(spark, graph, sources: DataFrame, targets: pa.Table, out: str, limit: float | None = None) -> DataFrame | None:
    """Rows of ``routing.place_matrix`` without paths for a broadcast graph; None where sources are too few or too many, or borders too long."""
    if not FEW <= sources.limit(MANY + 1).count() <= MANY or not len(targets):
        return None
    cells = overlay.build(spark, graph)
    if cells is None:
        return None
    g, asked = graph.value, sources.toArrow()
    arrays = lambda t: (t["edge"].fill_null(-1).to_numpy(), t["offset"].fill_null(0).to_numpy())
    starts, goals = (_ends(g, *arrays(t)) for t in (asked, targets))

    def upward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        climb = overlay.climb(graph.value, cells.value)
        for b in batches:
            for row, arc in zip(b.column("row").to_pylist(), b.column("arc").to_pylist(), strict=True):
                yield pa.record_batch({"row": [row], "costs": pa.array([pickle.dumps([(n, whole) for n, _, _, whole in climb.side(arc, True)[0][1:]])], pa.binary())})

    tasks = 4 * spark.sparkContext.defaultParallelism
    # Sources near each other share the tables of their cells.
    order = np.argsort(g.arrays["to"][starts[1]], kind="stable")
    listed = spark.createDataFrame(pa.table({"place": np.arange(len(order)), "row": order, "arc": starts[1][order]})) if len(order) else None
    held: dict = {}
    if listed is not None:
        for r in listed.repartitionByRange(tasks, "place").select("row", "arc").mapInArrow(upward, "row long, costs binary").collect():
            for level, (n, whole) in enumerate(pickle.loads(r.costs), 1):
                held.setdefault((level, n), []).append((r.row, whole))
    ups = {}
    for cell, found in held.items():
        found.sort(key=lambda x: x[0])
        ups[cell] = np.array([r for r, _ in found]), np.array([w for _, w in found])
    held.clear()
    # A place belongs to the cell where its first arc starts; those without any arc to the first cell that is asked for.
    size = cells.value.size
    leaf = (np.searchsorted(g.arrays["end"], goals[1], side="right") // size).astype(np.int64)
    home = np.full(len(targets), -1)
    home[goals[0][::-1]] = leaf[::-1]
    home[home < 0] = home[home >= 0].min(initial=np.iinfo(np.int64).max) if (home >= 0).any() else 0
    used = np.unique(home)
    sent = spark.sparkContext.broadcast(Asked(asked.select(["id"]), targets.select(["id"]), starts, (*goals, leaf, home), ups))
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(out))

    def rows(g: Compact, places: np.ndarray, below: Down, starts, block: range) -> np.ndarray:
        """Costs from a block of sources to some targets, infinite where there is no path."""
        n, arcs, share, leaf = (x[np.isin(sent.value.goals[0], places)] for x in sent.value.goals[:4])
        source, k, s = starts
        found = np.full((len(k), len(n)), np.inf)
        for c in np.unique(leaf).tolist():
            on = np.flatnonzero(leaf == c)
            inner = below.costs(c, arcs[on])
            found[:, on] = np.where(inner < FAR, inner // HOP, np.inf)
        cost = g.arrays["cost"]
        found = ((1 - s) * cost[k])[:, None] + found + (share * cost[arcs])[None, :]
        for j, (a, e) in enumerate(zip(arcs.tolist(), share.tolist(), strict=True)):
            same = np.flatnonzero((k == a) & (s <= e))
            found[same, j] = np.minimum(found[same, j], (e - s[same]) * cost[a])
        if limit is not None:
            found[found > limit] = np.inf
        out = np.full((len(block), len(places)), np.inf)
        if len(k) and len(n):
            (here, i), (there, j) = np.unique(source, return_index=True), np.unique(n, return_index=True)
            out[np.ix_(here - block.start, np.searchsorted(places, there))] = np.minimum.reduceat(np.minimum.reduceat(found, i, axis=0), j, axis=1)
        return out

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, a = graph.value, sent.value
        climb = overlay.climb(g, cells.value)
        ids = [t["id"].combine_chunks() for t in (a.sources, a.targets)]
        own = [c for b in batches for c in b.column("id").to_pylist()]
        for lo in range(0, len(ids[0]), BLOCK):
            block = range(lo, min(lo + BLOCK, len(ids[0])))
            i, j = np.searchsorted(a.starts[0], (block.start, block.stop))
            below = Down(climb, a.ups, a.starts[1][i:j], i)
            for c in own:
                places = np.flatnonzero(a.goals[4] == used[c])
                found = rows(g, places, below, [x[i:j] for x in a.starts], block)
                step = max(1, ROWS // len(places))
                for at in range(0, len(block), step):
                    cost = found[at : at + step].ravel()
                    n, none = len(cost), np.isinf(cost)
                    source = ids[0].take(pa.array(np.repeat(np.arange(lo + at, lo + at + n // len(places)), len(places))))
                    target = ids[1].take(pa.array(np.tile(places, n // len(places))))
                    path = pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], pa.int64()), type=schema.field("path").type)
                    error = pa.array(["no path"]).take(pa.array(np.zeros(n, np.int64), mask=~none))
                    yield pa.RecordBatch.from_arrays([source, target, pa.array(cost, mask=none), path, error], schema=schema)

    return spark.range(0, len(used), 1, min(len(used), tasks)).mapInArrow(fill, out)
