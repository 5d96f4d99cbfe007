"""Strongly connected parts of graphs that no task holds: labels inside parts of the graph first, then a graph of labels.

The graph is one of edges, with a link from an edge to another where an arc of the second follows one of the first; an
edge belongs to the part (a tile, say) in which it starts.  Every part labels its edges on its own, by its own links: the label is the least edge of those
that are strongly connected inside.  What a part says depends on nothing outside it, so parts that did not change keep what they said before.

Labels and the links between them are the graph that is left.  A label can only be in a cycle through other
parts if it lies on a way through its own, from one that is entered to one that is left; all others are settled.  Those on a way are dealt to
parents, some parts each, and labelled there by the same step, until none is left.  Every level loses what was settled and joins what
was connected, so a task sees the labels on ways through its children and never the edges below them.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.log import LOGGER
from waymark.operators.graph import transitions
from waymark.operators.routing import strong_components
from waymark.operators.tiled import part_of
from waymark.storage import drop, materialize

#: A parent has up to 2 ** FAN_BITS children.
FAN_BITS = 4
#: So many labels and links, at most, are left to one parent at once.
FEW = 200_000
_INNER = "part long, mark string, edge_id long, label long"
_LEVEL = "part long, node long, label long, size long, open boolean"


def edge_links(arcs: DataFrame, forbidden: DataFrame | None = None, parts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(part, node) of all edges with an arc, and links a, part_a, b, part_b between them.

    ``parts``: vertex_id, part; by ``part_of`` if there is none, and for vertices that it leaves out.  Penalties of turns and turns behind prefixes play no part.
    """
    if forbidden is not None and "penalty" in forbidden.columns:
        forbidden = forbidden.where("penalty is null").drop("penalty")
    tails = arcs.select(F.shiftright("arc_id", 1).alias("node"), F.when(F.col("arc_id") % 2 == 0, F.col("from_v")).otherwise(F.col("to_v")).alias("tail")).distinct()
    if parts is None:
        nodes = tails.select(part_of(F.col("tail")).cast("long").alias("part"), "node")
    else:
        given = parts.select(F.col("vertex_id").alias("tail"), F.col("part").cast("long").alias("part"))
        nodes = tails.join(given, "tail", "left").select(F.coalesce("part", part_of(F.col("tail"))).cast("long").alias("part"), "node")
    nodes = materialize(nodes, "label-nodes")
    links = transitions(arcs, forbidden).select(F.shiftright("a", 1).alias("a"), F.shiftright("b", 1).alias("b")).where("a <> b").distinct()
    home = lambda x: nodes.select(F.col("node").alias(x), F.col("part").alias(f"part_{x}"))
    return nodes, materialize(links.join(home("a"), "a").join(home("b"), "b").select("a", "part_a", "b", "part_b"), "label-links")


def _components(nodes: pa.Table, links: pa.Table) -> tuple[dict[int, list[int]], list[list[int]]]:
    following: dict[int, list[int]] = {n: [] for n in nodes["node"].to_pylist()}
    if links.num_rows:
        for a, b in zip(links["a"].to_pylist(), links["b"].to_pylist(), strict=True):
            following[a].append(b)
    return following, list(strong_components(following))


def inner_labels(nodes: DataFrame, links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """What every part says by itself: part, mark, edge_id, label.

    ``known`` is what was said before.  A part whose mark is the same (how many edges and links it has, and 128 bits of their hashes) is taken from there and not searched again.
    """
    inner = links.where("part_a = part_b").select(F.col("part_a").alias("part"), "a", "b")
    rows = nodes.select("part", F.col("node").alias("a"), F.lit(-1).cast("long").alias("b")).unionByName(inner)
    marks = rows.groupBy("part").agg(F.concat_ws("-", F.count("*"), *[F.hex(F.bit_xor(F.xxhash64("a", "b", F.lit(k)))) for k in (0, 1)]).alias("mark"))
    marks = materialize(marks, "label-marks")
    todo = marks if known is None else marks.join(known.select("part", "mark").distinct(), ["part", "mark"], "left_anti")

    def run(own: pa.Table, ways: pa.Table) -> pa.Table:
        found = _components(own, ways)[1] if own.num_rows else []
        n = sum(map(len, found))
        part, mark = (own["part"][0].as_py(), own["mark"][0].as_py()) if n else (None, None)
        columns = [[part] * n, [mark] * n, [e for c in found for e in c], [least for c in found for least in [min(c)] * len(c)]]
        return pa.table([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["part", "mark", "edge_id", "label"])

    fresh = nodes.join(todo, "part").groupBy("part").cogroup(inner.join(todo.select("part"), "part", "left_semi").groupBy("part")).applyInArrow(run, _INNER)
    if known is not None:
        fresh = fresh.unionByName(known.select("part", "mark", "edge_id", "label").join(marks, ["part", "mark"], "left_semi"))
    out = materialize(fresh, "label-inner")
    drop(marks)
    return out


def _level(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Labels of nodes (part, node, size) by the links inside their parts, and whether they are on a way through it."""
    cross = links.where("part_a <> part_b")
    yes, no = F.lit(True), F.lit(False)
    ends = cross.select(F.col("a").alias("node"), yes.alias("left"), no.alias("entered")).unionByName(cross.select(F.col("b").alias("node"), no.alias("left"), yes.alias("entered")))
    ends = ends.groupBy("node").agg(F.max("left").alias("left"), F.max("entered").alias("entered"))
    flagged = nodes.join(ends, "node", "left").select("part", "node", "size", F.coalesce("left", no).alias("left"), F.coalesce("entered", no).alias("entered"))

    def run(own: pa.Table, ways: pa.Table) -> pa.Table:
        rows = []
        if own.num_rows:
            # Components come with those that they lead to before them.
            following, found = _components(own, ways)
            at = {n: i for i, c in enumerate(found) for n in c}
            size, left, entered = (dict(zip(own["node"].to_pylist(), own[x].to_pylist(), strict=True)) for x in ("size", "left", "entered"))
            next_ = [{at[o] for n in c for o in following[n]} - {i} for i, c in enumerate(found)]
            out, into = [any(left[n] for n in c) for c in found], [any(entered[n] for n in c) for c in found]
            for i, ahead in enumerate(next_):
                out[i] = out[i] or any(out[j] for j in ahead)
            for i in range(len(found) - 1, -1, -1):
                for j in next_[i] if into[i] else ():
                    into[j] = True
            part = own["part"][0].as_py()
            rows = [(part, n, min(c), sum(size[m] for m in c), out[i] and into[i]) for i, c in enumerate(found) for n in c]
        return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], names=["part", "node", "label", "size", "open"])

    inner = links.where("part_a = part_b").select(F.col("part_a").alias("part"), "a", "b")
    return materialize(flagged.groupBy("part").cogroup(inner.groupBy("part")).applyInArrow(run, _LEVEL), "label-level")


def _renamed(links: DataFrame, names: DataFrame) -> DataFrame:
    """Links between the labels of nodes (node, label) that differ."""
    side = lambda x: names.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}"))
    both = links.join(side("a"), "a").join(side("b"), "b").where("label_a <> label_b")
    return both.select(F.col("label_a").alias("a"), "part_a", F.col("label_b").alias("b"), "part_b").distinct()


def edge_labels(arcs: DataFrame, forbidden: DataFrame | None = None, parts: DataFrame | None = None, *, known: DataFrame | None = None, few: int = FEW) -> tuple[DataFrame, DataFrame]:
    """(edges, inner): edge_id, label and size of every edge's strongly connected part, the label being its least edge; and what parts said, to be given as ``known`` the next time.

    Edges without an arc are not there; repeated arcs count once; an empty table gives empty ones.
    """
    nodes, links = edge_links(arcs, forbidden, parts)
    inner = inner_labels(nodes, links, known)
    graph = materialize(_renamed(links, inner.select(F.col("edge_id").alias("node"), "label")), "label-links")
    drop(links)
    drop(nodes)
    states = materialize(inner.groupBy("part", F.col("label").alias("node")).agg(F.count("*").alias("size")), "label-nodes")
    levels = []
    while True:
        level = _level(states, graph)
        levels.append(level)
        drop(states)
        up = lambda c: F.shiftrightunsigned(c, FAN_BITS).alias(c)
        links = materialize(_renamed(graph, level.where("open").select("node", "label")).select("a", up("part_a"), "b", up("part_b")), "label-links")
        drop(graph)
        graph, states = links, materialize(level.where("open and node = label").select(up("part"), "node", "size"), "label-nodes")
        left, ways = states.count(), graph.count()
        LOGGER.debug("level %s: %s labels and %s links are left", len(levels), left, ways)
        if left == 0:
            break
        if left <= few and ways <= few:
            states, graph = states.withColumn("part", F.lit(0).cast("long")), graph.withColumn("part_a", F.lit(0).cast("long")).withColumn("part_b", F.lit(0).cast("long"))
    named = None
    for level in reversed(levels):
        settled = level.where("not open").select("node", "label", "size")
        if named is not None:
            above = named.select(F.col("node").alias("label"), F.col("label").alias("top"), "size")
            settled = settled.unionByName(level.where("open").select("node", "label").join(above, "label").select("node", F.col("top").alias("label"), "size"))
        under = materialize(settled, "label-named")
        if named is not None:
            drop(named)
        drop(level)
        named = under
    above = named.select(F.col("node").alias("label"), F.col("label").alias("top"), "size")
    edges = materialize(inner.join(above, "label").select("edge_id", F.col("top").alias("label"), "size"), "label-edges")
    for done in (named, states, graph):
        drop(done)
    return edges, inner


def islands_by_parts(arcs: DataFrame, forbidden: DataFrame | None = None, parts: DataFrame | None = None, *, max_size: int = 1024) -> DataFrame:
    """The edges of ``routing.islands`` and their sizes, by labels."""
    edges, inner = edge_labels(arcs, forbidden, parts)
    drop(inner)
    return edges.where(F.col("size") < max_size).select("edge_id", "size")
