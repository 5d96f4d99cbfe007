"""Arcs, costs, turns and searches by box over a network in tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators.profiles import Profile


def arcs(edges: DataFrame) -> DataFrame:
    """Both directions of every edge; arc_id is 2 * edge_id, plus one backward."""
    rest = [c for c in edges.columns if c not in ("edge_id", "tail", "head", "shape")]
    shaped = "shape" in edges.columns
    forward = edges.select("edge_id", F.lit(True).alias("forward"), F.col("tail").alias("from_v"), F.col("head").alias("to_v"), *(["shape"] if shaped else []), *rest)
    backward = edges.select("edge_id", F.lit(False).alias("forward"), F.col("head").alias("from_v"), F.col("tail").alias("to_v"), *([F.reverse("shape").alias("shape")] if shaped else []), *rest)
    return forward.unionByName(backward).withColumn("arc_id", F.col("edge_id") * 2 + F.when(F.col("forward"), 0).otherwise(1))


#: Dictionaries of attribute sets up to this many rows are broadcast; larger ones are joined by key.
BROADCAST_TYPES = 100_000


def _small(types: DataFrame, bound: int = BROADCAST_TYPES) -> DataFrame:
    return F.broadcast(types) if types.limit(bound + 1).count() <= bound else types


def cost_arcs(edges: DataFrame, profile: Profile) -> DataFrame:
    """Arcs that the profile may take, with cost = directed factor x length in cm, and speed.

    The profile rates every distinct set of the attributes it reads once, and edges take the rates by that set.
    """
    # A subclass may read any attribute.
    seen = F.array(*[F.col("attrs")[k] for k in profile.keys]) if type(profile) is Profile else F.array_sort(F.map_entries("attrs"))
    keyed = edges.withColumn("_key", F.coalesce(F.to_json(seen), F.lit("")))
    types = keyed.groupBy("_key").agg(F.first("attrs").alias("attrs"))
    fwd, bwd, fwd_speed, bwd_speed, can_stop = profile.factors(F.col("attrs"))
    both = arcs(keyed.join(_small(types.select("_key", fwd, bwd, fwd_speed, bwd_speed, can_stop)), "_key").drop("_key"))
    factor = F.when(F.col("forward"), F.col("fwd_factor")).otherwise(F.col("bwd_factor"))
    speed = F.when(F.col("forward"), F.col("fwd_speed")).otherwise(F.col("bwd_speed"))
    return both.where(factor > 0).withColumn("cost", factor * F.col("length_cm")).withColumn("speed", speed).drop("fwd_factor", "bwd_factor", "fwd_speed", "bwd_speed")


def acceptable(edges: DataFrame, *profiles: Profile, islands: DataFrame | None = None, any_profile: bool = False, can_stop: bool = True) -> DataFrame:
    """Edges that all profiles (or ``any_profile``) may travel in some direction and stop on, and that lie on no island (edge_id)."""
    if profiles:
        tests = []
        for p in profiles:
            fwd, bwd, _, _, stop = p.factors(F.col("attrs"))
            tests.append(((fwd > 0) | (bwd > 0)) & (stop if can_stop else F.lit(True)))
        ok = tests[0]
        for t in tests[1:]:
            ok = ok | t if any_profile else ok & t
        edges = edges.where(ok)
    return edges if islands is None else edges.join(islands.select("edge_id").distinct(), "edge_id", "left_anti").select(*edges.columns)


def forbidden_turns(turn_costs: DataFrame, profile: Profile) -> DataFrame:
    """(vertex_id, from_edge, to_edge, prefix, penalty) that count for the profile; with a prefix, only after those edges.

    A turn type that the profile forbids has no penalty (null); of others, the profile's turn factor times the cost is added to a path.
    """
    prefix = "prefix" if "prefix" in turn_costs.columns else F.array().cast("array<long>").alias("prefix")
    factor, binary = profile.turn_factor(F.col("attrs"))
    rated = turn_costs.where("cost > 0").select("vertex_id", "from_edge", "to_edge", prefix, F.when(~binary, factor * F.col("cost")).alias("penalty"))
    return rated.where("penalty is null or penalty > 0")


def plain_turns(forbidden: DataFrame) -> DataFrame:
    """Turns that hold whatever came before: vertex_id, from_edge, to_edge, penalty (null: forbidden), each once."""
    rows = forbidden.where(F.coalesce(F.size("prefix"), F.lit(0)) <= 0) if "prefix" in forbidden.columns else forbidden
    penalty = F.col("penalty") if "penalty" in rows.columns else F.lit(None).cast("long")
    summed = rows.withColumn("penalty", penalty).groupBy("vertex_id", "from_edge", "to_edge").agg(F.sum("penalty").alias("p"), F.max(F.col("penalty").isNull()).alias("barred"))
    return summed.select("vertex_id", "from_edge", "to_edge", F.when(~F.col("barred"), F.col("p")).alias("penalty"), "barred")


def turn_sequences(forbidden: DataFrame) -> DataFrame:
    """Turns that hold only after the edges of their prefix."""
    if "prefix" not in forbidden.columns:
        return forbidden.limit(0).select("vertex_id", "from_edge", "to_edge", F.array().cast("array<long>").alias("prefix"))
    return forbidden.where(F.size("prefix") > 0).select("vertex_id", "from_edge", "to_edge", "prefix").distinct()


def transitions(arc_table: DataFrame, forbidden: DataFrame | None = None) -> DataFrame:
    """Pairs of arcs (a, b, vertex_id, penalty) where b follows a: another edge that leaves where a ends, and no forbidden turn (those with a prefix are no matter of two arcs)."""
    a = arc_table.select(F.col("arc_id").alias("a"), F.col("edge_id").alias("from_edge"), F.col("to_v").alias("vertex_id"))
    b = arc_table.select(F.col("arc_id").alias("b"), F.col("edge_id").alias("to_edge"), F.col("from_v").alias("vertex_id"))
    pairs = a.join(b, "vertex_id").where("from_edge <> to_edge")
    if forbidden is None:
        return pairs.select("a", "b", "vertex_id", F.lit(0).cast("long").alias("penalty"))
    pairs = pairs.join(plain_turns(forbidden), ["vertex_id", "from_edge", "to_edge"], "left").where("barred is null or not barred")
    return pairs.select("a", "b", "vertex_id", F.coalesce("penalty", F.lit(0).cast("long")).alias("penalty"))


def box_zoom(metres: float) -> int:
    """Zoom of tiles about twice to four times as wide as ``metres``, at 60 degrees north."""
    return max(0, min(20, int(math.log2(math.pi * geo.RADIUS / (2 * metres)))))


def vertices_in_boxes(vertices: DataFrame, boxes: DataFrame, zoom: int = 14) -> DataFrame:
    """(query_id, vertex) for boxes (query_id, box): an equi-join on tiles, then the half-open box test."""
    tiled = vertices.withColumn("tile", geo.tile_id(F.col("lon"), F.col("lat"), zoom))
    asked = boxes.select("query_id", "box", F.explode(geo.tile_range(F.col("box"), zoom)).alias("tile"))
    return tiled.join(asked, "tile").where(geo.in_box(F.col("lon"), F.col("lat"), F.col("box"))).drop("tile", "box")


def edges_in_boxes(vertices: DataFrame, edges: DataFrame, boxes: DataFrame, zoom: int = 14, by_segment: bool = False) -> DataFrame:
    """(query_id, edge_id): edges with an end in the box, each once for a query; ``by_segment``: edges with any point in it, their ends wherever they are."""
    if by_segment:
        lines = full_shape(edges, vertices).select("edge_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("points") - 1), lambda i: F.struct(F.get("points", i - 1).alias("p"), F.get("points", i).alias("q")))).alias("s"))
        tiled = lines.select("edge_id", "s", F.explode(geo.tiles_crossed(F.col("s.p"), F.col("s.q"), zoom)).alias("tile"))
        asked = boxes.select("query_id", "box", F.explode(geo.tile_range(F.col("box"), zoom)).alias("tile"))
        return tiled.join(asked, "tile").where(geo.meets_box(F.col("s.p"), F.col("s.q"), F.col("box"))).select("query_id", "edge_id").distinct()
    inside = vertices_in_boxes(vertices, boxes, zoom).select("query_id", "vertex_id")
    ends = edges.select("edge_id", F.explode(F.array("tail", "head")).alias("vertex_id"))
    return inside.join(ends, "vertex_id").select("query_id", "edge_id").distinct()


def arcs_near(arc_table: DataFrame, vertices: DataFrame, places: DataFrame, metres: float, zoom: int = 14) -> DataFrame:
    """Arcs that leave a vertex in one of the boxes of ``metres`` around the places (query_id, lon, lat): bounds a search."""
    boxes = places.select("query_id", geo.box_around(F.col("lon"), F.col("lat"), F.lit(metres)).alias("box"))
    inside = vertices_in_boxes(vertices, boxes, zoom).select(F.col("vertex_id").alias("from_v")).distinct()
    return arc_table.join(inside, "from_v", "left_semi").select(*arc_table.columns)


def full_shape(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges with ``points``: tail, shape, head."""
    place = lambda name: vertices.select(F.col("vertex_id").alias(name), F.struct("lon", "lat").alias(f"{name}_at"))
    joined = edges.join(place("tail"), "tail").join(place("head"), "head")
    return joined.withColumn("points", F.concat(F.array("tail_at"), F.coalesce("shape", F.array().cast("array<struct<lon:double,lat:double>>")), F.array("head_at"))).drop("tail_at", "head_at")


def snap(
    points: DataFrame,
    vertices: DataFrame,
    edges: DataFrame,
    *profiles: Profile,
    radius: float = 100.0,
    wide: float = 500.0,
    max_distance: float = 100.0,
    everything: bool = False,
    islands: DataFrame | None = None,
    any_profile: bool = False,
    can_stop: bool = True,
    orthogonal: bool = False,
    zoom: int | None = None,
) -> DataFrame:
    """Nearest place on an edge for each point (query_id, lon, lat): query_id, edge_id, offset (0 to 65535), distance_m, error.

    Edges with an end within ``radius`` are candidates, within ``wide`` for points with none, if
    they are :func:`acceptable` for the profiles and on no island.
    A distance below a metre counts as zero; ties go to the smaller edge, then offset.
    ``everything`` returns the best place on every candidate edge; ``orthogonal`` only feet of perpendiculars.
    """
    edges = acceptable(edges, *profiles, islands=islands, any_profile=any_profile, can_stop=can_stop)
    shaped = full_shape(edges.select("edge_id", "tail", "head", "shape"), vertices).select("edge_id", "points")

    def best(asked: DataFrame, metres: float) -> DataFrame:
        # One join on tiles that are about as large as the boxes: an edge lies in those of its ends.
        at = zoom or box_zoom(metres)
        first, last = F.col("points")[0], F.element_at("points", -1)
        index = shaped.withColumn("tile", F.explode(F.array_distinct(F.array(geo.tile_id(first["lon"], first["lat"], at), geo.tile_id(last["lon"], last["lat"], at)))))
        boxes = asked.withColumn("box", geo.box_around(F.col("lon"), F.col("lat"), F.lit(metres))).withColumn("tile", F.explode(geo.tile_range(F.col("box"), at)))
        near = boxes.join(index, "tile").where(geo.in_box(first["lon"], first["lat"], F.col("box")) | geo.in_box(last["lon"], last["lat"], F.col("box")))
        pieces = F.arrays_zip(F.slice("points", F.lit(1), F.size("points") - 1).alias("p"), F.slice("points", F.lit(2), F.size("points") - 1).alias("q"))
        # An edge met in several tiles counts once, for the least of equal places is one place.
        near = near.select("query_id", "lon", "lat", "edge_id", F.posexplode(pieces).alias("k", "s"))
        c = F.col
        near = near.select("query_id", "edge_id", "k", "lon", "lat", c("s.p.lon").alias("px"), c("s.p.lat").alias("py"), c("s.q.lon").alias("qx"), c("s.q.lat").alias("qy"))
        # Foot of the perpendicular, one step at a time: a value that is used twice is computed once.
        near = near.withColumn("kx", F.cos(F.radians((c("py") + c("qy")) / 2))).withColumn("dx", (c("qx") - c("px")) * c("kx")).withColumn("dy", c("qy") - c("py"))
        near = near.withColumn("square", c("dx") * c("dx") + c("dy") * c("dy"))
        near = near.withColumn("t", ((c("lon") - c("px")) * c("kx") * c("dx") + (c("lat") - c("py")) * c("dy")) / F.when(c("square") > 0, c("square")))
        near = near.withColumn("fx", c("px") + (c("qx") - c("px")) * c("t")).withColumn("fy", c("py") + (c("qy") - c("py")) * c("t"))
        near = near.withColumn("df", F.when(c("t").between(0, 1), geo.distance(c("lon"), c("lat"), c("fx"), c("fy"))))
        near = near.withColumn("dp", geo.distance(c("lon"), c("lat"), c("px"), c("py"))).withColumn("dq", geo.distance(c("lon"), c("lat"), c("qx"), c("qy")))

        def option(d: str, share) -> Column:
            value = F.struct(F.when(c(d) < 1, 0.0).otherwise(F.round(d, 6)).alias("d"), share.alias("share"), c(d).alias("metres"))
            return F.when(c(d) < max_distance, value)

        foot, ends = option("df", c("t")), [option("dp", F.lit(0.0)), option("dq", F.lit(1.0))]
        # Of a segment, the nearest of its ends and the foot; the first of equals.
        one = near.withColumn("o", foot if orthogonal else F.least(*ends, foot))
        keys = ["query_id", "edge_id"] if everything else ["query_id"]
        # Segments that are too far are told apart in the aggregation: a filter would drag the geometry down to the join and compute it over and over.
        place = F.when(c("o").isNotNull(), F.struct(c("o.d").alias("d"), c("edge_id").alias("edge"), c("k"), c("o.share").alias("share"), c("o.metres").alias("metres")))
        ranked = one.select("query_id", "edge_id", place.alias("s"))
        return ranked.groupBy(*keys).agg(F.min("s").alias("s")).where("s is not null").select("query_id", "s.edge", "s.k", "s.share", "s.metres")

    points = points.select("query_id", "lon", "lat")
    first = best(points, radius)
    rest = points.join(first.select("query_id").distinct(), "query_id", "left_anti")
    found = first.unionByName(best(rest, wide)).join(shaped.withColumnRenamed("edge_id", "edge"), "edge")
    # The way along the edge is measured for the places found alone.
    p, q = F.element_at("points", F.col("k") + 1), F.element_at("points", F.col("k") + 2)
    along = geo.line_length(F.slice("points", F.lit(1), F.col("k") + 1)) + F.col("share") * geo.distance(p["lon"], p["lat"], q["lon"], q["lat"])
    total = geo.line_length(F.col("points"))
    offset = F.when(total > 0, F.least(F.lit(geo.OFFSET_MAX), F.floor(along / total * geo.OFFSET_MAX + 1e-6))).otherwise(0).cast("int")
    placed = found.select("query_id", F.col("edge").alias("edge_id"), offset.alias("offset"), F.col("metres").alias("distance_m"))
    return points.select("query_id").join(placed, "query_id", "left").withColumn("error", F.when(F.col("edge_id").isNull(), "no edge found near the point"))


def snap_to_vertex(points: DataFrame, vertices: DataFrame, edges: DataFrame | None = None, *profiles: Profile, radius: float = 100.0, everything: bool = False, islands: DataFrame | None = None, zoom: int | None = None) -> DataFrame:
    """Nearest vertex (or all) within ``radius``: query_id, vertex_id, distance_m.  With ``edges``, only vertices with an :func:`acceptable` one."""
    if edges is not None:
        ends = acceptable(edges, *profiles, islands=islands).select(F.explode(F.array("tail", "head")).alias("vertex_id")).distinct()
        vertices = vertices.join(ends, "vertex_id", "left_semi")
    asked = points.select("query_id", geo.box_around(F.col("lon"), F.col("lat"), F.lit(radius)).alias("box"))
    at = points.select("query_id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    near = vertices_in_boxes(vertices, asked, zoom or box_zoom(radius)).join(at, "query_id").withColumn("distance_m", geo.distance(F.col("x"), F.col("y"), F.col("lon"), F.col("lat")))
    if everything:
        return near.select("query_id", "vertex_id", "distance_m")
    best = near.groupBy("query_id").agg(F.min(F.struct(F.round("distance_m", 6).alias("d"), "vertex_id", "distance_m")).alias("s"))
    return best.select("query_id", "s.vertex_id", "s.distance_m")
