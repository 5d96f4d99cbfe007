"""Places on edges (edge_id, offset): made from vertices or edges, their location, angle and direction; elevation of points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators.graph import arcs
from waymark.operators.profiles import Profile


def _usable(arc_table: DataFrame, profile: Profile | None, forward: Column) -> Column:
    """Whether the profile may travel the edge in that direction and stop on it."""
    if profile is None:
        return F.lit(True)
    fwd, bwd, _, _, can_stop = profile.factors(F.col("attrs"))
    return (F.when(forward, fwd).otherwise(bwd) > 0) & can_stop


def from_vertices(queries: DataFrame, edges: DataFrame, profile: Profile | None = None, *, departure: bool = True) -> DataFrame:
    """A place on every edge at a vertex (query_id, vertex_id): query_id, edge_id, offset (0 at the tail, 65535 at the head).

    With a profile, edges that it cannot leave the vertex by (or, for an arrival, reach it by)
    are left out.  A vertex without edges gives no row.
    """
    leaving = arcs(edges.select("edge_id", "tail", "head", "attrs")).withColumnRenamed("from_v", "vertex_id")
    forward = F.col("forward") if departure else ~F.col("forward")
    at = queries.select("query_id", "vertex_id").join(leaving.where(_usable(leaving, profile, forward)), "vertex_id")
    return at.select("query_id", "edge_id", F.when(F.col("forward"), 0).otherwise(geo.OFFSET_MAX).alias("offset"))


def from_edges(queries: DataFrame, edges: DataFrame, profile: Profile | None = None) -> DataFrame:
    """The place that a query names (query_id, edge_id, offset, forward): with ``error`` if there is no such edge or the profile cannot use it that way."""
    known = edges.select("edge_id", "attrs", F.lit(True).alias("known"))
    j = queries.select("query_id", "edge_id", "offset", "forward").join(known, "edge_id", "left")
    error = F.when(F.col("known").isNull(), "edge not found").when(~F.coalesce(_usable(j, profile, F.col("forward")), F.lit(False)), "edge cannot be used in that direction")
    return j.select("query_id", "edge_id", "offset", error.alias("error"))


def vertices_of(places: DataFrame, edges: DataFrame) -> DataFrame:
    """Places (query_id, edge_id, offset) with ``vertex_id``, the end of the edge they lie on (null in between), and ``factor``, their share of the edge."""
    j = places.join(edges.select("edge_id", "tail", "head"), "edge_id", "left")
    vertex = F.when(F.col("offset") == 0, F.col("tail")).when(F.col("offset") == geo.OFFSET_MAX, F.col("head"))
    return j.select(*places.columns, vertex.alias("vertex_id"), (F.col("offset") / geo.OFFSET_MAX).alias("factor"))


def location(points: Column, offset: Column) -> Column:
    """Point of a place on its edge's line (tail, shape, head)."""
    return geo.along(points, offset / geo.OFFSET_MAX)


def angle(points: Column, offset: Column, length_m: Column, metres: float = 10.0) -> Column:
    """Bearing (0 to 360) of the edge over ``metres`` to both sides of a place; null where that is less than 0.1 m."""
    if metres <= 0:
        raise ValueError("the distance must be over 0")
    reach = F.lit(metres) / length_m * geo.OFFSET_MAX
    whole = reach > geo.OFFSET_MAX
    low = F.when(whole, 0).otherwise(F.floor(F.greatest(F.lit(0.0), offset - reach))).cast("int")
    high = F.when(whole, geo.OFFSET_MAX).otherwise(F.floor(F.least(F.lit(float(geo.OFFSET_MAX)), offset + reach))).cast("int")

    def ends(t: Column) -> Column:
        # Never less than the smallest step.
        same = t["low"] == t["high"]
        first = F.when(same, F.greatest(t["low"] - 1, F.lit(0))).otherwise(t["low"])
        last = F.when(same, F.least(t["high"] + 1, F.lit(geo.OFFSET_MAX))).otherwise(t["high"])
        return F.struct(t["points"].alias("points"), (first / geo.OFFSET_MAX).alias("first"), (last / geo.OFFSET_MAX).alias("last"))

    def bearing(s: Column) -> Column:
        a, b = s["a"], s["b"]
        return F.when(geo.distance(a["lon"], a["lat"], b["lon"], b["lat"]) >= 0.1, geo.normalize_degrees(geo.bearing(a["lon"], a["lat"], b["lon"], b["lat"])))

    placed = geo.bind(geo.bind(F.struct(points.alias("points"), low.alias("low"), high.alias("high")), ends), lambda t: F.struct(geo.along(t["points"], t["first"]).alias("a"), geo.along(t["points"], t["last"]).alias("b")))
    return geo.bind(placed, bearing)


def direction(edge_angle: Column, wanted: Column, tolerance: float = 90.0) -> Column:
    """true where the edge leads in the wanted bearing within the tolerance, false where its reverse does, null for neither.

    The difference is wrapped to (-180, 180] before it is compared.
    """
    if not 0 < tolerance <= 90:
        raise ValueError("the tolerance must be over 0 and at most 90")
    off = F.abs(geo.normalize_signed(wanted - edge_angle))
    return F.when(off <= tolerance, True).when(off >= 180 - tolerance, False)


def forced_directions(queries: DataFrame, shaped_edges: DataFrame, *, tolerance: float = 90.0) -> DataFrame:
    """Routing queries with compass bearings (from_bearing, to_bearing, degrees; null: either way) as ones with from_forward and to_forward.

    ``error`` says where the edge leads in neither direction of a bearing.
    """
    lines = shaped_edges.select("edge_id", "points")
    out = queries
    for side in ("from", "to"):
        at = lines.select(F.col("edge_id").alias(f"{side}_edge"), F.col("points").alias("_points"))
        edge_angle = angle(F.col("_points"), F.col(f"{side}_offset"), geo.line_length(F.col("_points")))
        out = out.join(at, f"{side}_edge", "left").withColumn(f"{side}_forward", direction(edge_angle, F.col(f"{side}_bearing"), tolerance)).drop("_points")
    lost = lambda side: F.col(f"{side}_bearing").isNotNull() & F.col(f"{side}_forward").isNull()
    return out.withColumn("error", F.when(lost("from"), "no departure in that direction").when(lost("to"), "no arrival in that direction"))


def add_elevation(points: DataFrame, raster: DataFrame, *, step: float, estimate: float | None = None) -> DataFrame:
    """Points (lon, lat, other columns) with ``ele``: their own where they have one, else of their raster cell, else ``estimate``.

    ``raster``: cell_x, cell_y (floor of lon and lat over ``step``), ele; the first of repeated cells in order of value.
    """
    have = points if "ele" in points.columns else points.withColumn("ele", F.lit(None).cast("float"))
    cells = raster.groupBy("cell_x", "cell_y").agg(F.min("ele").alias("cell_ele"))
    at = have.withColumn("cell_x", F.floor(F.col("lon") / step)).withColumn("cell_y", F.floor(F.col("lat") / step))
    known = at.join(cells, ["cell_x", "cell_y"], "left")
    return known.withColumn("ele", F.coalesce("ele", F.col("cell_ele").cast("float"), F.lit(estimate).cast("float"))).select(*have.columns)
