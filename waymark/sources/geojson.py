"""GeoJSON text of network parts: one feature a row, and a collection of features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_POINT = "struct<type:string,geometry:struct<type:string,coordinates:array<double>>,properties:map<string,string>>"


def _feature(kind: str, coordinates: Column, properties: Column) -> Column:
    geometry = F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")))


def point(lon: Column, lat: Column, properties: Column) -> Column:
    return _feature("Point", F.array(lon, lat), properties)


def line(points: Column, properties: Column) -> Column:
    return _feature("LineString", F.transform(points, lambda p: F.array(p["lon"], p["lat"])), properties)


def _over(own: Column, more: Column) -> Column:
    """Both maps; where they share a key, the second counts."""
    more = F.coalesce(more, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(F.coalesce(own, F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(more, k)), more)


def network_features(vertices: DataFrame, shaped_edges: DataFrame, factors: DataFrame | None = None, islands: DataFrame | None = None, preprocess: Callable[[Column], Column] | None = None) -> DataFrame:
    """A point for every vertex and a line for every edge, once each; ``factors``: edge_id, properties; ``preprocess``: attributes -> attributes."""
    v = vertices.dropDuplicates(["vertex_id"]).select(F.lit("vertex").alias("kind"), F.col("vertex_id").alias("id"), point(F.col("lon"), F.col("lat"), F.create_map(F.lit("_vertex_id"), F.col("vertex_id").cast("string"))).alias("feature"))
    e = shaped_edges.dropDuplicates(["edge_id"])
    own = _over(F.col("attrs") if preprocess is None else preprocess(F.col("attrs")), F.create_map(F.lit("_edge_id"), F.col("edge_id").cast("string")))
    if factors is not None:
        e = e.join(factors.select("edge_id", "properties"), "edge_id", "left")
        own = _over(own, F.col("properties"))
    if islands is not None:
        e = e.join(islands.select("edge_id", F.lit("true").alias("island")).distinct(), "edge_id", "left")
        own = _over(own, F.create_map(F.lit("_island"), F.coalesce("island", F.lit("false"))))
    return v.unionByName(e.select(F.lit("edge").alias("kind"), F.col("edge_id").alias("id"), line(F.col("points"), own).alias("feature")))


def turn_cost_features(turn_costs: DataFrame, vertices: DataFrame) -> DataFrame:
    """A point for every turn cost that is not zero."""
    at = turn_costs.where("cost <> 0").join(vertices.select("vertex_id", "lon", "lat"), "vertex_id")
    text = lambda c: F.col(c).cast("string")
    return at.select("vertex_id", point(F.col("lon"), F.col("lat"), F.create_map(F.lit("from_edge"), text("from_edge"), F.lit("to_edge"), text("to_edge"), F.lit("cost"), text("cost"))).alias("feature"))


def tile_features(tables: dict[str, DataFrame]) -> DataFrame:
    """Features of tiles that stand alone (``osm.tile_tables``): vertices, edges that have both ends there, and turn costs; tile, kind, id, feature."""
    from waymark.operators.graph import full_shape

    v, e = tables["vertices"], full_shape(tables["edges"], tables["vertices"])
    tiles = v.select("tile", F.lit("vertex").alias("kind"), F.col("vertex_id").alias("id")).unionByName(e.select("tile", F.lit("edge").alias("kind"), F.col("edge_id").alias("id")))
    turns = turn_cost_features(tables["turns"], v).join(v.select("vertex_id", "tile"), "vertex_id")
    return tiles.join(network_features(v, e), ["kind", "id"]).select("tile", "kind", "id", "feature").unionByName(turns.select("tile", F.lit("turn").alias("kind"), F.col("vertex_id").alias("id"), "feature"))


def collection(features: DataFrame, by: str, column: str = "feature") -> DataFrame:
    """One FeatureCollection text for each value of ``by``; meant for boxes, tiles and routes, whose size is bounded."""
    text = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.array_sort(F.collect_list(column)), ","), F.lit("]}")).alias("geojson")
    return features.groupBy(by).agg(text)


def write_features(features: DataFrame, path: str, column: str = "feature") -> None:
    """A feature a line, in as many files as there are partitions: for networks of any size."""
    features.select(column).write.mode("errorifexists").text(path)


def route_features(routes: DataFrame) -> DataFrame:
    """A line for every route (query_id, shape): query_id, feature; no properties."""
    return routes.select("query_id", line(F.col("shape"), F.create_map().cast("map<string,string>")).alias("feature"))


def place_features(places: DataFrame, shaped_edges: DataFrame) -> DataFrame:
    """A point for every place (query_id, edge_id, offset) on its edge (edge_id, points): query_id, feature."""
    from waymark.operators.places import location

    j = places.select("query_id", "edge_id", "offset").join(shaped_edges.select("edge_id", "points"), "edge_id")
    at = location(F.col("points"), F.col("offset"))
    properties = F.create_map(F.lit("edge_id"), F.col("edge_id").cast("string"), F.lit("offset"), F.col("offset").cast("string"))
    return j.withColumn("at", at).select("query_id", point(F.col("at.lon"), F.col("at.lat"), properties).alias("feature"))


def box_features(vertices: DataFrame, shaped_edges: DataFrame, boxes: DataFrame) -> DataFrame:
    """Features of the vertices in each box (query_id, box) and of the edges that end there: query_id, kind, id, feature."""
    from waymark.operators.graph import edges_in_boxes, vertices_in_boxes

    found = vertices_in_boxes(vertices, boxes).select("query_id", F.lit("vertex").alias("kind"), F.col("vertex_id").alias("id")).unionByName(edges_in_boxes(vertices, shaped_edges, boxes).select("query_id", F.lit("edge").alias("kind"), F.col("edge_id").alias("id")))
    return found.join(network_features(vertices, shaped_edges), ["kind", "id"]).select("query_id", "kind", "id", "feature")


def wkt_line(points: Column) -> Column:
    """A line as well-known text; null for fewer than two points."""
    pairs = F.array_join(F.transform(points, lambda p: F.concat_ws(" ", p["lon"].cast("string"), p["lat"].cast("string"))), ", ")
    return F.when(F.size(points) > 1, F.concat(F.lit("LINESTRING ("), pairs, F.lit(")")))


def table_attributes(table: Column) -> Column:
    """Attributes of a feature's properties: names and texts of values, without those that are null."""
    return F.map_filter(F.transform_values(table, lambda _, v: v.cast("string")), lambda _, v: v.isNotNull())
