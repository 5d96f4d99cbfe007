"""Changes make a new snapshot; ids of what stays never change."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.geo import line_length
from waymark.operators.graph import full_shape
from waymark.storage import Network

#: Edges that a table of turn costs may have: a fixed limit of the data model.
MOST_TURN_EDGES = 14


def add_vertices(network: Network, rows: DataFrame) -> Network:
    return replace(network, vertices=network.vertices.unionByName(rows, allowMissingColumns=True), version=network.version + 1)


def add_edges(network: Network, rows: DataFrame) -> Network:
    """Lengths that are missing are measured, in whole centimetres."""
    if "length_cm" not in rows.columns:
        rows = full_shape(rows, network.vertices).withColumn("length_cm", F.floor(line_length(F.col("points")) * 100).cast("long")).drop("points")
    return replace(network, edges=network.edges.unionByName(rows, allowMissingColumns=True), version=network.version + 1)


def _without_edges(turns: DataFrame, gone: DataFrame) -> DataFrame:
    """Turn costs that name none of the edges, not in their prefix either."""
    kept = turns.join(gone.withColumnRenamed("edge_id", "from_edge"), "from_edge", "left_anti").join(gone.withColumnRenamed("edge_id", "to_edge"), "to_edge", "left_anti").select(*turns.columns)
    if "prefix" not in turns.columns:
        return kept
    long = kept.where("size(prefix) > 0")
    behind = long.select("prefix", F.explode("prefix").alias("edge_id")).join(gone, "edge_id", "left_semi").select("prefix").distinct()
    return kept.where("coalesce(size(prefix), 0) <= 0").unionByName(long.join(behind, "prefix", "left_anti").select(*turns.columns))


def delete_edges(network: Network, ids: DataFrame) -> Network:
    """Edges go, and with them the turn costs that name them, as ends of the turn or before it."""
    gone = ids.select("edge_id").distinct()
    edges = network.edges.join(gone, "edge_id", "left_anti").select(*network.edges.columns)
    return replace(network, edges=edges, turn_costs=_without_edges(network.turn_costs, gone), version=network.version + 1)


def add_turn_costs(network: Network, tables: DataFrame) -> Network:
    """``tables``: vertex_id, attrs, edges array<long>, matrix array<array<long>>, prefix; zeros are no cost.  A table of more than 14 edges is an error."""
    if not tables.where(F.size("edges") > MOST_TURN_EDGES).isEmpty():
        raise ValueError(f"a table of turn costs has at most {MOST_TURN_EDGES} edges")
    cells = tables.select("vertex_id", "attrs", "prefix", "edges", F.posexplode("matrix").alias("i", "row")).select("*", F.posexplode("row").alias("j", "cost"))
    rows = cells.where("cost <> 0").select("vertex_id", F.expr("edges[i]").alias("from_edge"), F.expr("edges[j]").alias("to_edge"), "cost", "attrs", "prefix")
    return replace(network, turn_costs=network.turn_costs.unionByName(rows, allowMissingColumns=True), version=network.version + 1)


def replace_tiles(network: Network, vertices: DataFrame, edges: DataFrame) -> Network:
    """Everything in the tiles of the new rows (tile_id) gives way to them.

    Edges that start in such a tile go; one that only ends there stays if its head is among the new vertices.
    Turn costs at old vertices go, and those that name an edge that went.
    """
    tiles = vertices.select("tile_id").distinct()
    old = network.vertices.join(tiles, "tile_id", "left_semi").select("vertex_id")
    lost = old.join(vertices.select("vertex_id"), "vertex_id", "left_anti")
    stays = network.edges.join(old.withColumnRenamed("vertex_id", "tail"), "tail", "left_anti").join(lost.withColumnRenamed("vertex_id", "head"), "head", "left_anti").select(*network.edges.columns)
    gone = network.edges.select("edge_id").join(stays.select("edge_id"), "edge_id", "left_anti")
    turns = _without_edges(network.turn_costs.join(old, "vertex_id", "left_anti").select(*network.turn_costs.columns), gone)
    kept = network.vertices.join(tiles, "tile_id", "left_anti").select(*network.vertices.columns)
    return replace(network, vertices=kept.unionByName(vertices), edges=stays.unionByName(edges), turn_costs=turns, version=network.version + 1)


def clear(network: Network) -> Network:
    return Network(network.vertices.limit(0), network.edges.limit(0), network.turn_costs.limit(0), network.meta, network.version + 1)
