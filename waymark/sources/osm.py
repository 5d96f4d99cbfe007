"""Street networks from OpenStreetMap tables.

``nodes(id, lon, lat, tags)``, ``ways(id, nodes array<long>, tags)`` and
``relations(id, members array<struct<type,id,role>>, tags)`` come from Parquet or JSON;
reading the binary exchange format is left to other tools.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions.geo import box_around, line_length, tile_id, tile_range
from waymark.storage import Network, materialize

# Fixed values of turn restrictions: those that forbid, those that oblige, and vehicles.
PROHIBITORY = ("no_left_turn", "no_right_turn", "no_straight_on", "no_u_turn", "no_entry", "no_exit")
MANDATORY = ("only_right_turn", "only_left_turn", "only_straight_on")
VEHICLES = ("motor_vehicle", "foot", "dog", "bicycle", "motorcar", "hgv", "psv", "emergency")


def routable(tags: Column) -> Column:
    """Ways with any highway, and ferry routes."""
    return F.coalesce(tags["highway"].isNotNull() | (tags["route"] == "ferry"), F.lit(False))


@dataclass(frozen=True)
class TagsFilter:
    """What an import takes of ways, and how relations mark their members.

    ``keep``: tags -> boolean.  ``complete``: tags and points (lon, lat) -> boolean, for decisions that need the whole
    way.  ``members``: marks that relations put on their member ways.
    """

    keep: Callable[[Column], Column] = routable
    complete: Callable[[Column, Column], Column] | None = None
    members: tuple[MemberMark, ...] = ()


@dataclass(frozen=True)
class MemberMark:
    """Member ways of the relations that ``of`` selects by their tags get the tag ``key`` (of the relation's tags) with ``value``."""

    of: Callable[[Column], Column]
    key: Callable[[Column], Column]
    value: str = "yes"

    def apply(self, ways: DataFrame, relations: DataFrame) -> DataFrame:
        named = relations.where(F.coalesce(self.of(F.col("tags")), F.lit(False)))
        members = named.select(self.key(F.col("tags")).alias("k"), F.explode("members").alias("m")).where("m.type = 'way' and k is not null")
        marks = members.groupBy(F.col("m.id").alias("id")).agg(F.array_sort(F.collect_set("k")).alias("ks"))
        extra = F.map_from_arrays("ks", F.transform("ks", lambda _: F.lit(self.value)))
        base = F.map_filter("tags", lambda k, _: ~F.array_contains("ks", k))
        return ways.join(marks, "id", "left").withColumn("tags", F.when(F.col("ks").isNotNull(), F.map_concat(base, extra)).otherwise(F.col("tags"))).drop("ks")


#: Members of bicycle routes get ``_cycle_network:network:<n>`` = ``"yes   "`` (the blanks belong to the value).
CYCLE_NETWORKS = MemberMark(
    lambda tags: (tags["type"] == "route") & (tags["route"] == "bicycle") & tags["network"].isNotNull(), lambda tags: F.concat(F.lit("_cycle_network:network:"), tags["network"]), "yes   "
)


def cycle_networks(ways: DataFrame, relations: DataFrame) -> DataFrame:
    return CYCLE_NETWORKS.apply(ways, relations)


def with_coordinates(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ways with ``points``, for filters that look at whole objects; missing nodes leave gaps out."""
    at = ways.select("id", F.posexplode("nodes").alias("k", "node")).join(nodes.select(F.col("id").alias("node"), "lon", "lat"), "node")
    points = at.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "lon", "lat"))), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("points"))
    return ways.join(points, "id", "left")


def segments(ways: DataFrame) -> DataFrame:
    """Ways cut at core nodes (ends, and nodes used more than once): way, first and last index, tail, head, inner nodes."""
    at = ways.select("id", "tags", F.size("nodes").alias("n"), F.posexplode("nodes").alias("k", "node")).where("n > 1")
    used = at.groupBy("node").agg(F.count("*").alias("uses"))
    core = at.join(used, "node").withColumn("core", (F.col("uses") > 1) | (F.col("k") == 0) | (F.col("k") == F.col("n") - 1))
    order = Window.partitionBy("id").orderBy("k")
    # A core node ends one segment and begins the next.
    numbered = core.withColumn("after", F.sum(F.col("core").cast("int")).over(order))
    ends = numbered.where((F.col("core")) & (F.col("k") > 0)).withColumn("after", F.col("after") - 1)
    begins = numbered.where((F.col("k") < F.col("n") - 1) | ~F.col("core"))
    parts = begins.unionByName(ends).groupBy("id", "after").agg(F.array_sort(F.collect_list(F.struct("k", "node"))).alias("ns"), F.first("tags").alias("tags"))
    ns = F.col("ns")
    return parts.select(
        F.col("id").alias("way"),
        ns[0]["k"].alias("first_k"),
        F.element_at(ns, -1)["k"].alias("last_k"),
        ns[0]["node"].alias("tail_node"),
        F.element_at(ns, -1)["node"].alias("head_node"),
        F.transform(F.slice(ns, F.lit(2), F.greatest(F.size(ns) - 2, F.lit(0))), lambda p: p["node"]).alias("inner"),
        "tags",
    )


def import_network(
    nodes: DataFrame,
    ways: DataFrame,
    relations: DataFrame | None = None,
    *,
    filters: TagsFilter = TagsFilter(members=(CYCLE_NETWORKS,)),  # noqa: B008
    zoom: int = 14,
    strict: bool = False,
) -> Network:
    """Vertices at core nodes (their ids are the node ids), edges between them, and restrictions and barriers as turn costs.

    Edge ids are hashes of (way, first node index, last node index): the same in every import.
    Segments that end at a node that is not there have no place and are left out, as at the edge of an extract: :func:`missing_ends`
    lists them, and with ``strict`` they are an error.
    """
    kept = ways
    for mark in filters.members if relations is not None else ():
        kept = mark.apply(kept, relations)
    kept = kept.where(filters.keep(F.col("tags")))
    if filters.complete is not None:
        kept = with_coordinates(kept, nodes).where(F.coalesce(filters.complete(F.col("tags"), F.col("points")), F.lit(False))).drop("points")
    parts = segments(kept)
    at = nodes.select("id", "lon", "lat")
    if strict and not missing_ends(nodes, kept).isEmpty():
        raise ValueError("ways end at nodes that are not there")
    inner = parts.select("way", "first_k", F.posexplode("inner").alias("k", "node")).join(at.withColumnRenamed("id", "node"), "node")
    shapes = inner.groupBy("way", "first_k").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "lon", "lat"))), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("shape"))
    end = lambda name: at.select(F.col("id").alias(f"{name}_node"), F.struct("lon", "lat").alias(f"{name}_at"))
    joined = parts.join(shapes, ["way", "first_k"], "left").join(end("tail"), "tail_node").join(end("head"), "head_node")
    shape = F.coalesce("shape", F.array().cast("array<struct<lon:double,lat:double>>"))
    edges = joined.select(
        F.shiftright(F.xxhash64("way", "first_k", "last_k"), 2).alias("edge_id"),
        F.col("tail_node").alias("tail"),
        F.col("head_node").alias("head"),
        shape.alias("shape"),
        F.col("tags").alias("attrs"),
        F.floor(line_length(F.concat(F.array("tail_at"), shape, F.array("head_at"))) * 100).cast("long").alias("length_cm"),
        "way",
        "first_k",
        "last_k",
    )
    # Vertices, barriers and restrictions all read the edges: they are found once.
    edges = materialize(edges, "import-edges")
    vertices = edges.select(F.explode(F.array("tail", "head")).alias("id")).distinct().join(at, "id").select(F.col("id").alias("vertex_id"), "lon", "lat", tile_id(F.col("lon"), F.col("lat"), zoom).alias("tile_id"))
    costs = barriers(nodes, edges)
    if relations is not None:
        costs = costs.unionByName(restrictions(relations, edges))
    return Network(vertices, edges, costs)


def missing_ends(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """(way, node) of segments that end at a node that is not among ``nodes``."""
    ends = segments(ways).select("way", F.explode(F.array("tail_node", "head_node")).alias("node")).distinct()
    return ends.join(nodes.select(F.col("id").alias("node")), "node", "left_anti").select("way", "node")


def restriction_kind(tags: Column) -> Column:
    """true: forbids the turn, false: forbids all others, null: not a restriction."""
    value = F.coalesce(tags["restriction"], *[tags[f"restriction:{v}"] for v in VEHICLES])
    return F.when(tags["type"] == "restriction", F.when(value.isin(*PROHIBITORY), True).when(value.isin(*MANDATORY), False))


def trimmed(tags: Column) -> Column:
    """The attributes of a restriction that matter to profiles."""
    return F.map_filter(tags, lambda k, _: k.isin("type", "restriction", "except", *VEHICLES) | k.startswith("restriction:"))


def _runs(edges: DataFrame, ways: DataFrame) -> DataFrame:
    """Stretches of edges of the ways, in either direction: via_way, a, b (where they begin and end), run (edges in order)."""
    chain = edges.join(ways, "way", "left_semi").groupBy("way").agg(F.array_sort(F.collect_list(F.struct(*([F.col("first_k")] if "first_k" in edges.columns else [F.col("edge_id").alias("first_k")]), "edge_id", "tail", "head"))).alias("es"))
    each = chain.select("way", "es", F.explode(F.sequence(F.lit(1), F.size("es"))).alias("i")).select("way", "es", "i", F.explode(F.sequence(F.col("i"), F.size("es"))).alias("j"))
    part = each.select(F.col("way").alias("via_way"), F.slice("es", F.col("i"), F.col("j") - F.col("i") + 1).alias("p"))
    # Each edge begins where the one before ends, unless parts of the way are not there.
    part = part.where(F.forall(F.sequence(F.lit(1), F.size("p")), lambda k: (k == 1) | (F.element_at("p", k)["tail"] == F.element_at("p", F.greatest(k - 1, F.lit(1)))["head"])))
    ids = F.transform("p", lambda e: e["edge_id"])
    first, last = F.col("p")[0]["tail"], F.element_at("p", -1)["head"]
    both = F.array(F.struct(first.alias("a"), last.alias("b"), ids.alias("run")), F.struct(last.alias("a"), first.alias("b"), F.reverse(ids).alias("run")))
    return part.select("via_way", F.explode(both).alias("s")).select("via_way", "s.a", "s.b", "s.run")


def restrictions(relations: DataFrame, edges: DataFrame) -> DataFrame:
    """Turn costs of restrictions that go from a way over a node (or over ways) to a way.

    The edges of the from and to ways are those at the via; mandatory restrictions forbid
    every exit but the named one and the way back.  Over via ways, in the order of the members,
    the turn from the last via edge is forbidden and the edges before it are the ``prefix``.
    Each from way counts, and each to way of those that forbid; a via way that was cut into
    several edges is passed over all of them between its neighbours.
    """
    r = relations.withColumn("forbids", restriction_kind(F.col("tags"))).where("forbids is not null")
    member = lambda kind, role: F.filter("members", lambda m: (m["type"] == kind) & (m["role"] == role))
    ids = lambda kind, role: F.transform(member(kind, role), lambda m: m["id"])
    r = r.select("id", "forbids", trimmed(F.col("tags")).alias("attrs"), F.explode(ids("way", "from")).alias("from_way"), F.when(F.col("forbids"), ids("way", "to")).otherwise(F.slice(ids("way", "to"), 1, 1)).alias("to_ways"), F.get(ids("node", "via"), F.lit(0)).alias("via_node"), ids("way", "via").alias("vias"))
    r = r.withColumn("to_way", F.explode("to_ways")).drop("to_ways")
    ends = edges.select("way", "edge_id", F.explode(F.array("tail", "head")).alias("vertex_id")).distinct()
    side = lambda name: ends.select(F.col("way").alias(f"{name}_way"), F.col("edge_id").alias(f"{name}_edge"), F.col("vertex_id").alias(f"{name}_v"))
    node = r.where("via_node is not null").join(side("from"), "from_way").where("from_v = via_node").join(side("to"), "to_way").where("to_v = via_node")
    node = node.select("id", "forbids", "attrs", F.col("via_node").alias("vertex_id"), "from_edge", "to_edge", F.array().cast("array<long>").alias("prefix"))
    way = r.where("via_node is null and size(vias) > 0").join(side("from"), "from_way").withColumn("prefix", F.array().cast("array<long>"))
    over = _runs(edges, r.select(F.explode("vias").alias("way")).distinct())
    # One join for each via way in its order; shorter chains wait.
    for k in range(way.agg(F.max(F.size("vias"))).first()[0] or 0):
        more = way.where(F.size("vias") > k).withColumn("via_way", F.get("vias", F.lit(k))).join(over, "via_way").where("a = from_v and run[0] <> from_edge")
        behind = F.concat("prefix", F.array("from_edge"), F.slice("run", F.lit(1), F.size("run") - 1))
        more = more.withColumn("prefix", behind).withColumn("from_edge", F.element_at("run", -1)).withColumn("from_v", F.col("b")).select(*way.columns)
        way = way.where(F.size("vias") <= k).unionByName(more)
    way = way.join(side("to"), "to_way").where("to_v = from_v and to_edge <> from_edge")
    way = way.select("id", "forbids", "attrs", F.col("to_v").alias("vertex_id"), "from_edge", "to_edge", "prefix")
    found = node.unionByName(way)
    barred = found.where("forbids").select("vertex_id", "from_edge", "to_edge", "attrs", "prefix")
    others = ends.select("vertex_id", F.col("edge_id").alias("exit"))
    obliged = found.where("not forbids").join(others, "vertex_id").where("exit <> to_edge and exit <> from_edge").select("vertex_id", "from_edge", F.col("exit").alias("to_edge"), "attrs", "prefix")
    return barred.unionByName(obliged).select("vertex_id", "from_edge", "to_edge", F.lit(1).cast("long").alias("cost"), "attrs", "prefix")


def barriers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Turn costs between all pairs of edges at a node with a barrier."""
    marked = nodes.where(F.col("tags")["barrier"].isNotNull()).select(F.col("id").alias("vertex_id"), F.map_filter("tags", lambda k, _: k.isin("barrier", *VEHICLES)).alias("attrs"))
    ends = edges.select("edge_id", F.explode(F.array("tail", "head")).alias("vertex_id")).distinct()
    a = marked.join(ends.withColumnRenamed("edge_id", "from_edge"), "vertex_id")
    pairs = a.join(ends.withColumnRenamed("edge_id", "to_edge"), "vertex_id").where("from_edge <> to_edge")
    return pairs.select("vertex_id", "from_edge", "to_edge", F.lit(1).cast("long").alias("cost"), "attrs", F.array().cast("array<long>").alias("prefix"))


def global_id(way: Column, first: Column, last: Column) -> Column:
    """An edge's id in all imports: its way and its first and last node there, as text."""
    return F.concat_ws(":", way.cast("string"), first.cast("string"), last.cast("string"))


def global_parts(text: Column) -> Column:
    """(way, first_k, last_k) of such an id; null if it is none."""
    part = lambda k: F.regexp_extract(text, r"^(\d+):(\d+):(\d+)$", k).cast("long")
    return F.when(text.rlike(r"^\d+:\d+:\d+$"), F.struct(part(1).alias("way"), part(2).cast("int").alias("first_k"), part(3).cast("int").alias("last_k")))


def edges_of_global(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of ``asked`` (global_id, ...) with the edge_id of that edge, null if it is not there."""
    known = edges.select(global_id(F.col("way"), F.col("first_k"), F.col("last_k")).alias("global_id"), "edge_id")
    return asked.join(known, "global_id", "left")


# Standalone tiles.


def split_tile(network: Network, zoom: int = 14) -> tuple[DataFrame, DataFrame]:
    """(edges inside one tile, boundary crossings): a crossing appears in both tiles, with the other end's id."""
    tile = network.vertices.select("vertex_id", tile_id(F.col("lon"), F.col("lat"), zoom).alias("tile"))
    e = network.edges.join(tile.select(F.col("vertex_id").alias("tail"), F.col("tile").alias("tail_tile")), "tail").join(tile.select(F.col("vertex_id").alias("head"), F.col("tile").alias("head_tile")), "head")
    inside = e.where("tail_tile = head_tile").withColumnRenamed("tail_tile", "tile").drop("head_tile")
    cross = e.where("tail_tile <> head_tile")
    halves = cross.select("*", F.explode(F.array("tail_tile", "head_tile")).alias("tile")).drop("tail_tile", "head_tile")
    return inside, halves


def tile_tables(network: Network, zoom: int = 14) -> dict[str, DataFrame]:
    """A network cut into tiles that stand alone: vertices, edges inside a tile, crossings (in both tiles) and turn costs, each with ``tile``.

    Edges of an import have their global ids with them, by which crossings and restrictions of different tiles find each other.
    """
    tiled = network.vertices.withColumn("tile", tile_id(F.col("lon"), F.col("lat"), zoom))
    edges = network.edges
    if {"way", "first_k", "last_k"} <= set(edges.columns):
        edges = edges.withColumn("global_id", global_id(F.col("way"), F.col("first_k"), F.col("last_k")))
    inside, halves = split_tile(replace(network, edges=edges), zoom)
    turns = network.turn_costs.join(tiled.select("vertex_id", "tile"), "vertex_id")
    return {"vertices": tiled, "edges": inside, "crossings": halves, "turns": turns}


def write_tiles(network: Network, path: str, zoom: int = 14) -> None:
    """The tables of :func:`tile_tables`, each in the order of tiles, so that a reader of some tiles skips the rest by Parquet's statistics."""
    for name, table in tile_tables(network, zoom).items():
        table.repartitionByRange("tile").sortWithinPartitions("tile").write.mode("errorifexists").parquet(f"{path}/{name}")


def read_tiles(spark: SparkSession, path: str, low: int, high: int) -> dict[str, DataFrame]:
    """Tables of the tiles from ``low`` to ``high``; the bounds reach the scan."""
    return {name: spark.read.parquet(f"{path}/{name}").where(F.col("tile").between(low, high)) for name in ("vertices", "edges", "crossings", "turns")}


def tiles_around(places: DataFrame, metres: float, zoom: int = 14) -> DataFrame:
    """Tiles (tile) that a search within ``metres`` of the places (lon, lat) may need: what a loader on demand reads."""
    return places.select(F.explode(tile_range(box_around(F.col("lon"), F.col("lat"), F.lit(metres)), zoom)).alias("tile")).distinct()


def merge_tiles(inside: DataFrame, halves: DataFrame) -> DataFrame:
    """Edges of all loaded tiles: inner ones, and crossings whose two halves are there, once each."""
    both = halves.groupBy("edge_id").agg(F.count_distinct("tile").alias("sides")).where("sides = 2").select("edge_id")
    whole = halves.join(both, "edge_id", "left_semi").dropDuplicates(["edge_id"])
    return inside.drop("tile").unionByName(whole.drop("tile"))


# Routable tiles in JSON-LD.

_GRAPH = "array<map<string,string>>"


def read_routable_tile(text: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(nodes, ways) of tiles given as one JSON text a row."""
    item = F.explode(F.from_json(F.get_json_object(column, "$.@graph"), _GRAPH)).alias("g")
    g = text.select(item)
    number = lambda c: F.regexp_extract(c, r"(\d+)$", 1).cast("long")
    tags = F.map_filter("g", lambda k, _: ~k.startswith("@") & ~k.isin("geo:lat", "geo:long", "osm:hasNodes", "osm:hasMembers"))
    tags = F.transform_keys(tags, lambda k, _: F.regexp_replace(k, "^osm:", ""))
    nodes = g.where(F.col("g")["@type"] == "osm:Node").select(number(F.col("g")["@id"]).alias("id"), F.col("g")["geo:long"].cast("double").alias("lon"), F.col("g")["geo:lat"].cast("double").alias("lat"), tags.alias("tags"))
    refs = F.transform(F.from_json(F.col("g")["osm:hasNodes"], "array<string>"), number)
    ways = g.where(F.col("g")["@type"] == "osm:Way").select(number(F.col("g")["@id"]).alias("id"), refs.alias("nodes"), tags.alias("tags"))
    return nodes, ways


def map_tags(objects: DataFrame, mapping: DataFrame) -> DataFrame:
    """Tags renamed by an ontology table (uri, key, value_uri, value): keys and, where listed, values."""
    flat = objects.select("id", F.explode("tags").alias("uri", "v"))
    named = flat.join(mapping.select("uri", "key").distinct(), "uri", "left").join(mapping.select("uri", F.col("value_uri").alias("v"), "value").where("v is not null"), ["uri", "v"], "left")
    # Two uris may stand for one key: the least value counts.
    one = named.groupBy("id", F.coalesce("key", "uri").alias("k")).agg(F.min(F.coalesce("value", "v")).alias("x"))
    tags = one.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "x")))).alias("tags"))
    return objects.drop("tags").join(tags, "id", "left")


def read_tables(spark: SparkSession, path: str, kind: str = "parquet") -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.format(kind).load(f"{path}/{name}") for name in ("nodes", "ways", "relations"))
