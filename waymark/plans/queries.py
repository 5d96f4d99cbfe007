"""Questions over a grid of streets derived from the customer table, and SQL for the same rows.

Vertex c_custkey lies at column ``% 25`` and row ``div 25`` of a grid; an edge leads to the
right and one up, and carries the customer's market segment as its kind of street.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import attributes, geo
from waymark.operators import graph, places, routing
from waymark.operators.tiled import tiled_tree
from waymark.operators.profiles import BICYCLE, CAR, CAR_SHORT, PEDESTRIAN, edge_factors
from waymark.sources import osm
from waymark.storage import Network

KINDS = {"AUTOMOBILE": "motorway", "BUILDING": "primary", "FURNITURE": "secondary", "HOUSEHOLD": "residential", "MACHINERY": "living_street"}


def grid(spark: SparkSession, sf_dir: str) -> Network:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment")
    gx, gy = F.col("c_custkey") % 25, F.floor(F.col("c_custkey") / 25)
    v = c.select(F.col("c_custkey").alias("vertex_id"), gx.alias("gx"), gy.alias("gy"), (F.lit(4.70) + gx * F.lit(0.002)).alias("lon"), (F.lit(51.20) + gy * F.lit(0.0012)).alias("lat"))
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.col("c_mktsegment")]
    attrs = F.create_map(F.lit("highway"), kind)
    keys = c.select(F.col("c_custkey").alias("head"))
    right = c.where(gx < 24).select((F.col("c_custkey") * 2).alias("edge_id"), F.col("c_custkey").alias("tail"), (F.col("c_custkey") + 1).alias("head"), attrs.alias("attrs"))
    up = c.select((F.col("c_custkey") * 2 + 1).alias("edge_id"), F.col("c_custkey").alias("tail"), (F.col("c_custkey") + 25).alias("head"), attrs.alias("attrs"))
    shape = F.array().cast("array<struct<lon:double,lat:double>>")
    edges = right.unionByName(up).join(keys, "head", "left_semi").select("edge_id", "tail", "head", shape.alias("shape"), "attrs", F.lit(100).cast("long").alias("length_cm"))
    turns = spark.createDataFrame([], "vertex_id long, from_edge long, to_edge long, cost long, attrs map<string,string>, prefix array<long>")
    return Network(v, edges, turns)


_GRID = """
WITH RECURSIVE v AS (SELECT c_custkey AS vertex_id, c_custkey % 25 AS gx, c_custkey // 25 AS gy, 4.70::DOUBLE + (c_custkey % 25) * 0.002::DOUBLE AS lon, 51.20::DOUBLE + (c_custkey // 25) * 0.0012::DOUBLE AS lat,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'motorway' WHEN 'BUILDING' THEN 'primary' WHEN 'FURNITURE' THEN 'secondary' WHEN 'HOUSEHOLD' THEN 'residential' WHEN 'MACHINERY' THEN 'living_street' END AS kind FROM customer),
e AS (SELECT a.vertex_id * 2 AS edge_id, a.vertex_id AS tail, b.vertex_id AS head, a.kind FROM v a JOIN v b ON b.vertex_id = a.vertex_id + 1 AND a.gx < 24
  UNION ALL SELECT a.vertex_id * 2 + 1, a.vertex_id, b.vertex_id, a.kind FROM v a JOIN v b ON b.vertex_id = a.vertex_id + 25),
arc AS (SELECT edge_id * 2 AS arc_id, edge_id, tail AS from_v, head AS to_v, kind FROM e UNION ALL SELECT edge_id * 2 + 1, edge_id, head, tail, kind FROM e),
d AS (SELECT *, 100 * CASE kind WHEN 'motorway' THEN 30 WHEN 'primary' THEN 40 WHEN 'secondary' THEN 51 WHEN 'residential' THEN 72 ELSE 240 END AS cost FROM arc)
"""


def vertex_scan(spark, sf_dir):
    return grid(spark, sf_dir).vertices.select("vertex_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), geo.tile_id(F.col("lon"), F.col("lat")).alias("tile_id"))


def edge_scan(spark, sf_dir):
    return grid(spark, sf_dir).edges.select("edge_id", "tail", "head", F.col("attrs")["highway"].alias("highway"))


def adjacency(spark, sf_dir):
    return graph.arcs(grid(spark, sf_dir).edges).select("arc_id", "edge_id", "forward", "from_v", "to_v")


def edge_geometry(spark, sf_dir):
    n = grid(spark, sf_dir)
    e = graph.full_shape(n.edges, n.vertices)
    p, q = F.col("points")[0], F.col("points")[1]
    return e.select("edge_id", F.round(geo.line_length(F.col("points")), 4).alias("metres"), F.round(geo.bearing(p["lon"], p["lat"], q["lon"], q["lat"]), 4).alias("bearing"), geo.compass(p["lon"], p["lat"], q["lon"], q["lat"]).alias("compass"))


def cost_arcs(spark, sf_dir):
    return graph.cost_arcs(grid(spark, sf_dir).edges, CAR).select("arc_id", "from_v", "to_v", "cost")


def profile_factors(spark, sf_dir):
    types = grid(spark, sf_dir).edges.select(F.col("attrs")["highway"].alias("highway"), "attrs").dropDuplicates(["highway"]).withColumn("type_id", F.col("highway"))
    return edge_factors(types, CAR, CAR_SHORT, BICYCLE, PEDESTRIAN).select("profile", F.col("type_id").alias("highway"), "fwd_factor", "bwd_factor", "fwd_speed", "can_stop")


def edge_types(spark, sf_dir):
    e = grid(spark, sf_dir).edges
    types = attributes.dictionary(e)
    return e.withColumn("text", F.to_json(attributes.canonical(F.col("attrs")))).join(F.broadcast(types) if types.count() < 100_000 else types, "text").groupBy("type_id").agg(F.count("*").alias("n_edges"))


def turn_pairs(spark, sf_dir):
    return graph.transitions(_one_way_arcs(grid(spark, sf_dir)), _barred(grid(spark, sf_dir))).select("a", "b")


def least_cost_tree(spark, sf_dir):
    arcs = graph.cost_arcs(grid(spark, sf_dir).edges, CAR)
    return routing.vertex_costs(arcs, spark.createDataFrame([(0,)], "source long")).select("vertex_id", "cost")


def cost_matrix(spark, sf_dir):
    """Costs to every vertex from the vertices whose id is divisible by 100."""
    n = grid(spark, sf_dir)
    sources = n.vertices.where("vertex_id % 100 = 0").select(F.col("vertex_id").alias("source"))
    return routing.vertex_costs(graph.cost_arcs(n.edges, CAR), sources).select("source", "vertex_id", "cost")


def _one_way_arcs(n: Network) -> DataFrame:
    return graph.cost_arcs(n.edges, CAR).where("forward or edge_id % 5 <> 0")


def _barred(n: Network) -> DataFrame:
    """No turn from a right edge into an up edge at vertices of which 3 is left over 7."""
    r = n.edges.where("edge_id % 2 = 0 and head % 7 = 3").select(F.col("head").alias("vertex_id"), F.col("edge_id").alias("from_edge"))
    u = n.edges.where("edge_id % 2 = 1").select(F.col("tail").alias("vertex_id"), F.col("edge_id").alias("to_edge"))
    return r.join(u, "vertex_id").select("vertex_id", "from_edge", "to_edge")


def directed_tree(spark, sf_dir):
    n = grid(spark, sf_dir)
    return routing.arc_tree(_one_way_arcs(n), spark.createDataFrame([(0,)], "source long"), _barred(n)).select("arc_id", "cost")


def _sequences(n: Network) -> DataFrame:
    """After two right edges no turn up at vertices of which 3 is left over 7."""
    r = n.edges.where("edge_id % 2 = 0").select("tail", "head", "edge_id")
    first, second = r.select(F.col("head").alias("m"), F.col("edge_id").alias("p")), r.select(F.col("tail").alias("m"), F.col("head").alias("vertex_id"), F.col("edge_id").alias("from_edge"))
    u = n.edges.where("edge_id % 2 = 1").select(F.col("tail").alias("vertex_id"), F.col("edge_id").alias("to_edge"))
    return second.join(first, "m").join(u, "vertex_id").where("vertex_id % 7 = 3").select("vertex_id", "from_edge", "to_edge", F.array("p").alias("prefix"))


def sequence_tree(spark, sf_dir):
    """Least costs where a turn is forbidden only after a certain edge."""
    n = grid(spark, sf_dir)
    return routing.arc_tree(graph.cost_arcs(n.edges, CAR), spark.createDataFrame([(0,)], "source long"), _sequences(n)).select("arc_id", "cost")


def _boxes(spark, sf_dir) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("query_id"), (F.lit(4.7003) + (F.col("s_suppkey") % 20) * 0.002).alias("lon"), (F.lit(51.2004) + (F.col("s_suppkey") % 6) * 0.0012).alias("lat"))
    return s.select("query_id", F.struct((F.col("lon") - 0.0035).alias("left"), (F.col("lat") - 0.002).alias("bottom"), (F.col("lon") + 0.0035).alias("right"), (F.col("lat") + 0.002).alias("top")).alias("box"))


def box_search(spark, sf_dir):
    n = grid(spark, sf_dir)
    return graph.edges_in_boxes(n.vertices, n.edges, _boxes(spark, sf_dir))


def box_vertices(spark, sf_dir):
    return graph.vertices_in_boxes(grid(spark, sf_dir).vertices, _boxes(spark, sf_dir)).select("query_id", "vertex_id")


def box_tiles(spark, sf_dir):
    boxes = _boxes(spark, sf_dir)
    middle = geo.center(F.col("box"))
    return boxes.select("query_id", F.explode(geo.tile_range(F.col("box"))).alias("tile_id"), geo.tile_id(middle["lon"], middle["lat"]).alias("middle_tile"))


def _points(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("query_id"), (F.lit(4.7001) + (F.col("user_id") % 23) * 0.00207).alias("lon"), (F.lit(51.2001) + (F.col("event_id") % 5) * 0.00117).alias("lat"))


def snap_vertices(spark, sf_dir):
    n = grid(spark, sf_dir)
    return graph.snap_to_vertex(_points(spark, sf_dir), n.vertices).select("query_id", "vertex_id", F.round("distance_m", 3).alias("distance_m"))


def snap_all_vertices(spark, sf_dir):
    n = grid(spark, sf_dir)
    return graph.snap_to_vertex(_points(spark, sf_dir), n.vertices, everything=True).select("query_id", "vertex_id", F.round("distance_m", 3).alias("distance_m"))


def vertex_places(spark, sf_dir):
    """Places from which a bicycle may leave each vertex."""
    n = grid(spark, sf_dir)
    return places.from_vertices(n.vertices.select(F.col("vertex_id").alias("query_id"), "vertex_id"), n.edges, BICYCLE)


def edge_places(spark, sf_dir):
    """Places that the events name, some on edges that do not exist or that a bicycle may not use."""
    asked = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("query_id"), (F.col("user_id") * 3).alias("edge_id"), (F.col("event_id") % 65536).cast("int").alias("offset"), (F.col("event_id") % 2 == 0).alias("forward"))
    return places.from_edges(asked, grid(spark, sf_dir).edges, BICYCLE)


def attribute_edits(spark, sf_dir):
    """Keys put, removed and kept, and sets compared."""
    attrs = F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"), F.lit("note"), F.lit("x"))
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", attrs.alias("attrs"))
    changed = attributes.put(F.col("attrs"), "name", F.lit("none"))
    text = lambda m: F.to_json(attributes.canonical(m))
    return c.select(
        F.col("c_custkey").alias("id"), text(attributes.remove(changed, "note")).alias("removed"), F.to_json(attributes.keep(changed, ["segment"])).alias("kept"), attributes.same(F.col("attrs"), changed).alias("same"), attributes.same(F.col("attrs"), changed, "name").alias("same_but_name")
    )


def imported_edges(spark, sf_dir):
    """Import of one way for every row and column of the grid: cut where they cross, tags and lengths kept."""
    v = grid(spark, sf_dir).vertices.select("vertex_id", F.pmod("vertex_id", F.lit(25)).alias("gx"), F.floor(F.col("vertex_id") / 25).alias("gy"), "lon", "lat")
    nodes = v.select(F.col("vertex_id").alias("id"), "lon", "lat", F.create_map().cast("map<string,string>").alias("tags"))
    way = lambda key, kind, first: v.groupBy(F.col(key).alias("k")).agg(F.array_sort(F.collect_list("vertex_id")).alias("nodes")).select((F.col("k") + first).alias("id"), "nodes", F.create_map(F.lit("highway"), F.lit(kind)).alias("tags"))
    ways = way("gx", "residential", 0).unionByName(way("gy", "primary", 1000)).where(F.size("nodes") > 1)
    edges = osm.import_network(nodes, ways).edges
    return edges.select("tail", "head", "way", F.col("attrs")["highway"].alias("highway"), F.size("shape").alias("n_shape"), F.round(F.col("length_cm") / 100, 0).cast("long").alias("metres"))


def sequence_tiled(spark, sf_dir):
    """The same by supersteps over blocks of five by five vertices, whose borders the sequences cross."""
    n = grid(spark, sf_dir)
    v = F.col("vertex_id")
    blocks = n.vertices.select(v, (F.floor(v % 25 / 5) + 5 * F.floor(v / 125)).alias("part"))
    return tiled_tree(graph.cost_arcs(n.edges, CAR), spark.createDataFrame([(0,)], "source long"), _sequences(n), blocks).select("arc_id", "cost")


def near_costs(spark, sf_dir):
    """Least costs from vertex 0 over arcs that leave a vertex within 2500 m of it, as far as they lead."""
    n = grid(spark, sf_dir)
    origin = n.vertices.where("vertex_id = 0").select(F.col("vertex_id").alias("query_id"), "lon", "lat")
    arcs = graph.arcs_near(graph.cost_arcs(n.edges, CAR), n.vertices, origin, 2500.0)
    return routing.vertex_costs(arcs, spark.createDataFrame([(0,)], "source long")).select("vertex_id", "cost")


def snap_edges(spark, sf_dir):
    n = grid(spark, sf_dir)
    return graph.snap(_points(spark, sf_dir), n.vertices, n.edges).select("query_id", "edge_id", "offset", F.round("distance_m", 3).alias("distance_m"), "error")


def _od_paths(spark, sf_dir):
    n = grid(spark, sf_dir)
    count = n.vertices.count()
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("query_id"))
    edge = lambda k: k - (k % 25 == 24).cast("int")  # noqa: E731  the edge to the right, or its left neighbour's in the last column
    od = s.select("query_id", (edge(F.col("query_id") % count) * 2).alias("from_edge"), F.lit(20_000).alias("from_offset"), (edge((F.col("query_id") * 7 + 13) % count) * 2).alias("to_edge"), F.lit(40_000).alias("to_offset"))
    return n, graph.cost_arcs(n.edges, CAR), od


def route_paths(spark, sf_dir):
    _, arcs, od = _od_paths(spark, sf_dir)
    return routing.routes(arcs, od).select("query_id", F.round("cost", 3).alias("cost"), F.size("path").alias("n_edges"), "error")


def small_islands(spark, sf_dir):
    """Edges from which there is no way back, on one-way streets with forbidden turns."""
    n = grid(spark, sf_dir)
    return routing.islands(_one_way_arcs(n).where("edge_id % 11 <> 4"), _barred(n), max_size=16)


QUERIES = {
    f.__name__: f
    for f in (vertex_scan, edge_scan, adjacency, edge_geometry, cost_arcs, profile_factors, edge_types, turn_pairs, least_cost_tree, cost_matrix, directed_tree, sequence_tree, sequence_tiled, near_costs, box_search, box_vertices, box_tiles, attribute_edits, imported_edges, vertex_places, edge_places, snap_all_vertices, snap_vertices, snap_edges, route_paths, small_islands)
}

_DIST = "sqrt(pow(radians({b}.lon - {a}.lon) * cos(radians({a}.lat + {b}.lat) / 2), 2) + pow(radians({b}.lat - {a}.lat), 2)) * 6371000"
_BEARING = "degrees(atan2((q.lon - p.lon) * cos(radians(p.lat)), q.lat - p.lat))"
_BOX = "b AS (SELECT s_suppkey AS query_id, 4.7003::DOUBLE + (s_suppkey % 20) * 0.002::DOUBLE AS lon, 51.2004::DOUBLE + (s_suppkey % 6) * 0.0012::DOUBLE AS lat FROM supplier)"
_TILE_X = "floor(({x} + 180) / 360 * 16384)::BIGINT"
_TILE_Y = "floor((1 - ln(tan(radians({y})) + 1 / cos(radians({y}))) / pi()) / 2 * 16384)::BIGINT"
_TREE = """
, ow AS (SELECT * FROM d WHERE arc_id % 2 = 0 OR edge_id % 5 <> 0),
t AS (SELECT a.arc_id AS a, b.arc_id AS b, b.cost FROM ow a JOIN ow b ON a.to_v = b.from_v AND a.edge_id <> b.edge_id
  WHERE NOT (a.to_v % 7 = 3 AND a.arc_id % 4 = 0 AND b.arc_id % 4 = 2))"""

def metres_sql(a: str, b: str) -> str:
    return f"sqrt(pow(radians({b}.lon - {a}.lon) * cos(radians({a}.lat + {b}.lat) / 2), 2) + pow(radians({b}.lat - {a}.lat), 2)) * 6371000"


NEAR = "abs({v}.lon - {p}.lon) * 111194.92664455873 * cos(radians({p}.lat)) < {m} AND abs({v}.lat - {p}.lat) * 111194.92664455873 < {m}"


def snap_sql(acceptable: str) -> str:
    """Snap to the edges that ``acceptable`` selects from e, as (edge_id, tail, head, pts, m1, m2, metres)."""
    foot = "((p.lon - a.lon) * kx * ((b.lon - a.lon) * kx) + (p.lat - a.lat) * (b.lat - a.lat)) / (((b.lon - a.lon) * kx) * ((b.lon - a.lon) * kx) + (b.lat - a.lat) * (b.lat - a.lat))"
    return f"""
, ok AS ({acceptable}),
seg AS (SELECT edge_id, tail, head, metres AS total, i, pts[i] AS a, pts[i + 1] AS b, CASE i WHEN 1 THEN 0 WHEN 2 THEN m1 ELSE m2 END AS before, cos(radians((pts[i].lat + pts[i + 1].lat) / 2)) AS kx FROM (SELECT *, unnest(range(1, len(pts))) AS i FROM ok)),
vs AS (SELECT query_id, lon, lat, vertex_id, near FROM (SELECT p.query_id, p.lon, p.lat, v.vertex_id, {NEAR.format(v='v', p='p', m=100)} AS near FROM asked p JOIN v ON {NEAR.format(v='v', p='p', m=500)})),
ns AS (SELECT query_id, any_value(lon) AS lon, any_value(lat) AS lat, edge_id, bool_or(near) AS near FROM vs JOIN ok ON vs.vertex_id = tail OR vs.vertex_id = head GROUP BY query_id, edge_id),
o AS (SELECT query_id, near, edge_id, total, before, i, a, b, {{'lon': lon, 'lat': lat}} AS p, kx FROM ns JOIN seg USING (edge_id)),
f AS (SELECT *, {foot} AS share FROM o),
c AS (SELECT query_id, near, edge_id, total, before, i, a, b, 0.0::DOUBLE AS share, {metres_sql('p', 'a')} AS m FROM f UNION ALL SELECT query_id, near, edge_id, total, before, i, a, b, 1.0, {metres_sql('p', 'b')} FROM f
  UNION ALL SELECT query_id, near, edge_id, total, before, i, a, b, share, {metres_sql('p', 'x')} FROM (SELECT *, {{'lon': a.lon + (b.lon - a.lon) * share, 'lat': a.lat + (b.lat - a.lat) * share}} AS x FROM f WHERE share BETWEEN 0 AND 1)),
g AS (SELECT *, CASE WHEN m < 1 THEN 0 ELSE round(m, 6) END AS dist FROM c WHERE m < 100),
h AS (SELECT * FROM (SELECT *, max(near::INT) OVER (PARTITION BY query_id) AS any_near FROM g) WHERE near OR any_near = 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dist, edge_id, i, share) = 1)
SELECT asked.query_id, coalesce(edge_id, -1) AS edge_id, CASE WHEN edge_id IS NULL THEN -1 ELSE least(65535, floor((before + share * {metres_sql('a', 'b')}) / total * 65535 + 1e-6)) END::INT AS "offset", round(coalesce(m, -1), 3) AS distance_m, CASE WHEN edge_id IS NULL THEN 'no edge found near the point' END AS error FROM asked LEFT JOIN h USING (query_id)"""


ORACLES = {
    "vertex_scan": _GRID + "SELECT vertex_id, round(lon, 6) AS lon, round(lat, 6) AS lat, floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 16384)::BIGINT * 16384 + floor((lon + 180) / 360 * 16384)::BIGINT AS tile_id FROM v",
    "edge_scan": _GRID + "SELECT edge_id, tail, head, kind AS highway FROM e",
    "adjacency": _GRID + "SELECT arc_id, edge_id, arc_id % 2 = 0 AS forward, from_v, to_v FROM arc",
    "edge_geometry": _GRID + f"SELECT edge_id, round({_DIST.format(a='p', b='q')}, 4) AS metres, round({_BEARING}, 4) AS bearing, ((round(({_BEARING} - floor({_BEARING} / 360) * 360) / 45)::INT % 8) * 45)::INT AS compass FROM e JOIN v p ON p.vertex_id = tail JOIN v q ON q.vertex_id = head",
    "cost_arcs": _GRID + "SELECT arc_id, from_v, to_v, cost::BIGINT AS cost FROM d",
    "profile_factors": """
SELECT p.profile, k.highway, f::BIGINT AS fwd_factor, f::BIGINT AS bwd_factor, s::INT AS fwd_speed, f > 0 AS can_stop FROM (VALUES
 ('car','motorway',30,3333),('car','primary',40,2500),('car','secondary',51,1944),('car','residential',72,1388),('car','living_street',240,416),
 ('car.short','motorway',1,3333),('car.short','primary',1,2500),('car.short','secondary',1,1944),('car.short','residential',1,1388),('car.short','living_street',1,416),
 ('bicycle','motorway',0,0),('bicycle','primary',24,416),('bicycle','secondary',24,416),('bicycle','residential',24,416),('bicycle','living_street',24,416),
 ('pedestrian','motorway',0,0),('pedestrian','primary',72,138),('pedestrian','secondary',72,138),('pedestrian','residential',72,138),('pedestrian','living_street',72,138)) p(profile, highway, f, s)
JOIN (SELECT DISTINCT CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'motorway' WHEN 'BUILDING' THEN 'primary' WHEN 'FURNITURE' THEN 'secondary' WHEN 'HOUSEHOLD' THEN 'residential' ELSE 'living_street' END AS highway FROM customer) k USING (highway)""",
    "edge_types": _GRID + "SELECT dense_rank() OVER (ORDER BY kind)::BIGINT AS type_id, count(*)::BIGINT AS n_edges FROM e GROUP BY kind",
    "turn_pairs": _GRID + _TREE + " SELECT a, b FROM t",
    "least_cost_tree": _GRID + """, r(v, c) USING KEY (v) AS (SELECT 0::BIGINT, 0::BIGINT UNION
 (SELECT d.to_v, min(r.c + d.cost)::BIGINT FROM r JOIN d ON d.from_v = r.v LEFT JOIN recurring.r q ON q.v = d.to_v WHERE q.c IS NULL OR r.c + d.cost < q.c GROUP BY d.to_v))
SELECT v AS vertex_id, c AS cost FROM r""",
    "cost_matrix": _GRID + """, r(s, v, c) USING KEY (s, v) AS (SELECT vertex_id::BIGINT, vertex_id::BIGINT, 0::BIGINT FROM v WHERE vertex_id % 100 = 0 UNION
 (SELECT r.s, d.to_v, min(r.c + d.cost)::BIGINT FROM r JOIN d ON d.from_v = r.v LEFT JOIN recurring.r q ON q.s = r.s AND q.v = d.to_v WHERE q.c IS NULL OR r.c + d.cost < q.c GROUP BY r.s, d.to_v))
SELECT s AS source, v AS vertex_id, c AS cost FROM r""",
    "directed_tree": _GRID + _TREE + """, r(k, c) USING KEY (k) AS (SELECT arc_id::BIGINT, cost::BIGINT FROM ow WHERE from_v = 0 UNION
 (SELECT t.b, min(r.c + t.cost)::BIGINT FROM r JOIN t ON t.a = r.k LEFT JOIN recurring.r q ON q.k = t.b WHERE q.c IS NULL OR r.c + t.cost < q.c GROUP BY t.b))
SELECT k AS arc_id, c AS cost FROM r""",
    "box_search": _GRID + """, b AS (SELECT s_suppkey AS query_id, 4.7003::DOUBLE + (s_suppkey % 20) * 0.002::DOUBLE AS lon, 51.2004::DOUBLE + (s_suppkey % 6) * 0.0012::DOUBLE AS lat FROM supplier)
SELECT DISTINCT query_id, edge_id FROM b JOIN v ON v.lat > b.lat - 0.002 AND v.lat <= b.lat + 0.002 AND v.lon > b.lon - 0.0035 AND v.lon <= b.lon + 0.0035 JOIN e ON v.vertex_id IN (tail, head)""",
    "snap_vertices": _GRID + f""", p AS (SELECT event_id AS query_id, 4.7001::DOUBLE + (user_id % 23) * 0.00207::DOUBLE AS lon, 51.2001::DOUBLE + (event_id % 5) * 0.00117::DOUBLE AS lat FROM events),
n AS (SELECT query_id, vertex_id, {_DIST.format(a='p', b='v')} AS m FROM p JOIN v ON abs(v.lon - p.lon) * 111194.92664455873 * cos(radians(p.lat)) < 100 AND abs(v.lat - p.lat) * 111194.92664455873 < 100)
SELECT query_id, vertex_id, round(m, 3) AS distance_m FROM n QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(m, 6), vertex_id) = 1""",
    "sequence_tree": _GRID + """, t AS (SELECT a.arc_id AS a, b.arc_id AS b, b.cost, a.to_v AS v FROM d a JOIN d b ON a.to_v = b.from_v AND a.edge_id <> b.edge_id),
r(p, k, c) USING KEY (p, k) AS (SELECT -1::BIGINT, arc_id::BIGINT, cost::BIGINT FROM d WHERE from_v = 0 UNION
 (SELECT r.k, t.b, min(r.c + t.cost)::BIGINT FROM r JOIN t ON t.a = r.k LEFT JOIN recurring.r q ON q.p = r.k AND q.k = t.b
  WHERE NOT (t.v % 7 = 3 AND r.p >= 0 AND r.p // 2 % 2 = 0 AND r.k // 2 % 2 = 0 AND t.a % 2 = 0 AND r.p % 2 = 0 AND t.b // 2 % 2 = 1 AND t.b % 2 = 0) AND (q.c IS NULL OR r.c + t.cost < q.c) GROUP BY r.k, t.b))
SELECT k AS arc_id, min(c) AS cost FROM r GROUP BY k""",
    "box_vertices": _GRID + f", {_BOX} SELECT query_id, vertex_id FROM b JOIN v ON v.lat > b.lat - 0.002 AND v.lat <= b.lat + 0.002 AND v.lon > b.lon - 0.0035 AND v.lon <= b.lon + 0.0035",
    "box_tiles": f"""WITH {_BOX}, n AS (SELECT *, {_TILE_X.format(x='lon - 0.0035')} AS x1, {_TILE_X.format(x='lon + 0.0035')} AS x2, {_TILE_Y.format(y='lat + 0.002')} AS y1, {_TILE_Y.format(y='lat - 0.002')} AS y2 FROM b),
x AS (SELECT *, unnest(range(x1, x2 + 1)) AS x FROM n), y AS (SELECT *, unnest(range(y1, y2 + 1)) AS y FROM x)
SELECT query_id, y * 16384 + x AS tile_id, {_TILE_Y.format(y='lat')} * 16384 + {_TILE_X.format(x='lon')} AS middle_tile FROM y""",
    "attribute_edits": """SELECT c_custkey AS id, '[{"key":"name","value":"none"},{"key":"segment","value":"' || c_mktsegment || '"}]' AS removed, '{"segment":"' || c_mktsegment || '"}' AS kept, c_name = 'none' AS same, true AS same_but_name FROM customer""",
    "imported_edges": _GRID + f""", m AS (SELECT p.vertex_id AS tail, q.vertex_id AS head, p.gx, p.gy, q.vertex_id = p.vertex_id + 25 AS up, {_DIST.format(a='p', b='q')} AS metres FROM v p JOIN v q ON q.vertex_id = p.vertex_id + 25 OR q.vertex_id = p.vertex_id + 1 AND p.gx < 24)
SELECT tail, head, CASE WHEN up THEN gx ELSE gy + 1000 END AS way, CASE WHEN up THEN 'residential' ELSE 'primary' END AS highway, 0 AS n_shape, round(floor(metres * 100) / 100)::BIGINT AS metres FROM m""",
    "vertex_places": _GRID + "SELECT from_v AS query_id, edge_id, CASE WHEN arc_id % 2 = 0 THEN 0 ELSE 65535 END AS \"offset\" FROM arc WHERE kind <> 'motorway'",
    "edge_places": _GRID + """SELECT event_id AS query_id, user_id * 3 AS edge_id, (event_id % 65536)::INT AS "offset", CASE WHEN e.edge_id IS NULL THEN 'edge not found' WHEN kind = 'motorway' THEN 'edge cannot be used in that direction' END AS error FROM events LEFT JOIN e ON e.edge_id = user_id * 3""",
    "snap_all_vertices": _GRID + f""", p AS (SELECT event_id AS query_id, 4.7001::DOUBLE + (user_id % 23) * 0.00207::DOUBLE AS lon, 51.2001::DOUBLE + (event_id % 5) * 0.00117::DOUBLE AS lat FROM events)
SELECT query_id, vertex_id, round({_DIST.format(a='p', b='v')}, 3) AS distance_m FROM p JOIN v ON abs(v.lon - p.lon) * 111194.92664455873 * cos(radians(p.lat)) < 100 AND abs(v.lat - p.lat) * 111194.92664455873 < 100""",
    "near_costs": _GRID + """, k AS (SELECT d.* FROM d JOIN v ON v.vertex_id = d.from_v, (SELECT lon AS x, lat AS y FROM v WHERE vertex_id = 0) WHERE abs(v.lon - x) * 111194.92664455873 * cos(radians(y)) < 2500 AND abs(v.lat - y) * 111194.92664455873 < 2500),
r(v, c) USING KEY (v) AS (SELECT 0::BIGINT, 0::BIGINT UNION
 (SELECT k.to_v, min(r.c + k.cost)::BIGINT FROM r JOIN k ON k.from_v = r.v LEFT JOIN recurring.r q ON q.v = k.to_v WHERE q.c IS NULL OR r.c + k.cost < q.c GROUP BY k.to_v))
SELECT v AS vertex_id, c AS cost FROM r""",
    "snap_edges": _GRID + """, asked AS (SELECT event_id AS query_id, 4.7001::DOUBLE + (user_id % 23) * 0.00207::DOUBLE AS lon, 51.2001::DOUBLE + (event_id % 5) * 0.00117::DOUBLE AS lat FROM events)"""
    + snap_sql(f"SELECT edge_id, tail, head, pts, m1, m1 AS m2, m1 AS metres FROM (SELECT e.*, [{{'lon': a.lon, 'lat': a.lat}}, {{'lon': b.lon, 'lat': b.lat}}] AS pts, {_DIST.format(a='a', b='b')} AS m1 FROM e JOIN v a ON a.vertex_id = tail JOIN v b ON b.vertex_id = head)"),
    # Costs times a million plus arcs: the fewest arcs among the cheapest paths.
    "route_paths": _GRID + """, n AS (SELECT count(*) AS n FROM v), od AS (SELECT s_suppkey AS q, (s_suppkey % n - (s_suppkey % n % 25 = 24)::INT) * 2 AS fe, ((s_suppkey * 7 + 13) % n - ((s_suppkey * 7 + 13) % n % 25 = 24)::INT) * 2 AS te FROM supplier, n),
src AS (SELECT q, arc_id AS k, cost, to_v, CASE WHEN arc_id % 2 = 0 THEN 20000 / 65535.0::DOUBLE ELSE 1 - 20000 / 65535.0::DOUBLE END AS s FROM od JOIN d ON edge_id = fe),
dst AS (SELECT q, arc_id AS k, cost, from_v, CASE WHEN arc_id % 2 = 0 THEN 40000 / 65535.0::DOUBLE ELSE 1 - 40000 / 65535.0::DOUBLE END AS s FROM od JOIN d ON edge_id = te),
r(s, v, c) USING KEY (s, v) AS (SELECT DISTINCT to_v::BIGINT, to_v::BIGINT, 0::BIGINT FROM src UNION
 (SELECT r.s, d.to_v, min(r.c + d.cost::BIGINT * 1000000 + 1)::BIGINT FROM r JOIN d ON d.from_v = r.v LEFT JOIN recurring.r q ON q.s = r.s AND q.v = d.to_v WHERE q.c IS NULL OR r.c + d.cost::BIGINT * 1000000 + 1 < q.c GROUP BY r.s, d.to_v)),
o AS (SELECT src.q, (1 - src.s) * src.cost + r.c // 1000000 + dst.s * dst.cost AS cost, r.c % 1000000 + 2 AS n FROM src JOIN dst ON src.q = dst.q JOIN r ON r.s = src.to_v AND r.v = dst.from_v WHERE src.k // 2 <> dst.k // 2 OR src.k = dst.k AND r.c > 0
  UNION ALL SELECT src.q, (dst.s - src.s) * src.cost, 1 FROM src JOIN dst ON src.q = dst.q AND src.k = dst.k AND dst.s >= src.s)
SELECT q AS query_id, round(cost, 3) AS cost, n::INT AS n_edges, NULL AS error FROM o QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(cost, 6), n) = 1""",
    # Parts of edges that reach each other both ways.
    "small_islands": _GRID + """, ow AS (SELECT * FROM d WHERE (arc_id % 2 = 0 OR edge_id % 5 <> 0) AND edge_id % 11 <> 4),
l AS (SELECT DISTINCT a.edge_id AS a, b.edge_id AS b FROM ow a JOIN ow b ON a.to_v = b.from_v AND a.edge_id <> b.edge_id WHERE NOT (a.to_v % 7 = 3 AND a.arc_id % 4 = 0 AND b.arc_id % 4 = 2)),
r(a, b) AS (SELECT DISTINCT edge_id, edge_id FROM ow UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
s AS (SELECT x.a AS edge_id, count(*)::BIGINT AS size FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a)
SELECT edge_id, size FROM s WHERE size < 16""",
}

ORACLES["sequence_tiled"] = ORACLES["sequence_tree"]
