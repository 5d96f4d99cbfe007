"""Small graphs with known answers, and the two search engines against each other."""

import math
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators import graph, mutate, places, routes, routing
from waymark.operators.profiles import BICYCLE, CAR
from waymark.sources import osm
from waymark.storage import Network, read_snapshot, write_snapshot

P = [(4.792613983154297, 51.26535213392538), (4.797506332397461, 51.26674845584085), (4.792141914367670, 51.26297560389227), (4.797334671020508, 51.26241166347257)]
ARC = "arc_id long, edge_id long, forward boolean, from_v long, to_v long, cost long"


def arcs_of(spark, edges):
    """(edge, tail, head, cost) with arcs both ways."""
    return spark.createDataFrame([r for e, t, h, c in edges for r in ((2 * e, e, True, t, h, c), (2 * e + 1, e, False, h, t, c))], ARC)


def route(spark, arcs, q, forbidden=None, **kw):
    spec = "query_id long, from_edge long, from_offset long, to_edge long, to_offset long, from_forward boolean, to_forward boolean"
    return routing.routes(arcs, spark.createDataFrame([(1, *q)], spec), forbidden, **kw).collect()


def test_three_hops(spark):
    r = route(spark, arcs_of(spark, [(1, 0, 1, 1), (2, 1, 2, 1), (3, 2, 3, 1)]), (1, 0, 3, 65535, None, None))[0]
    assert (r.cost, r.path, r.offset1, r.offset2) == (3.0, [2, 4, 6], 0, 65535)


def test_detour_beats_own_edge(spark):
    arcs = arcs_of(spark, [(1, 0, 1, 1), (2, 1, 2, 1), (3, 0, 2, 10)])
    r = route(spark, arcs, (3, 0, 3, 65535, None, None))[0]
    assert r.cost == 2.0 and [a >> 1 for a in r.path] == [3, 1, 2, 3]


def test_forbidden_turn_gives_no_path(spark):
    arcs = arcs_of(spark, [(1, 0, 1, 1), (2, 1, 2, 1)])
    bar = spark.createDataFrame([(1, 1, 2)], "vertex_id long, from_edge long, to_edge long")
    assert route(spark, arcs, (1, 0, 2, 65535, None, None), bar)[0].error == "no path"


def test_forced_directions_go_round(spark):
    arcs = arcs_of(spark, [(1, 0, 1, 1), (2, 1, 2, 1), (3, 2, 3, 1), (4, 3, 0, 1)])
    r = route(spark, arcs, (1, 65535, 1, 0, True, True))[0]
    assert [a >> 1 for a in r.path] == [1, 2, 3, 4, 1] and (r.offset1, r.offset2) == (65535, 0)


def test_kernel_equals_relaxation(spark):
    import random

    rnd = random.Random(5)
    edges = [(e, rnd.randrange(12), rnd.randrange(12), rnd.randrange(1, 20)) for e in range(1, 30)]
    arcs = arcs_of(spark, edges).where("forward or edge_id % 4 <> 0")
    bar = spark.createDataFrame([(edges[k][2], edges[k][0], edges[k + 1][0]) for k in range(10)], "vertex_id long, from_edge long, to_edge long")
    sources = spark.createDataFrame([(0,), (5,)], "source long")
    key = lambda df: sorted((r.source, r.arc_id, r.cost) for r in df.collect())
    assert key(routing.arc_tree(arcs, sources, bar)) == key(routing.relax_arcs(arcs, sources, bar))


def test_islands_agree(spark):
    # A cycle of three, a one-way tail, and a two-way pair apart.
    arcs = arcs_of(spark, [(1, 0, 1, 1), (2, 1, 2, 1), (3, 2, 0, 1), (4, 2, 5, 1), (6, 7, 8, 1), (7, 8, 9, 1)]).where("not (edge_id in (1, 2, 3, 4) and not forward)")
    a = {r.edge_id: r.size for r in routing.islands(arcs, max_size=3).collect()}
    b = {r.edge_id: r.size for r in routing.colored_islands(arcs, max_size=3).collect()}
    assert a == b and set(a) == {4, 6, 7}


def test_labels_of_parts(spark):
    """Parts of any cut give the strongly connected parts of the whole graph; parts that did not change are not searched again."""
    import random

    from waymark.operators.labels import edge_labels, islands_by_parts

    rnd = random.Random(11)
    for n in (14,):
        edges = [(e, rnd.randrange(n), rnd.randrange(n), 1) for e in range(1, 2 * n)]
        arcs = arcs_of(spark, edges).where("forward or edge_id % 5 = 0").cache()
        bar = spark.createDataFrame([(edges[k][2], edges[k][0], edges[k + 1][0]) for k in range(n)], "vertex_id long, from_edge long, to_edge long")
        links = {(a.edge_id, b.edge_id) for a in arcs.collect() for b in arcs.collect() if a.to_v == b.from_v and a.edge_id != b.edge_id} - {(r.from_edge, r.to_edge) for r in bar.collect() for a in arcs.collect() if a.edge_id == r.from_edge and a.to_v == r.vertex_id}
        reach = {e: {e} for e, *_ in edges}
        for _ in edges:
            reach = {e: {e} | {x for a, b in links if a == e for x in reach[b]} for e in reach}
        want = {e: (min(part), len(part)) for e in reach for part in [[x for x in reach[e] if e in reach[x]]]}
        for width, few in ((1, 0), (3, 100)):
            parts = spark.createDataFrame([(v, 20 * (v // width)) for v in range(n)], "vertex_id long, part long")
            got, said = edge_labels(arcs, bar, parts, few=few)
            assert {r.edge_id: (r.label, r.size) for r in got.collect()} == want
        # One part loses an edge: what the others said, though wrong here on purpose, is taken again.
        home = lambda e: 20 * (edges[e - 1][1] // 3)
        parts = spark.createDataFrame([(v, 20 * (v // 3)) for v in range(n)], "vertex_id long, part long")
        said = edge_labels(arcs, bar, parts)[1]
        again = edge_labels(arcs.where("edge_id <> 1"), bar, parts, known=said.withColumn("label", F.col("edge_id")))[1]
        assert all((r.label == r.edge_id) for r in again.collect() if r.part != home(1)) and {r.edge_id for r in again.collect()} == {e for e, *_ in edges} - {1}
        assert {r.mark for r in again.collect() if r.part == home(1)}.isdisjoint({r.mark for r in said.collect()})
    assert edge_labels(arcs.limit(0), bar, parts)[0].count() == 0
    routed = {r.edge_id: r.size for r in islands_by_parts(arcs, bar, max_size=3).collect()}
    assert routed == {r.edge_id: r.size for r in routing.islands(arcs, bar, max_size=3).collect()} == {e: k for e, (_, k) in want.items() if k < 3}


def test_profiles(spark):
    rows = [({"highway": "residential"},), ({"highway": "pedestrian"},), ({"highway": "residential", "oneway": "yes"},), ({"route": "ferry"},), ({},)]
    df = spark.createDataFrame(rows, "attrs map<string,string>")
    got = [(r.fwd_factor, r.bwd_factor) for r in df.select(*BICYCLE.factors(F.col("attrs"))).collect()]
    assert got == [(24, 24), (0, 0), (24, 0), (24, 24), (0, 0)]


def test_geometry(spark):
    one = spark.range(1)
    d = one.select(geo.distance(F.lit(4.7), F.lit(51.2), geo.offset_x(F.lit(4.7), F.lit(51.2), F.lit(10.0)), F.lit(51.2)).alias("d")).first().d
    assert math.isclose(d, 10, abs_tol=1e-3)
    lines = [3.7312209606170654, 51.05363599762037, 3.7314248085021973, 51.053366234152264, 3.7311029434204100, 51.05344379131031, 3.7315267324447630, 51.053588789126906]
    x = one.select(geo.intersection(*map(F.lit, lines)).alias("x")).first().x
    assert (round(x.lon, 6), round(x.lat, 6)) == (3.731312, 51.053515)
    assert one.select(geo.project(F.lit(0.0), F.lit(5.0), F.lit(1.0), F.lit(0.0), F.lit(2.0), F.lit(0.0)).alias("p")).first().p is None


def network(spark):
    v = spark.createDataFrame([(k, *p) for k, p in enumerate(P)], "vertex_id long, lon double, lat double")
    e = spark.createDataFrame([(1, 0, 1, [], {"highway": "residential"}), (2, 1, 3, [], {"highway": "residential"}), (3, 3, 2, [], {"highway": "primary"})], "edge_id long, tail long, head long, shape array<struct<lon:double,lat:double>>, attrs map<string,string>")
    t = spark.createDataFrame([], "vertex_id long, from_edge long, to_edge long, cost long, attrs map<string,string>, prefix array<long>")
    empty = Network(v, e.limit(0).withColumn("length_cm", F.lit(0).cast("long")), t)
    return mutate.add_edges(empty, e)


def test_snap_route_build_and_snapshot(spark, tmp_path):
    n = network(spark)
    mid = ((P[0][0] + P[1][0]) / 2, (P[0][1] + P[1][1]) / 2)
    # The ends are over 100 m away, so the wide box finds the edge.
    s = graph.snap(spark.createDataFrame([(1, *mid)], "query_id long, lon double, lat double"), n.vertices, n.edges).first()
    assert s.edge_id == 1 and abs(s.offset - 32767) <= 1 and s.distance_m == 0
    arcs = graph.cost_arcs(n.edges, CAR)
    q = spark.createDataFrame([(7, 1, 0, 3, 65535)], "query_id long, from_edge long, from_offset long, to_edge long, to_offset long")
    on_path = routes.path_edges(routing.routes(arcs, q))
    shaped = graph.full_shape(n.edges, n.vertices).select("edge_id", "points", "attrs", "length_cm")
    speeds = n.edges.select("edge_id", *CAR.factors(F.col("attrs"))[2:4])
    r = routes.build(routes.pieces(on_path, shaped, speeds)).first()
    assert len(r.shape) == 4 and [m.edge_id for m in r.meta] == [1, 2, 3]
    assert math.isclose(r.total_distance, sum(x.length_cm for x in n.edges.collect()) / 100, rel_tol=1e-6)
    write_snapshot(n, str(tmp_path))
    assert read_snapshot(spark, str(tmp_path), n.version).edges.count() == 3
    assert mutate.delete_edges(n, spark.createDataFrame([(2,)], "edge_id long")).edges.count() == 2
    split = osm.split_tile(n, zoom=18)
    assert osm.merge_tiles(*split).count() == 3


def test_import_restriction_and_barrier(spark):
    nodes = spark.createDataFrame([(k, *P[k % 4], {"barrier": "bollard"} if k == 2 else {}) for k in range(4)], "id long, lon double, lat double, tags map<string,string>")
    ways = spark.createDataFrame([(10, [0, 1, 2], {"highway": "residential"}), (11, [1, 3], {"highway": "service"}), (12, [2, 3], {"highway": "residential"}), (13, [0, 3], {"building": "yes"})], "id long, nodes array<long>, tags map<string,string>")
    members = [("way", 11, "from"), ("node", 1, "via"), ("way", 10, "to")]
    rel = spark.createDataFrame([(5, members, {"type": "restriction", "restriction": "no_left_turn"})], "id long, members array<struct<type:string,id:long,role:string>>, tags map<string,string>")
    n = osm.import_network(nodes, ways, rel)
    assert sorted((r.tail, r.head) for r in n.edges.collect()) == [(0, 1), (1, 2), (1, 3), (2, 3)]
    costs = n.turn_costs.collect()
    assert {r.vertex_id for r in costs} == {1, 2}
    assert len([r for r in costs if r.vertex_id == 2]) == 2 and len([r for r in costs if r.vertex_id == 1]) == 2


def test_instructions_turn_and_roundabout():
    from waymark.operators.instructions import Line, scan, text
    from waymark.operators.texts import DEFAULT_SETTINGS, Texts

    a, b = {"name": "A"}, {"name": "B"}
    r = Line([(0.0, 0.0), (0.001, 0.0), (0.001, -0.001), (0.001, -0.002)], [a, b, b])
    found = scan(r)
    assert [f[:3] for f in found] == [("start", 0, 0), ("turn", 1, 1), ("followalong", 2, 3), ("end", 2, 3)]
    assert found[1][3] == -90 and [text(r, found[1], Texts(DEFAULT_SETTINGS["languages"][c])) for c in ("en", "nl")] == ["Turn right on B", "Sla rechtsaf op B"]
    assert [text(r, f, Texts(DEFAULT_SETTINGS["languages"]["en"])) for f in (found[0], found[3])] == ["Start east on A", "You have arrived at your destination"]
    with pytest.raises(ValueError, match="point 1"):
        scan(r, ("start",))
    assert [f[0] for f in scan(r, ("start",), gaps=True)] == ["start", "end"]
    # A ring that the route never leaves ends with it; a route of one piece has no more than start and end.
    ring = {"junction": "roundabout"}
    assert [f[:4] for f in scan(Line([(0.0, 0.0), (0.001, 0.0), (0.0012, 0.0002), (0.0014, 0.0)], [a, a, ring]))][1:] == [("roundabout", 1, 3, 90), ("end", 2, 3, 0)]
    assert [f[0] for f in scan(Line([(0.0, 0.0), (0.001, 0.0)], [a]))] == ["start", "end"]


# Routes on real streets, and what instructions on them are to be: (lon, lat) by point, attributes by piece.
RAMP = [(3.1850286573171616, 51.20640699014240), (3.1848630309104920, 51.20649017227455), (3.1847423315048218, 51.20651705939626), (3.1847235560417170, 51.20658847823707), (3.1846323609352107, 51.20662628816679)]
BEND = [
    (3.2872939109802246, 51.25332724127623), (3.287535309791565, 51.253407820538555), (3.2878518104553223, 51.253434680261265), (3.2881200313568115, 51.25339103320389), (3.288302421569824, 51.25325337682838), (3.2883989810943604, 51.25303178277289), (3.288388252258301, 51.25282361768734),
    (3.288302421569824, 51.25271953479114), (3.2879215478897095, 51.25222597720485), (3.287878632545471, 51.25207824465225), (3.287953734397888, 51.25196072978281), (3.2880690693855286, 51.251900293447285), (3.2884150743484497, 51.25177942053796),
]
STREET = [(3.220316469669342, 51.21548471911082), (3.2195869088172913, 51.21530158595063), (3.2183021306991577, 51.21495043867946), (3.218068778514862, 51.21488491329411), (3.2174840569496155, 51.21467657555176), (3.216794729232788, 51.21445647578384), (3.2170093059539795, 51.21416580806587)]
CORNER = [(3.2200777530670166, 51.21591482715479), (3.220316469669342, 51.21548471911082), (3.2207858562469482, 51.21558888627144)]


def test_instructions_on_real_roundabouts():
    from waymark.operators.instructions import Branch, Line, roundabout

    way, ring, out = {"name": "Legeweg"}, {"junction": "roundabout", "name": "Legeweg"}, {"name": "Sint-Hubertuslaan"}
    right = Line([*RAMP, (3.1846685707569122, 51.20672627427577), (3.1847423315048218, 51.20736399569539)], [way, way, ring, ring, out, out])
    kind, begin, end, degrees, more = roundabout(right, 1)
    assert (kind, begin, end, degrees, more["exitnumber"]) == ("roundabout", 1, 5, -64, "1")
    side = Branch(3.184565305709839, 51.206622927285395, ring)
    across = Line([*RAMP, (3.1845176964998245, 51.20661410497061), (3.1844761222600937, 51.20655654982782), (3.1842997670173645, 51.20656999337126)], [way, way, ring, ring, ring, ring, out], {4: [side], 6: [side]})
    _, _, end, degrees, more = roundabout(across, 1)
    assert (end, degrees, more["exitnumber"]) == (6, 31, "2")
    assert roundabout(across, 0) is None and roundabout(across, 6) is None


def test_instructions_on_real_bends_and_streets():
    from waymark.operators.instructions import Branch, Line, base, follow_along, follow_bend, intersection, scan

    name = [{"name": "Rabauestraat"}] * 12
    assert follow_bend(Line(BEND, name), 8)[1:4] == (8, 12, 85)
    assert follow_bend(Line(BEND, name), 1)[1:4] == (1, 7, -143)
    assert follow_bend(Line(BEND, name, {2: [Branch(3.2877659797668457, 51.253599195720575)]}), 1)[1:4] == (1, 7, -143)
    assert follow_bend(Line(BEND, name, {4: [Branch(3.288109302520752, 51.25313250747596)]}), 1)[1:4] == (1, 4, -77)

    klaver, ezel = {"name": "Klaverstraat"}, {"name": "Ezelstraat"}
    # The second street begins at the last point: the last piece is still of the first.
    assert follow_along(Line(STREET, [klaver] * 6), 1)[:3] == ("followalong", 1, 5)
    assert follow_along(Line([(3.220186908178931, 51.21572321641173), *STREET], [klaver] * 7), 1) is None
    assert base(Line(CORNER, [{"name": "Elf-Julistraat"}, klaver]), 0)[1:4] == (0, 1, 90)
    assert base(Line(CORNER[::-1], [klaver, {"name": "Elf-Julistraat"}]), 0)[1:4] == (0, 1, -90)
    assert base(Line(CORNER, [ezel, klaver]), 1) is None
    right = Line([(3.2200763, 51.215923), (3.2203252, 51.215485), (3.2195995, 51.215298)], [{"name": "Elf-Julistraat"}, klaver])
    assert [f[:4] for f in scan(right, ("roundabout", "turn", "base"))] == [("base", 0, 1, -87), ("turn", 1, 1, -87), ("end", 1, 2, 0)]
    along = Line([(3.2203238220720323, 51.215487201201114), (3.2208590840492377, 51.215600349155096), (3.2210915919065712, 51.215630089643184)], [klaver, klaver])
    assert scan(along)[1][0] == "followalong"
    off = Line([(3.2208590840492377, 51.215600349155096), (3.2210915919065712, 51.215630089643184), (3.221081870955544, 51.215575831418306)], [klaver, {"name": "Vlamingdam"}])
    assert scan(off)[1][0] == "turn"
    path = [(3.213835487550398, 51.210335796947305), (3.213832145410805, 51.210259375824165), (3.2137970529425957, 51.210155736015906), (3.213740236565144, 51.21006884589596), (3.213661696278564, 51.210029064822805), (3.2135965245518605, 51.21001126801539), (3.213499602496398, 51.21000289304513), (3.2134026804409643, 51.21000498678771), (3.2132756791262693, 51.21005523658562)]
    assert [f[:1] + f[3:4] for f in scan(Line(path, [{"highway": "cycleway"}] * 8))] == [("start", 0), ("followbend", -117), ("end", 0)]

    groene = {"name": "Groenestraat"}
    cross = [(3.2175779342651363, 51.21153207328682), (3.2173392176628113, 51.211704299781594), (3.217083066701889, 51.21161356590366), (3.2166606187820435, 51.21148670620053)]
    left = intersection(Line(cross, [klaver, groene, groene], {1: [Branch(3.217179626226425, 51.2118614033882, klaver), Branch(3.2176195085048676, 51.21182611813286, groene)]}), 1)
    assert (left[2], left[4]["actualindex"], len(left[4]["roads"])) == (2, "2", 3) and left[4]["roads"][2] == (left[3], groene)
    right = intersection(Line([(3.217179626226425, 51.2118614033882), *cross[1:]], [klaver, groene, groene], {1: [Branch(*cross[0], klaver), Branch(3.2176195085048676, 51.21182611813286, groene)]}), 1)
    assert (right[2], right[4]["actualindex"]) == (2, "1")


def test_relative_directions(spark):
    angles = [0, 4.9, 5, 24.9, 25, 130, 154.9, 155, 169.9, 170, 189.9, 190, 204.9, 205, 300, 334.9, 335, 354.9, 355]
    rows = spark.createDataFrame([(float(a),) for a in angles], "a double").select(geo.relative_direction(F.col("a")).alias("k")).collect()
    want = ["TurnBack"] * 2 + ["SharpRight"] * 2 + ["Right"] * 3 + ["SlightlyRight"] * 2 + ["StraightOn"] * 2 + ["SlightlyLeft"] * 2 + ["Left"] * 3 + ["SharpLeft"] * 2 + ["TurnBack"]
    assert [r.k for r in rows] == want
    one = spark.range(1).select(geo.turn_angle(*[F.lit(float(x)) for x in (0, 51, 1, 51, 1, 50)]).alias("a"), geo.turn_angle(*[F.lit(float(x)) for x in (1, 51, 1, 51, 1, 50)]).alias("n")).first()
    assert round(one.a, 6) == 90 and one.n is None


@pytest.mark.parametrize("plan", ["queries", "town", "drills"])
def test_queries_match_sql_on_small_tables(spark, plan):
    duckdb = pytest.importorskip("duckdb")
    import importlib

    module = importlib.import_module(f"waymark.plans.{plan}")
    ORACLES, QUERIES = module.ORACLES, module.QUERIES

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    con = duckdb.connect()
    for name in ("customer", "supplier", "events"):
        con.sql(f"create view {name} as select * from '{sf}/{name}.parquet'")
    for name, sql in ORACLES.items():
        a, b = QUERIES[name](spark, sf).toPandas(), con.sql(sql).df()
        cols = sorted(a.columns)
        assert cols == sorted(b.columns), name
        rows = lambda d: sorted(map(tuple, d[cols].astype(object).where(d[cols].notna(), None).values.tolist()), key=repr)  # noqa: E731, B023
        assert rows(a) == rows(b), name


def test_forbidden_sequences(spark):
    """A turn that is forbidden after a certain edge is open to others, and a detour that loses the history is found."""
    arcs = arcs_of(spark, [(1, 0, 1, 1), (2, 1, 2, 1), (3, 2, 3, 1), (4, 9, 1, 1), (5, 0, 9, 5)])
    bar = spark.createDataFrame([(2, 2, 3, [1])], "vertex_id long, from_edge long, to_edge long, prefix array<long>")
    r = route(spark, arcs, (1, 0, 3, 65535, None, None), bar)[0]
    # Leaving edge 1 backwards over 5 and 4 comes to edge 2 with another edge behind.
    assert r.cost == 8.0 and [a >> 1 for a in r.path] == [1, 5, 4, 2, 3]
    assert route(spark, arcs, (4, 0, 3, 65535, True, None), bar)[0].cost == 3.0
    tree = {x.arc_id: x.cost for x in routing.arc_tree(arcs, spark.createDataFrame([(0,)], "source long"), bar).collect()}
    assert tree[4] == 2 and tree[6] == 5 + 1 + 1 + 1
    with pytest.raises(ValueError):
        routing.relax_arcs(arcs, spark.createDataFrame([(0,)], "source long"), bar)


def test_places_and_elevation(spark):
    edges = spark.createDataFrame([(1, 10, 11, {"highway": "residential", "oneway": "yes"}), (2, 11, 12, {"highway": "steps"})], "edge_id long, tail long, head long, attrs map<string,string>")
    at = spark.createDataFrame([(7, 11)], "query_id long, vertex_id long")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(places.from_vertices(at, edges)) == [(7, 1, 65535), (7, 2, 0)]
    assert rows(places.from_vertices(at, edges, CAR)) == []
    assert rows(places.from_vertices(at, edges, CAR, departure=False)) == [(7, 1, 65535)]
    asked = spark.createDataFrame([(1, 1, 5, True), (2, 1, 5, False), (3, 9, 5, True)], "query_id long, edge_id long, offset int, forward boolean")
    assert [r[3] for r in rows(places.from_edges(asked, edges, CAR))] == [None, "edge cannot be used in that direction", "edge not found"]

    line = F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in ((4.0, 51.0), (4.0, 51.001), (4.001, 51.001))])
    angle = lambda offset: places.angle(line, F.lit(offset), geo.line_length(line))
    got = spark.range(1).select(angle(0), angle(65535), places.direction(F.lit(10.0), F.lit(350.0), 30.0), places.direction(F.lit(10.0), F.lit(180.0), 30.0), places.direction(F.lit(10.0), F.lit(90.0), 30.0)).first()
    assert abs(got[0]) < 1e-6 and abs(got[1] - 90) < 1e-6 and list(got)[2:] == [True, False, None]

    points = spark.createDataFrame([(1, 4.05, 51.05, None), (2, 4.05, 51.05, 3.0), (3, 9.0, 51.0, None)], "id long, lon double, lat double, ele float")
    raster = spark.createDataFrame([(40, 510, 12.0)], "cell_x long, cell_y long, ele float")
    assert [(r.id, r.ele) for r in places.add_elevation(points, raster, step=0.1, estimate=-1.0).orderBy("id").collect()] == [(1, 12.0), (2, 3.0), (3, -1.0)]


def test_augmented_metas(spark):
    from waymark.operators import instructions

    shape = [(4.0, 51.0), (4.0, 51.001), (4.0, 51.002), (4.0, 51.003)]
    built = spark.createDataFrame(
        [(1, shape, [(2, 5, True, '{"name":"a"}', 222.0, 20.0), (3, 6, True, '{"name":"b"}', 111.0, 11.0)])],
        "query_id long, shape array<struct<lon:double,lat:double>>, meta array<struct<shape_idx:int,edge_id:long,forward:boolean,attrs:string,metres:double,seconds:double>>",
    )
    found = spark.createDataFrame([(1, 0, 1, {"en": "Start"}), (1, 1, 3, {"en": "End"})], "query_id long, seq int, shape_idx_end int, texts map<string,string>")
    meta = instructions.augment(built, found).first().meta
    assert [(m.shape_idx, m.edge_id) for m in meta] == [(1, 5), (2, 5), (3, 6)]
    assert [eval(m.attrs) for m in meta] == [{"name": "a", "instruction:en": "Start"}, {"name": "a", "instruction:en": "End"}, {"name": "b", "instruction:en": "End"}]
    assert abs(meta[0].metres - 111.2) < 0.1 and abs(meta[0].seconds - 10.0) < 0.1
    assert [m.shape_idx for m in instructions.augment(built, found.limit(0)).first().meta] == [2, 3]


def test_alternatives_branches_and_features(spark):
    import json

    from waymark.sources import geojson

    arcs = arcs_of(spark, [(1, 0, 1, 1), (2, 2, 3, 1), (3, 1, 2, 10), (4, 1, 2, 11), (5, 2, 9, 1)])
    spec = "query_id long, from_edge long, from_offset long, to_edge long, to_offset long"
    asked = spark.createDataFrame([(1, 1, 0, 2, 65535)], spec)
    found = {r["rank"]: [a >> 1 for a in r.path] for r in routing.routes(arcs, asked, alternatives=2, max_shared=0.7).collect()}
    assert found == {0: [1, 3, 2], 1: [1, 4, 2]}
    assert routing.routes(arcs, asked, alternatives=2).count() == 1
    side = routes.branches(routes.path_edges(routing.routes(arcs, asked)), arcs).collect()
    assert sorted((r.seq, r.edge_id) for r in side) == [(0, 4), (1, 4), (1, 5)]

    v = spark.createDataFrame([(1, 4.0, 51.0), (2, 4.1, 51.1)], "vertex_id long, lon double, lat double")
    e = spark.createDataFrame([(7, 1, 2, [], {"highway": "path"})], "edge_id long, tail long, head long, shape array<struct<lon:double,lat:double>>, attrs map<string,string>")
    features = {(r.kind, r.id): json.loads(r.feature) for r in geojson.network_features(v, graph.full_shape(e, v)).collect()}
    kinds = sorted(f["geometry"]["type"] for f in features.values())
    assert kinds == ["LineString", "Point", "Point"]
    line = next(f for f in features.values() if f["geometry"]["type"] == "LineString")
    assert line["type"] == "Feature" and line["geometry"]["coordinates"] == [[4.0, 51.0], [4.1, 51.1]]


def test_restrictions_keep_all_members(spark):
    from waymark.sources import osm

    edges = spark.createDataFrame([(k, 10 + k, k, k + 1) for k in range(5)] + [(7, 17, 9, 1)], "edge_id long, way long, tail long, head long")
    tags = {"type": "restriction", "restriction": "no_entry"}
    rows = [
        (1, [("way", 10, "from"), ("way", 11, "via"), ("way", 12, "via"), ("way", 13, "to")], tags),
        (2, [("way", 10, "from"), ("way", 17, "from"), ("node", 1, "via"), ("way", 11, "to")], tags),
        (3, [("way", 12, "from"), ("way", 11, "via"), ("way", 10, "to"), ("way", 17, "to")], tags),
    ]
    got = osm.restrictions(spark.createDataFrame(rows, "id long, members array<struct<type:string,id:long,role:string>>, tags map<string,string>"), edges)
    assert sorted((r.vertex_id, r.from_edge, r.to_edge, list(r.prefix)) for r in got.collect()) == [(1, 0, 1, []), (1, 1, 0, [2]), (1, 1, 7, [2]), (1, 7, 1, []), (3, 2, 3, [0, 1])]


TURNS = "vertex_id long, from_edge long, to_edge long, cost long, attrs map<string,string>, prefix array<long>"


def test_graded_turn_costs(spark):
    """A dear turn is avoided where the way round is cheaper, and paid where it is not; both engines agree."""
    from waymark.operators.profiles import Profile

    lights = Profile("lights", {"residential": 50}, turn_weight=lambda a: F.when(a["type"] == "lights", 5), forbids=lambda a: a["type"] == "bar")
    rows = [(1, 1, 2, 2, {"type": "lights"}, []), (1, 2, 1, 2, {"type": "lights"}, []), (9, 1, 2, 1, {"type": "bar"}, []), (9, 1, 2, 0, {"type": "bar"}, []), (9, 1, 3, 1, {"type": "none"}, [])]
    turns = graph.forbidden_turns(spark.createDataFrame(rows, TURNS), lights)
    assert sorted((r.vertex_id, r.from_edge, r.to_edge, r.penalty) for r in turns.where("vertex_id = 1").collect()) == [(1, 1, 2, 10), (1, 2, 1, 10)]
    assert [(r.from_edge, r.penalty) for r in turns.where("vertex_id = 9").collect()] == [(1, None)]
    for dear, cost, path in ((3, 3.0, [3]), (30, 12.0, [1, 2])):
        arcs = arcs_of(spark, [(1, 0, 1, 1), (2, 1, 2, 1), (3, 0, 2, dear), (4, 0, 7, 0), (5, 2, 8, 0)])
        r = route(spark, arcs, (4, 0, 5, 65535, False, None), turns)[0]
        assert r.cost == cost and [a >> 1 for a in r.path] == [4, *path, 5]
        sources = spark.createDataFrame([(0,)], "source long")
        key = lambda df: sorted((r.source, r.arc_id, r.cost) for r in df.collect())
        assert key(routing.arc_tree(arcs, sources, turns)) == key(routing.relax_arcs(arcs, sources, turns))
        assert {r.vertex_id: r.cost for r in routing.vertex_costs(arcs, sources, turns).collect()}[2] == cost
    # The same turn under a prefix costs only after it.
    late = turns.where("vertex_id = 1").withColumn("prefix", F.array(F.lit(6).cast("long")))
    arcs = arcs_of(spark, [(1, 0, 1, 1), (2, 1, 2, 1), (6, 5, 0, 1), (7, 6, 0, 1)])
    assert route(spark, arcs, (6, 0, 2, 65535, True, None), late)[0].cost == 13.0
    assert route(spark, arcs, (7, 0, 2, 65535, True, None), late)[0].cost == 3.0


def random_graph(spark, seed):
    import random

    rnd = random.Random(seed)
    edges = [(e, *rnd.sample(range(15), 2), rnd.randrange(1, 20)) for e in range(1, 40)]
    arcs = arcs_of(spark, edges).where("forward or edge_id % 4 <> 0")
    bar = [(t, a, b, None if k % 2 else 7) for k, ((a, _, t, _), (b, *_)) in enumerate(zip(edges, edges[5:]))]  # noqa: B905
    return edges, arcs, spark.createDataFrame(bar, "vertex_id long, from_edge long, to_edge long, penalty long")


def test_routes_beyond_the_bound_agree(spark, monkeypatch):
    edges, arcs, turns = random_graph(spark, 8)
    spec = "query_id long, from_edge long, from_offset long, to_edge long, to_offset long, from_forward boolean, to_forward boolean"
    asked = [(k, edges[k][0], 20_000, edges[(7 * k + 3) % 39][0], 40_000, (None, True, False)[k % 3], (None, None, True)[k % 3]) for k in range(39)] + [(50, 1, 10, 1, 65_000, None, None), (51, 1, 65_000, 1, 10, True, True), (52, 999, 0, 1, 0, None, None), (53, None, 0, 1, 0, None, None)]
    q = spark.createDataFrame(asked, spec)
    # Of paths with equal costs and numbers of arcs, each may take its own.
    rows = lambda df: sorted((r.query_id, r.error, None if r.cost is None else round(r.cost, 6), len(r.path), r.offset1, r.offset2) for r in df.collect())
    for most in (None, 30.0):
        kernel = rows(routing.routes(arcs, q, turns, max_cost=most))
        monkeypatch.setattr(routing, "BROADCAST_ARCS", 3)
        assert rows(routing.routes(arcs, q, turns, max_cost=most)) == kernel
        monkeypatch.undo()
        assert len(kernel) == len(asked) and any(r[1] is None for r in kernel)


@pytest.mark.parametrize("size", [1, 3, 100])
def test_tiled_search_agrees_with_one_graph(spark, size):
    """Parts of one, three and all vertices; turns with penalties, bars, and prefixes over several borders."""
    from waymark.operators.tiled import tiled_tree

    edges, arcs, turns = random_graph(spark, 21)
    turns = turns.withColumn("prefix", F.array().cast("array<long>"))
    by_end = {}
    for e, t, h, _ in edges:
        by_end.setdefault(h, []).append((e, t))
    late = [(h, e, f, None if e % 2 else 9, [d]) for e, t, h, _ in edges for d, _ in by_end.get(t, ())[:2] for f, u, _, _ in edges if u == h and f not in (e, d)]
    longer = [(h, e, f, 5, [c, d]) for e, t, h, _ in edges for d, u in by_end.get(t, ())[:2] for c, _ in by_end.get(u, ())[:1] for f, w, _, _ in edges[::3] if w == h]
    spec = "vertex_id long, from_edge long, to_edge long, penalty long, prefix array<long>"
    every = turns.unionByName(spark.createDataFrame(late[:60] + longer[:40], spec))
    sources = spark.createDataFrame([(k,) for k in (0, 3, 3, 7, None, 999)], "source long")
    parts = spark.createDataFrame([(v, v // size) for v in range(15)], "vertex_id long, part long")
    key = lambda df: sorted((r.source, r.arc_id, r.cost) for r in df.collect())
    want = key(routing.arc_tree(arcs, sources, every))
    got = tiled_tree(arcs, sources, every, parts)
    assert key(got) == want and len(want) > 100
    # The arc before an arc is one that ends where it begins, at a lesser cost.
    rows = {(r.source, r.arc_id): r for r in got.collect()}
    ends = {r.arc_id: (r.from_v, r.to_v) for r in arcs.collect()}
    assert all(ends[r.prev_arc][1] == ends[r.arc_id][0] and rows[r.source, r.prev_arc].cost <= r.cost for r in rows.values() if r.prev_arc is not None)
    assert key(tiled_tree(arcs, sources, None, parts)) == key(routing.arc_tree(arcs, sources))
    assert key(tiled_tree(arcs, sources, None, parts, max_cost=15)) == [x for x in key(routing.arc_tree(arcs, sources)) if x[2] <= 15]


def test_island_test_of_single_edges(spark):
    """Small networks with known answers: (edges as (edge, tail, head, one-way), bars, greatest size, what each edge is)."""
    from waymark.operators.islands import island_test

    cases = [
        ([(1, 1, 2, 0)], [], 1024, {1: True}),
        ([(1, 1, 2, 0), (2, 2, 3, 0)], [], 2, {1: False, 2: False}),
        ([(1, 1, 2, 0), (2, 2, 3, 0)], [(2, 1, 2)], 2, {1: True, 2: True}),
        ([(1, 1, 2, 0), (2, 2, 3, 0)], [], 3, {1: True}),
        ([(1, 1, 2, 1), (2, 2, 3, 1)], [], 2, {1: True}),
        ([(1, 1, 2, 1), (2, 2, 3, 1), (3, 3, 1, 1)], [], 3, {1: False}),
        ([(1, 1, 2, 0), (2, 2, 3, 1), (3, 3, 4, 1), (4, 4, 2, 1)], [], 4, {1: False, 2: False, 3: False, 4: False}),
        ([(1, 1, 2, 1), (2, 2, 3, 0), (3, 3, 1, 0)], [], 3, {1: False, 2: False, 3: False}),
        ([(1, 1, 2, 0), (2, 2, 3, 0), (3, 3, 1, 0), (4, 4, 5, 0)], [], 3, {1: False, 4: True, 99: None}),
        ([(1, 1, 2, 0), (2, 2, 3, 1), (3, 3, 4, 0)], [], 3, {1: True, 3: True}),
    ]
    for edges, bars, most, want in cases:
        arcs = arcs_of(spark, [(e, t, h, 1) for e, t, h, _ in edges]).where(~F.col("arc_id").isin([2 * e + 1 for e, *_, one in edges if one]))
        turns = spark.createDataFrame(bars, "vertex_id long, from_edge long, to_edge long") if bars else None
        asked = spark.createDataFrame([(e,) for e in want] * 2 + [(None,)], "edge_id long")
        assert {r.edge_id: r.on_island for r in island_test(arcs, asked, turns, max_size=most).collect()} == want
    _, arcs, turns = random_graph(spark, 8)
    small = {r.edge_id for r in routing.islands(arcs, turns, max_size=5).collect()}
    asked = arcs.select("edge_id")
    assert {r.edge_id: r.on_island for r in island_test(arcs, asked, turns, max_size=5).collect()} == {r.edge_id: r.edge_id in small for r in asked.distinct().collect()}
    assert island_test(arcs, asked.limit(0), turns).count() == 0


def test_backward_searches_agree(spark):
    edges, arcs, turns = random_graph(spark, 11)
    spec = "query_id long, from_edge long, from_offset long, to_edge long, to_offset long, from_forward boolean, to_forward boolean"
    q = spark.createDataFrame([(k, edges[k][0], 20_000, edges[k % 3][0], 40_000, (None, True, False)[k % 3], (None, False)[k % 2]) for k in range(39)], spec)
    rows = lambda df: sorted((r.query_id, r.error, None if r.cost is None else round(r.cost, 6), len(r.path), r.offset1, r.offset2) for r in df.collect())
    assert rows(routing.routes_to(arcs, q, turns)) == rows(routing.routes(arcs, q, turns))


def test_matrix_is_all_single_routes(spark):
    edges, arcs, turns = random_graph(spark, 9)
    side = lambda first: spark.createDataFrame([(f"p{k}", edges[k][0], 1000 * k) for k in range(first, first + 6)], "id string, edge long, offset long")
    a, b = side(0), side(10)
    got = {(r.source_id, r.target_id): (None if r.cost is None else round(r.cost, 6), len(r.path)) for r in routing.place_matrix(arcs, a, b, turns).collect()}
    single = routing.routes(arcs, routing.many_to_many(a, b), turns).collect()
    assert got == {(r.query_id.source_id, r.query_id.target_id): (None if r.cost is None else round(r.cost, 6), len(r.path)) for r in single} and len(got) == 36


def test_snap_takes_profiles_and_islands(spark):
    from waymark.operators.profiles import PEDESTRIAN

    n = network(spark)
    steps = n.edges.withColumn("attrs", F.when(F.col("edge_id") == 1, F.create_map(F.lit("highway"), F.lit("steps"))).otherwise(F.col("attrs")))
    point = spark.createDataFrame([(1, (P[0][0] + 2 * P[1][0]) / 3, (P[0][1] + 2 * P[1][1]) / 3)], "query_id long, lon double, lat double")
    at = lambda *profiles, **kw: graph.snap(point, n.vertices, steps, *profiles, max_distance=500.0, wide=800.0, **kw).first()
    assert at().edge_id == at(PEDESTRIAN).edge_id == 1 and at(CAR).edge_id == 2 and at(CAR, PEDESTRIAN, any_profile=True).edge_id == 1
    assert at(islands=spark.createDataFrame([(1,)], "edge_id long")).edge_id == 2
    assert at(CAR, islands=spark.createDataFrame([(2,), (3,)], "edge_id long")).error is not None
    assert at(CAR, orthogonal=True).edge_id is None or at(CAR, orthogonal=True).distance_m >= at(CAR).distance_m
    near = spark.createDataFrame([(1, *P[0])], "query_id long, lon double, lat double")
    assert graph.snap_to_vertex(near, n.vertices, radius=900.0).first().vertex_id == 0
    assert graph.snap_to_vertex(near, n.vertices, steps, CAR, radius=900.0).first().vertex_id != 0


def test_turn_cost_tables_and_deletion(spark):
    n = network(spark)
    spec = "vertex_id long, attrs map<string,string>, edges array<long>, matrix array<array<long>>, prefix array<long>"
    big = spark.createDataFrame([(1, {}, list(range(15)), [[1] * 15] * 15, [])], spec)
    with pytest.raises(ValueError):
        mutate.add_turn_costs(n, big)
    n = mutate.add_turn_costs(n, spark.createDataFrame([(1, {"a": "b"}, [1, 2], [[0, 3], [0, 0]], []), (3, {}, [2, 3], [[0, 1], [1, 0]], [1])], spec))
    assert sorted((r.vertex_id, r.from_edge, r.to_edge, r.cost) for r in n.turn_costs.collect()) == [(1, 1, 2, 3), (3, 2, 3, 1), (3, 3, 2, 1)]
    gone = mutate.delete_edges(n, spark.createDataFrame([(1,)], "edge_id long"))
    assert gone.turn_costs.count() == 0 and gone.edges.count() == 2
    assert mutate.delete_edges(n, spark.createDataFrame([(3,)], "edge_id long")).turn_costs.count() == 1
    assert mutate.clear(n).edges.count() == 0 and mutate.clear(n).version == n.version + 1


def test_replaced_tiles_leave_no_loose_ends(spark):
    v = spark.createDataFrame([(1, 4.0, 51.0, 7), (2, 4.1, 51.0, 8), (3, 4.2, 51.0, 8)], "vertex_id long, lon double, lat double, tile_id long")
    spec = "edge_id long, tail long, head long, shape array<struct<lon:double,lat:double>>, attrs map<string,string>, length_cm long"
    e = spark.createDataFrame([(k, t, h, [], {}, 1) for k, (t, h) in enumerate([(1, 2), (2, 1), (2, 3), (3, 2)])], spec)
    turns = spark.createDataFrame([(1, 1, 0, 5, {}, []), (2, 2, 1, 5, {}, []), (2, 3, 2, 5, {}, [])], TURNS)
    n = Network(v, e, turns)
    new_v = spark.createDataFrame([(9, 4.0, 51.0, 7)], v.schema)
    new_e = spark.createDataFrame([(20, 9, 2, [], {}, 1)], spec)
    got = mutate.replace_tiles(n, new_v, new_e)
    ids = {r.vertex_id for r in got.vertices.collect()}
    assert ids == {2, 3, 9} and {r.edge_id for r in got.edges.collect()} == {2, 3, 20}
    assert all({r.tail, r.head} <= ids for r in got.edges.collect())
    assert [(r.vertex_id, r.from_edge) for r in got.turn_costs.collect()] == [(2, 3)]
    same = mutate.replace_tiles(n, spark.createDataFrame([(1, 4.0, 51.0, 7)], v.schema), new_e.limit(0))
    assert {r.edge_id for r in same.edges.collect()} == {1, 2, 3}


def test_snapshot_keeps_meta_and_is_written_once(spark, tmp_path):
    from waymark.storage import has_tiles, has_vertices, read_types

    n = network(spark)
    n = Network(n.vertices, n.edges, n.turn_costs, spark.createDataFrame([("name", "town")], "key string, value string"), 4)
    write_snapshot(n, str(tmp_path))
    back = read_snapshot(spark, str(tmp_path), 4)
    assert [tuple(r) for r in back.meta.collect()] == [("name", "town")] and back.version == 4
    assert read_types(spark, str(tmp_path), 4).count() == 2
    with pytest.raises(ValueError):
        write_snapshot(n, str(tmp_path))
    with pytest.raises(ValueError):
        read_snapshot(spark, str(tmp_path), 5)
    asked = spark.createDataFrame([(0,), (77,)], "vertex_id long")
    assert {r.vertex_id: r.found for r in has_vertices(back, asked).collect()} == {0: True, 77: False}
    tile = back.vertices.select(geo.tile_id(F.col("lon"), F.col("lat")).alias("tile_id")).first().tile_id
    assert {r.tile_id: r.found for r in has_tiles(back, spark.createDataFrame([(tile,), (5,)], "tile_id long")).collect()} == {tile: True, 5: False}


def test_tile_stream_survives_a_repeated_batch(spark, tmp_path):
    import glob

    from waymark.streaming.tiles import load_tiles, loaded_edges

    spec = "edge_id long, tail long, head long, tile long, crosses boolean"
    write = lambda rows: spark.createDataFrame(rows, spec).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: load_tiles(spark, f"{tmp_path}/in", spec, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    write([(1, 1, 2, 10, False), (2, 2, 3, 10, True)])
    run()
    assert {r.edge_id for r in loaded_edges(spark, f"{tmp_path}/out").collect()} == {1}
    write([(2, 2, 3, 11, True), (3, 3, 4, 11, False), (1, 1, 2, 10, False)])
    run()
    want = {1, 2, 3}
    assert {r.edge_id for r in loaded_edges(spark, f"{tmp_path}/out").collect()} == want
    # The last batch is run again, as after a failure before its commit.
    last = max(glob.glob(f"{tmp_path}/check/commits/[0-9]*"), key=lambda p: int(p.rsplit("/", 1)[1]))
    for p in (last, last.replace("/commits/", "/commits/.") + ".crc"):
        if os.path.exists(p):
            os.remove(p)
    run()
    assert sorted(r.edge_id for r in loaded_edges(spark, f"{tmp_path}/out").collect()) == sorted(want)


def test_tags_by_ontology_and_missing_nodes(spark):
    things = spark.createDataFrame([(1, {"u:a": "v:1", "u:b": "v:2", "free": "x"}), (2, {})], "id long, tags map<string,string>")
    mapping = spark.createDataFrame([("u:a", "highway", "v:1", "path"), ("u:b", "highway", None, None)], "uri string, key string, value_uri string, value string")
    got = {r.id: r.tags for r in osm.map_tags(things, mapping).collect()}
    assert got[1] == {"highway": "path", "free": "x"} and not got[2]
    nodes = spark.createDataFrame([(1, 4.0, 51.0, {}), (2, 4.1, 51.0, {})], "id long, lon double, lat double, tags map<string,string>")
    ways = spark.createDataFrame([(10, [1, 2], {"highway": "path"}), (11, [2, 3], {"highway": "path"})], "id long, nodes array<long>, tags map<string,string>")
    assert osm.import_network(nodes, ways).edges.count() == 1
    assert [tuple(r) for r in osm.missing_ends(nodes, ways).collect()] == [(11, 3)]
    with pytest.raises(ValueError):
        osm.import_network(nodes, ways, strict=True)


def test_features_of_routes_places_and_boxes(spark):
    import json

    from waymark.sources import geojson

    n = network(spark)
    shaped = graph.full_shape(n.edges, n.vertices)
    factors = spark.createDataFrame([(1, {"highway": "car"})], "edge_id long, properties map<string,string>")
    got = {(r.kind, r.id): json.loads(r.feature) for r in geojson.network_features(n.vertices, shaped, factors, spark.createDataFrame([(1,)], "edge_id long")).collect()}
    assert got["edge", 1]["properties"] == {"highway": "car", "_edge_id": "1", "_island": "true"} and got["edge", 2]["properties"]["_island"] == "false"
    r = spark.createDataFrame([(5, [(4.0, 51.0), (4.1, 51.1)])], "query_id long, shape array<struct<lon:double,lat:double>>")
    assert json.loads(geojson.route_features(r).first().feature)["geometry"]["coordinates"] == [[4.0, 51.0], [4.1, 51.1]]
    assert r.select(geojson.wkt_line(F.col("shape"))).first()[0] == "LINESTRING (4.0 51.0, 4.1 51.1)"
    f = json.loads(geojson.place_features(spark.createDataFrame([(1, 1, 0)], "query_id long, edge_id long, offset int"), shaped).first().feature)
    assert f["geometry"] == {"type": "Point", "coordinates": list(P[0])} and f["properties"] == {"edge_id": "1", "offset": "0"}
    box = spark.createDataFrame([(3, P[0][0], P[0][1])], "query_id long, lon double, lat double").select("query_id", geo.box_around(F.col("lon"), F.col("lat"), F.lit(100.0)).alias("box"))
    assert sorted((x.kind, x.id) for x in geojson.box_features(n.vertices, shaped, box).collect()) == [("edge", 1), ("vertex", 0)]
    assert spark.range(1).select(geojson.table_attributes(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(None).cast("int"))).alias("t")).first().t == {"a": "1"}


def test_settings_and_texts():
    import json

    from waymark.operators.instructions import Line
    from waymark.operators.texts import DEFAULT_SETTINGS, Settings, Texts

    values = lambda **kw: (lambda key: kw.get(key.replace(".", "at_").replace("+", "to_")))
    en = Texts(DEFAULT_SETTINGS["languages"]["en"])
    assert en(values(type="turn", turndegrees="-87", to_name="Klaverstraat")) == "Turn right on Klaverstraat"
    assert en(values(type="base", turndegrees="3", at_name="A", to_name="B")) == "Continue on A onto B"
    assert en(values(type="base", turndegrees="3", at_name="A", to_name="A")) == "Continue on A"
    assert en(values(type="roundabout", turndegrees="10", exitnumber="9")) == "Go straight on the roundabout by taking the 9th exit"
    assert en(values(type="other")) == "Could not generate an instruction for other"
    assert Texts("Turn $turnDegrees around, so you are at $tUrnDeGReEs")(values(turndegrees="42")) == "Turn 42 around, so you are at 42"
    assert Texts("Take the ${exitNumber}th exit")(values(exitnumber="5")) == "Take the 5th exit"
    with pytest.raises(KeyError):
        Texts("$missing")(values())
    with pytest.raises(ValueError):
        Texts({"turn": "x"})(values(type="base"))
    rules = Texts({"*": "rest", "$startDegrees>=-45&$startDegrees<=45": "north", "BASE": {"$a=1": "one", "*": "more $x"}, "extensions": {"x": {"$a!=2": "$y", "*": "two"}, "y": "why"}})
    assert [rules(values(type=t, a=a, startdegrees=s)) for t, a, s in (("z", None, "0"), ("base", "1", None), ("base", "2", None), ("base", "3", "50"), ("z", None, "n"))] == ["north", "one", "more two", "more why", "rest"]
    mine = lambda r, k: ("turn", k, k, 7, {}) if k == 1 else None
    loaded = Settings.load(json.dumps({"generators": ["start", "mine"], "languages": {"xx": {"*": "$type $turnDegrees"}}}), {"mine": mine})
    assert loaded.generators == ("start", mine) and list(loaded.languages) == ["xx"]
    with pytest.raises(ValueError):
        Settings.load({"generators": ["nothing"], "languages": {}})
    assert Line([(0.0, 0.0), (0.0, 1.0)], [{}, {}]).last == 1


def test_positions_and_descriptions(spark):
    shape = [(4.0, 51.0), (4.0, 51.001), (4.0, 51.002), (4.0, 51.003)]
    built = spark.createDataFrame(
        [(1, shape, [(2, 5, True, '{"name":"a"}', 200.0, 20.0), (3, 6, True, '{"name":"b"}', 111.0, 11.0)])],
        "query_id long, shape array<struct<lon:double,lat:double>>, meta array<struct<shape_idx:int,edge_id:long,forward:boolean,attrs:string,metres:double,seconds:double>>",
    )
    at = routes.positions(built)
    rows = at.orderBy("shape_idx").collect()
    assert [(r.shape_idx, r.meta_idx, round(r.distance_at, 3), round(r.time_at, 3)) for r in rows] == [(0, 0, 0.0, 0.0), (1, 0, 100.0, 10.0), (2, 0, 200.0, 20.0), (3, 1, 311.0, 31.0)]
    found = routes.until(at, F.col("meta.edge_id") == 6).orderBy("shape_idx").collect()
    assert [r.found_idx for r in found] == [3, 3, 3, None]
    assert [r.found_idx for r in routes.until(at, F.col("shape_idx") < 2, forward=False).orderBy("shape_idx").collect()] == [None, 0, 1, 1]
    asked = spark.createDataFrame([(1, 1, 3)], "query_id long, first int, last int")
    r = routes.distances_between(at, asked).first()
    assert (round(r.metres, 3), round(r.seconds, 3)) == (211.0, 21.0)
    paths = spark.createDataFrame([(1, [2, 5], 10, 20), (2, [], None, None)], "query_id long, path array<long>, offset1 int, offset2 int")
    assert [r.text for r in routes.describe(paths).orderBy("query_id").collect()] == ["10 1+ 2- 20", "no path"]


def test_bearings_types_boxes_and_global_ids(spark):
    from waymark.operators.profiles import PEDESTRIAN, prepare

    n = network(spark)
    shaped = graph.full_shape(n.edges, n.vertices)
    spec = "query_id long, from_edge long, from_offset int, from_bearing double, to_edge long, to_offset int, to_bearing double"
    q = spark.createDataFrame([(1, 1, 30_000, 70.0, 3, 30_000, None), (2, 1, 30_000, 250.0, 3, 30_000, 100.0), (3, 1, 30_000, 160.0, 3, 0, None)], spec)
    got = {r.query_id: (r.from_forward, r.to_forward, r.error) for r in places.forced_directions(q, shaped, tolerance=60.0).collect()}
    assert got == {1: (True, None, None), 2: (False, False, None), 3: (None, None, "no departure in that direction")}

    typed, types, factors = prepare(n.edges.withColumn("attrs", F.map_concat("attrs", F.create_map(F.lit("name"), F.col("edge_id").cast("string")))), CAR, PEDESTRIAN)
    assert types.count() == 2 and factors.count() == 4 and typed.select("type_id").distinct().count() == 2
    assert prepare(n.edges, CAR)[2].where("fwd_factor > 0").count() == 2

    box = lambda *v: F.struct(*[F.lit(float(x)).alias(c) for x, c in zip(v, ("left", "bottom", "right", "top"))])  # noqa: E731, B905
    none = F.when(F.lit(False), box(0, 0, 0, 0))
    one = spark.range(1).select(geo.box_union(box(0, 1, 2, 3), box(-1, 2, 1, 5)).alias("u"), geo.box_union(none, box(1, 1, 2, 2)).alias("v"), geo.box_union(none, none).alias("w")).first()
    assert tuple(one.u) == (-1, 1, 2, 5) and tuple(one.v) == (1, 1, 2, 2) and one.w is None
    assert tuple(shaped.where("edge_id = 1").select(geo.box_of(F.col("points")).alias("b")).first().b) == (P[0][0], P[0][1], P[1][0], P[1][1])

    e = spark.createDataFrame([(77, 5, 0, 3)], "edge_id long, way long, first_k int, last_k int")
    asked = spark.createDataFrame([("5:0:3",), ("5:0:4",)], "global_id string")
    assert {r.global_id: r.edge_id for r in osm.edges_of_global(e, asked).collect()} == {"5:0:3": 77, "5:0:4": None}
    parts = asked.select(osm.global_parts(F.col("global_id")).alias("p")).first().p
    assert tuple(parts) == (5, 0, 3) and asked.select(osm.global_parts(F.lit("x:1")).alias("p")).first().p is None


def test_restriction_over_a_via_way_in_parts(spark):
    edges = spark.createDataFrame([(1, 10, 0, 0, 1), (2, 11, 0, 1, 2), (3, 11, 1, 2, 3), (4, 12, 0, 3, 4), (5, 13, 0, 2, 9)], "edge_id long, way long, first_k int, tail long, head long")
    rel = [(1, [("way", 10, "from"), ("way", 11, "via"), ("way", 12, "to")], {"type": "restriction", "restriction": "no_right_turn"}), (2, [("way", 12, "from"), ("way", 11, "via"), ("way", 13, "to")], {"type": "restriction", "restriction": "no_left_turn"})]
    got = osm.restrictions(spark.createDataFrame(rel, "id long, members array<struct<type:string,id:long,role:string>>, tags map<string,string>"), edges)
    assert sorted((r.vertex_id, r.from_edge, r.to_edge, list(r.prefix)) for r in got.collect()) == [(2, 3, 5, [4]), (3, 3, 4, [1, 2])]


def test_extra_attributes(spark):
    n = network(spark)
    q = spark.createDataFrame([(7, 1, 0, 3, 65535)], "query_id long, from_edge long, from_offset long, to_edge long, to_offset long")
    on_path = routes.path_edges(routing.routes(graph.cost_arcs(n.edges, CAR), q))
    shaped = graph.full_shape(n.edges, n.vertices).select("edge_id", "points", "attrs", "length_cm")
    speeds = n.edges.select("edge_id", *CAR.factors(F.col("attrs"))[2:4])
    extra = {"way": F.col("edge_id"), "kind": F.when(F.col("edge_id") == 2, "two")}
    got = {r.edge_id: r.attrs for r in routes.pieces(on_path, shaped, speeds, extra).collect()}
    assert got[2] == {"highway": "residential", "way": "2", "kind": "two"} and got[1] == {"highway": "residential", "way": "1"}


def test_tiles_config_islands_and_log(spark, tmp_path):
    from dataclasses import replace

    from waymark.log import set_log_action
    from waymark.sources import geojson
    from waymark.storage import Config

    n = network(spark)
    osm.write_tiles(n, f"{tmp_path}/tiles", zoom=14)
    whole = osm.tile_tables(n)
    tiles = sorted(r.tile for r in whole["vertices"].select("tile").distinct().collect())
    back = osm.read_tiles(spark, f"{tmp_path}/tiles", tiles[0], tiles[-1])
    assert {k: back[k].count() for k in back} == {k: whole[k].count() for k in whole}
    assert osm.read_tiles(spark, f"{tmp_path}/tiles", tiles[0], tiles[0])["vertices"].where(F.col("tile") != tiles[0]).count() == 0
    assert "PushedFilters: [IsNotNull(tile)" in back["vertices"]._jdf.queryExecution().toString()
    near = spark.createDataFrame([P[0]], "lon double, lat double")
    assert {r.tile for r in osm.tiles_around(near, 50.0).collect()} & set(tiles)
    geojson.write_features(geojson.network_features(n.vertices, graph.full_shape(n.edges, n.vertices), preprocess=lambda a: F.map_filter(a, lambda k, _: k == "none")), f"{tmp_path}/features")
    assert spark.read.text(f"{tmp_path}/features").count() == 7 and spark.read.text(f"{tmp_path}/features").where("value like '%highway%'").count() == 0

    assert Config.of(n) == Config() and Config.of(replace(n, meta=Config(12, 64).meta(spark))) == Config(12, 64)
    heard = []
    set_log_action(lambda *m: heard.append(m))
    try:
        first = {r.edge_id: r.size for r in routing.island_table(n, CAR, f"{tmp_path}/islands", max_size=16).collect()}
        count = len(heard)
        again = {r.edge_id: r.size for r in routing.island_table(n, CAR, f"{tmp_path}/islands", max_size=16).collect()}
    finally:
        set_log_action(None)
    assert first == again and set(first) == {1, 2, 3} and count == len(heard) and any("islands of car" in m[2] for m in heard)
