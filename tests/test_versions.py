"""Versions as changes, dictionaries that grow, least types, and boxes met by lines."""

import os
import random
import sys
from dataclasses import dataclass

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.functions.attributes import dictionary
from waymark.operators import graph
from waymark.operators.profiles import BICYCLE, CAR, PEDESTRIAN, Profile, edge_factors, minimise, prepare
from waymark.storage import Changes, Network, compact, numbered, read_snapshot, read_types, versions, write_changes, write_snapshot

EDGE = "edge_id long, tail long, head long, shape array<struct<lon:double,lat:double>>, attrs map<string,string>, length_cm long"
TURN = "vertex_id long, from_edge long, to_edge long, cost long, attrs map<string,string>, prefix array<long>"


def network(spark, edges, turns=()):
    v = spark.createDataFrame([(k, 4.0 + k / 1000, 51.0) for k in range(10)], "vertex_id long, lon double, lat double")
    return Network(v, edge_rows(spark, edges), turn_rows(spark, turns), None, 1)


def edge_rows(spark, edges):
    return spark.createDataFrame([(e, e, e + 1, [], {"highway": kind} if kind else {}, cm) for e, kind, cm in edges], EDGE)


def turn_rows(spark, turns):
    return spark.createDataFrame([(0, a, b, 5, {}, prefix) for a, b, prefix in turns], TURN)


def test_a_version_is_its_changes(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    n = network(spark, [(e, "road" if e % 2 else "track", 100) for e in range(1, 9)], [(1, 2, []), (3, 4, [2]), (5, 6, []), (7, 8, None)])
    write_snapshot(n, path)
    ids = lambda df, c: sorted(r[0] for r in df.select(c).collect())
    gone = lambda *e: spark.createDataFrame([(x,) for x in (*e, *e)], "edge_id long")
    write_changes(spark, Changes(gone_edges=gone(2)), path, 1, 2)
    write_changes(spark, Changes(gone_edges=gone(5), edges=edge_rows(spark, [(2, "path", 7), (5, "road", 9), (20, "ferry", 3)]), turn_costs=turn_rows(spark, [(20, 5, [])]), gone_vertices=spark.createDataFrame([(9,)], "vertex_id long"), meta=spark.createDataFrame([("zoom", "13")], "key string, value string")), path, 2, 4)
    assert versions(spark, path, 4) == [1, 2, 4]
    two, four = read_snapshot(spark, path, 2), read_snapshot(spark, path, 4)
    assert ids(two.edges, "edge_id") == [1, 3, 4, 5, 6, 7, 8] and ids(two.turn_costs, "from_edge") == [5, 7] and two.vertices.count() == 10
    assert {r.edge_id: r.length_cm for r in four.edges.collect()} == {1: 100, 2: 7, 3: 100, 4: 100, 5: 9, 6: 100, 7: 100, 8: 100, 20: 3}
    # What named edge 5 before went with it; what came with the new one stays, as do turns without a prefix.
    assert ids(four.turn_costs, "from_edge") == [7, 20] and ids(four.vertices, "vertex_id") == list(range(9)) and four.meta.first()["value"] == "13"
    # A change is as large as what it changes.
    assert not os.path.exists(f"{tmp_path}/log/v=2/edges") and sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(f"{tmp_path}/log/v=2") for f in fs) < 20_000
    types = {r.text: r.type_id for r in read_types(spark, path, 4).collect()}
    first = {r.text: r.type_id for r in read_types(spark, path, 1).collect()}
    assert first == {t: types[t] for t in first} and sorted(types.values()) == [1, 2, 3, 4]
    compact(spark, path, 4, 5)
    five = read_snapshot(spark, path, 5)
    for a, b in ((four.vertices, five.vertices), (four.edges.withColumn("attrs", F.to_json("attrs")), five.edges.withColumn("attrs", F.to_json("attrs"))), (four.turn_costs.drop("attrs"), five.turn_costs.drop("attrs"))):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))
    assert versions(spark, path, 5) == [5] and {r.text: r.type_id for r in read_types(spark, path, 5).collect()} == types
    for bad in (lambda: write_changes(spark, Changes(), path, 4, 4), lambda: write_changes(spark, Changes(), path, 3, 9), lambda: write_changes(spark, Changes(), path, 1, 5), lambda: read_snapshot(spark, path, 3)):
        with pytest.raises(ValueError):
            bad()
    # A version may start anew from an older one, and read on after one was made whole.
    write_changes(spark, Changes(gone_edges=gone(1)), path, 5, 6)
    write_changes(spark, Changes(gone_edges=gone(1)), path, 1, 7)
    assert ids(read_snapshot(spark, path, 6).edges, "edge_id") == [2, 3, 4, 5, 6, 7, 8, 20] and ids(read_snapshot(spark, path, 7).edges, "edge_id") == list(range(2, 9))


def test_numbers_have_no_gaps(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("other")).repartition(7)
    got = numbered(rows, "k", start=5).collect()
    assert sorted((r.k, r.id) for r in got) == [(k, k + 5) for k in range(1000)] and got[0].other == "x"
    assert numbered(rows.limit(0), "k").count() == 0
    sets = spark.createDataFrame([({"a": "1", "b": "2"},), ({"b": "2", "a": "1"},), ({},), (None,), ({"c": "3"},)], "attrs map<string,string>")
    known = dictionary(sets)
    assert sorted(r.type_id for r in known.collect()) == [1, 2]
    more = dictionary(sets.unionByName(spark.createDataFrame([({"a": "0"},)], "attrs map<string,string>")), known=known)
    assert [r.type_id for r in more.collect()] == [3] and dictionary(sets, known=known).count() == 0
    assert [r.type_id for r in dictionary(sets, known=known.limit(0)).orderBy("type_id").collect()] == [1, 2]


@dataclass(frozen=True)
class Lit(Profile):
    """Reads a key that it does not declare."""

    def speed(self, attrs):
        return F.when(attrs["lit"] == "no", 0).otherwise(super().speed(attrs))


def test_least_types_cost_the_same(spark):
    rnd = random.Random(3)
    pick = lambda *x: rnd.choice(x)
    rows = [(e, {k: x for k, x in {"highway": pick("primary", "secondary", "tertiary", "footway", None), "oneway": pick("yes", "no", "-1", None), "name": pick("A", "B"), "lit": pick("no", None)}.items() if x}) for e in range(300)] + [(300, None), (301, {})]
    edges = spark.createDataFrame(rows, "edge_id long, attrs map<string,string>")
    profiles = (CAR, BICYCLE, PEDESTRIAN, Lit("lit", CAR.speeds))
    typed, types, factors = minimise(edges, *profiles)
    want = {(r.profile, r.type_id): tuple(r)[2:] for r in edge_factors(edges.select(F.col("edge_id").alias("type_id"), F.coalesce("attrs", F.create_map().cast("map<string,string>")).alias("attrs")), *profiles).collect()}
    by_type = {(r.profile, r.type_id): tuple(r)[2:] for r in factors.collect()}
    home = {r.edge_id: r.type_id for r in typed.collect()}
    assert len(home) == len(rows) and all(by_type[p, home[e]] == x for (p, e), x in want.items())
    ratings = {tuple(want[p.name, e] for p in profiles) for e, _ in rows}
    assert types.count() == len(ratings) < prepare(edges, *profiles)[1].count() + 10
    # No profile here reads names.
    plain = minimise(edges, CAR, PEDESTRIAN)[1].collect()
    assert not any({"name", "lit"} & set(r.attrs) for r in plain) and len(plain) < prepare(edges, CAR, PEDESTRIAN)[1].count()
    assert minimise(edges.limit(0), CAR)[1].count() == 0


def test_lines_meet_tiles_and_boxes(spark):
    rnd = random.Random(9)
    point = lambda: (4.7 + rnd.random() * 0.2, 51.2 + rnd.random() * 0.1)
    lines = [(k, *point(), *point()) for k in range(40)]
    lines += [(40, 4.75, 51.21, 4.75, 51.29), (41, 4.71, 51.25, 4.89, 51.25), (42, 4.8, 51.25, 4.8, 51.25)]
    df = spark.createDataFrame(lines, "k long, a double, b double, c double, d double").select("k", F.struct(F.col("a").alias("lon"), F.col("b").alias("lat")).alias("p"), F.struct(F.col("c").alias("lon"), F.col("d").alias("lat")).alias("q"))
    tiles = {r.k: r.t for r in df.select("k", geo.tiles_crossed(F.col("p"), F.col("q"), 14).alias("t")).collect()}
    steps = df.crossJoin(spark.range(2001).select((F.col("id") / 2000.0).alias("s")))
    along = lambda c: F.col(f"p.{c}") + (F.col(f"q.{c}") - F.col(f"p.{c}")) * F.col("s")
    met = {r.k: set(r.t) for r in steps.groupBy("k").agg(F.collect_set(geo.tile_id(along("lon"), along("lat"), 14)).alias("t")).collect()}
    for k, found in tiles.items():
        # Sampling may miss a corner that is cut; nothing else may differ, and no tile comes twice.
        assert met[k] <= set(found) and len(found) == len(set(found)) and len(found) <= len(met[k]) + 3
    box = F.struct(F.lit(4.0).alias("left"), F.lit(51.0).alias("bottom"), F.lit(5.0).alias("right"), F.lit(52.0).alias("top"))
    cases = [
        ((3.0, 51.5, 6.0, 51.5), True), ((4.5, 50.0, 4.5, 53.0), True), ((3.5, 51.5, 4.5, 52.5), False), ((3.5, 51.4, 4.5, 52.4), True), ((3.4, 51.5, 4.4, 52.6), False), ((3.0, 50.0, 3.9, 53.0), False),
        ((4.5, 51.5, 4.5, 51.5), True), ((4.0, 51.5, 4.0, 51.5), False), ((5.0, 52.0, 5.0, 52.0), True), ((5.0, 50.0, 5.0, 53.0), True), ((4.0, 50.0, 4.0, 53.0), False), ((3.0, 52.0, 6.0, 52.0), True), ((3.0, 51.0, 6.0, 51.0), False),
        ((4.2, 51.2, 4.3, 51.3), True), ((5.0, 51.5, 6.0, 51.5), True), ((3.0, 51.5, 4.0, 51.5), False),
    ]
    rows = spark.createDataFrame([(k, *c) for k, (c, _) in enumerate(cases)], "k long, a double, b double, c double, d double").select("k", F.struct(F.col("a").alias("lon"), F.col("b").alias("lat")).alias("p"), F.struct(F.col("c").alias("lon"), F.col("d").alias("lat")).alias("q"))
    for way in (("p", "q"), ("q", "p")):
        assert {r.k: r.m for r in rows.select("k", geo.meets_box(F.col(way[0]), F.col(way[1]), box).alias("m")).collect()} == {k: m for k, (_, m) in enumerate(cases)}
    # A long edge over a box in which it has no end, by its middle piece; the search by ends does not see it.
    v = spark.createDataFrame([(1, 4.70, 51.20), (2, 4.80, 51.20)], "vertex_id long, lon double, lat double")
    e = spark.createDataFrame([(7, 1, 2, [(4.72, 51.23), (4.78, 51.23)])], "edge_id long, tail long, head long, shape array<struct<lon:double,lat:double>>")
    asked = spark.createDataFrame([(1, 4.745, 51.229, 4.755, 51.231), (2, 4.745, 51.2, 4.755, 51.21)], "query_id long, left double, bottom double, right double, top double").select("query_id", F.struct("left", "bottom", "right", "top").alias("box"))
    assert [tuple(r) for r in graph.edges_in_boxes(v, e, asked, by_segment=True).collect()] == [(1, 7)] and graph.edges_in_boxes(v, e, asked).count() == 0
