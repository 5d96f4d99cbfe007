"""Instructions on routes made of legs (bearing, metres), one for each supplier: roundabouts, bends and crossings, whose texts SQL can say."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators import instructions
from waymark.operators.texts import Settings

_STEP = 180 / (math.pi * geo.RADIUS)


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("query_id"))


def _leg(bearing: Column, metres: float) -> Column:
    return F.struct(bearing.cast("double").alias("b"), F.lit(float(metres)).alias("m"))


def _ahead(at: Column, leg: Column) -> Column:
    turned = F.radians(leg["b"])
    return F.struct((at["lon"] + leg["m"] * F.sin(turned) / F.cos(F.radians(at["lat"])) * _STEP).alias("lon"), (at["lat"] + leg["m"] * F.cos(turned) * _STEP).alias("lat"))


def _routes(asked: DataFrame, legs: Column, attrs: Column) -> DataFrame:
    """Routes of the legs, a meta for each; ``attrs``: leg number -> attributes as JSON."""
    start = F.struct((F.lit(4.7) + F.col("query_id") * 0.001).alias("lon"), F.lit(51.2).alias("lat"))
    rows = asked.withColumn("legs", legs)
    shape = F.aggregate("legs", F.array(start), lambda done, leg: F.concat(done, F.array(_ahead(F.element_at(done, -1), leg))))
    rows = rows.withColumn("shape", shape)
    meta = F.transform("legs", lambda leg, i: F.struct((i + 1).alias("shape_idx"), i.cast("long").alias("edge_id"), F.lit(True).alias("forward"), attrs(i).alias("attrs"), leg["m"].alias("metres"), (leg["m"] / 10).alias("seconds")))
    return rows.withColumn("meta", meta)


def drill_roundabouts(spark, sf_dir):
    """Roundabouts with up to four exits before the one taken, left in all directions; at some, a way leaves where the ring begins."""
    asked = _asked(spark, sf_dir)
    q = F.col("query_id")
    into, passed = (q % 8) * 45 + 0.5, (q % 5).cast("int")
    out = into + (q % 11) * 30 - 150.5
    ring = F.transform(F.sequence(F.lit(0), passed), lambda i: _leg(into + 60 + i * 20, 10))
    legs = F.concat(F.array(_leg(into, 50), _leg(into, 50)), ring, F.array(_leg(out, 60), _leg(out, 60)))
    attrs = lambda i: F.when(i < 2, '{"name":"In","highway":"primary"}').when(i <= passed + 2, '{"junction":"roundabout","highway":"primary"}').otherwise('{"name":"Out","highway":"primary"}')
    r = _routes(asked, legs, attrs)
    leaves = lambda k: (k > 2) & (k <= passed + 2) | (k == 2) & (q % 3 == 0)
    inner = F.filter(F.transform("shape", lambda p, i: F.struct(i.cast("int").alias("shape_idx"), (p["lon"] + 0.0001).alias("lon"), p["lat"].alias("lat"))), lambda b: leaves(b["shape_idx"]))
    found = instructions.instructions(r.withColumn("branches", inner))
    return found.where("type = 'roundabout'").select("query_id", "shape_idx", "shape_idx_end", "turn_degrees", "exit_number", F.col("texts")["en"].alias("text"))


def drill_bends(spark, sf_dir):
    """Bends of four to seven small turns, to the left and to the right: alone, with a way on the outer side, and with one on the inner side that ends them early."""
    asked = _asked(spark, sf_dir)
    q = F.col("query_id")
    into, turns = (q % 8) * 45 + 0.25, (q % 4 + 3).cast("int")
    each = F.when(q % 2 == 0, -17.5).otherwise(17.5)
    legs = F.concat(F.array(_leg(into, 60)), F.transform(F.sequence(F.lit(1), turns), lambda i: _leg(into + each * i, 15)), F.array(_leg(into + each * (turns + 1), 80)))
    r = _routes(asked, legs, lambda i: F.lit('{"name":"Bend","highway":"residential"}'))

    def way(at: Column, side: Column) -> Column:
        there = _ahead(F.get("shape", at), _leg(into + each * (at - 1) + F.signum(each) * side, 30))
        return F.array(F.struct(at.alias("shape_idx"), there["lon"].alias("lon"), there["lat"].alias("lat")))

    sides = F.when(q % 3 == 1, way(F.lit(2), F.lit(-60.0))).when(q % 3 == 2, way(turns, F.lit(60.0))).otherwise(F.array().cast("array<struct<shape_idx:int,lon:double,lat:double>>"))
    found = instructions.instructions(r.withColumn("branches", sides))
    return found.where("type = 'followbend'").select("query_id", "shape_idx", "shape_idx_end", "turn_degrees", F.col("texts")["en"].alias("text"))


def drill_crossings(spark, sf_dir):
    """Which of the ways at a crossing is taken, counted from the left; other ways count by the direction from which they come."""
    asked = _asked(spark, sf_dir)
    q = F.col("query_id")
    into = (q % 8) * 45 + 0.25
    taken = (q % 5) * 40 - 80.5
    r = _routes(asked, F.array(_leg(into, 60), _leg(into + taken, 60), _leg(into + taken, 60)), lambda i: F.concat(F.lit('{"name":"W'), i.cast("string"), F.lit('"}')))
    ways = F.filter(F.array(*[F.struct(F.lit(float(a)).alias("a")) for a in (-105, -65, -25, 25, 65, 105)]), lambda w: F.pmod(F.abs(w["a"]) + q, F.lit(3)) != 0)
    corner = F.col("shape")[1]
    ahead = lambda w: _ahead(corner, F.struct((into + w["a"]).alias("b"), F.lit(30.0).alias("m")))
    other = F.transform(ways, lambda w: F.struct(F.lit(1).alias("shape_idx"), ahead(w)["lon"].alias("lon"), ahead(w)["lat"].alias("lat")))
    settings = Settings(("start", "intersection"), {"en": {"intersection": "way $rank of $ways", "*": "$type"}})
    found = instructions.instructions(r.withColumn("branches", other), settings=settings, gaps=True)
    return found.where("type = 'intersection'").select("query_id", "shape_idx_end", "turn_degrees", F.size("roads").alias("n_roads"), F.col("texts")["en"].alias("text"))


QUERIES = {f.__name__: f for f in (drill_roundabouts, drill_bends, drill_crossings)}

_LR = "CASE WHEN t <= -135 THEN 'sharply right' WHEN t <= -65 THEN 'right' WHEN t <= -25 THEN 'slightly right' WHEN t < 25 THEN 'straight' WHEN t < 65 THEN 'slightly left' WHEN t < 135 THEN 'left' ELSE 'sharply left' END"

ORACLES = {
    "drill_roundabouts": f"""WITH x AS (SELECT s_suppkey AS q, s_suppkey % 5 AS n, s_suppkey % 5 + (s_suppkey % 3 = 0)::INT + 1 AS x, trunc(150.5 - (s_suppkey % 11) * 30)::INT AS t FROM supplier),
y AS (SELECT *, ['first exit', 'second exit', 'third exit', 'fourth exit', 'fifth exit', 'sixth exit'][x] AS ex FROM x)
SELECT q AS query_id, 1::INT AS shape_idx, (n + 4)::INT AS shape_idx_end, t AS turn_degrees, x::INT AS exit_number, CASE WHEN t > 155 THEN 'Turn around on the roundabout by taking the ' || ex ELSE 'Go ' || {_LR} || ' on the roundabout by taking the ' || ex END AS text FROM y""",
    "drill_bends": f"""WITH x AS (SELECT s_suppkey AS q, s_suppkey % 4 + 4 - (s_suppkey % 3 = 2)::INT AS e, CASE WHEN s_suppkey % 2 = 0 THEN 17 ELSE -17 END AS one FROM supplier), y AS (SELECT q, e, one * (e - 1) AS t FROM x WHERE e > 3)
SELECT q AS query_id, 1::INT AS shape_idx, e::INT AS shape_idx_end, t::INT AS turn_degrees, 'Follow Bend which bends ' || {_LR} AS text FROM y""",
    "drill_crossings": """WITH x AS (SELECT s_suppkey AS q, trunc(80.5 - s_suppkey % 5 * 40)::INT AS own, list_filter([-105, -65, -25, 25, 65, 105], lambda a: (abs(a) + s_suppkey) % 3 <> 0) AS ways FROM supplier)
SELECT q AS query_id, 2::INT AS shape_idx_end, own AS turn_degrees, (len(ways) + 1)::INT AS n_roads, 'way ' || len(list_filter(ways, lambda a: CASE WHEN a > 0 THEN 180 - a ELSE -180 - a END >= own)) || ' of ' || (len(ways) + 1) AS text FROM x""",
}
