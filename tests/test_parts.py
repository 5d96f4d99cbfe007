"""Things that arrive in parts, in any order, over restarts."""

import glob
import os
import random
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F

from waymark.sources import osm
from waymark.storage import Network
from waymark.streaming.parts import load_parts, loaded_network, tile_parts


def imported(spark):
    """A street of ten nodes over several tiles with side streets, a barrier, and restrictions over a node and over a way."""
    at = [(4.70 + k * 0.004, 51.20 + (k % 2) * 0.003) for k in range(10)]
    nodes = spark.createDataFrame([(k, *p, {"barrier": "bollard"} if k == 4 else {}) for k, p in enumerate(at)] + [(20 + k, at[k][0], 51.21, {}) for k in (2, 5, 7)], "id long, lon double, lat double, tags map<string,string>")
    ways = spark.createDataFrame([(10, [0, 1, 2], {"highway": "residential"}), (11, [2, 3, 4, 5], {"highway": "residential"}), (12, [5, 6, 7, 8, 9], {"highway": "service"}), (13, [2, 22], {"highway": "service"}), (14, [5, 25], {"highway": "service"}), (15, [7, 27], {"highway": "service"}), (16, [4, 27], {"highway": "service"})], "id long, nodes array<long>, tags map<string,string>")
    rel = [
        (1, [("way", 10, "from"), ("node", 2, "via"), ("way", 13, "to")], {"type": "restriction", "restriction": "no_left_turn"}),
        (2, [("way", 10, "from"), ("way", 11, "via"), ("way", 14, "to")], {"type": "restriction", "restriction": "no_left_turn"}),
        (3, [("way", 10, "from"), ("way", 11, "via"), ("way", 14, "to")], {"type": "restriction", "restriction": "no_left_turn"}),
        (4, [("way", 14, "from"), ("node", 5, "via"), ("way", 12, "to")], {"type": "restriction", "restriction": "only_left_turn"}),
    ]
    return osm.import_network(nodes, ways, spark.createDataFrame(rel, "id long, members array<struct<type:string,id:long,role:string>>, tags map<string,string>"))


def plain(n: Network):
    """Rows of all tables as sorted texts, repeated ones included."""
    text = lambda df: sorted(r[0] for r in df.select(F.to_json(F.struct(*[F.array_sort(F.map_entries(c)).alias(c) if c == "attrs" else c for c in sorted(df.columns)]))).collect())
    return [text(df) for df in (n.vertices, n.edges, n.turn_costs)]


def test_any_order_gives_the_import(spark, tmp_path):
    n = imported(spark)
    parts = tile_parts(n, 16)
    tiles = sorted(r.tile for r in parts.select("tile").distinct().collect())
    assert len(tiles) > 5 and parts.where("kind = 'turn' and of > 3").count() and parts.where("kind = 'edge' and of = 2").count()
    parts = parts.cache()
    random.Random(5).shuffle(tiles)

    def arrive(some):
        for t in some:
            parts.where(F.col("tile") == t).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        load_parts(spark, f"{tmp_path}/in", parts.schema, f"{tmp_path}/out", f"{tmp_path}/check", files_per_trigger=4).awaitTermination()

    arrive(tiles[:4])
    some = loaded_network(spark, parts.schema, f"{tmp_path}/out")
    # What is there is what tiles of before make whole, and no more.
    whole = {(r.kind, r.key) for r in parts.where(F.col("tile").isin(tiles[:4])).groupBy("kind", "key", "of").count().where("count = of").collect()}
    assert [len(x) for x in plain(some)] == [len([k for k in whole if k[0] == kind]) for kind in ("vertex", "edge", "turn")]
    # Tiles come again beside new ones, and the batch that brought them is run again, as after a failure before its commit.
    arrive([tiles[0], *tiles[4:7], tiles[2]])
    last = max(glob.glob(f"{tmp_path}/check/commits/[0-9]*"), key=lambda p: int(p.rsplit("/", 1)[1]))
    for p in (last, last.replace("/commits/", "/commits/.") + ".crc"):
        if os.path.exists(p):
            os.remove(p)
    arrive(tiles[7:])
    assert plain(loaded_network(spark, parts.schema, f"{tmp_path}/out")) == plain(n)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").find("RocksDB") < 0
    parts.unpersist()


def test_empty_networks_have_no_parts(spark):
    n = imported(spark)
    none = Network(n.vertices.limit(0), n.edges.limit(0), n.turn_costs.limit(0))
    assert tile_parts(none).isEmpty()


def test_parts_of_a_turn_are_tiles(spark):
    """What lies in one tile never waits, and what lies in two is joined without Python."""
    from waymark.plans import town

    parts = tile_parts(town.town(spark, "/root/testdata/sf0.001"), 15)
    same = parts.where("kind = 'turn'").groupBy("key").agg(F.countDistinct("tile").alias("tiles"), F.count("*").alias("n"), F.max("of").alias("of"))
    assert same.where("tiles <> of or n <> of").isEmpty() and not same.where("of = 1").isEmpty()


def test_two_parts_meet_once(spark, tmp_path, monkeypatch):
    from waymark.plans import town
    from waymark.streaming import parts as streaming

    monkeypatch.setattr(streaming._LastPart, "handleInputRows", None)
    parts = tile_parts(town.town(spark, "/root/testdata/sf0.001"), 15).where("of < 3").cache()
    for some in ("part = 0", "part = 0", "true"):
        parts.where(some).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        load_parts(spark, f"{tmp_path}/in", parts.schema, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").groupBy("kind", "key").count()
    assert got.where("count > 1").isEmpty() and got.count() == parts.select("kind", "key").distinct().count()
    parts.unpersist()
