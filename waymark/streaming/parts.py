"""Things that arrive in parts: a crossing in two tiles, a turn whose edges lie in several.

A tile's file holds the parts that lie in it.  A thing is given out once, when the last of its
parts comes, in whatever order and however often tiles arrive.  Which parts have come is state in RocksDB on
the executors, one short list for each thing, kept in the checkpoint: a stream that starts again goes on from there and
gives nothing out twice.  Things with one part only never wait; they are told from repeated ones by their keys, and
those with two, nearly all others, are a join of the first parts with the second, both without Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from waymark.functions.geo import tile_id
from waymark.sources.osm import global_id
from waymark.storage import Network

KINDS = ("vertex", "edge", "turn")
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def tile_parts(network: Network, zoom: int = 14) -> DataFrame:
    """Every thing of a network in parts by tile: kind, key, part (from 0), of (how many there are), tile, and one of vertex, edge and turn with its columns.

    A vertex has one part, an edge one for each tile that its ends lie in.  A turn has one for each tile that its
    edges lie in, those behind it included, so it comes out when every edge that it names is whole.  Edges of
    an import are known by their global ids; equal turns are told apart by a number.
    """
    v = network.vertices.withColumn("tile", tile_id(F.col("lon"), F.col("lat"), zoom))
    at = lambda name: v.select(F.col("vertex_id").alias(name), F.col("tile").alias(f"{name}_tile"))
    ids = {"way", "first_k", "last_k"} <= set(network.edges.columns)
    key = global_id(F.col("way"), F.col("first_k"), F.col("last_k")) if ids else F.col("edge_id").cast("string")
    e = network.edges.join(at("tail"), "tail").join(at("head"), "head").select(F.col("edge_id").alias("id"), key.alias("key"), F.struct(*network.edges.columns).alias("edge"), F.array_sort(F.array_distinct(F.array("tail_tile", "head_tile"))).alias("tiles"))
    marks = F.array_join(F.transform(F.array_sort(F.map_entries("attrs")), lambda x: F.concat_ws("=", x["key"], x["value"])), ";")
    prefix = F.coalesce("prefix", F.array().cast("array<long>"))
    t = network.turn_costs.select(F.struct(*network.turn_costs.columns).alias("turn"), F.concat(prefix, F.array("from_edge", "to_edge")).alias("chain"), F.concat_ws("|", F.col("vertex_id").cast("string"), F.array_join(F.concat(prefix, F.array("from_edge", "to_edge")), ","), F.col("cost").cast("string"), marks).alias("name"))
    copies = t.groupBy("name").agg(F.first("turn").alias("turn"), F.first("chain").alias("chain"), F.count("*").alias("n"))
    where = copies.select("name", F.explode(F.array_distinct("chain")).alias("id")).join(e.select("id", "tiles"), "id").select("name", F.explode(F.transform("tiles", lambda x: F.struct(F.col("id"), x.alias("tile")))).alias("p"))
    t = copies.drop("chain").join(where.groupBy("name").agg(F.array_sort(F.collect_list("p")).alias("ps")), "name")
    t = t.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))).select(F.concat_ws("#", "name", F.col("copy").cast("string")).alias("key"), "turn", "ps")

    def rows(kind: str, df: DataFrame, tiles) -> DataFrame:
        # Payloads of the other kinds are null.
        each = df.select(F.lit(kind).alias("kind"), "key", kind, F.size(tiles).alias("of"), F.posexplode(tiles).alias("part", "tile"))
        return each.select("kind", "key", "part", "of", "tile", kind)

    out = rows("vertex", v.select(F.col("vertex_id").cast("string").alias("key"), F.struct(*network.vertices.columns).alias("vertex"), F.array("tile").alias("tiles")), F.col("tiles"))
    for kind, df, tiles in (("edge", e, F.col("tiles")), ("turn", t, F.array_sort(F.array_distinct(F.transform("ps", lambda p: p["tile"]))))):
        out = out.unionByName(rows(kind, df, tiles), allowMissingColumns=True)
    return out


class _LastPart(StatefulProcessor):
    """One row for each key, when all of its parts have come; nothing after that."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._came = handle.getValueState("came", "parts array<int>")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        came = set(self._came.get()[0]) if self._came.exists() else set()
        before, last = len(came), None
        for row in rows:
            came.add(row["part"])
            last = row
        if len(came) > before:
            self._came.update((sorted(came),))
            if len(came) == last["of"]:
                yield Row(**{c: last[c] for c in ("kind", "key", *KINDS)})

    def close(self) -> None:
        pass


def load_parts(spark: SparkSession, source: str, schema: StructType | str, target: str, checkpoint: str, *, files_per_trigger: int = 100):
    """Stream of Parquet files of :func:`tile_parts` into a table of whole things at ``target``; runs to the end of what is there.

    Its sink writes each batch once, so what is at ``target`` has neither gaps nor repeats after a failure.
    ``spark.sql.shuffle.partitions`` of the first start is the number of state partitions for good.
    """
    # A session of its own, so that the caller's settings stay as they are.
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    arriving = own.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    columns = ["kind", "key", *KINDS]
    single = arriving.where("of = 1").dropDuplicates(["kind", "key"]).select(*columns)
    spec = StructType([arriving.schema[c] for c in columns])
    half = lambda part, *c: arriving.where(f"of = 2 and part = {part}").select(*c).dropDuplicates(["kind", "key"])
    pairs = half(0, *columns).join(half(1, "kind", "key"), ["kind", "key"]).select(*columns)
    several = arriving.where("of > 2").groupBy("kind", "key").transformWithState(_LastPart(), spec, "Append", "None")
    out = single.unionByName(pairs).unionByName(several)
    return out.writeStream.format("parquet").partitionBy("kind").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def loaded_network(spark: SparkSession, schema: StructType, target: str) -> Network:
    """All that is whole so far; edges may end at vertices of tiles that are not there only while such an edge waits."""
    columns = ["key", *KINDS, "kind"]
    rows = spark.read.schema(StructType([schema[c] for c in columns])).parquet(target)
    table = lambda kind: rows.where(F.col("kind") == kind).select(f"{kind}.*")
    return Network(table("vertex"), table("edge"), table("turn"))
