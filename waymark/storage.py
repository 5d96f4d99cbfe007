"""Intermediate and versioned tables in shared storage."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a temporary folder if driver and executors are one process, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = getattr(spark, "_waymark_graph_scratch", None)
        if base is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="waymark-graph-")
            atexit.register(shutil.rmtree, folder, True)
            base = spark._waymark_graph_scratch = f"file://{folder}"
    return base.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write once, read again."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._waymark_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table made by :func:`materialize` that no later step reads."""
    if path := getattr(df, "_waymark_path", None):
        hadoop = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def numbered(df: DataFrame, *order: str, start: int = 1) -> DataFrame:
    """Rows with ``id`` from ``start`` without gaps, in the order of ``order``: sorted by ranges, each of which counts from where those before it end."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(ranged.select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_place")), "numbered")
    before, at = {}, start
    # As many rows as ranges.
    for r in sorted(placed.groupBy("_range").count().collect()):
        before[r["_range"]], at = at, at + r["count"]
    first = df.sparkSession.createDataFrame(list(before.items()), "_range int, _first long")
    return placed.join(F.broadcast(first), "_range").select(*df.columns, (F.col("_first") + F.col("_place")).alias("id"))


TABLES = ("vertices", "edges", "turn_costs", "meta")


@dataclass(frozen=True)
class Network:
    """One snapshot: vertices(vertex_id, lon, lat), edges(edge_id, tail, head, shape, attrs, length_cm), turn_costs(vertex_id, from_edge, to_edge, cost, attrs), meta(key, value)."""

    vertices: DataFrame
    edges: DataFrame
    turn_costs: DataFrame
    meta: DataFrame | None = None
    version: int = 0


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def write_snapshot(network: Network, path: str, types: DataFrame | None = None) -> None:
    """A version is a folder that is written once: one that is complete is an error, what a broken writer left is replaced.

    ``types`` holds the distinct attribute sets with their ids, by default those of a new dictionary; ``meta`` comes last and marks the version as complete.
    """
    from waymark.functions.attributes import dictionary

    spark, folder = network.vertices.sparkSession, f"{path}/v={network.version}"
    _new_version(spark, path, network.version)
    for name in TABLES[:-1]:
        getattr(network, name).write.mode("overwrite").parquet(f"{folder}/{name}")
    (dictionary(network.edges) if types is None else types).write.mode("overwrite").parquet(f"{folder}/types")
    meta = network.meta if network.meta is not None else spark.createDataFrame([], "key string, value string")
    meta.write.mode("overwrite").parquet(f"{folder}/meta")


def _new_version(spark: SparkSession, path: str, version: int) -> None:
    if exists(spark, f"{path}/v={version}/meta/_SUCCESS"):
        raise ValueError(f"version {version} is there already")


@dataclass(frozen=True)
class Changes:
    """What a version adds to the one before it and what it takes away; rows of an id that goes and comes replace the old ones."""

    vertices: DataFrame | None = None
    edges: DataFrame | None = None
    turn_costs: DataFrame | None = None
    #: vertex_id; their edges are not touched.
    gone_vertices: DataFrame | None = None
    #: edge_id; turn costs that name them go, too, unless they come with this version or a later one.
    gone_edges: DataFrame | None = None
    meta: DataFrame | None = None


def write_changes(spark: SparkSession, changes: Changes, path: str, base: int, version: int) -> None:
    """A version that holds nothing but what differs from version ``base``: as large as the change.

    Attribute sets that are new get the ids after those in use.  Later versions have greater numbers.
    """
    from waymark.functions.attributes import dictionary

    if version <= base:
        raise ValueError(f"version {version} does not come after {base}")
    _new_version(spark, path, version)
    before, folder = versions(spark, path, base), f"{path}/v={version}"
    for name in ("vertices", "edges", "turn_costs", "gone_vertices", "gone_edges"):
        rows = getattr(changes, name)
        if rows is not None:
            key = {"gone_vertices": "vertex_id", "gone_edges": "edge_id"}.get(name)
            (rows if key is None else rows.select(key).distinct()).write.mode("overwrite").parquet(f"{folder}/{name}")
    if changes.edges is not None:
        dictionary(changes.edges, known=read_types(spark, path, base)).write.mode("overwrite").parquet(f"{folder}/types")
    meta = changes.meta if changes.meta is not None else spark.read.parquet(f"{path}/v={before[-1]}/meta")
    spark.createDataFrame([(base,)], "base long").write.mode("overwrite").parquet(f"{folder}/base")
    meta.write.mode("overwrite").parquet(f"{folder}/meta")


def versions(spark: SparkSession, path: str, version: int) -> list[int]:
    """The versions that a version is read from, the whole one first."""
    out = [version]
    while True:
        if not exists(spark, f"{path}/v={out[0]}/meta/_SUCCESS"):
            raise ValueError(f"there is no complete version {out[0]}")
        if not exists(spark, f"{path}/v={out[0]}/base/_SUCCESS"):
            return out
        out.insert(0, spark.read.parquet(f"{path}/v={out[0]}/base").first()["base"])


def read_snapshot(spark: SparkSession, path: str, version: int) -> Network:
    """A version as one network, read from the whole one that it goes back to and the changes since."""
    from waymark.operators.mutate import _without_edges

    chain = versions(spark, path, version)
    read = lambda v, name: spark.read.parquet(f"{path}/v={v}/{name}")
    if len(chain) == 1:
        return Network(*(read(version, name) for name in TABLES), version)

    def every(name: str, extra: str) -> DataFrame | None:
        found = None
        for v in chain:
            if exists(spark, f"{path}/v={v}/{name}/_SUCCESS"):
                part = read(v, name).withColumn(extra, F.lit(v))
                found = part if found is None else found.unionByName(part, allowMissingColumns=True)
        return found

    def left(name: str, key: str) -> DataFrame:
        rows, gone = every(name, "_came"), every(f"gone_{name}", "_went")
        if gone is None:
            return rows.drop("_came")
        last = gone.groupBy(key).agg(F.max("_went").alias("_went"))
        return rows.join(last, key, "left").where("_went is null or _went <= _came").drop("_came", "_went")

    turns, gone = None, every("gone_edges", "_went")
    for v in chain:
        if exists(spark, f"{path}/v={v}/turn_costs/_SUCCESS"):
            part = read(v, "turn_costs")
            if gone is not None and v < version:
                part = _without_edges(part, gone.where(F.col("_went") > v).select("edge_id").distinct())
            turns = part if turns is None else turns.unionByName(part, allowMissingColumns=True)
    return Network(left("vertices", "vertex_id"), left("edges", "edge_id"), turns, read(version, "meta"), version)


def compact(spark: SparkSession, path: str, version: int, to: int) -> None:
    """Version ``version`` again as a whole one under the number ``to``: the same rows, and the same ids of attribute sets."""
    network = read_snapshot(spark, path, version)
    write_snapshot(Network(network.vertices, network.edges, network.turn_costs, network.meta, to), path, read_types(spark, path, version))


@dataclass(frozen=True)
class Config:
    """Settings that belong to a network: the zoom of its tiles and the size below which parts count as islands."""

    zoom: int = 14
    max_island_size: int = 1024

    def meta(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([("zoom", str(self.zoom)), ("max_island_size", str(self.max_island_size))], "key string, value string")

    @classmethod
    def of(cls, network: Network) -> Config:
        """As the network's meta says, defaults elsewhere."""
        rows = [] if network.meta is None else network.meta.where(F.col("key").isin("zoom", "max_island_size")).collect()
        return cls(**{r["key"]: int(r["value"]) for r in rows})


def read_types(spark: SparkSession, path: str, version: int) -> DataFrame:
    """The dictionary of attribute sets of a version: text, type_id.  Ids stay from version to version."""
    found = None
    for v in versions(spark, path, version):
        if exists(spark, f"{path}/v={v}/types/_SUCCESS"):
            part = spark.read.parquet(f"{path}/v={v}/types")
            found = part if found is None else found.unionByName(part)
    return found


def has_vertices(network: Network, asked: DataFrame) -> DataFrame:
    """Rows of ``asked`` (vertex_id, ...) with ``found``."""
    known = network.vertices.select("vertex_id").distinct().withColumn("known", F.lit(True))
    return asked.join(known, "vertex_id", "left").withColumn("found", F.coalesce("known", F.lit(False))).drop("known")


def has_tiles(network: Network, asked: DataFrame, zoom: int = 14) -> DataFrame:
    """Rows of ``asked`` (tile_id, ...) with ``found``: whether a vertex lies in the tile."""
    from waymark.functions.geo import tile_id

    known = network.vertices.select(tile_id(F.col("lon"), F.col("lat"), zoom).alias("tile_id")).distinct().withColumn("known", F.lit(True))
    return asked.join(known, "tile_id", "left").withColumn("found", F.coalesce("known", F.lit(False))).drop("known")
