"""Trees on a network that is read as a search meets it: tiles of arcs lie in storage, and a superstep reads those that it reaches for the first time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.log import LOGGER
from waymark.operators.tiled import packed_parts, supersteps
from waymark.storage import drop, materialize

#: Up to this many tiles are asked for by name, which Parquet's statistics answer; more by a join.
NAMED_TILES = 1000


def write_arc_tiles(arcs: DataFrame, parts: DataFrame, path: str, turns: DataFrame | None = None) -> None:
    """Arcs (arc_id, from_v, to_v, cost) and turns of a network by part (``parts``: vertex_id, part), in the order of parts, and where vertices lie.

    An arc lies in the parts of both its ends, a turn in those that its edges, and the edges behind it, touch.
    """
    named = lambda name: parts.select(F.col("vertex_id").alias(f"{name}_v"), F.col("part").cast("long").alias(f"{name}_part"))
    rows = arcs.select("arc_id", "from_v", "to_v", F.col("cost").cast("long")).join(named("from"), "from_v").join(named("to"), "to_v")
    sides = F.array_distinct(F.array("from_part", "to_part"))
    tables = {"arcs": rows.withColumn("part", F.explode(sides)), "places": parts.select("vertex_id", F.col("part").cast("long").alias("part"))}
    if turns is not None:
        touched = rows.select(F.shiftright("arc_id", 1).alias("edge_id"), F.explode(sides).alias("part")).distinct()
        prefix = F.coalesce("prefix", F.array()).cast("array<long>") if "prefix" in turns.columns else F.array().cast("array<long>")
        penalty = F.col("penalty").cast("long") if "penalty" in turns.columns else F.lit(None).cast("long")
        full = turns.select("vertex_id", "from_edge", "to_edge", prefix.alias("prefix"), penalty.alias("penalty"))
        tables["turns"] = full.withColumn("edge_id", F.explode(F.array_distinct(F.concat("prefix", F.array("from_edge"))))).join(touched, "edge_id").drop("edge_id").distinct()
    for name, table in tables.items():
        by = ("vertex_id",) if name == "places" else ("part",)
        table.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("errorifexists").parquet(f"{path}/{name}")


class ArcTiles:
    """Tiles of :func:`write_arc_tiles`, each read and packed once, when a search first reaches it; ``asked`` has one table of parts for each reading."""

    def __init__(self, spark: SparkSession, path: str, *, turns: bool = False):
        self._spark, self._path, self._turns = spark, path, turns
        self.asked: list[DataFrame] = []
        self._graphs: list[DataFrame] = []

    def _read(self, name: str, asked: DataFrame, few: list[int] | None) -> DataFrame:
        rows = self._spark.read.parquet(f"{self._path}/{name}")
        return rows.where(F.col("part").isin(few)) if few is not None else rows.join(asked, "part", "left_semi")

    def graphs(self, reached: DataFrame) -> DataFrame:
        """Graphs of all tiles so far, those of ``reached`` (part, ...) with them."""
        asked = reached.select("part").distinct()
        if self.asked:
            asked = asked.join(reduce(DataFrame.unionByName, self.asked), "part", "left_anti")
        asked = materialize(asked, "tiles-asked")
        first = [r.part for r in asked.limit(NAMED_TILES + 1).collect()]
        if first or not self._graphs:
            few = first if len(first) <= NAMED_TILES else None
            rows = self._read("arcs", asked, few)
            ends = [rows.select(F.col(f"{e}_v").alias("vertex_id"), F.col(f"{e}_part").alias("part")) for e in ("from", "to")]
            turns = self._read("turns", asked, few).drop("part").distinct() if self._turns else None
            packed = packed_parts(rows.select("arc_id", "from_v", "to_v", "cost").distinct(), turns, ends[0].unionByName(ends[1]).distinct())
            # Neighbours that came along are not whole.
            self._graphs.append(materialize(packed.join(asked, "part", "left_semi"), "tiles-graphs"))
            drop(packed)
            self.asked.append(asked)
            LOGGER.debug("tiles read for the first time: %s", len(first) if few is not None else f"over {NAMED_TILES}")
        else:
            drop(asked)
        return reduce(DataFrame.unionByName, self._graphs)

    def close(self) -> None:
        for t in (*self.asked, *self._graphs):
            drop(t)
        self.asked, self._graphs = [], []


def tree_on_demand(tiles: ArcTiles, sources: DataFrame, *, max_cost: float | None = None, chunks: int = 8) -> DataFrame:
    """The tree of ``routing.arc_tree`` from sources (source), reading no tile that no path within ``max_cost`` enters; sources that lie nowhere have no rows."""
    places = tiles._spark.read.parquet(f"{tiles._path}/places").withColumnRenamed("vertex_id", "source")
    asked = sources.select(F.col("source").cast("long").alias("source")).where("source is not null").distinct()
    return supersteps(asked.join(places, "source"), tiles.graphs, max_cost=max_cost, chunks=chunks)
