"""Tiles that arrive over time.

Every arriving file holds rows of whole tiles.  Tiles loaded before are skipped, so the
loaded set is the table itself; crossings wait in a table of halves until both are there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.sources.osm import merge_tiles
from waymark.storage import exists


def load_tiles(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, *, files_per_trigger: int = 100):
    """Stream of Parquet files of edges (edge_id, tail, head, tile, ...) into ``target``; run it to the end of what is there.

    A batch that is tried again after a failure writes the same folders again: only tiles of
    earlier batches count as loaded.  The tiles loaded are a small table beside the edges.
    """
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)

    def append(batch: DataFrame, epoch: int) -> None:
        session = batch.sparkSession
        batch = batch.dropDuplicates(["tile", "edge_id"])
        if exists(session, f"{target}/tiles"):
            known = session.read.schema("tile long, epoch int").parquet(f"{target}/tiles").where(F.col("epoch") < epoch).select("tile").distinct()
            batch = batch.join(known, "tile", "left_anti").select(*batch.columns)
        edges = f"{target}/edges/epoch={epoch}"
        batch.write.mode("overwrite").parquet(edges)
        # Read back what was written: the batch itself is not computed twice.
        session.read.schema(batch.schema).parquet(edges).select(F.col("tile").cast("long")).distinct().coalesce(1).write.mode("overwrite").parquet(f"{target}/tiles/epoch={epoch}")

    return arriving.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def loaded_edges(spark: SparkSession, target: str) -> DataFrame:
    """Edges of all tiles so far; ``crosses`` marks halves."""
    rows = spark.read.parquet(f"{target}/edges").drop("epoch")
    return merge_tiles(rows.where(~F.col("crosses")).drop("crosses"), rows.where("crosses").drop("crosses"))
