"""Columns computed in Python from one text column, batch by batch, with all other columns passed through as Arrow has them.

Ids never become pandas numbers, which would round large ones beside a null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Batches of texts of 4 MB instead of 64: executors hold some copies of each outside their heaps.  A setting of the user's own stays."""
    if spark.conf.get(_BATCH_BYTES, None) in ("67108864b", "64m", "64MB", "67108864"):
        spark.conf.set(_BATCH_BYTES, "4m")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most so many rows, and about so many bytes on the average: what a worker holds as Python objects."""
    for b in batches:
        step = max(1, min(rows, b.num_rows * size // max(b.nbytes, 1)))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def derive(df: DataFrame, column: str, make: Callable[[list], Sequence[Sequence]], spec: str) -> DataFrame:
    """``df`` without ``column``, and with the columns of ``spec``: ``make`` gets the values of ``column`` and gives one list for each of them."""
    small_batches(df.sparkSession)
    added = StructType.fromDDL(spec)
    schema = StructType([f for f in df.schema if f.name != column] + list(added))
    kept = [f.name for f in df.schema if f.name != column]
    types = list(to_arrow_schema(added).types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            made = [pa.array(values, t) for values, t in zip(make(b.column(column).to_pylist()), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *made], names=schema.names)

    return df.mapInArrow(run, schema)
