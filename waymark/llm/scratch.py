"""Intermediate tables in the folder that all executors share.

Iterative and multi-pass operators cut their lineage here: a table is written as Parquet
and read again, so that a lost executor costs a re-read and not a recomputation.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a temporary folder if driver and executors are one process, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = getattr(spark, "_waymark_scratch", None)
        if base is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = spark._waymark_scratch = "file://" + tempfile.mkdtemp(prefix="waymark-")
            atexit.register(_remove_local, base)
    return base.rstrip("/")


def _remove_local(base: str) -> None:
    import shutil

    shutil.rmtree(base.removeprefix("file://"), ignore_errors=True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a frame that reads it."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    # What is written needs its shuffle files no more: Spark may delete them when the job ends.
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._waymark_path = path
    if (made := _MADE.get()) is not None:
        made.add(path)
    return out


#: Paths of the tables made within :func:`own_tables` of this thread.
_MADE: ContextVar[set[str] | None] = ContextVar("made", default=None)


@contextlib.contextmanager
def own_tables() -> Iterator[set[str]]:
    """Notes the tables that are made within, and no others: what is not dropped by then can be swept by name."""
    made: set[str] = set()
    before = _MADE.set(made)
    try:
        yield made
    finally:
        _MADE.reset(before)


def sweep(spark: SparkSession, made: set[str], keep: DataFrame | None = None) -> None:
    """Delete the tables of ``made`` that are left, but that of ``keep``: results that read them must have been written by then."""
    for path in made - {getattr(keep, "_waymark_path", None)}:
        _delete(spark, path)
        made.discard(path)


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def drop(df: DataFrame) -> None:
    """Delete a table made by :func:`materialize` that no later step reads."""
    path = getattr(df, "_waymark_path", None)
    if path:
        _delete(df.sparkSession, path)
        if (made := _MADE.get()) is not None:
            made.discard(path)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
