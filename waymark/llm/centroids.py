"""Clusters of vectors by Hamerly's bounds, in whole numbers.

Every vector keeps its cluster, an upper bound of the distance to that centroid and one lower bound
of the distance to any other.  When centroids move, the upper bound grows by the own centroid's drift and the lower one
shrinks by the greatest drift of the others.  While the upper bound lies below the lower one, or below half the way from
the own centroid to the nearest other, nothing can have changed.  Otherwise the upper
bound is made exact, and a vector that is still ambiguous is compared with all centroids,
exactly.  Bounds are widened by more than their rounding, and ties count as ambiguous, so results are those of
full scans: the nearest centroid, of equals the one with the smallest number.

Vectors and bounds lie in one table, written once a round, the one before deleted then.  The driver holds the
centroids only: their sums come as one row a task and centroid, added up by Spark.

Kept are vectors of exactly ``size`` components, none null or not finite; a component x becomes floor(scale * x).
A null id is kept, and never a first centroid; rows that share an id are vectors of their own, and among the
first centroids come in the order of their components.  With fewer vectors than centroids there
are as many centroids as vectors with an id.  An empty table gives an empty result; other columns are ignored.  Integers beyond 2 ** 26
would give distances beyond a long and are an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.scratch import drop, materialize

#: Largest integer of a component: 64 squared differences of such stay below 2 ** 60.
LARGEST = 1 << 26
#: Up to this size, products of 64 components are exact as doubles, which multiply faster.
_EXACT = 1 << 22
_SLACK = 1e-9

_STATE = "vec_id long, v array<int>, cluster int, upper double, lower double"


def distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``v`` to all of ``c``."""
    if max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) <= _EXACT:
        v, c = v.astype(np.float64), c.astype(np.float64)
        return ((v * v).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c * c).sum(axis=1)[None]).astype(np.int64)
    return np.stack([((v - one) ** 2).sum(axis=1) for one in c], axis=1)


def assign(v: np.ndarray, c: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Nearest centroids with their bounds, in place; returns how many vectors needed all distances."""
    between = distances(c, c)
    np.fill_diagonal(between, np.iinfo(np.int64).max)
    half = np.sqrt(between.min(axis=1, initial=np.iinfo(np.int64).max).astype(np.float64)) / 2
    known = cluster >= 0
    sure = lambda k: upper[k] * (1 + _SLACK) < np.maximum(lower[k], half[cluster[k]]) * (1 - _SLACK)
    unsure = np.flatnonzero(known)
    unsure = unsure[~sure(unsure)]
    upper[unsure] = np.sqrt(((v[unsure] - c[cluster[unsure]]) ** 2).sum(axis=1))
    scan = np.concatenate([np.flatnonzero(~known), unsure[~sure(unsure)]])
    for part in np.array_split(scan, len(scan) // 8192 + 1):
        d = distances(v[part], c)
        cluster[part] = d.argmin(axis=1)
        upper[part] = np.sqrt(d.min(axis=1))
        d[np.arange(len(part)), cluster[part]] = np.iinfo(np.int64).max
        lower[part] = np.sqrt(d.min(axis=1).astype(np.float64))
    return len(scan)


def drifted(cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, drift: np.ndarray) -> None:
    """Bounds after the centroids have moved by ``drift``, in place."""
    order = np.argsort(drift)
    most, next_ = drift[order[-1]], drift[order[-2]] if len(drift) > 1 else 0.0
    upper += drift[cluster]
    lower -= np.where(cluster == order[-1], next_, most)


def _columns(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.int64)
    return v, *(b.column(c).to_numpy(zero_copy_only=False).copy() for c in ("cluster", "upper", "lower"))


def _round(state: DataFrame, centroids: np.ndarray, drift: np.ndarray | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, cluster, upper, lower = _columns(b)
            if drift is not None:
                drifted(cluster, upper, lower, drift)
            assign(v, centroids, cluster, upper, lower)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(cluster), pa.array(upper), pa.array(lower)], names=b.schema.names)

    return state.mapInArrow(run, _STATE)


def _means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floors of the means; a centroid without vectors stays."""
    k, size = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [[0] * size for _ in range(k)]
        counts = np.zeros(k, np.int64)
        for b in batches:
            v, cluster, *_ = _columns(b)
            for c in np.unique(cluster):
                # A batch's sums fit a long, those of a task need not.
                sums[c] = [a + s for a, s in zip(sums[c], v[cluster == c].sum(axis=0).tolist(), strict=True)]
            counts += np.bincount(cluster, minlength=k)
        used = np.flatnonzero(counts).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used]), pa.array([list(map(str, sums[c])) for c in used], pa.list_(pa.string()))], names=["cluster", "n", "sums"])

    rows = state.select("vec_id", "v", "cluster", "upper", "lower").mapInArrow(run, "cluster int, n long, sums array<string>")
    totals = rows.select("cluster", "n", F.posexplode("sums").alias("i", "s")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out = centroids.copy()
    # At most k * size rows.
    for r in totals.collect():
        out[r["cluster"], r["i"]] = int(r["s"]) // r["n"]
    return out


def vectors(table: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", size: int = 64, scale: float = 256.0) -> DataFrame:
    """The kept vectors as integers: vec_id, v."""
    x = F.transform(vector_col, lambda e: e.cast("double"))
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    whole = F.transform(x, lambda e: F.when(F.abs(e) * scale <= LARGEST, F.floor(e * F.lit(scale)).cast("int")).otherwise(F.raise_error(F.lit(f"a component times {scale} is beyond {LARGEST}")).cast("int")))
    return table.where(F.col(vector_col).isNotNull() & (F.size(vector_col) == size) & fine).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


def cluster(table: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", size: int = 64, scale: float = 256.0, k: int = 40, rounds: int = 5, salt: str = "2:") -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    unknown = [F.lit(-1).alias("cluster"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower")]
    state = materialize(vectors(table, id_col=id_col, vector_col=vector_col, size=size, scale=scale).select("vec_id", "v", *unknown), "centroids-state")
    named = state.where("vec_id is not null").select("v", F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256).alias("h"))
    first = [r["v"] for r in named.orderBy("h", "v").limit(k).collect()]
    spec = "vec_id long, cluster int, distance long"
    if not first:
        return state.limit(0).select("vec_id", "cluster", *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    centroids, drift = np.array(first, np.int64), None
    for n in range(rounds + 1):
        after = materialize(_round(state, centroids, drift), "centroids-state")
        drop(state)
        state = after
        if n < rounds:
            moved = _means(state, centroids)
            # Greater than the drift by more than its rounding.
            drift = np.sqrt(((moved - centroids) ** 2).sum(axis=1).astype(np.float64)) * (1 + _SLACK)
            centroids = moved

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, own, *_ = _columns(b)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("cluster"), pa.array(((v - centroids[own]) ** 2).sum(axis=1))], names=["vec_id", "cluster", "distance"])

    measured = materialize(state.mapInArrow(measure, spec), "centroids-distances")
    drop(state)
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    sums = {r["cluster"]: r["s"] for r in measured.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    rows = [(c, s, sum(sums.values()), shas[c]) for c, s in sums.items()]
    # As many rows as centroids.
    about = state.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return measured.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
