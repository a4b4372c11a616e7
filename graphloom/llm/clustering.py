"""Centroid clustering: identical quantised vectors are one weighted vector, Lloyd's rounds use exact integers."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_by_heat

DIMS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
#: Largest size of a quantised component: with it, a squared distance of 64 components fits in 63 bits.
LARGEST = 1 << 27
#: Distinct vectors whose assignments (48 bytes each) a broadcast may hold; of more, the most frequent ones.
BROADCAST_VECTORS = 200_000


def quantise(vector: str, dims: int = DIMS, scale: int = SCALE) -> tuple[Column, Column]:
    """Whether a vector has ``dims`` finite components, and floor(``scale`` * x) of each."""
    x = F.col(vector)
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf")))
    good = F.coalesce((F.size(x) == dims) & F.forall(x, finite), F.lit(False))

    def one(v: Column) -> Column:
        y = F.floor(v.cast("double") * F.lit(float(scale)))
        return F.when(F.abs(v.cast("double")) * scale < LARGEST, y.cast("int")).otherwise(F.raise_error(F.lit("a component is too large for a distance of 63 bits")).cast("int"))

    return good, F.transform(x, one)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of, and squared distance to, the nearest centroid; the smaller number on a tie."""
    far = np.stack([((x - c) ** 2).sum(axis=1) for c in centroids])
    best = far.argmin(axis=0)
    return best, far[best, np.arange(len(x))]


def _blocks(batch: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors ``q`` and weights ``n`` of a batch."""
    q = batch.column(batch.schema.get_field_index("q")).flatten().to_numpy().astype(np.int64).reshape(-1, dims)
    return q, batch.column(batch.schema.get_field_index("n")).to_numpy()


def _sums(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's weighted integer sums: a row for each centroid that has vectors, whatever the task has read."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x, n = _blocks(batch, dims)
            best, _ = _nearest(x, centroids)
            np.add.at(weight, best, n)
            np.add.at(total, best, x * n[:, None])
        some = np.flatnonzero(weight)
        sums = pa.array(total[some].tolist(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(weight[some], pa.int64()), sums], ["cluster", "n", "sums"])

    return run


def _assigned(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, _ = _blocks(batch, centroids.shape[1])
            best, far = _nearest(x, centroids)
            columns = [*batch.columns, pa.array(best, pa.int32()), pa.array(far, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "cluster", "distance"])

    return run


def lloyd(distinct: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids after ``rounds`` rounds over distinct vectors ``q`` with weights ``n``; empty ones stay.

    A round sends the few centroids out and gets as many integer sums back, combined
    by an aggregate.  It ends early when nothing moves, as further rounds are the same.
    """
    dims = centroids.shape[1]
    for _ in range(rounds):
        parts = distinct.select("q", "n").mapInArrow(_sums(centroids), "cluster int, n long, sums array<long>")
        sums = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dims)]
        moved = centroids.copy()
        for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect():  # a row for each centroid
            moved[r.cluster] = [r[f"s{i}"] // r.n for i in range(dims)]
        if (moved == centroids).all():
            break
        centroids = moved
    return centroids


def cluster_vectors(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    dims: int = DIMS,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    seed: int = SEED,
    most: int | None = None,
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, n_same`` of every usable vector.

    Vectors are quantised to integers, and identical ones grouped with their number
    (``n_same``), combined before the shuffle.  Lloyd's rounds run over the distinct
    ones, in exact integers, from the vectors whose ids have the smallest hashes.
    Assignments are joined back by two 64-bit hashes of the vector, after a check
    that no two distinct vectors share both; else by the vector itself.  The most
    frequent vectors' assignments are broadcast (``most`` of them), so a vector that
    many rows have is no task's group; the other ones are merged by a shuffle.

    Vectors that are null, of another length, or with null or non-finite components
    go.  Rows that share an id are clustered each for itself; null ids are clustered
    but start a centroid only after all others (ties of a start: by the vector).
    With fewer vectors than ``clusters`` there are as many centroids as vectors.
    A component of 2**27 quantised units or more is an error.  An empty table gives
    an empty result; other columns are ignored.
    """
    most = BROADCAST_VECTORS if most is None else most
    good, q = quantise("_v", dims, scale)
    kept = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("_v")).where(good).select("vec_id", q.alias("q"))
    start = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.select(start.alias("s"), "q").orderBy(F.asc_nulls_last("s"), "q").limit(clusters).collect()
    if not first:
        null = {"cluster": "int", "distance": "long", "cluster_inertia": "long", "inertia": "long", "centroid_sha256": "string", "n_same": "long"}
        return kept.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in null.items()]).limit(0)

    hashes = [F.xxhash64("q").alias("h1"), F.xxhash64(F.lit(seed), "q").alias("h2")]
    distinct = cut(kept.groupBy("q").agg(F.count(F.lit(1)).alias("n")).select("q", "n", *hashes))
    centroids = lloyd(distinct, np.array([r.q for r in first], np.int64), rounds)
    known = cut(distinct.mapInArrow(_assigned(centroids), "q array<int>, n long, h1 long, h2 long, cluster int, distance long"))

    sums = {r.cluster: r.s for r in known.groupBy("cluster").agg(F.sum(F.col("n") * F.col("distance")).alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    named = [(k, s, sum(sums.values()), digest[k]) for k, s in sums.items()]
    named = kept.sparkSession.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # a row for each centroid

    alone = known.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty()
    on = ["h1", "h2"] if alone else ["q"]
    table = known.select(*on, F.col("n").alias("n_same"), "cluster", "distance")
    rows = kept.select("vec_id", *(hashes if alone else ["q"]))
    found = join_by_heat(rows, table, on, "n_same", most).join(F.broadcast(named), "cluster")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_same")
