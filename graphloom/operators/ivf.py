"""Inverted-file vector index: k-means cells as partitions, two quantised dimensions a byte, integer inner products."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .vector import top_k

#: Rows that cells are fitted to, at most; every row is indexed.
SAMPLE = 65_536
#: Cells of an index, at most; their centroids are read by the driver.
MOST_CELLS = 4096
#: Codes, and queries, of a cell that meet in one task of a search for many queries.
CHUNK, QUERIES = 32_768, 4096
#: Largest level of a code: levels -7 to 7 as 1 to 15 in half a byte.
LEVEL = 7


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def packed_code(vector: str) -> tuple[Column, Column, Column, Column]:
    """Code (two dimensions a byte), scale, distance of the code's vector from the real one, and that vector's length."""
    x = F.transform(vector, lambda v: v.cast("double"))
    scale = F.greatest(F.array_max(F.transform(x, lambda v: F.abs(v))) / LEVEL, F.lit(1e-30))
    level = lambda v: F.round(v / scale).cast("int")
    digits = F.transform(x, lambda v: F.substr(F.lit("0123456789abcdef"), level(v) + LEVEL + 2, F.lit(1)))
    text = F.array_join(digits, "")
    code = F.unhex(F.when(F.size(vector) % 2 == 1, F.concat(text, F.lit("8"))).otherwise(text))
    off = F.transform(x, lambda v: F.pow(v - level(v) * scale, F.lit(2.0)))
    return code, scale, F.sqrt(_sum(off)), F.sqrt(_sum(F.transform(x, lambda v: F.pow(level(v) * scale, F.lit(2.0)))))


def levels(codes: list[bytes], dims: int) -> np.ndarray:
    """Levels of packed codes, a row each."""
    raw = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    return (np.stack([raw >> 4, raw & 15], axis=2).reshape(len(codes), -1)[:, :dims]).astype(np.int32) - (LEVEL + 1)


def _whole(query: np.ndarray) -> tuple[np.ndarray, float]:
    """A query as 8-bit integers, and their unit."""
    unit = max(float(np.abs(query).max()) / 127, 1e-30)
    return np.rint(query / unit).astype(np.int32), unit


@dataclass(frozen=True)
class IvfIndex:
    """``cells(cell, centroid, radius, n)``, ``codes(id, code, scale, off, length, cell)`` and ``vectors(id, embedding, cell)`` of a folder."""

    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def centroids(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers, centroids and radii of the cells that have rows."""
        rows = self.table("cells").orderBy("cell").collect()  # MOST_CELLS at most
        return np.array([r.cell for r in rows]), np.array([r.centroid for r in rows], np.float64), np.array([r.radius for r in rows])


def build_ivf(vectors: DataFrame, path: str, *, id_col: str = "vec_id", vector_col: str = "embedding", cells: int | None = None, sample: int = SAMPLE, seed: int = 5) -> IvfIndex:
    """An index of ``vectors`` under ``path``: codes and vectors in a partition for each cell.

    Cells are the clusters that Spark's k-means finds in the ``sample`` rows whose ids
    have the least hashes; by default as many as the root of the number of rows.  Rows
    without a vector aren't indexed; an empty table can't be.  A cell with many rows is
    written by several tasks.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("embedding")).where("embedding is not null")
    rows = rows.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
    if cells is None:
        cells = max(1, min(MOST_CELLS, math.isqrt(rows.count())))
    picked = rows.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample).select("features")
    model = KMeans(k=max(2, cells), seed=seed, maxIter=12, predictionCol="cell").fit(picked)
    centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    centres = spark.createDataFrame(centres, "cell int, centroid array<double>")
    placed = model.transform(rows).drop("features").hint("rebalance", "cell")
    placed.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    written = spark.read.parquet(f"{path}/vectors")
    code, scale, off, length = packed_code("embedding")
    codes = written.select("id", code.alias("code"), scale.alias("scale"), off.alias("off"), length.alias("length"), "cell")
    codes.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/codes")
    apart = F.zip_with("embedding", "centroid", lambda a, b: F.pow(a.cast("double") - b, F.lit(2.0)))
    radius = F.max(F.sqrt(_sum(apart))).alias("radius")
    sizes = written.join(F.broadcast(centres), "cell").groupBy("cell").agg(radius, F.count(F.lit(1)).alias("n"))
    centres.join(sizes, "cell").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    return IvfIndex(spark, path)


def _rough(codes: DataFrame, query: np.ndarray, most: int | None, least: float) -> DataFrame:
    """``id, cell, rough`` by integer inner products: the ``most`` best of each batch, or all that can reach ``least``."""
    ints, unit = _whole(query)
    kind = codes.schema["id"].dataType.simpleString()
    lost = float(np.linalg.norm(query - ints * unit))
    length = float(np.linalg.norm(query))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            col = lambda c: batch.column(batch.schema.get_field_index(c))
            rough = (levels(col("code").to_pylist(), len(ints)) @ ints) * col("scale").to_numpy() * unit
            if most is None:
                keep = np.flatnonzero(rough + length * col("off").to_numpy() + lost * col("length").to_numpy() + 1e-6 >= least)
            else:
                keep = np.argpartition(-rough, min(most, len(rough)) - 1)[:most]
            rows = pa.array(keep)
            yield pa.RecordBatch.from_arrays([col("id").take(rows), col("cell").take(rows), pa.array(rough[keep])], ["id", "cell", "rough"])

    return codes.mapInArrow(run, f"id {kind}, cell int, rough double")


def ivf_top_k(index: IvfIndex, query: list[float], k: int = 5, *, probe: int | None = None, over: int = 10, sure: bool = False) -> DataFrame:
    """``id, score`` of the ``k`` best by inner product among the ``probe`` nearest cells (a third by default), ties by id.

    Only the partitions of these cells are read: codes first, of which ``over * k`` rows
    go on, then the vectors of those.  With ``sure`` the result is exact: further cells
    are read whose centroid and radius allow a better score than the ``k``-th found, and
    of their codes all rows whose distance from their vectors allows one.
    """
    q = np.array(query, np.float64)
    number, centre, radius = index.centroids()
    near = centre @ q
    order = np.argsort(-near, kind="stable")
    some = order[: probe or max(1, -(-len(order) // 3))]

    def best(cells: np.ndarray, most: int | None, least: float = 0.0) -> DataFrame:
        here = F.col("cell").isin([int(c) for c in number[cells]])
        pool = _rough(index.table("codes").where(here), q, most, least)
        pool = pool if most is None else pool.orderBy(F.desc("rough"), "id").limit(most)
        found = index.table("vectors").where(here).join(pool.select("id", "cell") if most is None else F.broadcast(pool.select("id", "cell")), ["id", "cell"], "left_semi")
        return top_k(found, query, k, -1e300, "id")

    first = best(some, over * k)
    if not sure:
        return first.select("id", "score")
    scores = [r.score for r in first.select("score").collect()]
    least = min(scores) if len(scores) == k else -math.inf
    cells = np.flatnonzero(near + np.linalg.norm(q) * radius + 1e-6 >= least)
    return best(cells, None, least).select("id", "score")


def ivf_neighbours(index: IvfIndex, queries: DataFrame, k: int = 10, *, probe: int | None = None, over: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query, rank, id, score``: the ``k`` best of each query other than itself, through the nearest ``probe`` cells (three quarters by default).

    Queries go to the cells that they probe; a cell's codes meet them in chunks, so no
    task has a whole cell.  ``over * k`` rows of a query's rough scores go on to exact ones.
    """
    number, centre, _ = index.centroids()
    probe = probe or max(1, -(-3 * len(number) // 4))
    dims = centre.shape[1]
    kind = queries.schema[id_col].dataType.simpleString()

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                q = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)
                cells = number[np.argsort(-(q @ centre.T), axis=1, kind="stable")[:, :probe]]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(cells), pa.list_(pa.int32()))], ["query", "q", "cells"])

    asked = queries.where(F.size(vector_col) == dims).select(F.col(id_col).alias("query"), F.col(vector_col).cast("array<double>").alias("q"))
    asked = asked.mapInArrow(probed, f"query {kind}, q array<double>, cells array<int>").select("query", "q", F.explode("cells").alias("cell"))
    sizes = index.table("cells").select("cell", F.ceil(F.col("n") / F.lit(CHUNK)).cast("int").alias("chunks"))
    wanted = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(QUERIES)).cast("int").alias("blocks"))
    plan = F.broadcast(sizes.join(wanted, "cell"))  # MOST_CELLS rows at most
    spread = lambda df, own, n, other, m, key: df.join(plan, "cell").withColumn(own, F.pmod(F.xxhash64(key), F.col(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(m) - 1)))
    codes = spread(index.table("codes"), "chunk", "chunks", "block", "blocks", "id").select("cell", "chunk", "block", "id", "code", "scale")
    asked_at = spread(asked, "block", "blocks", "chunk", "chunks", "query").select("cell", "chunk", "block", "query", "q")
    rows = over * k

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query": right["query"].slice(0, 0), "id": left["id"].slice(0, 0), "rough": pa.array([], pa.float64())})
        x, scale, ids = levels(left["code"].to_pylist(), dims), left["scale"].to_numpy(), left["id"].combine_chunks()
        asked_, found, score = [], [], []
        for query, q in zip(right["query"].to_pylist(), right["q"].to_pylist(), strict=True):
            ints, unit = _whole(np.array(q))
            rough = (x @ ints) * scale * unit
            top = np.argpartition(-rough, min(rows, len(rough)) - 1)[:rows]
            asked_ += [query] * len(top)
            found.append(top)
            score.append(rough[top])
        return pa.table({"query": pa.array(asked_, right.schema.field("query").type), "id": ids.take(pa.array(np.concatenate(found))), "rough": np.concatenate(score)})

    out = f"query {kind}, id {index.table('codes').schema['id'].dataType.simpleString()}, rough double"
    key = ["cell", "chunk", "block"]
    met = codes.groupBy(*key).cogroup(asked_at.groupBy(*key)).applyInArrow(meet, out)
    rank = lambda by: F.row_number().over(Window.partitionBy("query").orderBy(F.desc(by), "id"))  # noqa: E731  over at most as many rows as chunks allow
    pool = met.where("query <> id").withColumn("r", rank("rough")).where(F.col("r") <= rows).select("query", "id")
    exact = pool.join(index.table("vectors").select("id", "embedding"), "id").join(asked.select("query", "q").dropDuplicates(["query"]), "query")
    score = _sum(F.zip_with("embedding", "q", lambda a, b: a.cast("double") * b)).alias("score")
    return exact.select("query", "id", score).withColumn("rank", rank("score")).where(F.col("rank") <= k).select("query", "rank", "id", "score")
