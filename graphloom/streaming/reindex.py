"""Incremental refresh of a graph from a stream of edge files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators.model import first_edges
from graphloom.schemas import EDGES
from graphloom.sources.files import path_exists

_FIELDS = [f.split()[0] for f in EDGES.split(", ")]


def _part(parts: int) -> Column:
    """The partition of an edge, by what tells it from others."""
    return F.pmod(F.xxhash64(F.upper("src"), F.upper("dst"), "kind", F.upper("details")), F.lit(parts)).cast("int")


def merge_edges(batch: DataFrame, target: str, parts: int = 256) -> list[int]:
    """Merge a batch of edges into the table under ``target``; only partitions that it touches are read and written again.

    An edge's repeats share a partition, and the first of them stays, so merging a batch
    once more, also after half of it was committed, changes nothing.  Tells the
    partitions, ``parts`` at most.
    """
    spark = batch.sparkSession
    batch = batch.select(*_FIELDS).withColumn("part", _part(parts))
    touched = sorted(r.part for r in batch.select("part").distinct().collect())
    if not touched:
        return []
    rows = batch.drop("part")
    if path_exists(spark, target):
        rows = rows.unionByName(stored_edges(spark, target).where(F.col("part").isin(touched)).drop("part"))
    merged = first_edges(rows).select(*_FIELDS).withColumn("part", _part(parts)).hint("rebalance", "part")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(target)
    return touched


def stored_edges(spark: SparkSession, target: str) -> DataFrame:
    """The edges under ``target``, with their partition."""
    return spark.read.schema(f"{EDGES}, part int").parquet(target)


def refresh_edges(spark: SparkSession, source: str, target: str, checkpoint: str, parts: int = 256) -> StreamingQuery:
    """Merge new Parquet edge files of ``source`` into the table under ``target``, batch by batch; a repeated batch changes nothing."""
    stream = spark.readStream.schema(EDGES).parquet(source)
    merge = lambda batch, _: merge_edges(batch, target, parts) and None
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
