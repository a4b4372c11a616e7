"""The stored adjacency: deduplicated edges bucketed by source and again by target, and nodes bucketed by key."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import PropertyGraph

#: Tables of a stored graph: the column that each is bucketed by, and its order in a bucket.
LAYOUT = {"out": ("src_key", ["src_key", "seq"]), "into": ("dst_key", ["dst_key", "seq"]), "nodes": ("id_key", ["id_key", "seq"])}

WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


@dataclass(frozen=True)
class StoredGraph(PropertyGraph):
    """A graph whose edges lie by source (``out``) and by target (``into``), co-partitioned with its nodes (``keyed``).

    Degrees, isolated nodes and joins of edges with nodes need no exchange of edges;
    one node's edges are read from one bucket.  ``edges`` have been deduplicated once,
    when the graph was stored.
    """

    out: DataFrame | None = None
    into: DataFrame | None = None
    keyed: DataFrame | None = None

    def keyed_nodes(self) -> DataFrame:
        return self.keyed

    def keyed_edges(self) -> DataFrame:
        return self.out

    def edge_keys(self) -> DataFrame:
        return self.out.select("src_key", "dst_key", "kind")

    def outgoing(self, node: str) -> DataFrame:
        return self.out.where(F.col("src_key") == node.upper()).drop("src_key", "dst_key")

    def incoming(self, node: str) -> DataFrame:
        return self.into.where(F.col("dst_key") == node.upper()).drop("src_key", "dst_key")

    def node(self, node: str) -> DataFrame:
        return self.keyed.where(F.col("id_key") == node.upper()).drop("id_key")

    def with_degrees(self) -> DataFrame:
        one, zero = F.count(F.lit(1)), F.lit(0).cast("bigint")
        o = self.out.groupBy("src_key").agg(one.alias("_out"))
        i = self.into.groupBy("dst_key").agg(one.alias("_in"))
        joined = self.keyed.join(i, F.col("id_key") == F.col("dst_key"), "left").join(o, F.col("id_key") == F.col("src_key"), "left")
        return joined.select(*self.nodes.columns, F.coalesce("_in", zero).alias("in_degree"), F.coalesce("_out", zero).alias("out_degree"))

    def isolated(self) -> DataFrame:
        alone = self.keyed.join(self.out.select("src_key"), F.col("id_key") == F.col("src_key"), "left_anti")
        return alone.join(self.into.select("dst_key"), F.col("id_key") == F.col("dst_key"), "left_anti").drop("id_key")

    def induced(self, nodes: DataFrame, few: bool = False) -> DataFrame:
        """With ``few``, for a capped view, its keys are broadcast; else the edges left by the first join are exchanged once."""
        keys = nodes.select(F.upper("id").alias("_k"))
        keys = F.broadcast(keys) if few else keys
        kept = self.out.join(keys, F.col("src_key") == F.col("_k"), "left_semi")
        return kept.join(keys, F.col("dst_key") == F.col("_k"), "left_semi").drop("src_key", "dst_key")

    def named_edges(self) -> DataFrame:
        names = self.keyed.select(F.col("id_key").alias("_k"), F.col("name").alias("_name"))
        joined = self.into.join(names, F.col("dst_key") == F.col("_k"), "left")
        return joined.withColumn("dst_name", F.coalesce("_name", "dst")).drop("_k", "_name", "src_key", "dst_key")


def _write(df: DataFrame, table: str, path: str, part: str, buckets: int) -> DataFrame:
    """Rows rebalanced by bucket, so that a bucket is a file; one with a hot key is split into several.

    Keys follow from ids, so they are left out of the exchange and made again behind it.  Rows are sorted
    here: the writer's own order begins with the bucket, which it hashes anew at every comparison.
    """
    key, order = LAYOUT[part]
    keys = [c for c in ("src_key", "dst_key", "id_key") if c in df.columns]
    of = lambda c: F.upper(c.removesuffix("_key"))
    dealt = df.drop(*keys).withColumn("_bucket", F.pmod(F.hash(of(key)), F.lit(buckets))).hint("rebalance", "_bucket")
    dealt = dealt.select(*[of(c).alias(c) if c in keys else F.col(c) for c in df.columns]).sortWithinPartitions(*order)
    spark = df.sparkSession
    before = spark.conf.get(WRITERS)
    spark.conf.set(WRITERS, str(max(buckets, int(before))))  # a file of each bucket is open, so no order by bucket is asked for
    try:
        dealt.write.format("parquet").option("path", f"{path}/{part}").option("compression", "zstd").bucketBy(buckets, key).mode("overwrite").saveAsTable(table)
    finally:
        spark.conf.set(WRITERS, before)
    return spark.table(table)


def _stored(nodes: DataFrame, out: DataFrame, into: DataFrame | None) -> StoredGraph:
    return StoredGraph(nodes.drop("id_key"), out.drop("src_key", "dst_key"), None, out, into, nodes)


def store_graph(graph: PropertyGraph, path: str, buckets: int = 64, name: str | None = None, into: bool = True) -> StoredGraph:
    """Write ``graph`` under ``path``, a folder that driver and executors share, and return it as stored.

    Edges are deduplicated once; the table by target is made from the one by source, and
    without ``into`` it is left to :func:`store_into`.
    Tables are registered as ``<name>_out``, ``<name>_into`` and ``<name>_nodes``.
    """
    name = name or f"graph_{uuid.uuid4().hex}"
    out = _write(PropertyGraph.keyed_edges(graph), f"{name}_out", path, "out", buckets)
    if into:
        store_into(out.sparkSession, path, buckets, name)
    _write(PropertyGraph.keyed_nodes(graph), f"{name}_nodes", path, "nodes", buckets)
    return load_graph(out.sparkSession, name)


def store_into(spark: SparkSession, path: str, buckets: int, name: str) -> None:
    """The table by target of a graph that was stored without it."""
    _write(spark.table(f"{name}_out"), f"{name}_into", path, "into", buckets)


def load_graph(spark: SparkSession, name: str) -> StoredGraph:
    """A graph stored under ``name`` in this session's catalog; ``into`` is none where it was left out."""
    into = spark.table(f"{name}_into") if spark.catalog.tableExists(f"{name}_into") else None
    return _stored(spark.table(f"{name}_nodes"), spark.table(f"{name}_out"), into)


def open_graph(spark: SparkSession, path: str, buckets: int = 64, name: str | None = None) -> StoredGraph:
    """A graph that :func:`store_graph` wrote under ``path`` with ``buckets``, maybe by another application."""
    name = name or f"graph_{uuid.uuid4().hex}"
    for part, (key, order) in LAYOUT.items():
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(f"{path}/{part}").schema)
        spark.sql(f"CREATE TABLE {name}_{part} ({fields}) USING parquet CLUSTERED BY ({key}) SORTED BY ({', '.join(order)}) INTO {buckets} BUCKETS LOCATION '{path}/{part}'")
    return load_graph(spark, name)
