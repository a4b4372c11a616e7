"""The property graph: two DataFrames, case-insensitive keys and an explicit order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.runtime import settled


def first_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (source, target, kind, details), ends and details without regard to case; the first stays.

    An aggregate, not a window: repeats are combined before the shuffle.
    """
    keys = [F.upper("src").alias("_s"), F.upper("dst").alias("_d"), F.col("kind"), F.upper("details").alias("_x")]
    row = F.struct("seq", "src", "dst", "details", "line_number")
    return edges.groupBy(*keys).agg(F.min(row).alias("e")).select("e.seq", "e.src", "e.dst", "kind", "e.details", "e.line_number")


def strict_edges(edges: DataFrame) -> DataFrame:
    """The archived policy: exact keys, and no edge from a node to itself."""
    row = F.struct("seq", "line_number")
    kept = edges.where("src <> dst").groupBy("src", "dst", "kind", "details").agg(F.min(row).alias("e"))
    return kept.select("e.seq", "src", "dst", "kind", "details", "e.line_number")


def upsert_nodes(nodes: DataFrame, last_wins: bool = True) -> DataFrame:
    """One node for each id: the last one's values at the first one's place, or the first one as it is."""
    if not last_wins:
        rank = F.row_number().over(Window.partitionBy("id").orderBy("seq"))
        return nodes.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    key = Window.partitionBy(F.upper("id"))
    rank = F.row_number().over(key.orderBy(F.desc("seq")))
    return nodes.withColumn("_rank", rank).withColumn("seq", F.min("seq").over(key)).where("_rank = 1").drop("_rank")


def first_per_key(df: DataFrame, *keys: Column) -> DataFrame:
    """The first row, by ``seq``, of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("seq"))).where("_r = 1").drop("_r")


def dense_index(df: DataFrame, name: str = "idx") -> DataFrame:
    """Numbers from 0 in ``seq`` order, made part by part rather than in one task."""
    spark = df.sparkSession
    ranged = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "seq").withColumn("_part", F.spark_partition_id())
    ranged = settled(ranged)  # ranges are sampled: a second evaluation may deal the rows otherwise
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))  # a row for each partition
    local = F.row_number().over(Window.partitionBy("_part").orderBy("seq"))
    return (
        ranged.withColumn("_local", local)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_before") + F.col("_local") - 1).cast("bigint"))
        .drop("_part", "_local", "_before")
    )


@dataclass(frozen=True)
class PropertyGraph:
    """``nodes(id, name, namespace, origin, category, seq, ...)`` and ``edges(src, dst, kind, details, seq, ...)``.

    Ids match without regard to case.  Edges may point at ids that are no nodes.  Where ``edges`` are
    :func:`first_edges` of ``raw``, one node's edges are filtered before they are deduplicated, so that
    the filter reaches the scan and only that node's edges are shuffled.
    """

    nodes: DataFrame
    edges: DataFrame
    raw: DataFrame | None = None

    def keyed_nodes(self) -> DataFrame:
        return self.nodes.withColumn("id_key", F.upper("id"))

    def keyed_edges(self) -> DataFrame:
        return self.edges.withColumn("src_key", F.upper("src")).withColumn("dst_key", F.upper("dst"))

    def edge_keys(self) -> DataFrame:
        """``src_key, dst_key, kind`` of every edge, for counts: no row has to be chosen among repeats, so they hash."""
        if self.raw is None:
            return self.keyed_edges().select("src_key", "dst_key", "kind")
        keys = [F.upper("src").alias("src_key"), F.upper("dst").alias("dst_key"), "kind", F.upper("details").alias("_x")]
        return self.raw.select(*keys).distinct().drop("_x")

    def outgoing(self, node: str) -> DataFrame:
        return self._edges_where(F.upper("src") == node.upper())

    def incoming(self, node: str) -> DataFrame:
        return self._edges_where(F.upper("dst") == node.upper())

    def _edges_where(self, condition) -> DataFrame:
        return self.edges.where(condition) if self.raw is None else first_edges(self.raw.where(condition))

    def indexed(self, ids: DataFrame) -> DataFrame:
        """``ids`` (``id``) with the dense number of the node of exactly that id; others go."""
        return ids.join(dense_index(self.nodes).select(F.col("id").alias("_id"), "idx"), F.col("id") == F.col("_id")).drop("_id")

    def node(self, node: str) -> DataFrame:
        return self.nodes.where(F.upper("id") == node.upper())

    def neighbours(self, node: str) -> DataFrame:
        """Distinct ids one edge away in either direction."""
        out = self.outgoing(node).select(F.col("dst").alias("id"))
        return out.unionByName(self.incoming(node).select(F.col("src").alias("id"))).distinct()

    def with_degrees(self) -> DataFrame:
        """Every node with ``in_degree`` and ``out_degree``; both ends are counted in one aggregate, so edges are shuffled once."""
        ends = self.edge_keys().select(F.explode(F.array(
            F.struct(F.col("src_key").alias("k"), F.lit(1).alias("o"), F.lit(0).alias("i")),
            F.struct(F.col("dst_key").alias("k"), F.lit(0).alias("o"), F.lit(1).alias("i")),
        )).alias("e"))
        counts = ends.groupBy(F.col("e.k").alias("_k")).agg(F.sum("e.i").alias("_in"), F.sum("e.o").alias("_out"))
        joined = self.nodes.join(counts, F.upper("id") == F.col("_k"), "left")
        zero = F.lit(0).cast("bigint")
        return joined.select(*self.nodes.columns, F.coalesce("_in", zero).alias("in_degree"), F.coalesce("_out", zero).alias("out_degree"))

    def isolated(self) -> DataFrame:
        edges = self.edges if self.raw is None else self.raw  # repeats make no difference
        ends = edges.select(F.explode(F.array(F.upper("src"), F.upper("dst"))).alias("k"))
        return self.nodes.join(ends, F.upper("id") == F.col("k"), "left_anti")

    def induced(self, nodes: DataFrame, few: bool = False) -> DataFrame:
        """Edges both of whose ends are in ``nodes``."""
        keys = nodes.select(F.upper("id").alias("_k"))
        kept = self.edges.join(keys, F.upper("src") == F.col("_k"), "left_semi")
        return kept.join(keys, F.upper("dst") == F.col("_k"), "left_semi")

    def named_edges(self) -> DataFrame:
        """Edges with their target's name, the raw id where it is no node."""
        names = self.nodes.select(F.upper("id").alias("_k"), F.col("name").alias("_name"))
        joined = self.edges.join(names, F.upper("dst") == F.col("_k"), "left")
        return joined.withColumn("dst_name", F.coalesce("_name", "dst")).drop("_k", "_name")
