"""Degrees, totals, hubs, isolated nodes and group counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .model import PropertyGraph


def degrees(graph: PropertyGraph) -> DataFrame:
    """Every node with its numbers of incoming and outgoing edges; unknown ends count for nobody."""
    return graph.with_degrees()


def top_by(graph: PropertyGraph, column: str, k: int = 5) -> DataFrame:
    """The ``k`` nodes with most ``column``, earlier nodes first on a tie."""
    return degrees(graph).orderBy(F.desc(column), "seq").limit(k).select("id", "name", column)


def totals(graph: PropertyGraph) -> DataFrame:
    n = graph.nodes.agg(F.count(F.lit(1)).alias("node_count"))
    return n.crossJoin(graph.edge_keys().agg(F.count(F.lit(1)).alias("edge_count")))  # one row each


def isolated(graph: PropertyGraph) -> DataFrame:
    return graph.isolated()


def counts_by(df: DataFrame, column: str) -> DataFrame:
    """Rows of each value, most first; ties by first appearance (``seq``)."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("_first"))
    return counts.orderBy(F.desc("n"), "_first").drop("_first")


def origin_counts(graph: PropertyGraph) -> DataFrame:
    """Conditional counts of four origins, in one row; nodes of other origins count for none."""
    origins = ("EngineRuntime", "EngineEditor", "UserProject", "SystemPrimitive")
    return graph.nodes.agg(*[F.count_if(F.col("origin") == o).alias(o.lower()) for o in origins])


def total_degrees(graph: PropertyGraph) -> DataFrame:
    """Every node with ``degree``: its edges at both ends, a loop twice, 1 at least."""
    both = degrees(graph)
    return both.withColumn("degree", F.greatest(F.col("in_degree") + F.col("out_degree"), F.lit(1))).drop("in_degree", "out_degree")


def diagnostics(graph: PropertyGraph, k: int = 5) -> DataFrame:
    """``section, rank, label, n``: counts by origin, category and kind, totals, hubs, god nodes, isolated nodes and the first cycles."""
    from functools import reduce

    from pyspark.sql import Window

    from .paths import detect_cycles

    row = lambda df, section, label, n, *by: df.select(
        F.lit(section).alias("section"), F.row_number().over(Window.orderBy(*by)).cast("int").alias("rank"), label.cast("string").alias("label"), n.cast("bigint").alias("n"))
    one = lambda df, section: row(df.select(F.explode(F.create_map(*[F.lit(x) if i % 2 == 0 else F.col(x) for c in df.columns for i, x in enumerate((c, c))])).alias("c", "n")), section, F.col("c"), F.col("n"), "c")
    grouped = lambda df, c: row(counts_by(df, c), c, F.col(c), F.col("n"), F.desc("n"), c)  # noqa: E731  a row a value
    cycles = detect_cycles(graph).select("cycle_key").orderBy("cycle_key").limit(k)
    parts = [
        one(totals(graph), "totals"), one(origin_counts(graph), "origins"), grouped(graph.nodes, "category"), grouped(graph.edges, "kind"),
        row(top_by(graph, "in_degree", k), "hubs", F.col("id"), F.col("in_degree"), F.desc("in_degree"), "id"),
        row(top_by(graph, "out_degree", k), "god_nodes", F.col("id"), F.col("out_degree"), F.desc("out_degree"), "id"),
        isolated(graph).agg(F.count(F.lit(1)).alias("n")).select(F.lit("isolated").alias("section"), F.lit(1).alias("rank"), F.lit("nodes").alias("label"), "n"),
        row(cycles, "cycles", F.col("cycle_key"), F.lit(1), "cycle_key"),
    ]
    return reduce(DataFrame.unionByName, parts)


def metrics_report(graph: PropertyGraph, k: int = 5) -> dict[str, DataFrame]:
    return {"totals": totals(graph), "hubs": top_by(graph, "in_degree", k), "god_nodes": top_by(graph, "out_degree", k), "isolated": isolated(graph)}
