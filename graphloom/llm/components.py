"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def star_components(links: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """``u, v``: each linked node ``u`` other than its component's smallest, and that smallest ``v``.

    Alternates large-star and small-star rounds, which end after about the log of
    the longest chain.  The least neighbour of a node comes from an aggregate that
    combines in the map tasks, and is joined back from its own exchange, so a hub
    with very many links is never one task's group.  Every round is written to the
    shared folder.  Links with a null end are ignored; no links give no rows.
    """
    one = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = cut(one.distinct())
    mark = _mark(edges)
    for _ in range(max_rounds):
        if not mark[0]:
            return edges
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, F.col("u") == F.col("w"))
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        small = large.join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = cut(small.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).where("u != v").distinct())
        drop_cut(edges)
        edges, before = new, mark
        mark = _mark(edges)
        if mark == before:
            return edges
    raise RuntimeError("components did not settle")
