"""Breadth-first paths and distances, cycles, and the closure of inheritance."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.runtime import settled

from .model import PropertyGraph, dense_index
from .strong import back_edge_cycles


def _steps(graph: PropertyGraph, undirected: bool, known_only: bool) -> DataFrame:
    """``at, to, ord, src, dst, kind, details``: where each edge leads, in the order a node tries its edges."""
    e = graph.keyed_edges()
    keep = ["src", "dst", "kind", "details"]
    out = e.select(F.col("src_key").alias("at"), F.col("dst_key").alias("to"), F.struct(F.lit(0).alias("way"), "seq").alias("ord"), *keep)
    if undirected:
        back = e.select(F.col("dst_key").alias("at"), F.col("src_key").alias("to"), F.struct(F.lit(1).alias("way"), "seq").alias("ord"), *keep)
        out = out.unionByName(back)
    if known_only:
        out = out.join(graph.nodes.select(F.upper("id").alias("_k")), F.col("to") == F.col("_k"), "left_semi")
    return out


def shortest_path(
    graph: PropertyGraph, start: str, target: str, undirected: bool = False, known_only: bool = False
) -> DataFrame:
    """``step, src, dst, kind, details`` of the path that breadth-first search finds first.

    A node's parent is the first node of the level before that has an edge to it,
    by that node's own rank and then edge order.  No rows: not found, or no step
    needed.  Every level is one join of the frontier with the edges.
    """
    spark = graph.nodes.sparkSession
    a, b = start.upper(), target.upper()
    schema = "step bigint, src string, dst string, kind string, details string"
    both = graph.nodes.where(F.upper("id").isin(a, b)).select(F.upper("id")).distinct().count()
    if a == b or both < 2:
        return spark.createDataFrame([], schema)
    steps = settled(_steps(graph, undirected, known_only))
    seen = settled(spark.createDataFrame([(a, 0, 0)], "key string, rank bigint, level int").withColumn("via", F.lit(None).cast(
        "struct<at:string,src:string,dst:string,kind:string,details:string>")))
    for level in count(1):
        frontier = seen.where(F.col("level") == level - 1).select(F.col("key").alias("at"), F.col("rank").alias("from_rank"))
        found = steps.join(frontier, "at").join(seen.select(F.col("key").alias("to")), "to", "left_anti")
        best = found.groupBy("to").agg(F.min(F.struct("from_rank", "ord", F.struct("at", "src", "dst", "kind", "details").alias("via"))).alias("b"))
        ranked = best.select(F.col("to").alias("key"), F.lit(level).alias("level"), F.col("b.via").alias("via"), F.struct("b.from_rank", "b.ord").alias("seq"))
        new = settled(dense_index(ranked, "rank").select("key", "rank", "level", "via"))  # ranks order the next level
        if new.isEmpty():
            return spark.createDataFrame([], schema)
        seen = settled(seen.unionByName(new))
        if not new.where(F.col("key") == b).isEmpty():
            break
    rows, key = [], b
    while key != a:  # as many look-ups as the path has steps
        via = seen.where(F.col("key") == key).select("via.*").first()
        rows.append((via.src, via.dst, via.kind, via.details))
        key = via.at
    return spark.createDataFrame([(i, *r) for i, r in enumerate(reversed(rows), 1)], schema)


def distances(graph: PropertyGraph, start: str) -> DataFrame:
    """``id, distance`` of every node that directed edges reach from ``start``."""
    spark = graph.nodes.sparkSession
    steps = settled(graph.keyed_edges().select(F.col("src_key").alias("at"), F.col("dst_key").alias("to")).distinct())
    seen = spark.createDataFrame([(start.upper(), 0)], "key string, distance int")
    for level in count(1):
        frontier = seen.where(F.col("distance") == level - 1).select(F.col("key").alias("at"))
        new = steps.join(frontier, "at", "left_semi").select(F.col("to").alias("key")).distinct().join(seen, "key", "left_anti")
        new = settled(new.withColumn("distance", F.lit(level)))
        if new.isEmpty():
            break
        seen = settled(seen.unionByName(new))
    names = graph.nodes.select(F.upper("id").alias("key"), "id")
    return seen.join(names, "key").select("id", "distance")


def transitions(rows: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """``src, dst, n``: how often a value comes right after another in the order of a key's rows."""
    after = F.lead(value).over(Window.partitionBy(key).orderBy(*order))
    pairs = rows.select(F.col(value).alias("src"), after.alias("dst")).where("dst is not null")
    return pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def k_cycles(graph: PropertyGraph, k: int) -> DataFrame:
    """Every elementary cycle of ``k`` (2 to 4) nodes once, from its smallest node: ``cycle_key``."""
    known = graph.nodes.select(F.upper("id").alias("_n"))
    e = graph.keyed_edges().select("src_key", "dst_key").distinct()
    e = settled(e.join(known, F.col("dst_key") == F.col("_n"), "left_semi").where("src_key <> dst_key"))
    hop = lambda i: e.select(F.col("src_key").alias(f"n{i}"), F.col("dst_key").alias(f"n{i + 1}"))
    path = hop(0).where("n0 < n1")
    for i in range(1, k):
        path = path.join(hop(i), f"n{i}")
        path = path.where(" and ".join(f"n{i + 1} <> n{j}" for j in range(1, i + 1)) + (f" and n{i + 1} > n0" if i + 1 < k else f" and n{i + 1} = n0"))
    nodes = [F.col(f"n{i}") for i in range(k)]
    return path.select(F.array_join(F.array(*nodes, nodes[0]), " -> ").alias("cycle_key"))


def detect_cycles(graph: PropertyGraph) -> DataFrame:
    """``cycle_key, nodes``: one cycle for each back edge of a depth-first search in insertion order, component by component."""
    return back_edge_cycles(graph)


def ancestor_walks(edges: DataFrame, max_depth: int = 25) -> DataFrame:
    """``id, ancestor, depth, walks``: how many walks of ``depth`` ``Inherits`` edges lead from ``id`` to ``ancestor``, up to ``max_depth``.

    By doubling: walks of up to k edges, joined behind those of exactly k, give those
    of up to 2k, so 25 hops take five joins.  Rows are pairs and depths, never walks,
    so types that name each other in rings cost no more than their pairs.  Walk counts
    are decimals of 38 digits.
    """
    base = edges.where("kind = 'Inherits'").groupBy(F.upper("src").alias("id"), F.upper("dst").alias("ancestor")).agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("walks"))
    walks = settled(base.select("id", "ancestor", F.lit(1).alias("depth"), "walks"))
    reach = 1
    while reach < max_depth:
        behind = walks.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("next"), F.col("depth").alias("more"), F.col("walks").alias("times"))
        ends = walks.where(F.col("depth") == reach).join(behind.where(F.col("more") <= max_depth - reach), "ancestor")
        new = ends.select("id", F.col("next").alias("ancestor"), (F.lit(reach) + F.col("more")).alias("depth"), (F.col("walks") * F.col("times")).cast("decimal(38,0)").alias("walks"))
        new = settled(new.groupBy("id", "ancestor", "depth").agg(F.sum("walks").cast("decimal(38,0)").alias("walks")))
        if new.isEmpty():
            break
        walks, reach = settled(walks.unionByName(new)), 2 * reach
    return walks


def ancestors(edges: DataFrame, max_depth: int = 25) -> DataFrame:
    """``id, ancestor, depth`` over ``Inherits`` edges, up to ``max_depth`` hops, once for each depth; rings count again up to there."""
    return ancestor_walks(edges, max_depth).drop("walks")


def descendant_counts(edges: DataFrame, more_than: int = 0, max_depth: int = 25) -> DataFrame:
    """``ancestor, descendants``: walks of up to ``max_depth`` hops that end at a type; more than 63 bits hold are an error."""
    counts = ancestor_walks(edges, max_depth).groupBy("ancestor").agg(F.sum("walks").cast("bigint").alias("descendants"))
    return counts.where(F.col("descendants") > more_than)


def base_edges(types: DataFrame) -> DataFrame:
    """``Inherits`` edges of types (``full_name, name, base_type, seq``): a base by full name, else the first of that short name."""
    base = types.where("base_type is not null").select(F.col("full_name").alias("src"), F.col("base_type").alias("_b"), "seq")
    full = types.groupBy(F.upper("full_name").alias("_f")).agg(F.min_by("full_name", "seq").alias("_by_full"))
    short = types.groupBy(F.upper("name").alias("_s")).agg(F.min_by("full_name", "seq").alias("_by_short"))
    found = base.join(full, F.upper("_b") == F.col("_f"), "left").join(short, F.upper("_b") == F.col("_s"), "left")
    return found.select("seq", "src", F.coalesce("_by_full", "_by_short", "_b").alias("dst"), F.lit("Inherits").alias("kind"), F.lit("Base Class").alias("details"))


def derivatives(edges: DataFrame, target: str, max_depth: int = 25) -> DataFrame:
    """``id`` of everything below ``target``, up to ``max_depth`` hops: a walk down from the target alone."""
    base = settled(edges.where("kind = 'Inherits'").select(F.upper("src").alias("s"), F.upper("dst").alias("d")))
    level = base.where(F.col("d") == target.upper()).select(F.col("s").alias("id")).distinct()
    out = level = settled(level)
    for _ in range(max_depth - 1):
        level = base.join(level, F.col("d") == F.col("id"), "left_semi").select(F.col("s").alias("id")).distinct()
        level = settled(level.join(out, "id", "left_anti"))
        if level.isEmpty():
            break
        out = settled(out.unionByName(level))
    return out


def cycle_hops(cycles: DataFrame, graph: PropertyGraph) -> DataFrame:
    """``cycle_key, hop, src, dst, label``: each step of a cycle with its first edge's ``kind: details``, cycles in order."""
    steps = cycles.select("cycle_key", F.posexplode(F.split("cycle_key", " -> ", -1)).alias("hop", "src"), F.split("cycle_key", " -> ", -1).alias("ns"))
    steps = steps.select("cycle_key", "hop", "src", F.get("ns", F.col("hop") + 1).alias("dst")).where("dst is not null")
    first = graph.edges.groupBy(F.upper("src").alias("_s"), F.upper("dst").alias("_d")).agg(F.min_by(F.concat("kind", F.lit(": "), "details"), "seq").alias("label"))
    joined = steps.join(first, (F.upper("src") == F.col("_s")) & (F.upper("dst") == F.col("_d")), "left")
    return joined.select("cycle_key", "hop", "src", "dst", F.coalesce("label", F.lit("unknown connection")).alias("label")).orderBy("cycle_key", "hop")
