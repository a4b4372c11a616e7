"""Strongly connected components by trimming and colours, and the ordered depth-first search of each."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.runtime import settled

from .model import PropertyGraph


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges that are left when nodes without an edge in or out have gone, again and again."""
    n = edges.count()
    while n:
        starts, ends = edges.select(F.col("src").alias("k")).distinct(), edges.select(F.col("dst").alias("k")).distinct()
        left = edges.join(ends, F.col("src") == F.col("k"), "left_semi").join(starts, F.col("dst") == F.col("k"), "left_semi")
        edges = settled(left)
        n, before = edges.count(), n
        if n == before:
            break
    return edges


def _colours(edges: DataFrame) -> DataFrame:
    """``key, colour``: the largest key that reaches a node, itself included; a round sends on only colours that have changed."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("key")).distinct()
    colours = changed = settled(ends.withColumn("colour", F.col("key")))
    while not changed.isEmpty():
        sent = edges.join(changed, F.col("src") == F.col("key")).groupBy(F.col("dst").alias("key")).agg(F.max("colour").alias("new"))
        both = settled(colours.join(sent, "key", "left").select("key", F.greatest("colour", F.coalesce("new", "colour")).alias("colour"), (F.col("new") > F.col("colour")).alias("moved")))
        colours, changed = both.select("key", "colour"), both.where("moved").select("key", "colour")
    return colours


def strong_components(edges: DataFrame) -> DataFrame:
    """``key, component`` of every node on a cycle of two nodes or more, from ``src, dst``; the component is its smallest key.

    Nodes that no cycle can hold are trimmed.  Of the others, the largest key that
    reaches a node is its colour; what reaches that key backwards within its colour is
    its component, and the rest goes around again.  Every step is a join over all
    edges that are left; a colour's node that is reached takes part once.
    """
    left = settled(edges.where("src <> dst").select("src", "dst").distinct())
    found = []
    while True:
        left = _trimmed(left)
        if left.isEmpty():
            break
        colours = _colours(left)
        of = lambda end: colours.select(F.col("key").alias(end), F.col("colour").alias(f"{end}_colour"))
        left = settled(left.join(of("src"), "src").join(of("dst"), "dst").where("src_colour = dst_colour").select("src", "dst", F.col("src_colour").alias("colour")))
        reached = new = settled(left.where("dst = colour").select(F.col("colour").alias("key"), "colour").distinct())
        while not new.isEmpty():
            back = left.join(new.select(F.col("key").alias("dst")), "dst", "left_semi").select(F.col("src").alias("key"), "colour").distinct()
            new = settled(back.join(reached, "key", "left_anti"))
            reached = settled(reached.unionByName(new))
        found.append(reached)
        gone = reached.select("key")
        left = left.join(gone, F.col("src") == F.col("key"), "left_anti").join(gone, F.col("dst") == F.col("key"), "left_anti")
        left = settled(left.select("src", "dst"))
    if not found:
        return edges.select(F.col("src").alias("key"), F.col("src").alias("component")).limit(0)
    whole = reduce(DataFrame.unionByName, found)
    least = whole.groupBy("colour").agg(F.min("key").alias("component"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return settled(whole.join(least, "colour").select("key", "component"))


def _canonical(cycle: list[str]) -> tuple[str, ...]:
    """Rotated to start at the smallest name in upper case, and closed."""
    at = min(range(len(cycle)), key=lambda i: cycle[i].upper())
    turned = cycle[at:] + cycle[:at]
    return (*turned, turned[0])


def ordered_search(roots: Iterable[str], out: dict[str, list[tuple[int, str]]], inside: set[str] | None = None) -> tuple[list[tuple[str, ...]], dict[int, int]]:
    """Cycles of the back edges of a depth-first search over ``out`` (order and target of each edge), and when it looked at each edge.

    With ``inside``, edges to other nodes are only looked at.
    """
    done: dict[str, int] = {}
    found: dict[str, tuple[str, ...]] = {}
    seen: dict[int, int] = {}
    for root in roots:
        if root in done:
            continue
        done[root] = 1
        path, stack = [root], [iter(out.get(root, ()))]
        while stack:
            for order, nxt in stack[-1]:
                seen[order] = len(seen)
                if inside is not None and nxt not in inside:
                    continue
                state = done.get(nxt, 0)
                if state == 1:
                    cycle = _canonical(path[path.index(nxt) :])
                    found.setdefault("|".join(cycle).upper(), cycle)
                elif state == 0:
                    done[nxt] = 1
                    path.append(nxt)
                    stack.append(iter(out.get(nxt, ())))
                    break
            else:
                done[path.pop()] = 2
                stack.pop()
    return list(found.values()), seen


def _search(pdf: pd.DataFrame) -> pd.DataFrame:
    """Cycles of one component, searched from its entry, and the times of its edges to other components."""
    pdf = pdf.sort_values("ord")
    names = dict(zip(pdf["src"], pdf["id"], strict=True))
    out: dict[str, list] = {}
    for src, order, dst in zip(pdf["src"], pdf["ord"], pdf["dst"], strict=True):
        out.setdefault(src, []).append((order, dst))
    cycles, seen = ordered_search([pdf["entry"].iloc[0]], out, set(out))
    named = [[names[x] for x in c] for c in cycles]
    exits = [(o, seen[o]) for o, dst in zip(pdf["ord"], pdf["dst"], strict=True) if dst not in names]
    rows = [(c, None, None) for c in named] + [(None, o, t) for o, t in exits]
    return pd.DataFrame(rows, columns=["nodes", "ord", "time"]).astype({"ord": "Int64", "time": "Int64"})


def back_edge_cycles(graph: PropertyGraph) -> DataFrame:
    """``cycle_key, nodes``: one cycle for each back edge of a depth-first search in insertion order.

    A cycle lies within a strong component, and a search of the whole graph that enters
    a component goes through all of it before it comes back out.  So each component is
    searched for itself, from the node where the whole search would enter it.  That is
    told by paths over the components: the search comes first by the least path, of
    root and then of edges in the order in which each component looks at them.  In a
    round, components whose predecessors are all done take the least of their paths;
    those of several nodes are searched, each as a group of its own.  There are as many
    rounds as the longest chain of components that lead to cycles; a single component
    is searched in one task, as its search is sequential.
    """
    known = graph.nodes.select(F.upper("id").alias("key"), "seq", "id").groupBy("key").agg(F.min(F.struct("seq", "id")).alias("n")).select("key", "n.seq", "n.id")
    ends = known.select("key")
    e = graph.keyed_edges().select(F.col("src_key").alias("src"), F.col("dst_key").alias("dst"), F.col("seq").alias("ord"))
    e = settled(e.join(ends, F.col("dst") == F.col("key"), "left_semi").join(ends, F.col("src") == F.col("key"), "left_semi"))
    n, before = e.count(), None
    while n != before:  # nodes that lead to no cycle change nothing
        e = settled(e.join(e.select(F.col("src").alias("key")).distinct(), F.col("dst") == F.col("key"), "left_semi"))
        n, before = e.count(), n
    schema = "cycle_key string, nodes array<string>"
    if not n:
        return graph.nodes.sparkSession.createDataFrame([], schema)
    strong = strong_components(e)
    nodes = known.join(e.select(F.col("src").alias("key")).distinct(), "key").join(strong, "key", "left")
    nodes = settled(nodes.select("key", "seq", "id", F.coalesce("component", "key").alias("component"), F.col("component").isNotNull().alias("several")))
    of = lambda end: nodes.select(F.col("key").alias(end), F.col("component").alias(f"{end}_in"))
    e = settled(e.join(of("src"), "src").join(of("dst"), "dst"))
    cross = settled(e.where("src_in <> dst_in").select("src_in", "dst_in", "dst", "ord"))
    alone = nodes.where("not several").select("key", "id")
    loops = e.where("src = dst").join(alone, F.col("src") == F.col("key")).select(F.array("id", "id").alias("nodes")).distinct()

    starts = nodes.groupBy("component").agg(F.min(F.struct(F.array("seq").alias("path"), F.col("key").alias("entry"))).alias("way"), F.max("several").alias("several"))
    todo = settled(starts)
    paths, times = None, None  # of components that are done
    cycles = [loops]
    while not todo.isEmpty():
        waiting = cross.join(todo.select(F.col("component").alias("src_in")), "src_in", "left_semi").select(F.col("dst_in").alias("component"))
        ready = todo.join(waiting, "component", "left_anti")
        ways = ready.select("component", "several", "way")
        if paths is not None:
            via = cross.join(ready.select(F.col("component").alias("dst_in"), "several"), "dst_in").join(paths.withColumnRenamed("component", "src_in"), "src_in").join(times, "ord", "left")
            step = F.struct(F.concat("path", F.array(F.coalesce("time", "ord"))).alias("path"), F.col("dst").alias("entry"))
            ways = ways.unionByName(via.select(F.col("dst_in").alias("component"), "several", step.alias("way")))
        now = settled(ways.groupBy("component", "several").agg(F.min("way").alias("way")).select("component", "several", "way.path", "way.entry"))
        rows = e.join(now.where("several").select(F.col("component").alias("src_in"), "entry"), "src_in").join(nodes.select(F.col("key").alias("src"), "id"), "src")
        found = settled(rows.select("src_in", "src", "dst", "ord", "id", "entry").groupBy("src_in").applyInPandas(_search, "nodes array<string>, ord bigint, time bigint"))
        cycles.append(found.where("nodes is not null").select("nodes"))
        new = found.where("ord is not null").select("ord", "time")
        times = new if times is None else settled(times.unionByName(new))
        done = now.select("component", "path")
        paths = done if paths is None else settled(paths.unionByName(done))
        todo = settled(todo.join(done, "component", "left_anti"))
    return reduce(DataFrame.unionByName, cycles).select(F.array_join("nodes", " -> ").alias("cycle_key"), "nodes")
