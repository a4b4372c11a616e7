"""Search, explanations, filtered views and their styles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .model import PropertyGraph


def contains_ci(column: str, text: str) -> Column:
    return F.contains(F.upper(column), F.lit(text.upper()))


def search(graph: PropertyGraph, text: str, limit: int = 30) -> DataFrame:
    """The first nodes whose id or namespace has ``text`` in any case; the empty text matches all."""
    return search_hits(graph, text).orderBy("seq").limit(limit).select("id", "name", "namespace")


def search_hits(graph: PropertyGraph, text: str) -> DataFrame:
    """All of them."""
    return graph.nodes.where(contains_ci("id", text) | contains_ci("namespace", text)) if text else graph.nodes


#: Bit of a node's flags that hides it.
HIDDEN = 32
VIEWS = {"all": ("out", "in", "engine"), "in": ("in",), "out": ("out",), "in_out": ("in", "out"), "engine": ("engine",), "engine_deps": ("engine",)}


def explain(graph: PropertyGraph, node: str, view: str = "all") -> DataFrame:
    """``section, other, kind, details`` of a node: own edges out, all edges in, engine edges without their prefix."""
    if view not in VIEWS:
        raise ValueError(f"unknown view {view!r}")
    out, into, engine = graph.outgoing(node), graph.incoming(node), F.col("kind").startswith("Engine_")
    row = lambda df, section, other, kind: df.select(F.lit(section).alias("section"), F.col(other).alias("other"), kind.alias("kind"), "details")
    parts = {
        "out": row(out.where(~engine), "out", "dst", F.col("kind")),
        "in": row(into, "in", "src", F.col("kind")),
        "engine": row(out.where(engine), "engine", "dst", F.regexp_replace("kind", "^Engine_", "")),
    }
    first, *rest = (parts[s] for s in VIEWS[view])
    for part in rest:
        first = first.unionByName(part)
    return first


def view_nodes(
    graph: PropertyGraph,
    search_query: str | None = None,
    user_code_only: bool = False,
    include_system_primitives: bool = False,
    components_only: bool = False,
    razor_only: bool = False,
    max_nodes: int = 30_000,
) -> DataFrame:
    """The first ``max_nodes`` nodes that pass all the filters."""
    if components_only and razor_only:
        raise ValueError("components_only and razor_only exclude each other")
    df = graph.nodes
    if not include_system_primitives:
        df = df.where("origin <> 'SystemPrimitive'")
    if user_code_only:
        df = df.where("origin = 'UserProject'")
    if components_only:
        df = df.where("category = 'SceneComponent'")
    if razor_only:
        df = df.where("category in ('UiPanel', 'UiPanelComponent')")
    if search_query:
        df = df.where(contains_ci("name", search_query) | contains_ci("namespace", search_query))
    return df.orderBy("seq").limit(max_nodes)


def induced_edges(graph: PropertyGraph, nodes: DataFrame, few: bool = False) -> DataFrame:
    """Edges both of whose ends are in ``nodes``; ``few`` says that they are capped, as those of a view."""
    return graph.induced(nodes, few)


def with_focus(nodes: DataFrame, graph: PropertyGraph, focus: str | None) -> DataFrame:
    """``alpha``: 1 for the focused node and its neighbours, or for all without a focus, else 0.15."""
    if focus is None:
        return nodes.withColumn("alpha", F.lit(1.0))
    near = graph.neighbours(focus).select(F.upper("id").alias("_f"), F.lit(True).alias("_near"))
    lit = (F.upper("id") == focus.upper()) | F.col("_near")
    joined = nodes.join(near.distinct(), F.upper("id") == F.col("_f"), "left")
    return joined.withColumn("alpha", F.when(lit, 1.0).otherwise(0.15)).drop("_f", "_near")


def focused_edges(edges: DataFrame, focus: str | None) -> DataFrame:
    """``alpha``: 1 for edges that touch the focused node, or for all without one, else 0.15."""
    touches = (F.upper("src") == focus.upper()) | (F.upper("dst") == focus.upper()) if focus else F.lit(True)
    return edges.withColumn("alpha", F.when(touches, 1.0).otherwise(0.15))


def visible(df: DataFrame) -> DataFrame:
    """Nodes whose hidden flag isn't set."""
    return df.where(F.col("flags").bitwiseAND(F.lit(HIDDEN)) == 0)


def drawn_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges ``i, j`` both of whose numbers are those of visible nodes (``idx, flags``)."""
    seen = visible(nodes).select("idx")
    return edges.join(seen.select(F.col("idx").alias("i")), "i", "left_semi").join(seen.select(F.col("idx").alias("j")), "j", "left_semi")


def shown_labels(nodes: DataFrame, graph: PropertyGraph, focus: str | None, width: float, height: float) -> DataFrame:
    """Nodes (``id, x, y`` on the screen) that have a label: the focused one and its neighbours, in or near the viewport."""
    near = with_focus(nodes, graph, focus).where(F.lit(focus is not None) & (F.col("alpha") == 1.0)).drop("alpha")
    return near.where(F.col("x").between(-80.0, width + 80.0) & F.col("y").between(-40.0, height + 40.0))


def visual_metrics(degree: Column) -> dict[str, Column]:
    """Level, radius and mass that a node's degree gives."""
    return {
        "z": F.least(F.lit(16), F.floor(F.log2(degree + 1)).cast("int")),
        "radius": F.lit(6.0) + F.sqrt(degree),
        "mass": F.lit(1.0) + 0.25 * degree,
    }


def carry_over(new: DataFrame, saved: DataFrame) -> DataFrame:
    """New nodes at their saved places where there are any (``id, x, y, pinned``)."""
    old = saved.select(F.col("id").alias("_id"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("pinned").alias("_p"))
    joined = new.join(old, F.col("id") == F.col("_id"), "left")
    kept = joined.withColumn("x", F.coalesce("_x", "x")).withColumn("y", F.coalesce("_y", "y"))
    return kept.withColumn("pinned", F.coalesce("_p", F.lit(False))).drop("_id", "_x", "_y", "_p")


# Member types that a keyword search may be limited to, by the tiers they mean.
TIERS = {0: ("class", "type", "struct", "interface", "enum"), 1: ("property", "prop", "field"), 2: ("method",)}


def keyword_search(
    types: DataFrame, members: DataFrame, text: str, limit: int = 5, member_type: str = "all", fallback: PropertyGraph | None = None
) -> DataFrame:
    """Types, then properties, then methods that contain ``text``, sharing one budget.

    ``types(seq, name, full_name, is_interface, is_enum, is_value_type)``,
    ``members(type_seq, seq, member_kind, name, doc_id)``.  Members of compiler-made types are left out.
    Where nothing is found and types are asked for, nodes of ``fallback`` whose id or namespace has the text are.
    """
    wanted = member_type.lower().strip()
    allowed = [t for t, names in TIERS.items() if wanted == "all" or wanted in names]
    visible = lambda c: ~F.col(c).rlike("[<$]")
    badge = F.when(F.col("is_interface"), "INTERFACE").when(F.col("is_enum"), "ENUM").when(F.col("is_value_type"), "STRUCT").otherwise("CLASS")
    hit = types.where(visible("full_name") & (contains_ci("name", text) | contains_ci("full_name", text)))
    tiers = hit.select(F.lit(0).alias("tier"), F.col("seq").alias("type_seq"), F.lit(0).cast("bigint").alias("member_seq"), badge.alias("badge"), F.col("full_name").alias("label"))
    hidden = types.where(~visible("full_name")).select(F.col("seq").alias("type_seq")).distinct()
    members = members.join(hidden, "type_seq", "left_anti")
    for tier, kind in ((1, "property"), (2, "method")):
        found = members.where((F.col("member_kind") == kind) & contains_ci("name", text))
        tiers = tiers.unionByName(found.select(F.lit(tier).alias("tier"), "type_seq", F.col("seq").cast("bigint").alias("member_seq"), F.lit(kind.upper()).alias("badge"), F.col("doc_id").alias("label")))
    best = tiers.where(F.col("tier").isin(allowed)).orderBy("tier", "type_seq", "member_seq").limit(limit)
    if fallback is None or 0 not in allowed:
        return best
    nodes = search_hits(fallback, text).where(visible("id"))
    nodes = nodes.select(F.lit(3).alias("tier"), F.col("seq").alias("type_seq"), F.lit(0).cast("bigint").alias("member_seq"), F.lit("USER").alias("badge"), F.col("id").alias("label"))
    first = F.min("tier").over(Window.partitionBy(F.lit(0)))  # over at most twice the limit
    both = best.unionByName(nodes.orderBy("type_seq").limit(limit)).withColumn("_first", first)
    return both.where("(_first < 3 and tier < 3) or _first = 3").drop("_first").orderBy("tier", "type_seq", "member_seq")
