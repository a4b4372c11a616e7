"""Graph documents, notes, canvases and catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import names
from graphloom.functions.names import table_summary
from graphloom.operators.model import PropertyGraph, dense_index
from graphloom.operators.paths import ancestors
from graphloom.operators.spatial import grid_layout


def write_tables(graph: PropertyGraph, folder: str) -> None:
    """Both tables as Parquet: the form for large graphs."""
    graph.nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    graph.edges.write.mode("overwrite").parquet(f"{folder}/edges")


def graph_document(graph: PropertyGraph) -> DataFrame:
    """``value``: the whole graph as one JSON document, in the shape :func:`graphloom.sources.files.graph_cache` reads.

    One row holds the graph, so this is for graphs that one reader takes whole; :func:`write_tables` is for any.
    """
    file = F.regexp_extract(F.coalesce("file_path", F.lit("")), r"([^/\\]*)$", 1) if "file_path" in graph.nodes.columns else F.lit("")
    listed = lambda df, item: df.agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", item.alias("item")))), lambda x: x["item"]).alias("items"))
    nodes = listed(graph.nodes, F.struct("id", file.alias("file"), "namespace")).withColumnRenamed("items", "nodes")
    links = listed(graph.edges, F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("kind").alias("type"), "details")).withColumnRenamed("items", "links")
    return nodes.crossJoin(links).select(F.to_json(F.struct("nodes", "links")).alias("value"))  # one row each


def write_document(graph: PropertyGraph, folder: str) -> None:
    """The graph document as a text file under ``folder``."""
    graph_document(graph).coalesce(1).write.mode("overwrite").text(folder)


def json_lines(graph: PropertyGraph) -> DataFrame:
    """``value``: a JSON object for each node and edge, so that no row holds the graph."""
    nodes = graph.nodes.select(F.to_json(F.struct(F.lit("node").alias("row"), "id", "namespace")).alias("value"))
    links = graph.edges.select(F.to_json(F.struct(F.lit("link").alias("row"), F.col("src").alias("source"), F.col("dst").alias("target"), F.col("kind").alias("type"), "details")).alias("value"))
    return nodes.unionByName(links)


def notes(graph: PropertyGraph) -> DataFrame:
    """``id, note``: markdown with front matter, edges out, edges in and engine edges of every node."""
    engine = F.col("kind").startswith("Engine_")
    line = lambda other: F.concat(F.lit("- [["), other, F.lit("]] ("), F.col("kind"), F.lit(": "), F.col("details"), F.lit(")"))
    out = graph.edges.select(F.upper("src").alias("k"), F.when(engine, "engine").otherwise("out").alias("s"), "seq", line(F.col("dst")).alias("line"))
    into = graph.edges.select(F.upper("dst").alias("k"), F.lit("in").alias("s"), "seq", line(F.col("src")).alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "\n")
    parts = out.unionByName(into).groupBy("k").pivot("s", ["out", "in", "engine"]).agg(text)
    joined = graph.nodes.join(parts, F.upper("id") == F.col("k"), "left")
    none = F.lit("*None*")
    note = F.concat(F.lit("---\nid: "), F.col("id"), F.lit("\nnamespace: "), F.coalesce("namespace", F.lit("global")), F.lit("\n---\n## Out\n"), F.coalesce("out", none),
                    F.lit("\n## In\n"), F.coalesce("in", none), F.lit("\n## Engine API Dependencies\n"), F.coalesce("engine", none), F.lit("\n"))
    return joined.select("id", note.alias("note"))


# The heading a view of a note begins with; a view may have several.
SECTIONS = {"methods": ("methods",), "properties": ("properties", "fields"), "dependencies": ("dependencies", "out", "in")}


def section(note: str, heading: str) -> str:
    """Lines of a note's first section whose heading starts with ``heading``."""
    out, on = [], False
    for line in note.splitlines():
        if line.startswith("## "):
            if on:
                break
            on = line[3:].lower().startswith(heading.lower())
        if on:
            out.append(line)
    return "\n".join(out)


def note_view(note: Column | str, view: str) -> Column:
    """A view of a note: ``all``, ``summary`` (what precedes its first section), or the sections of :data:`SECTIONS`."""
    note = F.col(note) if isinstance(note, str) else note
    if view == "all":
        return note
    parts = F.split(note, r"(?m)^(?=## )", -1)
    first = F.when(~note.startswith("## "), parts[0]).otherwise("")
    if view == "summary":
        return F.regexp_replace(first, r"\s+$", "")
    if view not in SECTIONS:
        raise ValueError(f"unknown view {view!r}")
    begins = lambda h: lambda p: F.lower(p).startswith(f"## {h}")
    picked = [F.get(F.filter(parts, begins(h)), F.lit(0)) for h in SECTIONS[view]]
    return F.array_join(F.array_compact(F.array(*[F.regexp_replace(p, r"\s+$", "") for p in picked])), "\n")


def canvas(graph: PropertyGraph) -> tuple[DataFrame, DataFrame]:
    """Nodes on a grid and labelled edges, a JSON object a row."""
    placed = grid_layout(dense_index(graph.nodes), graph.nodes.count())
    nodes = placed.select(F.to_json(F.struct("id", F.lit("text").alias("type"), F.col("name").alias("text"), "x", "y")).alias("value"))
    numbered = dense_index(graph.edges)
    label = F.concat("kind", F.lit(": "), "details")
    edges = numbered.select(F.to_json(F.struct(F.concat(F.lit("edge_"), F.col("idx").cast("string")).alias("id"), F.col("src").alias("fromNode"), F.col("dst").alias("toNode"), label.alias("label"))).alias("value"))
    return nodes, edges


def type_catalog(types: DataFrame, flag: str) -> DataFrame:
    """Types with a flag (``is_enum``, ``is_attribute``), by full name."""
    return types.where(flag).select("full_name", table_summary(F.col("summary")).alias("summary")).orderBy("full_name")


def _table(members: DataFrame, kind: str, title: str, head: str, row: Column) -> DataFrame:
    """``type_key`` and a section of the public members of a kind, in order."""
    shown = members.where((F.col("member_kind") == kind) & F.col("is_public"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("type_seq", "seq", row.alias("row")))), lambda m: m["row"]), "\n")
    return shown.groupBy("type_key").agg(F.concat(F.lit(f"## {title}\n{head}\n"), rows, F.lit("\n\n")).alias(kind))


def type_notes(types: DataFrame, members: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """``full_name, note``: front matter, summary, tables of public members (an enum's values), edges and derivatives of each type."""
    link = lambda c: F.concat(F.lit("[["), names.unique_id(c), F.lit("]]"))
    summary = table_summary(F.col("summary"))
    bold = F.concat(F.lit("**"), "name", F.lit("**"))
    typed = F.concat(F.lit("| "), names.type_link("member_type"), F.lit(" | "), bold, F.lit(" | "), summary, F.lit(" |"))
    called = F.array_join(F.coalesce("params", F.array().cast("array<string>")), ", ")
    static = F.when(F.col("is_static"), "static ").otherwise("")
    signed = F.concat(F.lit("| `"), static, names.type_link("member_type"), F.lit(" "), "name", F.lit("("), called, F.lit(")` | "), summary, F.lit(" |"))
    out = types.withColumn("_k", F.upper("full_name"))
    three = "| Type | Name | Summary |\n| --- | --- | --- |"
    for kind, title, head, row in (("field", "Fields", three, typed), ("property", "Properties", three, typed), ("method", "Methods", "| Signature | Summary |\n| --- | --- |", signed)):
        out = out.join(_table(members, kind, title, head, row).withColumnRenamed("type_key", f"_{kind}"), F.col("_k") == F.col(f"_{kind}"), "left")
    values = members.where("member_kind = 'field' and name <> 'value__'").groupBy(F.col("type_key").alias("_v"))
    values = values.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("type_seq", "seq", "name"))), lambda m: F.concat(F.lit("- **"), m["name"], F.lit("**"))), "\n").alias("_values"))
    out = out.join(values, F.col("_k") == F.col("_v"), "left")
    if edges is not None:
        line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) and not p.isidentifier() else F.col(p) for p in parts])
        ordered = lambda df, key, text, name: df.groupBy(F.upper(key).alias(f"_{name}k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", text.alias("t")))), lambda x: x["t"]), "\n").alias(f"_{name}"))
        leaving = ordered(edges, "src", line("- ─[", "kind", "]─> [[", "dst", "]] `", "details", "`"), "out")
        coming = ordered(edges, "dst", line("- [[", "src", "]] ─[", "kind", "]─> `", "details", "`"), "in")
        below = ancestors(edges).select("id", "ancestor").distinct().groupBy(F.col("ancestor").alias("_below")).agg(F.array_sort(F.collect_set("id")).alias("_children"))
        key = F.upper(names.unique_id(F.col("full_name")))
        out = out.join(leaving, key == F.col("_outk"), "left").join(coming, key == F.col("_ink"), "left").join(below, key == F.col("_below"), "left")
    else:
        out = out.withColumn("_out", F.lit(None).cast("string")).withColumn("_in", F.lit(None).cast("string")).withColumn("_children", F.lit(None).cast("array<string>"))
    none, empty = F.lit("*None*"), F.lit("")
    nested = F.col("is_nested") if "is_nested" in types.columns else F.lit(False)
    kind = F.when(nested, "engine_nested_class").when(F.col("is_enum"), "engine_enum").otherwise("engine_class")
    base = F.when(F.col("base_type").isNotNull() & ~nested, F.concat(F.lit('base_type: "'), "base_type", F.lit('"\n'))).otherwise(empty)
    front = F.concat(F.lit("---\ntype: "), kind, F.lit("\nnamespace: "), F.coalesce("namespace", empty), F.lit("\n"), base, F.lit("---\n"))
    told = F.coalesce(F.concat(F.lit("> "), F.replace(F.trim("summary"), F.lit("\n"), F.lit("\n> ")), F.lit("\n\n")), empty)
    tables = F.when(F.col("is_enum"), F.concat(F.lit("## Fields (Values)\n"), F.coalesce("_values", empty), F.lit("\n\n"))).otherwise(
        F.concat(F.coalesce("field", empty), F.coalesce("property", empty), F.coalesce("method", empty)))
    links = F.concat(F.lit("## Dependencies\n\n### Out\n"), F.coalesce("_out", none), F.lit("\n\n### In\n"), F.coalesce("_in", none), F.lit("\n"))
    family = F.coalesce(F.concat(F.lit("\n## Derivatives\n\n"), F.array_join(F.transform("_children", lambda c: F.concat(F.lit("- [["), c, F.lit("]]"))), "\n"), F.lit("\n")), empty)
    note = F.concat(front, F.lit("# "), names.unique_id(F.col("full_name")), F.lit("\n\n"), told, F.lit("---\n\n"), tables, links, family)
    return out.select("full_name", note.alias("note"))


def home_index(families: DataFrame) -> DataFrame:
    """``rank, line``: a line for each large family (``ancestor, descendants``), the largest first, after the catalogs."""
    from pyspark.sql import Window

    by = F.row_number().over(Window.orderBy(F.desc("descendants"), "ancestor"))  # families only
    line = F.concat(F.lit("- [["), names.unique_id(F.col("ancestor")), F.lit("]] ("), F.col("descendants").cast("string"), F.lit(" classes)"))
    head = families.sparkSession.createDataFrame([(-2, "- [[Enums_Catalog]] — All enumerations"), (-1, "- [[Attributes_Catalog]] — All decorator attributes")], "rank int, line string")
    return head.unionByName(families.select(by.alias("rank"), line.alias("line"))).orderBy("rank")


def path_text(start: str, steps: DataFrame) -> str:
    """Numbered steps; the arrow shows which end of each edge the walk is at."""
    lines, at = [], start.upper()
    for r in steps.orderBy("step").collect():  # as many rows as the path has steps
        ahead = r.src.upper() == at
        lines.append(f"{r.step}. {r.src} ──[{r.kind}]──> {r.dst}" if ahead else f"{r.step}. {r.dst} <──[{r.kind}]── {r.src}")
        at = (r.dst if ahead else r.src).upper()
    return "\n".join(lines)
