"""Nodes and edges from C# and Razor source text, and from an API registry."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import names

from .model import PropertyGraph, first_edges, first_per_key, upsert_nodes
from .tokens import declared_types, ordered_edges


def resolve_names(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Targets that are a node's simple name become its id, the first node's on a tie; others stay. Self edges go."""
    first = nodes.groupBy(F.upper("name").alias("_n")).agg(F.min_by("id", "seq").alias("_id"))
    joined = edges.join(first, F.upper("dst") == F.col("_n"), "left").withColumn("dst", F.coalesce("_id", "dst"))
    return joined.drop("_n", "_id").where(F.upper("src") != F.upper("dst"))


def razor_edges(sources: DataFrame, nodes: DataFrame) -> DataFrame:
    """One edge from a file's stem to each interface node whose tag it uses: distinct tags, then an equi-join."""
    tags = F.expr(r"array_distinct(regexp_extract_all(text, '<([A-Z][A-Za-z0-9_]*)', 1))")
    stem = F.regexp_extract("path", r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)
    used = sources.select(stem.alias("src"), F.explode(tags).alias("tag"))
    used = used.groupBy("src", F.upper("tag").alias("k")).agg(F.min("tag").alias("tag")).where(F.upper("src") != F.col("k"))
    ui = nodes.where("category in ('UiPanel', 'UiPanelComponent')").groupBy(F.upper("name").alias("k")).agg(F.min_by("id", "seq").alias("dst"))
    return used.join(ui, "k").select("src", "dst", F.lit("RazorMarkupTag").alias("kind"), F.concat(F.lit("Markup tag <"), "tag", F.lit(" />")).alias("details"))


def razor_to_csharp(text: str, class_name: str) -> str | None:
    """C# for the first ``@code`` block; nothing without one."""
    m = re.search(r"@code\s*\{", text)
    if not m:
        return None
    depth, end = 1, m.end()
    while end < len(text) and depth:
        depth += (text[end] == "{") - (text[end] == "}")
        end += 1
    usings = "".join(f"using {u};\n" for u in re.findall(r"^@using\s+([\w.]+)", text, re.M))
    base = re.search(r"^@inherits\s+([\w.<>]+)", text, re.M)
    return f"{usings}public partial class {class_name} : {base[1] if base else 'Panel'} {{{text[m.end() : end - 1]}}}"


def razor_code(text: Column | str, class_name: Column | str) -> Column:
    """:func:`razor_to_csharp` as a column; matching braces has no expression."""

    def run(texts: pd.Series, classes: pd.Series) -> pd.Series:
        return pd.Series([razor_to_csharp(t or "", c) for t, c in zip(texts, classes, strict=True)])

    return F.pandas_udf(run, "string")(text, class_name)


def razor_sources(sources: DataFrame) -> DataFrame:
    """``path, text`` of what a compiler would read: C# files as they are, Razor files' code blocks, none without one."""
    stem = F.regexp_extract("path", r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)
    razor = F.lower("path").endswith(".razor")
    code = sources.where(razor).select("path", razor_code(F.col("text"), stem).alias("text")).where("text is not null")
    return sources.where(~razor).select("path", "text").unionByName(code)


def markup_edges(sources: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges of Razor files' markup before ``@code``: tags of declared classes (``name``), and their ``@Class.`` expressions, in any case.

    What tags and expressions name is read first and then joined, rather than every class being looked for in every file.
    """
    stem = F.regexp_extract("path", r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)
    markup = F.substring_index("text", "@code", 1)
    found = lambda pattern, kind, details: F.transform(
        F.array_distinct(F.transform(F.regexp_extract_all(markup, F.lit(pattern), F.lit(1)), lambda x: F.upper(x))),
        lambda x: F.struct(x.alias("k"), F.lit(kind).alias("kind"), F.lit(details).alias("details")),
    )
    used = F.concat(found(r"<([A-Za-z_]\w*)(?=[\s>/])", "UI_NestedComponent", "HTML Tag"), found(r"@([A-Za-z_]\w*)\.", "Calls", "HTML Expression"))
    rows = sources.where(F.lower("path").endswith(".razor")).select(stem.alias("src"), F.explode(used).alias("u")).select("src", "u.*").distinct()
    known = classes.groupBy(F.upper("name").alias("k")).agg(F.min("name").alias("dst"))
    return rows.join(known, "k").where("src <> dst").select("src", "dst", "kind", "details")


#: A tag's name, in any case.
TAG = r"<([a-zA-Z][A-Za-z0-9_]*)"


def tag_counts(pages: DataFrame, html: str) -> DataFrame:
    """``tag, n``: uses of each tag."""
    tags = pages.select(F.explode(F.regexp_extract_all(html, F.lit(TAG), F.lit(1))).alias("tag"))
    return tags.groupBy(F.lower("tag").alias("tag")).agg(F.count(F.lit(1)).alias("n"))


def tag_links(pages: DataFrame, src: Column, html: str) -> DataFrame:
    """``src, dst``: an edge from each page to each tag it uses."""
    tags = F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(TAG), F.lit(1)), lambda t: F.lower(t)))
    return pages.select(src.alias("src"), F.explode(tags).alias("dst"))


def link_degrees(pages: DataFrame, html: str) -> DataFrame:
    """``href, in_degree``: pages that link to each address."""
    links = F.array_distinct(F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1)))
    return pages.select(F.explode(links).alias("href")).groupBy("href").agg(F.count(F.lit(1)).alias("in_degree"))


def api_types(document: DataFrame) -> DataFrame:
    """One row for each type of an API document, the first of those with one name."""
    rows = document.select(F.posexplode("Types").alias("seq", "t"))
    full = F.coalesce("t.FullName", "t.Name")
    flat = rows.select("seq", F.col("t.Name").alias("name"), full.alias("full_name"), names.namespace(full).alias("namespace"), F.col("t.BaseType").alias("base_type"),
                       F.coalesce("t.IsInterface", F.lit(False)).alias("is_interface"), F.coalesce("t.IsEnum", F.lit(False)).alias("is_enum"),
                       (F.coalesce("t.IsEnum", F.lit(False)) | F.coalesce(F.col("t.BaseType") == "System.ValueType", F.lit(False))).alias("is_value_type"),
                       (F.coalesce("t.Name", F.lit("")).endswith("Attribute") | F.coalesce("t.BaseType", F.lit("")).endswith("Attribute")).alias("is_attribute"),
                       (F.col("t.DeclaringType").isNotNull() | F.contains(full, F.lit("+"))).alias("is_nested"), F.col("t.Documentation.Summary").alias("summary"))
    return first_per_key(flat, F.upper("full_name"))


def api_members(document: DataFrame) -> DataFrame:
    """Members of all types of one name together; the first of those with one document id stays."""
    t = document.select(F.posexplode("Types").alias("type_seq", "t")).withColumn("full", F.coalesce("t.FullName", "t.Name"))

    def part(kind, letter, array, type_field):
        m = t.select("type_seq", "full", F.posexplode(f"t.{array}").alias("seq", "m"))
        params = F.transform("m.Parameters", lambda p: p["ParameterType"]) if kind == "method" else None
        no_params = F.array().cast("array<string>")
        return m.select("type_seq", "seq", F.lit(kind).alias("member_kind"), F.upper("full").alias("type_key"), F.col("full").alias("type_name"), F.col("m.Name").alias("name"),
                        names.doc_id(letter, F.col("full"), F.col("m.Name"), F.coalesce(params, no_params) if params is not None else None).alias("doc_id"),
                        F.col(f"m.{type_field}").alias("member_type"), F.coalesce("m.IsPublic", F.lit(False)).alias("is_public"), F.coalesce("m.IsStatic", F.lit(False)).alias("is_static"),
                        F.col("m.Documentation.Summary").alias("summary"), (F.coalesce(params, no_params) if params is not None else no_params).alias("params"))

    rows = part("field", "F", "Fields", "FieldType").unionByName(part("property", "P", "Properties", "PropertyType")).unionByName(part("method", "M", "Methods", "ReturnType"))
    rank = F.row_number().over(Window.partitionBy("type_key", F.upper("doc_id")).orderBy("type_seq", "seq"))
    return rows.withColumn("_r", rank).where("_r = 1").drop("_r")


def api_edges(types: DataFrame, members: DataFrame) -> DataFrame:
    """Inheritance, and references to the types of members and parameters and to their generic arguments.

    Names resolve by full name, else by the first type of that short name; value types aren't linked.
    """
    uses = members.select("type_name", F.concat(F.initcap("member_kind"), F.when(F.col("member_kind") == "method", F.lit(" Return: ")).otherwise(F.lit(": ")), "name").alias("details"), F.col("member_type").alias("used"))
    uses = uses.unionByName(members.select("type_name", F.concat(F.lit("Method Param: "), "name").alias("details"), F.explode("params").alias("used")))
    uses = uses.where("used is not null").select("type_name", "details", F.explode(F.transform(names.type_signature("used"), lambda s: s["full_name"])).alias("used"), F.lit("References").alias("kind"))
    uses = uses.unionByName(types.where("base_type is not null").select(F.col("full_name").alias("type_name"), F.lit("Base Class").alias("details"), F.col("base_type").alias("used"), F.lit("Inherits").alias("kind")))
    full = types.select(F.upper("full_name").alias("_f"), F.col("full_name").alias("_by_full"), F.col("is_value_type").alias("_v1"))
    short = types.groupBy(F.upper("name").alias("_s")).agg(F.min_by("full_name", "seq").alias("_by_short"), F.min_by("is_value_type", "seq").alias("_v2"))
    found = uses.join(full, F.upper("used") == F.col("_f"), "left").join(short, F.upper(F.substring_index("used", ".", -1)) == F.col("_s"), "left")
    found = found.withColumn("dst", F.coalesce("_by_full", "_by_short")).where("dst is not null and dst <> type_name")
    found = found.where((F.col("kind") == "Inherits") | ~F.coalesce("_v1", "_v2"))
    return found.select(F.col("type_name").alias("src"), "dst", "kind", "details").distinct()


def type_edges(types: DataFrame, properties: DataFrame, interfaces: DataFrame) -> DataFrame:
    """Edges of a type catalogue: property references to unwrapped types, base classes except ``object``, and interfaces.

    ``types(full_name, base_type, seq)``, ``properties(full_name, name, member_type, seq)``,
    ``interfaces(full_name, interface, seq)`` with all that a type implements.
    """
    fqn = lambda c: names.type_fqn(F.col(c))
    leaves = names.unwrapped(names.type_signature("member_type"))
    uses = properties.select(fqn("full_name").alias("src"), F.explode(leaves).alias("dst"), F.lit("PropertyReference").alias("kind"),
                             F.concat(F.lit("Property '"), "name", F.lit("'")).alias("details"), "seq").where(F.upper("src") != F.upper("dst"))
    base = types.where("base_type is not null and base_type not in ('System.Object', 'object')")
    base = base.select(fqn("full_name").alias("src"), fqn("base_type").alias("dst"), F.lit("Inherits").alias("kind"), F.lit("Base Class").alias("details"), "seq")
    faces = interfaces.select(fqn("full_name").alias("src"), fqn("interface").alias("dst"), F.lit("Implements").alias("kind"), F.lit("Interface Implementation").alias("details"), "seq")
    return first_edges(uses.unionByName(base).unionByName(faces).withColumn("line_number", F.lit(0)))


def type_methods(methods: DataFrame) -> DataFrame:
    """``full_name, methods``: names, return types, summaries and staticness of each type's methods, in order."""
    row = F.struct("seq", "name", F.coalesce("member_type", F.lit("void")).alias("type_name"), F.coalesce("summary", F.lit("")).alias("description"), "is_static")
    kept = F.transform(F.array_sort(F.collect_list(row)), lambda m: F.struct(*[m[c].alias(c) for c in ("name", "type_name", "description", "is_static")]))
    return methods.groupBy("full_name").agg(kept.alias("methods"))


def rebuild(catalogue: PropertyGraph, sources: DataFrame) -> PropertyGraph:
    """The graph of a type catalogue and a source tree: catalogue first, then declarations and their edges, then Razor tags.

    A declared type that the catalogue has only gains its file; targets resolve by
    simple name over all nodes; tags bind to the interface nodes there are by then.
    """
    code = sources.where(F.lower("path").endswith(".cs"))
    declared = declared_types(code).groupBy(F.upper("name").alias("_k")).agg(F.min(F.struct("path", "name", "category")).alias("d"))
    nodes = catalogue.nodes if "file_path" in catalogue.nodes.columns else catalogue.nodes.withColumn("file_path", F.lit(None).cast("string"))
    known = nodes.join(declared.select("_k", F.col("d.path").alias("_path")), F.upper("id") == F.col("_k"), "left")
    known = known.withColumn("file_path", F.coalesce(F.nullif("file_path", F.lit("")), "_path")).drop("_k", "_path")
    new = declared.join(nodes.select(F.upper("id").alias("_k")), "_k", "left_anti").select("d.*")
    last = F.lit(1 << 50)
    new = new.select(F.col("name").alias("id"), "name", "category", F.lit("UserProject").alias("origin"), F.col("path").alias("file_path"), F.lit("").alias("namespace"),
                     (last + F.xxhash64("name").bitwiseAND(F.lit((1 << 49) - 1))).alias("seq"))
    nodes = upsert_nodes(known.unionByName(new, allowMissingColumns=True))
    order = F.xxhash64("path").bitwiseAND(F.lit((1 << 29) - 1)) * F.lit(1 << 20) + F.col("n")
    walked = resolve_names(ordered_edges(code).withColumn("seq", last + order).drop("path"), nodes)
    tags = razor_edges(sources.where(F.lower("path").endswith(".razor")), nodes).withColumn("seq", F.lit(1 << 51)).withColumn("line_number", F.lit(0))
    columns = ["seq", "src", "dst", "kind", "details", "line_number"]
    raw = catalogue.edges.select(*columns).unionByName(walked.select(*columns)).unionByName(tags.select(*columns))
    return PropertyGraph(nodes, first_edges(raw), raw)
