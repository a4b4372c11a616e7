"""Batch builds: a source tree's graph and an API's documentation, as tables, documents, notes and vector indexes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import csharp, extract, lookup, paths, vector
from graphloom.operators.model import PropertyGraph, dense_index
from graphloom.runtime import settled
from graphloom.sinks import render
from graphloom.sources import files

#: File of ignore rules at the root of a source tree.
RULES = ".astignore"


def _written(df: DataFrame, path: str) -> int:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).count()


def _numbered(df: DataFrame) -> DataFrame:
    """Numbers from 0 in place of ``seq``, in its order."""
    return dense_index(df).withColumn("seq", F.col("idx")).drop("idx")


def project_sources(spark: SparkSession, root: str) -> DataFrame:
    """``path, text`` of C# files and of what Razor files turn into, without those that the tree's own rules leave out."""
    rules: list[str] = []
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{RULES}")
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(path):  # Spark's readers pass over files whose names begin with a dot
        stream = store.open(path)
        rules = files.parse_rules(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        stream.close()
    found = files.source_files(spark, root, rules)
    razor = F.lower("path").endswith(".razor")
    name = F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1)
    made = found.where(razor).select("path", extract.razor_code(F.col("text"), name).alias("text")).where("text is not null")
    return found.where(~razor).unionByName(made)


def user_graph(sources: DataFrame, types: DataFrame, members: DataFrame, engine_links: bool = True) -> PropertyGraph:
    """Declared classes of ``sources`` and their dependencies, on each other and on API types."""
    uses = settled(csharp.source_uses(sources))
    nodes = csharp.declared_classes(uses).select(
        F.col("name").alias("id"), "name", F.col("ns").alias("namespace"), F.lit("UserProject").alias("origin"), "category", F.col("path").alias("file_path"),
        F.concat_ws("\u0001", "path", "name").alias("seq"))
    nodes = _numbered(nodes)
    edges = csharp.dependency_edges(uses, csharp.engine_types(types, lookup.global_aliases(members)), engine_links)
    return PropertyGraph(settled(nodes), settled(edges))


def build_user(spark: SparkSession, root: str, out: str, types: DataFrame, members: DataFrame, engine_links: bool = True, encode: Callable | None = None) -> dict:
    """The graph of the source tree ``root`` under ``out``: ``tables``, ``graph`` (one document), ``notes``, ``canvas``, and an index with an encoder."""
    graph = user_graph(project_sources(spark, root), types, members, engine_links)
    render.write_tables(graph, f"{out}/tables")
    render.write_document(graph, f"{out}/graph")
    for part, df in zip(("nodes", "edges"), render.canvas(graph), strict=True):
        df.write.mode("overwrite").text(f"{out}/canvas/{part}")
    told = {"notes": _written(render.notes(graph), f"{out}/notes"), "edges": graph.edges.count()}
    return told | {"index": vector.write_index(lookup.user_chunks(graph.nodes), out, encode)["status"] if encode else "none"}


def build_engine(spark: SparkSession, out: str, types: DataFrame, members: DataFrame, encode: Callable | None = None) -> dict:
    """Documentation of an API under ``out``: ``notes``, ``catalogs``, ``home``, ``tables/edges``, and an index with an encoder."""
    if types.isEmpty():
        return {"notes": 0, "index": "skipped"}
    edges = extract.api_edges(types, members)
    edges = settled(_numbered(edges.withColumn("seq", F.concat_ws("\u0001", "src", "dst", "kind", "details"))))
    told = {"notes": _written(render.type_notes(types, members, edges), f"{out}/notes"), "edges": _written(edges, f"{out}/tables/edges")}
    for flag in ("is_enum", "is_attribute"):
        told[flag] = _written(render.type_catalog(types, flag), f"{out}/catalogs/{flag}")
    spelled = types.select(F.upper("full_name").alias("ancestor"), "full_name")
    families = paths.descendant_counts(paths.base_edges(types), 10).join(spelled, "ancestor").select(F.col("full_name").alias("ancestor"), "descendants")
    told["home"] = _written(render.home_index(families), f"{out}/home")
    return told | {"index": vector.write_index(lookup.api_chunks(types, members), out, encode)["status"] if encode else "none"}


def build(spark: SparkSession, mode: str, root: str, out: str, api: str | None = None, engine_links: bool = True, encode: Callable | None = None) -> dict:
    """Build ``user``, ``engine`` or ``both``, under ``user_code`` and ``engine_api`` of ``out``, and tell what was written.

    ``api`` is the API document; without one, user classes have no engine edges and the engine part is skipped.
    """
    if mode not in ("user", "engine", "both"):
        raise ValueError(f"unknown mode {mode!r}")
    document = files.api_document(spark, api)
    types, members = settled(extract.api_types(document)), settled(extract.api_members(document))
    told = {}
    if mode != "engine":
        told["user"] = build_user(spark, root, f"{out}/user_code", types, members, engine_links, encode)
    if mode != "user":
        told["engine"] = build_engine(spark, f"{out}/engine_api", types, members, encode)
    return told
