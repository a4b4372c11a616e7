"""Lookups between graphs, API types, chunks and vector hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import names


def first_match(df: DataFrame, column: str, name: str) -> DataFrame:
    """The first row named ``name``, else the first that ends in ``.name``, else the first that holds it; in any case."""
    upper, wanted = F.upper(column), name.strip().upper()
    tier = F.when(upper == wanted, 0).when(upper.endswith("." + wanted), 1).when(F.contains(upper, F.lit(wanted)), 2)
    return df.withColumn("_tier", tier).where("_tier is not null").orderBy("_tier", "seq").limit(1).drop("_tier")


def limited(df: DataFrame, n: int) -> tuple[DataFrame, int]:
    """The first ``n`` rows in ``seq`` order, and how many more there are."""
    return df.orderBy("seq").limit(n), max(0, df.count() - n)


def with_metadata(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits (``numeric_id, score``) with what is known of their chunks; unknown ids go."""
    return hits.join(chunks.select("numeric_id", "id", "fqn", "type", F.col("text").alias("preview")), "numeric_id")


def with_types(nodes: DataFrame, types: DataFrame) -> DataFrame:
    """Nodes with the first API type whose unique id is theirs; ``full_name`` is null without one."""
    keyed = types.groupBy(F.upper(names.unique_id(F.col("full_name"))).alias("_k"))
    keyed = keyed.agg(F.min_by(F.struct("full_name", "summary"), "seq").alias("_t"))
    joined = nodes.join(keyed, F.upper("id") == F.col("_k"), "left")
    return joined.select(*nodes.columns, F.col("_t.full_name").alias("full_name"), F.col("_t.summary").alias("summary"))


def with_members(hits: DataFrame, members: DataFrame) -> DataFrame:
    """Hits (``id, fqn``) with the member of that document id, else the first of that name in the parent type."""
    row = F.struct("doc_id", "member_type", "params")
    exact = members.groupBy(F.upper("doc_id").alias("_d")).agg(F.min_by(row, "seq").alias("_e"))
    named = members.groupBy("type_key", F.upper("name").alias("_n")).agg(F.min_by(row, "seq").alias("_f"))
    key = F.upper(F.regexp_extract("fqn", r"^(.*)\.[^.]*$", 1))
    joined = hits.join(exact, F.upper("id") == F.col("_d"), "left")
    joined = joined.join(named, (key == F.col("type_key")) & (F.upper(F.substring_index("fqn", ".", -1)) == F.col("_n")), "left")
    found = F.coalesce("_e", "_f")
    return joined.select(*hits.columns, *(found[c].alias(c) for c in ("doc_id", "member_type", "params")))


def global_aliases(members: DataFrame) -> DataFrame:
    """``alias, target``: each property of a type with ``Global`` in its name, and its type; the first stays."""
    rows = members.where((F.col("member_kind") == "property") & F.contains("type_name", F.lit("Global")))
    return rows.groupBy(F.col("name").alias("alias")).agg(F.min_by("member_type", F.struct("type_seq", "seq")).alias("target"))


def user_chunks(nodes: DataFrame) -> DataFrame:
    """One chunk for each node: ``id, fqn, type, text, seq``."""
    kind = F.lower(F.coalesce("category", F.lit("class")))
    file = F.regexp_extract(F.coalesce("file_path", F.lit("")), r"([^/\\]*)$", 1)
    text = F.concat(F.upper(kind), F.lit(": "), "id", F.lit(". Namespace: "), names.clean_namespace(F.col("namespace")), F.lit(". Source file: "), file, F.lit("."))
    return nodes.select(F.concat(F.lit("C:"), "id").alias("id"), F.col("id").alias("fqn"), kind.alias("type"), text.alias("text"), "seq")


def api_chunks(types: DataFrame, members: DataFrame) -> DataFrame:
    """Chunks of types, of public methods and of public properties; structs and interfaces count as classes."""
    described = F.coalesce(F.nullif(F.trim("summary"), F.lit("")), F.lit("No description."))
    kind = F.when(F.col("is_enum"), "enum").otherwise("class")
    head = F.concat(F.upper(kind), F.lit(": "), "full_name", F.lit(". Summary: "), described)
    out = types.select(F.concat(F.lit("C:"), names.unique_id(F.col("full_name"))).alias("id"), F.col("full_name").alias("fqn"), kind.alias("type"), head.alias("text"), "seq")
    shown = members.where("is_public and member_kind in ('method', 'property')")
    typed = F.when(F.col("member_kind") == "property", F.concat(F.lit(" ("), F.coalesce("member_type", F.lit("")), F.lit(")"))).otherwise("")
    text = F.concat(F.upper("member_kind"), F.lit(" in "), "type_name", F.lit(": "), "name", typed, F.lit(". Summary: "), described)
    part = shown.select(F.col("doc_id").alias("id"), F.concat("type_name", F.lit("."), "name").alias("fqn"), F.col("member_kind").alias("type"), text.alias("text"), F.col("type_seq").alias("seq"))
    return out.unionByName(part)
