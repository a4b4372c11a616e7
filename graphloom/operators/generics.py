"""Generic parameters, arities, overloads and nested names of API types."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import names
from graphloom.runtime import settled


def _used(members: DataFrame) -> DataFrame:
    """``type_key, doc_id, member_kind, used``: names of member and parameter types and of their first arguments level."""
    texts = members.select("type_key", "doc_id", "member_kind", F.explode(F.array_compact(F.concat(F.array("member_type"), F.coalesce("params", F.array().cast("array<string>"))))).alias("text"))
    near = F.filter(names.type_signature("text"), lambda s: s["depth"] <= 1)
    return texts.select("type_key", "doc_id", "member_kind", F.explode(F.transform(near, lambda s: s["clean_name"])).alias("used"))


def generic_names(members: DataFrame, types: DataFrame) -> DataFrame:
    """Uses whose name looks like a generic parameter and is no known type's."""
    known = types.select(F.upper("name").alias("_n")).distinct()
    return _used(members).where(names.is_generic_param(F.col("used"))).join(known, F.upper("used") == F.col("_n"), "left_anti")


def class_parameters(members: DataFrame, types: DataFrame) -> DataFrame:
    """``type_key, generics``: a type's inferred parameters, once in any case, in order."""
    once = generic_names(members, types).groupBy("type_key", F.upper("used").alias("_k")).agg(F.min("used").alias("used"))
    return once.groupBy("type_key").agg(F.array_sort(F.collect_list("used")).alias("generics"))


def method_parameters(members: DataFrame, types: DataFrame, of_class: DataFrame) -> DataFrame:
    """``type_key, doc_id, generics``: a method's inferred parameters without its type's (``of_class``)."""
    own = generic_names(members.where("member_kind = 'method'"), types)
    own = own.groupBy("type_key", "doc_id").agg(F.array_sort(F.collect_set("used")).alias("own"))
    joined = own.join(of_class, "type_key", "left")
    return joined.select("type_key", "doc_id", F.array_except("own", F.coalesce("generics", F.array().cast("array<string>"))).alias("generics"))


def arities(types: DataFrame, of_class: DataFrame) -> DataFrame:
    """``full_name, arity``: the number after a tick, else of inferred parameters."""
    tick = F.expr("try_cast(nullif(regexp_extract(full_name, '`([0-9]+)', 1), '') as int)")
    joined = types.join(of_class, F.upper("full_name") == F.col("type_key"), "left")
    return joined.select("full_name", F.coalesce(tick, F.size("generics"), F.lit(0)).alias("arity"))


def by_namespace(types: DataFrame, default: str = "Sandbox") -> DataFrame:
    """The first type of each namespace, name and arity; an empty namespace is ``default``."""
    space = F.coalesce(F.nullif("namespace", F.lit("")), F.lit(default))
    return types.groupBy(space.alias("namespace"), "name", "arity").agg(F.min_by("full_name", "seq").alias("full_name"), F.min("seq").alias("seq"))


def first_overloads(members: DataFrame) -> DataFrame:
    """One member for each type, kind, name, generic parameters (where there is such a column) and parameter types, the first."""
    key = F.concat_ws(",", F.coalesce("params", F.array().cast("array<string>")))
    generics = F.concat_ws(",", "generics") if "generics" in members.columns else F.lit("")
    rank = F.row_number().over(Window.partitionBy("type_key", "member_kind", "name", generics, key).orderBy("type_seq", "seq"))
    return members.withColumn("_r", rank).where("_r = 1").drop("_r")


def message_counts(messages: DataFrame, limit: int = 100) -> DataFrame:
    """``message, n, first_seq``: how often and where first, of the ``limit`` messages that came first."""
    counts = messages.groupBy("message").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))
    return counts.orderBy("first_seq").limit(limit)


def flattened_names(types: DataFrame) -> DataFrame:
    """``id, flat_name``: own name after those of all enclosing types, joined by ``_`` (``id, name, parent``).

    A join for each level of nesting, as many as there are; types that enclose each other in a ring are an error.
    """
    outer = types.select(F.upper("id").alias("_k"), F.col("name").alias("_name"), F.upper("parent").alias("_up"))
    rows = types.select("id", F.col("name").alias("flat_name"), F.upper("parent").alias("_at"))
    outer = settled(outer)
    done, depth, nodes = None, 0, types.count()
    while True:
        rows = settled(rows.join(outer, F.col("_at") == F.col("_k"), "left"))
        ended = rows.where("_k is null").select("id", "flat_name")
        done = ended if done is None else done.unionByName(ended)
        rows = rows.where("_k is not null")
        left = rows.count()
        if not left:
            return done
        if depth > nodes:
            raise ValueError("types enclose each other in a ring")
        depth += 1
        rows = rows.select("id", F.concat("_name", F.lit("_"), "flat_name").alias("flat_name"), F.col("_up").alias("_at"))
