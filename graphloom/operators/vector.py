"""Exact vector search, pooled filters and hybrid results."""

from __future__ import annotations

import threading
import uuid
from functools import reduce

import pandas as pd
from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import names
from graphloom.sources.files import INDEX_HOMES, path_exists

from .lookup import with_members
from .model import dense_index
from .views import keyword_search


def inner_product(column: str, query: list[float]) -> Column:
    """In doubles; expressions only, so the scan stays in the JVM."""
    parts = F.zip_with(column, F.array(*[F.lit(float(x)) for x in query]), lambda a, b: a.cast("double") * b)
    return F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)


def top_k(chunks: DataFrame, query: list[float], k: int | None = 5, threshold: float = 0.0, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """The ``k`` best by score, then those at or over ``threshold``: a threshold never lets others move up.

    Each task keeps its own ``k`` best, so the search needs no shuffle of vectors.
    """
    k = k if k and k > 0 else 5
    scored = chunks.withColumn("score", inner_product(vector, query))
    return scored.orderBy(F.desc("score"), id_col).limit(k).where(F.col("score") >= threshold)


def pool_size(limit: int, all_types: bool) -> int:
    return limit if all_types else min(max(limit * 10, 20), 100)


def pooled(chunks: DataFrame, query: list[float], limit: int, keep: Column | None, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """The best of a capped pool that pass ``keep``."""
    pool = top_k(chunks, query, pool_size(limit, keep is None), -1e9, id_col, vector)
    return (pool if keep is None else pool.where(keep)).orderBy(F.desc("score"), id_col).limit(limit)


def hybrid(keyword: DataFrame, semantic: DataFrame) -> DataFrame:
    """Keyword results and then semantic ones, as two sections; scores aren't fused.  Both have ``rank, label``."""
    part = lambda df, name: df.select(F.lit(name).alias("section"), "rank", "label")
    return part(keyword, "keyword").unionByName(part(semantic, "semantic"))


def quantise(vector: str, bits: int = 4) -> Column:
    """Signed integers of ``bits`` bits for each dimension of a unit vector; an approximation for a first pass."""
    top = (1 << (bits - 1)) - 1
    scale = F.array_max(F.transform(vector, lambda x: F.abs(x)))
    return F.transform(vector, lambda x: F.round(x / F.greatest(scale, F.lit(1e-12)) * top).cast("tinyint"))


def encoded(texts: DataFrame, encode, column: str = "text", prefix: str = "passage: ", name: str = "embedding") -> DataFrame:
    """``texts`` with the vectors that ``encode`` (a list of strings to a list of vectors) gives a batch of ``prefix`` and text."""

    def run(values: pd.Series) -> pd.Series:
        return pd.Series([[float(x) for x in v] for v in encode([prefix + (t or "") for t in values])])

    return texts.withColumn(name, F.pandas_udf(run, "array<float>")(column))


#: The first number of an index's documents.
FIRST_ID = 10_000


def build_index(documents: DataFrame, encode=None, bits: int = 4) -> DataFrame:
    """Chunks with numeric ids from 10000 in ``seq`` order, their vectors (``encode``, or as they are) and quantised codes."""
    numbered = dense_index(documents).withColumn("numeric_id", F.col("idx") + FIRST_ID).drop("idx")
    numbered = numbered if encode is None else encoded(numbered, encode)
    if "embedding" not in numbered.columns:
        return numbered
    scale = F.array_max(F.transform("embedding", lambda x: F.abs(x))) / F.lit(float((1 << (bits - 1)) - 1))
    return numbered.withColumn("code", quantise("embedding", bits)).withColumn("scale", scale.cast("float"))


def write_index(documents: DataFrame, folder: str, encode=None, bits: int = 4) -> dict:
    """An index of ``documents(seq, id, fqn, type, text)`` under ``folder``, overwriting; none for no documents."""
    if documents.isEmpty():
        return {"status": "empty"}
    path = f"{folder.rstrip('/')}/vec/semantic_index"
    build_index(documents, encode, bits).write.mode("overwrite").parquet(path)
    return {"status": "ok", "indexed_count": documents.sparkSession.read.parquet(path).count(), "output_dir": folder}


def load_index(spark: SparkSession, base: str) -> DataFrame:
    """The index under the first of the folders it may be in; an error if it is in none."""
    for sub in INDEX_HOMES:
        path = "/".join(x for x in (base.rstrip("/"), sub, "semantic_index") if x)
        if path_exists(spark, path):
            return spark.read.parquet(path)
    raise FileNotFoundError(f"no index under {base}")


def approximate_top_k(index: DataFrame, query: list[float], k: int = 5, threshold: float = 0.0, over: int = 10, id_col: str = "numeric_id") -> DataFrame:
    """The ``k`` best of an index: ``over`` times as many by their codes, then these by their vectors; exact for a large ``over``."""
    rough = inner_product("code", query) * F.col("scale")
    pool = index.withColumn("_rough", rough).orderBy(F.desc("_rough"), id_col).limit(k * over).drop("_rough")
    return top_k(pool, query, k, threshold, id_col)


def quantised_top_k(index: DataFrame, query: list[float], k: int = 5, threshold: float = 0.0, over: int = 10, id_col: str = "numeric_id") -> DataFrame:
    """The ``k`` best of an index, exactly: its codes leave out what can't be among them.

    A component is within half a step of its code, so a score is within half of ``scale`` times the sum of
    the query's components of what the codes give.  The ``k``-th score of :func:`approximate_top_k` is
    reached by ``k`` rows, so rows that can't reach it go, and the others are compared by their vectors.
    """
    k = k if k and k > 0 else 5
    found = approximate_top_k(index, query, k, float("-inf"), over, id_col).agg(F.count("score").alias("n"), F.min("score").alias("least")).first()
    if found.n < k:
        return top_k(index, query, k, threshold, id_col)
    size = sum(abs(float(x)) for x in query)
    most = inner_product("code", query) * F.col("scale") + F.col("scale").cast("double") * (0.5001 * size) + 1e-9 * (1 + size)  # half a step, and roundings
    return top_k(index.where(most >= found.least), query, k, threshold, id_col)


def semantic_search(index: DataFrame, text: str, encode, limit: int = 5, threshold: float = 0.0) -> DataFrame:
    """``numeric_id, id, fqn, type, score, preview`` of the best hits of a text, and what their previews say of place and file."""
    query = [float(x) for x in encode([f"query: {text.strip()}"])[0]]
    hits = top_k(index, query, limit, threshold, "numeric_id").select("numeric_id", "id", "fqn", "type", "score", F.col("text").alias("preview"))
    has = lambda mark: F.contains("preview", F.lit(mark))
    file = F.coalesce(F.nullif(F.rtrim(names.preview_file(F.col("preview"))), F.lit("")), F.concat("fqn", F.lit(".cs")))
    return hits.withColumn("namespace", F.when(has("Namespace:"), names.preview_namespace(F.col("preview"))).otherwise("global")).withColumn(
        "file", F.when(has("Source file:"), file).otherwise(F.concat("fqn", F.lit(".cs")))
    ).withColumn("score_text", names.score_text(F.col("score")))


#: Seconds that the semantic section of an answer may take.
GUARD = 35.0


def guarded(spark: SparkSession, make, seconds: float) -> DataFrame | None:
    """The rows of ``make()``, a small result, if they are there in ``seconds``; else nothing, and its jobs are cancelled.

    They run in a thread of their own under a job tag.  A call that is still in Python
    code at the deadline starts no job after it.
    """
    tag, over, box = f"guarded-{uuid.uuid4().hex}", threading.Event(), []

    def run() -> None:
        spark.sparkContext.addJobTag(tag)
        try:
            df = make()
            if not over.is_set():
                box.append((df.collect(), df.schema))
        except Exception as e:  # an error is the caller's, unless the deadline made it
            box.append(e)

    thread = InheritableThread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if thread.is_alive():
        over.set()
        for _ in range(10):  # a job may be about to start
            spark.sparkContext.cancelJobsWithTag(tag)
            thread.join(0.2)
            if not thread.is_alive():
                break
        return None
    if isinstance(box[0], Exception):
        raise box[0]
    return spark.createDataFrame(*box[0])


def api_search(
    types: DataFrame, members: DataFrame, index: DataFrame | None, text: str, encode=None, mode: str = "hybrid", member_type: str = "all", limit: int = 5, fallback=None, seconds: float | None = None
) -> DataFrame:
    """``section, rank, label, type, score`` of a search of the API: by keyword, by meaning, or one after the other.

    A semantic section takes a pool of the best, keeps those of the member type, and
    enriches them with the member that a hit stands for.  With ``seconds``, an answer by
    both leaves the semantic section out if it takes longer.
    """
    mode = mode.lower().strip()
    parts = []
    if mode in ("keyword", "hybrid"):
        found = keyword_search(types, members, text, limit, member_type, fallback)
        rank = F.row_number().over(Window.orderBy("tier", "type_seq", "member_seq"))  # over a top-k
        parts.append(found.select(F.lit("keyword").alias("section"), rank.alias("rank"), "label", F.lower("badge").alias("type"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("member")))
    if mode in ("semantic", "hybrid") and index is not None and encode is not None:
        def semantic() -> DataFrame:
            query = [float(x) for x in encode([f"query: {text.strip()}"])[0]]
            keep = None if member_type == "all" else names.member_type_is(F.col("type"), member_type)
            pool = top_k(index, query, pool_size(limit, keep is None), -1e9, "numeric_id")
            pool = pool.where(~F.col("fqn").rlike("[<$]") & (F.lit(True) if keep is None else keep))
            hits = pool.orderBy(F.desc("score"), "numeric_id").limit(limit).select("numeric_id", "id", "fqn", "type", "score")
            rank = F.row_number().over(Window.orderBy(F.desc("score"), "numeric_id"))  # over a top-k
            rich = with_members(hits, members)
            return rich.select(F.lit("semantic").alias("section"), rank.alias("rank"), F.col("fqn").alias("label"), "type", "score", F.col("doc_id").alias("member"))

        found = semantic() if seconds is None or mode == "semantic" else guarded(types.sparkSession, semantic, seconds)
        parts += [] if found is None else [found]
    if not parts:
        raise ValueError(f"unknown mode {mode!r}, or no index")
    return reduce(DataFrame.unionByName, parts)
