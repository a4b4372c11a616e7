"""Near copies by word shingles: SimHash groups, compared exactly, and the exact join of shingle sets for what 64 bits can't reach."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, identity, join_by_heat
from .components import star_components
from .jaccard_join import jaccard_components
from .simhash import POSTING, near_duplicates, shingle_hashes

SHINGLE, SIMILAR = 5, 0.8
#: Texts whose shingles are asked for that a broadcast may name.
BROADCAST_ENDS = 200_000


def in_common(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """Shingles that two texts have in common and in all, repeats counted."""
    (one, m), (two, n) = np.unique(x, return_counts=True), np.unique(y, return_counts=True)
    _, i, j = np.intersect1d(one, two, assume_unique=True, return_indices=True)
    both = int(np.minimum(m[i], n[j]).sum())
    return both, len(x) + len(y) - both


def _text(key: str) -> Column:
    """The part of a row's identity that tells its text."""
    return F.struct(F.col(f"{key}.h1").alias("h1"), F.col(f"{key}.h2").alias("h2"))


def _shingles(rows: DataFrame, shingle: int) -> DataFrame:
    """``node, hashes`` of every row: its text and all its shingles, repeats included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_hashes(t.as_py() or "", shingle).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["node", "hashes"])

    return rows.select(_text("doc_id").alias("node"), "text").mapInArrow(run, "node struct<h1:bigint,h2:bigint>, hashes binary")


def _similar(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` whose shingles ``x`` and ``y`` have ``percent`` of all in common; blank texts are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = ([np.frombuffer(v.as_py(), np.uint64) for v in batch.column(c)] for c in (2, 3))
            counts = [in_common(x, y) for x, y in zip(*ends, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array([100 * both >= percent * every for both, every in counts], pa.bool_()))

    return pairs.mapInArrow(run, "a struct<h1:bigint,h2:bigint>, b struct<h1:bigint,h2:bigint>")


def _confirmed(near: DataFrame, rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``a, b``: texts of the SimHash groups ``near`` that have enough in common with the text of their group's least row."""
    ends = near.groupBy(_text("doc_id").alias("a"), _text("component_id").alias("b"))
    ends = cut(ends.agg(F.min("doc_id").alias("x"), F.min("component_id").alias("y")).where("a <> b"))
    some = cut(ends.select(F.col("x").alias("_id")).union(ends.select("y")).distinct())
    some = F.broadcast(some) if some.count() <= BROADCAST_ENDS else some.hint("merge")  # texts stay where they are, or are shuffled
    texts = _shingles(rows.join(some, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi"), shingle)
    texts = cut(texts.dropDuplicates(["node"]))
    of = lambda end, name: texts.select(F.col("node").alias(end), F.col("hashes").alias(name))
    pairs = ends.select("a", "b").join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", "x", "y")
    return _similar(pairs, percent)


def near_texts(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similar: float = SIMILAR, posting: int = POSTING
) -> DataFrame:
    """One row per distinct text: ``node, m, least``, the text's hash, its rows, and the least :func:`identity` of its group.

    See :func:`near_copies` for the groups.
    """
    percent = round(100 * similar)
    if abs(percent - 100 * similar) > 1e-9:
        raise ValueError("a similarity has to be whole percents")
    rows = docs.select(identity(id_col, text_col).alias("doc_id"), F.col(text_col).alias("text"))
    near = cut(near_duplicates(rows, shingle=shingle, posting=posting).select("doc_id", "component_id"))
    links = _confirmed(near, rows, shingle, percent)
    joined = jaccard_components(rows, shingle=shingle, percent=percent)
    joined = joined.groupBy(_text("doc_id").alias("node"), _text("component_id").alias("other"))
    joined = cut(joined.agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("m")))
    links = links.unionByName(joined.select(F.col("node").alias("a"), F.col("other").alias("b")))
    roots = star_components(links, "a", "b").withColumnRenamed("u", "node")

    # Rows of one text may be in several components only where it is blank.
    texts = joined.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.sum("m").alias("m"))
    texts = cut(texts.join(roots, "node", "left").select("node", "m", "doc_id", F.coalesce("v", "node").alias("root")))
    named = texts.groupBy("root").agg(F.min("doc_id").alias("least"))
    return cut(texts.join(named, "root").select("node", "m", "least"))


def near_copies(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similar: float = SIMILAR, posting: int = POSTING
) -> DataFrame:
    """One row per input row: ``doc_id, component_id``, the smallest id of the row's component.

    A component has all rows reachable over links of two kinds, each made whole by
    its operator.  SimHash groups (:func:`near_duplicates`: fingerprints of word
    shingles within 2 bits) link each text to the group's least one if, repeats
    counted, they have ``similar`` of their shingles in common: texts that repeat a
    passage are found by it although their sets differ.  A fingerprint of 64 bits
    misses most pairs near 0.8, so all pairs whose sets of shingles have a Jaccard
    similarity of ``similar`` or more are linked too, by the exact join of op12
    (:func:`jaccard_components`).

    Null and blank texts are one node; texts of fewer words than a shingle are one
    shingle.  Null ids are never a component's smallest id unless it has no others.
    An empty table gives an empty result; other columns are ignored.
    """
    found = near_texts(docs, id_col=id_col, text_col=text_col, shingle=shingle, similar=similar, posting=posting)
    rows = docs.select(identity(id_col, text_col).alias("key")).select(F.col("key.i").alias("doc_id"), _text("key").alias("node"))
    return join_by_heat(rows, found, ["node"], "m", BROADCAST_ENDS).select("doc_id", F.col("least.i").alias("component_id"))
