"""Exact deduplication by 128-bit content hash, with bytes compared inside each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, by_heat, cut

#: Hashes that occur twice or more which may be broadcast: the most frequent ones; the others are merged with the texts by a shuffle.
BROADCAST_HASHES = 500_000


def exact_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise=ascii_lower,
    content_hash=F.md5,
    keep: str = "largest",
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are grouped by ``content_hash`` and, inside a hash, by their bytes, so
    two texts that share the hash stay apart.  The group's row with the largest
    (or smallest) id stays.

    Hashes are counted first, and only texts whose hash occurs twice cross the
    network for their bytes to be compared.  The most frequent of those hashes, up to
    :data:`BROADCAST_HASHES`, are broadcast, so their texts stay where they are, and the
    comparing aggregate first combines the copies each task has seen: a text held by a
    third of all rows is one row per task.  Texts of the other hashes, each of fewer rows
    than some power of two, are merged with them by a shuffle.  Ids are joined to their groups without
    the text, so adaptive execution can split a hot group.

    Null texts count as empty and form one group.  Repeated rows are members of
    one group; those with the id that stays are all kept.  A group with only null
    ids has a null ``keep_id`` and is kept.  An empty table gives an empty result;
    other columns are ignored.
    """
    norm: Column = normalise(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("doc_id"), norm.alias("_norm"))
    rows = rows.select("doc_id", "_norm", content_hash("_norm").alias("_hash"))
    slim = cut(rows.select("doc_id", "_hash", F.sha2("_norm", 256).alias("text_sha256")))
    heavy, light = by_heat(cut(slim.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")), "_n", BROADCAST_HASHES)
    pick = F.max if keep == "largest" else F.min

    def compared(some: DataFrame) -> DataFrame:
        return rows.join(some, "_hash").groupBy("_hash", "_norm").agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))

    groups = compared(F.broadcast(heavy.select("_hash")))
    if light is not None:
        groups = groups.unionByName(compared(light.select("_hash").hint("merge")))
    groups = cut(groups.select(F.col("_hash").alias("_h"), F.sha2("_norm", 256).alias("_sha"), "keep_id", "group_size"))
    # Two different texts with both hashes alike would give a row twice; the digest tells apart those with one alike.
    joined = slim.join(groups, (slim["_hash"] == groups["_h"]) & (slim["text_sha256"] == groups["_sha"]), "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )
