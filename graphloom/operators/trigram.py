"""Substring search over a posting table of trigrams: the rarest meet, and what is left is verified."""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.runtime import settled

from .views import keyword_search

#: Trigrams of a needle whose postings are intersected, the rarest ones.
RAREST = 4


def trigrams(text: Column) -> Column:
    """Distinct trigrams of a text in upper case; a shorter text is its only one, the empty text has none.

    By characters, so that the work is linear in the text.
    """
    chars = F.filter(F.split(F.upper(text), ""), lambda c: c != "")
    after = lambda n: F.slice(chars, F.lit(n + 1), F.size(chars))
    joined = lambda a, b: F.zip_with(a, b, lambda x, y: F.concat(x, y))  # noqa: E731  null past the end of the shorter one
    long = F.array_distinct(F.filter(joined(joined(chars, after(1)), after(2)), lambda g: g.isNotNull()))
    return F.when(F.size(chars) >= 3, long).when(F.size(chars) > 0, F.array(F.array_join(chars, ""))).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class TrigramIndex:
    """``postings(gram, key, field, part)``, ``grams(gram, n, part)`` and ``texts(key, field, text, part)`` of a folder."""

    spark: SparkSession
    path: str
    parts: int
    kind: str

    def table(self, name: str) -> DataFrame:
        """With a schema of its own, as a folder of no rows has none."""
        columns = {"postings": f"gram string, key {self.kind}, field int", "grams": "gram string, n bigint", "texts": f"key {self.kind}, field int, text string"}
        return self.spark.read.schema(f"{columns[name]}, part int").parquet(f"{self.path}/{name}")

    def of(self, name: str, grams: list[str]) -> DataFrame:
        """Rows of ``grams``, from their partitions only."""
        parts = sorted({zlib.crc32(g.encode()) % self.parts for g in grams})
        return self.table(name).where(F.col("part").isin(parts) & F.col("gram").isin(grams))


def build_trigrams(rows: DataFrame, path: str, key: str, columns: list[str], parts: int = 64) -> TrigramIndex:
    """An index of ``columns`` of ``rows`` under ``path``, by ``key`` (rows that share one are found together).

    Postings are partitioned by trigram and sorted by it; a partition with a very
    common trigram is written by several tasks.  Texts are partitioned by key.  Null
    texts aren't in it; a null key is an error of the caller, as no row could be named by it.
    """
    spark = rows.sparkSession
    fields = [F.struct(F.lit(i).alias("field"), F.col(c).cast("string").alias("text")) for i, c in enumerate(columns)]
    texts = rows.select(F.col(key).alias("key"), F.explode(F.array(*fields)).alias("f")).select("key", "f.field", "f.text").where("text is not null")
    texts.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")).hint("rebalance", "part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/texts")
    index = TrigramIndex(spark, path, parts, rows.schema[key].dataType.simpleString())
    texts = index.table("texts")
    postings = texts.select(F.explode(trigrams(F.col("text"))).alias("gram"), "key", "field").withColumn("part", F.pmod(F.crc32(F.col("gram").cast("binary")), F.lit(parts)).cast("int"))
    postings.hint("rebalance", "part").sortWithinPartitions("part", "gram").write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings")
    counts = index.table("postings").groupBy("part", "gram").agg(F.count(F.lit(1)).alias("n"))
    counts.repartition("part").sortWithinPartitions("part", "gram").write.mode("overwrite").partitionBy("part").parquet(f"{path}/grams")
    return index


def candidates(index: TrigramIndex, needle: str) -> tuple[DataFrame, bool]:
    """``key, field`` of texts that may contain ``needle`` (not empty), and whether they surely do.

    A needle of one or two characters is in a text if it is in one of its trigrams, so
    the list of trigrams is searched for it; one of three is a trigram.  Of a longer one,
    the rarest trigrams' postings are intersected, and a trigram that no text has ends it.
    """
    u = needle.upper()
    if len(u) < 3:
        has = index.table("grams").where(F.contains("gram", F.lit(u))).select("part", "gram")
        return index.table("postings").join(has, ["part", "gram"], "left_semi").select("key", "field").distinct(), True
    grams = sorted({u[i : i + 3] for i in range(len(u) - 2)})
    counts = index.of("grams", grams).orderBy("n", "gram").collect()  # as many as the needle has
    if len(counts) < len(grams):
        return index.table("postings").where(F.lit(False)).select("key", "field"), True
    rare = [r.gram for r in counts[:RAREST]]
    found = index.of("postings", rare[:1]).select("key", "field")
    for gram in rare[1:]:
        found = found.join(index.of("postings", [gram]).select("key", "field"), ["key", "field"], "left_semi")
    return found, len(u) == 3


def containing(index: TrigramIndex, needle: str) -> DataFrame:
    """``key`` of rows one of whose texts contains ``needle``, in any case; every row with a text contains the empty one.

    Candidates' texts are read from the partitions and the range of keys that they are in, and verified.
    """
    if not needle:
        return index.table("texts").select("key").distinct()
    found, sure = candidates(index, needle)
    if not sure:
        found = settled(found.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(index.parts)).cast("int")))
        within = found.agg(F.collect_set("part").alias("parts"), F.min("key").alias("least"), F.max("key").alias("most")).first()  # as many parts as the index has
        texts = index.table("texts").where(F.col("part").isin(within.parts) & F.col("key").between(within.least, within.most))
        texts = texts.join(found, ["part", "key", "field"], "left_semi")
        found = texts.where(F.contains(F.upper("text"), F.lit(needle.upper())))
    return found.select("key").distinct()


def search_indexed(nodes: DataFrame, index: TrigramIndex, text: str, limit: int = 30, key: str = "seq") -> DataFrame:
    """The first ``limit`` nodes with ``text`` in an indexed column, by ``seq``, and how many there are (``hits``)."""
    found = nodes.join(containing(index, text).withColumnRenamed("key", key), key, "left_semi") if text else nodes
    total = found.agg(F.count(F.lit(1)).alias("hits"))
    return found.orderBy("seq").limit(limit).crossJoin(F.broadcast(total))  # one row


def keyword_search_indexed(types: DataFrame, members: DataFrame, type_index: TrigramIndex, member_index: TrigramIndex, text: str, limit: int = 5, member_type: str = "all", fallback=None) -> DataFrame:
    """:func:`keyword_search` over the rows that the indexes name: of types by ``seq``, of members by ``member_key``.

    Types of members that are found come along, as members of compiler-made types are left out.
    """
    if not text:
        return keyword_search(types, members, text, limit, member_type, fallback)
    some = members.join(containing(member_index, text).withColumnRenamed("key", "member_key"), "member_key", "left_semi")
    wanted = containing(type_index, text).select(F.col("key").alias("seq")).unionByName(some.select(F.col("type_seq").alias("seq"))).distinct()
    return keyword_search(types.join(wanted, "seq", "left_semi"), some, text, limit, member_type, fallback)


def containing_any(index: TrigramIndex, needles: list[str]) -> DataFrame:
    """``needle, key`` for several needles."""
    return reduce(DataFrame.unionByName, [containing(index, n).select(F.lit(n).alias("needle"), "key") for n in needles])
