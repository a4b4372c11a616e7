"""SimHash near-duplicates through a byte-position inverted index with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .components import star_components

#: Fingerprints of a posting that are paired with each other; larger postings link through midpoints.
POSTING = 32
#: Shingles hashed at once.
BLOCK = 100_000


def shingle_hashes(text: str, shingle: int = 3) -> np.ndarray:
    """XXH64 (seed 42) hashes of a text's word shingles, repeats included; none of a blank text."""
    import xxhash

    words = text.encode().lower().split()  # of bytes: A-Z, and blanks 09-0D and 20, only
    if not words:
        return np.empty(0, np.uint64)
    grams = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(g, 42) for g in grams), np.uint64, max(1, len(words) - shingle + 1))


def fingerprint(text: str, shingle: int = 3) -> int:
    """64-bit majority of the hashes of a text's word shingles."""
    hashes = shingle_hashes(text, shingle)
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, BLOCK):
        rows = hashes[lo : lo + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id, fp``: a signed 64-bit fingerprint of every row; null and blank texts have zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py() or "", shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def shared_bytes(x: Column, y: Column) -> Column:
    """Number of positions at which two fingerprints have the same byte."""
    diff = x.bitwiseXOR(y)
    same = [(F.shiftrightunsigned(diff, 8 * p).bitwiseAND(F.lit(255)) == 0).cast("int") for p in range(8)]
    return reduce(lambda a, b: a + b, same)


def near_links(fps: DataFrame, distance: int = 2, posting: int = POSTING) -> DataFrame:
    """``a, b``: links among distinct fingerprints ``fp`` that give the components of all pairs within 2 bits.

    Two fingerprints within 2 bits differ in at most two bytes, so at least six of
    eight positional bytes match and, of the four byte pairs, at least two match
    whole.  The index posts every fingerprint under each two of its byte pairs.  In
    a posting of up to ``posting`` members, the shared positional bytes of each pair
    are tallied, pairs with fewer than six go, and the rest are verified.

    Members of larger postings aren't paired.  Two fingerprints are within 2 bits
    exactly if some value is within 1 bit of both, so each such member is dealt to
    the 65 values within 1 bit of it, and the at most 65 members of a value link to
    the least of them: the same components from a number of rows in proportion.
    """
    if distance != 2:
        raise ValueError("the index is laid out for a distance of 2 bits")
    pair = lambda i: F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))
    keys = [
        F.struct(F.lit(k).alias("k"), F.shiftleft(pair(i), 16).bitwiseOR(pair(j)).alias("bytes"))
        for k, (i, j) in enumerate(combinations(range(4), 2))
    ]
    posts = fps.select("fp", F.explode(F.array(*keys)).alias("key")).select("fp", "key.k", "key.bytes")
    sizes = cut(posts.groupBy("k", "bytes").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    posted = posts.join(sizes, ["k", "bytes"])

    small = posted.where(F.col("n") <= posting).groupBy("k", "bytes").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    tail = lambda i: F.slice("fps", i + F.lit(2), F.size("fps"))
    close = lambda x, y: (shared_bytes(x, y) >= 8 - distance) & (F.bit_count(x.bitwiseXOR(y)) <= distance)
    pairs = F.flatten(
        F.transform(
            "fps",
            lambda x, i: F.transform(F.filter(tail(i), lambda y: close(x, y)), lambda y: F.struct(x.alias("a"), y.alias("b"))),
        )
    )
    paired = small.select(F.explode(pairs).alias("p")).select("p.a", "p.b")

    dense = posted.where(F.col("n") > posting).select("fp").distinct()
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i))
    near = F.concat(F.array(F.lit(0).cast("long")), flips)
    mids = dense.select("fp", F.explode(near).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
    hubbed = mids.withColumn("hub", F.min("fp").over(Window.partitionBy("mid"))).where("hub != fp")
    return paired.unionByName(hubbed.select(F.col("fp").alias("a"), F.col("hub").alias("b"))).distinct()


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, posting: int = POSTING
) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint`` (hex), ``component_id``.

    The component of a row has all rows reachable over fingerprints that differ in
    2 bits or fewer; its id is the smallest id in it.  Equal fingerprints are one
    node, so exact copies cost one row each and no links.

    Null and blank texts have fingerprint zero and link like any other.  Texts of
    fewer words than a shingle are one shingle.  Repeated rows are in one component.
    Null ids are never a component's smallest id unless it has no others.  An empty
    table gives an empty result; other columns are ignored.
    """
    fps = cut(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    stars = star_components(near_links(nodes.select("fp"), posting=posting), "a", "b")
    rooted = nodes.join(stars.withColumnRenamed("u", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("v", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = cut(rooted.join(named, "root").select(F.col("fp").alias("node"), "component_id"))
    return fps.join(known, F.col("fp") == F.col("node")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
