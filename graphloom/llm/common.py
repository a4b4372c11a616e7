"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER_AZ = UPPER_AZ.lower()

#: Letters outside ASCII that ``lower`` would change as well.
_OTHER_CASED = r"[\x{80}-\x{10FFFF}&&[\p{Lu}\p{Lt}\p{Nl}\p{So}]]"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else.

    ``lower`` is a byte loop for such texts; only a text with cased letters
    outside ASCII needs the slower character map.
    """
    return F.when(text.rlike(_OTHER_CASED), F.translate(text, UPPER_AZ, LOWER_AZ)).otherwise(F.lower(text))


def packed(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one struct, so that none can clash with an operator's own names."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns])


def identity(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A row's id, null ids last, and 128 hash bits of its text: rows that share or lack an id are told apart by it."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.struct(
        F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2")
    )


def rows_of(docs: DataFrame, keys: DataFrame, how: str, *, once: bool = False) -> DataFrame:
    """The rows of ``docs`` whose :func:`identity` is (``left_semi``) or isn't (``left_anti``) in column ``key`` of ``keys``.

    With ``once``, of rows with the same identity one stays.
    """
    parts = ["n", "i", "h1", "h2"]
    keys = keys.select("key.*").distinct().select(*[F.col(c).alias(f"k_{c}") for c in parts])
    rows = docs.select(packed(docs).alias("row"), identity().alias("key")).select("row", "key.*")
    same = [F.col(c).eqNullSafe(F.col(f"k_{c}")) if c == "i" else F.col(c) == F.col(f"k_{c}") for c in parts]
    rows = rows.join(keys, same, how)
    return (rows.dropDuplicates(parts) if once else rows).select("row.*")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one where none is configured, in local mode only."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        place = tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/graphloom/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(*frames: DataFrame) -> None:
    """Delete tables made by :func:`cut` that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        for name in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def input_bytes(df: DataFrame) -> int:
    """Size of the files behind ``df`` as the optimizer knows it (no job is run)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parts_for(df: DataFrame, per_part: int = 8 << 20, least: int = 16) -> int:
    """How many parts to deal ``df`` into so that a part has about ``per_part`` bytes of file."""
    size = input_bytes(df)
    if size > 1 << 55:  # unknown to the optimizer
        return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(least, -(-size // per_part))


def by_heat(table: DataFrame, weight: str, most: int) -> tuple[DataFrame, DataFrame | None]:
    """``table`` cut at a power of two of ``weight``: the heaviest keys, at most ``most``, and the lighter ones (none: null)."""
    level = F.floor(F.log2(weight)).cast("int")
    least, taken, left = 64, 0, 0
    for r in sorted(table.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r.level):
        if left or taken + r.n > most:
            left += r.n
        else:
            least, taken = r.level, taken + r.n
    return (table.where(level >= least), table.where(level < least)) if left else (table, None)


def join_by_heat(rows: DataFrame, table: DataFrame, on: list[str], weight: str, most: int) -> DataFrame:
    """``rows`` joined with ``table``, which has each key once and how often ``rows`` may hold it as ``weight``.

    The heaviest keys, at most ``most`` of them and all over some power of two, are
    broadcast, so a key of any number of rows stays where its rows are; the others,
    each lighter than that power, are merged by shuffles.
    """
    heavy, light = by_heat(table, weight, most)
    if light is None:
        return rows.join(F.broadcast(heavy), on)
    rows = cut(rows)
    return rows.join(F.broadcast(heavy), on).unionByName(rows.join(light.hint("merge"), on))


def packed_by(key: Column, docs: DataFrame, level: int = 6) -> DataFrame:
    """``key, blob``: the rows of each batch by key, compressed, so that a shuffle of texts moves about half their bytes."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", level))
        for batch in batches:
            key = batch.column(0).to_numpy()
            order = np.argsort(key, kind="stable")
            edges = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0, [True]])) if len(order) else [0]
            rest = pa.RecordBatch.from_arrays(batch.columns[1:], names)
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rest.schema, options=options) as writer:
                    writer.write_batch(rest.take(pa.array(order[lo:hi])))
                blob = pa.array([sink.getvalue().to_pybytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([key[order[lo]]]), blob], ["key", "blob"])

    return docs.select(key.cast("long").alias("key"), "*").mapInArrow(run, "key long, blob binary")


def unpacked(blobs: Iterable[bytes]) -> Iterator[pa.Table]:
    """The rows that :func:`packed_by` has compressed."""
    for blob in blobs:
        yield pa.ipc.open_stream(blob).read_all()
