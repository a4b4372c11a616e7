"""Line deduplication over the whole corpus, giving compressed keep bitmaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut, join_by_heat, packed

#: What is stripped from both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
#: Salts for the first, combining aggregate.
SALTS = 32
#: Keys that a broadcast may hold; beyond it the join shuffles.
BROADCAST_KEYS = 500_000


def _keyed(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """``doc_id, h1, h2, keys``: a row and its text's hash, and per line the key's 128-bit hash, or null for short keys."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def key(line: Column) -> Column:
        bare = F.btrim(line, F.lit(BLANKS))
        return F.when(
            F.length(bare) >= min_chars,
            F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit(7), bare).alias("b")),
        )

    return docs.select(
        F.col(id_col).alias("doc_id"),
        *_text_hash(text),
        F.transform(F.split(ascii_lower(text), "\n", -1), key).alias("keys"),
    )


def _text_hash(text: Column) -> tuple[Column, Column]:
    """Rows are told apart by id and these: equal ids, or null ones, are no reason to share another text's lines."""
    return F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2")


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` refers to it."""
    return F.transform(F.array(value), body)[0]


def frequent_lines(docs: DataFrame, *, id_col="doc_id", text_col="text", min_chars=40, min_docs=5) -> DataFrame:
    """``a, b, last, docs``: hash of each key in ``min_docs`` documents or more, the largest id that has it, and their number.

    Every document offers each of its keys once.  A salted aggregate combines what
    a task has seen, so a line of a third of all documents becomes a few rows;
    those are range-partitioned by hash, sorted by document inside a hash, and the
    first occurrence (in falling id order, as the last one stays) is streamed out.
    Lines of one document stay or go together, so their position is no sort key.

    Null ids sort below all others.  Repeated rows count again; null and empty texts
    have no key; an empty table has no rows; other columns are ignored.
    """
    fresh = lambda s: F.filter(s, lambda k, i: F.coalesce(F.get(s, i - 1) != k, F.lit(True)))
    keys = F.sort_array(F.filter("keys", lambda k: k.isNotNull()))
    rows = _keyed(docs, id_col, text_col, min_chars).select("doc_id", F.explode(_let(keys, fresh)).alias("k"))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    part = rows.groupBy(F.col("k.a").alias("a"), F.col("k.b").alias("b"), salt.alias("s"))
    part = part.agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
    ranged = part.repartitionByRange("a", "b").sortWithinPartitions("a", "b", F.desc("last"))
    run = Window.partitionBy("a", "b")
    first = F.row_number().over(run.orderBy(F.desc_nulls_last("last")))
    return (
        ranged.withColumn("_first", first)
        .withColumn("docs", F.sum("n").over(run))
        .where((F.col("_first") == 1) & (F.col("docs") >= min_docs))
        .select("a", "b", "last", "docs")
    )


def line_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5
) -> DataFrame:
    """``doc_id, h1, h2, dropped``: runs ``(s, e)`` of line numbers to drop, of each row that has some.

    A line's key is the line stripped of blanks and with A-Z lower-cased; keys
    are compared by 128 hash bits.  A key of ``min_chars`` code points or more in
    ``min_docs`` documents or more loses all its lines but those of the largest id
    that has it.  ``h1, h2`` are a hash of the whole text, so rows that share an id
    have their own runs.

    Null and empty texts have one empty line, which never goes.  Each row counts
    as a document: repeated rows count again, and rows that share the largest id
    all keep their lines.  A null id counts as a document smaller than all others.
    Empty table: empty result; other columns are ignored.
    """
    frequent = cut(frequent_lines(docs, id_col=id_col, text_col=text_col, min_chars=min_chars, min_docs=min_docs))
    lines = _keyed(docs, id_col, text_col, min_chars).select("doc_id", "h1", "h2", F.posexplode("keys").alias("p", "k"))
    lines = lines.where(F.col("k").isNotNull()).select("doc_id", "h1", "h2", "p", "k.a", "k.b")
    hit = join_by_heat(lines, frequent, ["a", "b"], "docs", BROADCAST_KEYS)
    gone = hit.where(~F.col("doc_id").eqNullSafe(F.col("last"))).groupBy("doc_id", "h1", "h2").agg(F.array_sort(F.collect_set("p")).alias("d"))
    starts = F.filter("d", lambda p, i: F.coalesce(F.get("d", i - 1) != p - 1, F.lit(True)))
    ends = F.filter("d", lambda p, i: F.coalesce(F.get("d", i + 1) != p + 1, F.lit(True)))
    return gone.select("doc_id", "h1", "h2", F.arrays_zip(starts.alias("s"), ends.alias("e")).alias("dropped"))


def _before(i: Column) -> Column:
    """The last dropped line before run ``i``, -1 for none."""
    return F.coalesce(F.get("_dropped", i - 1)["e"], F.lit(-1))


def _kept(lines: Column) -> Column:
    """The lines between the runs of ``_dropped``, joined; each line is copied once."""
    pieces = F.transform("_dropped", lambda r, i: F.slice(lines, _before(i) + 2, r["s"] - _before(i) - 1))
    end = F.element_at("_dropped", -1)["e"]
    tail = F.slice(lines, end + 2, F.greatest(F.size(lines) - end - 1, F.lit(0)))
    return F.array_join(F.concat(F.flatten(pieces), tail), "\n")


def apply_line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", report: bool = True, **rule) -> DataFrame:
    """``docs`` with ``text_col`` reduced to the lines that stay.

    With ``report``, also ``n_lines, n_dropped`` and ``keep_runs``, the compressed
    keep bitmap: the lengths of its runs, a kept run (of length 0 or more) and a
    dropped one in turn, without the kept run at the end.  These replace columns of
    the same names; all other columns of ``docs`` stay under their own names.  Null
    texts become empty ones; for ids and repeated rows see :func:`line_duplicates`.
    """
    gone = line_duplicates(docs, id_col=id_col, text_col=text_col, **rule)
    gone = gone.select(F.col("doc_id").alias("_g"), F.col("h1").alias("_g1"), F.col("h2").alias("_g2"), F.col("dropped").alias("_dropped"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(packed(docs).alias("_row"), F.col(id_col).alias("_id"), text.alias("_text"), *_text_hash(text))
    same = F.col("_id").eqNullSafe(F.col("_g")) & (F.col("h1") == F.col("_g1")) & (F.col("h2") == F.col("_g2"))
    stay = F.when(F.col("_dropped").isNull(), F.col("_text")).otherwise(_let(F.split("_text", "\n", -1), _kept))
    runs = F.transform("_dropped", lambda r, i: F.concat_ws(",", r["s"] - _before(i) - 1, r["e"] - r["s"] + 1))
    extra = {
        "n_lines": (F.length("_text") - F.length(F.replace("_text", F.lit("\n"))) + 1).cast("long"),
        "n_dropped": F.coalesce(F.aggregate("_dropped", F.lit(0), lambda n, r: n + (r["e"] - r["s"] + 1)), F.lit(0)).cast("long"),
        "keep_runs": F.coalesce(F.array_join(runs, ","), F.lit("")),
    } if report else {}
    return rows.join(gone, same, "left").select(
        *[stay.alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns if c not in extra],
        *[column.alias(name) for name, column in extra.items()],
    )
