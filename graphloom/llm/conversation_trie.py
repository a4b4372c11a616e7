"""Prefix trie of conversations by partition refinement: classes split turn by turn, and their totals fold back."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut, join_by_heat

#: Conversations of a block of ids begin with turns of the block's first one: fewer than ``HEADS`` of them.
BLOCK, HEADS = 20, 4
#: Turns of a class that one task refines to the end; larger classes are split by joins.
TOGETHER = 8192
#: Keys of a hot join that a broadcast may hold.
BROADCAST_KEYS = 200_000
#: Ids in a piece of text that is hashed as a whole.
PIECE = 512

_WORD, _BLANK = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"
_SEGMENT = "conv_id long, top long, bottom long, parent long, n_convs long, w_above long, w_bottom long, end long, n_children long, n_leaves long, saved long"


def _turns(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``conv_id, turn, key, words``: a digest of role and text, and the text's words, instead of the texts."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    key = F.unhex(F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text), 256))
    words = F.length(F.regexp_replace(F.regexp_replace(text, _WORD, "x"), _BLANK, "")).cast("long")
    return conversations.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), key.alias("key"), words.alias("words"))


def _local_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place of each turn, and words up to it, in its conversation within a sorted partition."""
    from pyspark import TaskContext

    part, last, place, sofar = TaskContext.get().partitionId(), None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv, words = (batch.column(i).to_numpy() for i in (0, 2))
        first = np.flatnonzero(np.concatenate([[conv[0] != last], conv[1:] != conv[:-1]]))
        at = np.arange(len(conv))
        total = np.cumsum(words)
        start = np.searchsorted(first, at, side="right") - 1  # -1: the run that the batch before began
        begin = np.where(start < 0, -place, first[start] if len(first) else 0)
        before = np.where(start < 0, -sofar, (total - words)[first[start]] if len(first) else 0)
        places, sums = at - begin + 1, total - before
        last, place, sofar = conv[-1], int(places[-1]), int(sums[-1])
        columns = [*batch.columns, pa.array(places, pa.int64()), pa.array(sums, pa.int64()), pa.array(np.full(len(conv), part), pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, ["conv_id", "key", "words", "p", "w", "part"])


def placed_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, key, words, p, w`` with places from 1 and sums of words.

    Turns are sorted over range partitions, so that a conversation of any length is
    spread over tasks; what it has in earlier partitions (a row for each partition) is added.
    """
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", F.asc_nulls_first("turn"), "key"]
    ranged = turns.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv_id", "key", "words")
    local = cut(ranged.mapInArrow(_local_places, "conv_id long, key binary, words long, p long, w long, part int"))
    sizes = local.groupBy("conv_id", "part").agg(F.max("p").alias("n"), F.max("w").alias("s"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("conv_id", "part", F.sum("n").over(before).alias("n"), F.sum("s").over(before).alias("s")).where("n is not null")
    zero = F.lit(0).cast("long")
    rows = local.join(F.broadcast(offsets), ["conv_id", "part"], "left")
    return rows.select("conv_id", "key", "words", (F.col("p") + F.coalesce("n", zero)).alias("p"), (F.col("w") + F.coalesce("s", zero)).alias("w"))


def rebuilt(turns: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """``conv_id, d, key, words, w`` of every conversation with the head of its block's first one, and ``conv_id, len``."""
    rows = placed_turns(turns)
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(HEADS)).cast("int")
    upto = [F.coalesce(F.max(F.when(F.col("p") == i, F.col("w"))), F.lit(0).cast("long")) for i in range(1, HEADS)]
    convs = cut(rows.groupBy("conv_id").agg(F.max("p").alias("n"), F.array(F.lit(0).cast("long"), *upto).alias("ws")))
    base = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("b_n"), F.col("ws").alias("b_ws"))
    both = convs.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % BLOCK).join(base, "base", "left")
    both = both.withColumn("m", F.least(F.col("h"), F.coalesce("b_n", F.lit(0))).cast("int"))
    b_w = F.when(F.col("m") > 0, F.get("b_ws", F.col("m"))).otherwise(0)
    info = both.select("conv_id", "n", "base", "h", "m", (b_w - F.get("ws", F.col("h"))).alias("dw"), (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("len"))
    info = cut(info)
    own = join_by_heat(rows.where(F.col("p") > h), info.select("conv_id", "n", F.col("m") - F.col("h"), "dw").toDF("conv_id", "n", "dd", "dw"), ["conv_id"], "n", most)
    own = own.select("conv_id", (F.col("p") + F.col("dd")).cast("long").alias("d"), "key", "words", (F.col("w") + F.col("dw")).cast("long").alias("w"))
    heads = rows.where(F.col("p") < HEADS).withColumnRenamed("conv_id", "base").join(info.select("conv_id", "base", "m"), "base").where("p <= m")
    heads = heads.select("conv_id", F.col("p").cast("long").alias("d"), "key", "words", "w")
    return cut(own.unionByName(heads)), info.select("conv_id", "len")


def _bundles(rows: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations of the same turns are one: ``len, x1, x2, conv_id`` of each, and ``len, x1, x2, bundle, m, wt`` of each sequence."""
    x = [F.bit_xor(F.xxhash64(F.lit(s), "d", "key")).alias(f"x{s}") for s in (1, 2)]
    found = lengths.join(rows.groupBy("conv_id").agg(F.max("w").alias("wt"), *x), "conv_id", "left")
    zero = F.lit(0).cast("long")
    members = cut(found.select("conv_id", "len", *[F.coalesce(c, zero).alias(c) for c in ("wt", "x1", "x2")]))
    bundles = members.groupBy("len", "x1", "x2").agg(F.min("conv_id").alias("bundle"), F.count(F.lit(1)).alias("m"), F.max("wt").alias("wt"))
    return members, cut(bundles)


def _ends(ids: DataFrame) -> DataFrame:
    """``end, sha``: SHA-256 of each bundle's ids in order.

    Ids are sorted over range partitions and joined into short texts there; these,
    in order, stream through the hash, so no bundle is ever held as a whole.
    """
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bundle, conv = (batch.column(i).to_numpy() for i in (0, 1))
            cuts = np.flatnonzero(np.concatenate([[True], bundle[1:] != bundle[:-1], [True]]))
            spans = [(a, min(a + PIECE, hi)) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True) for a in range(lo, hi, PIECE)]
            text = [",".join(map(str, conv[a:b].tolist())) for a, b in spans]
            at = [a for a, _ in spans]
            yield pa.RecordBatch.from_arrays([pa.array(bundle[at], pa.int64()), pa.array(conv[at], pa.int64()), pa.array(text, pa.string())], ["bundle", "first", "text"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            found = []
            for bundle, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if bundle == now:
                    digest.update(b"," + text.encode())
                else:
                    found += [(now, digest.hexdigest())] if digest else []
                    now, digest = bundle, hashlib.sha256(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in ((0, pa.int64()), (1, pa.string()))], ["end", "sha"])
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([digest.hexdigest()])], ["end", "sha"])

    ranged = ids.repartitionByRange(parts, "bundle", "conv_id").sortWithinPartitions("bundle", "conv_id")
    some = ranged.mapInArrow(pieces, "bundle long, first long, text string")
    return some.repartition(parts, "bundle").sortWithinPartitions("bundle", "first").mapInArrow(hashed, "end long, sha string")


def refine(bundles: list[tuple[int, int, list, list, list]], top: int, parent: int | None) -> list[tuple]:
    """Segments of a class whose ``(bundle, copies, keys, words, sums of words)`` share the turn ``top`` and begin with it.

    Classes wait on a stack.  One with a single bundle is retired with its tail as a
    segment; another follows its members to the first turn that isn't the same in all,
    and is split there.  Totals fold back from the last segment to the first.
    """
    made: list[list] = []  # conv, top, bottom, parent, convs, above, at bottom, end, children, leaves, saved; last: place of the parent
    stack = [(bundles, top, parent, -1)]
    while stack:
        group, top, parent, up = stack.pop()
        group.sort(key=lambda b: b[0])
        conv, _, keys, words, sums = group[0]
        i = depth = top - made[0][1] if made else 0  # place in the lists
        shortest = min(len(b[2]) for b in group)
        if len(group) == 1:
            i = shortest - 1
        else:
            while i + 1 < shortest and all(b[2][i + 1] == keys[i + 1] for b in group):
                i += 1
        end = next((b[0] for b in group if len(b[2]) == i + 1), None)
        bottom = top + i - depth
        made.append([conv, top, bottom, parent, sum(b[1] for b in group), sums[depth] - words[depth], sums[i], end, 0, 0, 0, up])
        parts: dict = {}
        for b in group:
            if len(b[2]) > i + 1:
                parts.setdefault(b[2][i + 1], []).append(b)
        stack += [(g, bottom + 1, conv, len(made) - 1) for g in parts.values()]
    for seg in reversed(made):
        seg[9] = seg[9] or 1
        if seg[11] >= 0:
            above = made[seg[11]]
            above[8] += 1
            above[9] += seg[9]
            above[10] += seg[10] + (seg[4] - 1) * (seg[6] - seg[5])
    return [tuple(seg[:11]) for seg in made]


def _refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of the classes of a partition sorted by class, bundle and depth."""
    fields = [(c.split()[0], pa.int64()) for c in _SEGMENT.split(", ")]

    def out(segments: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([s[i] for s in segments], t) for i, (_, t) in enumerate(fields)], [n for n, _ in fields])

    now, group = None, []
    for batch in batches:
        segments = []
        for cls, top, parent, bundle, m, key, words, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or cls != now[0]:
                segments += refine(group, now[1], now[2]) if group else []
                now, group = (cls, top, parent), []
            if not group or group[-1][0] != bundle:
                group.append((bundle, m, [], [], []))
            for values, value in zip(group[-1][2:], (key, words, w), strict=True):
                values.append(value)
        yield out(segments)
    if group:
        yield out(refine(group, now[1], now[2]))


def conversation_trie(
    conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", together: int | None = None, most: int | None = None
) -> DataFrame:
    """One row per trie node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    Conversations of equal turns are one bundle with a weight.  All bundles start in
    one class.  In a round every class runs on to the first turn that isn't the same
    in all its members (turns at which nothing splits cost no round), and is split
    there; classes of one bundle retire with their tail as a unary chain, classes of
    at most ``together`` turns are refined to the end in a task, and the others go
    into the next round.  Totals fold back from the last round to the first.  A class
    is a segment of nodes on the path of its smallest conversation, whose turns give
    the rows.

    Turns are compared by SHA-256 of role and text, bundles by 128 hash bits over all
    turns.  Turns go by ``turn``, null first, ties by their digest.  Null roles and
    texts are empty.  Ids are integers; rows without one belong to no conversation.
    No conversations give no rows, not even a root.  Other columns are ignored.
    """
    together = TOGETHER if together is None else together
    most = BROADCAST_KEYS if most is None else most
    spark = conversations.sparkSession
    turns = cut(_turns(conversations, id_col, turn_col, role_col, text_col))
    rows, lengths = rebuilt(turns, most)
    members, bundles = _bundles(rows, lengths)
    root = bundles.agg(F.min("bundle").alias("cls"), F.count(F.lit(1)).alias("k"), F.sum("m").alias("n"), F.max(F.when(F.col("len") == 0, F.col("bundle"))).alias("empty")).first()
    if root.cls is None:
        names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
        return spark.createDataFrame([], ", ".join(f"{c} long" for c in names) + ", ends_sha256 string")
    own = bundles.select(F.col("bundle").alias("conv_id"), "m", "len", "wt")
    reps = cut(rows.join(own.hint("merge"), "conv_id"))  # of each bundle's smallest conversation only

    long = lambda x: F.lit(x).cast("long")
    active = reps.select(long(root.cls).alias("cls"), F.col("conv_id").alias("bundle"), "m", "len", "wt", "d", "key", "words", "w")
    classes = spark.createDataFrame([(root.cls, 0, None, root.k, root.n, 0)], "cls long, top long, parent long, k long, n_convs long, w_above long")
    big, done, before = [], [], None
    while not classes.isEmpty():
        depths = active.groupBy("cls", "d").agg(F.count(F.lit(1)).alias("c"), F.min("key").alias("lo"), F.max("key").alias("hi"), F.max("w").alias("w"))
        depths = cut(depths.join(classes.select("cls", "k"), "cls").select("cls", "d", "w", ((F.col("c") == F.col("k")) & (F.col("lo") == F.col("hi"))).alias("same")))
        # a class of one bundle, which only the root can be here, has no turn at which it splits
        bottoms = classes.join(depths.groupBy("cls").agg(F.min(F.when(~F.col("same"), F.col("d"))).alias("differ"), F.max("d").alias("last")), "cls", "left")
        bottoms = bottoms.withColumn("bottom", F.coalesce(F.col("differ") - 1, "last", long(0)))
        at = depths.select("cls", F.col("d").alias("bottom"), F.col("w").alias("w_bottom"))
        segments = cut(bottoms.join(at, ["cls", "bottom"], "left").select("cls", "top", "bottom", "parent", "n_convs", "w_above", F.coalesce("w_bottom", long(0)).alias("w_bottom")))
        drop_cut(depths)
        last = segments.select("cls", "bottom")
        ends = active.join(last, "cls").where("d = bottom and len = bottom").select("cls", F.col("bundle").alias("end"))
        if not big and root.empty is not None:  # a conversation without turns has no row
            ends = spark.createDataFrame([(root.cls, root.empty)], "cls long, end long")
        big.append(segments.join(ends, "cls", "left"))

        split = active.join(last.withColumnRenamed("cls", "up"), F.col("cls") == F.col("up")).where("d = bottom + 1")
        split = split.select("up", "key", "bundle", "m", "len", "wt", "d", (F.col("w") - F.col("words")).alias("w_above"))
        parts = cut(split.groupBy("up", "key").agg(
            F.min("bundle").alias("cls"), F.first("d").alias("top"), F.count(F.lit(1)).alias("k"), F.sum("m").alias("n_convs"), F.max("w_above").alias("w_above"),
            F.sum(F.col("len") - F.col("d") + 1).alias("turns"), F.max("len").alias("len"), F.max("wt").alias("wt")))
        single = parts.where("k = 1").select(
            F.col("cls").alias("conv_id"), "top", F.col("len").alias("bottom"), F.col("up").alias("parent"), "n_convs", "w_above", F.col("wt").alias("w_bottom"),
            F.col("cls").alias("end"), long(0).alias("n_children"), long(1).alias("n_leaves"), long(0).alias("saved"))
        several = parts.where("k > 1").select("up", "key", "cls", "k", "turns")
        moved = cut(join_by_heat(split.select("up", "key", "bundle", "d"), several, ["up", "key"], "k", most).select("bundle", "up", "cls", F.col("d").alias("top"), "turns"))
        left = cut(active.drop("cls").join(moved.hint("merge"), "bundle").where("d >= top"))
        small = left.where(F.col("turns") <= together).select("cls", "top", F.col("up").alias("parent"), "bundle", "m", "key", "words", "w", "d")
        small = small.repartition("cls").sortWithinPartitions("cls", "bundle", "d").drop("d")
        done.append(cut(single.unionByName(small.mapInArrow(_refined, _SEGMENT))))
        classes = cut(parts.where((F.col("k") > 1) & (F.col("turns") > together)).select("cls", "top", F.col("up").alias("parent"), "k", "n_convs", "w_above"))
        active, gone = left.where(F.col("turns") > together).select("cls", "bundle", "m", "len", "wt", "d", "key", "words", "w"), before
        before = left
        big[-1] = cut(big[-1])
        drop_cut(parts, moved, *([gone] if gone is not None else []))

    found, tops = list(done), None
    for segments, kids in zip(reversed(big), reversed(done), strict=True):
        gain = (F.col("saved") + (F.col("n_convs") - 1) * (F.col("w_bottom") - F.col("w_above"))).alias("gain")
        some = kids.select("parent", "top", "n_leaves", gain)
        # a conversation may be the smallest of several nested classes: the turn tells whose child a segment is
        heads = segments.select(F.col("cls").alias("parent"), (F.col("bottom") + 1).alias("top"))
        below = (some if tops is None else some.unionByName(tops)).join(heads, ["parent", "top"], "left_semi")
        total = below.groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("gain").alias("saved"))
        whole = segments.withColumnRenamed("cls", "conv_id").join(total.withColumnRenamed("parent", "conv_id"), "conv_id", "left")
        whole = whole.withColumns({"n_children": F.coalesce("n_children", long(0)), "n_leaves": F.coalesce("n_leaves", long(1)), "saved": F.coalesce("saved", long(0))})
        whole = cut(whole.select(*[c.split()[0] for c in _SEGMENT.split(", ")]))
        tops = whole.select("parent", "top", "n_leaves", gain)
        found.append(whole)

    copies = bundles.where("m > 1").select("len", "x1", "x2", "bundle", "m")
    many = _ends(join_by_heat(members.select("len", "x1", "x2", "conv_id"), copies, ["len", "x1", "x2"], "m", most).select("bundle", "conv_id"))
    segments = reduce(DataFrame.unionByName, found).withColumnRenamed("conv_id", "conv").join(many, "end", "left")
    ended = F.coalesce("sha", F.sha2(F.col("end").cast("string"), 256), F.sha2(F.lit(""), 256))
    path = reps.select("conv_id", "d", "words", "w").unionByName(spark.createDataFrame([(root.cls, 0, 0, 0)], "conv_id long, d long, words long, w long"))
    nodes = path.join(segments.hint("merge"), (F.col("conv_id") == F.col("conv")) & F.col("d").between(F.col("top"), F.col("bottom")))
    final = F.col("d") == F.col("bottom")
    return nodes.select(
        "conv_id",
        F.col("d").alias("depth"),
        F.when(F.col("d") == F.col("top"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.when(final, F.col("n_children")).otherwise(long(1)).alias("n_children"),
        "n_leaves",
        (F.col("saved") + (F.col("n_convs") - 1) * (F.col("w_bottom") - F.col("w") + F.col("words"))).alias("saved_tokens"),
        F.when(final, ended).otherwise(F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
