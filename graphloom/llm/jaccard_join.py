"""Exact Jaccard self-join of word n-gram sets: families of sets that may link, each joined over a prefix tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_by_heat
from .components import star_components
from .simhash import shingle_hashes

SHINGLE, PERCENT = 4, 85
#: Sets and n-grams of a tree; larger families are dealt to several, each of which meets each.
TREE_SETS, TREE_GRAMS = 1024, 1 << 18
#: Trees of a family beyond which its sets meet by the n-grams of their prefixes instead.
FAMILY_TREES = 16
#: Rows that a broadcast may hold (of 40 bytes).
BROADCAST_ROWS = 200_000


def least_shared(n: int, percent: int = PERCENT) -> int:
    """N-grams that a set of ``n`` has in common with any set that it links to, at least."""
    return -(-percent * n // 100)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """Of two sets that link, these many first n-grams in one order have one in common."""
    return n - least_shared(n, percent) + 1


def _extra(n: int, percent: int) -> int:
    """N-grams in common that a prefix longer by as many, less one, guarantees."""
    return (prefix_length(n, percent) + 1) // 2


def gram_set(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams; none of a blank text."""
    return np.unique(shingle_hashes(text, shingle))


def _name(grams: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(grams.tobytes())


def _sets(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``doc_id, n, node, part`` of every row: its set's size and 128-bit name, and a prefix in the order of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [gram_set(t.as_py() or "", shingle) for t in batch.column(1)]
            size = [len(g) for g in found]
            part = [g[: prefix_length(len(g), percent) + _extra(len(g), percent) - 1].view(np.int64) if len(g) else None for g in found]
            columns = [pa.array(size, pa.int64()), pa.array([_name(g) if len(g) else None for g in found], pa.binary()), pa.array(part, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n", "node", "part"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, node binary, part array<long>")


def _whole(docs: DataFrame, shingle: int) -> DataFrame:
    """``node, n, grams`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [gram_set(t.as_py() or "", shingle) for t in batch.column(0)]
            columns = [pa.array([_name(g) for g in found], pa.binary()), pa.array([len(g) for g in found], pa.int64()), pa.array([g.view(np.int64) for g in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "n", "grams"])

    return docs.select("text").mapInArrow(run, "node binary, n long, grams array<long>")


def _small(table: DataFrame) -> DataFrame:
    """Broadcast a written table of few rows; merge others by a shuffle."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table.hint("merge")


def _likely(rows: DataFrame, percent: int) -> DataFrame:
    """``node, doc_id`` of sets that may link to another: in a longer prefix, enough of their n-grams are in others' too.

    Prefixes of two sets that link have as many n-grams in common as the smaller of both
    extras says, and the smaller set has at least ``percent`` of the larger one's size.
    """
    copies = cut(rows.groupBy("node").agg(F.count(F.lit(1)).alias("m"), F.min("doc_id").alias("least")).where("m > 1").drop("m"))
    copies = _small(copies.withColumnRenamed("node", "_node"))
    once = rows.join(copies, F.col("node") == F.col("_node"), "left").where(F.col("_node").isNull() | F.col("doc_id").eqNullSafe(F.col("least")))
    posts = once.select(F.xxhash64("node").alias("k"), "n", F.explode("part").alias("g"))
    shared = posts.groupBy("g").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo <> hi").select("g")
    less = f"ceil(n * {percent} / 100.0bd)"
    need = F.expr(f"floor(({less} - ceil({less} * {percent} / 100.0bd) + 2) / 2)")
    found = cut(posts.join(shared.hint("merge"), "g").groupBy("k", "n").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= need).select("k"))
    return once.select("node", "doc_id", F.xxhash64("node").alias("k")).join(_small(found), "k", "left_semi").select("node", "doc_id")


def _ordered(sets: DataFrame, percent: int) -> DataFrame:
    """``node, n, alone, grams``: n-grams that other sets have too, the rarest first; sets with too few of them go."""
    each = sets.select("node", F.explode("grams").alias("g"))
    often = each.groupBy("g").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    kept = each.join(often.hint("merge"), "g").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("f", "g"))).alias("ts"))  # of one text
    kept = kept.join(sets.select("node", "n"), "node").where(F.size("ts") * 100 >= F.col("n") * percent)
    return kept.select("node", "n", (F.col("n") - F.size("ts")).alias("alone"), F.col("ts.g").alias("grams"))


class _Tree:
    """A prefix tree over sets in one global order, most frequent n-grams first: sorted, with the lengths that neighbours share."""

    def __init__(self, seqs: list[np.ndarray], sizes: np.ndarray):
        by = sorted(range(len(seqs)), key=lambda i: seqs[i].astype(">i4").tobytes())
        self.place, self.seqs = np.array(by), [seqs[i] for i in by]
        self.sizes, self.lengths = sizes[by], np.array([len(seqs[i]) for i in by])
        self.common = np.zeros(len(by) + 1, np.int64)
        for i in range(1, len(by)):
            a, b = self.seqs[i - 1], self.seqs[i]
            k = min(len(a), len(b))
            differ = np.flatnonzero(a[:k] != b[:k])
            self.common[i] = differ[0] if len(differ) else k


def tree_links(probes: list[np.ndarray], probe_sizes: np.ndarray, trees: list[np.ndarray], tree_sizes: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of a probe and a tree set that link; sets hold the n-grams that are shared at all, sizes count all.

    The tree is walked once for all probes: a branch adds to each probe's overlap the
    n-grams of its edge, so sets that begin alike share that sum; a probe leaves a
    branch when its overlap and what is left of both can't reach the least one.
    """
    words, flat = np.unique(np.concatenate(probes), return_inverse=True)
    m = len(probes)
    owner = np.repeat(np.arange(m), [len(p) for p in probes])
    who = owner[np.argsort(flat, kind="stable")]
    start = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=len(words)))])
    lengths, total = np.array([len(p) for p in probes]), 100 + percent

    ids, unknown = [], {}
    for s in trees:
        at = np.minimum(np.searchsorted(words, s), len(words) - 1)
        new = words[at] != s
        if new.any():
            at = at.copy()
            at[new] = [unknown.setdefault(g, len(words) + len(unknown)) for g in s[new].tolist()]
        ids.append(at)
    tree = _Tree(ids, tree_sizes)
    xs, ys = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

    def hits(edge: np.ndarray) -> np.ndarray:
        edge = edge[edge < len(words)]
        counts = start[edge + 1] - start[edge]
        skip = np.repeat(start[edge] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
        return np.bincount(who[skip + np.arange(counts.sum())], minlength=m)

    stack = [(0, len(ids), 0, np.arange(m), np.zeros(m, np.int64))]
    while stack:
        lo, hi, depth, alive, have = stack.pop()
        low = int(tree.common[lo + 1 : hi].min()) if hi - lo > 1 else int(tree.lengths[lo])
        have = have + hits(tree.seqs[lo][depth:low])[alive]
        at = lo
        while at < hi and tree.lengths[at] == low:  # sets that end here come first
            ok = alive[total * have >= percent * (probe_sizes[alive] + tree.sizes[at])]
            xs.append(ok)
            ys.append(np.full(len(ok), tree.place[at]))
            at += 1
        if at == hi:
            continue
        edges = [at, *(k for k in range(at + 1, hi) if tree.common[k] == low), hi]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            rest = np.minimum(int(tree.lengths[a:b].max()) - low, lengths[alive] - have)
            keep = total * (have + rest) >= percent * (probe_sizes[alive] + int(tree.sizes[a:b].min()))
            if keep.any():
                stack.append((a, b, low, alive[keep], have[keep]))
    return np.concatenate(xs), np.concatenate(ys)


def _group_links(members: list[tuple], i: int, j: int, gram: int | None, percent: int) -> list[tuple[bytes, int, bytes]]:
    """``node, links, root`` of the sets of two blocks of a family; ``members`` are (block, node, n, alone, grams)."""
    if len(members) < 2:
        return []
    one = [k for k, r in enumerate(members) if r[0] == i]
    two = one if i == j else [k for k, r in enumerate(members) if r[0] == j]
    if not one or not two:
        return []
    seqs, sizes = [np.array(r[4][::-1], np.int64) for r in members], np.array([r[2] for r in members], np.int64)
    x, y = tree_links([seqs[k] for k in one], sizes[one], [seqs[k] for k in two], sizes[two], percent)
    x, y = np.array(one)[x], np.array(two)[y]
    if i == j:
        x, y = x[x < y], y[x < y]
    if gram is not None:  # a pair counts where the first n-gram is that both prefixes have
        heads = [r[4][: prefix_length(r[2], percent) - r[3]] for r in members]
        sets = [set(h) for h in heads]
        first = [next(g for g in heads[a] if g in sets[b]) == gram for a, b in zip(x.tolist(), y.tolist(), strict=True)]
        x, y = x[first], y[first]
    root, count = list(range(len(members))), np.bincount(np.concatenate([x, y]), minlength=len(members))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a, b in zip(x.tolist(), y.tolist(), strict=True):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [(members[k][1], int(count[k]), members[find(k)][1]) for k in np.flatnonzero(count)]


def _joined(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array([r[k] for r in found], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.binary()))]
            return pa.RecordBatch.from_arrays(columns, ["node", "links", "root"])

        now, group = None, []
        for batch in batches:
            found = []
            for unit, i, j, gram, *member in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (unit, i, j) != now:
                    found += _group_links(group, now[1], now[2], last, percent) if group else []
                    now, group, last = (unit, i, j), [], gram
                group.append(tuple(member))
            yield out(found)
        if group:
            yield out(_group_links(group, now[1], now[2], last, percent))

    return run


def set_links(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``node, links, root``: in parts, how many other sets of :func:`_ordered` each set links to, and links that connect as all do.

    Sets whose prefixes share an n-gram, directly or over others, are a family; a set
    is in one family, so it moves once.  A family larger than a tree is dealt to several
    by hashes, and each tree's sets are probed against each tree; beyond
    ``FAMILY_TREES`` trees its sets meet by the n-grams of their prefixes, each such
    bucket again in trees.  Every pair that can link meets, in one place that counts.
    """
    prefix = F.expr(f"cast(n - ceil(n * {percent} / 100.0bd) + 1 - alone as int)")
    posts = cut(sets.where(prefix > 0).select("node", F.explode(F.slice("grams", F.lit(1), prefix)).alias("g")))
    hubs = posts.groupBy("g").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("m")).where("m > 1")
    links = posts.join(hubs.hint("merge"), "g").where("node <> hub").select("node", "hub").distinct()
    stars = star_components(links, "node", "hub")
    family = cut(stars.select(F.col("u").alias("node"), F.col("v").alias("family")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("family")).distinct()))
    sets = sets.withColumn("size", F.size("grams"))
    sizes = sets.select("node", "size").join(family, "node")
    trees = lambda: F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(TREE_SETS)), F.ceil(F.sum("size") / F.lit(TREE_GRAMS))).cast("int").alias("trees")
    of = cut(sizes.groupBy("family").agg(trees(), F.count(F.lit(1)).alias("m")))
    known = cut(join_by_heat(sizes, of, ["family"], "m", BROADCAST_ROWS))
    null = F.lit(None).cast("long")
    members = known.where(F.col("trees") <= FAMILY_TREES).select(F.hex("family").alias("unit"), null.alias("gram"), "node", "trees")
    large = known.where(F.col("trees") > FAMILY_TREES).select("node", "size")
    if not large.isEmpty():
        some = cut(posts.join(large.hint("merge"), "node"))
        buckets = cut(some.groupBy("g").agg(trees(), F.count(F.lit(1)).alias("m")).where("m > 1"))
        some = join_by_heat(some, buckets, ["g"], "m", BROADCAST_ROWS)
        members = members.unionByName(some.select(F.concat(F.lit("g"), F.col("g").cast("string")).alias("unit"), F.col("g").alias("gram"), "node", "trees"))
    block = F.pmod(F.xxhash64("node"), F.col("trees")).cast("int")
    members = members.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)))
    members = members.select("unit", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "gram", "block", "node")
    sent = members.join(sets.select("node", "n", "alone", "grams").hint("merge"), "node").select("unit", "i", "j", "gram", "block", "node", "n", "alone", "grams")
    return sent.repartition("unit", "i", "j").sortWithinPartitions("unit", "i", "j").mapInArrow(_joined(percent), "node binary, links long, root binary")


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, n_links``.

    Two texts link when their sets of word n-grams have ``percent`` of their union in
    common; ``component_id`` is the smallest id that links reach, ``n_links`` the number
    of other sets that the row's own set links to.  Rows of equal sets are one node, so
    copies are never paired.  Sets go that have too few n-grams in common with others
    to link to any; what is left is joined exactly (:func:`set_links`).

    N-grams are told apart by 64-bit hashes, sets by 128 bits.  Null and blank texts
    have the empty set, which links with nothing, so their rows keep their own ids;
    texts of fewer words than an n-gram are one n-gram.  A null id is a component's only
    if it has no other.  Rows that share an id are rows of their own.  An empty table
    gives an empty result; other columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = cut(_sets(docs, shingle, percent))
    full = rows.where(F.col("node").isNotNull())
    likely = cut(_likely(full, percent))
    ids = cut(likely.select(F.col("doc_id").alias("_id")).distinct())
    texts = docs.join(_small(ids), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    sets = cut(_whole(texts, shingle).join(likely.select("node"), "node", "left_semi").dropDuplicates(["node"]))
    links = cut(set_links(cut(_ordered(sets, percent)), percent))
    roots = star_components(links.where("node <> root"), "node", "root")

    counts = links.groupBy("node").agg(F.sum("links").alias("n_links"))
    nodes = full.groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("m")).join(roots.withColumnRenamed("u", "node"), "node", "left")
    nodes = cut(nodes.join(counts, "node", "left").select("node", "least", "m", "n_links", F.coalesce("v", "node").alias("root")))
    named = nodes.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("k"))
    known = cut(join_by_heat(nodes, named, ["root"], "k", BROADCAST_ROWS).select("node", "m", "component_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")))
    found = join_by_heat(full.select("doc_id", "n", "node"), known, ["node"], "m", BROADCAST_ROWS)
    empty = rows.where(F.col("node").isNull()).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links").unionByName(empty)
