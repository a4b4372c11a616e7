"""Quality classes from an interpolated modified Kneser-Ney model of trusted text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from .common import cut, packed_by, parts_for, unpacked

#: Code points of an n-gram.  No alphabet is folded, so the model grows with the corpus.
ORDER = 5
#: Quantiles of trusted documents' perplexity, by language, outside which a document goes.
LOW, HIGH = 0.002, 0.995
#: Bytes of input file that make a block of documents.
BLOCK = 10 << 20
#: Code points whose n-grams are made at once.
SLICE = 1 << 20
#: How hard documents are compressed before they are dealt to blocks.
LEVEL = 7
#: Of so many trusted documents one is kept apart from the model, for the upper threshold.
APART = 5
#: Parts that the documents of one language are dealt into for the join with its thresholds.
SALTS = 32

_NEWLINE = 10
_STEP = np.uint64(0x9E3779B97F4A7C15)


def grams(texts: Iterable[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(codes, at, hash, doc)``, a slice at a time: of each n-gram its place in the codes, its hash and its text's number.

    Every code point ends one n-gram; newlines precede a text, and n-grams don't cross texts.
    """
    n = ORDER - 1
    pad = np.full(n, _NEWLINE, np.uint32)
    parts: list[np.ndarray] = []
    ends: list[np.ndarray] = []
    docs: list[np.ndarray] = []
    size = 0

    def flush():
        codes, ends_ = np.concatenate(parts), np.concatenate(ends)
        value = (codes.astype(np.uint64) + np.uint64(1)) * _STEP
        value ^= value >> np.uint64(32)
        h = value[: len(codes) - n].copy()
        for k in range(1, ORDER):
            h = h * _STEP + value[k : len(codes) - n + k]
        h ^= h >> np.uint64(29)
        at = np.flatnonzero(ends_) - n
        return codes, at, h[at], np.concatenate(docs)

    for d, text in enumerate(texts):
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        before = pad
        for lo in range(0, len(codes), SLICE):
            some = codes[lo : lo + SLICE]
            parts += [before, some]
            ends += [np.zeros(n, bool), np.ones(len(some), bool)]
            docs.append(np.full(len(some), d))
            size += len(some)
            before = np.concatenate([before, some])[-n:]
            if size >= SLICE:
                yield flush()
                parts, ends, docs, size = [], [], [], 0
    if size:
        yield flush()


class Numbers:
    """Places of hashes among the distinct ones of some texts: a table over their leading bits, and a search for what it misses."""

    BITS = 22

    def __init__(self, texts: list[str]):
        self.keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.unique(h) for _, _, h, _ in grams(texts))]))
        self.shift = np.uint64(64 - self.BITS)
        self.table = np.zeros(1 << self.BITS, np.int32)
        self.table[(self.keys >> self.shift).astype(np.int64)] = np.arange(len(self.keys))

    def __call__(self, h: np.ndarray) -> np.ndarray:
        at = self.table[(h >> self.shift).astype(np.int64)]
        missed = np.flatnonzero(self.keys[at] != h)
        at[missed] = np.searchsorted(self.keys, h[missed])
        return at


def distinct_grams(texts: list[str], trusted: list[bool]) -> tuple[list[str], np.ndarray]:
    """All distinct n-grams in the order of their hashes, and how often trusted texts have them."""
    number = Numbers(texts)
    rows, counts = np.zeros((len(number.keys), ORDER), np.uint32), np.zeros(len(number.keys), np.int64)
    trust, known = np.array(trusted, bool), np.zeros(len(number.keys), bool)
    for codes, at, h, doc in grams(texts):
        n = number(h)
        new = np.flatnonzero(~known[n])
        rows[n[new]] = codes[at[new][:, None] + np.arange(ORDER)]
        known[n[new]] = True
        counts += np.bincount(n[trust[doc]], minlength=len(counts))
    whole = rows.astype("<u4").tobytes().decode("utf-32-le")
    return [whole[i : i + ORDER] for i in range(0, len(whole), ORDER)], counts


def _documents(table: pa.Table) -> pa.Table | None:
    """The documents of a block."""
    found = [*unpacked(blob.as_buffer() for blob in table.column("blob").combine_chunks())]
    return pa.concat_tables(found) if found else None


def _texts(docs: pa.Table) -> list[str]:
    return [t or "" for t in docs.column("text").to_pylist()]


def _needed(docs: pa.Table, trusted: pa.Table) -> pa.Table:
    """``block, at, gram, c``: a block's distinct n-grams, numbered, and how often its trusted documents have each."""
    names = ["block", "at", "gram", "c"]
    rows = _documents(docs)
    if rows is None:
        return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.string(), pa.int64())], names)
    trust = pc.is_in(rows.column("doc_id"), trusted.column("doc_id").combine_chunks(), skip_nulls=True).to_pylist()
    found, c = distinct_grams(_texts(rows), trust)
    found = pa.array(found, pa.string())
    order = pc.sort_indices(found)  # neighbours begin alike, which the written table compresses
    block = pa.array(np.full(len(c), docs.column("key")[0].as_py()))
    return pa.table([block, order.cast(pa.int64()), found.take(order), pa.array(c).take(order)], names)


def _scored(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """``doc_id, lang, n_symbols, perplexity`` of a block's documents from the surprise of its distinct n-grams."""
    rows = _documents(docs)
    nll = np.zeros(answers.num_rows)
    nll[answers.column("at").to_numpy()] = answers.column("nll").to_numpy()
    texts = _texts(rows)
    sums, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    number = Numbers(texts)
    for _, _, h, doc in grams(texts):
        sums += np.bincount(doc, nll[number(h)], len(texts))
        n += np.bincount(doc, minlength=len(texts))
    perplexity = np.where(n > 0, np.exp(sums / np.maximum(n, 1)), 1.0)
    return pa.table([rows.column("doc_id"), rows.column("lang"), pa.array(n), pa.array(perplexity)], ["doc_id", "lang", "n_symbols", "perplexity"])


def kneser_ney(counts: DataFrame) -> DataFrame:
    """``gram, p``: the interpolated modified Kneser-Ney probability of the last symbol of every ``gram`` of ``counts``.

    ``counts`` has each n-gram once, with ``c``, 0 for those that are only asked for.  All
    tables are sharded by n-gram or context, and each order takes one join with its contexts' totals
    and one with the shorter order.  Counts below the highest order are numbers of distinct preceding symbols.
    """
    levels = {ORDER: cut(counts.select("gram", "c"))}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = cut(levels[k + 1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.sum((F.col("c") > 0).cast("long")).alias("c")))
    # A symbol that trusted text lacks shares the weight of one symbol beyond those it has.
    p = levels[1].select(F.lit("").alias("gram"), "c").groupBy("gram").agg((1 / (F.sum((F.col("c") > 0).cast("long")) + 1)).alias("p"))
    for k in range(1, ORDER + 1):
        level = levels[k]
        of = level.agg(*[F.sum((F.col("c") == j).cast("double")).alias(f"n{j}") for j in range(1, 5)]).select(_discounts().alias("d"))
        of = F.broadcast(of)  # one row
        context, rest = F.substring("gram", 1, k - 1), F.substring("gram", 2, k - 1)  # keys that rows needn't carry
        cut_off = F.when(F.col("c") > 0, F.element_at("d", F.least("c", F.lit(3)).cast("int"))).otherwise(0.0)
        totals = level.where("c > 0").crossJoin(of).groupBy(context.alias("ctx")).agg(F.sum("c").alias("total"), F.sum(cut_off).alias("mass"))
        known = level.join(totals, context == F.col("ctx"), "left").select("gram", "c", "total", "mass")
        known = known.join(p.select(F.col("gram").alias("g"), F.col("p").alias("q")), rest == F.col("g")).crossJoin(of)
        some = (F.col("c") - cut_off + F.col("mass") * F.col("q")) / F.col("total")
        p = cut(known.select("gram", F.coalesce(some, F.col("q")).alias("p")))
    return p


def _discounts() -> Column:
    """Discounts of counts 1, 2 and 3 or more, from the numbers of n-grams with counts 1 to 4."""
    n = [F.col(f"n{j}") for j in range(1, 5)]
    y = F.when((n[0] > 0) & (n[1] > 0), n[0] / (n[0] + 2 * n[1])).otherwise(0.5)
    one = lambda k: F.when(n[k - 1] > 0, F.greatest(F.least(k - (k + 1) * y * n[k] / n[k - 1], F.lit(k - 0.05)), F.lit(0.05))).otherwise(0.5)
    return F.array(one(1), one(2), one(3))


def score_perplexity(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """``doc_id, lang, n_symbols, perplexity`` of every row of ``docs``; an empty text has perplexity 1.

    Documents are dealt to blocks, compressed.  Each block asks for its distinct n-grams; they meet the model of
    the trusted documents' n-grams in joins by n-gram, and the answers meet the block's documents again.
    """
    id_type = docs.schema["doc_id"].dataType
    blocks = parts_for(docs, BLOCK)
    # A row's block follows from its id, and without one from its text.
    block = F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")), F.lit(blocks))
    dealt = packed_by(block, docs.select("doc_id", "lang", "text"), LEVEL).groupBy("key")
    trusted = trusted.select(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("key"), "doc_id")
    needed = cut(dealt.cogroup(trusted.groupBy("key")).applyInArrow(_needed, "block long, at long, gram string, c long"))
    p = kneser_ney(needed.groupBy("gram").agg(F.sum("c").alias("c")))
    answers = needed.join(p, "gram").select("block", "at", (-F.log("p")).cast("float").alias("nll"))
    columns = [StructField("doc_id", id_type), StructField("lang", StringType()), StructField("n_symbols", LongType()), StructField("perplexity", DoubleType())]
    return dealt.cogroup(answers.groupBy("block")).applyInArrow(_scored, StructType(columns))


def classify_quality(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", low: float = LOW, high: float = HIGH
) -> DataFrame:
    """One row per input row: ``doc_id, lang, n_symbols, perplexity, low, high, kept``.

    Trusted text is every document labelled with quality 1.  All its n-grams of
    :data:`ORDER` code points are counted; the interpolated modified Kneser-Ney
    probabilities, and every document's perplexity under them, come from joins
    of sharded counts, whose number grows with the corpus.  A document stays if its
    perplexity lies between two quantiles of its language's trusted ones: the upper one of the trusted
    documents (one in :data:`APART`, by a hash of the id) that the model isn't fitted to, as a model
    finds its own text less surprising than any other; the lower one of all.

    Null and empty texts have perplexity 1 and go if a threshold is known.
    Languages without trusted text (a null one too), or without some kept apart, use the quantiles of all
    trusted documents; without any trusted text all documents stay.  Repeated rows give a
    row each; an empty table gives an empty result; other columns are ignored.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    trusted = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast(slim.schema["doc_id"].dataType).alias("doc_id")).distinct()
    apart = F.pmod(F.xxhash64("doc_id"), F.lit(APART)) == 0
    scored = cut(score_perplexity(slim, trusted.where(~apart)))
    # merged at every size: a broadcast of labels would be bounded by nothing
    sure = scored.join(trusted.hint("merge"), "doc_id", "left_semi").where("n_symbols > 0")
    quantile = lambda column, q: F.percentile_approx(column, F.lit(q), F.lit(10_000))
    bounds = F.array(quantile("perplexity", low), quantile(F.when(apart, F.col("perplexity")), high)).alias("b")
    rest = sure.agg(bounds, quantile("perplexity", high).alias("h")).first()  # one row: the quantiles of all trusted documents
    rest = [rest.b[0], rest.h if rest.b[1] is None else rest.b[1]]
    # A language may hold most documents: its thresholds are repeated for each salt, and the documents dealt over the salts.
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    by_lang = sure.groupBy(F.coalesce("lang", F.lit("")).alias("_lang")).agg(bounds).select("_lang", "b", salts)
    low_, high_ = (F.coalesce(F.col("b")[i], F.lit(rest[i]).cast("double")) for i in (0, 1))
    return (
        scored.withColumn("_lang", F.coalesce("lang", F.lit("")))
        .withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        .join(by_lang, ["_lang", "_salt"], "left")
        .select("doc_id", "lang", "n_symbols", "perplexity", low_.alias("low"), high_.alias("high"))
        .withColumn("kept", F.coalesce(F.col("perplexity").between(F.col("low"), F.col("high")), F.lit(True)))
    )
