"""Harmonic packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Distinct chunks, and distinct plain words, that a worker remembers the ids of; it forgets all beyond that.
MEMO = 700_000
#: Characters of text to tokenise at once.
BLOCK = 2_000_000
#: Documents of a batch whose texts and ids are Python objects at once.
SLICE = 256
#: A Latin-1 word, then ASCII punctuation: two pre-tokens for sure, each of which is lower-cased by itself.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")


#: Texts by which a vocabulary is tested: those it doesn't take apart as :class:`Ids` does are left to the library as a whole.
_PROBES = [
    "", " ", "Don't-stop...  now\tand\nthen \r\n x", "ABC Éclair İstanbul ﬁ ſ ß Σας", "a<|endoftext|>b </s> [CLS] <s>", "x=1234567890;  y+=0.5e-3\u00a0z", "日本語 テスト жук 𝄞 👍🏽",
    "snake_case CamelCase e-mail@host.org http://a.b/c?d=e", "  leading and trailing  ", "it's we'll I'd THEY'RE", "!!! ??? --- *** ### &&&", "\u200bzero\u2009width\u3000wide",
]


class Ids:
    """Token ids of texts, as little-endian 32-bit words.

    The vocabulary drops white space and no token spans it, so a text's ids are
    those of its chunks between spaces and newlines, and equal chunks are
    tokenised once.  A plain word skips normalisation and pre-tokenisation, which
    leave it as it is in lower case.  A vocabulary of which that isn't true, as
    probes tell, tokenises whole texts.  ``most`` chunks and words are remembered.
    """

    def __init__(self, tokenizer_file: str, most: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        bare = json.loads(self.tokenizer.to_str()) | {"normalizer": None, "added_tokens": []}
        self.words = Tokenizer.from_str(json.dumps(bare))
        self.words.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.memo: dict[str, bytes] = {}
        self.plain: dict[str, bytes] = {}
        self.most, self.block = most, min(BLOCK, 4 * most)
        self.splits = True
        try:
            self.splits = self(_PROBES) == list(self._chunks(_PROBES)) and all(self([a + " " + b]) == list(self._chunks([a + " " + b])) for a in _PROBES for b in _PROBES)
        except Exception:  # the bare vocabulary can't be built or asked: no rule of ours holds
            self.splits = False
        self.memo.clear()

    def _chunks(self, chunks: list[str]) -> Iterator[bytes]:
        for lo in range(0, len(chunks), 4096):
            for e in self.tokenizer.encode_batch(chunks[lo : lo + 4096], add_special_tokens=False):
                yield np.array(e.ids, "<u4").tobytes()

    def _words(self, words: list[str]) -> Iterator[bytes]:
        """Of lower-case words that split nowhere, tokenised as one text."""
        for lo in range(0, len(words), 4096):
            some = words[lo : lo + 4096]
            e = self.words.encode(" ".join(some), add_special_tokens=False)
            ids, ends = np.array(e.ids, "<u4"), np.searchsorted(np.array(e.word_ids), np.arange(len(some) + 1))
            for i in range(len(some)):
                yield ids[ends[i] : ends[i + 1]].tobytes()

    def _learn(self, chunks: set[str]) -> None:
        split = {x: m.groups() for x in chunks if (m := _PLAIN.fullmatch(x))}
        words = {w.lower() for w, _ in split.values()}
        new = words.difference(self.plain)
        if len(self.plain) + len(new) > self.most:
            self.plain.clear()
            new = words
        new = list(new)
        self.plain.update(zip(new, self._words(new), strict=True))
        other = [*{t for _, t in split.values()}.union(chunks.difference(split))]
        ids = dict(zip(other, self._chunks(other), strict=True))
        plain = self.plain
        for x in chunks:
            if x in split:
                word, tail = split[x]
                self.memo[x] = plain[word.lower()] + ids[tail] if tail else plain[word.lower()]
            else:
                self.memo[x] = ids[x]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.splits:
            return list(self._chunks(texts))
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            taken, size = [], 0
            while at < len(texts) and (not taken or size + len(texts[at]) <= self.block):
                taken.append(texts[at].replace("\n", " ").split(" "))
                size += len(texts[at])
                at += 1
            asked = set().union(*taken)
            new = asked.difference(self.memo)
            if len(self.memo) + len(new) > self.most:
                self.memo.clear()
                new = asked
            self._learn(new)
            known = self.memo.__getitem__
            out.extend(b"".join(map(known, chunks)) for chunks in taken)
        return out

    def forget(self) -> None:
        """Give what is remembered back to the system: Spark keeps the process for tasks of other stages."""
        self.memo, self.plain = {}, {}
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # only glibc holds freed memory back, and has this
            ctypes.CDLL(None).malloc_trim(0)


def reciprocals(capacity: int) -> list[int]:
    """Numbers of pieces a sequence may have: each 1/k of it is a class's slot."""
    ks, k = [], 1
    while k <= capacity:
        ks.append(k)
        k += max(1, k // 8)
    return ks


class Cutter:
    """Cuts a document of n tokens into pieces of reciprocal-capacity classes.

    Of what is left, the largest slot that fits is cut off, until a whole rest
    leaves no more than a ``1 / slack`` of its slot empty.
    """

    def __init__(self, capacity: int, slack: int = 64):
        self.capacity, self.slack = capacity, slack
        self.ks = reciprocals(capacity)
        self.slots = [capacity // k for k in self.ks]
        self.memo: dict[int, list[tuple[int, int]]] = {}

    def __call__(self, n: int) -> list[tuple[int, int]]:
        """``(length, class)`` of each piece, in order."""
        full, rest = divmod(n, self.capacity)
        if rest not in self.memo:
            self.memo[rest] = self._cut(rest)
        return [(self.capacity, 0)] * full + self.memo[rest]

    def _cut(self, rest: int) -> list[tuple[int, int]]:
        out = []
        while rest:
            home = max(c for c, slot in enumerate(self.slots) if slot >= rest)
            slot = self.slots[home]
            if (slot - rest) * self.slack <= slot or home + 1 == len(self.slots):
                out.append((rest, home))
                break
            out.append((self.slots[home + 1], home + 1))
            rest -= self.slots[home + 1]
        return out


_ids: dict[tuple[str, int], Ids] = {}


def _ids_of(tokenizer_file: str, most: int) -> Ids:
    """One tokeniser, with what it remembers, for each worker process, file and bound."""
    if (tokenizer_file, most) not in _ids:
        _ids[tokenizer_file, most] = Ids(tokenizer_file, most)
    return _ids[tokenizer_file, most]


def cut_pieces(
    docs: DataFrame, tokenizer_file: str, *, id_col: str, text_col: str, capacity: int, end_id: int, memo: int | None = None
) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, kind, part, rank``: each document's pieces.

    ``rank`` numbers the pieces of a class that one task made.
    """
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _ids_of(tokenizer_file, MEMO if memo is None else memo)
        try:
            yield from cut_batches(ids_of, batches)
        finally:
            if memo is not None:
                ids_of.forget()

    def cut_batches(ids_of: Ids, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(capacity)
        part = TaskContext.get().partitionId()
        seen = [0] * len(cutter.slots)
        for batch in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
            doc, start, length, crc, whole, kind, rank = ([] for _ in range(7))
            for k, ids in enumerate(ids_of([x or "" for x in batch.column(1).to_pylist()])):
                view = memoryview(ids + tail)
                n, at = len(view) // 4, 0
                for size, c in cutter(n):
                    doc.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(view[4 * at : 4 * (at + size)]))
                    whole.append(n)
                    kind.append(c)
                    rank.append(seen[c])
                    seen[c] += 1
                    at += size
            long = lambda x: pa.array(x, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(long(doc)), *map(long, (start, length, crc, whole, kind, [part] * len(doc), rank))],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "kind", "part", "rank"],
            )

    id_type = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    columns = "start long, length long, ids_crc32 long, doc_tokens long, kind long, part long, rank long"
    return slim.mapInArrow(run, f"doc_id {id_type}, {columns}")


def _fit(lengths: list[int], capacity: int) -> list[int]:
    """Sequence of each piece: longest first, into the first sequence with room."""
    room: list[int] = []
    out = [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = next((s for s, free in enumerate(room) if free >= lengths[i]), len(room))
        if at == len(room):
            room.append(capacity)
        room[at] -= lengths[i]
        out[i] = at
    return out


def pack_documents(
    docs: DataFrame,
    tokenizer_file: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 4096,
    end_id: int = 2,
    memo: int | None = None,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Harmonic packing: a piece's length puts it in a class of slots of 1/k of a
    sequence, and k pieces of a class, wherever they were made, fill one.  A piece's
    place in its class is its task's count of earlier tasks' pieces plus its own
    number, so tasks fill sequences without waiting for each other.  Each class
    leaves less than one sequence over; those pieces, at most the sum of all k and
    so bounded by the capacity and not by the input, are packed longest first.

    Pieces are written once, with lengths and checksums and without ids.  Null and
    empty texts have one token, the end.  Repeated rows are packed again; null ids
    pass through; an empty table gives an empty result; other columns are ignored.

    A worker remembers the ids of :data:`MEMO` chunks and words from task to task;
    with ``memo``, of as many, and of none after a task, so that other stages of one
    application have that memory.  Results don't depend on it.
    """
    pieces = cut(cut_pieces(docs, tokenizer_file, id_col=id_col, text_col=text_col, capacity=capacity, end_id=end_id, memo=memo))
    ks = reciprocals(capacity)
    per = F.element_at(F.array(*[F.lit(k) for k in ks]), (F.col("kind") + 1).cast("int"))

    counts = pieces.groupBy("kind", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("n").over(Window.partitionBy("kind"))
    bases = counts.select("kind", "part", F.coalesce(before, F.lit(0)).alias("base"), total.alias("total"))
    placed = (
        pieces.join(bases, ["kind", "part"])
        .withColumn("rank", F.col("rank") + F.col("base"))
        .withColumn("per", per)
        .withColumn("full", F.col("rank") < F.col("total") - F.pmod("total", "per"))
    )
    step = len(ks) + 1
    filled = placed.where("full").withColumn("sequence_id", F.floor(F.col("rank") / F.col("per")) * step + F.col("kind"))

    def last(pdf):
        pdf = pdf.sort_values(["kind", "rank"], ignore_index=True)
        pdf["sequence_id"] = [s * step + step - 1 for s in _fit(pdf["length"].tolist(), capacity)]
        return pdf

    keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "kind", "rank"]
    rest = placed.where("not full").select(*keep)
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rest.schema)}, sequence_id long"
    rest = rest.groupBy(F.lit(0).alias("one")).applyInPandas(last, schema)
    run = Window.partitionBy("sequence_id").orderBy("kind", "rank")
    offset = F.sum("length").over(run) - F.col("length")
    return (
        filled.select(*keep, "sequence_id")
        .unionByName(rest)
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("sequence_id").cast("long").alias("sequence_id"), offset.alias("offset"))
    )
