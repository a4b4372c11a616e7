"""Benchmark decontamination: CGK embedding, bit-sampling LSH and exact edit distance."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items handled in one pass over the documents; a larger benchmark takes more passes.
ITEMS = 20_000
#: Characters of items, about, in one pass.
CHARS = 32_000_000
#: Edits, as a share of an item's words, up to which a window is a copy of it.
EDITS = 0.2
#: Embeddings with sampled places each, and the number of places.
REPEATS, PLACES = 14, 3
#: Words of document text to search at once.
BLOCK = 400_000

_SEPARATE = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Runs of letters and digits, without regard to case and normal form in all of Unicode."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return text.encode().lower().translate(_SEPARATE).split()


def edit_distance(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """Least edits between all of ``item`` and any part of ``window``, and where that part ends.

    Bit-parallel: one machine word of any width holds a column of the table.
    """
    m = len(item)
    full, last = (1 << m) - 1, 1 << (m - 1)
    peq: dict[int, int] = {}
    for i, s in enumerate(item.tolist()):
        peq[s] = peq.get(s, 0) | 1 << i
    up, down, score = full, 0, m
    best, end = m, 0
    for j, s in enumerate(window.tolist()):
        eq = peq.get(s, 0)
        x = (((eq & up) + up) ^ up) | eq | down
        hu, hd = down | ~(x | up) & full, up & x
        if hu & last:
            score += 1
        elif hd & last:
            score -= 1
        hu, hd = (hu << 1) & full, (hd << 1) & full
        up, down = hd | ~((eq | down) | hu) & full, hu & (eq | down)
        if score < best:
            best, end = score, j + 1
    return best, end


class Index:
    """The benchmark items by sampled places of their embeddings."""

    def __init__(self, items: list[tuple[int, list[bytes]]], edits: float = EDITS, seed: int = 7):
        self.edits = edits
        items = [(i, w) for i, w in items if w]
        self.ids = [i for i, _ in items]
        self.vocab: dict[bytes, int] = {}
        for _, w in items:
            for x in w:
                self.vocab.setdefault(x, len(self.vocab) + 1)
        self.items = [np.array([self.vocab[x] for x in w], np.int64) for _, w in items]
        self.longest = max(map(len, self.items), default=0)
        rng = np.random.default_rng(seed)
        self.sym = rng.integers(1, 1 << 62, len(self.vocab) + 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.steps = rng.integers(1, 1 << 62, (REPEATS, 3 * max(1, self.longest)), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        # Items of like sizes share windows of the smallest size among them.
        self.classes = []
        left = sorted(range(len(self.items)), key=lambda k: len(self.items[k]))
        while left:
            size = len(self.items[left[0]])
            members = [k for k in left if len(self.items[k]) <= max(size, size * 5 // 4)]
            left = left[len(members) :]
            tables = []
            for r in range(REPEATS):
                reach = max(1, 2 * size - 2)
                first = int(rng.integers(0, min(6, reach)))
                more = [j for j in range(reach) if j > first]
                places = sorted([first, *rng.choice(more, min(PLACES - 1, len(more)), replace=False).tolist()])
                stem = np.concatenate([self.items[k][:size] for k in members])
                begin = np.arange(len(members)) * size
                keys = self._walk(stem, begin, begin + size, size, r, places, None)[1]
                tables.append((places, [np.unique(x) for x in keys], keys[-1]))
            self.classes.append((size, np.array(members), tables))

    def _walk(self, words, start, tail, size, r, places, prune):
        """Random walk of every window: each step reads a symbol and moves on or not, as the step and symbol say.

        Keys of the symbols read at ``places`` so far; with ``prune``, windows whose
        key no item has leave at once.  Past the document's end, ``tail``, are words that no item has.
        """
        at, key, keys, n = start.copy(), np.zeros(len(start), np.uint64), [], 0
        pad = len(self.sym) - 1
        for j in range(places[-1] + 1):
            inside = at - start < size
            s = np.where(inside, np.where(at < tail, words[np.minimum(at, len(words) - 1)], 0), pad)
            if j == places[n]:
                key = (key ^ self.sym[s]) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
                keys.append(key)
                if prune is not None:
                    allowed = prune[n]
                    slot = np.minimum(np.searchsorted(allowed, key), len(allowed) - 1)
                    stay = allowed[slot] == key
                    start, tail, at, key, s, inside = start[stay], tail[stay], at[stay], key[stay], s[stay], inside[stay]
                    if not len(start):
                        return start, key
                n += 1
            at = at + (inside & (((self.sym[s] * self.steps[r, j]) >> np.uint64(63)) == 1))
        return start, (key if prune is not None else keys)

    def search(self, words: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """``(item number, document, start, end, edits)`` of copies in ``words``, where 0 is any word no item has.

        Documents begin at ``begins`` and have ``lengths`` words; places count from the document's first word.
        """
        known = np.concatenate([[0], np.cumsum(words > 0)])
        tails = np.repeat(begins + lengths, lengths)
        done: set[tuple[int, int]] = set()
        for size, members, tables in self.classes:
            if len(words) < 1:
                return
            # A copy has all but the edited words of its item, so this loses none.
            ends = np.minimum(np.arange(len(words)) + size, tails)
            spare = int(np.ceil(self.edits * max(len(self.items[k]) for k in members)))
            start = np.flatnonzero((known[ends] - known[:-1] >= size - spare) & (words > 0))
            if not len(start):
                continue
            for r, (places, prune, keys) in enumerate(tables):
                at, key = self._walk(words, start, tails[start], size, r, places, prune)
                if not len(at):
                    continue
                order = np.argsort(keys, kind="stable")
                lo, hi = np.searchsorted(keys[order], key, "left"), np.searchsorted(keys[order], key, "right")
                # A window begins with a word of its document, so its place tells the document; a copy's start doesn't.
                doc = np.searchsorted(begins, at, "right") - 1
                head, tail = begins[doc], begins[doc] + lengths[doc]
                hits = zip(at.tolist(), lo.tolist(), hi.tolist(), doc.tolist(), head.tolist(), tail.tolist(), strict=True)
                for p, a, b, d, head_, tail_ in hits:
                    for k in members[order[a:b]].tolist():
                        n = len(self.items[k])
                        near = (k, d, (p - head_) // max(1, n // 4))
                        if near in done:
                            continue
                        done.add(near)
                        spare = int(self.edits * n)
                        lo_, hi_ = max(head_, p - n // 4 - spare), min(tail_, p + n + n // 4 + spare)
                        edits, end = edit_distance(self.items[k], words[lo_:hi_])
                        if edits <= spare:
                            # Backwards from the end, the best match of the turned item ends where the copy starts.
                            length = edit_distance(self.items[k][::-1], words[lo_ : lo_ + end][::-1][: n + spare])[1]
                            yield k, d, lo_ + end - length - head_, lo_ + end - head_, edits


def _search_docs(docs: DataFrame, index: Index, id_type: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        get = index.vocab.get
        for batch in batches:
            found: list[tuple] = []
            k = 0
            while k < batch.num_rows:
                parts, begins, lengths, size = [], [], [], 0
                first = k
                while k < batch.num_rows and (not parts or size < BLOCK):
                    words = words_of(batch.column(1)[k].as_py() or "")
                    ids = np.fromiter(map(get, words, repeat(0)), np.int64, len(words))
                    parts.append(ids)
                    begins.append(size)
                    lengths.append(len(words))
                    size += len(ids)
                    k += 1
                best: dict[tuple[int, int], tuple] = {}
                for item, d, start, end, edits in index.search(np.concatenate(parts), np.array(begins), np.array(lengths)):
                    row = (edits, start, end - start)
                    best[d, item] = min(best.get((d, item), row), row)
                found += [(first + d, index.ids[item], *row) for (d, item), row in best.items()]
            rows = list(zip(*found, strict=True)) if found else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows[0], pa.int64())), *(pa.array(rows[c], pa.int64()) for c in (1, 3, 4, 2))],
                ["doc_id", "item_id", "start_word", "n_words", "edits"],
            )

    return docs.mapInArrow(run, f"doc_id {id_type}, item_id long, start_word long, n_words long, edits long")


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", edits: float = EDITS, items: int = ITEMS
) -> DataFrame:
    """``doc_id, item_id, start_word, n_words, edits``: the best copy of an item in a document, if there is one.

    A copy is a run of words that ``edits`` of the item's words, or fewer, turn into
    the item.  Every window of an item's size, at every word, that has enough of the
    benchmark's words is embedded by seeded random walks (CGK), under which few
    edits change few places; windows that agree with an item in a walk's sampled
    places are verified by exact edit distance.  Unedited copies are always found.

    The benchmark is read in blocks of about ``items`` items, or :data:`CHARS` characters, each of
    which is sent to the executors and takes a pass over the documents; no document is shuffled.

    Null and empty texts, and items without a word, match nothing.  Repeated rows
    give their rows again; null ids pass through; an empty table on either side gives
    an empty result; other columns are ignored.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null and item_id is not null").distinct()
    n, chars = bench.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // items), -(-chars // CHARS))
    out = None
    for b in range(blocks):
        rows = bench.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        part = _search_docs(slim, Index([(r.item_id, words_of(r.text)) for r in rows], edits), id_type)
        out = part if out is None else out.unionByName(part)
    return out
