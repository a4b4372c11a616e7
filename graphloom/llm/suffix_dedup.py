"""Removal of passages that occur earlier in the corpus, by hash-compared suffix sorting.

Two equal passages of ``span`` bytes agree on everything inside, so both have the
same least-hashed ``GRAM`` bytes (the anchor) at the same place.  Only suffixes
that start at an anchor which occurs twice can belong to a repeated passage.  They
are merge-sorted, with what precedes them in reverse: two suffixes are compared by
a binary search for their common extension over prefix polynomial hashes, and the
order is verified by its bytes.  A passage repeats where enough before and behind
the anchor is common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed_by, parts_for, unpacked

#: Bytes of an anchor.
GRAM = 40
#: Bytes of a text whose anchors are found at once.
SLICE = 1 << 22
#: Differing surroundings of an anchor that meet in one task, about, before its passages are dealt one by one.
TOGETHER = 1 << 16
#: Surroundings sorted at once.
CHUNK = 1 << 14

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_EMPTY, _NONE = np.zeros(0, np.int64), np.zeros(0, np.uint64)
#: Marks a row that only says that its anchor's passages are dealt one by one.
_NOTICE = 255


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, SLICE + 1024), _powers(_INVERSE, SLICE + 1024)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of each ``size`` bytes from prefix polynomial hashes, modulo 2**64, over random byte values."""
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _UP[: len(data)], out=prefix[1:])
    return _mixed((prefix[size:] - prefix[:-size]) * _DOWN[: len(data) - size + 1])


def anchors(data: np.ndarray, span: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the leftmost least gram of every ``span`` bytes of ``data``."""
    places, hashes = [_EMPTY], [np.zeros(0, np.uint64)]
    width = span - gram + 1
    low = np.uint64((1 << 24) - 1)
    for at in range(0, max(0, len(data) - span + 1), SLICE):
        part = data[at : at + SLICE + span - 1]
        h = gram_hashes(part, gram)
        n = len(h)
        keys = np.full(-(-n // width) * width, np.iinfo(np.uint64).max)
        keys[:n] = (h & ~low) | np.arange(n, dtype=np.uint64)
        blocks = keys.reshape(-1, width)
        head = np.minimum.accumulate(blocks, axis=1).ravel()
        tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = (np.minimum(tail[: n - width + 1], head[width - 1 : n]) & low).astype(np.int64)
        least = least[np.concatenate([[True], least[1:] != least[:-1]])]
        places.append(least + at)
        hashes.append(h[least])
    place, first = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(hashes)[first]


@cache
def _codec() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def _dump(*arrays: np.ndarray) -> bytes:
    """Columns one after the other, each with its length before it, compressed."""
    return _codec()[0].compress(b"".join(len(x).to_bytes(8, "little") + x.tobytes() for x in arrays))


def _load(blobs: list[bytes], *kinds) -> list[np.ndarray]:
    columns: list[list[np.ndarray]] = [[] for _ in kinds]
    for blob in blobs:
        blob, at = _codec()[1].decompress(blob), 0
        for c, kind in enumerate(kinds):
            kind = np.dtype(kind)
            n = int.from_bytes(blob[at : at + 8], "little")
            columns[c].append(np.frombuffer(blob, kind, n, at + 8))
            at += 8 + n * kind.itemsize
    return [np.concatenate(x) if x else np.zeros(0, k) for x, k in zip(columns, kinds, strict=True)]


def _dealt(key: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """``(key, blob)`` of the rows of each key, in their order."""
    order = np.argsort(key, kind="stable")
    sorted_ = key[order]
    edges = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1], [True]])) if len(key) else []
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        some = order[lo:hi]
        yield int(sorted_[lo]), _dump(*(x[some] for x in arrays))


def _frame(rows) -> pd.DataFrame:
    return pd.DataFrame(list(rows), columns=["key", "blob"])


def _repeated(h: np.ndarray) -> np.ndarray:
    """Whether each value occurs more than once."""
    _, back, n = np.unique(h, return_inverse=True, return_counts=True)
    return n[back] > 1


class Suffixes:
    """Byte strings, the rows of ``data`` up to their ``length``, compared by prefix hashes; ``segment`` keeps groups apart.

    Rows of a segment are adjacent.
    """

    def __init__(self, data: np.ndarray, length: np.ndarray, segment: np.ndarray):
        self.data, self.length = data, length.astype(np.int64)
        self.prefix = np.zeros((len(data), data.shape[1] + 1), np.uint64)
        for j in range(data.shape[1]):
            self.prefix[:, j + 1] = self.prefix[:, j] * np.uint64(_BASE) + _BYTE[data[:, j]]
        new = np.concatenate([[True], segment[1:] != segment[:-1]])
        begin = np.flatnonzero(new)
        self.begin = np.repeat(begin, np.diff(np.append(begin, len(data))))
        self.end = np.repeat(np.append(begin[1:], len(data)), np.diff(np.append(begin, len(data))))

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension of rows ``x`` and ``y``, by binary search."""
        lo, hi = np.zeros(len(x), np.int64), np.minimum(self.length[x], self.length[y])
        for _ in range(int(hi.max(initial=0)).bit_length()):
            mid = (lo + hi + 1) >> 1
            same = self.prefix[x, mid] == self.prefix[y, mid]
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def _byte(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The byte at a place, -1 past the end."""
        inside = at < self.length[x]
        return np.where(inside, self.data[x, np.minimum(at, self.data.shape[1] - 1)].astype(np.int64), -1)

    def compare(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Below, at or above 0 as ``x`` is less than, equal to or greater than ``y``."""
        at = self.common(x, y)
        return self._byte(x, at) - self._byte(y, at)

    def order(self) -> np.ndarray:
        """Rows in lexicographic order inside their segments: a stable merge sort of all segments at once.

        Each round merges neighbouring runs: a row's place is its own number in its run
        plus that of the other run's rows before it, which a binary search finds.
        """
        order = np.arange(len(self.data))
        width, longest = 1, int((self.end - self.begin).max(initial=0))
        while width < longest:
            at = np.flatnonzero(self.end - self.begin > width)  # places in segments with a run to merge
            row, begin, end = order[at], self.begin[at], self.end[at]
            run, number = (at - begin) // width, (at - begin) % width
            left = run % 2 == 0
            other = np.minimum(begin + (run + np.where(left, 1, -1)) * width, end)
            lo = other.copy()
            hi = np.minimum(lo + width, end)
            while (open_ := np.flatnonzero(lo < hi)).size:
                mid = (lo[open_] + hi[open_]) >> 1
                sign = self.compare(order[mid], row[open_])
                before = np.where(left[open_], sign < 0, sign <= 0)
                lo[open_] = np.where(before, mid + 1, lo[open_])
                hi[open_] = np.where(before, hi[open_], mid)
            pair = begin + run // 2 * 2 * width
            new = order.copy()
            new[pair + number + (lo - other)] = row
            order, width = new, 2 * width
        return order

    def sorted_classes(self) -> tuple[np.ndarray, np.ndarray]:
        """The order, and how much each row in it has in common with the one before it, both verified by bytes.

        An order whose neighbours are verified is right as a whole.  A segment that fails
        (by a collision of hashes) is sorted by its bytes.
        """
        order = self.order()
        bad = self._check(order)
        for begin in np.unique(self.begin[bad]).tolist():
            rows = range(begin, int(self.end[begin]))
            order[begin : begin + len(rows)] = sorted(rows, key=lambda i: self.data[i, : self.length[i]].tobytes())
        return order, self._neighbours(order)

    def _neighbours(self, order: np.ndarray) -> np.ndarray:
        """By bytes: the common prefix of each row with the one before it in its segment, 0 for a segment's first."""
        out = np.zeros(len(order), np.int64)
        for lo in range(1, len(order), CHUNK):
            x, y = order[lo : lo + CHUNK], order[lo - 1 : lo + CHUNK - 1][: len(order) - lo]
            most = np.minimum(self.length[x], self.length[y])
            differs = (self.data[x] != self.data[y]) | (np.arange(self.data.shape[1]) >= most[:, None])
            out[lo : lo + len(x)] = np.where(differs.any(axis=1), differs.argmax(axis=1), most)
        out[np.unique(self.begin)] = 0
        return out

    def _check(self, order: np.ndarray) -> np.ndarray:
        """Places whose row isn't, by its bytes, at or after the one before it."""
        at = np.flatnonzero(self.begin != np.arange(len(order)))
        x, y = order[at - 1], order[at]
        m = self._neighbours(order)[at]
        return at[self._byte(x, m) > self._byte(y, m)]


_ANCHOR = (np.uint64, np.int64, np.int64)
_RUN = (np.int64, np.int64, np.int64)
_LEAF = (np.uint64, np.uint64, np.int64, np.int64, np.int64)


def _later(group: np.ndarray, d: np.ndarray, r: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Of rows with equal passages (the same ``group``), which are later than another.

    A row is later than any of a smaller document, and than those that start before
    it in the same row.  Rows of one id are no earlier or later than each other.
    """
    order = np.lexsort((p, r, d, group))
    g, d, r, p = group[order], d[order], r[order], p[order]
    if not len(g):
        return np.zeros(0, bool)
    new = np.concatenate([[True], g[1:] != g[:-1]])
    other = new | np.concatenate([[True], (r[1:] != r[:-1]) | (d[1:] != d[:-1])])
    origin, row = (np.maximum.accumulate(np.where(x, np.arange(len(g)), 0)) for x in (new, other))
    out = np.empty(len(g), bool)
    out[order] = (d != d[origin]) | (p > p[row])
    return out


class _Job:
    """The functions of one run.

    Keys below ``buckets`` are buckets of anchors, then come buckets of passages, then
    blocks of documents.  A row is known by ``r``, a hash of its id and text.
    """

    def __init__(self, span: int, blocks: int, together: int):
        self.span, self.blocks, self.buckets = span, blocks, blocks
        self.hot = max(1, together // blocks)
        self.side = span - GRAM
        self.context = np.dtype((np.uint8, (GRAM + 2 * self.side,)))

    def bucket(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(20)) % np.uint64(self.buckets)).astype(np.int64)

    def runs(self, r: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, bytes]]:
        return _dealt(2 * self.buckets + r % self.blocks, r, start, end)

    def find(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Anchors of documents, by bucket.

        Of an anchor that a batch has several times, one goes to the bucket, marked
        by a negative place; the others are known to repeat, and are dealt by
        document past the buckets, so no bucket gets a row per copy.
        """
        for batch in batches:
            row, place, hashes = [_EMPTY], [_EMPTY], [_NONE]
            for r, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                p, h = anchors(np.frombuffer(text.as_buffer() or b"", np.uint8), self.span)
                row.append(np.full(len(p), r, np.int64))
                place.append(p)
                hashes.append(h)
            r, p, h = np.concatenate(row), np.concatenate(place), np.concatenate(hashes)
            many = _repeated(h)
            first = np.zeros(len(h), bool)
            first[np.unique(h, return_index=True)[1]] = True
            rows = [*_dealt(self.bucket(h[first]), h[first], r[first], np.where(many[first], ~p[first], p[first]))]
            rest = ~first
            rows += _dealt(self.buckets + r[rest] % self.blocks, h[rest], r[rest], p[rest])
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.binary())], ["key", "blob"]
            )

    def match(self, key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Anchors that occur twice or more, by block of their document."""
        h, r, p = _load(pdf["blob"].tolist(), *_ANCHOR)
        if key[0] < self.buckets:
            twice = _repeated(h) | (p < 0)
            h, r, p = h[twice], r[twice], np.where(p < 0, ~p, p)[twice]
        return _frame(_dealt(r % self.blocks, h, r, p))

    def contexts(self, docs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        """What surrounds each repeated anchor, by bucket.

        Of equal surroundings within the block, the earliest goes on; the others are
        repeats as a whole, known without further comparison.  An anchor with very many
        differing surroundings in the block is noticed to its bucket, and its passages
        are dealt by their hashes.
        """
        h, r, p = _load(found["blob"].tolist(), *_ANCHOR)
        order = np.lexsort((p, r))
        h, r, p = h[order], r[order], p[order]
        side, out, runs = self.side, [], []
        seen: dict[bytes, tuple[int, int, int]] = {}
        rows = {(d, r_): text for d, r_, text in _documents(docs)}  # repeated rows once
        for (d, row), text in sorted(rows.items()):
            lo, hi = np.searchsorted(r, row, "left"), np.searchsorted(r, row, "right")
            data = text.encode()
            at, first = np.unique(p[lo:hi], return_index=True)
            at_hash, at = h[lo:hi][first][at + GRAM <= len(data)], at[at + GRAM <= len(data)]
            if not len(at):
                continue
            padded = np.frombuffer(bytes(side) + data + bytes(side), np.uint8)
            around = padded[at[:, None] + np.arange(GRAM + 2 * side)]
            left, right = np.minimum(side, at), np.minimum(side, len(data) - at - GRAM)
            for i, (x, a, b) in enumerate(zip(at.tolist(), left.tolist(), right.tolist(), strict=True)):
                was = seen.setdefault(around[i].tobytes() + bytes((a, b)), (d, row, x))
                if was[0] != d or was[1] == row and was[2] != x:
                    runs.append((row, x - a, x + GRAM + b))
                else:
                    out.append((at_hash[i], d, row, x, a, b, around[i]))
        made: list = []
        if out:
            columns = [np.array(c, t) for c, t in zip(zip(*out, strict=True), (np.uint64, *3 * [np.int64], np.uint8, np.uint8, np.uint8), strict=True)]
            columns = [c[np.argsort(columns[0], kind="stable")] for c in columns]
            kinds, back, n = np.unique(columns[0], return_inverse=True, return_counts=True)
            hot = (n > self.hot)[back]
            noticed = kinds[n > self.hot]
            zero = np.zeros(len(noticed), np.int64)
            notices = [noticed, zero, zero, zero, np.full(len(noticed), _NOTICE, np.uint8), zero.astype(np.uint8), np.zeros(len(noticed), self.context)]
            cold = [np.concatenate([c[~hot], x]) for c, x in zip(columns, notices, strict=True)]
            made += _dealt(self.bucket(cold[0]), *cold)
            made += self.passages(*(c[hot] for c in columns[1:]))
        if runs:
            made += self.runs(*(np.array(x, np.int64) for x in zip(*runs, strict=True)))
        return _frame(made)

    def passages(self, d, r, p, left, right, around) -> list[tuple[int, bytes]]:
        """All passages of these surroundings: the earliest of equal ones by 128 hash bits, the others as runs."""
        side, span = self.side, self.span
        found: list[list[np.ndarray]] = []
        for j in range(side + 1):
            rows = np.flatnonzero((side - left.astype(int) <= j) & (j + span <= side + GRAM + right.astype(int)))
            if len(rows):
                data = _BYTE[around[rows, j : j + span]]
                one = (data * _UP[:span]).sum(axis=1, dtype=np.uint64)
                two = ((data ^ (data >> np.uint64(17))) * _DOWN[:span]).sum(axis=1, dtype=np.uint64)
                found.append([_mixed(one), _mixed(two), d[rows], r[rows], p[rows] - side + j])
        if not found:
            return []
        return self._settled(*(np.concatenate(c) for c in zip(*found, strict=True)), on=True)

    def _settled(self, one, two, d, r, start, on: bool) -> list[tuple[int, bytes]]:
        """Later passages as runs; with ``on``, those that aren't later by what is known here go on to their bucket."""
        group = np.unique(np.stack([one, two], axis=1), axis=0, return_inverse=True)[1].ravel()
        later = _later(group, d, r, start)
        rows = [*self.runs(r[later], start[later], start[later] + self.span)]
        if on:
            go = ~later
            rows += _dealt(self.buckets + self.bucket(one[go]), one[go], two[go], d[go], r[go], start[go])
        return rows

    def compare(self, key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Runs of bytes covered by an earlier equal passage, by block of their document."""
        if key[0] >= self.buckets:
            return pdf
        h, d, r, p, left, right, around = _load(pdf["blob"].tolist(), np.uint64, *3 * [np.int64], np.uint8, np.uint8, self.context)
        dealt = np.isin(h, h[left == _NOTICE])
        one_by_one = np.flatnonzero(dealt & (left != _NOTICE))
        made = self.passages(*(c[one_by_one] for c in (d, r, p, left, right, around))) if len(one_by_one) else []
        some = np.flatnonzero(~dealt)
        some = some[_repeated(h[some])]
        some = some[np.argsort(h[some], kind="stable")]
        anchor = h[some]
        begin = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(some) else _EMPTY
        at = 0
        while at < len(some):  # whole anchors, about CHUNK surroundings at once
            k = np.searchsorted(begin, at + CHUNK, "right") - 1
            end = int(begin[k]) if k >= 0 and begin[k] > at else int(next(iter(begin[begin > at]), len(some)))
            end = len(some) if len(some) - at <= CHUNK else end
            rows = some[at:end]
            first, last = self.covered(h[rows], d[rows], r[rows], p[rows], left[rows], right[rows], around[rows])
            hit = np.flatnonzero(last >= 0)
            start = p[rows][hit] - self.side
            made += self.runs(r[rows][hit], start + first[hit], start + last[hit] + self.span)
            at = end
        return _frame(made)

    def covered(self, h, d, r, p, left, right, around) -> tuple[np.ndarray, np.ndarray]:
        """First and last place in its surroundings at which each anchor has an earlier equal passage, -1 for none.

        Rows of an anchor are adjacent.  With the suffixes and the reversed prefixes in
        order, rows that share the first ``n`` bytes are neighbours; a passage is as many
        bytes before its anchor and the rest from it on, so equal passages share a class
        in both orders.  All passages that hold an anchor overlap, so what lies between is covered too.
        """
        n, span, side = len(h), self.span, self.side
        behind = Suffixes(around[:, side:], GRAM + right.astype(np.int64), h)
        ahead = Suffixes(np.ascontiguousarray(around[:, :side][:, ::-1]), left, h)
        sorts = [(s, *s.sorted_classes()) for s in (behind, ahead)]
        first, last = np.full(n, -1, np.int64), np.full(n, -1, np.int64)

        def classes(which: int, size: int) -> np.ndarray:
            suffixes, order, shared = sorts[which]
            new = shared < size
            new[suffixes.begin[np.arange(n)] == np.arange(n)] = True
            out = np.empty(n, np.int64)
            out[order] = np.cumsum(new)
            return out

        for j in range(side + 1):
            before, rest = side - j, span - side + j
            rows = np.flatnonzero((left >= before) & (right >= rest - GRAM))
            if len(rows) < 2:
                continue
            group = classes(0, rest)[rows] * np.int64(n + 1) + classes(1, before)[rows]
            some = _repeated(group)
            rows, group = rows[some], group[some]
            later = rows[_later(group, d[rows], r[rows], p[rows])]
            first[later] = np.where(first[later] < 0, j, first[later])
            last[later] = j
        return first, last

    def settle(self, key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Runs of the passages that were dealt one by one; keys become blocks of documents."""
        if key[0] >= 2 * self.buckets:
            made = ((key[0], blob) for blob in pdf["blob"])
        else:
            made = self._settled(*_load(pdf["blob"].tolist(), *_LEAF), on=False)
        return _frame((k - 2 * self.buckets, blob) for k, blob in made)

    def remove(self, docs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        r, s, e = _load(found["blob"].tolist(), *_RUN)
        order = np.lexsort((s, r))
        r, s, e = r[order], s[order], e[order]
        out = []
        for d, row, text in _documents(docs):
            data = text.encode()
            lo, hi = np.searchsorted(r, row, "left"), np.searchsorted(r, row, "right")
            runs = merged_runs(s[lo:hi], e[lo:hi])
            digest, at = hashlib.sha256(), 0
            for a, b in runs:
                digest.update(data[at:a])
                at = b
            digest.update(data[at:])
            out.append((None if d == _NULL else d, len(data), sum(b - a for a, b in runs), len(runs), digest.hexdigest()))
        table = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
        table["doc_id"] = table["doc_id"].astype("Int64")
        return table


#: Where rows without an id stand in the order.
_NULL = -(1 << 63)


def _documents(docs: pd.DataFrame) -> Iterator[tuple[int, int, str]]:
    """``(id, row, text)`` of a block's documents."""
    for table in unpacked(docs["blob"]):
        yield from zip(table.column("id").to_pylist(), table.column("row").to_pylist(), table.column("text").to_pylist(), strict=True)


def merged_runs(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of what the sorted ``[start, end)`` cover."""
    if not len(start):
        return []
    reach = np.maximum.accumulate(end)
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    edges = np.flatnonzero(new)
    return [*zip(start[edges].tolist(), reach[np.append(edges[1:], len(start)) - 1].tolist(), strict=True)]


def remove_repeats(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", span: int = 100, together: int = TOGETHER
) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    Removes each byte covered by ``span`` bytes that also start earlier: in a
    smaller id, or before in the same document, overlaps included.  Matches are
    judged on the input and never cross documents.

    Shuffled are anchors (about one in 30 bytes, packed), the texts, once, and the
    surroundings of repeated anchors, all compressed.  Groups are buckets of hashes and blocks of
    documents of about the same file size at any input size; what a task has
    several times is combined before it is shuffled.  Of an anchor, about ``together`` differing surroundings
    (and one a block) meet in a task; where there are more, each passage around it is dealt
    by its own 128-bit hash instead, after equal ones in a block are combined.

    Null and empty texts have no bytes and lose none.  Rows that share an id are one
    place in the order, so neither is earlier than the other, and each loses what
    its own text repeats; rows are told apart by a 64-bit hash of id and text, and
    repeated rows (the same id and text) give the same row each.  A null id comes before
    all others and stays null.  Ids are integers.  Empty table: empty result; other
    columns are ignored.
    """
    if span <= GRAM:
        raise ValueError(f"span must be over {GRAM}")
    if span - GRAM >= _NOTICE:
        raise ValueError(f"span must be under {GRAM + _NOTICE}")
    parts = parts_for(docs, 6 << 20)
    job = _Job(span, parts, together)
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL)).alias("id"), F.xxhash64(F.col(id_col).cast("long"), text).alias("row"), text.alias("text")
    )
    blob = "key long, blob binary"
    by_block = packed_by(F.pmod("row", F.lit(parts)), slim).groupBy("key")

    def match(key, pdf):
        return job.match(key, pdf)

    def compare(key, pdf):
        return job.compare(key, pdf)

    def settle(key, pdf):
        return job.settle(key, pdf)

    found = slim.select("row", "text").mapInArrow(job.find, blob).groupBy("key").applyInPandas(match, blob)
    around = by_block.cogroup(found.groupBy("key")).applyInPandas(lambda a, b: job.contexts(a, b), blob)
    runs = around.groupBy("key").applyInPandas(compare, blob).groupBy("key").applyInPandas(settle, blob)
    return by_block.cogroup(runs.groupBy("key")).applyInPandas(
        lambda a, b: job.remove(a, b), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
