"""Token counts by heap-and-linked-list byte-pair merging."""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Distinct chunks a worker remembers; it forgets all of them beyond that.
MEMO = 400_000


def read_pieces(model_file: str) -> dict[str, int]:
    """Rank (from 1) of every ordinary piece of a BPE model file; smaller merges first."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    plain = ["ﬁ Éa\u0301 ＡＢ  ½ \u00a0x", "tab\tand\r\nbreak", "日本 жук 𝄞"]
    for text in plain:
        shown = "".join(model.id_to_piece(i) if not model.is_byte(i) else f"<{model.id_to_piece(i)}>" for i in model.encode(text))
        if any(ch not in shown and ch not in " " and not any(model.is_byte(i) for i in model.encode(ch)) for ch in text):
            raise ValueError(f"{model_file} normalises texts, which this counter doesn't")
    pieces = [
        (-model.get_score(i), i, model.id_to_piece(i))
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]
    ranks: dict[str, int] = {}
    last, rank = None, 0
    for score, _, piece in sorted(pieces):
        rank += score != last  # equal scores share a rank: the leftmost pair merges first
        last, ranks[piece] = score, rank
    return ranks


def merged_count(symbols: str, rank: dict[str, int]) -> int:
    """Initial symbols less merges: pop the lowest-ranked adjacent pair, the leftmost on a tie, until none is left.

    Symbols form a linked list; ``now[i]`` is the rank of the pair that starts at
    ``i``, 0 if there is none, so an outdated heap entry is known by its rank.
    """
    n = left = len(symbols)
    if n < 2:
        return n
    shift = n.bit_length()
    mask = (1 << shift) - 1
    get = rank.get
    now = [get(symbols[i : i + 2], 0) for i in range(n)]
    now[-1] = 0
    heap = [r << shift | i for i, r in enumerate(now) if r]
    if not heap:
        return left
    piece, prev, nxt = list(symbols), list(range(-1, n - 1)), list(range(1, n + 1))
    pop, push = heapq.heappop, heapq.heappush
    heapq.heapify(heap)
    while heap:
        key = pop(heap)
        i = key & mask
        if now[i] != key >> shift:
            continue
        j = nxt[i]
        both = piece[i] = piece[i] + piece[j]
        left -= 1
        now[j] = 0
        j = nxt[i] = nxt[j]
        if j < n:
            prev[j] = i
            now[i] = r = get(both + piece[j], 0)
            if r:
                push(heap, r << shift | i)
        else:
            now[i] = 0
        p = prev[i]
        if p >= 0:
            now[p] = r = get(piece[p] + both, 0)
            if r:
                push(heap, r << shift | p)
    return left


class TokenCounter:
    """Counts the tokens of texts as the library of a BPE model does.

    No merge may join an ordinary symbol to a following space mark, and none may
    touch a newline; where the pieces say so, a text falls into chunks that merge
    independently, and equal chunks are merged once.
    """

    #: Characters of text to take apart at once.
    BLOCK = 2_000_000

    def __init__(self, rank: dict[str, int]):
        self.rank, self.memo = rank, {}
        self.symbols = {x for x in rank if len(x) == 1}
        self.pairs = {p[i : i + 2] for p in rank for i in range(len(p) - 1)}
        self.splits = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in rank)

    def chunks(self, text: str) -> list[str]:
        """What merges independently, without newlines."""
        if not text:
            return []
        if not self.splits:
            return [SPACE + text.replace(" ", SPACE)]
        if "  " not in text and text[0] != " " and SPACE not in text:
            return (SPACE + text.replace(" ", "\n" + SPACE)).split("\n")
        out = []
        for line in (SPACE + text.replace(" ", SPACE)).split("\n"):
            at, n = 0, len(line)
            while at < n:  # space marks, then other symbols up to the next mark
                end = at
                while end < n and line[end] == SPACE:
                    end += 1
                end = line.find(SPACE, end)
                end = n if end < 0 else end
                out.append(line[at:end])
                at = end
        return out

    def learn(self, chunks: set[str]) -> None:
        """Put the counts of ``chunks`` into the memo."""
        if len(self.memo) + len(chunks) > MEMO:
            self.memo.clear()
        memo, rank, pairs, symbols = self.memo, self.rank, self.pairs, self.symbols
        for x in chunks:
            n = at = 0
            # No merge crosses a place whose two neighbours no piece has side by side.
            cuts = [i for i in range(1, len(x)) if x[i - 1 : i + 1] not in pairs]
            for end in (*cuts, len(x)):
                part, at = x[at:end], end
                if (m := memo.get(part)) is None:
                    m = merged_count(part, rank)
                    if not symbols.issuperset(part):  # a symbol that is no piece falls back to its bytes
                        m += sum(len(c.encode()) - 1 for c in part if c not in symbols)
                    memo[part] = m
                n += m
            memo[x] = n

    def __call__(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        at = 0
        while at < len(texts):
            taken, size = [], 0
            while at < len(texts) and (not taken or size + len(texts[at]) <= self.BLOCK):
                taken.append(self.chunks(texts[at]))
                size += len(texts[at])
                at += 1
            asked = set(chain.from_iterable(taken))
            if new := asked.difference(self.memo):
                self.learn(new if len(self.memo) + len(new) <= MEMO else asked)
            known = self.memo
            for chunks, text in zip(taken, texts[at - len(taken) : at], strict=True):
                out.append(sum(map(known.__getitem__, chunks)) + (text.count("\n") if self.splits else 0))
        return out


_counters: dict[str, TokenCounter] = {}


def _counter_of(model_file: str) -> TokenCounter:
    """One counter, with what it remembers, for each worker process and model."""
    if model_file not in _counters:
        _counters[model_file] = TokenCounter(read_pieces(model_file))
    return _counters[model_file]


def count_tokens(
    docs: DataFrame, model_file: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096
) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_tokens, over_limit``.

    Counts are those of the model's library without begin and end tokens: initial
    symbols less merges, with no identifiers made.  The vocabulary file must be at
    ``model_file`` on every executor.  A map without shuffle; very long texts need
    memory for one text.

    Null and empty texts have no bytes and no tokens.  Repeated rows give a row
    each; null ids pass through; an empty table gives an empty result; other columns
    are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter_of(os.fspath(model_file))
        for batch in batches:
            n = count([x or "" for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).alias("text"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
    )
    return slim.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn(
        "over_limit", F.col("n_tokens") > limit
    )
