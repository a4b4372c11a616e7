import hashlib
import random

import numpy as np
import pytest

from graphloom.llm import suffix_dedup


def brute_repeats(rows, span=100):
    """Per row (id, text): a window is gone if a smaller id has it, or the same row before; rows of one id are no earlier."""
    first = {}  # window -> smallest id; a null id is the smallest
    order = lambda i: (i is not None, i)
    datas = [(i, (t or "").encode()) for i, t in rows]
    for i, b in datas:
        for k in range(len(b) - span + 1):
            w = b[k : k + span]
            first[w] = min(first.get(w, i), i, key=order)
    out = []
    for i, b in datas:
        gone, seen = bytearray(len(b)), set()
        for k in range(len(b) - span + 1):
            w = b[k : k + span]
            if first[w] != i or w in seen:
                gone[k : k + span] = b"\1" * span
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((-1 if i is None else i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def fixture():
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdeé ", k=rng.randint(2, 9)))
    shared = [" ".join(word() for _ in range(30)) for _ in range(4)]
    rows = [(i, " ".join(rng.choice([word(), word(), rng.choice(shared)]) for _ in range(12))) for i in range(60)]
    rows += [(60, "z" * 500), (61, "ab" * 300), (62, None), (63, ""), (64, rows[7][1]), (65, "z" * 99)]
    # rows that lack or share an id, with the same text and with others
    rows += [(None, shared[0] + word()), (None, word() + shared[0] + shared[1]), (7, rows[9][1]), (7, rows[7][1] + word()), (None, None)]
    return rows + [(None, shared[2] * 2), (70, shared[3] * 3), (70, shared[3] * 3)]


@pytest.mark.parametrize("together", [suffix_dedup.TOGETHER, 16])
def test_repeats(spark, together):
    """All surroundings of an anchor in one task, and passages dealt one by one."""
    rows = fixture()
    docs = spark.createDataFrame([(i, t, "b", 1) for i, t in rows], "doc_id bigint, text string, blob string, `row` int").repartition(3)
    got = suffix_dedup.remove_repeats(docs, together=together).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, *tuple(r)[1:]) for r in got) == brute_repeats(rows)
    assert suffix_dedup.remove_repeats(docs.where("false")).count() == 0


def test_long_documents(spark):
    rng = random.Random(4)
    part = "".join(rng.choices("abcdefghij ", k=3_000))
    long = "".join("".join(rng.choices("abcdefghij ", k=40_000)) + part for _ in range(20))
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(spark.createDataFrame([(1, long), (2, part)], "doc_id bigint, text string")).collect()}
    assert got[1].n_spans == 19 and abs(got[1].n_removed - 19 * 3_000) < 60 and got[2].n_removed == 3_000


def test_order_of_suffixes():
    rng = np.random.default_rng(1)
    for _ in range(100):
        n, width = rng.integers(1, 40), rng.integers(1, 12)
        data = rng.integers(97, 99, (n, width), dtype=np.uint8)
        length, segment = rng.integers(0, width + 1, n), np.sort(rng.integers(0, 4, n))
        key = lambda i: (segment[i], data[i, : length[i]].tobytes())  # noqa: B023, E731
        order, shared = suffix_dedup.Suffixes(data, length, segment).sorted_classes()
        assert order.tolist() == sorted(range(n), key=key)
        for q in range(1, n):
            (s, a), (t, b) = key(order[q - 1]), key(order[q])
            same = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert shared[q] == (same if s == t else 0)


def test_order_survives_colliding_hashes(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_BYTE", np.ones(256, np.uint64))  # all strings of a length hash alike
    data = np.random.default_rng(1).integers(97, 110, (40, 9), dtype=np.uint8)
    order, shared = suffix_dedup.Suffixes(data, np.full(40, 9), np.repeat([0, 1], 20)).sorted_classes()
    rows = [data[i].tobytes() for i in order]
    assert rows == sorted(rows[:20]) + sorted(rows[20:]) and shared.max() < 9
