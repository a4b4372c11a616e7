import random
import re
from collections import defaultdict

import numpy as np
import pytest

from graphloom.llm import jaccard_join as J

ROW = "doc_id bigint, text string, n int, node int, links string, component_id int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()


def brute(rows, percent=85):
    """``(doc_id, size, component, links)`` of every row, from all pairs of sets."""
    nodes = list({grams(t) for _, t in rows} - {frozenset()})
    links = defaultdict(set)
    for i, x in enumerate(nodes):
        for y in nodes[:i]:
            if 100 * len(x & y) >= percent * len(x | y):
                links[x].add(y)
                links[y].add(x)
    ids, comp = defaultdict(list), {}
    for d, t in rows:
        if d is not None:
            ids[grams(t)].append(d)
    for x in nodes:
        if x not in comp:
            seen, todo = {x}, [x]
            while todo:
                for y in links[todo.pop()] - seen:
                    seen.add(y)
                    todo.append(y)
            least = min((d for y in seen for d in ids[y]), default=None)
            comp |= dict.fromkeys(seen, least)
    found = [(d, len(g), comp[g] if g else d, len(links[g])) for d, t in rows for g in [grams(t)]]
    return sorted(found, key=repr)


def corpus(rng, families, size, words=90):
    """Families of near copies with few or many edits, a passage that many share, and texts of their own."""
    word = lambda: f"w{rng.randint(0, 3000)}"
    shared, rows = " ".join(word() for _ in range(40)), []
    for f in range(families):
        base = [word() for _ in range(rng.randint(5, words))]
        for _ in range(size):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(t))
                t[k : k + 1] = rng.choice([[word()], [], [word(), t[k]]])
            rows.append(" ".join(t) + (f" {shared}" if f % 3 == 0 else ""))
    rows += [f"{shared} " + " ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(30)]
    rng.shuffle(rows)
    return rows


def run(spark, rows, **how):
    df = spark.createDataFrame([(d, t, 1, 2, "l", 3) for d, t in rows], ROW)
    return sorted(map(tuple, J.jaccard_components(df, **how).collect()), key=repr)


@pytest.mark.parametrize("sets,trees,broadcast", [(1024, 16, 200_000), (5, 16, 3), (4, 1, 200_000)])
def test_against_all_pairs(spark, monkeypatch, sets, trees, broadcast):
    monkeypatch.setattr(J, "TREE_SETS", sets)
    monkeypatch.setattr(J, "FAMILY_TREES", trees)
    monkeypatch.setattr(J, "BROADCAST_ROWS", broadcast)
    rng = random.Random(sets)
    texts = corpus(rng, 6, 15)
    texts += [texts[0], texts[0].upper(), "One two", "one  TWO", "ONE\ttwo three", "", None, " \n ", "É é É é", "é é é é", "a b c d", "x"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[8]), (3, texts[3]), (None, texts[5]), (None, "nobody else has this text"), (None, None)]
    want = brute(rows)
    assert sum(r[3] for r in want) > 50
    assert run(spark, rows) == want


def test_long_texts_and_no_texts(spark):
    rng = random.Random(2)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:50_000])), (3, " ".join(words[:52_000])), (4, " ".join(words[:40_000])), (5, "x y " * 40_000)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_tree_against_all_pairs():
    rng = np.random.default_rng(1)
    for _ in range(30):
        base = rng.choice(10**6, 60, replace=False)
        seqs = [np.sort(np.where(rng.random(60) < 0.06, rng.choice(10**6, 60), base))[: rng.integers(1, 61)] for _ in range(25)]
        seqs = [np.unique(s) for s in seqs]
        sizes = np.array([len(s) + rng.integers(0, 4) for s in seqs])
        x, y = J.tree_links(seqs[:12], sizes[:12], seqs[12:], sizes[12:])
        both = lambda a, b: len(np.intersect1d(seqs[a], seqs[12 + b]))
        want = {(a, b) for a in range(12) for b in range(13) if 100 * both(a, b) >= 85 * (sizes[a] + sizes[12 + b] - both(a, b))}
        assert set(zip(x.tolist(), y.tolist(), strict=True)) == want
