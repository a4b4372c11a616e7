import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from graphloom.llm.conversation_trie import conversation_trie

ROW = "conv_id bigint, turn bigint, role string, text string, key int, words string, d int, cls int"
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def digest(r):
    role, text = r[2] or "", r[3] or ""
    return hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).digest()


def brute(rows):
    """Every node by a dictionary of prefixes."""
    own = defaultdict(list)
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, digest(r))):
        own[r[0]].append((r[2] or "", r[3] or ""))
    nodes = defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        path = own.get(base, [])[:h] + own[c][h:]
        for d in range(len(path) + 1):
            nodes[tuple(path[:d])].append((c, len(path) == d))
    kids, leaves, saved = Counter(p[:-1] for p in nodes if p), Counter(), Counter()
    for p, members in nodes.items():
        gain = (len(members) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += gain
            leaves[p[:d]] += not kids[p]
    least = {p: min(c for c, _ in m) for p, m in nodes.items()}
    sha = lambda m: hashlib.sha256(",".join(str(c) for c in sorted(c for c, end in m if end)).encode()).hexdigest()
    return Counter((least[p], len(p), least[p[:-1]] if p else None, len(m), kids[p], leaves[p], saved[p], sha(m)) for p, m in nodes.items())


def nodes(spark, rows, **how):
    df = spark.createDataFrame([(*r, 1, "w", 2, 3) for r in rows], ROW)
    got = conversation_trie(df, **how)
    assert got.columns == NODE
    return Counter(map(tuple, got.collect()))


def talk(rng, i):
    say = lambda: (rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", "", None, "d  e\tf", "a b "]))
    return [(i, t, *say()) for t in range(rng.randint(1, 6))]


@pytest.mark.parametrize("together,most", [(8192, 200_000), (12, 3)])
def test_against_a_dictionary_of_prefixes(spark, together, most):
    rng = random.Random(5)
    rows = [r for i in rng.sample(range(-30, 120), 90) for r in talk(rng, i)]
    rows += [(200 + i, t, "user", f"shared {t}") for i in range(25) for t in range(3 + i % 4)]  # prefixes of one another, and copies
    rows += [(5, None, "user", "before all"), (5, None, None, "too"), (5, 2, "user", "tie"), (5, 2, "user", "tie"), (None, 0, "user", "nobody's")]
    rng.shuffle(rows)
    assert nodes(spark, rows, together=together, most=most) == brute(rows)


def test_long_conversations_and_their_prefixes(spark):
    rows = [(1000 + i, t, "user", f"step {t}") for i in range(12) for t in range(6 * (i + 1))]
    rows += [(2000, t, "assistant", "x " * 50_000) for t in range(150)]
    assert nodes(spark, rows, together=350) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(4, 0, "a", "b"), (5, 0, "a", "b"), (None, 0, "user", "x")], [(21, 0, "a", "x"), (22, 0, "a", "y"), (61, 0, "", None)]])
def test_small_tables(spark, rows):
    assert nodes(spark, rows) == brute(rows)
