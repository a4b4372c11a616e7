import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest

from graphloom.llm import clustering

ROW = "vec_id bigint, embedding array<float>, label int, q int, n int, cluster string"


def brute(rows, dims=64, k=8, rounds=10):
    """``vec_id -> [(cluster, distance, cluster inertia, inertia, centroid hash, same)]`` in plain Python."""
    kept = [(i, tuple(math.floor(1024 * x) for x in e)) for i, e in rows if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    cs = [q for _, q in sorted(kept, key=key)[:k]]
    far = lambda q, c: sum((a - b) ** 2 for a, b in zip(q, c, strict=True))
    near = lambda q: min((far(q, c), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, q in kept:
            groups[near(q)[1]].append(q)
        cs = [tuple(sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)) if groups[j] else c for j, c in enumerate(cs)]
    at, sums, same = [(i, q, *near(q)) for i, q in kept], Counter(), Counter(q for _, q in kept)
    for _, _, d, j in at:
        sums[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return Counter((i, j, d, sums[j], sum(sums.values()), digest[j], same[q]) for i, q, d, j in at)


def vectors(seed, n, hot):
    rng = random.Random(seed)
    e = lambda: [rng.gauss(0, 0.125) for _ in range(64)]
    base = e()
    return [(i, base if i < hot else e()) for i in range(n)]


def table(spark, rows):
    import struct

    single = lambda x: x if x is None or not math.isfinite(x) else struct.unpack("f", struct.pack("f", x))[0]
    rows = [(i, None if e is None else [single(x) for x in e]) for i, e in rows]
    return rows, spark.createDataFrame([(i, e, 0, 1, 2, "x") for i, e in rows], ROW)


@pytest.mark.parametrize("most", [200_000, 5, 0])
def test_against_plain_lloyd(spark, most):
    nan, inf = float("nan"), float("inf")
    rows = vectors(1, 120, 40)
    bad = [[0.1] * 63, [0.1] * 65, [0.1] * 63 + [None], [nan] + [0.1] * 63, [0.2] * 63 + [-inf], None, []]
    rows += [(1000 + i, e) for i, e in enumerate(bad)] + [(7, rows[60][1]), (7, rows[60][1]), (None, rows[61][1]), (None, [-0.5] * 64)]
    rows, df = table(spark, rows)
    assert Counter(map(tuple, clustering.cluster_vectors(df, most=most).collect())) == brute(rows)


def test_hashes_that_collide(spark, monkeypatch):
    rows, df = table(spark, vectors(2, 40, 10))
    monkeypatch.setattr(clustering.F, "xxhash64", lambda *c: clustering.F.lit(1).cast("long"))
    assert Counter(map(tuple, clustering.cluster_vectors(df).collect())) == brute(rows)


def test_few_and_no_vectors(spark):
    for n in (0, 1, 3):
        rows, df = table(spark, vectors(3, n, 2))
        got = clustering.cluster_vectors(df)
        assert got.columns[:6] == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        assert Counter(map(tuple, got.collect())) == brute(rows)


def test_empty_centroids_stay_and_large_components_fail(spark):
    rows, df = table(spark, [(i, [0.25] * 64) for i in range(20)])  # eight equal centroids: seven stay empty
    assert {r.cluster for r in clustering.cluster_vectors(df).collect()} == {0}
    assert Counter(map(tuple, clustering.cluster_vectors(df).collect())) == brute(rows)
    with pytest.raises(Exception, match="too large"):
        clustering.cluster_vectors(table(spark, [(1, [1e9] * 64)])[1]).collect()
