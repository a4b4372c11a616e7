import random

import numpy as np
import pytest

from graphloom.operators import ivf

SCHEMA = "vec_id bigint, embedding array<float>, cell string, id string"


def grouped(n, groups, dims, seed, spread=0.05):
    """Unit vectors around a few directions."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    x = centres[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, dims))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


@pytest.fixture(scope="module")
def grown(spark, tmp_path_factory):
    x = grouped(3000, 40, 32, 1, 0.3)
    df = spark.createDataFrame([(i, v.tolist(), "c", "i") for i, v in enumerate(x)] + [(9000, None, "c", "i")], SCHEMA)
    return x, ivf.build_ivf(df, str(tmp_path_factory.mktemp("ivf")), cells=40)


def test_codes_hold_two_dimensions_a_byte(spark):
    rng = random.Random(1)
    vectors = [[rng.uniform(-1, 1) for _ in range(n)] for n in (1, 2, 7, 64)] + [[0.0, 0.0]]
    df = spark.createDataFrame([(v,) for v in vectors], "v array<float>")
    code, scale, off, length = ivf.packed_code("v")
    for v, r in zip(vectors, df.select(code.alias("c"), scale.alias("s"), off.alias("o"), length.alias("l")).collect(), strict=True):
        assert len(r.c) == (len(v) + 1) // 2
        near = ivf.levels([bytes(r.c)], len(v))[0] * r.s
        assert np.abs(near - v).max() <= r.s / 2 + 1e-6
        assert np.isclose(np.linalg.norm(near - np.float32(v)), r.o, atol=1e-6) and np.isclose(np.linalg.norm(near), r.l, atol=1e-6)


def test_every_row_is_in_a_cell(grown):
    x, index = grown
    assert sorted(r.id for r in index.table("codes").select("id").collect()) == list(range(len(x)))
    assert index.table("cells").agg({"n": "sum"}).first()[0] == len(x)


def test_sure_search_is_exact(grown):
    x, index = grown
    rng = np.random.default_rng(2)
    for q in (x[5], rng.normal(size=32), 3 * x[17] - x[4]):
        got = [(r.id, r.score) for r in ivf.ivf_top_k(index, q.astype(float).tolist(), 7, probe=1, sure=True).collect()]
        want = x.astype(np.float64) @ q
        assert [i for i, _ in got] == sorted(range(len(x)), key=lambda i: (-want[i], i))[:7]
        assert np.allclose([s for _, s in got], sorted(want)[::-1][:7])


def test_search_reads_few_cells(grown):
    x, index = grown
    hits, read = [], []
    sizes = {r.cell: r.n for r in index.table("cells").collect()}
    number, centre, _ = index.centroids()
    for i in range(0, len(x), 300):
        got = {r.id for r in ivf.ivf_top_k(index, x[i].tolist(), 10, probe=6).collect()}
        hits.append(len(got & set(np.argsort(-(x @ x[i]))[:10].tolist())) / 10)
        read.append(sum(sizes[int(c)] for c in number[np.argsort(-(centre @ x[i]))[:6]]) / len(x))
    assert np.mean(hits) >= 0.9 and np.mean(read) <= 0.25
    plan = ivf.ivf_top_k(index, x[0].tolist(), 10, probe=6)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_neighbours_of_the_table(spark, tmp_path, sf, monkeypatch):
    monkeypatch.setattr(ivf, "CHUNK", 40)
    monkeypatch.setattr(ivf, "QUERIES", 3)
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    x = {r.vec_id: np.array(r.embedding, np.float64) for r in df.collect()}
    index = ivf.build_ivf(df, str(tmp_path))
    got: dict = {}
    for r in ivf.ivf_neighbours(index, df.where("vec_id % 100 = 0")).collect():
        got.setdefault(r.query, {})[r.id] = (r.rank, r.score)
    assert set(got) == {i for i in x if i % 100 == 0}
    hits = []
    for q, found in got.items():
        score = {i: float(v @ x[q]) for i, v in x.items() if i != q}
        assert sorted(r for r, _ in found.values()) == list(range(1, 11)) and all(abs(score[i] - s) < 1e-5 for i, (_, s) in found.items())
        hits.append(len(set(sorted(score, key=lambda i: -score[i])[:10]) & set(found)) / 10)
    print(sf, "recall", np.mean(hits))
    assert np.mean(hits) >= 0.9
