"""Views larger than the grid: its border cells hold most nodes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import spatial

VIEW = "idx long, x double, y double, radius double, mass double, degree int, pinned boolean"


@pytest.fixture(scope="module")
def view(spark):
    rng = np.random.default_rng(1)
    n = 1200
    radius = np.where(rng.random(n) < 0.03, rng.random(n) * 900, rng.random(n) * 60)
    rows = zip(range(n), rng.normal(0, 9000, n).tolist(), rng.normal(0, 9000, n).tolist(), radius.tolist(), (1 + rng.random(n)).tolist(), [1] * n, (rng.random(n) < 0.1).tolist(), strict=True)
    return spark.createDataFrame(list(rows), VIEW).coalesce(2).cache()


@pytest.mark.parametrize("scale", [1.0, 2.0])
def test_counts_are_those_of_the_pairs(view, scale):
    pairs = spatial.neighbour_pairs(view, scale).groupBy("i").count()
    want = {r.i: r["count"] for r in pairs.collect()}
    assert {r.i: r.n for r in spatial.neighbour_counts(view, scale, ranked=100).collect()} == want and len(want) > 300


@pytest.mark.parametrize("scale", [1.0, 2.0])
def test_collisions_are_those_of_all_pairs_of_the_grid(view, scale):
    p = view.orderBy("idx").toPandas()
    x, y, r = p.x.to_numpy(), p.y.to_numpy(), p.radius.to_numpy() * scale
    size = max(100.0, 120.0 * scale)
    cx, cy = (np.clip(np.floor(v / size) + 64, 0, 127) for v in (x, y))
    want = {}
    for i in range(len(p)):
        for j in range(i + 1, len(p)):
            d = np.hypot(x[i] - x[j], y[i] - y[j])
            over = r[i] + r[j] + 6 * scale - d
            if over > 0 and abs(cx[i] - cx[j]) <= 1 and abs(cy[i] - cy[j]) <= 1:
                push = (0.6 if over > r[i] * 0.5 else 0.35) * over / d / 2
                for k, way in ((i, 1), (j, -1)):
                    want.setdefault(k, np.zeros(2))
                    want[k] += way * push * np.array([x[i] - x[j], y[i] - y[j]]) * (not p.pinned[k])
    got = {r.idx: (r.fx, r.fy) for r in spatial.collisions(view, scale).collect()}
    assert got.keys() == want.keys() and len(want) > 20
    assert all(np.allclose(got[k], want[k]) for k in want)


def test_a_crowded_cell_makes_no_pairs_of_distant_nodes(spark):
    far = spark.range(20_000).select(F.col("id").alias("idx"), (9000 + F.col("id") % 200 * 60.0).alias("x"), (9000 + F.floor(F.col("id") / 200) * 60.0).alias("y"),
                                     F.lit(6.0).alias("radius"), F.lit(1.0).alias("mass"), F.lit(1).alias("degree"), F.lit(False).alias("pinned"))
    assert spatial.collisions(far).count() == 0  # all in one cell of the grid: 200 million pairs
    n = spatial.neighbour_counts(far)
    assert n.agg(F.sum("n")).first()[0] == 20_000 * 19_999 // 2
    joins = [x for x in n._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x]
    assert joins and all("block" in x for x in joins)  # ranks with totals of blocks, never nodes with nodes


def test_repulsion_in_parts_is_that_of_all_pairs(view):
    p = view.orderBy("idx").toPandas()
    x, y, m = p.x.to_numpy(), p.y.to_numpy(), p.mass.to_numpy()
    dx, dy = x[:, None] - x, y[:, None] - y
    d2 = dx * dx + dy * dy
    soft = np.maximum(d2, 64 + 4 * (m[:, None] + m))
    force = np.where(d2 <= 2500.0**2, 350 * m / soft / np.sqrt(soft), 0)
    want = np.column_stack([(dx * force).sum(axis=1), (dy * force).sum(axis=1)])
    others = (d2 <= 2500.0**2).sum(axis=1) > 1
    for parts in ({}, {"own": 20, "others": 50}):
        got = {r.idx: (r.fx, r.fy) for r in spatial.repulsion(view, **parts).collect()}
        assert set(got) == set(np.flatnonzero(others))
        assert all(np.allclose(got[k], want[k]) for k in got)
