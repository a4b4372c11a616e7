import random

import pytest

from graphloom.operators import paths, strong
from graphloom.operators.model import PropertyGraph

NODES = "seq bigint, id string, name string"
EDGES = "seq bigint, src string, dst string, kind string, details string, line_number int"


def graph(spark, nodes, edges):
    n = spark.createDataFrame([(i, x, x) for i, x in enumerate(nodes)], NODES)
    return PropertyGraph(n, spark.createDataFrame([(i, a, b, "References", "", 0) for i, (a, b) in enumerate(edges)], EDGES))


def whole_search(nodes, edges):
    """The search of the whole graph in one go."""
    out, known = {}, set(nodes)
    for i, (a, b) in enumerate(edges):
        if a in known and b in known:
            out.setdefault(a, []).append((i, b))
    return sorted(" -> ".join(c) for c in strong.ordered_search(nodes, out)[0])


def reach(edges):
    found = {a: {b for x, b in edges if x == a} for a in {x for e in edges for x in e}}
    for _ in found:
        for a in found:
            found[a] |= {c for b in found[a] for c in found[b]}
    return found


def random_graph(seed, chain=False):
    rng = random.Random(seed)
    names = [f"{c}{i}" for i, c in enumerate(rng.sample("ABCDEFGHIJKLMNOP", 14))]
    if not chain:
        return names, [(rng.choice(names), rng.choice([*names, "Q"])) for _ in range(rng.randint(12, 26))]
    edges = []  # components of three nodes, each with several ways into the next
    for k in range(0, 12, 3):
        a = names[k : k + 3]
        edges += [(a[0], a[1]), (a[1], a[2]), (a[2], a[0]), (a[1], a[0])]
        edges += [(rng.choice(a), rng.choice(names[k + 3 : k + 6])) for _ in range(3) if k < 9]
    rng.shuffle(edges)
    rng.shuffle(names)
    return names, edges


@pytest.mark.parametrize("seed,chain", [(1, False), (3, True), (4, True)])
def test_components_searched_apart_give_the_cycles_of_the_whole_search(spark, seed, chain):
    nodes, edges = random_graph(seed, chain)
    want = whole_search(nodes, edges)
    assert want and sorted(r.cycle_key for r in paths.detect_cycles(graph(spark, nodes, edges)).collect()) == want


def test_strong_components_against_mutual_reach(spark):
    for seed in (6,):
        _, edges = random_graph(seed)
        r = reach(edges)
        want = {(a, min(b for b in r[a] if a in r[b])) for a in r if len({b for b in r[a] if a in r[b]} | {a}) > 1}
        want = {(a, min(a, c)) for a, c in want}
        df = spark.createDataFrame(edges, "src string, dst string")
        assert {tuple(x) for x in strong.strong_components(df).collect()} == want


def test_entry_by_a_detour(spark):
    # the search goes A, B, D before it looks at A -> C, so the ring D, E is entered at D though E comes first in order
    nodes, edges = ["A", "E", "C", "B", "D"], [("A", "B"), ("B", "D"), ("A", "C"), ("C", "E"), ("D", "E"), ("E", "D"), ("E", "E")]
    got = sorted(r.cycle_key for r in paths.detect_cycles(graph(spark, nodes, edges)).collect())
    assert got == whole_search(nodes, edges) == ["D -> E -> D", "E -> E"]


def test_graphs_without_cycles(spark):
    assert paths.detect_cycles(graph(spark, "ABC", ["AB", "BC", "AC"])).collect() == []
    assert paths.detect_cycles(graph(spark, "ABC", ["AA", "AB"])).first().nodes == ["A", "A"]
    assert strong.strong_components(spark.createDataFrame([("A", "B"), ("C", "C")], "src string, dst string")).collect() == []
