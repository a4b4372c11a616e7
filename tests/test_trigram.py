import random
import re

import pytest

from graphloom.operators import trigram, views
from graphloom.operators.model import PropertyGraph

ROW = "seq bigint, id string, namespace string, part int, gram string"


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abAB_.ßé🙂") for _ in range(rng.randint(0, 9)))
    rows = [(i, word(), rng.choice([word(), None]), 1, "g") for i in range(400)]
    rows += [(1000, "", "", 1, "g"), (1001, None, None, 1, "g"), (1002, "x" * 50_000 + "needle", "long", 1, "g"), (1003, "dup", "dup", 1, "g"), (1003, "twice dup", "", 1, "g")]
    df = spark.createDataFrame(rows, ROW)
    return rows, df, trigram.build_trigrams(df, str(tmp_path_factory.mktemp("trigrams")), "seq", ["id", "namespace"], parts=8)


def test_equal_to_contains(world):
    rows, df, index = world
    rng = random.Random(2)
    texts = [t for r in rows for t in r[1:3] if t and len(t) < 100]
    needles = ["", "a", "abA", "ß", "é🙂", "XXXX", "dup", "not there at all", "up tw"]
    for _ in range(4):
        t = rng.choice(texts)
        k = rng.randrange(len(t))
        needles.append(t[k : k + rng.randint(1, 6)].swapcase())
    for n in needles:
        want = {r.seq for r in df.where(views.contains_ci("id", n) | views.contains_ci("namespace", n)).select("seq").collect()}
        assert {r.key for r in trigram.containing(index, n).collect()} == want, n


def test_only_candidates_are_verified(world):
    rows, _, index = world
    found, sure = trigram.candidates(index, "needle")
    assert not sure and [r.key for r in found.collect()] == [1002]
    plan = trigram.containing(index, "needle")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*part#\d+ = ", plan)
    absent, sure = trigram.candidates(index, "abAneedle")
    assert sure and absent.collect() == []


def test_search_as_a_scan(world):
    _, df, index = world
    graph = PropertyGraph(df.withColumnRenamed("gram", "name"), None)
    for text in ("ab", ""):
        got = trigram.search_indexed(graph.nodes, index, text, 10).collect()
        assert [r.seq for r in got] == [r.seq for r in views.search_hits(graph, text).orderBy("seq").limit(10).collect()]
        assert not got or got[0].hits == views.search_hits(graph, text).count()


def test_no_rows(spark, tmp_path):
    index = trigram.build_trigrams(spark.createDataFrame([], ROW), str(tmp_path), "seq", ["id"])
    assert [trigram.containing(index, n).collect() for n in ("", "a", "abc", "abcd")] == [[]] * 4


def test_keywords_through_indexes(spark, tmp_path):
    types = spark.createDataFrame([(i, f"Type{i}", f"N.Type{i}" if i % 5 else f"N.<Type{i}>", False, False, i % 2 == 0) for i in range(40)],
                                  "seq bigint, name string, full_name string, is_interface boolean, is_enum boolean, is_value_type boolean")
    members = spark.createDataFrame([(i // 3, i % 3, "property" if i % 2 else "method", f"Get{i}Type" if i % 4 else f"Run{i}", f"M:{i}", i) for i in range(120)],
                                    "type_seq bigint, seq int, member_kind string, name string, doc_id string, member_key bigint")
    a = trigram.build_trigrams(types, str(tmp_path / "t"), "seq", ["name", "full_name"])
    b = trigram.build_trigrams(members, str(tmp_path / "m"), "member_key", ["name"])
    for text, kind in (("type1", "all"), ("un", "method"), ("", "all")):
        want = views.keyword_search(types, members, text, 60, kind).collect()
        assert trigram.keyword_search_indexed(types, members, a, b, text, 60, kind).collect() == want
