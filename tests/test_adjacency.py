import random
import re

import pytest
from pyspark.sql import functions as F

from graphloom.operators import metrics, views
from graphloom.operators.adjacency import open_graph, store_graph
from graphloom.operators.model import PropertyGraph, first_edges
from graphloom.plans import registry
from graphloom.sources import star

NODES = "seq bigint, id string, name string, namespace string, origin string, category string"
EDGES = "seq bigint, src string, dst string, kind string, details string, line_number int"


@pytest.fixture(scope="module")
def graphs(spark, tmp_path_factory):
    rng = random.Random(4)
    ids = [f"n{i}" for i in range(60)]
    nodes = spark.createDataFrame([(i, x, x.upper(), "ns", "UserProject", "Class") for i, x in enumerate(ids)], NODES)
    end = lambda: "n0" if rng.random() < 0.35 else rng.choice([*ids, "N7", "ghost"])  # noqa: E731  a hot node
    raw = spark.createDataFrame([(i, end(), end(), rng.choice(["A", "Engine_B"]), rng.choice("xyX"), i) for i in range(900)], EDGES)
    graph = PropertyGraph(nodes, first_edges(raw), raw)
    path = str(tmp_path_factory.mktemp("adjacency"))
    return graph, store_graph(graph, path, buckets=8), path


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def test_stored_graph_answers_as_the_tables_do(graphs):
    graph, stored, _ = graphs
    for ask in (metrics.degrees, metrics.isolated, metrics.totals, metrics.total_degrees, lambda g: g.named_edges(), lambda g: g.neighbours("N0"), lambda g: g.node("N3"),
                lambda g: views.explain(g, "N0"), lambda g: views.explain(g, "ghost", "in"), lambda g: g.outgoing("nobody"),
                lambda g: views.induced_edges(g, g.nodes.where("seq < 20")), lambda g: views.induced_edges(g, g.nodes.where("seq < 20"), few=True)):
        assert rows(ask(stored)) == rows(ask(graph))


def test_graph_written_by_another_application(graphs, spark):
    graph, _, path = graphs
    again = open_graph(spark, path, buckets=8)
    assert rows(metrics.degrees(again)) == rows(metrics.degrees(graph))
    assert buckets_read(again.outgoing("n0")) == [1]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def buckets_read(df):
    """How many buckets each scan of a plan reads."""
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return [leaves.apply(i).optionalBucketSet().get().cardinality() for i in range(leaves.length())]


def exchanged(df):
    """Exchanges by key, without broadcasts of few rows."""
    return re.findall(r"Exchange hashpartitioning\(([^)]*)", plan(df))


def test_edges_stay_where_they_are(graphs, spark):
    _, stored, _ = graphs
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert exchanged(metrics.degrees(stored)) == [] and exchanged(metrics.isolated(stored)) == []
        assert exchanged(stored.named_edges()) == []
        assert exchanged(views.induced_edges(stored, views.view_nodes(stored), few=True)) == []
        assert len([x for x in exchanged(views.induced_edges(stored, stored.nodes)) if "dst_key" in x]) == 1  # edges with one end found
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert exchanged(views.explain(stored, "n0")) == []
    assert buckets_read(views.explain(stored, "n0", "in_out")) == [1, 1]


def test_headline_queries_read_the_stored_graph(spark):
    sf = "/root/testdata/sf0.001"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("degree_in_out", "top_hubs", "total_degrees", "induced_edges", "explain_out", "explain_in", "explain_all"):
            df = registry.QUERIES[name](spark, sf)
            assert not any("src" in x or "dst" in x for x in exchanged(df)), name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hot_bucket_is_split(spark, tmp_path):
    edges = spark.range(200_000).select(F.col("id").alias("seq"), F.lit("hub").alias("src"), F.concat(F.lit("n"), "id").alias("dst"), F.lit("k").alias("kind"),
                                        F.sha2(F.col("id").cast("string"), 256).alias("details"), F.lit(0).alias("line_number"))
    nodes = spark.createDataFrame([(0, "hub", "hub", "", "", "")], NODES)
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2m")
    try:
        stored = store_graph(PropertyGraph(nodes, edges), str(tmp_path), buckets=4)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    assert len(list((tmp_path / "out").glob("part-*.parquet"))) > 1
    assert stored.with_degrees().first().out_degree == 200_000


def test_stored_again_when_a_table_changes(spark, tmp_path):
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    before = metrics.totals(star.stored_star(spark, str(tmp_path))).first()
    spark.read.parquet("/root/testdata/sf0.001/part.parquet").limit(10).write.mode("append").parquet(str(tmp_path / "part.parquet"))
    after = metrics.totals(star.stored_star(spark, str(tmp_path))).first()
    assert after.node_count == before.node_count + 10 and after.edge_count == before.edge_count
