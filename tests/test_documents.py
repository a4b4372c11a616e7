import json

import pytest
from pyspark.sql import functions as F

from graphloom.functions import names, style
from graphloom.operators import extract, metrics, paths, views
from graphloom.operators.model import PropertyGraph
from graphloom.sinks import render
from graphloom.sources import files

NODES = "seq bigint, id string, name string, namespace string, origin string, category string"
EDGES = "seq bigint, src string, dst string, kind string, details string, line_number int"

API = {"Types": [
    {"FullName": "Sandbox.Box", "Name": "Box", "BaseType": "Sandbox.Thing", "Documentation": {"Summary": "A | box.\nIt holds."},
     "Properties": [{"Name": "Lid", "PropertyType": "Sandbox.Lid", "IsPublic": True}, {"Name": "Hue", "PropertyType": "Sandbox.Hue", "IsPublic": True}],
     "Fields": [{"Name": "n", "FieldType": "System.Int32", "IsPublic": False}],
     "Methods": [{"Name": "Put", "ReturnType": "System.Void", "IsPublic": True, "IsStatic": True, "Parameters": [{"Name": "x", "ParameterType": "List<Sandbox.Lid>"}, {"Name": "y"}]}]},
    {"FullName": "sandbox.box", "Name": "Box2", "Properties": [{"Name": "Lid", "PropertyType": "Other", "IsPublic": True}, {"Name": "More", "PropertyType": "Lid", "IsPublic": True}]},
    {"FullName": "Sandbox.Lid", "Name": "Lid", "BaseType": "Box"}, {"FullName": "Sandbox.Thing", "Name": "Thing"},
    {"FullName": "Sandbox.Hue", "Name": "Hue", "IsEnum": True, "BaseType": "System.Enum"},
    {"FullName": "Sandbox.Box+Key", "Name": "Key", "DeclaringType": "Sandbox.Box", "BaseType": "System.ValueType"}, {"FullName": "Sandbox.EditAttribute", "Name": "EditAttribute", "IsInterface": None},
]}


@pytest.fixture(scope="module")
def api(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("api") / "api.json"
    path.write_text(json.dumps(API))
    document = files.api_document(spark, str(path))
    return extract.api_types(document), extract.api_members(document)


def test_api_document(api):
    types, members = api
    t = {r.full_name: r for r in types.collect()}
    assert "sandbox.box" not in t and t["Sandbox.Box"].namespace == "Sandbox" and t["Sandbox.Box+Key"].is_nested and t["Sandbox.Box+Key"].is_value_type
    assert t["Sandbox.Hue"].is_enum and t["Sandbox.Hue"].is_value_type and t["Sandbox.EditAttribute"].is_attribute and not t["Sandbox.Box"].is_attribute
    m = {(r.member_kind, r.name): r for r in members.where("type_key = 'SANDBOX.BOX'").collect()}
    assert m["property", "Lid"].member_type == "Sandbox.Lid" and m["property", "More"].member_type == "Lid"  # merged; the first of a document id stays
    assert m["method", "Put"].doc_id == "M:Sandbox.Box.Put(List<Sandbox.Lid>,object)" and m["method", "Put"].is_static and not m["field", "n"].is_public


def test_api_edges(api):
    got = {(r.src, r.dst, r.kind, r.details) for r in extract.api_edges(*api).collect()}
    assert ("Sandbox.Box", "Sandbox.Lid", "References", "Property: Lid") in got and ("Sandbox.Box", "Sandbox.Lid", "References", "Method Param: Put") in got
    assert ("Sandbox.Lid", "Sandbox.Box", "Inherits", "Base Class") in got and ("Sandbox.Box", "Sandbox.Thing", "Inherits", "Base Class") in got
    assert not any(d == "Sandbox.Hue" for _, d, *_ in got)  # a value type
    assert {(r.src, r.dst) for r in paths.base_edges(api[0]).collect()} >= {("Sandbox.Lid", "Sandbox.Box"), ("Sandbox.Box", "Sandbox.Thing")}


def test_catalogs_and_filters(api, spark):
    types, _ = api
    assert [r.full_name for r in render.type_catalog(types, "is_enum").collect()] == ["Sandbox.Hue"]
    assert [r.full_name for r in render.type_catalog(types, "is_attribute").collect()] == ["Sandbox.EditAttribute"]
    assert types.where("name = 'Box'").select(names.table_summary(F.col("summary"))).first()[0] == "A &#124; box. It holds."
    assert spark.range(1).select(names.short_name(F.lit("A.B.C`1")), names.namespace(F.lit("A.B.C")), names.namespace(F.lit("C")), names.doc_id("P", F.lit("A"), F.lit("b")), names.table_summary(F.lit(None))).first() == ("C", "A.B", "Sandbox", "P:A.b", "-")
    below = lambda *x: F.array(*map(F.lit, x))
    no = F.lit(False)
    kinds = spark.range(1).select(names.category_of(F.lit(True), F.lit(True), no, below("")), names.category_of(no, no, no, below("Component", "PanelComponent")), names.category_of(no, no, no, below("Panel")), names.category_of(no, no, no, below("x")))
    assert kinds.first() == ("Interface", "UiPanelComponent", "UiPanel", "Class")
    look = spark.range(1).select(style.category_style(F.lit("Interface"))["shape"], style.relation_style(F.lit("no such"))["line"]).first()
    assert look[0] is not None and look[1] == style.RELATION_OTHER[5]


def graph(spark):
    nodes = [(0, "A", "A", "n", "UserProject", "SceneComponent"), (1, "B", "B", "", "UserProject", "UiPanel"), (2, "C", "C", "n", "SystemPrimitive", "Class"), (3, "D", "Deer", "n", "EngineRuntime", "Class")]
    edges = [(0, "A", "B", "Calls", "f", 1), (1, "b", "A", "References", "g", 2), (2, "A", "X.Y", "Engine_Calls", "h", 3)]
    return PropertyGraph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES))


def test_notes_canvas_and_lines(spark):
    g = graph(spark)
    note = {r.id: r.note for r in render.notes(g).collect()}
    assert "## Out\n- [[B]] (Calls: f)\n" in note["A"] and "## In\n- [[b]] (References: g)\n" in note["A"] and "## Engine API Dependencies\n- [[X.Y]] (Engine_Calls: h)" in note["A"]
    assert note["D"].count("*None*") == 3 and render.section(note["A"], "in").splitlines() == ["## In", "- [[b]] (References: g)"]
    nodes, edges = render.canvas(g)
    at = {x["id"]: (x["x"], x["y"]) for x in (json.loads(r.value) for r in nodes.collect())}
    assert at == {"A": (0, 0), "B": (650, 0), "C": (0, 400), "D": (650, 400)}
    assert {(x["id"], x["label"]) for x in (json.loads(r.value) for r in edges.collect())} == {("edge_0", "Calls: f"), ("edge_1", "References: g"), ("edge_2", "Engine_Calls: h")}
    rows = [json.loads(r.value) for r in render.json_lines(g).collect()]
    assert sum(r["row"] == "node" for r in rows) == 4 and {r["type"] for r in rows if r["row"] == "link"} == {"Calls", "References", "Engine_Calls"}


def test_tables_round_trip(spark, tmp_path):
    g = graph(spark)
    render.write_tables(g, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/nodes").count() == 4 and spark.read.parquet(f"{tmp_path}/edges").count() == 3


def test_text_of_a_path(spark):
    g = graph(spark)
    steps = paths.shortest_path(g, "B", "A", undirected=True)
    assert render.path_text("B", steps) == "1. b ──[References]──> A"
    back = PropertyGraph(g.nodes, g.edges.where("kind = 'Calls'"))
    assert render.path_text("B", paths.shortest_path(back, "B", "A", undirected=True)) == "1. B <──[Calls]── A"


def test_views(spark):
    g = graph(spark)
    ids = lambda **k: [r.id for r in views.view_nodes(g, **k).orderBy("seq").collect()]
    assert ids() == ["A", "B", "D"] and ids(user_code_only=True) == ["A", "B"] and ids(components_only=True) == ["A"] and ids(razor_only=True) == ["B"]
    assert ids(include_system_primitives=True, max_nodes=3) == ["A", "B", "C"] and ids(search_query="deer") == ["D"]
    with pytest.raises(ValueError):
        views.view_nodes(g, components_only=True, razor_only=True)
    assert {(r.section, r.kind) for r in views.explain(g, "a", "engine").collect()} == {("engine", "Calls")} and views.explain(g, "a", "in_out").count() == 2
    assert {r.id for r in metrics.isolated(g).collect()} == {"C", "D"} and metrics.origin_counts(g).first() == (1, 0, 2, 1)
    assert set(metrics.metrics_report(g)) == {"totals", "hubs", "god_nodes", "isolated"}
    assert [r.category for r in metrics.counts_by(g.nodes, "category").collect()] == ["Class", "SceneComponent", "UiPanel"]
