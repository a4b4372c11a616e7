import math
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.functions import names
from graphloom.operators import extract, generics, lookup, metrics, paths, spatial, tokens, vector
from graphloom.operators.model import PropertyGraph, first_edges, strict_edges, upsert_nodes
from graphloom.operators.strong import ordered_search
from graphloom.sources import files
from graphloom.sources.files import ignored

NODES = "seq bigint, id string, name string, namespace string, origin string, category string"
EDGES = "seq bigint, src string, dst string, kind string, details string, line_number int"


def graph(spark, nodes, edges):
    n = spark.createDataFrame([(i, x, x, "ns", "UserProject", "Class") for i, x in enumerate(nodes)], NODES)
    return PropertyGraph(n, spark.createDataFrame([(i, a, b, "References", "", 0) for i, (a, b) in enumerate(edges)], EDGES))


def steps(df):
    return [(r.src, r.dst) for r in df.orderBy("step").collect()]


def test_path_takes_the_first_discoverer(spark):
    g = graph(spark, "ABCD", ["AB", "AC", "BD", "CD"])
    assert steps(paths.shortest_path(g, "a", "D")) == [("A", "B"), ("B", "D")]


def test_path_direction_self_and_dangling(spark):
    g = graph(spark, "AB", ["AB", "Ax", "Bx"])
    assert steps(paths.shortest_path(g, "B", "A")) == []
    assert steps(paths.shortest_path(g, "B", "A", undirected=True)) == [("A", "B")]
    assert steps(paths.shortest_path(g, "A", "A")) == []
    h = graph(spark, "AB", ["Ax", "Bx"])
    assert len(steps(paths.shortest_path(h, "A", "B", undirected=True))) == 2
    assert steps(paths.shortest_path(h, "A", "B", undirected=True, known_only=True)) == []


def test_cycles(spark):
    g = graph(spark, "ABCD", ["AB", "BC", "CA", "CD", "DC"])
    assert {r.cycle_key for r in paths.detect_cycles(g).collect()} == {"A -> B -> C -> A", "C -> D -> C"}
    g = graph(spark, "ABCD", ["AB", "AC", "BD", "CD", "DA"])
    assert [r.cycle_key for r in paths.detect_cycles(g).collect()] == ["A -> B -> D -> A"]
    assert ordered_search(["_x", "B"], {"_x": [(0, "B")], "B": [(1, "_x")]})[0] == [("B", "_x", "B")]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), max_size=20))
def test_cycles_are_closed_walks(edges):
    out: dict = {}
    for i, (a, b) in enumerate(edges):
        out.setdefault(str(a), []).append((i, str(b)))
    for c in ordered_search([str(i) for i in range(7)], out)[0]:
        assert c[0] == c[-1] == min(c) and all(b in [x for _, x in out[a]] for a, b in zip(c, c[1:], strict=False))


def test_edge_policies(spark):
    rows = [(0, "A", "B", "t", "d", 1), (1, "A", "B", "t", "d", 2), (2, "a", "B", "t", "d", 3), (3, "A", "A", "t", "d", 4)]
    e = spark.createDataFrame(rows, EDGES)
    assert strict_edges(e).count() == 2
    assert {(r.src, r.dst, r.line_number) for r in first_edges(e).collect()} == {("A", "B", 1), ("A", "A", 4)}
    n = spark.createDataFrame([(0, "a", "x", "", "", ""), (1, "b", "y", "", "", ""), (2, "A", "z", "", "", "")], NODES)
    assert sorted((r.seq, r.name) for r in upsert_nodes(n).collect()) == [(0, "z"), (1, "y")]


def test_degrees_ignore_dangling_ends_and_ties_keep_order(spark):
    g = graph(spark, "yxz", ["yx", "zx", "xy", "zy", "yz", ("y", "ghost")])
    assert [r.id for r in metrics.top_by(g, "in_degree", 2).collect()] == ["y", "x"]
    assert metrics.totals(g).first() == (3, 6)
    assert metrics.isolated(graph(spark, "AB", ["Aq"])).first().id == "B"


def test_signatures():
    assert names.parse_type("")[0][1:3] == ("System.Void", "void")
    sig = names.parse_type("System.Collections.Generic.List`1<Sandbox.Component>")
    assert [x[1] for x in sig] == ["System.Collections.Generic.List", "Sandbox.Component"]
    assert names.parse_type("Sandbox.Component[]")[0][1] == "Sandbox.Component"
    assert names.parse_type("System.Int32&")[0][3] and names.parse_type("System.Byte*")[0][4]
    assert [x[1] for x in names.parse_type("Dictionary<System.String,List<Foo>>")] == ["Dictionary", "System.String", "List", "Foo"]


def test_unique_ids(spark):
    want = {"Sandbox.Foo+Bar": "Sandbox.Foo.Bar", "Sandbox.A_B": "Sandbox.A.B", "My_Type": "My_Type", "L`1": "L", "A<B, C>": "A_B_C_", "X`10": "X0", "": "void"}
    df = spark.createDataFrame([(k,) for k in want], "n string")
    assert {r.n: r.u for r in df.select("n", names.unique_id(F.col("n")).alias("u")).collect()} == want


def test_threshold_follows_top_k(spark):
    df = spark.createDataFrame([(i, [s]) for i, s in enumerate((0.9, 0.5, 0.4))], "id int, embedding array<float>")
    assert vector.top_k(df, [1.0], 2, 0.45).count() == 2 and vector.top_k(df, [1.0], 2, 0.6).count() == 1


def test_layout_and_hits(spark):
    df = spark.range(2).select(F.col("id").alias("idx"))
    x, y = spatial.spiral(F.col("idx"))
    rows = df.select("idx", F.round(x, 4).alias("x"), F.round(y, 4).alias("y")).orderBy("idx").collect()
    assert rows[0][1:] == (35.0, 0.0) and math.isclose(rows[1].x, -36.4979, abs_tol=1e-3)
    p = spark.createDataFrame([(5.0, 1.0)], "x double, y double")
    assert p.where(spatial.near_segment(0, 0, 10, 0, 1)).count() == 1
    assert spark.range(1).select(spatial.cell(F.lit(130.0)).alias("a"), spatial.cell(F.lit(-10.0)).alias("b")).first() == (65, 63)


def test_razor_and_csharp(spark):
    ui = spark.createDataFrame([(0, "u.Button", "Button", "", "", "UiPanel"), (1, "u.Menu", "Menu", "", "", "UiPanel")], NODES)
    src = spark.createDataFrame([("x/Menu.razor", "<Menu/><Button a><button><Button/>")], "path string, text string")
    assert [tuple(r) for r in extract.razor_edges(src, ui).collect()] == [("Menu", "u.Button", "RazorMarkupTag", "Markup tag <Button />")]
    assert extract.razor_to_csharp("<p/>", "A") is None
    code = 'class A : B, IC {\n // new X()\n void F() { var s = "new Y()"; new Z(); Bus.Instance.Go(); x.E += f; } }'
    got = {(r.dst, r.kind) for r in tokens.csharp_edges(spark.createDataFrame([("a.cs", code)], "path string, text string")).collect()}
    assert {("B", "Inherits"), ("IC", "Implements"), ("Z", "Instantiates"), ("Bus", "SingletonAccess"), ("x", "EventSubscription")} <= got
    assert not any(re.match("[XY]$", d) for d, _ in got)


def test_ignore_rules(spark):
    df = spark.createDataFrame([(x,) for x in ("a/Tests/x.cs", "b/ui.designer.cs", "c/tmp.cs", "a/Test.cs", "bin/a.cs")], "path string")
    assert [r.path for r in df.where(~ignored(F.col("path"), ["Tests/", "*.designer.cs", "tmp.cs"])).collect()] == ["a/Test.cs"]


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


def test_names_of_types_and_previews(spark):
    assert one(spark, names.display_type, "System.Collections.Generic.List`1<System.Int32>") == "List<int>"
    assert one(spark, names.display_type, "System.Span<System.Byte>") == "byte[]" and one(spark, names.display_type, "A.B[]") == "B[]"
    assert one(spark, names.type_link, "A.Map<System.String,A.B>") == "[[A.Map]]<string, [[A.B]]>"
    preview = "CLASS: X. Namespace: My.Code. Source file: X.cs."
    assert one(spark, names.preview_namespace, preview) == "My" and one(spark, names.preview_file, preview) == "X.cs"
    assert one(spark, names.score_text, 0.8766, "double") == "87.7%" and one(spark, names.score_colour, 0.9, "double") == "green"


MEMBERS = "type_key string, type_name string, type_seq int, seq int, member_kind string, name string, doc_id string, member_type string, params array<string>, is_public boolean, summary string"


def test_generic_parameters(spark):
    rows = [
        ("A.BOX", "A.Box", 0, 0, "property", "Item", "P:A.Box.Item", "T", None, True, None),
        ("A.BOX", "A.Box", 0, 1, "method", "Map", "M:A.Box.Map", "List<TOut>", ["T", "A.Tree"], True, "Maps."),
        ("A.BOX", "A.Box", 0, 2, "method", "Map", "M:A.Box.Map2", "void", ["T", "A.Tree"], False, None),
    ]
    members = spark.createDataFrame(rows, MEMBERS)
    types = spark.createDataFrame([(0, "A.Box", "Box", "A", False, None), (1, "A.Tree", "Tree", "", False, "A tree.")], "seq int, full_name string, name string, namespace string, is_enum boolean, summary string")
    of_class = generics.class_parameters(members, types)
    assert [tuple(r) for r in of_class.collect()] == [("A.BOX", ["T", "TOut"])]
    assert generics.method_parameters(members, types, of_class.select("type_key", F.array(F.lit("T")).alias("generics"))).where("size(generics) > 0").first().generics == ["TOut"]
    arity = generics.arities(types, of_class)
    assert {r.full_name: r.arity for r in arity.collect()} == {"A.Box": 2, "A.Tree": 0}
    assert {r.namespace for r in generics.by_namespace(types.join(arity, "full_name")).collect()} == {"A", "Sandbox"}
    assert sorted(r.seq for r in generics.first_overloads(members).collect()) == [0, 1]
    texts = {r.id: r.text for r in lookup.api_chunks(types, members).collect()}
    assert texts["P:A.Box.Item"] == "PROPERTY in A.Box: Item (T). Summary: No description." and texts["C:A.Tree"] == "CLASS: A.Tree. Summary: A tree."
    assert "M:A.Box.Map2" not in texts
    hits = spark.createDataFrame([("M:A.Box.Map2", "A.Box.Map"), ("?", "A.Box.Item"), ("?", "A.None")], "id string, fqn string")
    assert {(r.fqn, r.doc_id) for r in lookup.with_members(hits, members).collect()} == {("A.Box.Map", "M:A.Box.Map2"), ("A.Box.Item", "P:A.Box.Item"), ("A.None", None)}
    nodes = spark.createDataFrame([("a.tree",), ("x",)], "id string")
    assert {(r.id, r.full_name) for r in lookup.with_types(nodes, types).collect()} == {("a.tree", "A.Tree"), ("x", None)}
    assert lookup.global_aliases(members.withColumn("type_name", F.lit("GlobalState"))).first() == ("Item", "T")


def test_lookup_tiers_nesting_and_messages(spark):
    df = spark.createDataFrame([(0, "Vertex.Colors"), (1, "A.Color"), (2, "B.Color")], "seq int, name string")
    assert lookup.first_match(df, "name", " color ").first().seq == 1 and lookup.first_match(df, "name", "none").count() == 0
    shown, more = lookup.limited(df, 2)
    assert shown.count() == 2 and more == 1
    nested = spark.createDataFrame([("a", "A", None), ("b", "B", "A"), ("c", "C", "b")], "id string, name string, parent string")
    assert {r.id: r.flat_name for r in generics.flattened_names(nested).collect()} == {"a": "A", "b": "A_B", "c": "A_B_C"}
    assert generics.message_counts(df.select("seq", F.lit("m").alias("message"))).first() == ("m", 3, 0)


def test_file_listing_and_index_dir(spark, tmp_path):
    (tmp_path / "vec").mkdir()
    (tmp_path / "vec" / "graph.json").write_text("{}")
    (tmp_path / "a.cs").write_bytes(b"x\n\xff")
    (tmp_path / "b.dat").write_bytes(b"\x00\n")
    got = {r.path: (r.bytes, r.lines, r.is_binary) for r in files.file_listing(spark, str(tmp_path), ["vec/"]).collect()}
    assert got == {"a.cs": (3, 2, False), "b.dat": (2, None, True)}
    assert files.index_dir(spark, str(tmp_path)) == f"{tmp_path}/vec" and files.index_dir(spark, str(tmp_path / "none")) == f"{tmp_path}/none"
    src = spark.createDataFrame([("b/Foo.cs",), ("a/foo.razor",), ("a/Food.cs",)], "path string")
    assert files.source_of(src, "Foo").first().path == "a/foo.razor"


def test_closure_by_doubling(spark):
    names = "ABCD"
    ring = [(i, a, b, "Inherits", "", 0) for i, (a, b) in enumerate((a, b) for a in names for b in names if a != b)]
    e = spark.createDataFrame([*ring, (90, "x", "a", "Inherits", "", 0), (91, "x", "A", "Inherits", "", 0), (92, "x", "B", "Calls", "", 0)], EDGES)
    at = {**{(a, b): int(a != b) for a in names for b in names}, ("X", "A"): 2}  # repeated edges are walks of their own
    level, want = dict(at), {(a, b, 1): n for (a, b), n in at.items() if n}
    for depth in range(2, 26):
        step: dict = {}
        for (a, b), n in level.items():
            for (c, d), m in at.items():
                if b == c and n * m:
                    step[a, d] = step.get((a, d), 0) + n * m
        level = step
        want |= {(a, b, depth): n for (a, b), n in level.items() if n}
    got = {(r.id, r.ancestor, r.depth): int(r.walks) for r in paths.ancestor_walks(e).collect()}
    assert got == want
    total = {r.ancestor: r.descendants for r in paths.descendant_counts(e).collect()}
    assert total == {b: sum(n for (_, x, _), n in want.items() if x == b) for b in names}
    assert {r.depth for r in paths.ancestors(e, 3).collect()} == {1, 2, 3} and paths.ancestors(e, 1).count() == 13
    assert paths.ancestors(e.where("kind = 'None'")).collect() == []


def test_closure_of_a_chain_takes_five_joins(spark):
    e = spark.createDataFrame([(i, f"t{i}", f"t{i + 1}", "Inherits", "", 0) for i in range(40)], EDGES)
    got = {(r.id, r.ancestor, r.depth) for r in paths.ancestors(e).collect()}
    assert got == {(f"T{i}", f"T{i + d}", d) for i in range(40) for d in range(1, 26) if i + d <= 40}
