import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom import api
from graphloom.functions import names
from graphloom.operators import csharp, extract, metrics, paths, spatial, tokens, vector, views
from graphloom.operators.model import PropertyGraph, dense_index, first_edges
from graphloom.plans import registry
from graphloom.sinks import render
from graphloom.sources import files

NODES = "seq bigint, id string, name string, namespace string, origin string, category string"
EDGES = "seq bigint, src string, dst string, kind string, details string, line_number int"

CODE = """using Parts; // using Nothing;
namespace Shop
{
    /* class Ghost { } */
    public partial class Till : Desk, IOpen
    {
        private Dictionary<string, List<Coin>> coins = new();
        public Coin[] Loose { get; private set; } = new Coin[3];
        public static Till Instance => _one;
        int a = 1, b;
        [Attr] public T Make<T>( Lamp lamp, int n = 2 ) where T : Thing
        {
            var c = new Coin();
            c.Flip( lamp );
            Texture.Create( 1 ).WithSize( 2 ).Finish();
            Log.Info( "new Ghost()" );
            Feed.Sold += OnSold;
            n += 2;
            return Bank.Instance.Take( lamp.Bulb, Screen.Width );
        }
    }
    class Drawer { Till owner; void F() { Bank.Instance.Open(); } }
}
"""
OTHERS = [("Bank.cs", "namespace Money { public class Bank { public static Bank Instance; public int Vault; } }"),
          ("Parts.cs", "namespace Parts { class Coin { public int Value; } struct Lamp { public Bulb Bulb { get; set; } } class Bulb { } class Desk { } }")]


def sources(spark):
    return spark.createDataFrame([("src/Till.cs", CODE), *OTHERS], "path string, text string")


def test_dependencies_of_the_first_reading(spark):
    types = spark.createDataFrame([(0, "Sandbox.Texture", "Texture"), (1, "Screen", "Screen")], "seq bigint, full_name string, name string")
    engine = csharp.engine_types(types, spark.createDataFrame([("Log", "Sandbox.Diagnostics.Logger")], "alias string, target string"))
    uses = csharp.source_uses(sources(spark))
    got = {(r.src, r.dst, r.kind, r.details) for r in csharp.dependency_edges(uses, engine).collect()}
    assert got == {
        ("Till", "Desk", "Inherits", "Base Class"),
        ("Till", "Coin", "References", "Field 'coins' (holds 'Dictionary<string, List<Coin>>')"),
        ("Till", "Coin", "References", "Has property 'Loose' (type: Coin[])"), ("Till", "Lamp", "References", "Parameter 'lamp'"),
        ("Till", "Coin", "Instantiates", "new Coin()"), ("Till", "Coin", "Instantiates", "new Dictionary()"), ("Till", "Coin", "Calls", "Method 'Flip()'"),
        ("Till", "Sandbox.Texture", "Engine_Calls", "Method 'Create()'"), ("Till", "Sandbox.Texture", "Engine_Calls", "Method 'WithSize()'"), ("Till", "Sandbox.Texture", "Engine_Calls", "Method 'Finish()'"),
        ("Till", "Sandbox.Diagnostics.Logger", "Engine_Calls", "Method 'Info()'"), ("Till", "Sandbox.Screen", "Engine_References", "Property 'Width'"),
        ("Till", "Bank", "CallsSingleton", "Method 'Take()' (Fuzzy)"), ("Till", "Lamp", "References", "Property 'Bulb'"),
        ("Drawer", "Till", "References", "Field 'owner' (holds 'Till')"), ("Drawer", "Bank", "CallsSingleton", "Method 'Open()' (Fuzzy)"), ("Lamp", "Bulb", "References", "Has property 'Bulb' (type: Bulb)"),
        ("Bank", "Bank", "", ""),
    } - {("Bank", "Bank", "", "")}
    assert {r.name for r in csharp.declared_classes(uses).collect()} == {"Till", "Drawer", "Bank", "Coin", "Lamp", "Bulb", "Desk"}


def test_engine_edges_of_receivers_go_out_from_the_main_class_too(spark):
    src = spark.createDataFrame([("Main.cs", "class Main { } class Helper { Texture t; void F() { Log.Info( 1 ); } }")], "path string, text string")
    types = spark.createDataFrame([(0, "Sandbox.Texture", "Texture"), (1, "Log", "Log")], "seq bigint, full_name string, name string")
    engine = csharp.engine_types(types, spark.createDataFrame([], "alias string, target string"))
    for links, want in ((True, 3), (False, 2)):
        got = {(r.src, r.dst, r.kind) for r in csharp.dependency_edges(csharp.source_uses(src), engine, links).collect()}
        assert len(got) == want and {("Main", "Sandbox.Log", "Engine_Calls"), ("Helper", "Sandbox.Log", "Engine_Calls")} <= got


def test_second_reading_and_rebuild(spark):
    got = {(r.src, r.dst, r.kind, r.details, r.line_number) for r in tokens.csharp_edges(sources(spark).where("path like '%Till%'")).collect()}
    assert ("Till", "Feed", "EventSubscription", "Event 'Sold' +=", 17) in got and ("Till", "IOpen", "Implements", "Interface", 5) in got
    assert ("Till", "Bank", "SingletonAccess", ".Instance", 19) in got and not any("Ghost" in x for x in map(str, got))
    assert {r.name for r in tokens.declared_types(sources(spark)).collect()} >= {"Till", "Drawer", "Bank"}
    catalogue = PropertyGraph(spark.createDataFrame([(0, "Parts.Coin", "Coin", "Parts", "EngineRuntime", "Class"), (1, "Ui.Menu", "Menu", "Ui", "EngineRuntime", "UiPanel")], NODES), spark.createDataFrame([], EDGES))
    more = spark.createDataFrame([("ui/Shelf.razor", "<Menu/>\n@code { }")], "path string, text string")
    graph = extract.rebuild(catalogue, sources(spark).unionByName(more))
    assert {(r.src, r.dst) for r in graph.edges.where("kind in ('Instantiates', 'RazorMarkupTag')").collect()} >= {("Till", "Parts.Coin"), ("Shelf", "Ui.Menu")}
    assert {r.id for r in graph.nodes.where("origin = 'UserProject'").collect()} >= {"Till", "Bank"}


def test_large_file_in_time(spark):
    code = "class Big {\n" + "void F() { var x = new Item(); { x.Go(); } }\n" * 20_000 + "}"
    assert tokens.csharp_edges(spark.createDataFrame([("a.cs", code)], "path string, text string")).agg(F.max("line_number")).first()[0] == 20_001


def test_catalogue_edges_and_methods(spark):
    types = spark.createDataFrame([("A.Box`1", "System.Object", 0), ("A.Lid", "A.Box`1", 1)], "full_name string, base_type string, seq int")
    props = spark.createDataFrame([("A.Lid", "All", "Map<System.String,List<A.Box[]>>", 0), ("A.Lid", "Me", "A.Lid", 1)], "full_name string, name string, member_type string, seq int")
    faces = spark.createDataFrame([("A.Lid", "IOpen", 0)], "full_name string, interface string, seq int")
    got = {(r.src, r.dst, r.kind) for r in extract.type_edges(types, props, faces).collect()}
    assert got == {("A.Lid", "System.String", "PropertyReference"), ("A.Lid", "A.Box", "PropertyReference"), ("A.Lid", "A.Box", "Inherits"), ("A.Lid", "IOpen", "Implements")}
    methods = spark.createDataFrame([("A.Lid", 1, "Shut", None, None, False), ("A.Lid", 0, "Open", "bool", "Opens.", True)], "full_name string, seq int, name string, member_type string, summary string, is_static boolean")
    assert [tuple(m) for m in extract.type_methods(methods).first().methods] == [("Open", "bool", "Opens.", True), ("Shut", "void", "", False)]
    base = paths.base_edges(types.withColumn("name", F.substring_index("full_name", ".", -1)).unionByName(spark.createDataFrame([("B.Cap", "Lid", 2, "Cap")], "full_name string, base_type string, seq int, name string")))
    assert {(r.src, r.dst) for r in base.collect()} >= {("B.Cap", "A.Lid")} and {r.id for r in paths.derivatives(base, "a.box`1").collect()} == {"A.LID", "B.CAP"}


def test_names_and_filters(spark):
    df = spark.createDataFrame([("Facade.dll",), ("Sandbox.Engine",), ("Editor.Tools",), ("mscorlib",), ("Systematic",)], "a string")
    assert [r[0] for r in df.select(names.origin_of(F.col("a"))).collect()] == ["UserProject", "EngineRuntime", "EngineEditor", "SystemPrimitive", "UserProject"]
    assert spark.range(1).select(names.sanitised_namespace(F.lit("a.1b.class")), names.sanitised_member(F.lit("I.Foo-x")), names.sanitised_namespace(F.lit(None))).first() == ("a._1b.@class", "Foo_x", "")
    rows = spark.createDataFrame([("", "", False), ("list", "Own", False), ("X", "System.IO", False), ("V", "Sandbox", True), ("V", "Own", True), ("C", "Sandbox.UI", False), ("C", "Own", False)], "n string, ns string, v boolean")
    assert [r[0] for r in rows.select(names.is_blacklisted(F.col("n"), F.col("ns"), F.col("v"), F.lit(False))).collect()] == [True, True, True, True, False, True, False]
    flags = spark.range(1).select(names.pack_flags(F.lit(3), F.lit(True), F.lit(False), F.lit(True)), names.is_primitive(F.lit("guid"))).first()
    assert flags == (0b1010011, True)
    kinds = spark.createDataFrame([("Enum",), ("field",), ("method",)], "t string")
    assert [[r[0] for r in kinds.select(names.member_type_is(F.col("t"), w)).collect()] for w in ("type", "prop", "all", "Method")] == [[True, False, False], [False, True, False], [True] * 3, [False, False, True]]
    assert spark.createDataFrame([("a(b(c)) Summary: x(y)",)], "p string").select(names.signature_of(F.col("p"))).first()[0] == "b(c)"


def test_scans_and_documents(spark, tmp_path):
    for path, text in {"a/z.cs": "class Z { }", "a/b.razor": "<p/>", "a/c/d.cs": "class D { }", "BIN/x.cs": "x", "Tests/y.cs": "y", "m.cs": "m"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    found = files.source_files(spark, str(tmp_path), files.parse_rules("# note\n\ntests/\n"))
    assert [r.path for r in files.scan_order(found).orderBy("seq").collect()] == ["m.cs", "a/z.cs", "a/b.razor", "a/c/d.cs"]
    assert {r.path for r in files.project_files(spark, str(tmp_path)).collect()} == {"m.cs", "a/z.cs", "a/b.razor", "a/c/d.cs", "Tests/y.cs"}
    assert files.api_document(spark, None, str(tmp_path / "none.json")).count() == 0
    g = PropertyGraph(spark.createDataFrame([(0, "A", "A", "n", "", ""), (1, "B", "B", "", "", "")], NODES).withColumn("file_path", F.lit("x/a.cs")), spark.createDataFrame([(0, "A", "B", "Calls", "d", 0)], EDGES))
    render.write_document(g, str(tmp_path / "out"))
    nodes, edges = files.graph_cache(spark, str(tmp_path / "out"))
    assert [(r.id, r.file_path) for r in nodes.orderBy("seq").collect()] == [("A", "a.cs"), ("B", "a.cs")] and edges.first().kind == "Calls"


def test_razor(spark):
    src = spark.createDataFrame([("u/Menu.razor", "@using A.B\n@inherits Base\n<Card x><card/><menu/>@Maths.Pi @code { int x; { } } <Shelf/>"), ("u/No.razor", "<p/>"), ("a.cs", "class A { }")], "path string, text string")
    classes = spark.createDataFrame([("Card",), ("Maths",), ("Menu",), ("Shelf",)], "name string")
    assert {tuple(r) for r in extract.markup_edges(src, classes).collect()} == {("Menu", "Card", "UI_NestedComponent", "HTML Tag"), ("Menu", "Maths", "Calls", "HTML Expression")}
    code = {r.path: r.text for r in extract.razor_sources(src).collect()}
    assert code.keys() == {"u/Menu.razor", "a.cs"} and code["u/Menu.razor"] == "using A.B;\npublic partial class Menu : Base { int x; { } }"


def test_index_round_trip_and_searches(spark, tmp_path):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(300, 16))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    docs = spark.createDataFrame([(i, f"P:A.T{i}.X", f"A.T{i}.X", "property" if i % 2 else "class", f"text {i}") for i in range(300)], "seq bigint, id string, fqn string, type string, text string")
    encode = lambda texts: [vectors[int(t.rsplit(" ", 1)[1])].tolist() for t in texts]
    assert vector.write_index(docs.where("false"), str(tmp_path), encode) == {"status": "empty"}
    assert vector.write_index(docs, str(tmp_path), encode)["indexed_count"] == 300
    index = vector.load_index(spark, str(tmp_path))
    assert index.agg(F.min("numeric_id"), F.max("numeric_id")).first() == (10_000, 10_299)
    hits = vector.semantic_search(index, " 7 ", encode, 3, -1.0).collect()
    exact = np.argsort(-(vectors @ vectors[7]))[:3]
    assert [h.numeric_id - 10_000 for h in hits] == exact.tolist() and hits[0].namespace == "global" and hits[0].file == "A.T7.X.cs"
    found = [{r.numeric_id for r in vector.approximate_top_k(index, vectors[q].tolist(), 5, -1.0).collect()} for q in range(0, 300, 30)]
    truth = [set((np.argsort(-(vectors @ vectors[q]))[:5] + 10_000).tolist()) for q in range(0, 300, 30)]
    assert sum(len(a & b) for a, b in zip(found, truth, strict=True)) >= 0.95 * 50
    with pytest.raises(FileNotFoundError):
        vector.load_index(spark, str(tmp_path / "none"))


def test_numbers_of_a_large_view(spark):
    df = spark.range(50_000).select((F.col("id") * 7919 % 50_021).alias("seq"), F.col("id").cast("string").alias("a"), F.rand(3).alias("b")).repartition(6)
    for _ in range(2):
        got = dense_index(df).select("seq", "idx").toPandas().sort_values("seq")
        assert got["idx"].tolist() == list(range(50_000))


def view(spark, n, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, float(x), float(y), 0.0, 0.0, 6.0 + i % 3, i % 5, 1.0 + i % 4, i % 7 == 0, i % 11 == 0) for i, (x, y) in enumerate(rng.normal(0, 300, (n, 2)))]
    return rows, spark.createDataFrame(rows, "idx bigint, x double, y double, vx double, vy double, radius double, degree bigint, mass double, pinned boolean, hidden boolean")


def test_physics_against_loops(spark):
    rows, df = view(spark, 60)
    links = [(i, i // 2) for i in range(1, 60)]
    got = {r.idx: r for r in spatial.physics(df, spark.createDataFrame(links, "i bigint, j bigint")).collect()}
    alpha, v = 1 - 0.016, np.zeros((60, 2))
    at = np.array([r[1:3] for r in rows])
    radius, degree, mass, pinned, hidden = (np.array([r[k] for r in rows]) for k in (5, 6, 7, 8, 9))
    for i in range(60):
        for j in range(60):
            d = at[i] - at[j]
            if i != j and not hidden[i] and not hidden[j] and d @ d <= 2500**2:
                soft = max(d @ d, 64 + 4 * (mass[i] + mass[j]))
                v[i] += d / np.sqrt(soft) * (120 * 350 * mass[j] / soft) * alpha * 0.016
    for i, j in links:
        d = at[j] - at[i]
        r = np.linalg.norm(d)
        if hidden[i] or hidden[j] or r < 0.001:
            continue
        c = 0.65 if pinned[i] or pinned[j] else 0.24 / np.sqrt(max(1, 0.15 * max(degree[i], degree[j])))
        f = d / r * (r - 160 - 0.85 * (radius[i] + radius[j])) * c * alpha
        v[i] += f * (0 if pinned[i] else 1.5 if pinned[j] else 0.5)
        v[j] -= f * (0 if pinned[j] else 1.5 if pinned[i] else 0.5)
    cell = np.floor(at / 120)
    for i in range(60):
        for j in range(i + 1, 60):
            d = at[j] - at[i]
            r, want = np.linalg.norm(d), radius[i] + radius[j] + 6
            if not hidden[i] and not hidden[j] and (abs(cell[i] - cell[j]) <= 1).all() and 0.01 < r < want:
                f = d / r * (want - r) * (0.6 if want - r > radius[i] / 2 else 0.35) * alpha / 2
                v[i] -= 0 if pinned[i] else f
                v[j] += 0 if pinned[j] else f
    v = (v - at * 0.35 * 0.002 * alpha) * 0.68
    speed = np.linalg.norm(v, axis=1)
    v *= np.where(pinned | hidden, 0, np.minimum(1, 15 / np.maximum(speed, 1e-9)))[:, None]
    assert all(np.allclose((got[i].x, got[i].y), at[i] + v[i], atol=1e-9) for i in range(60))


def test_tree_is_near_the_exact_repulsion(spark):
    rows, df = view(spark, 400, 5)
    exact = {r.idx: (r.fx, r.fy) for r in spatial.repulsion(df).collect()}
    tree = {r.idx: (r.fx, r.fy) for r in spatial.tree_repulsion(df).collect()}
    assert exact.keys() == tree.keys()
    a, b = (np.array([x[i] for i in sorted(exact)]) for x in (exact, tree))
    fine = {r.idx: (r.fx, r.fy) for r in spatial.tree_repulsion(df, theta=0.25).collect()}
    kernel = spatial.barnes_hut(df.where("not hidden").orderBy("idx").toPandas(), theta=0.25)
    off = lambda x: np.linalg.norm(a - x) / np.linalg.norm(a)
    assert off(np.array([fine[i] for i in sorted(fine)])) < 0.05 and off(kernel) < 0.6 and off(b) < 0.6
    assert {r.idx for r in spatial.tree_repulsion(df, theta=0.0).collect()} == exact.keys()


def test_views_and_rays(spark):
    g = PropertyGraph(spark.createDataFrame([(i, x, x, "n", "", "") for i, x in enumerate("ABCD")], NODES), spark.createDataFrame([(0, "A", "B", "k", "d", 0), (1, "C", "A", "k", "e", 0)], EDGES))
    on = spark.createDataFrame([("A", 10.0, 10.0), ("B", -79.0, 0.0), ("C", -81.0, 0.0), ("D", 5.0, 5.0)], "id string, x double, y double")
    assert {r.id for r in views.shown_labels(on, g, "a", 100, 50).collect()} == {"A", "B"} and views.shown_labels(on, g, None, 100, 50).count() == 0
    kept = views.carry_over(on, spark.createDataFrame([("A", 1.0, 2.0, True)], "id string, x double, y double, pinned boolean")).collect()
    assert {(r.id, r.x, r.pinned) for r in kept} >= {("A", 1.0, True), ("B", -79.0, False)}
    balls = spark.createDataFrame([(0, 0.0, 0.0, 50.0, 6.0), (1, 0.0, 2.0, 20.0, 1.0), (2, 9.0, 0.0, 5.0, 1.0)], "idx int, x double, y double, z double, radius double")
    assert spatial.pick_ray(balls, (0, 0, 100), (0, 0, -1)).first().idx == 0
    text = {(r.section, r.label): r.n for r in metrics.diagnostics(g).collect()}
    assert text["totals", "node_count"] == 4 and text["hubs", "A"] == 1 and text["isolated", "nodes"] == 1 and text["kind", "k"] == 2
    loop = PropertyGraph(g.nodes, spark.createDataFrame([(0, "A", "B", "k", "d", 0), (1, "B", "A", "k", "e", 0)], EDGES))
    hops = paths.cycle_hops(paths.detect_cycles(loop).select("cycle_key"), loop).collect()
    assert [(r.hop, r.src, r.dst, r.label) for r in hops] == [(0, "A", "B", "k: d"), (1, "B", "A", "k: e")]
    pushed = PropertyGraph(g.nodes, first_edges(g.edges), g.edges)
    assert pushed.outgoing("a").count() == 1 and pushed.neighbours("a").count() == 2


def test_long_paths_and_deep_nesting(spark):
    n = 70
    nodes = spark.createDataFrame([(i, f"n{i}", f"n{i}", "", "", "") for i in range(n)], NODES)
    g = PropertyGraph(nodes, spark.createDataFrame([(i, f"n{i}", f"n{i + 1}", "k", "", 0) for i in range(n - 1)], EDGES))
    assert paths.shortest_path(g, "n0", f"n{n - 1}").count() == n - 1


def test_notes(spark):
    types = spark.createDataFrame([(0, "A.Box", "Box", "A", "A.Base", False, False, "Holds.\nAll."), (1, "A.Hue", "Hue", "A", None, True, False, None)], "seq int, full_name string, name string, namespace string, base_type string, is_enum boolean, is_nested boolean, summary string")
    rows = [("A.BOX", 0, 0, "field", "f", "A.Hue", True, False, None, None), ("A.BOX", 0, 1, "field", "hidden", "int", False, False, None, None), ("A.BOX", 0, 0, "method", "Open", "System.Int32", True, True, "Opens | it.", ["A.Hue"]),
            ("A.HUE", 1, 0, "field", "value__", "int", True, False, None, None), ("A.HUE", 1, 1, "field", "Red", "A.Hue", True, False, None, None)]
    members = spark.createDataFrame(rows, "type_key string, type_seq int, seq int, member_kind string, name string, member_type string, is_public boolean, is_static boolean, summary string, params array<string>")
    edges = spark.createDataFrame([(0, "A.Lid", "A.Box", "Inherits", "Base Class", 0)], EDGES)
    note = {r.full_name: r.note for r in render.type_notes(types, members, edges).collect()}
    box, hue = note["A.Box"], note["A.Hue"]
    assert "| [[A.Hue]] | **f** | - |" in box and "hidden" not in box and "| `static int Open(A.Hue)` | Opens &#124; it. |" in box and "> Holds.\n> All." in box
    assert "- [[A.Lid]] ─[Inherits]─> `Base Class`" in box and "## Derivatives" in box and "### Out\n*None*" in box
    assert "## Fields (Values)\n- **Red**\n" in hue and "value__" not in hue and "type: engine_enum" in hue
    shown = spark.createDataFrame([(box,)], "note string").select(render.note_view("note", "methods").alias("m"), render.note_view("note", "summary").alias("s"), render.note_view("note", "properties").alias("p")).first()
    assert shown.m.startswith("## Methods\n| Signature") and shown.s.endswith("---") and shown.p.startswith("## Fields\n")


def call(w, name, **arguments):
    line = json.dumps({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": name, "arguments": arguments}})
    return json.loads(api.handle(w, line, limit=2))["result"]


def test_tools(spark):
    names_ = "ABCD"
    g = PropertyGraph(spark.createDataFrame([(i, x, x, "n", "UserProject", "Class") for i, x in enumerate(names_)], NODES), spark.createDataFrame([(0, "A", "B", "k", "d", 0), (1, "B", "A", "k", "e", 0), (2, "A", "C", "k", "f", 0), (3, "D", "A", "k", "g", 0)], EDGES))
    w = api.Workspace(g, sources=spark.createDataFrame([("x/A.cs", "class A { }")], "path string, text string"), notes=spark.createDataFrame([(0, "Own.Box", "# Box\n\n## Methods\nm\n")], "seq int, id string, note string"))
    got = call(w, "any_user_explain_class", class_name="a", view_mode="in_out", unknown=1)
    assert len(got["content"]) == 2 and got["more"] == 2
    assert [x["dst"] for x in call(w, "user_find_path", from_class="C", to_class="D")["content"]] == ["C", "A"]
    assert call(w, "user_check_cycles")["content"][0]["label"] == "k: d"
    assert call(w, "user_read_source_code", class_name="a")["content"][0]["text"] == "class A { }"
    assert call(w, "engine_explain", class_name="box", view_mode="methods")["content"] == [{"id": "Own.Box", "note": "## Methods\nm"}]
    assert call(w, "user_get_metrics")["more"] > 0
    for bad in ("nothing", "user_semantic_search"):
        assert call(w, bad, query="x").get("isError")
    assert call(w, "user_find_path", from_class="C")["isError"]
    assert {t["name"] for t in api.tool_list("engine")} == {"engine_search_api", "engine_explain", "engine_explain_type"}
    out = []
    api.listen(w, ['{"id": null}', "", '{"id": 2, "method": "nope"}', '{"id": 3, "method": "tools/list"}'], out.append)
    assert [json.loads(x)["id"] for x in out] == [2, 3] and json.loads(out[0])["error"]["code"] == -32601
    types = spark.createDataFrame([(0, "Box", "Own.Box", False, False, False, None)], "seq bigint, name string, full_name string, is_interface boolean, is_enum boolean, is_value_type boolean, summary string")
    members = spark.createDataFrame([(0, 0, "method", "Boxed", "M:Own.Box.Boxed", "OWN.BOX", "void")], "type_seq bigint, seq bigint, member_kind string, name string, doc_id string, type_key string, member_type string").withColumn("params", F.array().cast("array<string>"))
    w.types, w.members = types, members
    assert [x["label"] for x in call(w, "engine_search_api", query="box", search_mode="keyword")["content"]] == ["Own.Box", "M:Own.Box.Boxed"]
    assert [x["label"] for x in call(w, "engine_search_api", query="box", search_mode="keyword", member_type="method")["content"]] == ["M:Own.Box.Boxed"]
    assert [x["label"] for x in call(w, "engine_search_api", query="D", search_mode="keyword")["content"]] == ["M:Own.Box.Boxed"]
    assert [x["label"] for x in call(w, "engine_search_api", query="n", search_mode="keyword", member_type="class")["content"]][0] == "Own.Box"


def test_semantic_command(spark, tmp_path):
    def fake_encoder(texts):
        return [[1.0, 0.0] if "cat" in t else [0.0, 1.0] for t in texts]

    docs = spark.createDataFrame([(0, "C:Cat", "Cat", "class", "CLASS: cat. Namespace: Zoo. Source file: Cat.cs."), (1, "C:Dog", "Dog", "class", "dog")], "seq bigint, id string, fqn string, type string, text string")
    vector.write_index(docs, str(tmp_path / "user_code"), fake_encoder)
    assert tuple(api.command_search(spark, str(tmp_path), "a cat", fake_encoder).first()) == ("100.0%", "Cat", "class", "Zoo", "Cat.cs")
    vector.write_index(docs.where("seq = 1"), str(tmp_path / "engine_api"), fake_encoder)
    assert api.command_search(spark, str(tmp_path), "a cat", fake_encoder).count() == 1


def test_refresh_merges_new_files(spark, tmp_path):
    from graphloom.streaming.reindex import merge_edges, refresh_edges, stored_edges

    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    for rows in ([(i, f"n{i}", f"m{i}", "k", "d", 1) for i in range(200)], [(900, "N5", "m5", "k", "D", 2), (901, "B", "C", "k", "d", 3)]):
        spark.createDataFrame(rows, EDGES).write.mode("append").parquet(source)
        before = {f: f.stat().st_mtime_ns for f in (tmp_path / "out").glob("part=*/*.parquet")}
        refresh_edges(spark, source, target, checkpoint, parts=16).awaitTermination(60)
    kept = {f for f in (tmp_path / "out").glob("part=*/*.parquet") if before.get(f) == f.stat().st_mtime_ns}
    assert len({f.parent for f in before}) > 10 and len({f.parent for f in before} - {f.parent for f in kept}) <= 2  # of all partitions two are new
    got = {(r.seq, r.src, r.dst) for r in stored_edges(spark, target).collect()}
    assert got == {(i, f"n{i}", f"m{i}") for i in range(200)} | {(901, "B", "C")}
    late = spark.createDataFrame([(-1, "N7", "M7", "K", "d", 0), (-1, "n7", "m7", "k", "d", 0)], EDGES)
    for _ in range(2):  # an earlier edge takes its repeat's place, and a replay changes nothing
        assert merge_edges(late, target, 16)
        after = {(r.seq, r.src, r.dst, r.kind) for r in stored_edges(spark, target).collect()}
        assert len(after) == 202 and {(-1, "n7", "m7", "k"), (-1, "N7", "M7", "K")} <= after
    assert merge_edges(late.limit(0), target, 16) == []


def test_slow_encoder_does_not_hold_the_answer(spark):
    import time

    types = spark.createDataFrame([(0, "Cat", "A.Cat", False, False, False)], "seq bigint, name string, full_name string, is_interface boolean, is_enum boolean, is_value_type boolean")
    members = spark.createDataFrame([], "type_seq bigint, seq int, member_kind string, name string, doc_id string, type_key string, member_type string, params array<string>")
    index = spark.createDataFrame([(10_000, "C:Cat", "A.Cat", "class", "t", [1.0])], "numeric_id bigint, id string, fqn string, type string, text string, embedding array<float>")

    def search(encode, seconds):
        began = time.time()
        rows = vector.api_search(types, members, index, "cat", encode, "hybrid", seconds=seconds).collect()
        return {(r.section, r.label) for r in rows}, time.time() - began

    slow_rows = index.select("numeric_id", "id", "fqn", "type", "text", F.udf(lambda v: time.sleep(30) or v, "array<float>")("embedding").alias("embedding"))
    quick = lambda texts: [[1.0] for _ in texts]
    assert search(quick, 60)[0] == search(quick, None)[0] == {("keyword", "A.Cat"), ("semantic", "A.Cat")}
    found, took = search(lambda texts: time.sleep(20) or quick(texts), 1)  # a slow encoder
    assert found == {("keyword", "A.Cat")} and took < 15
    index = slow_rows
    found, took = search(quick, 2)  # slow jobs
    assert found == {("keyword", "A.Cat")} and took < 20
    time.sleep(1)
    assert spark.sparkContext.statusTracker().getActiveJobsIds() == []


def test_pages_of_an_answer(spark):
    types = spark.createDataFrame([(i, f"N{i:02}", f"A.N{i:02}", False, False, False) for i in range(25)], "seq bigint, name string, full_name string, is_interface boolean, is_enum boolean, is_value_type boolean")
    members = spark.createDataFrame([], "type_seq bigint, seq int, member_kind string, name string, doc_id string")
    w = api.Workspace(None, types=types, members=members)
    seen, offset = [], 0
    while True:
        ask = {"id": 1, "method": "tools/call", "params": {"name": "engine_search_api", "arguments": {"query": "n", "search_mode": "keyword", "max_results": 25}, "offset": offset}}
        answer = json.loads(api.handle(w, json.dumps(ask), limit=10))["result"]
        seen += [r["label"] for r in answer["content"]]
        offset += 10
        if not answer["more"]:
            break
    assert seen == [f"A.N{i:02}" for i in range(25)]


def test_service(spark, tmp_path):
    import threading
    import urllib.error
    import urllib.request

    from graphloom.service import Service, server

    def encode(texts):
        return [[1.0, 0.0] if "cat" in t else [0.6, 0.8] for t in texts]

    s = server(Service(spark, encode), port=0)
    threading.Thread(target=s.serve_forever, daemon=True).start()

    def ask(path, body=None):
        request = urllib.request.Request(f"http://127.0.0.1:{s.server_port}{path}", None if body is None else json.dumps(body).encode())
        try:
            with urllib.request.urlopen(request, timeout=60) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    docs = [{"id": f"C:{n}", "fqn": n, "type": "class", "text": n} for n in ("cat", "dog")]
    assert ask("/") == (200, {"status": "alive"}) and ask("/index", {"out_directory": str(tmp_path)})[1]["status"] == "empty"
    assert ask("/query", {"out_directory": str(tmp_path), "query": "cat"})[0] == 404 and ask("/query", {"query": "x"})[0] == 400
    assert ask("/index", {"out_directory": str(tmp_path), "documents": docs})[1]["indexed_count"] == 2
    found = ask("/query", {"out_directory": str(tmp_path), "query": "cat", "max_results": 2, "threshold": 0.7})[1]["matches"]
    assert [m["fqn"] for m in found] == ["cat"] and found[0]["preview"] == "cat" and ask("/nope")[0] == 404
    s.shutdown()


def test_dependencies_read_each_source_once(spark):
    got = registry.QUERIES["dependency_edges"](spark, "/root/testdata/sf0.001")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapIn" not in plan  # each of seven parts of the plan read all sources
    assert got.count() == spark.read.parquet("/root/testdata/sf0.001/customer.parquet").count() * 9


def test_implicit_creations_and_marks_beside_them(spark):
    code = "class A { List<B> all = new(), more = new (); int n = 1; Dictionary<string, C[]>? d\n = new ( 2 ); void F() { x = new(); D e = new(); } }"
    got = [(r.target, r.line_number) for r in csharp.source_uses(spark.createDataFrame([("a.cs", code)], "path string, text string")).where("kind = 'Instantiates'").orderBy("n").collect()]
    assert got == [("B", 1), ("string", 1), ("C", 1), ("D", 2)]
