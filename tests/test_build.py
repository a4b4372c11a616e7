import json

from graphloom import api
from graphloom.build import build
from graphloom.operators import vector
from graphloom.sources import files

DOC = {"Types": [
    {"Name": "Texture", "FullName": "Sandbox.Texture", "Methods": [{"Name": "Load", "ReturnType": "Sandbox.Texture", "IsPublic": True, "Parameters": []}]},
    {"Name": "Color", "FullName": "Sandbox.Color", "IsEnum": True, "Fields": [{"Name": "Red", "FieldType": "Sandbox.Color", "IsPublic": True}]},
    *({"Name": f"T{i}", "FullName": f"Sandbox.T{i}", "BaseType": "Sandbox.Texture"} for i in range(12))]}


def tree(tmp_path):
    src = tmp_path / "src"
    for path, text in {"a/Till.cs": "namespace Shop { class Till : Desk { Coin c; Color skin; void F() { new Coin(); Texture.Load(); } } }", "Desk.cs": "namespace Shop { class Desk { } class Coin { } }",
                       "Gone/Ghost.cs": "class Ghost { }", "ui/Shelf.razor": "<p/>\n@code { Coin c; }", ".astignore": "Gone/\n"}.items():
        (src / path).parent.mkdir(parents=True, exist_ok=True)
        (src / path).write_text(text)
    (tmp_path / "api.json").write_text(json.dumps(DOC))
    return str(src), str(tmp_path / "api.json")


def test_build_both(spark, tmp_path):
    src, doc = tree(tmp_path)
    out = str(tmp_path / "out")
    told = build(spark, "both", src, out, doc, encode=lambda texts: [[float(len(t)), 1.0] for t in texts])
    assert told["user"]["notes"] == 4 and told["user"]["index"] == "ok" and told["engine"] == {"notes": 14, "edges": told["engine"]["edges"], "is_enum": 1, "is_attribute": 0, "home": 3, "index": "ok"}
    edges = {(r.src, r.dst, r.kind) for r in spark.read.parquet(f"{out}/user_code/tables/edges").collect()}
    assert {("Till", "Desk", "Inherits"), ("Till", "Coin", "Instantiates"), ("Till", "Sandbox.Texture", "Engine_Calls"), ("Till", "Sandbox.Color", "Engine_References")} <= edges and any(s == "Shelf" and d == "Coin" for s, d, _ in edges)
    document = next((tmp_path / "out/user_code/graph").glob("part-*"))
    nodes, _ = files.graph_cache(spark, str(document))
    assert {r.id for r in nodes.collect()} == {"Till", "Desk", "Coin", "Shelf"}
    assert vector.load_index(spark, f"{out}/engine_api").count() > 14
    assert [r.line for r in spark.read.parquet(f"{out}/engine_api/home").orderBy("rank").collect()][2] == "- [[Sandbox.Texture]] (12 classes)"


def test_command_without_engine_links_or_api(spark, tmp_path, capsys):
    src, doc = tree(tmp_path)
    api.main(["--src", src, "--out", str(tmp_path / "o"), "--api", doc, "--mode", "user", "--engine-links", "false"])
    assert set(json.loads(capsys.readouterr().out.strip().splitlines()[-1])) == {"user"}
    kinds = {(r.dst, r.kind) for r in spark.read.parquet(str(tmp_path / "o/user_code/tables/edges")).where("src = 'Till'").collect()}
    assert ("Sandbox.Color", "Engine_References") not in kinds and ("Sandbox.Texture", "Engine_Calls") in kinds  # receivers' edges stay
    assert build(spark, "engine", src, str(tmp_path / "e"))["engine"]["index"] == "skipped"
