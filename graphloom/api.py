"""Commands and tools over a graph; each returns a DataFrame, rendering is separate."""

from __future__ import annotations

import argparse
import importlib
import json
import re
import sys
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from graphloom.build import build
from graphloom.operators import lookup, metrics, paths, vector, views
from graphloom.operators.model import PropertyGraph
from graphloom.runtime import session
from graphloom.sinks.render import note_view
from graphloom.sources.files import graph_cache, path_exists, source_of


@dataclass
class Workspace:
    """What tools work on: a user graph, and where there are any an API registry with its notes, source files, vector indexes and an encoder."""

    graph: PropertyGraph
    types: DataFrame | None = None
    members: DataFrame | None = None
    notes: DataFrame | None = None  # id, note, seq
    sources: DataFrame | None = None  # path, text
    user_index: DataFrame | None = None
    engine_index: DataFrame | None = None
    encode: Callable | None = None


class Missing(ValueError):
    """A tool that needs a part that the workspace doesn't have, or a name it doesn't know."""


def _need(value, what: str):
    if value is None:
        raise Missing(f"no {what} here")
    return value


def _explain_class(w: Workspace, class_name: str, view_mode: str = "all") -> DataFrame:
    return views.explain(w.graph, class_name, view_mode)


def _find_path(w: Workspace, from_class: str, to_class: str, undirected: bool = True) -> DataFrame:
    return paths.shortest_path(w.graph, from_class, to_class, undirected, known_only=True)


def _check_cycles(w: Workspace) -> DataFrame:
    return paths.cycle_hops(paths.detect_cycles(w.graph).select("cycle_key"), w.graph)


def _get_metrics(w: Workspace) -> DataFrame:
    return metrics.diagnostics(w.graph)


def _user_search(w: Workspace, query: str = "", max_results: int = 5) -> DataFrame:
    if not query.strip():
        raise Missing("the query is empty")
    return vector.semantic_search(_need(w.user_index, "user index"), query, _need(w.encode, "encoder"), max_results)


def _read_source(w: Workspace, class_name: str) -> DataFrame:
    return source_of(_need(w.sources, "source files"), class_name)


def _search_api(w: Workspace, query: str, search_mode: str = "hybrid", member_type: str = "all", max_results: int = 5) -> DataFrame:
    types, members = _need(w.types, "API registry"), _need(w.members, "API registry")
    return vector.api_search(types, members, w.engine_index, query, w.encode, search_mode, member_type.lower(), max_results, w.graph, seconds=vector.GUARD)


def _explain_type(w: Workspace, class_name: str, view_mode: str = "all") -> DataFrame:
    found = lookup.first_match(_need(w.notes, "notes"), "id", class_name)
    return found.select("id", note_view("note", view_mode).alias("note"))


#: Tools by name; clients may put a product's name and a line below before it.  Arguments are the functions' own.
TOOLS: dict[str, Callable] = {
    "user_explain_class": _explain_class, "user_explain_component": _explain_class, "user_find_path": _find_path, "user_check_cycles": _check_cycles,
    "user_get_metrics": _get_metrics, "user_semantic_search": _user_search, "user_read_source_code": _read_source,
    "engine_search_api": _search_api, "engine_explain": _explain_type, "engine_explain_type": _explain_type,
}

_OPTIONAL = {"view_mode": "string", "undirected": "boolean", "max_results": "integer", "search_mode": "string", "member_type": "string"}


def tool_list(mode: str = "both") -> list[dict]:
    """Names and arguments of the tools of a mode: ``user``, ``engine``, or both."""
    out = []
    for name, f in TOOLS.items():
        if mode in ("user", "engine") and not name.startswith(mode):
            continue
        arguments = list(f.__code__.co_varnames[1 : f.__code__.co_argcount])
        required = arguments[: len(arguments) - len(f.__defaults__ or ())]
        properties = {a: {"type": _OPTIONAL.get(a, "string")} for a in arguments}
        out.append({"name": name, "inputSchema": {"type": "object", "properties": properties, "required": required}})
    return out


def call_tool(w: Workspace, name: str, arguments: dict) -> DataFrame:
    """The rows of a tool; arguments it doesn't have are left out."""
    bare = re.sub(r"^[A-Za-z0-9]+_(?=(?:user|engine)_)", "", name)
    if bare not in TOOLS:
        raise Missing(f"unknown tool: {name}")
    f = TOOLS[bare]
    known = f.__code__.co_varnames[1 : f.__code__.co_argcount]
    return f(w, **{k: v for k, v in arguments.items() if k in known})


def run_command(graph: PropertyGraph, command: str, arg1: str = "", arg2: str = "", undirected: bool = False) -> DataFrame:
    if command == "path":
        return paths.shortest_path(graph, arg1, arg2, undirected, known_only=True)
    if command in ("metrics", "weight"):
        return metrics.degrees(graph).select("id", "in_degree", "out_degree")
    if command in ("cycles", "loops"):
        return paths.detect_cycles(graph).select("cycle_key").orderBy("cycle_key")
    if command == "explain":
        return views.explain(graph, arg1, arg2 or "all")
    if command in ("search", "query"):
        return views.search(graph, arg1)
    raise ValueError(f"unknown command {command!r}")


def handle(w: Workspace, line: str, limit: int = 100, mode: str = "both") -> str | None:
    """Answer to one JSON-RPC line; none to a notification.

    Beyond ``limit`` rows an answer says how many more there are; a call's ``offset`` asks for those after as many.
    """
    request = json.loads(line)
    if request.get("id") is None:
        return None
    answer: dict = {"jsonrpc": "2.0", "id": request["id"]}
    method, params = request.get("method"), request.get("params") or {}
    if method == "initialize":
        answer["result"] = {"serverInfo": {"name": "graphloom"}, "capabilities": {"tools": {}}}
    elif method == "tools/list":
        answer["result"] = {"tools": tool_list(mode)}
    elif method == "tools/call":
        try:
            rows = call_tool(w, params.get("name", ""), params.get("arguments") or {})
            offset = int(params.get("offset") or 0)
            shown = [json.loads(r) for r in rows.offset(offset).limit(limit + 1).toJSON().collect()]
            more = rows.count() - offset - limit if len(shown) > limit else 0
            answer["result"] = {"content": shown[:limit], "more": more}
        except (ValueError, TypeError) as e:  # a tool's error is its answer
            answer["result"] = {"content": [], "isError": True, "message": str(e)}
    else:
        answer["error"] = {"code": -32601, "message": "Method not found"}
    return json.dumps(answer)


def listen(w: Workspace, lines: Iterable[str], put: Callable[[str], object], mode: str = "both") -> None:
    """Answers to a stream of lines, until it ends; empty lines are passed over."""
    for line in lines:
        if line.strip() and (answer := handle(w, line, mode=mode)) is not None:
            put(answer + "\n")


def _encoder(name: str) -> Callable:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def command_search(spark, folder: str, text: str, encode: Callable, limit: int = 5) -> DataFrame:
    """Hits in the API's index under ``folder`` if it has one, else in the user's."""
    sub = next((s for s in ("engine_api", "user_code") if path_exists(spark, f"{folder}/{s}/vec/semantic_index")), "")
    hits = vector.semantic_search(vector.load_index(spark, f"{folder}/{sub}".rstrip("/")), text, encode, limit)
    return hits.select("score_text", "fqn", "type", "namespace", "file")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="graphloom")
    parser.add_argument("--cache", help="graph document")
    parser.add_argument("--cmd", help="a command, semantic, or serve; without one, --src and --out build")
    parser.add_argument("--src", help="source tree to build from")
    parser.add_argument("--out", help="folder to build into")
    parser.add_argument("--api", help="API document of a build")
    parser.add_argument("--engine-links", choices=["true", "false"], default="true", help="whether a build links user classes to API types")
    parser.add_argument("--index", help="folder of vector indexes, for semantic")
    parser.add_argument("--encoder", help="module:function that encodes texts, for semantic")
    parser.add_argument("--arg1", default="")
    parser.add_argument("--arg2", default="")
    parser.add_argument("--undirected", action="store_true")
    parser.add_argument("--mode", default="both", choices=["user", "engine", "both"])
    a = parser.parse_args(argv)
    if not a.cmd:
        encode = _encoder(a.encoder) if a.encoder else None
        print(json.dumps(build(session(), a.mode, _need(a.src, "source tree"), _need(a.out, "folder"), a.api, a.engine_links == "true", encode)))
        return
    if a.cmd == "semantic":
        for row in command_search(session(), _need(a.index, "index folder"), a.arg1, _encoder(_need(a.encoder, "encoder"))).toLocalIterator():
            print("\t".join(map(str, row)))
        return
    graph = PropertyGraph(*graph_cache(session(), _need(a.cache, "graph document")))
    if a.cmd == "serve":
        listen(Workspace(graph), sys.stdin, lambda x: (sys.stdout.write(x), sys.stdout.flush()), a.mode)
        return
    rows = run_command(graph, a.cmd, a.arg1, a.arg2, a.undirected)
    for row in rows.toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in row))


if __name__ == "__main__":
    main()
