"""The vector index as a small HTTP service: health, indexing and queries."""

from __future__ import annotations

import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession

from graphloom.operators import vector

DOCUMENT = "seq bigint, id string, fqn string, type string, text string"


class Service:
    """Requests and answers as dictionaries; a loaded index stays until another folder is asked for."""

    def __init__(self, spark: SparkSession, encode: Callable):
        self.spark, self.encode = spark, encode
        self._folder, self._index = None, None

    def health(self) -> dict:
        return {"status": "alive"}

    def index(self, request: dict) -> dict:
        """Writes the index of ``documents`` under ``out_directory``."""
        rows = [(i, *(d[c] for c in ("id", "fqn", "type", "text"))) for i, d in enumerate(request.get("documents") or [])]
        if not rows:
            return {"status": "empty", "message": "No documents provided for indexing."}
        self._folder = None
        return vector.write_index(self.spark.createDataFrame(rows, DOCUMENT), request["out_directory"], self.encode)

    def query(self, request: dict) -> dict:
        """The best matches of ``query`` in the index under ``out_directory``; the threshold follows the limit."""
        if self._folder != request["out_directory"]:
            self._index = vector.load_index(self.spark, request["out_directory"]).persist()
            self._folder = request["out_directory"]
        limit, least = request.get("max_results") or 5, request.get("threshold")
        hits = vector.semantic_search(self._index, request["query"], self.encode, limit, 0.0 if least is None else least)
        return {"query": request["query"], "matches": [r.asDict() for r in hits.select("id", "fqn", "type", "score", "preview").collect()]}

    def answer(self, method: str, path: str, body: bytes) -> tuple[int, dict]:
        """Status and answer of a request; a missing index is 404, a request without a needed part 400."""
        routes = {("GET", "/"): lambda _: self.health(), ("POST", "/index"): self.index, ("POST", "/query"): self.query}
        route = routes.get((method, path))
        if route is None:
            return 404, {"detail": "Not Found"}
        try:
            return 200, route(json.loads(body or b"{}"))
        except FileNotFoundError as e:
            return 404, {"detail": str(e)}
        except (KeyError, ValueError, TypeError) as e:
            return 400, {"detail": str(e)}


def server(service: Service, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server of ``service``; call its ``serve_forever``."""

    class Handler(BaseHTTPRequestHandler):
        def _do(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, found = service.answer(self.command, self.path, body)
            data = json.dumps(found).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _do

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
