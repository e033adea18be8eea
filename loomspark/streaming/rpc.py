"""Line-delimited JSON-RPC over the engine's API."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import SparkSession

from loomspark import __version__
from loomspark.model import Config
from loomspark.operators import pipeline
from loomspark.operators.graph import build, priors, traverse
from loomspark.operators.graph.store import Store
from loomspark.sources import files, requests

PARSE, VERSION, METHOD, TOOL = -32700, -32600, -32601, -32000
IMPACT_DEPTH = 2

_TEXT, _LIST = {"type": "string"}, {"type": "array", "items": {"type": "string"}}
TOOLS = {
    "optimize": ("Reduce the chunks of a request to a token budget", {"request": {"type": "object"}, "max_tokens": {"type": "integer"}}, ["request"]),
    "build_graph": ("Index all source files", {"ignore": _LIST}, []),
    "update_graph": ("Index changed files", {"paths": _LIST}, ["paths"]),
    "impact_radius": ("Files affected by changes", {"paths": _LIST, "depth": {"type": "integer"}}, ["paths"]),
    "skeleton": ("Signatures of a file", {"path": _TEXT}, ["path"]),
    "graph_stats": ("Sizes of the graph", {}, []),
}


class Server:
    """Answers requests about the tree at source_root, whose graph snapshots are at root."""

    def __init__(self, spark: SparkSession, root: str, source_root: str, config: Config = Config()):
        self.spark, self.root, self.source_root, self.config = spark, root, source_root, config
        self.tools: dict[str, Callable[[dict], object]] = {n: getattr(self, f"_{n}") for n in TOOLS}

    def _store(self) -> Store:
        return Store.open(self.spark, self.root)

    def _optimize(self, a: dict) -> object:
        from dataclasses import replace

        chunks, query = requests.parse_request(self.spark, json.dumps(a["request"]))
        config = replace(self.config, max_tokens=a["max_tokens"]) if "max_tokens" in a else self.config
        return json.loads(requests.result_json(pipeline.optimize(chunks, query, config)))

    def _build_graph(self, a: dict) -> object:
        store, report = build.update(self._store(), files.scan(self.spark, self.source_root, a.get("ignore", [])))
        store.save(self.root)
        return vars(report)

    def _update_graph(self, a: dict) -> object:
        store, report = build.update(self._store(), files.scan(self.spark, self.source_root), files.path_list(self.spark, a["paths"]))
        store.save(self.root)
        return vars(report)

    def _impact_radius(self, a: dict) -> object:
        return [r.path for r in priors.impact(self._store(), a["paths"], a.get("depth", IMPACT_DEPTH)).collect()]

    def _skeleton(self, a: dict) -> object:
        return traverse.file_skeleton(self._store().nodes, a["path"]).first()[0]

    def _graph_stats(self, a: dict) -> object:
        return dict(zip(("nodes", "edges", "files"), self._store().stats()))

    def handle(self, line: str) -> dict:
        """The reply to one line; notifications are answered too."""
        try:
            request = json.loads(line)
        except ValueError as e:
            return _error(None, PARSE, f"parse error: {e}")
        if not isinstance(request, dict) or request.get("jsonrpc") != "2.0":
            return _error(request.get("id") if isinstance(request, dict) else None, VERSION, "jsonrpc must be 2.0")
        ident, method, params = request.get("id"), request.get("method"), request.get("params") or {}
        if method == "initialize":
            return _result(ident, {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "loomspark", "version": __version__}})
        if method == "tools/list":
            return _result(ident, {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": r}} for n, (d, p, r) in TOOLS.items()]})
        if method != "tools/call":
            return _error(ident, METHOD, f"unknown method {method}")
        try:
            got = self.tools[params["name"]](params.get("arguments") or {})
        except Exception as e:
            return _error(ident, TOOL, f"{type(e).__name__}: {str(e)[:500]}")
        return _result(ident, {"content": [{"type": "text", "text": got if isinstance(got, str) else json.dumps(got, ensure_ascii=False)}]})

    def serve(self, lines: Iterable[str]) -> Iterator[str]:
        for line in lines:
            if line.strip():
                yield json.dumps(self.handle(line), ensure_ascii=False)


def _result(ident, value) -> dict:
    return {"jsonrpc": "2.0", "id": ident, "result": value}


def _error(ident, code: int, message: str) -> dict:
    return {"jsonrpc": "2.0", "id": ident, "error": {"code": code, "message": message}}
