"""JSON-RPC over lines of text: one request a line, one response a line."""

from __future__ import annotations

import json
import logging
import sys
from collections.abc import Callable, Iterable
from typing import TextIO

log = logging.getLogger(__name__)

# Fixed values of the protocol: its version, error codes and method names, and below the tools' names and arguments.
PROTOCOL = "2024-11-05"
PARSE, METHOD, PARAMS, INTERNAL = -32700, -32601, -32602, -32603


def _text(description: str) -> dict:
    return {"type": "string", "description": description}


def _list(description: str, items: dict | None = None) -> dict:
    return {"type": "array", "description": description, "items": items or {"type": "string"}}


CATALOGUE = [
    {
        "name": "save_thread",
        "description": "Store what was decided, learned and done in a session of a project.",
        "inputSchema": {
            "type": "object",
            "properties": {
                "project_path": _text("Folder of the project"),
                "use_local_storage": {"type": "boolean", "description": "Keep the document in the project's own folder", "default": True},
                "architecture": _text("Design of the project"),
                "decisions": _list("Decisions with their reasons", {"type": "object", "properties": {"decision": {"type": "string"}, "reason": {"type": "string"}}, "required": ["decision"]}),
                "facts": _list("Single statements to remember"),
                "state": {"type": "object", "description": "Where the project stands", "properties": {k: _list(k.replace("_", " ")) for k in ("completed", "in_progress", "pending")}},
                "summary": _text("Summary of the session"),
            },
            "required": ["project_path", "summary"],
        },
    },
    {"name": "load_thread", "description": "Design, state, recent sessions and decisions of a project.", "inputSchema": {"type": "object", "properties": {"project_path": _text("Folder of the project")}, "required": ["project_path"]}},
    {
        "name": "search_memory",
        "description": "Find facts by meaning and words, in one project or in all.",
        "inputSchema": {"type": "object", "properties": {"project_path": _text("Folder of the project; all projects if left out"), "query": _text("What to look for"), "limit": {"type": "integer", "description": "Most results", "default": 5}}, "required": ["query"]},
    },
]


class Server:
    def __init__(self, tools: dict[str, Callable[[dict], dict]], name: str = "factloom", version: str = "0.1.0"):
        self.tools, self.name, self.version = tools, name, version
        self.methods: dict[str, Callable[[dict], dict]] = {
            "initialize": self.initialize,
            "initialized": lambda params: {},
            "notifications/initialized": lambda params: {},
            "tools/list": lambda params: {"tools": [t for t in CATALOGUE if t["name"] in self.tools]},
            "resources/list": lambda params: {"resources": []},
            "resources/templates/list": lambda params: {"resourceTemplates": []},
            "ping": lambda params: {},
        }

    def initialize(self, params: dict) -> dict:
        asked = params.get("protocolVersion")
        return {"protocolVersion": asked if isinstance(asked, str) else PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": self.name, "version": self.version}}

    def handle(self, request: dict) -> dict:
        """The response to one request; whatever goes wrong inside becomes an error response."""
        ident, method, params = request.get("id"), request.get("method"), request.get("params")
        try:
            if method == "tools/call":
                return self.call(ident, params)
            if method in self.methods:
                return _success(ident, self.methods[method](params if isinstance(params, dict) else {}))
            return _success(None, {}) if ident is None else _error(ident, METHOD, f"{method!r} is not a method of this server")
        except Exception as error:
            log.exception("request failed")
            return _error(ident, INTERNAL, f"the request failed: {error}")

    def call(self, ident: object, params: object) -> dict:
        if not isinstance(params, dict):
            return _error(ident, PARAMS, "a call needs params, as an object")
        name = params.get("name") if isinstance(params.get("name"), str) else ""
        if name not in self.tools:
            return _error(ident, PARAMS, f"{name!r} is not a tool of this server")
        arguments = params.get("arguments")
        try:
            return _success(ident, _content(self.tools[name](arguments if isinstance(arguments, dict) else {})))
        except Exception as error:  # a tool's failure is a result that says so
            log.exception("tool failed")
            return _success(ident, _content({"error": str(error)}) | {"isError": True})

    def respond(self, line: str) -> str | None:
        """The response line to a request line; none for blank lines and notifications without an error."""
        if not line.strip():
            return None
        try:
            request = json.loads(line)
            if not isinstance(request, dict) or not isinstance(request.get("method"), str):
                raise ValueError("not a request")
        except ValueError as error:
            return json.dumps(_error(None, PARSE, f"the line is no request: {error}"))
        response = self.handle(request)
        return json.dumps(response, ensure_ascii=False, default=str) if request.get("id") is not None or "error" in response else None

    def run(self, source: Iterable[str] | None = None, sink: TextIO | None = None) -> None:
        """Strictly one request after the other."""
        sink = sink or sys.stdout
        for line in source if source is not None else sys.stdin:
            if (out := self.respond(line)) is not None:
                sink.write(out + "\n")
                sink.flush()


def _success(ident: object, result: dict) -> dict:
    return {"jsonrpc": "2.0", "id": ident, "result": result}


def _error(ident: object, code: int, message: str) -> dict:
    return {"jsonrpc": "2.0", "id": ident, "error": {"code": code, "message": message}}


def _content(value: dict) -> dict:
    return {"content": [{"type": "text", "text": json.dumps(value, ensure_ascii=False, default=str)}]}


def main() -> None:
    """Serves a session on standard input and output; logs go to standard error."""
    import os
    from pathlib import Path

    from pyspark.sql import SparkSession

    from factloom import config
    from factloom.engine import Engine

    logging.basicConfig(level=os.environ.get("FACTLOOM_LOG", "INFO"), stream=sys.stderr)
    root = Path.home() / config.FOLDER
    config.create_default_if_missing(root / "config.toml")
    Server(Engine(SparkSession.builder.getOrCreate(), root, config.load(root / "config.toml")).tools).run()


if __name__ == "__main__":
    main()
