"""A tool server over standard input and output: JSON-RPC 2.0, one message a line, as the Model Context Protocol has it."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from typing import IO

from lattice import service
from lattice.plans.materialize import scratch
from lattice.schemas import Graph
from lattice.sources.models import Embedder

_TEXT, _INT = {"type": "string"}, {"type": "integer"}

#: Tool name: (description, properties with defaults, required).
TOOLS: dict[str, tuple[str, dict, list[str]]] = {
    "search": ("Text passages nearest to a query.", {"query": _TEXT, "limit": _INT}, ["query"]),
    "get_entity": ("An entity with its mentions and relations.", {"name": _TEXT, "type": _TEXT}, ["name"]),
    "list_entities": ("Entities by name.", {"type": _TEXT, "limit": _INT}, []),
    "get_neighbors": ("The neighbourhood of an entity.", {"name": _TEXT, "depth": _INT}, ["name"]),
    "find_path": ("A shortest path between two entities.", {"from_name": _TEXT, "to_name": _TEXT, "max_depth": _INT}, ["from_name", "to_name"]),
    "list_relations": ("Relations by predicate, subject or object.", {"predicate": _TEXT, "subject": _TEXT, "object": _TEXT, "limit": _INT}, []),
    "get_schema": ("The current schema.", {}, []),
}


def call(g: Graph, embedder: Callable[[], Embedder], name: str, a: dict) -> object:
    """The answer of a tool; names with the suffix _tool are the same tools, and entity_type is the same argument as type."""
    name, kind = name.removesuffix("_tool"), a.get("type", a.get("entity_type"))
    if name == "search":
        return [{k: r[k] for k in ("chunk_text", "document_path", "entities")} for r in service.find(g, embedder(), a["query"], a.get("limit", 10))]
    if name == "get_entity":
        return service.entity(g, a["name"], kind) or f"Entity not found: {a['name']}"
    if name == "list_entities":
        return service.entities(g, kind, None, a.get("limit", 50))
    if name == "get_neighbors":
        return service.neighbors(g, a["name"], a.get("depth", 1))
    if name == "find_path":
        found = service.path(g, a["from_name"], a["to_name"], a.get("max_depth", 5))
        return f"No path from {a['from_name']} to {a['to_name']}" if found is None else found
    if name == "list_relations":
        return service.relations(g, a.get("predicate"), a.get("subject"), a.get("object"), a.get("limit", 50))
    if name == "get_schema":
        return service.schema(g) or "No schema yet"
    raise KeyError(f"unknown tool {name}")


def _error(message_id: object, code: int, text: str) -> dict:
    return {"jsonrpc": "2.0", "id": message_id, "error": {"code": code, "message": text}}


def answer(message: object, open_graph: Callable[[], Graph], embedder: Callable[[], Embedder]) -> dict | None:
    """The reply to one message; notifications have none."""
    if not isinstance(message, dict) or not isinstance(message.get("params") or {}, dict):
        return _error(message.get("id") if isinstance(message, dict) else None, -32600, "not a request")
    if "id" not in message:
        return None
    reply: dict = {"jsonrpc": "2.0", "id": message["id"]}
    method, params = message.get("method"), message.get("params") or {}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "lattice", "version": "0.1"}}}
    if method == "ping":
        return reply | {"result": {}}
    if method == "tools/list":
        tools = [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": r}} for n, (d, p, r) in TOOLS.items()]
        return reply | {"result": {"tools": tools}}
    if method == "tools/call":
        try:
            with scratch():
                value = call(open_graph(), embedder, params["name"], params.get("arguments") or {})
            return reply | {"result": {"content": [{"type": "text", "text": value if isinstance(value, str) else json.dumps(value)}]}}
        except Exception as e:
            return reply | {"result": {"content": [{"type": "text", "text": f"{type(e).__name__}: {e}"}], "isError": True}}
    return _error(message["id"], -32601, f"unknown method {method}")


def answer_line(line: str, open_graph: Callable[[], Graph], embedder: Callable[[], Embedder]) -> dict | list | None:
    """The reply to a line, which holds a message or a batch of them; a line that is no JSON is answered with an error."""
    try:
        message = json.loads(line)
    except ValueError as e:
        return _error(None, -32700, f"not JSON: {e}")
    if not isinstance(message, list):
        return answer(message, open_graph, embedder)
    if not message:
        return _error(None, -32600, "an empty batch")
    return [r for m in message if (r := answer(m, open_graph, embedder)) is not None] or None


def serve(open_graph: Callable[[], Graph], embedder: Callable[[], Embedder], lines: IO[str] = sys.stdin, out: IO[str] = sys.stdout) -> None:
    for line in lines:
        if line.strip() and (reply := answer_line(line, open_graph, embedder)) is not None:
            out.write(json.dumps(reply) + "\n")
            out.flush()
