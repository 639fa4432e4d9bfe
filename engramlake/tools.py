"""A tool server over a Memory: JSON-RPC requests, one a line, answers one a line."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterable
from typing import IO

from engramlake.api import Memory, Refused
from engramlake.operators import records as R

# Protocol versions and error codes of the transport.
VERSION, LEGACY_VERSION = "2026-07-28", "2025-06-18"
PARSE, INVALID, METHOD, PARAMS, INTERNAL, UNSUPPORTED = -32700, -32600, -32601, -32602, -32603, -32022


class RpcError(Exception):
    def __init__(self, code: int, message: str) -> None:
        super().__init__(message)
        self.code = code


def _matches(df) -> list[dict]:
    extra = [c for c in ("cos", "score", "rank") if c in df.columns]
    plain = R.as_json(df).withColumnRenamed("id", "_id")
    rows = df.select("id", *extra).collect()
    order = {r["id"]: k for k, r in enumerate(rows)}
    found = [json.loads(r["json"]) for r in plain.collect()]
    out = sorted(found, key=lambda r: order[r["id"]])
    return [o | {c: rows[order[o["id"]]][c] for c in extra} for o in out]


#: tool -> (required and optional arguments by type, what it does)
ARGUMENTS: dict[str, tuple[dict[str, str], dict[str, str]]] = {
    "memory_search": ({"query": "string"}, {"section": "string", "project": "string", "k": "integer"}),
    "memory_recall": ({"question": "string"}, {}),
    "memory_insert": ({"section": "string", "content": "string"}, {"project": "string", "locked": "boolean"}),
    "memory_update": ({"id": "string", "content": "string"}, {}),
    "memory_deprecate": ({"id": "string"}, {"reason": "string"}),
    "memory_list": ({}, {"section": "string", "project": "string", "include_deprecated": "boolean"}),
    "project_select": ({"slug": "string or null"}, {}),
    "project_list": ({}, {}),
    "observe_turn": ({"role": "string", "text": "string"}, {}),
    "context_build": ({"user_message": "string"}, {"base_system_prompt": "string"}),
    "memory_stats": ({}, {}),
}


def _recall(m: Memory, a: dict) -> dict:
    answer, cited = m.recall(a["question"])
    return {"answer": answer, "cited": [{"id": r["id"], "content": r["content"]} for r in cited]}


def _done(x: object) -> dict:
    return {"ok": True}


CALLS: dict[str, Callable[[Memory, dict], dict]] = {
    "memory_search": lambda m, a: {"matches": _matches(m.search(a["query"], a.get("section", "any"), a.get("project"), a.get("k", 0)))},
    "memory_recall": _recall,
    "memory_insert": lambda m, a: {"id": m.insert(a["section"], a["content"], a.get("project"), a.get("locked", False))},
    "memory_update": lambda m, a: _done(m.update(a["id"], a["content"])),
    "memory_deprecate": lambda m, a: _done(m.deprecate(a["id"], a.get("reason"))),
    "memory_list": lambda m, a: {"records": _matches(m.list(a.get("section", "any"), a.get("project"), a.get("include_deprecated", False)))},
    "project_select": lambda m, a: _done(m.select_project(a["slug"])) | {"active": m.active},
    "project_list": lambda m, a: {"projects": m.projects()},
    "observe_turn": lambda m, a: _done(m.observe_turn(a["role"], a["text"])),
    "context_build": lambda m, a: {"prompt": m.build_prompt(a.get("base_system_prompt", ""), a["user_message"])},
    "memory_stats": lambda m, a: m.stats(),
}


def _argument(name: str, kind: str, v: object) -> object:
    if kind == "string or null" and v is None:
        return None
    if kind.startswith("string") and isinstance(v, str) and "\0" not in v:
        return v
    if kind == "boolean" and isinstance(v, bool):
        return v
    if kind == "integer" and isinstance(v, (int, float)) and not isinstance(v, bool) and v == v and abs(v) < 2**63 and v == int(v):
        return int(v)
    raise RpcError(PARAMS, f"{name}: {kind} expected")


def describe(name: str) -> dict:
    need, may = ARGUMENTS[name]
    kinds = {k: {"type": ["string", "null"] if t.endswith("null") else t} for k, t in (need | may).items()}
    return {"name": name, "inputSchema": {"type": "object", "properties": kinds, "required": list(need)}}


def call(memory: Memory, params: object) -> dict:
    """A refusal is a result marked as an error; a wrong call is a protocol error."""
    if not isinstance(params, dict) or params.get("name") not in CALLS or not isinstance(params.get("arguments", {}), dict):
        raise RpcError(PARAMS, "an existing tool and its arguments are needed")
    need, may = ARGUMENTS[params["name"]]
    given = params.get("arguments", {})
    if missing := [k for k in need if k not in given]:
        raise RpcError(PARAMS, f"missing {', '.join(missing)}")
    args = {k: _argument(k, t, given[k]) for k, t in (need | may).items() if k in given}
    try:
        result, bad = CALLS[params["name"]](memory, args), False
    except Refused as e:
        result, bad = {"error": e.code, "message": str(e)}, True
    return {"content": [{"type": "text", "text": json.dumps(result, ensure_ascii=False)}], "structuredContent": result, "isError": bad}


def _request(memory: Memory, req: object) -> dict | None:
    if isinstance(req, list):
        raise RpcError(INVALID, "one request at a time")
    if not isinstance(req, dict):
        raise RpcError(INVALID, "a request is an object")
    has_id, rid, method = "id" in req, req.get("id"), req.get("method")
    if has_id and (isinstance(rid, bool) or not isinstance(rid, (str, int))):
        raise RpcError(INVALID, "the id must be a string or an integer")
    answer = {"jsonrpc": "2.0", "id": rid}
    try:
        if req.get("jsonrpc") != "2.0" or not isinstance(method, str):
            raise RpcError(INVALID, "no request of version 2.0")
        if not has_id and method.startswith("notifications/"):
            return None
        meta = req["params"].get("_meta") if isinstance(req.get("params"), dict) else None
        asked = meta.get("io.modelcontextprotocol/protocolVersion") if isinstance(meta, dict) else None
        if asked is not None and asked != VERSION and method != "server/discover":
            raise RpcError(UNSUPPORTED, "unsupported protocol version")
        info = {"capabilities": {"tools": {}}, "serverInfo": {"name": "engramlake", "version": "0.1.0"}}
        if method == "initialize":
            return answer | {"result": {"protocolVersion": LEGACY_VERSION} | info}
        if method == "server/discover":
            return answer | {"result": {"supportedVersions": [VERSION]} | info}
        if method == "ping":
            return answer | {"result": {}}
        if method == "tools/list":
            return answer | {"result": {"tools": [describe(n) for n in ARGUMENTS]}}
        if method == "tools/call":
            return answer | {"result": call(memory, req.get("params"))}
        raise RpcError(METHOD, "method not found")
    except RpcError as e:
        return answer | {"error": {"code": e.code, "message": str(e)}}
    except Exception as e:  # noqa: BLE001 - a fault must not end the server
        return answer | {"error": {"code": INTERNAL, "message": type(e).__name__}}


def handle(memory: Memory, line: str) -> str | None:
    """The answer to one line; None for blank lines and notifications."""
    if not line.strip():
        return None
    try:
        out = _request(memory, json.loads(line, parse_constant=lambda c: (_ for _ in ()).throw(ValueError(c))))
    except ValueError:
        out = {"jsonrpc": "2.0", "id": None, "error": {"code": PARSE, "message": "no JSON"}}
    except RpcError as e:
        out = {"jsonrpc": "2.0", "id": None, "error": {"code": e.code, "message": str(e)}}
    return json.dumps(out, ensure_ascii=False, separators=(",", ":")) if out else None


def serve(memory: Memory, lines: Iterable[str] = sys.stdin, out: IO[str] = sys.stdout) -> None:
    for line in lines:
        if (answer := handle(memory, line.rstrip("\r\n"))) is not None:
            print(answer, file=out, flush=True)
    memory.close()
