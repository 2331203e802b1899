"""A JSON-RPC server on lines: maps, symbols, the index and expansions as tools."""

from __future__ import annotations

import json
import os
import re
from typing import TextIO

from . import api
from .langs import LANGUAGES, TOKEN_DEFAULT
from .render import structured

PROTOCOL = "2024-11-05"
PARSE, INVALID, UNKNOWN, PARAMS, INTERNAL = -32700, -32600, -32601, -32602, -32603


def _schema(required: tuple[str, ...], **properties: dict) -> dict:
    path = {"type": "string", "description": "directory to look at, under the server's root"}
    return {"type": "object", "properties": {"path": path, **properties}, "required": ["path", *required]}


def _is(kind: str, about: str, **more: object) -> dict:
    return {"type": kind, "description": about, **more}


_BUDGET = {"budget": _is("integer", "most tokens of the answer", minimum=1)}
_NARROW = {
    "no_private": _is("boolean", "leave out what isn't public"),
    "lang": {"description": "languages to keep, as a list or with commas between", "anyOf": [{"type": "string"}, {"type": "array", "items": {"type": "string"}}]},
}
_FOCUS = {"focus": _is("array", "files or directories to rank from", items={"type": "string"}), "format": _is("string", "form of the map", enum=["md", "json", "xml"])}
TOOLS = [
    {"name": "get_map", "description": "The ranked structure of a source tree within a token budget.", "inputSchema": _schema((), **_BUDGET, **_NARROW, **_FOCUS)},
    {"name": "get_symbol", "description": "Where a symbol of exactly this name is defined.", "inputSchema": _schema(("name",), name=_is("string", "name, letter by letter"), **_NARROW)},
    {"name": "get_symbol_index", "description": "Anchors of types, then functions, within a token budget.", "inputSchema": _schema((), **_BUDGET, **_NARROW)},
    {"name": "expand_symbol", "description": "A symbol's signature and what its file imports and is used by.", "inputSchema": _schema(("anchor",), anchor=_is("string", "path#name, or path#name@line where the name repeats"), **_NARROW)},
]


def parse_anchor(anchor: str) -> tuple[str, str, int | None] | None:
    """``path#name`` or ``path#name@line``: the first ``#``, a trailing ``@digits``; None if a side is empty."""
    path, _, rest = anchor.partition("#")
    pinned = re.fullmatch(r"(.+)@([0-9]+)", rest, re.DOTALL)
    name, line = (pinned[1], int(pinned[2])) if pinned else (rest, None)
    return (path, name, line) if path and name else None


def confine(root: str, path: str | None) -> str:
    """``path`` under ``root``, links resolved; ValueError outside or if it is no directory."""
    if path is not None and not isinstance(path, str):
        raise ValueError("path is a text")
    full = os.path.realpath(os.path.join(root, path or "."))
    if full != (top := os.path.realpath(root)) and not full.startswith(top + os.sep):
        raise ValueError("the path leaves the server's root")
    if not os.path.isdir(full):
        raise ValueError(f"not a directory: {path}")
    return full


def _texts(value: object, name: str) -> list[str]:
    """A list of texts, or one with commas."""
    if value is None:
        return []
    parts = value.split(",") if isinstance(value, str) else value
    if not isinstance(parts, list) or not all(isinstance(x, str) for x in parts):
        raise ValueError(f"{name} is a text or a list of texts")
    return [x.strip() for x in parts if x.strip()]


def options(args: dict) -> api.MapOptions:
    langs = _texts(args.get("lang"), "lang")
    if unknown := [x for x in langs if x not in LANGUAGES]:
        raise ValueError(f"unknown language {unknown[0]}")
    size = args.get("budget", TOKEN_DEFAULT)
    if not isinstance(size, int) or isinstance(size, bool) or size <= 0:
        raise ValueError("budget is a positive number")
    return api.MapOptions(size, bool(args.get("no_private")), langs or None, _texts(args.get("focus"), "focus"))


class Server:
    def __init__(self, spark, root: str) -> None:
        self.spark, self.root = spark, root

    def call(self, name: str, args: object) -> str:
        if not isinstance(args, dict):
            raise ValueError("arguments are named")
        root, opts = confine(self.root, args.get("path")), options(args)
        if name == "get_map":
            form = args.get("format", "md")
            if form not in ("md", "json", "xml"):
                raise ValueError("format is md, json or xml")
            return api.render_map(api.build_map(self.spark, root, opts), form)
        if name == "get_symbol":
            if not isinstance(args.get("name"), str) or not args["name"]:
                raise ValueError("name is missing")
            return json.dumps([r.asDict() for r in api.find_symbol(self.spark, root, args["name"], opts)])
        if name == "get_symbol_index":
            found = api.build_symbol_index(self.spark, root, opts)
            return json.dumps({"version": structured.VERSION, **{k: found[k] for k in ("loc", "files", "rendered", "entries")}})
        at = parse_anchor(args["anchor"]) if isinstance(args.get("anchor"), str) else None
        if at is None:
            raise ValueError("an anchor is path#name or path#name@line")
        row = api.expand_symbol(self.spark, root, *at, opts)
        return json.dumps(row.asDict() if row else None)

    def handle(self, request: object) -> dict | None:
        """The answer; None to a notification."""
        if not isinstance(request, dict) or not isinstance(request.get("method"), str):
            return self.error(None, INVALID, "not a request")
        number, method, params = request.get("id"), request["method"], request.get("params")
        if "id" not in request:
            return None
        if params is not None and not isinstance(params, dict):
            return self.error(number, PARAMS, "params are named")
        if method == "initialize":
            return self.answer(number, {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "sylva", "version": "1"}})
        if method == "ping":
            return self.answer(number, {})
        if method == "tools/list":
            return self.answer(number, {"tools": TOOLS})
        if method == "tools/call":
            name = (params or {}).get("name")
            if name not in [t["name"] for t in TOOLS]:
                return self.answer(number, {"content": [{"type": "text", "text": f"unknown tool {name!r}"}], "isError": True})
            try:
                arguments = (params or {}).get("arguments")
                text, bad = self.call(name, {} if arguments is None else arguments), False
            except (ValueError, OSError) as e:
                text, bad = str(e), True
            return self.answer(number, {"content": [{"type": "text", "text": text}], "isError": bad})
        return self.error(number, UNKNOWN, f"unknown method {method}")

    @staticmethod
    def answer(number: object, result: dict) -> dict:
        return {"jsonrpc": "2.0", "id": number, "result": result}

    @staticmethod
    def error(number: object, code: int, message: str) -> dict:
        return {"jsonrpc": "2.0", "id": number, "error": {"code": code, "message": message}}


def serve(spark, root: str, requests: TextIO, answers: TextIO) -> None:
    server = Server(spark, root)
    for line in requests:
        if not line.strip():
            continue
        try:
            found = server.handle(json.loads(line))
        except ValueError as e:
            found = server.error(None, PARSE, str(e))
        except Exception as e:  # one failed request must not end the others
            found = server.error(None, INTERNAL, f"{type(e).__name__}: {e}")
        if found is not None:
            answers.write(json.dumps(found) + "\n")
            answers.flush()
