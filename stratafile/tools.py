"""The catalogue's tools by name, with JSON in and out, and a server for them over standard input and output (JSON-RPC 2.0, one message a line)."""

from __future__ import annotations

import inspect
import json
import sys
from collections.abc import Callable
from dataclasses import asdict, is_dataclass
from typing import IO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .api import Catalogue
from .errors import CatalogueError, InputError

#: Tool names and the facade's methods.
TOOLS: dict[str, str] = {
    "status": "status", "drive_list": "drive_list", "space_check": "space_check", "drive_add": "drive_add", "scan": "scan", "dedup_refresh": "dedup_refresh", "rmlint_import": "rmlint_import", "query_duplicates": "query_duplicates",
    "query_unclassified": "query_unclassified", "query_files": "query_files", "query_backup_unique": "query_backup_unique", "classify_auto": "classify_auto", "classify": "classify", "classify_pattern": "classify_pattern",
    "plan_create": "plan_create", "plan_show": "plan_show", "policy_validate": "policy_validate", "policy_show": "policy_show", "policy_apply": "policy_apply", "plan_approve": "plan_approve", "migrate_execute": "migrate_execute",
    "rollback": "rollback", "verify": "verify", "report": "report",
}


def arguments(method: Callable) -> dict:
    """The method's arguments as a JSON schema."""
    names = {"str": "string", "int": "integer", "bool": "boolean"}
    found = {n: p for n, p in inspect.signature(method).parameters.items() if n != "self" and p.kind in (p.POSITIONAL_OR_KEYWORD, p.KEYWORD_ONLY) and str(p.annotation).split(" |")[0] in names}
    return {"type": "object", "properties": {n: {"type": names[str(p.annotation).split(" |")[0]]} for n, p in found.items()}, "required": [n for n, p in found.items() if p.default is p.empty]}


def as_json(result: object) -> str:
    """A tool's result as JSON: a frame as a list of all its rows, in its order."""
    if isinstance(result, DataFrame):
        rows = result.select(F.to_json(F.struct("*")).alias("row")).toLocalIterator() if result.columns else []
        return "[" + ",\n".join(r["row"] for r in rows) + "]"
    return json.dumps(asdict(result) if is_dataclass(result) else result, default=str)


def call(catalogue: Catalogue, tool: str, args: dict | None = None) -> str:
    """The tool's answer as JSON text."""
    if tool not in TOOLS:
        raise InputError(f"unknown tool {tool!r}")
    method = getattr(catalogue, TOOLS[tool])
    try:
        inspect.signature(method).bind(**(args or {}))
    except TypeError as e:
        raise InputError(f"{tool}: {e}") from e
    return as_json(method(**(args or {})))


def serve(catalogue: Catalogue, lines: IO[str] = sys.stdin, out: IO[str] = sys.stdout) -> None:
    """Answers initialize, tools/list and tools/call until the input ends; errors of tools are answers, too."""
    for line in filter(str.strip, lines):
        try:
            ask = json.loads(line)
        except ValueError:
            ask = {"id": None, "method": None}
        if not isinstance(ask, dict) or "id" not in ask:
            continue  # a notification
        method, params = ask.get("method"), ask.get("params") or {}
        answer: dict = {"jsonrpc": "2.0", "id": ask["id"]}
        if method == "initialize":
            answer["result"] = {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "stratafile", "version": "1"}}
        elif method == "tools/list":
            answer["result"] = {"tools": [{"name": n, "description": (inspect.getdoc(getattr(Catalogue, m)) or n) if callable(getattr(Catalogue, m)) else n, "inputSchema": arguments(getattr(Catalogue, m))} for n, m in TOOLS.items()]}
        elif method == "tools/call":
            try:
                text, bad = call(catalogue, params.get("name"), params.get("arguments")), False
            except (CatalogueError, ValueError, OSError) as e:
                text, bad = f"{type(e).__name__}: {e}", True
            answer["result"] = {"content": [{"type": "text", "text": text}], "isError": bad}
        else:
            answer["error"] = {"code": -32601 if method else -32700, "message": f"unknown method {method}" if method else "no JSON"}
        print(json.dumps(answer), file=out, flush=True)
