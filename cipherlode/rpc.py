"""Scans on request: JSON-RPC over lines of a stream, one tool."""

from __future__ import annotations

import json
import os
from typing import IO

from pyspark.sql import SparkSession

from cipherlode.plans import report, scan

PROTOCOL_VERSION = "2025-06-18"
TOOL = {
    "name": "crypto_scan", "description": "Inventory the cryptography of a JavaScript or TypeScript source tree and say which of it a large quantum computer would break.",
    "inputSchema": {"type": "object", "properties": {"directory": {"type": "string"}, "exclude": {"type": "array", "items": {"type": "string"}}, "testFiles": {"type": "array", "items": {"type": "string"}}, "detail": {"enum": ["summary", "full"]}}, "required": ["directory"]},
}


def call(spark: SparkSession, args: dict) -> dict:
    """The tool's result; what is wrong with the request is a result too."""
    from cipherlode.cli import stamp

    folder, detail = args.get("directory"), args.get("detail", "summary")
    lists = [args.get(k, []) for k in ("exclude", "testFiles")]
    if not isinstance(folder, str) or not os.path.isdir(folder):
        return {"content": [{"type": "text", "text": f"not a directory: {folder}"}], "isError": True}
    if detail not in ("summary", "full") or not all(isinstance(x, list) and all(isinstance(v, str) for v in x) for x in lists):
        return {"content": [{"type": "text", "text": "detail is summary or full; exclude and testFiles are lists of texts"}], "isError": True}
    found = scan.settled(scan.scan_folder(spark, os.path.abspath(folder), *lists))
    make = report.report if detail == "full" else report.short_view
    return {"content": [{"type": "text", "text": json.dumps(make(found, os.path.basename(os.path.abspath(folder)), stamp()), ensure_ascii=False, separators=(",", ":"))}]}


def answer(spark: SparkSession, line: str) -> dict | None:
    """The reply to one line; none to a notification."""
    try:
        asked = json.loads(line)
    except ValueError:
        return {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
    if not isinstance(asked, dict) or asked.get("jsonrpc") != "2.0" or not isinstance(asked.get("method"), str):
        return {"jsonrpc": "2.0", "id": asked.get("id") if isinstance(asked, dict) else None, "error": {"code": -32600, "message": "not a request"}}
    if "id" not in asked:
        return None
    method, params = asked["method"], asked.get("params") or {}
    done = {"jsonrpc": "2.0", "id": asked["id"]}
    if method == "initialize":
        return done | {"result": {"protocolVersion": PROTOCOL_VERSION, "capabilities": {"tools": {}}, "serverInfo": report.TOOL}}
    if method == "ping":
        return done | {"result": {}}
    if method == "tools/list":
        return done | {"result": {"tools": [TOOL]}}
    if method == "tools/call":
        if params.get("name") != TOOL["name"]:
            return done | {"error": {"code": -32602, "message": "no such tool"}}
        return done | {"result": call(spark, params.get("arguments") or {})}
    return done | {"error": {"code": -32601, "message": "no such method"}}


def listen(spark: SparkSession, lines: IO[str], out: IO[str]) -> int:
    for line in lines:
        if line.strip() and (reply := answer(spark, line)) is not None:
            out.write(json.dumps(reply, ensure_ascii=False, separators=(",", ":")) + "\n")
            out.flush()
    return 0
