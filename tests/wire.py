"""Small session logs for tests."""

import json

from sessionlens.sources.logs import parse_records, wire_frames

SCHEMA = {
    "type": "object",
    "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}},
    "required": ["query"],
    "additionalProperties": False,
}


def tool(name="web_search", schema=SCHEMA, **more):
    return {"name": name, "inputSchema": schema, **more}


def c2s(**frame):
    return {"dir": "c2s", "frame": {"jsonrpc": "2.0", **frame}}


def s2c(**frame):
    return {"dir": "s2c", "frame": {"jsonrpc": "2.0", **frame}}


def handshake(tools=None, capabilities=None, info=None):
    return [
        c2s(id=1, method="initialize", params={"protocolVersion": "p", "capabilities": capabilities or {}, "clientInfo": {"name": "c"}}),
        s2c(id=1, result={"protocolVersion": "p", "capabilities": {"tools": {}}, "serverInfo": info or {"name": "test-server"}}),
        c2s(method="notifications/initialized"),
        c2s(id=2, method="tools/list"),
        s2c(id=2, result={"tools": [tool()] if tools is None else tools}),
    ]


def call(number, name="web_search", **arguments):
    return c2s(id=number, method="tools/call", params={"name": name, "arguments": arguments or {"query": "x"}})


def result(number, **body):
    return s2c(id=number, result=body or {"content": []})


def log_text(entries):
    return [
        e if isinstance(e, str) else json.dumps({"schema_version": "0.1", "seq": n, "ts": f"t{n}", "raw": None, **e})
        for n, e in enumerate(entries, 1)
    ]


def frames(spark, sessions, block_rows=4):
    """Frames of {session: entries}; tiny blocks so that carries between blocks matter."""
    rows = [
        (session, n // block_rows, n, line, False)
        for session, entries in sessions.items()
        for n, line in enumerate(log_text(entries), 1)
    ]
    lines = spark.createDataFrame(rows, "session_id string, block bigint, ord bigint, value string, tail_only boolean")
    return wire_frames(parse_records(lines))
