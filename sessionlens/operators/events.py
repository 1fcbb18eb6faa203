"""Frames to typed events: classification, request/response pairing, causal parents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.jsonvalue import field, identity_key, is_object, present, text_at
from ..plans.blocks import computed_once, with_previous

FRAME_COLUMNS = [
    "session_id", "block", "ord", "seq", "ts", "dir", "frame", "raw", "gate",
]


#: What classification adds to the columns of a frame.
ROLE_TYPES = (
    "parsed boolean, has_method boolean, method string, no_id boolean, id_key string, request_id string, "
    "answers boolean, has_error boolean, role string, pair_space string, call_name string"
)


def with_roles(frames: DataFrame, *keep: str) -> DataFrame:
    """Every frame with its role on the wire, null if it becomes no event; ``keep`` names
    further columns to carry along.

    Roles: raw, call, client_note, client_reply, client_request, server_message,
    response.  Lines with neither an object frame nor raw text, and object frames
    of an unknown direction, give no event.
    """
    frame = F.col("frame")
    # one cast takes the members an event's role depends on; it is null for no object
    top = "struct<method:variant,id:variant,result:variant,error:variant>"
    opened = computed_once(
        frames.select(*FRAME_COLUMNS, *keep), F.try_variant_get(frame, "$", top).alias("top")
    )
    request_id = F.col("top.id")
    parsed = computed_once(
        opened,
        F.col("top").isNotNull().alias("parsed"),
        present(F.col("top.method")).alias("has_method"),
        text_at(F.col("top.method"), "$").alias("method"),
        request_id.isNull().alias("no_id"),
        identity_key(request_id).alias("id_key"),
        F.when(present(request_id), text_at(request_id, "$")).alias("request_id"),
        (F.col("top.result").isNotNull() | F.col("top.error").isNotNull()).alias("answers"),
        present(F.col("top.error")).alias("has_error"),
    ).drop("top")
    role = (
        F.when(F.expr("NOT parsed AND raw IS NOT NULL"), "raw")
        .when(F.expr("NOT parsed OR dir IS NULL OR dir NOT IN ('c2s', 's2c')"), None)
        .when(F.expr("dir = 'c2s' AND method = 'tools/call'"), "call")
        .when(F.expr("dir = 'c2s' AND has_method AND no_id"), "client_note")
        .when(F.expr("dir = 'c2s' AND NOT has_method AND answers"), "client_reply")
        .when(F.expr("dir = 'c2s'"), "client_request")
        .when(F.col("has_method"), "server_message")
        .otherwise("response")
    )
    space = (
        F.when(F.col("id_key").isNull(), None)
        .when(F.col("role") == "call", "client")
        .when((F.col("role") == "client_request") & F.col("has_method") & (F.col("method") != ""), "client")
        .when(F.col("role") == "response", "client")
        .when(F.col("role").isin("server_message", "client_reply"), "server")
    )
    return (
        parsed.withColumn("role", role)
        .withColumn("pair_space", space)
        .withColumn(
            "call_name",
            F.when(
                F.col("role") == "call", F.coalesce(text_at(frame, "$.params.name"), F.lit("?"))
            ),
        )
    )


def classify_frames(frames: DataFrame, *keep: str) -> DataFrame:
    """One row per frame that becomes an event, with its role; see ``with_roles``."""
    return with_roles(frames, *keep).filter("role IS NOT NULL")


def calls_of(lines: DataFrame) -> DataFrame:
    """Tool calls of classified lines, with tool name and arguments."""
    arguments = field(F.col("frame"), "$.params.arguments")
    return lines.filter("role = 'call'").select(
        "session_id", "block", "ord", "seq", "ts", "request_id",
        F.col("call_name").alias("tool_name"),
        F.coalesce(arguments, F.parse_json(F.lit("{}"))).alias("args"),
    )


def build_events(lines: DataFrame, strict_call_kind: bool = False) -> DataFrame:
    """Typed events of classified lines.

    A response answers the row just before it in its (session, initiator, id)
    group when that row is a request: the latest open request wins and is used
    once.  With ``strict_call_kind`` a response counts as a tool result whenever a
    call was answered; by default a tool whose name starts with ``<`` is taken for
    a protocol method, as recorded logs expect.
    """
    opens = F.col("role").isin("call", "client_request", "server_message")
    label = F.coalesce("call_name", F.concat(F.lit("<"), F.col("method"), F.lit(">")))
    paired = with_previous(
        lines,
        ["session_id", "pair_space", "id_key"],
        F.struct(
            opens.alias("opens"),
            (F.col("role") == "call").alias("call"),
            label.alias("label"),
            F.col("ord"),
            F.col("seq"),
        ),
        "before",
    )
    is_answer = F.col("role").isin("response", "client_reply")
    matched = is_answer & F.col("pair_space").isNotNull() & F.coalesce(F.col("before.opens"), F.lit(False))
    real_call = F.col("before.call") if strict_call_kind else ~F.col("before.label").startswith("<")
    real_call = real_call & (F.col("before.label") != "")  # a call without a tool name has no tool result
    frame = F.col("frame")
    error = field(frame, "$.error")
    kind = (
        F.when(F.col("role") == "call", "tool_call")
        .when((F.col("role") == "response") & F.col("matched") & real_call, "tool_result")
        .when(F.col("role") == "response", "state_change")
        .otherwise("message")
    )
    part_kind = (
        F.when(F.col("role") == "raw", "text")
        .when(F.col("kind") == "tool_call", "tool_use")
        .when(F.col("kind") == "tool_result", "tool_result")
        .when((F.col("kind") == "state_change") & F.col("has_error"), "error")
        .otherwise("json")
    )
    return (
        paired.withColumn("matched", matched)
        .withColumn("kind", kind)
        .withColumn("part_kind", part_kind)
        .select(
            "session_id", "block", "ord", "seq", "ts",
            F.when(F.expr("dir = 'c2s'"), "client").otherwise("server").alias("actor"),
            "role", "kind", "part_kind", "method", "request_id",
            F.when(F.col("kind") == "tool_call", F.col("call_name"))
            .when(F.col("kind") == "tool_result", F.col("before.label"))
            .alias("tool_name"),
            F.when(
                F.col("kind") == "tool_call",
                F.coalesce(field(frame, "$.params.arguments"), F.parse_json(F.lit("{}"))),
            ).alias("args"),
            F.when(F.col("matched"), F.col("before.label")).alias("responds_to"),
            F.when(F.col("matched"), F.struct("before.ord", "before.seq")).alias("request"),
            (is_answer & F.col("pair_space").isNotNull() & ~F.col("matched")).alias("orphaned"),
            "has_error",
            (
                (F.col("kind") == "tool_result")
                & (
                    F.col("has_error")
                    | F.coalesce(F.try_variant_get(frame, "$.result.isError", "boolean"), F.lit(False))
                )
            ).alias("is_error"),
            F.when(
                F.col("part_kind") == "error",
                F.coalesce(text_at(frame, "$.error.message"), F.to_json(error)),
            ).alias("error_message"),
            (F.col("role") == "server_message").alias("server_initiated"),
            (
                (F.col("role") == "client_note")
                | ((F.col("role") == "server_message") & F.col("no_id"))
            ).alias("notification"),
            (F.col("role") == "raw").alias("unparsed"),
            frame,
            "raw",
            "gate",
        )
    )


def with_parents(events: DataFrame) -> DataFrame:
    """Add ``parent``: the answered request, else the event just before in the session."""
    position = F.struct("ord", "seq")
    return with_previous(events, ["session_id"], position, "_previous").withColumn(
        "parent", F.coalesce("request", "_previous")
    ).drop("_previous")


def declared_tools(lines: DataFrame) -> DataFrame:
    """Every tool definition in any server result, whichever request it answers."""
    tools = F.try_variant_get(F.col("frame"), "$.result.tools", "array<variant>")
    definition = F.col("tool_def")
    return (
        lines.filter("role = 'response'")
        .select("session_id", "block", "ord", "seq", F.posexplode(tools).alias("pos", "tool_def"))
        .withColumn("tool_name", text_at(definition, "$.name"))
        .filter("tool_name IS NOT NULL")
        .withColumn("description", text_at(definition, "$.description"))
        .withColumn("input_schema", field(definition, "$.inputSchema"))
    )


def client_hello(lines: DataFrame) -> DataFrame:
    """Capabilities and identity of the last initialize request of each session."""
    frame = F.col("frame")
    offered = F.coalesce(field(frame, "$.params.capabilities"), F.parse_json(F.lit("{}")))
    hello = F.struct(
        F.to_json(offered).alias("client_capabilities"),
        F.to_json(field(frame, "$.params.clientInfo")).alias("client_info"),
    )
    return (
        lines.filter("role IN ('client_note', 'client_request') AND method = 'initialize'")
        .groupBy("session_id")
        .agg(F.max_by(hello, "ord").alias("hello"))
        .select("session_id", "hello.*")
    )


def server_welcome(events: DataFrame) -> DataFrame:
    """What the last matched initialize result of each session says of the server."""
    frame = F.col("frame")
    result = field(frame, "$.result")
    offered = F.coalesce(field(frame, "$.result.capabilities"), F.parse_json(F.lit("{}")))
    welcome = F.struct(
        F.to_json(offered).alias("server_capabilities"),
        F.to_json(field(frame, "$.result.serverInfo")).alias("server_info"),
        text_at(frame, "$.result.serverInfo.name").alias("server_name"),
        text_at(frame, "$.result.serverInfo.version").alias("server_version"),
        text_at(frame, "$.result.protocolVersion").alias("protocol_version"),
    )
    return (
        events.filter("role = 'response' AND responds_to = '<initialize>'")
        .filter(is_object(result))
        .groupBy("session_id")
        .agg(F.max_by(welcome, "ord").alias("welcome"))
        .select("session_id", "welcome.*")
    )


def listings(events: DataFrame) -> DataFrame:
    """Matched tools/list results with their sorted set of tool names."""
    tools = F.try_variant_get(F.col("frame"), "$.result.tools", "array<variant>")
    names = F.filter(F.transform(tools, lambda t: text_at(t, "$.name")), lambda n: n.isNotNull())
    return (
        events.filter("role = 'response' AND kind = 'state_change' AND responds_to = '<tools/list>'")
        .filter("NOT has_error")
        .select("session_id", "block", "ord", "seq", F.array_sort(F.array_distinct(names)).alias("names"))
        .filter("names IS NOT NULL")
    )


def handshake_steps(lines: DataFrame, events: DataFrame) -> DataFrame:
    """Positions of the first end of handshake, listing request and listing per session.

    Only minima of a number, so a hot session shrinks to one row per map task.
    """
    asked = lines.filter("method IN ('notifications/initialized', 'tools/list')").select(
        "session_id",
        F.expr("CASE WHEN method = 'notifications/initialized' AND role <> 'call' THEN ord END").alias("initialized"),
        F.expr(
            "CASE WHEN method = 'tools/list' AND role IN ('client_note', 'client_request') THEN ord END"
        ).alias("list_request"),
        F.lit(None).cast("bigint").alias("listing"),
    )
    none = F.lit(None).cast("bigint")
    answered = listings(events).select("session_id", none, none, "ord")
    return (
        asked.union(answered)
        .groupBy("session_id")
        .agg(
            F.min("initialized").alias("first_initialized"),
            F.min("list_request").alias("first_list_request"),
            F.min("listing").alias("first_listing"),
        )
    )


def session_context(lines: DataFrame, events: DataFrame) -> DataFrame:
    """One row per session: negotiated context, outcome, first and last time stamp."""
    stamped = F.coalesce(F.col("ts"), F.lit("")) != ""
    at = F.when(stamped, F.col("ord"))
    spans = lines.groupBy("session_id").agg(
        F.coalesce(F.min_by("ts", at), F.lit("")).alias("first_ts"),
        F.coalesce(F.max_by("ts", at), F.lit("")).alias("last_ts"),
        F.count("*").alias("event_count"),
        F.when(F.max(F.expr("role = 'response' AND has_error")), "failed")
        .otherwise("completed")
        .alias("final_state"),
    )
    return spans.join(client_hello(lines), "session_id", "left").join(
        server_welcome(events), "session_id", "left"
    )


def gate_marks(frames: DataFrame) -> DataFrame:
    """The last gate marker of each (session, seq)."""
    return (
        frames.filter(F.col("seq").isNotNull() & F.col("gate").isNotNull())
        .filter(is_object(F.col("gate")))
        .groupBy("session_id", "seq")
        .agg(F.max_by(F.to_json("gate"), "ord").alias("gate_json"))
        .withColumn("gate_mark", F.parse_json("gate_json"))
        .drop("gate_json")
    )


def with_gate(events: DataFrame, frames: DataFrame) -> DataFrame:
    """Stamp events with the gate marker of their seq."""
    return events.join(gate_marks(frames), ["session_id", "seq"], "left")
