"""Detectors: each one is a plan from session tables to findings."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.catalogue import ScanConfig
from ..functions.hosts import egress_hosts, is_trusted
from ..functions.jsonvalue import field as json_field
from ..functions.jsonvalue import members, schema_parts, schema_problems, text_at
from ..functions.scan import hits, tag
from ..plans.blocks import computed_once, keep_matching, spread_join
from ..plans.durable import written
from .events import (
    build_events,
    calls_of,
    classify_frames,
    client_hello,
    declared_tools,
    gate_marks,
    handshake_steps,
    listings,
    server_welcome,
    session_context,
)

# Capability each known server request needs, and requests that need none.
REQUEST_CAPABILITY = {
    "sampling/createMessage": "sampling",
    "roots/list": "roots",
    "elicitation/create": "elicitation",
}
FREE_REQUESTS = ("ping",)

FINDING_COLUMNS = [
    "session_id", "block", "ord", "seq", "kind", "category", "subcategory",
    "severity", "explanation", "tool", "detail",
]


@dataclass(frozen=True)
class Sessions:
    """The tables every detector reads, derived once from a frames table."""

    frames: DataFrame
    config: ScanConfig = field(default_factory=ScanConfig)
    strict_call_kind: bool = False

    lines_table: DataFrame | None = None
    events_table: DataFrame | None = None

    @cached_property
    def lines(self) -> DataFrame:
        return self.lines_table if self.lines_table is not None else classify_frames(self.frames)

    @cached_property
    def events(self) -> DataFrame:
        if self.events_table is not None:
            return self.events_table
        return build_events(self.lines, self.strict_call_kind)

    def stored(self) -> Sessions:
        """The same sessions with lines and events written once to the shared folder.

        Parsing and pairing then happen once however many detectors follow, and
        each detector reads only its columns.
        """
        lines = written(self.lines)
        once = replace(self, lines_table=lines)
        return replace(once, events_table=written(once.events))

    @cached_property
    def calls(self) -> DataFrame:
        return calls_of(self.lines)

    @cached_property
    def declared(self) -> DataFrame:
        return declared_tools(self.lines)

    @cached_property
    def context(self) -> DataFrame:
        return session_context(self.lines, self.events)

    @cached_property
    def declared_names(self) -> DataFrame:
        return self.declared.select("session_id", "tool_name").distinct()


def finding(
    rows: DataFrame,
    kind: Column | str,
    subcategory: Column | str,
    severity: Column | int,
    explanation: Column,
    tool: Column | None = None,
    category: str | None = None,
    **detail: Column,
) -> DataFrame:
    """Rows as findings; ``detail`` columns become one string map."""

    def column(value):
        return value if isinstance(value, Column) else F.lit(value)

    entries = [x for k, v in detail.items() for x in (F.lit(k), v.cast("string"))]
    empty = F.lit(None).cast("map<string,string>")
    return rows.select(
        "session_id", "block", "ord", "seq",
        column(kind).alias("kind"),
        F.lit(category).cast("string").alias("category"),
        column(subcategory).alias("subcategory"),
        column(severity).cast("int").alias("severity"),
        explanation.alias("explanation"),
        (tool if tool is not None else F.lit(None).cast("string")).alias("tool"),
        (F.create_map(*entries) if entries else empty).alias("detail"),
    )


def fabricated_calls(s: Sessions) -> DataFrame:
    """Calls of tools the session never declares, before or after."""
    group = ["session_id", "tool_name"]
    sized = s.declared.groupBy("session_id").agg(F.lit(True).alias("any_declared"))
    # decided once per (session, tool) and block, then joined back to the calls
    strange = (
        s.calls.select(*group, "block").distinct()
        .join(s.declared_names, group, "left_anti")
        .join(sized, "session_id", "left")
    )
    rows = keep_matching(s.calls, strange, [*group, "block"])
    return finding(
        rows, "hallucination", "fabricated_tool_call", 3,
        F.format_string("tools/call '%s' is outside the declared surface", "tool_name"),
        tool=F.col("tool_name"), category="tool_use",
        no_declaration_seen=F.col("any_declared").isNull(),
    )


def call_order(s: Sessions) -> DataFrame:
    """Calls before the handshake ended, and calls without any listing asked for."""
    steps = handshake_steps(s.lines, s.events)

    def seen(step: str) -> Column:
        return F.coalesce(F.col(step) < F.col("ord"), F.lit(False))

    rows = spread_join(s.calls, steps, ["session_id"]).withColumn(
        "problem",
        F.when(~seen("first_initialized"), "premature_call").when(
            ~seen("first_listing") & ~seen("first_list_request"), "call_before_declaration"
        ),
    ).filter("problem IS NOT NULL")
    early = F.col("problem") == "premature_call"
    return finding(
        rows, "anomaly", F.col("problem"), F.when(early, 2).otherwise(1),
        F.when(
            early, F.format_string("tools/call '%s' before notifications/initialized", "tool_name")
        ).otherwise(
            F.format_string("tools/call '%s' and no tools/list request was ever sent", "tool_name")
        ),
        tool=F.col("tool_name"),
    )


def schema_violations(s: Sessions) -> DataFrame:
    """One finding per problem of a call's arguments against its tool's first schema."""
    first_schema = (
        s.declared.groupBy("session_id", "tool_name")
        .agg(F.min_by("input_schema", F.struct("ord", "pos")).alias("schema"))
        .select("session_id", "tool_name", *schema_parts(F.col("schema")))
        # a schema that asks for nothing still asks for an object
        .filter("applies")
    )
    checked = computed_once(
        spread_join(s.calls, first_schema, ["session_id", "tool_name"], "inner"),
        members(F.col("args")).alias("given"),
    )
    rows = computed_once(checked, schema_problems("args").alias("problems")).withColumn(
        "problem", F.explode("problems")
    )
    return finding(
        rows, "divergence", "schema_violation", 2,
        F.format_string("'%s': %s", "tool_name", "problem"),
        tool=F.col("tool_name"), category="tool_use",
    )


def server_requests(s: Sessions) -> DataFrame:
    """Server requests the client never granted, or that no client capability covers."""
    need = F.create_map(*[F.lit(x) for pair in REQUEST_CAPABILITY.items() for x in pair])
    asked = (
        s.lines.filter("role = 'server_message' AND NOT no_id")
        .filter(~F.col("method").isin(*FREE_REQUESTS))
        .withColumn("need", F.try_element_at(need, F.col("method")))
    )
    granted = client_hello(s.lines)
    rows = (
        spread_join(asked, granted, ["session_id"])
        .withColumn("granted", F.json_object_keys("client_capabilities"))
        .filter(
            "need IS NULL OR (client_capabilities IS NOT NULL AND "
            "NOT array_contains(coalesce(granted, array()), need))"
        )
    )
    known = F.col("need").isNotNull()
    return finding(
        rows, "anomaly",
        F.when(known, "capability_violation").otherwise("unknown_server_request"),
        F.when(known, 3).otherwise(2),
        F.when(
            known,
            F.format_string(
                "server requested '%s' but the client never granted the '%s' capability",
                "method", "need",
            ),
        ).otherwise(
            F.format_string(
                "server-initiated request '%s' is not a known MCP client capability", "method"
            )
        ),
        method=F.col("method"),
    )


def orphaned_responses(s: Sessions) -> DataFrame:
    """Responses whose id matched no open request, in either direction."""
    rows = s.events.filter("orphaned")
    return finding(
        rows, "anomaly", "orphaned_response", 1,
        F.format_string("response id=%s matched no request", "request_id"),
    )


def surface_changes(s: Sessions) -> DataFrame:
    """tools/list results that differ from the first one of the session."""
    listed = listings(s.events)
    first = listed.groupBy("session_id").agg(F.min_by("names", "ord").alias("first_names"))
    delta = F.array_sort(
        F.array_union(
            F.array_except("names", "first_names"), F.array_except("first_names", "names")
        )
    )
    rows = (
        spread_join(listed, first, ["session_id"])
        .withColumn("delta", delta)
        .filter(F.size("delta") > 0)
        .withColumn("shown", F.concat(F.lit("['"), F.array_join("delta", "', '"), F.lit("']")))
    )
    return finding(
        rows, "divergence", "surface_change", 2,
        F.format_string("tools/list surface changed mid-session; delta: %s", "shown"),
        delta=F.array_join("delta", ", "),
    )


def gate_actions(s: Sessions) -> DataFrame:
    """Records of frames the gate blocked, answered itself or let through unchecked."""
    mark = F.col("gate_mark")
    action = text_at(mark, "$.action")
    tool = F.coalesce(text_at(mark, "$.tool"), F.lit("None"))
    rows = (
        keep_matching(s.lines, gate_marks(s.frames), ["session_id", "seq"])
        .withColumn("action", action)
        .withColumn("gated_tool", tool)
        .filter(F.col("action").isin("blocked", "injected", "gate_skipped"))
    )
    blocked = F.format_string(
        "gate blocked tools/call '%s' — outside the declared surface; the server never saw this frame",
        "gated_tool",
    )
    injected = F.format_string(
        "error response synthesized by the gate for blocked call '%s'; the server never sent this frame",
        "gated_tool",
    )
    skipped = F.format_string(
        "gate failed open for tools/call '%s' — no tools/list response arrived within the hold "
        "window, so this call was forwarded unenforced",
        "gated_tool",
    )
    return finding(
        rows, "info",
        F.when(F.col("action") == "blocked", "gate_blocked")
        .when(F.col("action") == "injected", "gate_injected_response")
        .otherwise("gate_skipped"),
        1,
        F.when(F.col("action") == "blocked", blocked)
        .when(F.col("action") == "injected", injected)
        .otherwise(skipped),
        tool=text_at(mark, "$.tool"),
        reason=text_at(mark, "$.reason"),
    )


def argument_hits(s: Sessions) -> DataFrame:
    """Calls with the sensitive values of their arguments."""
    texts = computed_once(
        s.calls.select("session_id", "block", "ord", "seq", "tool_name", "args"),
        F.to_json("args").alias("text"),
    )
    return computed_once(texts, hits(F.col("text"), s.config).alias("hits"))


def argument_leaks(s: Sessions) -> DataFrame:
    """Sensitive values in call arguments, one finding per category and value."""
    rows = argument_hits(s).select(
        "session_id", "block", "ord", "seq", "tool_name", F.explode("hits").alias("hit")
    )
    return finding(
        rows, "divergence", F.concat(F.lit("pii_"), F.col("hit.category")), F.col("hit.severity"),
        F.format_string(
            "tools/call '%s' argument contains %s: %s",
            F.col("tool_name"),
            s.config.description_of(F.col("hit.category")),
            tag(F.col("hit.value"), F.col("hit.category")),
        ),
        tool=F.col("tool_name"), category="tool_use",
        pii_category=F.col("hit.category"),
    )


def declared_hosts(s: Sessions) -> DataFrame:
    """Hosts the server itself named: its identity, tool descriptions and schemas."""
    in_tools = s.declared.select(
        "session_id",
        F.explode(
            F.array_union(
                F.coalesce(egress_hosts(json_field(F.col("tool_def"), "$.description")), F.array()),
                F.coalesce(egress_hosts(F.col("input_schema")), F.array()),
            )
        ).alias("host"),
    )
    in_identity = server_welcome(s.events).select(
        "session_id", F.explode(egress_hosts(F.try_parse_json("server_info"))).alias("host")
    )
    return in_tools.union(in_identity).distinct()


def egress(s: Sessions) -> DataFrame:
    """Calls that reach a host the server never declared."""
    naming = computed_once(
        s.calls.select("session_id", "block", "ord", "seq", "tool_name", "args"),
        egress_hosts(F.col("args")).alias("hosts"),
    ).filter(F.size("hosts") > 0)
    scanned = computed_once(naming, hits(F.to_json("args"), s.config).alias("hits"))
    reached = scanned.select(
        "session_id", "block", "ord", "seq", "tool_name",
        F.exists("hits", lambda h: h.severity >= 2).alias("sensitive"),
        F.explode("hosts").alias("host"),
    )
    named = declared_hosts(s).withColumn("declared", F.lit(True))
    rows = (
        spread_join(reached, named, ["session_id", "host"])
        .filter("declared IS NULL")
        .withColumn("trusted", is_trusted(F.col("host")))
        .filter("sensitive OR NOT trusted")
    )
    return finding(
        rows, "anomaly", "unexpected_egress_host",
        F.when(F.expr("sensitive AND NOT trusted"), 3).otherwise(2),
        F.format_string(
            "tools/call '%s' reaches %s%s%s",
            F.col("tool_name"), F.col("host"),
            F.when(F.col("trusted"), " (allowlisted)").otherwise(" (undeclared)"),
            F.when(F.col("sensitive"), " CARRYING SENSITIVE DATA").otherwise(""),
        ),
        tool=F.col("tool_name"),
        host=F.col("host"), has_pii=F.col("sensitive"), trusted=F.col("trusted"),
    )


def result_text(frame: Column) -> Column:
    """The scanned text of a tool result: id, output and error flag."""
    output = F.coalesce(
        F.when(F.col("has_error"), json_field(frame, "$.error")).otherwise(
            json_field(frame, "$.result")
        ),
        F.parse_json(F.lit("null")),
    )
    return F.to_json(
        F.array(
            F.struct(
                F.col("request_id").alias("tool_use_id"),
                output.alias("output"),
                F.col("is_error").alias("is_error"),
            )
        )
    )


def result_leaks(s: Sessions) -> DataFrame:
    """Severity-3 values that come back in tool results."""
    texts = computed_once(
        s.events.filter("kind = 'tool_result'"), result_text(F.col("frame")).alias("text")
    )
    rows = (
        computed_once(texts, hits(F.col("text"), s.config).alias("hits"))
        .withColumn("hit", F.explode("hits"))
        .filter("hit.severity >= 3")
    )
    return finding(
        rows, "divergence", F.concat(F.lit("pii_in_result_"), F.col("hit.category")), 3,
        F.concat(F.lit("tool result leaks "), s.config.description_of(F.col("hit.category"))),
        tool=F.col("tool_name"), category="tool_use",
        pii_category=F.col("hit.category"),
    )


Detector = Callable[[Sessions], DataFrame]

DETECTORS: tuple[Detector, ...] = (
    fabricated_calls,
    surface_changes,
    call_order,
    schema_violations,
    server_requests,
    orphaned_responses,
    gate_actions,
    argument_leaks,
    egress,
    result_leaks,
)


def _failure(s: Sessions, detector: Detector, problem: Exception) -> DataFrame:
    """A detector whose plan cannot be built is itself a finding of every session."""
    rows = s.frames.select("session_id").distinct().select(
        "session_id",
        F.lit(None).cast("bigint").alias("block"),
        F.lit(None).cast("bigint").alias("ord"),
        F.lit(None).cast("bigint").alias("seq"),
    )
    name = detector.__name__
    return finding(
        rows, "anomaly", "detector_error", 2,
        F.lit(f"detector '{name}' raised {type(problem).__name__}: {problem}"),
        detector=F.lit(name), error_type=F.lit(type(problem).__name__),
    )


def detect(s: Sessions, detectors: Sequence[Detector] = DETECTORS) -> DataFrame:
    """All findings: the bag union of the detectors' outputs.

    A detector that fails while its plan is made gives a detector_error finding and
    the others still run.  Row-level faults cannot fail a plan: every parse in the
    detectors is of the try_ kind.
    """
    plans = []
    for detector in detectors:
        try:
            plans.append(detector(s).select(*FINDING_COLUMNS))
        except Exception as problem:  # noqa: BLE001
            plans.append(_failure(s, detector, problem))
    return reduce(DataFrame.unionByName, plans)
