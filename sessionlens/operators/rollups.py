"""Summaries per session, tool and log directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.jsonvalue import field, text_at
from ..plans.blocks import with_row_number
from ..plans.durable import with_dense_number
from .detectors import Sessions
from .events import with_gate

# The verdict of a session by its highest severity.
VERDICTS = {
    0: ("CLEAN", "behavior matched declaration"),
    1: ("WORTH A LOOK", "low-severity anomalies present"),
    2: ("SHOULD NOT HAPPEN", "protocol contract broken"),
    3: ("HOSTILE OR HALLUCINATED", "calls or requests outside any declaration"),
}
# Severity words on the three-step scale, and report levels.
SEVERITY_WORDS = {"critical": 3, "high": 3, "medium": 2, "low": 1, "note": 1, "info": 1}
LEVELS = {3: "error", 2: "warning", 1: "note"}
# Fixed value: how long a log counts as live.
LIVE_SECONDS = 5


def _lookup(pairs: dict, key: Column) -> Column:
    entries = [F.lit(x) for pair in pairs.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), key)


def severity_number(severity: Column) -> Column:
    """A severity word or number on the 1-3 scale; unknown values count as 2."""
    text = F.lower(severity.cast("string"))
    number = F.when(text.rlike("^[123]$"), text.cast("int"))
    return F.coalesce(number, _lookup(SEVERITY_WORDS, text), F.lit(2))


def severity_level(severity: Column) -> Column:
    return _lookup(LEVELS, severity_number(severity))


def at_least(findings: DataFrame, floor: int = 2) -> DataFrame:
    """Findings at or above a severity, whichever vocabulary they use."""
    return findings.filter(severity_number(F.col("severity")) >= floor)


def verdicts(sessions: DataFrame, findings: DataFrame) -> DataFrame:
    """Verdict of every session; informational findings never count."""
    counts = findings.filter("kind <> 'info'").groupBy("session_id").agg(
        F.max("severity").alias("max_severity"),
        *[F.count_if(F.col("severity") == n).alias(f"severity_{n}") for n in (3, 2, 1)],
    )
    worst = F.coalesce("max_severity", F.lit(0))
    return sessions.join(counts, "session_id", "left").select(
        "session_id",
        worst.alias("max_severity"),
        _lookup({n: v for n, (v, _) in VERDICTS.items()}, worst).alias("verdict"),
        _lookup({n: t for n, (_, t) in VERDICTS.items()}, worst).alias("verdict_text"),
        *[F.coalesce(f"severity_{n}", F.lit(0)).alias(f"severity_{n}") for n in (3, 2, 1)],
    )


def session_summary(s: Sessions, violations: DataFrame) -> DataFrame:
    """Counts of one session: frames, surface, calls and how they differ."""
    lines = s.lines.groupBy("session_id").agg(
        F.count_if(F.col("role") != "raw").alias("frames_parsed")
    )
    tools = (
        s.calls.groupBy("session_id", "tool_name").agg(F.count("*").alias("calls"))
        .join(s.declared_names.withColumn("declared", F.lit(1)), ["session_id", "tool_name"], "full")
        .groupBy("session_id")
        .agg(
            F.sum(F.coalesce("declared", F.lit(0))).alias("declared_tools"),
            F.sum(F.coalesce("calls", F.lit(0))).alias("calls"),
            F.count_if(F.expr("calls IS NOT NULL")).alias("called_tools"),
            F.count_if(F.expr("calls IS NULL")).alias("unused_declared"),
            F.sum(F.expr("CASE WHEN declared IS NULL THEN calls ELSE 0 END")).alias("fabricated_calls"),
        )
    )
    broken = violations.groupBy("session_id").agg(F.count("*").alias("context_violations"))
    return (
        lines.join(tools, "session_id", "left")
        .join(broken, "session_id", "left")
        .na.fill(0)
    )


def fabricated_rows(s: Sessions) -> DataFrame:
    """Every call of a tool that its session never declares: ``session_id, ord, seq, tool``."""
    strange = s.calls.join(s.declared_names, ["session_id", "tool_name"], "left_anti")
    return strange.select("session_id", "ord", "seq", F.col("tool_name").alias("tool"))


def error_taxonomy(events: DataFrame) -> DataFrame:
    """Protocol errors and failed tool results, one row each, kept apart."""
    frame = F.col("frame")
    output = F.when(F.col("has_error"), field(frame, "$.error")).otherwise(field(frame, "$.result"))
    failed = F.coalesce(text_at(output, "$.message"), F.to_json(output))
    return events.filter("part_kind = 'error' OR is_error").select(
        "session_id", "seq",
        F.when(F.col("part_kind") == "error", "protocol_error").otherwise("tool_error").alias("error_kind"),
        F.when(F.col("part_kind") == "error", F.col("error_message")).otherwise(failed).alias("message"),
    )


def _worst_per_event(findings: DataFrame) -> DataFrame:
    return (
        findings.filter("kind <> 'info'")
        .groupBy("session_id", "ord")
        .agg(F.max("severity").alias("event_severity"))
    )


def tool_heatmap(s: Sessions, findings: DataFrame) -> DataFrame:
    """Calls, errors and worst severity of every called tool of every session."""
    touched = (
        s.events.filter("kind IN ('tool_call', 'tool_result')")
        .join(_worst_per_event(findings), ["session_id", "ord"], "left")
        .groupBy("session_id", "tool_name")
        .agg(
            F.count_if(F.expr("kind = 'tool_call'")).alias("calls"),
            F.count_if("is_error").alias("errors"),
            F.coalesce(F.max("event_severity"), F.lit(0)).alias("max_severity"),
        )
        .filter("calls > 0")
    )
    known = s.declared_names.withColumn("declared", F.lit(True))
    return touched.join(known, ["session_id", "tool_name"], "left").select(
        "session_id", F.col("tool_name").alias("tool"), "calls", "errors", "max_severity",
        F.col("declared").isNull().alias("fabricated"),
    )


def session_counters(s: Sessions, findings: DataFrame) -> DataFrame:
    """Live-view counters: frames, fabricated, violations, server requests, gate."""
    seen = with_gate(s.lines, s.frames).groupBy("session_id").agg(
        F.count("*").alias("frames"),
        F.count_if(F.expr("role = 'server_message' AND NOT no_id")).alias("server_requests"),
        F.max(F.col("gate_mark").isNotNull()).alias("gate_on"),
    )
    judged = findings.groupBy("session_id").agg(
        F.count_if(F.expr("subcategory = 'fabricated_tool_call'")).alias("fabricated"),
        F.count_if(F.expr("kind <> 'info' AND subcategory <> 'fabricated_tool_call'")).alias("violations"),
    )
    return seen.join(judged, "session_id", "left").na.fill(0, ["fabricated", "violations"])


def clock(ts: Column) -> Column:
    """HH:MM:SS of an ISO time stamp; other stamps as they are."""
    return F.when(F.contains(ts, F.lit("T")) & (F.length(ts) >= 19), F.substring(ts, 12, 8)).otherwise(ts)


def report_label(strange: str = "unparseable wire line") -> Column:
    """Event label of the session report."""
    method = F.coalesce(F.when(F.col("method") != "", F.col("method")), F.lit("message"))
    return (
        F.when(F.col("kind") == "tool_call", F.concat(F.lit("tools/call · "), F.col("tool_name")))
        .when(
            F.col("kind") == "tool_result",
            F.concat(
                F.lit("tool result · "), F.col("tool_name"),
                F.when(F.col("is_error"), " · ERROR").otherwise(""),
            ),
        )
        .when((F.col("kind") == "message") & F.col("unparsed"), strange)
        .when((F.col("kind") == "message") & F.col("responds_to").isNotNull(), F.concat(F.lit("reply to "), "responds_to"))
        .when(
            F.col("kind") == "message",
            F.concat(
                method,
                F.when(F.expr("server_initiated AND NOT notification"), " · server-initiated request")
                .when(F.col("notification"), " · notification")
                .otherwise(""),
            ),
        )
        .when(F.col("error_message").isNotNull(), "protocol error")
        .when(F.col("responds_to").isNotNull(), F.concat(F.lit("response · "), "responds_to"))
        .otherwise("state change")
    )


def console_label() -> Column:
    """Event label of the live timeline."""
    answer = F.concat(F.lit("result id="), F.col("request_id"))
    return (
        F.when(F.col("unparsed"), "raw (unparsed line)")
        .when(F.col("kind") == "tool_call", F.concat(F.lit("tools/call "), "tool_name"))
        .when(F.col("kind") == "tool_result", F.coalesce(answer, F.lit("result")))
        .when(F.coalesce(F.col("method"), F.lit("")) != "", F.col("method"))
        .when(F.col("request_id").isNotNull(), answer)
        .otherwise(F.col("kind"))
    )


def timeline(events: DataFrame, findings: DataFrame) -> DataFrame:
    """Numbered timeline rows with arrow, label and worst severity."""
    marks = findings.groupBy("session_id", "ord").agg(
        F.coalesce(F.max(F.expr("CASE WHEN kind <> 'info' THEN severity END")), F.lit(0)).alias("severity"),
        F.max(F.expr("kind = 'info'")).alias("is_info"),
    )
    arrow = F.when(F.col("actor") == "client", "→").otherwise("←")
    rows = events.select(
        "session_id", "block", "ord", "seq",
        F.concat_ws(" ", clock(F.col("ts")), arrow, console_label()).alias("text"),
    )
    return (
        with_row_number(rows, ["session_id"], "nth", "rows")
        .join(marks, ["session_id", "ord"], "left")
        .na.fill(0, ["severity"])
        .na.fill(False, ["is_info"])
        .withColumn("row_index", F.col("nth") - 1)
        .drop("nth")
    )


def finding_rows(findings: DataFrame, rows: DataFrame) -> DataFrame:
    """Findings with the index of their event's timeline row; 0 when they have no event."""
    places = rows.select("session_id", "ord", "row_index")
    return findings.join(places, ["session_id", "ord"], "left").na.fill(0, ["row_index"])


def newest_rows(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Every session's timeline, or its last rows, with how many are folded away."""
    if limit is None:
        return rows.withColumn("collapsed_rows", F.lit(0).cast("bigint"))
    return rows.filter(F.col("row_index") >= F.col("rows") - limit).withColumn(
        "collapsed_rows", F.greatest(F.lit(0), F.col("rows") - limit)
    )


def ranked_findings(findings: DataFrame) -> DataFrame:
    """All findings of every session with their rank: severity down, then log position.

    Ranks come from a range partitioning, so a hot session spans many tasks.
    """
    down = findings.withColumn("_down", -F.col("severity"))
    return with_dense_number(down, ["session_id"], ["_down", "ord", "subcategory", "explanation"], "rank").drop("_down")


def top_findings(findings: DataFrame, limit: int) -> DataFrame:
    """The first findings of every session: severity down, then log position.

    Ranked per (session, block) first; only each block's own top rows meet in the
    session's ranking, so a hot session never gathers in one task.
    """
    order = [F.desc("severity"), F.asc_nulls_first("ord"), F.asc("subcategory"), F.asc("explanation")]
    local = Window.partitionBy("session_id", "block").orderBy(*order)
    whole = Window.partitionBy("session_id").orderBy(*order)
    totals = findings.groupBy("session_id").agg(F.count("*").alias("findings"))
    return (
        findings.withColumn("_local", F.row_number().over(local))
        .filter(F.col("_local") <= limit)
        .withColumn("rank", F.row_number().over(whole))
        .filter(F.col("rank") <= limit)
        .join(totals, "session_id")
        .withColumn("more_findings", F.greatest(F.lit(0), F.col("findings") - limit))
        .drop("_local", "findings")
    )


def search(rows: DataFrame, text: Column, words: str) -> DataFrame:
    """Rows whose text holds ``words``, ignoring case; empty words match nothing."""
    if not words:
        return rows.limit(0)
    return rows.filter(F.contains(F.lower(text), F.lit(words.lower())))


def blocked_records(frames: DataFrame) -> DataFrame:
    """Frames the gate stopped."""
    return frames.filter(text_at(F.col("gate"), "$.action") == "blocked").select(
        "session_id", "block", "ord", "seq", text_at(F.col("gate"), "$.tool").alias("tool")
    )


def gate_status(frames: DataFrame) -> DataFrame:
    return blocked_records(frames).groupBy("session_id").agg(F.count("*").alias("blocked_count"))


# ---- log directories -----------------------------------------------------------------------


def session_metrics(frames: DataFrame) -> DataFrame:
    """Self-metrics per session: frames seen and blocked, duration, bytes."""
    size = F.octet_length(F.coalesce(F.to_json("frame"), F.col("raw"), F.lit("")))
    stamp = F.try_to_timestamp("ts")
    return frames.groupBy("session_id").agg(
        F.count("*").alias("frames_seen"),
        F.count_if(text_at(F.col("gate"), "$.action") == "blocked").alias("frames_blocked"),
        (F.unix_micros(F.max(stamp)) - F.unix_micros(F.min(stamp))).alias("duration_us"),
        F.sum(size).alias("log_bytes"),
    ).withColumn(
        "session_duration_s", F.round(F.coalesce(F.col("duration_us"), F.lit(0)) / 1e6, 3)
    ).drop("duration_us")


def last_metrics(records: DataFrame) -> DataFrame:
    """The last metrics record of every log."""
    fields = ["frames_seen", "frames_blocked", "session_duration_s", "log_bytes"]
    return (
        records.groupBy("session_id")
        .agg(F.max_by(F.struct(*fields), "ord").alias("last"))
        .select("session_id", "last.*")
    )


def newest_sessions(logs: DataFrame, last: int = 10) -> DataFrame:
    """The newest logs by name, which starts with the time stamp."""
    return logs.orderBy(F.desc("session_id")).limit(last)


def health(logs: DataFrame, metrics: DataFrame, findings: DataFrame, last: int = 10) -> DataFrame:
    """One row over the newest ``last`` logs: sums, gaps and detector errors."""
    errors = (
        findings.filter("subcategory = 'detector_error'")
        .groupBy("session_id")
        .agg(F.count("*").alias("errors"))
    )
    chosen = newest_sessions(logs, last)
    total = (
        chosen.join(metrics, "session_id", "left")
        .join(errors, "session_id", "left")
        .agg(
            F.count("*").alias("sessions"),
            *[
                F.coalesce(F.sum(c), F.lit(0)).alias(c)
                for c in ("frames_seen", "frames_blocked", "session_duration_s", "log_bytes")
            ],
            F.count_if(F.expr("frames_seen IS NULL")).alias("sessions_missing_metrics"),
            F.coalesce(F.sum("errors"), F.lit(0)).alias("detector_errors"),
            F.count_if("tail_only").alias("tail_only_sessions"),
        )
    )
    return total.withColumn("session_duration_s", F.round("session_duration_s", 3)).withColumn(
        "verdict", F.when(F.col("detector_errors") == 0, "healthy").otherwise("degraded")
    )


def age_seconds(age: str) -> int:
    """'30d' or '12h' in seconds; anything else is an error."""
    number, unit = age[:-1], age[-1:]
    if not (number.isdecimal() and number.isascii() and unit in ("d", "h")):
        raise ValueError(f"bad age {age!r}, expected e.g. 30d or 12h")
    return int(number) * (86400 if unit == "d" else 3600)


def retention_plan(
    logs: DataFrame, findings: DataFrame, older_than: str, now: Column, force: bool = False
) -> DataFrame:
    """Logs old enough to go, and which of them are kept as evidence.

    A log with a detector error, or that could not be read, is protected unless
    forced.  ``logs`` needs session_id, mtime and unreadable.
    """
    cutoff = age_seconds(older_than)
    old = logs.filter(F.unix_timestamp(now) - F.unix_timestamp("mtime") >= cutoff)
    failed = (
        findings.filter("subcategory = 'detector_error'")
        .select("session_id", F.lit(True).alias("failed"))
        .distinct()
    )
    protected = F.lit(False) if force else F.col("unreadable") | F.col("failed").isNotNull()
    return old.join(failed, "session_id", "left").select(
        "session_id", "mtime",
        F.when(protected, "keep").otherwise("delete").alias("action"),
    )


def retention_result(plan: DataFrame, threshold: int = -1) -> DataFrame:
    """Counts of a plan and whether it has more candidates than the threshold."""
    return plan.agg(
        F.count("*").alias("candidates"),
        F.count_if(F.expr("action = 'delete'")).alias("deletable"),
        F.count_if(F.expr("action = 'keep'")).alias("protected"),
    ).withColumn("breach", (F.lit(threshold) >= 0) & (F.col("candidates") > threshold))


def live_sessions(logs: DataFrame, now: Column) -> DataFrame:
    """Logs newest first, with a flag for those that grew in the last seconds."""
    age = (F.unix_micros(now) - F.unix_micros("mtime")) / 1e6
    return logs.withColumn("live", age < LIVE_SECONDS).orderBy(F.desc("mtime"))
