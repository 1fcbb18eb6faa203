"""The decision a live gate would take for every tool call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.jsonvalue import text_at
from ..plans.blocks import with_first_after, with_last_before

# Fixed value: how long a call waits for a first surface.
HOLD_SECONDS = 2.0


def policy_verdicts(lines: DataFrame, hold: float = HOLD_SECONDS, enforce: bool = True) -> DataFrame:
    """Verdict per call against the latest surface the server listed before it.

    Without an earlier surface the call is held for the first later one; when none
    comes within ``hold`` seconds it passes and is marked as skipped.  A call whose
    tool is not in the surface is blocked, or only marked when ``enforce`` is off.
    Here the latest listing counts, not the whole session's.
    """
    frame = F.col("frame")
    tools = F.try_variant_get(frame, "$.result.tools", "array<variant>")
    names = F.filter(F.transform(tools, lambda t: text_at(t, "$.name")), lambda n: n.isNotNull())
    surface = F.when(
        (F.col("role").isin("response", "server_message")) & tools.isNotNull(),
        F.struct(names.alias("names"), F.try_to_timestamp("ts").alias("at")),
    )
    rows = lines.select(
        "session_id", "block", "ord", "seq", "ts", "role",
        F.col("call_name").alias("tool_name"), surface.alias("surface"),
    ).filter("role = 'call' OR surface IS NOT NULL")
    before = with_last_before(rows, ["session_id"], F.col("surface"), "latest")
    both = with_first_after(before, ["session_id"], F.col("surface"), "next")
    wait = (F.unix_micros("next.at") - F.unix_micros(F.try_to_timestamp("ts"))) / 1e6
    known = F.when(F.col("latest").isNotNull(), F.col("latest.names")).when(
        wait <= hold, F.col("next.names")
    )
    return both.filter("role = 'call'").withColumn("known", known).select(
        "session_id", "seq", "tool_name",
        F.when(F.col("known").isNull(), "gate_skipped")
        .when(F.array_contains("known", F.col("tool_name")), "forward")
        .otherwise("blocked" if enforce else "gate_disabled")
        .alias("verdict"),
    )
