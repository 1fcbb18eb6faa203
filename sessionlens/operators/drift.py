"""How each server's behaviour changes over its sessions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hosts import netloc_hosts
from ..functions.jsonvalue import field, text_at
from ..plans.durable import with_dense_number, written
from .detectors import Sessions
from .events import server_welcome

# Kind of drift, severity and text for a first-time item of each kind.
NOVELTIES = {
    "declared": ("new_declared_tool", 2, "server now declares '%s' — never in its surface before"),
    "fabricated": (
        "new_fabricated_tool", 3,
        "tools/call '%s' outside any declared surface, first time in this server's history",
    ),
    "called": ("new_called_tool", 1, "'%s' called for the first time across all sessions"),
    "request": ("new_server_request", 2, "server-initiated request '%s' never seen before"),
    "host": ("new_host", 2, "new host in wire traffic: %s"),
    "capability": ("new_capability", 1, "server now advertises the '%s' capability"),
}


def schema_hash(schema: Column) -> Column:
    """Twelve hex digits over the canonical JSON text of a schema."""
    return F.substring(F.sha2(F.coalesce(F.to_json(schema), F.lit("null")), 256), 1, 12)


def fingerprint_items(s: Sessions) -> DataFrame:
    """The comparable facts of every session as distinct (session, kind, item, hash) rows.

    Long rows instead of one wide row of sets: a session with very many hosts or
    tools stays spread over tasks.
    """
    none = F.lit(None).cast("string")

    def items(df: DataFrame, kind: str, item: Column, value: Column = none) -> DataFrame:
        return df.select("session_id", F.lit(kind).alias("kind"), item.alias("item"), value.alias("hash"))

    last_schema = s.declared.groupBy("session_id", "tool_name").agg(
        F.max_by(schema_hash(F.col("input_schema")), F.struct("ord", "pos")).alias("hash")
    )
    declared = items(last_schema, "declared", F.col("tool_name"), F.col("hash"))
    called = s.calls.select("session_id", "tool_name").distinct()
    fabricated = called.join(s.declared_names, ["session_id", "tool_name"], "left_anti")
    requests = s.lines.filter("role = 'server_message' AND NOT no_id AND method <> ''")
    frame = F.col("frame")
    output = F.when(F.col("has_error"), field(frame, "$.error")).otherwise(field(frame, "$.result"))
    in_calls = s.calls.select("session_id", F.explode(netloc_hosts(F.to_json("args"))).alias("host"))
    in_results = s.events.filter("kind = 'tool_result'").select(
        "session_id", F.explode(netloc_hosts(F.to_json(output))).alias("host")
    )
    capabilities = server_welcome(s.events).select(
        "session_id", F.explode(F.json_object_keys("server_capabilities")).alias("capability")
    )
    parts = [
        declared,
        items(called, "called", F.col("tool_name")).distinct(),
        items(fabricated, "fabricated", F.col("tool_name")),
        items(requests, "request", F.col("method")).distinct(),
        items(in_calls.union(in_results), "host", F.col("host")).distinct(),
        items(capabilities, "capability", F.col("capability")).distinct(),
    ]
    return reduce(DataFrame.unionByName, parts)


def file_server_name(session_id: Column) -> Column:
    """The server name inside a log name <stamp>_<name>_<pid>, else the whole name."""
    parts = F.split(session_id, "_")
    return F.when(
        F.size(parts) >= 3, F.array_join(F.slice(parts, 2, F.size(parts) - 2), "_")
    ).otherwise(session_id)


def fingerprints(s: Sessions, server_key: Column | None = None, tail_only: DataFrame | None = None) -> DataFrame:
    """Scalar facts of every session, and the server it belongs to.

    The key is the name the server gave, else the one in the log's name; pass
    ``server_key`` to group otherwise.
    """
    named = F.when(F.coalesce("server_name", F.lit("")) != "", F.col("server_name"))
    key = server_key if server_key is not None else F.coalesce(named, file_server_name(F.col("session_id")))
    rows = s.context.select(
        "session_id", key.alias("server_key"), "first_ts", "last_ts", "server_name",
        "server_version", "protocol_version", "event_count",
    )
    if tail_only is None:
        return rows.withColumn("tail_only", F.lit(False))
    flags = tail_only.select("session_id", "tail_only")
    return rows.join(flags, "session_id", "left").na.fill(False, ["tail_only"])


def drift(prints: DataFrame, items: DataFrame) -> DataFrame:
    """Everything a session shows that its server never showed in an earlier session.

    Novelty against all earlier sessions is a minimum over positions, not a running
    set: an item is new in the session that holds its first position, unless that is
    the server's first session.  Sessions are numbered without one task per server.
    """
    numbered = with_dense_number(
        prints.withColumn("_first_ts", F.coalesce("first_ts", F.lit(""))),
        ["server_key"], ["_first_ts", "session_id"], "nth",
    ).drop("_first_ts")
    place = numbered.select("session_id", "server_key", "nth")
    # written once: nine branches read the items, each of which parses frames otherwise
    placed = written(items.join(place, "session_id"))

    def rows(df: DataFrame, kind: Column | str, severity: Column | int, text: Column, item: Column):
        def column(v):
            return v if isinstance(v, Column) else F.lit(v)

        return df.select(
            "server_key", "session_id", "nth", column(kind).alias("kind"),
            column(severity).cast("int").alias("severity"), text.alias("explanation"), item.alias("item"),
        )

    firsts = placed.groupBy("server_key", "kind", "item").agg(
        F.min(F.struct("nth", "session_id")).alias("first")
    ).select("server_key", F.col("kind").alias("item_kind"), "item", "first.*").filter("nth > 1")
    # a tool called for the first time is not reported when that call was fabricated
    made_up = placed.filter("kind = 'fabricated'").select(
        "server_key", "item", "nth", F.lit("called").alias("item_kind")
    )
    firsts = firsts.join(made_up, ["server_key", "item", "nth", "item_kind"], "left_anti")
    table = {k: F.lit(v[0]) for k, v in NOVELTIES.items()}
    kind = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), v)])[F.col("item_kind")]
    severity = F.create_map(
        *[x for k, v in NOVELTIES.items() for x in (F.lit(k), F.lit(v[1]))]
    )[F.col("item_kind")]
    text = reduce(
        lambda acc, kv: acc.when(F.col("item_kind") == kv[0], F.format_string(kv[1][2], "item")),
        NOVELTIES.items(),
        F.when(F.lit(False), F.lit("")),
    )
    novel = rows(firsts, kind, severity, text, F.col("item"))

    declared = placed.filter("kind = 'declared'")
    # sessions that listed anything, in dense order, to find each one's predecessor
    listing = declared.select("server_key", "session_id", "nth").distinct()
    ranked = with_dense_number(listing, ["server_key"], ["nth"], "step")
    before = ranked.select(
        F.col("server_key"), F.col("nth").alias("earlier"), (F.col("step") + 1).alias("step")
    )
    pairs = ranked.join(before, ["server_key", "step"])
    gone = (
        declared.select("server_key", F.col("nth").alias("earlier"), "item")
        .join(pairs, ["server_key", "earlier"])
        .join(declared.select("server_key", "nth", "item"), ["server_key", "nth", "item"], "left_anti")
    )
    removed = rows(
        gone, "removed_declared_tool", 1,
        F.format_string("'%s' disappeared from the declared surface", "item"), F.col("item"),
    )

    hashes = declared.groupBy("server_key", "item", "hash").agg(
        F.min(F.struct("nth", "session_id")).alias("first")
    )
    tools = hashes.groupBy("server_key", "item").agg(F.min("first.nth").alias("tool_nth"))
    changed = rows(
        hashes.join(tools, ["server_key", "item"]).select("server_key", "item", "first.*", "tool_nth")
        .filter("nth > tool_nth"),
        "schema_changed", 2,
        F.format_string("inputSchema for '%s' changed since it was first declared", "item"), F.col("item"),
    )

    named = numbered.filter("coalesce(server_name, '') <> ''")
    names = named.groupBy("server_key", "server_name").agg(
        F.min("nth").alias("name_nth"),
        F.min(F.expr("CASE WHEN coalesce(server_version, '') <> '' THEN nth END")).alias("versioned_nth"),
    )
    first_named = names.groupBy("server_key").agg(F.min("name_nth").alias("any_nth"))
    identity = (
        named.join(names, ["server_key", "server_name"])
        .join(first_named, "server_key")
        .filter("nth = name_nth AND nth > any_nth")
    )
    renamed = rows(
        identity, "server_identity_changed", 2,
        F.format_string("serverInfo.name changed to '%s'", "server_name"), F.col("server_name"),
    )
    versions = (
        named.filter("coalesce(server_version, '') <> ''")
        .groupBy("server_key", "server_name", "server_version")
        .agg(F.min(F.struct("nth", "session_id")).alias("first"))
        .join(names, ["server_key", "server_name"])
        .select("server_key", "server_name", "server_version", "first.*", "versioned_nth")
        .filter("nth > versioned_nth")
    )
    upgraded = rows(
        versions, "server_version_changed", 1,
        F.format_string("'%s' version changed to %s", "server_name", "server_version"),
        F.col("server_version"),
    )
    partial = rows(
        numbered.filter("tail_only AND nth > 1"), "tail_only_partial", 1,
        F.lit(
            "session was ingested tail-only (head dropped at the ingest cap) — "
            "drift comparison is low-confidence"
        ),
        F.lit(None).cast("string"),
    )
    return reduce(DataFrame.unionByName, [novel, removed, changed, renamed, upgraded, partial])


def drift_histogram(prints: DataFrame, found: DataFrame) -> DataFrame:
    """Drift of every session by severity, and whether it calls for attention."""
    counts = found.groupBy("session_id").agg(
        *[F.count_if(F.col("severity") == n).alias(f"severity_{n}") for n in (3, 2, 1)],
        F.max("severity").alias("worst"),
    )
    return (
        prints.select("server_key", "session_id")
        .join(counts, "session_id", "left")
        .na.fill(0)
        .withColumn("alert", F.col("worst") >= 2)
    )


def drift_of_session(prints: DataFrame, items: DataFrame, session_id: str) -> DataFrame:
    """Drift of one session against the history of its server only."""
    chosen = prints.filter(F.col("session_id") == session_id).select("server_key")
    history = prints.join(F.broadcast(chosen), "server_key", "left_semi")
    kept = items.join(history.select("session_id"), "session_id", "left_semi")
    return drift(history, kept).filter(F.col("session_id") == session_id)
