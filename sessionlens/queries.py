"""Every operator as a query over the test tables: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bridge
from .functions.catalogue import entropy, entropy_by_alphabet, luhn
from .functions.hosts import is_trusted, netloc_hosts
from .functions.scan import displayed, hits, looks_like_secret, redacted, with_inline_value
from .operators import audit as a
from .operators import detectors as d
from .operators import drift as dr
from .operators import policy as p
from .operators import provenance as pv
from .operators import rollups as r
from .operators.events import with_parents
from .plans.blocks import computed_once, with_row_number
from .plans.durable import shared_dir, written
from .session import configure
from .sinks import reports
from .sources.logs import metrics_records, parse_records, read_written, wire_frames
from .streaming.history import LiveDrift
from .streaming.live import LiveFindings, LiveView
from .streaming.state import PAIRED, live_pairing, open_requests

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    """Register a query under its function's name."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return function(configure(spark), folder)

    QUERIES[function.__name__] = run
    return function


def logs(spark: SparkSession, folder: str) -> d.Sessions:
    return d.Sessions(bridge.event_frames(bridge.table(spark, folder, "events")))


# ---- events -------------------------------------------------------------------------------


@query
def event_classification(spark, folder):
    events = logs(spark, folder).events
    return events.groupBy("session_id", "actor", "role", "kind").agg(F.count("*").alias("events"))


@query
def request_pairing(spark, folder):
    answers = logs(spark, folder).events.filter("role IN ('response', 'client_reply')")
    return answers.select(
        "session_id", "seq", "kind", "responds_to", F.col("request.seq").alias("request_seq"), "orphaned"
    )


@query
def pairing_totals(spark, folder):
    answers = logs(spark, folder).events.filter("role IN ('response', 'client_reply')")
    return answers.groupBy("role").agg(
        F.count("*").alias("responses"),
        F.count_if(F.col("request").isNotNull()).alias("matched"),
        F.count_if("orphaned").alias("orphaned"),
    )


@query
def causal_parent(spark, folder):
    events = with_parents(logs(spark, folder).events)
    return events.select("session_id", "seq", F.col("parent.seq").alias("parent_seq"))


@query
def declared_surface(spark, folder):
    return logs(spark, folder).declared_names


@query
def unused_declared(spark, folder):
    s = logs(spark, folder)
    called = s.calls.select("session_id", "tool_name").distinct()
    return s.declared_names.join(called, ["session_id", "tool_name"], "left_anti")


@query
def called_tools(spark, folder):
    numbered = with_row_number(
        logs(spark, folder).calls.select("session_id", "block", "ord", "seq", "tool_name"), ["session_id"], "nth"
    )
    return numbered.select("session_id", "nth", "tool_name", "seq")


@query
def session_context(spark, folder):
    return logs(spark, folder).context.select(
        "session_id", "client_capabilities", "server_name", "server_version",
        "first_ts", "last_ts", "event_count", "final_state",
    )


# ---- detectors ----------------------------------------------------------------------------


def _findings(detector: d.Detector) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return detector(logs(spark, folder)).select(
            "session_id", "seq", "kind", "subcategory", "severity", "explanation", "tool"
        )

    run.__name__ = detector.__name__
    return run


for _detector in (
    d.fabricated_calls, d.surface_changes, d.call_order, d.schema_violations,
    d.server_requests, d.orphaned_responses, d.gate_actions,
):
    query(_findings(_detector))


@query
def all_findings(spark, folder):
    found = d.detect(logs(spark, folder).stored())
    return found.groupBy("session_id", "subcategory", "severity").agg(
        F.count("*").alias("findings"), F.min("seq").alias("first_seq")
    )


# ---- roll-ups -----------------------------------------------------------------------------


def wire_findings(s: d.Sessions) -> DataFrame:
    """Findings of the detectors that look at the protocol, not at payload text."""
    return d.detect(
        s,
        (
            d.fabricated_calls, d.surface_changes, d.call_order, d.schema_violations,
            d.server_requests, d.orphaned_responses, d.gate_actions,
        ),
    )


CONTEXT = (d.surface_changes, d.call_order, d.schema_violations, d.server_requests, d.orphaned_responses)


@query
def session_verdicts(spark, folder):
    s = logs(spark, folder).stored()
    return r.verdicts(s.frames.select("session_id").distinct(), wire_findings(s))


@query
def session_summary(spark, folder):
    s = logs(spark, folder).stored()
    return r.session_summary(s, d.detect(s, CONTEXT))


@query
def error_taxonomy(spark, folder):
    return r.error_taxonomy(logs(spark, folder).events)


@query
def tool_heatmap(spark, folder):
    s = logs(spark, folder).stored()
    return r.tool_heatmap(s, wire_findings(s)).orderBy(
        "session_id", F.desc("max_severity"), F.desc("calls")
    )


@query
def session_counters(spark, folder):
    s = logs(spark, folder).stored()
    return r.session_counters(s, wire_findings(s))


@query
def report_labels(spark, folder):
    events = logs(spark, folder).events
    return events.groupBy(r.report_label().alias("label")).agg(F.count("*").alias("events"))


@query
def timeline_view(spark, folder):
    s = logs(spark, folder).stored()
    rows = r.newest_rows(r.timeline(s.events, wire_findings(s)))
    return rows.select("session_id", "row_index", "text", "severity", "is_info", "collapsed_rows")


@query
def timeline_search(spark, folder):
    s = logs(spark, folder)
    found = r.search(r.timeline(s.events, d.orphaned_responses(s)), F.col("text"), "TOOLS/LIST")
    return found.select("session_id", "row_index", "text")


@query
def findings_view(spark, folder):
    ranked = r.ranked_findings(wire_findings(logs(spark, folder).stored()))
    return ranked.select("session_id", "rank", "seq", "severity", "subcategory")


@query
def severity_floor(spark, folder):
    kept = r.at_least(wire_findings(logs(spark, folder).stored()), 2)
    return kept.groupBy("subcategory", r.severity_level(F.col("severity")).alias("level")).agg(
        F.count("*").alias("findings")
    )


@query
def gate_status(spark, folder):
    return r.gate_status(logs(spark, folder).frames)


@query
def policy_verdicts(spark, folder):
    return p.policy_verdicts(logs(spark, folder).lines, hold=3600.0)


# ---- log directory ------------------------------------------------------------------------


def daily(spark: SparkSession, folder: str) -> d.Sessions:
    return d.Sessions(bridge.daily_frames(bridge.table(spark, folder, "events")))


def day_logs(spark: SparkSession, folder: str) -> DataFrame:
    """The daily logs as a directory listing; the last frame gives the modification time."""
    events = bridge.daily_frames(bridge.table(spark, folder, "events"))
    return events.groupBy("session_id").agg(
        F.max(F.to_timestamp("ts")).alias("mtime"),
        F.count("*").alias("frames"),
        F.lit(False).alias("tail_only"),
        F.lit(False).alias("unreadable"),
    )


@query
def session_metrics(spark, folder):
    return r.session_metrics(daily(spark, folder).frames).select(
        "session_id", "frames_seen", "frames_blocked", "session_duration_s"
    )


@query
def session_listing(spark, folder):
    listing = r.live_sessions(day_logs(spark, folder), F.lit("2024-01-30 23:00:00").cast("timestamp"))
    return listing.select("session_id", "frames", "live")


@query
def health_of_newest(spark, folder):
    s = daily(spark, folder)
    found = d.detect(s, (d.orphaned_responses,))
    return r.health(day_logs(spark, folder), r.session_metrics(s.frames), found, 10).drop("log_bytes")


@query
def retention_plan(spark, folder):
    s = daily(spark, folder)
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    plan = r.retention_plan(day_logs(spark, folder), d.orphaned_responses(s), "10d", now)
    return plan.select("session_id", "action")


@query
def retention_result(spark, folder):
    s = daily(spark, folder)
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    plan = r.retention_plan(day_logs(spark, folder), d.orphaned_responses(s), "240h", now)
    return r.retention_result(plan, 100)


# ---- drift --------------------------------------------------------------------------------


def day_prints(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    s = daily(spark, folder).stored()
    key = dr.file_server_name(F.col("session_id"))
    return dr.fingerprints(s, key), dr.fingerprint_items(s)


@query
def fingerprints(spark, folder):
    prints, _ = day_prints(spark, folder)
    return prints.select("session_id", "server_key", "first_ts", "last_ts", "server_name", "event_count")


@query
def fingerprint_items(spark, folder):
    _, items = day_prints(spark, folder)
    return items.groupBy("session_id", "kind").agg(F.count("*").alias("items"))


@query
def schema_hashes(spark, folder):
    _, items = day_prints(spark, folder)
    return items.filter("kind = 'declared'").select("session_id", "item", "hash")


@query
def drift(spark, folder):
    prints, items = day_prints(spark, folder)
    return dr.drift(prints, items).select("server_key", "session_id", "kind", "severity", "explanation")


@query
def drift_histogram(spark, folder):
    prints, items = day_prints(spark, folder)
    return dr.drift_histogram(prints, dr.drift(prints, items))


# ---- sensitive values ---------------------------------------------------------------------


def text_of(spark: SparkSession, folder: str) -> DataFrame:
    return bridge.table(spark, folder, "documents").select("doc_id", "lang", "source", "text")


@query
def document_hits(spark, folder):
    scanned = computed_once(text_of(spark, folder), hits(F.col("text")).alias("hits"))
    found = scanned.select("doc_id", F.explode("hits").alias("hit"))
    return found.select(
        "doc_id", F.col("hit.category").alias("category"), F.col("hit.severity").alias("severity"),
        F.col("hit.value").alias("value"),
    )


@query
def page_hits(spark, folder):
    pages = bridge.table(spark, folder, "pages").select("page_id", "html")
    scanned = computed_once(pages, hits(F.col("html")).alias("hits"))
    found = scanned.select("page_id", F.explode("hits").alias("hit"))
    return found.groupBy("page_id", F.col("hit.category").alias("category")).agg(F.count("*").alias("values"))


@query
def argument_leaks(spark, folder):
    s = d.Sessions(bridge.document_calls(bridge.table(spark, folder, "documents")))
    return d.argument_leaks(s).select("session_id", "seq", "subcategory", "severity", "explanation")


@query
def result_leaks(spark, folder):
    s = d.Sessions(bridge.document_results(bridge.table(spark, folder, "documents")))
    return d.result_leaks(s).select("session_id", "seq", "subcategory", "severity", "explanation")


@query
def redacted_documents(spark, folder):
    shown = redacted(text_of(spark, folder), shown=F.col("text"))
    return shown.select(
        "doc_id", F.length("shown").alias("chars"), (F.col("shown") != F.col("text")).alias("changed"),
        F.md5("shown").alias("digest"),
    )


@query
def displayed_documents(spark, folder):
    shown = displayed(text_of(spark, folder), shown=F.col("text"))
    return shown.select("doc_id", F.length("shown").alias("chars"), F.md5("shown").alias("digest"))


@query
def secret_documents(spark, folder):
    texts = text_of(spark, folder)
    return texts.groupBy("source").agg(F.count_if(looks_like_secret(F.col("text"))).alias("documents"))


@query
def card_numbers(spark, folder):
    runs = text_of(spark, folder).select(
        "doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).alias("digits")
    )
    return runs.filter(F.length("digits") >= 13).select("doc_id", "digits", luhn(F.col("digits")).alias("valid"))


@query
def token_entropy(spark, folder):
    tokens = text_of(spark, folder).select(
        "doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9/+=]{30,}"), F.lit(0))).alias("token")
    )
    return tokens.select(
        "doc_id", "token", F.round(entropy(F.col("token")), 6).alias("bits"),
        entropy_by_alphabet(F.col("token")).alias("random"),
    )


@query
def inline_values(spark, folder):
    words = text_of(spark, folder).select(
        "doc_id", F.array_distinct(F.split("text", r"\s+")).alias("words")
    ).select("doc_id", F.explode("words").alias("word"))
    shown = with_inline_value(words, F.col("word"), "shown", "word")
    quoted = F.col("shown").startswith("`")
    return shown.groupBy("doc_id").agg(
        F.count_if(quoted).alias("quoted"), F.count_if(~quoted).alias("redacted"),
        F.sum(F.when(~quoted, F.length("shown"))).alias("redacted_chars"),
    )


# ---- hosts --------------------------------------------------------------------------------


@query
def egress_findings(spark, folder):
    s = d.Sessions(bridge.page_frames(bridge.table(spark, folder, "pages")))
    return d.egress(s).select("session_id", "seq", "severity", "explanation")


@query
def declared_hosts(spark, folder):
    s = d.Sessions(bridge.page_frames(bridge.table(spark, folder, "pages")))
    return d.declared_hosts(s)


@query
def fingerprint_hosts(spark, folder):
    pages = bridge.table(spark, folder, "pages")
    return pages.select("page_id", F.explode(netloc_hosts(F.col("url"))).alias("host")).groupBy("host").agg(
        F.count("*").alias("pages")
    )


@query
def trusted_hosts(spark, folder):
    pages = bridge.table(spark, folder, "pages")
    host = F.regexp_extract("url", "https?://([^/]+)", 1)
    return pages.select("page_id", host.alias("host"), is_trusted(F.regexp_replace(host, r"example\.net$", "windows.net")).alias("trusted"))


# ---- unparsed lines -----------------------------------------------------------------------


def talks(spark: SparkSession, folder: str) -> d.Sessions:
    return d.Sessions(bridge.conversation_frames(bridge.table(spark, folder, "conversations")))


@query
def unparsed_lines(spark, folder):
    events = with_parents(talks(spark, folder).events)
    return events.select(
        "session_id", "seq", "actor", "kind", "part_kind", "unparsed",
        F.col("parent.seq").alias("parent_seq"), r.clock(F.col("ts")).alias("clock"),
        F.length("raw").alias("chars"),
    )


# ---- source trees -------------------------------------------------------------------------


def repos(spark: SparkSession, folder: str) -> DataFrame:
    return bridge.document_sources(bridge.table(spark, folder, "documents"))


@query
def audit_findings(spark, folder):
    return a.audit_findings(repos(spark, folder)).select(
        "repo", "path", "rule", "severity", "line", "detail", "count"
    )


@query
def audit_deductions(spark, folder):
    return a.deductions(a.audit_findings(repos(spark, folder)))


@query
def audit_scores(spark, folder):
    sources = repos(spark, folder)
    return a.scores(sources, a.audit_findings(sources))


@query
def audit_profiles(spark, folder):
    return a.profiles(repos(spark, folder)).select(
        "repo", "runtime", "files_scanned", "depth_ast", "depth_pattern", "dependency_count"
    )


@query
def rule_prevalence(spark, folder):
    sources = repos(spark, folder)
    return a.prevalence(sources, a.audit_findings(sources)).orderBy(F.desc("pct"))


@query
def survey_scores(spark, folder):
    sources = repos(spark, folder)
    return a.score_summary(a.scores(sources, a.audit_findings(sources)))


@query
def audit_sarif(spark, folder):
    sources = repos(spark, folder)
    found = written(a.audit_findings(sources))
    lines = reports.audit_sarif(found, a.scores(sources, found))
    return lines.groupBy("document", "section").agg(
        F.count("*").alias("lines"), F.count_if(F.startswith("text", F.lit(","))).alias("commas")
    )


@query
def audit_advisory(spark, folder):
    lines = reports.static_lines(a.audit_findings(repos(spark, folder)), 1, "base")
    return lines.select("document", "severity", "text")


# ---- dependencies -------------------------------------------------------------------------


@query
def provenance_findings(spark, folder):
    deps = bridge.supplier_deps(bridge.table(spark, folder, "lineitem"))
    registry = bridge.part_registry(bridge.table(spark, folder, "part"))
    found = pv.provenance(deps, registry, F.lit("2026-07-05").cast("timestamp"))
    return found.groupBy("repo", "ecosystem", "manifest", "rule", "severity", "detail").agg(
        F.count("*").alias("packages")
    )


@query
def provenance_notes(spark, folder):
    deps = bridge.supplier_deps(bridge.table(spark, folder, "lineitem"))
    registry = bridge.part_registry(bridge.table(spark, folder, "part")).filter("status <> 'error'")
    found = pv.provenance(deps, registry, F.lit("2026-07-05").cast("timestamp"))
    return found.filter("rule = 'prov-unavailable'").select("repo", "severity", "detail")


@query
def registry_facts(spark, folder):
    facts = pv.registry_facts(bridge.part_registry(bridge.table(spark, folder, "part")))
    return facts.select(
        "name", "status", "deprecated", F.date_format("newest", "yyyy-MM-dd").alias("newest"), "maintainers", "signed"
    )


# ---- reports of sessions ------------------------------------------------------------------


@query
def session_sarif(spark, folder):
    s = logs(spark, folder).stored()
    found = d.detect(s, CONTEXT)
    numbers = reports.line_numbers(with_row_number(s.frames, ["session_id"], "line_no"))
    lines = reports.session_sarif(found, numbers)
    result = F.try_parse_json(F.regexp_replace("text", "^,", ""))
    return lines.filter("section = 3").select(
        F.col("document").alias("session_id"),
        F.try_variant_get(result, "$.partialFingerprints.seq", "string").alias("print"),
        F.try_variant_get(result, "$.level", "string").alias("level"),
        F.try_variant_get(result, "$.locations[0].physicalLocation.region.startLine", "bigint").alias("line"),
    ).distinct()


@query
def runtime_advisory(spark, folder):
    lines = reports.runtime_lines(wire_findings(logs(spark, folder).stored()))
    return lines.select("document", "ord", "severity", "text")


@query
def session_report(spark, folder):
    s = logs(spark, folder).stored()
    rows = reports.report_rows(s, d.orphaned_responses(s))
    return rows.select("session_id", "row_index", "label", "parent_seq", "severity", "part_kind")


@query
def log_writer(spark, folder):
    lines = reports.log_lines(logs(spark, folder).frames)
    back = parse_records(lines.select(F.col("document").alias("session_id"), F.col("position").alias("ord"), F.col("text").alias("value")))
    return back.groupBy("session_id", "record_kind", "dir").agg(
        F.count("*").alias("records"), F.sum("seq").alias("seqs"), F.min("ts").alias("first_ts"),
        F.count_if(F.col("gate").isNotNull()).alias("gated"),
    )


@query
def finding_places(spark, folder):
    s = logs(spark, folder).stored()
    found = d.server_requests(s)
    rows = r.finding_rows(found, r.timeline(s.events, found))
    return rows.select("session_id", "seq", "subcategory", "row_index")


@query
def exported_events(spark, folder):
    events = logs(spark, folder).calls.select("session_id", "seq", "tool_name", "args")
    return reports.json_rows(events, "session_id")


# ---- streams ------------------------------------------------------------------------------


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events table as a stream of frames."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    files = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    return bridge.event_frames(files.parquet(folder))


@query
def live_findings(spark, folder):
    work = f"{shared_dir(spark)}/live-{uuid.uuid4().hex}"
    live = LiveFindings(spark, f"{work}/tables", (d.fabricated_calls, d.orphaned_responses, d.schema_violations))
    live.start(event_stream(spark, folder), f"{work}/checkpoint").awaitTermination()
    return live.findings().select("session_id", "seq", "subcategory", "severity", "explanation")


#: Parts of the events table that arrive one after the other.
STAGES = 4


def growing_events(spark: SparkSession, folder: str, work: str):
    """The events as a stream of frames whose source grows by a quarter of the ids at a time:
    yields the part that has just been added, and the stream."""
    rows = bridge.table(spark, folder, "events")
    top = rows.agg(F.max("event_id")).first()[0] or 0
    for part in range(STAGES):
        rows.filter(F.floor(F.col("event_id") * STAGES / (top + 1)) == part).write.parquet(f"{work}/events/{part}")
        yield part, bridge.event_frames(spark.readStream.schema(rows.schema).parquet(f"{work}/events/*"))


@query
def live_drift(spark, folder):
    """Drift of four batches of closed sessions, a quarter of the days each, from the index."""
    work = f"{shared_dir(spark)}/live-{uuid.uuid4().hex}"
    rows = bridge.table(spark, folder, "events").withColumn("day", F.unix_date(F.to_date("ts")))
    low, high = rows.agg(F.min("day"), F.max("day")).first()
    live = LiveDrift(spark, f"{work}/tables", dr.file_server_name(F.col("session_id")), buckets=8)
    events = rows.drop("day").schema
    for part in range(STAGES):
        mine = F.floor((F.col("day") - F.lit(low or 0)) * STAGES / ((high or 0) - (low or 0) + 1)) == part
        rows.filter(mine).drop("day").write.parquet(f"{work}/events/{part}")
        frames = bridge.daily_frames(spark.readStream.schema(events).parquet(f"{work}/events/*"))
        live.start(frames, f"{work}/checkpoint").awaitTermination()
    return live.findings().select("server_key", "session_id", "kind", "severity", "explanation")


def _live(spark: SparkSession, folder: str, view) -> LiveView:
    """A view after four batches, each from its own start of the stream."""
    work = f"{shared_dir(spark)}/live-{uuid.uuid4().hex}"
    live = LiveView(spark, f"{work}/tables", view, buckets=8)
    for _, frames in growing_events(spark, folder, work):
        live.start(frames, f"{work}/checkpoint").awaitTermination()
    return live


def _watched(s: d.Sessions) -> DataFrame:
    return d.detect(s, (d.fabricated_calls, d.orphaned_responses, d.server_requests))


@query
def live_changes(spark, folder):
    """The findings after each batch, from the changes alone."""
    live = _live(spark, folder, _watched)
    states = [live.replayed(k).withColumn("after", F.lit(k).cast("bigint")) for k in range(STAGES)]
    return reduce(DataFrame.unionByName, states).select("after", "session_id", "seq", "subcategory", "severity", "explanation")


@query
def live_retractions(spark, folder):
    """The findings that a later declaration took back, by the batch that brought it."""
    # details tell what is declared by now: they change while the finding stays
    gone = _live(spark, folder, lambda s: _watched(s).drop("detail")).changes().filter("op = 'retract'")
    return gone.select(F.col("batch").cast("bigint").alias("batch"), "session_id", "seq", "subcategory", "copies")


@query
def live_counters_feed(spark, folder):
    """What a display of session counters would be sent after each batch."""
    live = _live(spark, folder, lambda s: r.session_counters(s, _watched(s)))
    shown = ["session_id", "frames", "fabricated", "violations", "server_requests", "gate_on"]
    return live.feed("session_id").select(F.col("batch").cast("bigint").alias("batch"), "op", *[F.col(f"row.{c}") for c in shown])


def _paired(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Answers that four batches gave, and the requests that stay open in the state."""
    work = f"{shared_dir(spark)}/live-{uuid.uuid4().hex}"
    for _, frames in growing_events(spark, folder, work):
        sink = live_pairing(frames).writeStream.format("parquet").option("path", f"{work}/pairs")
        sink.option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(PAIRED).parquet(f"{work}/pairs"), open_requests(spark, f"{work}/checkpoint")


@query
def live_request_pairing(spark, folder):
    answers, _ = _paired(spark, folder)
    return answers.select("session_id", "seq", "role", "responds_to", "request_seq", "orphaned")


@query
def live_open_requests(spark, folder):
    return _paired(spark, folder)[1].select("session_id", "space", "id_key", "seq", "label")


# ---- audits of trees with every rule, and reports as JSON -----------------------------------


def trees(spark: SparkSession, folder: str) -> DataFrame:
    return bridge.document_tree(bridge.table(spark, folder, "documents"))


@query
def tree_findings(spark, folder):
    found = a.in_report_order(a.explained(a.audit_findings(trees(spark, folder)), a.rules_table(spark)))
    return found.select("repo", "nth", "path", "rule", "severity", "category", "line", "detail", "count")


@query
def tree_deductions(spark, folder):
    return a.deductions(a.audit_findings(trees(spark, folder)))


@query
def tree_profiles(spark, folder):
    return a.profiles(trees(spark, folder)).select(
        "repo", "runtime", "files_scanned", "python_files", "script_files", "depth_ast", "depth_pattern", "dependency_count"
    )


@query
def survey_servers(spark, folder):
    sources = trees(spark, folder)
    found = written(a.audit_findings(sources))
    return a.survey_rows(a.scores(sources, found), found).select("nth", "repo", "score", "grade", F.array_join("rules", ",").alias("rules"))


@query
def audit_report(spark, folder):
    sources = trees(spark, folder)
    # findings and profiles read what the parser found; it runs once
    parsed = written(a.scan_files(sources).drop("text"))
    found = written(a.audit_findings(sources, parsed=parsed))
    facts = a.profiles(sources, parsed).select("repo", "runtime", "files_scanned", "dependency_count")
    lines = reports.audit_lines(a.explained(found, a.rules_table(spark)), a.scores(sources, found), a.deductions(found), facts)
    # reasons and advice are our own sentences: their presence is compared, not their words
    bare = F.regexp_replace("text", '"why":"[^"]+","fix":"[^"]+"', '"why":"w","fix":"f"')
    return lines.select("document", "section", bare.alias("text"))


@query
def summary_report(spark, folder):
    s = logs(spark, folder).stored()
    return reports.summary_lines(s, wire_findings(s)).select("document", "section", "text")


@query
def analysis_report(spark, folder):
    s = logs(spark, folder).stored()
    return reports.analysis_lines(s, wire_findings(s)).select("document", "section", "text")


@query
def fabricated_rows(spark, folder):
    return r.fabricated_rows(logs(spark, folder)).select("session_id", "seq", "tool")


@query
def report_surface(spark, folder):
    return reports.report_surface(logs(spark, folder)).select("session_id", "side", "position", "tool", "fabricated")


@query
def recorded_records(spark, folder):
    """The events written as session logs, with the recorder's own records, broken and blank
    lines between them, and read back from the files."""
    frames = bridge.event_frames(bridge.table(spark, folder, "events"))
    mine = F.when(F.col("ord") % 7 == 0, F.format_string('{"type":"recorder.metrics","frames_seen":%d}', "ord")).when(
        F.col("ord") % 7 == 1, F.format_string('{"seq":%d', "ord")).when(F.col("ord") % 7 == 2, "[1]").when(F.col("ord") % 7 == 3, " ")
    extra = frames.select(F.col("session_id").alias("document"), F.lit(0).alias("section"), F.col("ord").alias("position"), mine.alias("text"))
    place = f"{shared_dir(spark)}/logs-{uuid.uuid4().hex}"
    reports.write_lines(reports.log_lines(frames).unionByName(extra.filter("text IS NOT NULL")), place)
    return read_written(spark, place).groupBy("session_id", "record_kind").agg(
        F.count("*").alias("records"), F.sum("seq").alias("seqs"), F.sum("frames_seen").alias("frames_seen"),
        F.sum(F.length("raw")).alias("raw_chars"), F.count_if(F.col("gate").isNotNull()).alias("gated"),
    )


@query
def recorded_pairing(spark, folder):
    """Pairing after the events went through log files, whose order is that of their lines."""
    place = f"{shared_dir(spark)}/logs-{uuid.uuid4().hex}"
    reports.write_lines(reports.log_lines(bridge.event_frames(bridge.table(spark, folder, "events"))), place)
    answers = d.Sessions(wire_frames(read_written(spark, place))).events.filter("role IN ('response', 'client_reply')")
    return answers.select("session_id", "seq", "responds_to", F.col("request.seq").alias("request_seq"), "orphaned")


@query
def drift_report(spark, folder):
    found = dr.drift(*day_prints(spark, folder)).select("server_key", "session_id", "kind", "severity", "explanation")
    return reports.drift_lines(written(found)).select("document", "section", "text")


@query
def last_recorded_metrics(spark, folder):
    """The recorder's last metrics record of every log, read from files."""
    frames = bridge.event_frames(bridge.table(spark, folder, "events"))
    mine = frames.filter("ord % 7 = 0").select(
        F.col("session_id").alias("document"), F.lit(0).alias("section"), F.col("ord").alias("position"),
        F.format_string('{"type":"recorder.metrics","frames_seen":%d,"log_bytes":%d}', "ord", F.col("ord") * 2).alias("text"),
    )
    place = f"{shared_dir(spark)}/logs-{uuid.uuid4().hex}"
    reports.write_lines(reports.log_lines(frames).unionByName(mine), place)
    return r.last_metrics(metrics_records(read_written(spark, place))).select("session_id", "frames_seen", "log_bytes")


@query
def findings_view_top(spark, folder):
    """The bounded view: five findings a session, and how many more there are."""
    top = r.top_findings(wire_findings(logs(spark, folder).stored()), 5)
    return top.select("session_id", "rank", "seq", "severity", "subcategory", "more_findings")


@query
def timeline_view_newest(spark, folder):
    """The bounded view: the last ten rows of a session, and how many are folded away."""
    s = logs(spark, folder).stored()
    rows = r.newest_rows(r.timeline(s.events, wire_findings(s)), 10)
    return rows.select("session_id", "row_index", "severity", "is_info", "collapsed_rows")
