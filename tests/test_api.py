"""The entry points over folders."""

import json

import sessionlens
from wire import call, handshake, log_text


def test_folders(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    gated = {**call(3, "ghost"), "gate": {"action": "blocked", "tool": "ghost"}}
    for name, entries in (("20260101T0Z_srv_1", handshake()), ("20260102T0Z_srv_2", handshake() + [gated])):
        (logs / f"{name}.jsonl").write_text("\n".join(log_text(entries)) + "\n")
    folder = str(logs)
    assert [r.session_id for r in sessionlens.list_sessions(spark, folder, 1).collect()] == ["20260102T0Z_srv_2"]
    found = [r.subcategory for r in sessionlens.analyze_session(spark, folder, "20260102T0Z_srv_2").collect()]
    assert found == ["fabricated_tool_call", "gate_blocked"]
    assert [r.tool for r in sessionlens.gate_status(spark, folder, "20260102T0Z_srv_2").collect()] == ["ghost"]
    assert [r.kind for r in sessionlens.watch_drift(spark, folder).collect()] == ["new_fabricated_tool"]

    trees = tmp_path / "trees" / "repo"
    trees.mkdir(parents=True)
    (trees / "a.py").write_text("eval('1')\n")
    (trees / "package.json").write_text('{"dependencies":{"x":"1"}}')
    found, scored = sessionlens.audit_servers(spark, str(tmp_path / "trees"))
    assert [(r.repo, r.score) for r in scored.collect()] == [("repo", 85)] and found.count() == 2
    answers = tmp_path / "registry" / "npm"
    answers.mkdir(parents=True)
    (answers / "x.json").write_text(json.dumps({"status": "not_found"}))
    rows = sessionlens.check_dependencies(spark, str(tmp_path / "trees"), str(tmp_path / "registry"), "2026-07-05")
    assert [r.rule for r in rows.collect()] == ["prov-not-in-registry"]
