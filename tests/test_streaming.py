"""Growing logs: the stream agrees with the batch after every step."""

import json

from sessionlens.operators.detectors import Sessions, call_order, detect, fabricated_calls, schema_violations
from sessionlens.sources.logs import read_records, wire_frames
from sessionlens.operators.events import build_events, classify_frames
from sessionlens.operators.rollups import session_counters
from sessionlens.streaming.live import BucketTable, LiveFindings, LiveView
from sessionlens.streaming.state import live_pairing, live_policy, open_requests, state_sizes
from sessionlens.streaming.tail import LogTail, completed_lines
from wire import c2s, call, frames, handshake, log_text, result, s2c

CHOSEN = (fabricated_calls, call_order, schema_violations)


def key(rows):
    return sorted((r.session_id, r.subcategory, r.seq, r.explanation) for r in rows)


def batch_findings(spark, folder):
    return key(detect(Sessions(wire_frames(read_records(spark, str(folder)))), CHOSEN).collect())


def drain(live, tail, work):
    tail.poll()
    query = live.start(tail.records().filter("record_kind <> 'self'"), str(work / "check"))
    assert query.awaitTermination(120) and query.exception() is None


def test_findings_follow_the_log(spark, tmp_path):
    logs, work = tmp_path / "logs", tmp_path / "work"
    logs.mkdir()
    lines = log_text([call(3), *handshake(), call(4, "ghost"), call(5, limit=1)])
    live = LiveFindings(spark, str(work / "live"), CHOSEN, buckets=4)
    tail = LogTail(spark, str(logs), str(work / "tail"), range_bytes=200)

    path = logs / "one.jsonl"
    path.write_text(lines[0] + "\n")
    drain(live, tail, work)
    assert [r.subcategory for r in live.findings().orderBy("subcategory").collect()] == ["fabricated_tool_call", "premature_call"]

    # a partial last line is held back; the declaration retracts the fabricated call
    with path.open("a") as handle:
        handle.write("\n".join(lines[1:7]) + "\n" + lines[7][:20])
    (logs / "two.jsonl").write_text("\n".join(log_text(handshake() + [call(3, "ghost")])) + "\n")
    drain(live, tail, work)
    assert key(live.findings().collect()) == [
        x for x in batch_findings(spark, logs) if x[2] != 8
    ]
    assert ("one", "fabricated_tool_call", 1) not in {x[:3] for x in key(live.findings().collect())}

    with path.open("a") as handle:
        handle.write(lines[7][20:] + "\n")
    drain(live, tail, work)
    assert key(live.findings().collect()) == batch_findings(spark, logs)

    # the log is rotated: its earlier frames no longer count, even before a line is complete
    path.write_text("{")
    drain(live, tail, work)
    assert {x[0] for x in key(live.findings().collect())} == {"two"}
    path.write_text("\n".join(log_text([*handshake()[:3], call(1)])) + "\n")
    drain(live, tail, work)
    assert key(live.findings().collect()) == batch_findings(spark, logs)

    # a vanished log keeps its findings, a look without news plans nothing
    path.unlink()
    version = tail.version()
    assert not tail.poll() and tail.version() == version
    drain(live, tail, work)
    assert {x[0] for x in key(live.findings().collect())} == {"one", "two"}
    assert {r.log.rpartition("/")[2]: r.epoch for r in tail.offsets().collect()} == {"one.jsonl": 1, "two.jsonl": 0}

    # the changes alone give every state, and the declaration's batch retracts the call
    last = live.changes().agg({"batch": "max"}).first()[0]
    assert key(live.replayed(last).collect()) == key(live.findings().collect())
    gone = live.changes().filter("op = 'retract' AND batch = 1").collect()
    assert [(r.session_id, r.subcategory) for r in gone] == [("one", "fabricated_tool_call")]


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    live = LiveFindings(spark, str(tmp_path / "live"), CHOSEN)
    rows = frames(spark, {"s": handshake() + [call(3, "ghost")]})
    live.absorb(rows, 0)
    first = key(live.findings().collect())
    live.absorb(rows, 0)
    assert key(live.findings().collect()) == first and len(first) == 1


def test_ranges_share_no_line(tmp_path):
    path = tmp_path / "x.jsonl"
    text = b"".join(b"x" * n + b"\n" for n in range(1, 40)) + b"unfinished"
    path.write_bytes(text)
    whole = list(completed_lines(str(path), 0, len(text)))
    for step in (1, 7, 64, 1000):
        parts = [x for at in range(0, len(text), step) for x in completed_lines(str(path), at, min(len(text), at + step))]
        assert parts == whole
    assert whole[-1][1] == b"x" * 39 + b"\n"


def test_a_stop_between_offsets_and_ranges(spark, tmp_path):
    logs, work = tmp_path / "logs", tmp_path / "work"
    logs.mkdir()
    (logs / "a.jsonl").write_text("one\ntwo\n")
    tail = LogTail(spark, str(logs), str(work), range_bytes=3)
    publish, tail._publish = tail._publish, lambda version: None
    assert tail.poll() and tail.version() == 0
    tail._publish = publish
    assert not tail.poll() and (work / "ranges" / "version=0").exists()
    query = tail.lines().writeStream.format("memory").queryName("lines").trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    rows = spark.sql("SELECT session_id, epoch, ord, value FROM lines ORDER BY ord").collect()
    assert [tuple(r) for r in rows] == [("a", 0, 0, "one"), ("a", 0, 4, "two")]


def test_only_the_tail_of_a_large_log(spark, tmp_path):
    logs, work = tmp_path / "logs", tmp_path / "work"
    logs.mkdir()
    (logs / "a.jsonl").write_text("".join(f"line{k}\n" for k in range(9)))
    tail = LogTail(spark, str(logs), str(work), range_bytes=4, tail_cap_bytes=20)

    def lines(name):
        query = tail.lines().writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
        assert query.awaitTermination(60)
        return [(r.value, r.tail_only) for r in spark.table(name).orderBy("ord").collect()]

    tail.poll()
    assert lines("first") == [(f"line{k}", True) for k in (6, 7, 8)]
    with (logs / "a.jsonl").open("a") as handle:
        handle.write("line9\n" * 9)
    tail.poll()
    assert lines("second") == [(f"line{k}", True) for k in (6, 7, 8, *[9] * 9)]


def staged(spark, sessions, cuts, work):
    """The frames of sessions as files that a stream reads one after the other."""
    rows = frames(spark, sessions)
    names = ["session_id", "block", "ord", "seq", "ts", "dir", "frame", "raw", "gate"]
    rows = rows.select(*names)
    bounds = [0, *cuts, 1 << 40]
    for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        rows.filter(f"ord >= {a} AND ord < {b}").coalesce(1).write.parquet(f"{work}/part{k}")
    return rows, spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{work}/part*")


PAIRS = {
    "a": [call(1), call(2), result(2), call(1), result(1), result(1), *[x for k in range(9) for x in (call(7, f"t{k}"), result(7))], s2c(id=1, method="ping"),
          c2s(id=1, result={}), c2s(id=1, result={}), call("1"), result(1), result("1"), call(5)],
    "b": [result(3), call(3), call(3, "again"), s2c(method="note"), call(4), result(3), result(4), c2s(id=8, method="initialize"), result(8, x=1)],
}


def test_pairing_state(spark, tmp_path):
    rows, stream = staged(spark, PAIRS, (3, 9, 10, 17), tmp_path / "in")
    query = (
        live_pairing(stream, shards=3).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    )
    assert query.awaitTermination(180) and query.exception() is None
    events = build_events(classify_frames(rows))
    answers = events.filter("role IN ('response', 'client_reply')").selectExpr(
        "session_id", "ord", "seq", "responds_to", "request.ord AS request_ord", "request.seq AS request_seq", "orphaned"
    )
    expected = sorted(map(tuple, answers.collect()), key=str)
    got = spark.read.parquet(str(tmp_path / "out")).select(*answers.columns).collect()
    assert sorted(map(tuple, got), key=str) == expected
    sizes = state_sizes(query)
    assert len({s["batch"] for s in sizes}) >= 4 and sizes[-1]["rows"] > 0
    held = {(r.session_id, r.space, r.id_key, r.label) for r in open_requests(spark, str(tmp_path / "check")).collect()}
    assert held == {("a", "client", "5", "web_search")}


def test_pairing_keys_do_not_grow_with_sessions(spark, tmp_path):
    sessions = {f"s{n}": [call(1), result(1), call(2)] for n in range(40)}
    _, stream = staged(spark, sessions, (3,), tmp_path / "in")
    query = (
        live_pairing(stream, shards=4).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    )
    assert query.awaitTermination(180) and query.exception() is None
    state = spark.read.format("statestore").option("path", str(tmp_path / "check")).option("stateVarName", "open").load()
    assert state.select("key").distinct().count() <= 4
    held = {(r.session_id, r.id_key) for r in open_requests(spark, str(tmp_path / "check")).collect()}
    assert held == {(f"s{n}", "2") for n in range(40)}


def test_changes_of_a_view(spark, tmp_path):
    sessions = {
        "a": [call(3, "late"), call(4, "ghost"), *handshake()[:4], s2c(id=2, result={"tools": [{"name": "late"}]}), call(5, "late")],
        "b": [call(1, "x"), result(1)],
    }
    def counters(s):
        return session_counters(s, fabricated_calls(s))

    rows, stream = staged(spark, sessions, (2, 7), tmp_path / "in")
    live = LiveView(spark, str(tmp_path / "live"), counters, buckets=3)
    found = LiveFindings(spark, str(tmp_path / "found"), (fabricated_calls,), buckets=3)
    for view, name in ((live, "one"), (found, "two")):
        query = view.start(stream, str(tmp_path / name))
        assert query.awaitTermination(180) and query.exception() is None
    bounds = (2, 7, 1 << 40)
    for number, bound in enumerate(bounds):
        s = Sessions(rows.filter(f"ord < {bound}"))
        assert sorted(map(str, live.replayed(number).collect())) == sorted(map(str, counters(s).collect()))
        assert key(found.replayed(number).collect()) == key(fabricated_calls(s).collect())
    assert sorted(map(str, live.current().collect())) == sorted(map(str, live.replayed(2).collect()))
    feed = [(r.batch, r.op, r.session_id) for r in live.feed("session_id").orderBy("batch", "session_id").collect()]
    assert feed[:2] == [(0, "insert", "a"), (0, "insert", "b")] and ("update" in {f[1] for f in feed}) and all(f[1] != "delete" for f in feed)
    retracted = found.changes().filter("op = 'retract'").collect()
    assert ("a", "fabricated_tool_call", 1) in {(r.session_id, r.subcategory, r.seq) for r in retracted}


def test_frames_are_parsed_once_and_a_bucket_written_by_many_tasks(spark, tmp_path, monkeypatch):
    plans = []

    def view(s):
        plans.append(s.lines._jdf.queryExecution().optimizedPlan().toString())
        return fabricated_calls(s)

    sessions = {"a": [call(n, "ghost") for n in range(60)] + [{"dir": "c2s", "frame": None}]}
    rows, _ = staged(spark, sessions, (2,), tmp_path / "in")
    live = LiveView(spark, str(tmp_path / "live"), view, buckets=1)
    live.absorb(rows, 0)
    assert "Generate" not in plans[0]
    assert live.current().count() == 60
    held = BucketTable(spark, str(tmp_path / "few"), 2)
    # Spark joins small partitions again unless told not to
    monkeypatch.setattr(held, "spark", spark.newSession())
    held.spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    held.spark.conf.set("spark.sql.shuffle.partitions", "8")
    held.write(held.spark.range(1000).selectExpr("cast(id AS string) AS session_id"), 0)
    assert held.read("session_id string").count() == 1000
    assert len(list((tmp_path / "few").glob("bucket=*/batch=0/part-*.parquet"))) > 2


def test_policy_stream(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    log = log_text([call(1), call(2, "ghost"), *handshake(), call(3), call(4, "ghost"), s2c(id=9, result={"tools": []}), call(5), result(5)])
    (logs / "s.jsonl").write_text("\n".join(log) + "\n")
    (logs / "quiet.jsonl").write_text("\n".join(log_text([call(1)])) + "\n")
    out = tmp_path / "out"

    tail = LogTail(spark, str(logs), str(tmp_path / "tail"))

    def run():
        tail.poll()
        query = (
            live_policy(tail.records(), hold=0.0)
            .writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "check"))
            .trigger(once=True).start()
        )
        assert query.awaitTermination(120) and query.exception() is None
        return sorted(tuple(r) for r in spark.read.parquet(str(out)).collect())

    got = run()
    assert [x for x in got if x[0] == "s"] == [
        ("s", 1, "web_search", "forward"), ("s", 2, "ghost", "blocked"), ("s", 8, "web_search", "forward"),
        ("s", 9, "ghost", "blocked"), ("s", 11, "web_search", "blocked"),
    ]
    with (logs / "s.jsonl").open("a") as handle:
        handle.write(json.dumps({"seq": 99, "ts": "t", "dir": "c2s", "frame": {"method": "tools/call", "params": {"name": "x"}}}) + "\n")
    got = run()
    assert ("s", 99, "x", "blocked") in got and ("quiet", 1, "web_search", "gate_skipped") in got

    # a replaced log starts without a surface
    (logs / "s.jsonl").write_text("\n".join(log_text([call(1, "early"), *handshake(), call(3, "late")])) + "\n")
    got = [x for x in run() if x[0] == "s"][-2:]
    assert ("s", 1, "early", "blocked") in run() and ("s", 7, "late", "blocked") in run(), got


def test_policy_sees_listings_before_calls(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        session = [*handshake([{"name": "a"}]), call(3, "a"), call(4, "b"), s2c(id=9, result={"tools": [{"name": "b"}]}), call(5, "a"), call(6, "b")]
        _, stream = staged(spark, {"s": session}, (), tmp_path / "in")
        query = (
            live_policy(stream.repartition(5, "ord")).writeStream.format("parquet").option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "check")).trigger(once=True).start()
        )
        assert query.awaitTermination(120) and query.exception() is None
        got = [(r.seq, r.verdict) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [(6, "forward"), (7, "blocked"), (9, "blocked"), (10, "forward")]
