"""Drift over sessions of one server."""

from pyspark.sql import functions as F

from sessionlens.operators import drift as dr
from sessionlens.operators.detectors import Sessions
from sessionlens.streaming.history import ITEMS, LiveDrift
from wire import call, frames, handshake, result, s2c, tool

OTHER = {"type": "object", "properties": {"query": {"type": "integer"}}}


def history(spark, steps, key=None):
    named = {f"202601{n:02d}T000000Z_srv_{n}": entries for n, entries in enumerate(steps, 1)}
    s = Sessions(frames(spark, named))
    prints = dr.fingerprints(s, key).withColumn("first_ts", F.lit("same"))
    return prints, dr.fingerprint_items(s)


def found(spark, steps, key=None):
    prints, items = history(spark, steps, key)
    rows = dr.drift(prints, items).orderBy("nth", "kind", "item").collect()
    return [(row.nth, row.kind, row.severity, row.item) for row in rows]


def test_each_kind_of_drift(spark):
    base = handshake()
    assert found(spark, [
        base,
        handshake([tool(), tool("second")]),                       # 2: new tool
        base,                                                      # 3: it is gone
        base[:3],                                                  # 4: no listing proves nothing
        handshake([tool(schema=OTHER)]),                           # 5: schema edited
        base + [call(3, "made_up")],                               # 6: fabricated
        base + [call(3, query="http://new.example.com:81/x")],     # 7: new host, first call
        base + [s2c(id=5, method="roots/list")],                   # 8: server request
        base + [call(3), call(4, "made_up"), result(3, content="http://new.example.com:81/y")],  # 9: nothing new
        handshake([tool(), tool("second")]),                       # 10: seen before
    ]) == [
        (2, "new_declared_tool", 2, "second"),
        (3, "removed_declared_tool", 1, "second"),
        (5, "schema_changed", 2, "web_search"),
        (6, "new_fabricated_tool", 3, "made_up"),
        (7, "new_called_tool", 1, "web_search"),
        (7, "new_host", 2, "new.example.com:81"),
        (8, "new_server_request", 2, "roots/list"),
    ]


def test_identity_and_version_with_a_given_grouping(spark):
    steps = [handshake(info={"name": "a", "version": "1"}), handshake(info={"name": "a", "version": "2"}),
             handshake(info={"name": "b", "version": "9"}), handshake(info={"name": "a", "version": "1"})]
    assert found(spark, steps, dr.file_server_name(F.col("session_id"))) == [
        (2, "server_version_changed", 1, "2"), (3, "server_identity_changed", 2, "b"),
    ]
    # grouped by the server's own name the third session starts its own history
    assert found(spark, steps) == [(2, "server_version_changed", 1, "2")]


def test_partial_logs_are_flagged(spark):
    prints, items = history(spark, [handshake(), handshake()])
    rows = dr.drift(prints.withColumn("tail_only", F.lit(True)), items).collect()
    assert [(row.nth, row.kind) for row in rows] == [(2, "tail_only_partial")]


def test_one_session_against_its_history(spark):
    prints, items = history(spark, [handshake(), handshake([tool(), tool("x")]), handshake([tool(), tool("y")])])
    rows = dr.drift_of_session(prints, items, "20260103T000000Z_srv_3").collect()
    assert sorted((row.kind, row.item) for row in rows) == [("new_declared_tool", "y"), ("removed_declared_tool", "x")]


def test_last_definition_is_hashed_and_key_order_is_not(spark):
    log = handshake([tool(schema={"b": 1, "a": 2})]) + [s2c(id=77, result={"tools": [tool(schema={"a": 2, "b": 1})]})]
    other = handshake([tool(schema={"a": 2, "b": 1})])
    items = dr.fingerprint_items(Sessions(frames(spark, {"one": log, "two": other}))).filter("kind = 'declared'")
    assert len({row.hash for row in items.collect()}) == 1


def test_drift_of_batches_equals_drift_of_all(spark, tmp_path):
    base = handshake(info={"name": "a", "version": "1"})
    steps = [
        base, handshake([tool(), tool("second")], info={"name": "a", "version": "2"}), base,
        base[:3], handshake([tool(schema=OTHER)]), base + [call(3, "made_up")], base + [call(3, query="http://new.example.com:81/x")],
        handshake([tool("second")], info={"name": "b", "version": "9"}), base + [call(3), call(4, "made_up"), s2c(id=5, method="roots/list")], base + [call(3, "late")],
    ]
    named = {f"202601{n:02d}T000000Z_{'srv' if n != 4 else 'own'}_{n}": entries for n, entries in enumerate(steps, 1)}
    rows = frames(spark, named)
    key = dr.file_server_name(F.col("session_id"))
    live = LiveDrift(spark, str(tmp_path / "live"), key, buckets=3)
    for number, (a, b) in enumerate(((1, 3), (4, 7), (8, 10))):
        live.absorb(rows.filter(F.substring("session_id", 7, 2).cast("int").between(a, b)), number)
    s = Sessions(rows)
    names = ["server_key", "session_id", "kind", "severity", "explanation", "item"]
    expected = sorted(map(str, dr.drift(dr.fingerprints(s, key), dr.fingerprint_items(s)).select(*names).collect()))
    assert sorted(map(str, live.findings().select(*names).collect())) == expected and len(expected) > 8


def test_items_of_one_server_are_written_by_many_tasks(spark, tmp_path):
    live = LiveDrift(spark.newSession(), str(tmp_path / "live"), buckets=2)
    live.spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    live.spark.conf.set("spark.sql.shuffle.partitions", "8")
    items = live.spark.range(400).selectExpr("cast(id AS string) AS session_id", "'declared' AS kind", "'x' AS item", "'h' AS hash", "'one' AS server_key")
    live.items.write(items, 0)
    assert len(list((tmp_path / "live/items").glob("bucket=*/batch=0/part-*.parquet"))) > 1
    assert live.items.read(ITEMS).count() == 400


def test_items_are_made_once(spark):
    """No branch of the comparison makes the items again."""
    prints = spark.createDataFrame(
        [("a", "s", "t1", "n", "1", False), ("b", "s", "t2", "n", "2", False)],
        "session_id string, server_key string, first_ts string, server_name string, server_version string, tail_only boolean",
    )
    raw = spark.createDataFrame([("a", "declared", "x", "1"), ("b", "declared", "x", "2"), ("b", "called", "x", None)], "session_id string, kind string, item string, hash string")
    items = raw.withColumn("item", F.reverse(F.reverse("item")))
    found = dr.drift(prints, items)
    assert "reverse" in items._jdf.queryExecution().optimizedPlan().toString()
    assert "reverse" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.session_id, r.kind) for r in found.collect()) == [("b", "new_called_tool"), ("b", "schema_changed"), ("b", "server_version_changed")]
