"""Pairing, parents and order against a plain fold, on random logs with tiny blocks."""

import random

from pyspark.sql import functions as F

from sessionlens.operators.detectors import Sessions
from sessionlens.operators.events import with_parents
from sessionlens.plans.blocks import with_first_after, with_last_before, with_row_number
from wire import c2s, frames, s2c

IDS = [1, 2, "1", None]


def entry(rng):
    number = rng.choice(IDS)
    kind = rng.randrange(8)
    if kind == 0:
        return c2s(id=number, method="tools/call", params={"name": rng.choice(["a", "b", "<c>"])})
    if kind == 1:
        return c2s(id=number, method=rng.choice(["initialize", "tools/list"]))
    if kind == 2:
        return c2s(method="notifications/initialized")
    if kind == 3:
        return c2s(id=number, result={})
    if kind == 4:
        return s2c(id=number, method=rng.choice(["ping", "roots/list"]))
    if kind == 5:
        return s2c(id=number, error={"code": 1, "message": "m"})
    if kind == 6:
        return rng.choice(["not json", {"dir": "s2c", "frame": None}, {"dir": "x2y", "frame": {"id": 1, "result": {}}}])
    return s2c(id=number, result={"tools": [{"name": "a"}]})


def fold(entries):
    """(seq, kind, answered label, parent, orphaned) per event, one dictionary per direction."""
    client, server, out, last = {}, {}, [], None
    for seq, e in enumerate(entries, 1):
        if isinstance(e, str):
            out.append((None, "message", None, last, False))
            last = None
            continue
        frame, way = e["frame"], e["dir"]
        if frame is None or way not in ("c2s", "s2c"):
            continue
        number, method = frame.get("id"), frame.get("method")
        key = (type(number).__name__, number)
        kind, label, parent, orphaned = "message", None, last, False
        if way == "c2s" and method:
            kind = "tool_call" if method == "tools/call" else "message"
            if number is not None:
                client[key] = (seq, frame["params"]["name"] if kind == "tool_call" else f"<{method}>")
        elif way == "s2c" and method:
            if number is not None:
                server[key] = (seq, f"<{method}>")
        else:
            hit = (client if way == "s2c" else server).pop(key, None) if number is not None else None
            orphaned = hit is None and number is not None
            if hit:
                parent, label = hit
            if way == "s2c":
                kind = "tool_result" if hit and not label.startswith("<") else "state_change"
        out.append((seq, kind, label, parent, orphaned))
        last = seq
    return out


def test_events_equal_the_fold(spark):
    rng = random.Random(7)
    logs = {f"s{n}": [entry(rng) for _ in range(60)] for n in range(40)}
    events = with_parents(Sessions(frames(spark, logs, block_rows=5)).events)
    got = {name: [] for name in logs}
    for row in events.orderBy("session_id", "ord").collect():
        parent = row.parent.seq if row.parent else None
        got[row.session_id].append((row.seq, row.kind, row.responds_to, parent, row.orphaned))
    assert got == {name: fold(entries) for name, entries in logs.items()}


def test_block_carries_equal_one_window(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), n // 7, n, rng.choice([None, None, n])) for n in range(400)]
    df = spark.createDataFrame(rows, "g string, block bigint, ord bigint, v bigint")
    out = with_row_number(
        with_first_after(with_last_before(df, ["g"], F.col("v"), "before"), ["g"], F.col("v"), "after"), ["g"], "nth", "size"
    )
    for row in out.collect():
        own = [r for r in rows if r[0] == row.g]
        before = [r[3] for r in own if r[2] < row.ord and r[3] is not None]
        after = [r[3] for r in own if r[2] > row.ord and r[3] is not None]
        assert row.before == (before[-1] if before else None)
        assert row.after == (after[0] if after else None)
        assert row.nth == sum(r[2] <= row.ord for r in own) and row["size"] == len(own)
