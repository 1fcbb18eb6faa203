"""Wall time of the registered queries and throughput on recorded frames; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores, BENCH_QUERIES (comma separated) a
choice of queries, BENCH_FRAMES the size of the frame benchmark (0 leaves it out).
Every query runs three times and its median is reported, the frame benchmark's detector
pass twice; the sink is a no-op, so all rows are computed and none are collected.
"""

from __future__ import annotations

import json
import os
import statistics
import time

HEADLINE = (
    "event_classification request_pairing causal_parent session_context fabricated_calls schema_violations "
    "server_requests orphaned_responses call_order all_findings policy_verdicts drift document_hits "
    "argument_leaks redacted_documents egress_findings audit_scores provenance_findings"
).split()


def timed(run, times: int) -> float:
    seconds = []
    for _ in range(times):
        start = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        seconds.append(time.perf_counter() - start)
    return round(statistics.median(seconds), 3)


def recorded_sessions(spark, frames: int, per_session: int = 1000):
    """Log lines of sessions in the shape of the baseline: a handshake, then calls and results."""
    from pyspark.sql import functions as F

    n, place = F.col("id"), F.col("id") % per_session
    number = ((place - 1) / 2).cast("bigint") + 1
    step = [
        '{"jsonrpc":"2.0","id":1,"method":"initialize","params":{"protocolVersion":"2025-03-26"}}',
        '{"jsonrpc":"2.0","id":1,"result":{"protocolVersion":"2025-03-26","capabilities":{}}}',
        '{"jsonrpc":"2.0","method":"notifications/initialized"}',
        '{"jsonrpc":"2.0","id":2,"method":"tools/list"}',
        '{"jsonrpc":"2.0","id":2,"result":{"tools":[{"name":"web_search","inputSchema":{"type":"object"}}]}}',
    ]
    call = F.concat(
        F.lit('{"jsonrpc":"2.0","id":'), number,
        F.lit(',"method":"tools/call","params":{"name":"web_search","arguments":{"q":"query '), number,
        F.lit(' padding pad"}}}'),
    )
    result = F.concat(
        F.lit('{"jsonrpc":"2.0","id":'), number,
        F.lit(',"result":{"content":[{"type":"text","text":"result '), number,
        F.lit(" " + "body " * 8 + '"}]}}'),
    )
    frame = F.when(place % 2 == 1, call).otherwise(result)
    for at, text in enumerate(step):
        frame = F.when(place == at, F.lit(text)).otherwise(frame)
    to_server = F.when(place < 5, place.isin(0, 2, 3)).otherwise(place % 2 == 1)
    line = F.concat(
        F.lit('{"schema_version":"0.1","seq":'), place + 1, F.lit(',"ts":"t'), place,
        F.lit('","dir":"'), F.when(to_server, "c2s").otherwise("s2c"),
        F.lit('","frame":'), frame, F.lit(',"raw":null}'),
    )
    return spark.range(frames).select(
        F.format_string("20260101T000000Z_srv_%d", (n / per_session).cast("bigint")).alias("session_id"),
        F.lit(0).cast("bigint").alias("block"), place.alias("ord"), line.alias("value"),
        F.lit(False).alias("tail_only"),
    )


def frame_rates(spark, frames: int) -> dict:
    """Frames per second of ingest (text to typed events) and of all detectors."""
    from sessionlens.operators.detectors import Sessions, detect
    from sessionlens.plans.durable import written
    from sessionlens.sources.logs import parse_records, wire_frames

    lines = written(recorded_sessions(spark, frames))

    def sessions():
        return Sessions(wire_frames(parse_records(lines)))

    ingest = timed(lambda: sessions().events, 3)
    detected = timed(lambda: detect(sessions().stored()), 2)
    return {
        "frames": frames,
        "ingest_sec": ingest,
        "ingest_frames_per_sec": int(frames / ingest),
        "ingest_and_detect_sec": detected,
        "ingest_and_detect_frames_per_sec": int(frames / detected),
    }


def main() -> None:
    from sessionlens.queries import QUERIES
    from sessionlens.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else [n for n in HEADLINE if n in QUERIES]
    if names == ["all"]:
        names = list(QUERIES)
    spark = local_session(cpus, int(cpus))
    spark.sparkContext.setLogLevel("OFF")
    seconds = {name: timed(lambda q=QUERIES[name]: q(spark, folder), 3) for name in names}
    frames = int(os.environ.get("BENCH_FRAMES", "1000000"))
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")),
                "master": f"local[{cpus}]",
                "frame_benchmark": frame_rates(spark, frames) if frames else None,
            }
        )
    )


if __name__ == "__main__":
    main()
