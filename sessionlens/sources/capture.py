"""Captured HTTP bodies to session frames."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.blocks import computed_once, with_row_number
from ..streaming.tail import CHUNK_BYTES, RANGE_BYTES, listed_logs

# Fixed value: the note that stands for an event over the size limit.
OVERSIZE = '{"dropped":"sse_frame_dropped_oversize"}'


def _data_lines(event: Column) -> Column:
    lines = F.transform(F.split(event, "\n"), lambda l: F.regexp_replace(l, "\r$", ""))
    return F.transform(
        F.filter(lines, lambda l: l.startswith("data:")),
        lambda l: F.regexp_replace(l, "^data: *", ""),
    )


def _meta(event: Column) -> Column:
    lines = F.transform(F.split(event, "\n"), lambda l: F.regexp_replace(l, "\r$", ""))
    fields = F.filter(lines, lambda l: l.rlike("^(event|id|retry):"))
    entries = F.transform(
        fields,
        lambda l: F.struct(
            F.regexp_extract(l, "^(event|id|retry):", 1).alias("key"),
            F.regexp_replace(l, "^(event|id|retry): *", "").alias("value"),
        ),
    )
    names = ("event", "id", "retry")

    def last(name: str) -> Column:
        found = F.filter(entries, lambda e: e.key == name)
        return F.when(F.size(found) > 0, F.struct(F.lit(name).alias("key"), F.element_at(found, -1).value.alias("value")))

    present = F.filter(F.array(*[last(n) for n in names]), lambda e: e.isNotNull())
    return F.when(F.size(fields) > 0, F.map_from_entries(present))


def sse_frames(bodies: DataFrame, max_event_bytes: int | None = None) -> DataFrame:
    """Events of captured event-stream bodies as server-to-client lines.

    ``bodies`` has session_id, block, ord and body.  Events end at a blank line in
    any of its three spellings; the data lines of an event form one payload, its
    other fields ride along.  An event without data, and an unfinished last event,
    are kept as raw text; an event over a size limit the caller names becomes one note.
    """
    text = F.regexp_replace("body", "^\ufeff", "")
    kept = [c for c in bodies.columns if c != "body"]
    cut = computed_once(bodies, F.split(text, "\r\n\r\n|\n\n|\r\r").alias("parts"))
    events = cut.select(
        *kept, F.size("parts").alias("events"), F.posexplode("parts").alias("event_no", "event")
    ).filter("event RLIKE '\\\\S'")
    unfinished = F.col("event_no") == F.col("events") - 1
    return _framed(events, kept + ["event_no"], unfinished, max_event_bytes)


def _framed(events: DataFrame, kept: list[str], unfinished: Column, max_event_bytes: int | None) -> DataFrame:
    """Events (column ``event``) as frames or raw text, with their other fields."""
    data = _data_lines(F.col("event"))
    has_data = F.size(data) > 0
    oversize = F.lit(False) if max_event_bytes is None else F.octet_length("event") > max_event_bytes
    line = (
        F.when(oversize, F.lit(OVERSIZE))
        .when(unfinished | ~has_data, F.col("event"))
        .otherwise(F.array_join(data, "\n"))
    )
    lined = computed_once(
        events, line.alias("line"), F.when(has_data & ~unfinished & ~oversize, _meta(F.col("event"))).alias("sse_meta")
    )
    read = computed_once(lined, F.try_parse_json("line").alias("frame"))
    return read.select(
        *kept, F.lit("s2c").alias("dir"), "frame", F.when(F.col("frame").isNull(), F.col("line")).alias("raw"), "sse_meta"
    )


# ---- captures on disk, cut by byte ranges -----------------------------------------------------

# The three ways in which an event can end.
TERMINATOR = re.compile(rb"\r\n\r\n|\n\n|\r\r")
_EVENTS = "log string, ord bigint, event string, unfinished boolean"


def _run_start(handle, at: int) -> int:
    """First byte of the run of line ends that stands just before a place.

    Where terminators lie in a run depends on the run alone, so a search from its first byte
    finds the same terminators as one from the first byte of the capture.
    """
    while at > 0:
        back = min(CHUNK_BYTES, at)
        handle.seek(at - back)
        rest = handle.read(back).rstrip(b"\r\n")
        if rest:
            return at - back + len(rest)
        at -= back
    return 0


def _last_cut(handle, before: int) -> int:
    """End of the last terminator that ends at or before a place, 0 if there is none."""
    size, stop = CHUNK_BYTES, before
    while stop > 0:
        start = _run_start(handle, max(0, before - size))
        handle.seek(start)
        ends = [start + m.end() for m in TERMINATOR.finditer(handle.read(before - start))]
        if ends or not start:
            return ends[-1] if ends else 0
        size, stop = size * 2, start
    return 0


def completed_events(handle, start: int, stop: int, size: int) -> Iterator[tuple[int, bytes, bool]]:
    """(offset, event, unfinished) for every event whose terminator ends inside a range; what
    follows the last terminator of the capture belongs to the last range."""
    begin = _run_start(handle, start)
    handle.seek(begin)
    # a terminator of four bytes may end inside the range and begin before its last bytes
    data = handle.read(stop - begin)
    at = None
    for found in TERMINATOR.finditer(data):
        end = begin + found.end()
        if end <= start:
            continue
        if at is None:
            at = _last_cut(handle, begin + found.start())
            handle.seek(at)
            yield at, handle.read(begin + found.start() - at), False
        else:
            yield at, data[at - begin : found.start()], False
        at = end
    if stop == size:
        at = _last_cut(handle, size) if at is None else at
        handle.seek(at)
        yield at, handle.read(size - at), True


def read_captures(
    spark: SparkSession, folders: str | list[str], suffix: str = ".sse", range_bytes: int = RANGE_BYTES,
    max_event_bytes: int | None = None,
) -> DataFrame:
    """Frames of captured event streams, one file a session, read in byte ranges by many tasks.

    ``ord`` is the byte an event begins at, ``seq`` its number in the capture and ``ts`` the time
    the capture was last written, as events carry none.  A mark of byte order at the beginning
    is dropped; empty events have no row.
    """
    folders = [folders] if isinstance(folders, str) else list(folders)
    listed = listed_logs(spark, folders, suffix).filter("size > 0")
    first = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(range_bytes).cast("bigint"))).alias("start")
    ranges = listed.select("log", "size", first).withColumn("stop", F.least(F.col("size"), F.col("start") + range_bytes))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                system, place = files.FileSystem.from_uri(r["log"])
                with system.open_input_file(place) as handle:
                    held: list[tuple[int, bytes, bool]] = []
                    size = 0
                    for event in completed_events(handle, r["start"], r["stop"], r["size"]):
                        held.append(event)
                        size += len(event[1])
                        if size >= CHUNK_BYTES:
                            yield _event_rows(r["log"], held)
                            held, size = [], 0
                    yield _event_rows(r["log"], held)

    events = ranges.repartition("log", "start").mapInArrow(read, _EVENTS).filter("event RLIKE '\\\\S'")
    stamped = events.join(listed.select("log", "mtime"), "log").select(
        F.regexp_replace(F.substring_index("log", "/", -1), r"\.[^.]*$", "").alias("session_id"),
        F.floor(F.col("ord") / RANGE_BYTES).alias("block"), "ord",
        F.date_format("mtime", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"), "event", "unfinished",
    )
    framed = _framed(stamped, ["session_id", "block", "ord", "ts"], F.col("unfinished"), max_event_bytes)
    return with_row_number(framed.withColumn("gate", F.try_parse_json(F.lit(None).cast("string"))), ["session_id"], "seq")


def _event_rows(log: str, events: list[tuple[int, bytes, bool]]) -> pa.RecordBatch:
    bom = b"\xef\xbb\xbf"
    texts = [e.removeprefix(bom) if not at else e for at, e, _ in events]
    return pa.RecordBatch.from_pydict({
        "log": pa.array([log] * len(events), pa.string()),
        "ord": pa.array([at for at, _, _ in events], pa.int64()),
        "event": pa.array([t.decode("utf-8", errors="replace") for t in texts], pa.string()),
        "unfinished": pa.array([u for _, _, u in events], pa.bool_()),
    })
