"""Growing session logs as a stream, planned from a table of offsets.

Spark's file source never looks at a file again after it was read, so a log that grows
needs its own plan.  ``LogTail.poll`` lists the logs on executors, joins the listing with the
offsets written before and writes two tables under the next version: the new offsets, and the
byte ranges that became readable.  ``LogTail.lines`` is Spark's own file stream over the
ranges, mapped to lines by the tasks.  No list of logs passes through the driver, and the
stream's progress is kept by its checkpoint.

Every log has an epoch.  A log that shrank was replaced: its epoch rises, it is read again
from zero, and its first range gives one row without a line, so that readers drop what they
hold of earlier epochs even before a line is complete.  A log that vanished keeps its row.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.logs import parse_records

LINES = "session_id string, epoch bigint, ord bigint, block bigint, value string, tail_only boolean"
OFFSETS = "log string, epoch bigint, start bigint, bytes bigint, restarted boolean, cut boolean, tail_only boolean"
RANGES = "log string, epoch bigint, start bigint, stop bigint, restarted boolean, cut boolean, tail_only boolean"
RANGE_BYTES = 1 << 27
CHUNK_BYTES = 1 << 20


def line_start(handle, before: int) -> int:
    """Offset just after the last newline before a position."""
    at = before
    while at > 0:
        back = min(CHUNK_BYTES, at)
        handle.seek(at - back)
        found = handle.read(back).rfind(b"\n")
        if found >= 0:
            return at - back + found + 1
        at -= back
    return 0


def completed_lines(path: str, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) for every line completed inside the range.

    A line belongs to the range that holds its newline, so ranges never share a
    line, and a last line without newline waits for a later range.
    """
    system, place = files.FileSystem.from_uri(path)
    try:
        handle = io.BufferedReader(system.open_input_file(place), CHUNK_BYTES)
    except FileNotFoundError:
        return  # it vanished since it was listed
    with handle:
        at = line_start(handle, start)
        handle.seek(at)
        while True:
            line = handle.readline()
            if not line.endswith(b"\n") or at + len(line) > stop:
                return
            yield at, line
            at += len(line)


def listed_logs(spark: SparkSession, folders: list[str], suffix: str) -> DataFrame:
    """``log, size, mtime`` of the files in each folder, listed by one task a folder."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                system, place = files.FileSystem.from_uri(folder)
                scheme = folder.partition("://")[0] + "://" if "://" in folder else ""
                found = system.get_file_info(files.FileSelector(place, allow_not_found=True))
                found = [f for f in found if f.type == files.FileType.File and f.base_name.endswith(suffix)]
                yield pa.RecordBatch.from_pydict({
                    "log": pa.array([scheme + f.path for f in found], pa.string()),
                    "size": pa.array([f.size for f in found], pa.int64()),
                    "mtime": pa.array([f.mtime for f in found], pa.timestamp("us", "UTC")),
                })

    rows = spark.createDataFrame([(f,) for f in folders], "folder string")
    return rows.repartition(len(folders), "folder").mapInArrow(entries, "log string, size bigint, mtime timestamp")


def next_offsets(before: DataFrame, listing: DataFrame, tail_cap: int | None) -> DataFrame:
    """Offsets after a listing: what each log holds now and from where it is to be read."""
    held, size = F.coalesce("bytes", F.lit(0)), F.coalesce("size", "bytes")
    both = before.select("log", "epoch", "bytes", F.col("tail_only").alias("was_partial")).join(listing, "log", "full")
    shrank = size < held
    start = F.when(shrank, 0).otherwise(held)
    partial = (start == 0) & (size > (tail_cap if tail_cap is not None else (1 << 62)))
    return both.select(
        "log",
        (F.coalesce("epoch", F.lit(0)) + shrank.cast("bigint")).alias("epoch"),
        F.when(partial, size - F.lit(tail_cap)).otherwise(start).cast("bigint").alias("start"),
        size.alias("bytes"),
        shrank.alias("restarted"),
        partial.alias("cut"),
        (partial | (~shrank & F.coalesce("was_partial", F.lit(False)))).alias("tail_only"),
    )


def byte_ranges(offsets: DataFrame, size: int) -> DataFrame:
    """The unread bytes of every log in ranges of bounded size."""
    first = F.explode(F.sequence("start", F.greatest("start", F.col("bytes") - 1), F.lit(size).cast("bigint"))).alias("at")
    return offsets.filter("bytes > start OR restarted").select("*", first).select(
        "log", "epoch", F.col("at").alias("start"), F.least("bytes", F.col("at") + size).alias("stop"),
        *[(F.col(flag) & (F.col("at") == F.col("start"))).alias(flag) for flag in ("restarted", "cut")], "tail_only",
    )


class LogTail:
    """Logs of ``folders`` followed with the tables of ``work``, a folder of their own.

    ``tail_cap_bytes`` reads only the last bytes of a log that is larger when first seen.
    """

    def __init__(
        self, spark: SparkSession, folders: str | list[str], work: str, suffix: str = ".jsonl",
        range_bytes: int = RANGE_BYTES, tail_cap_bytes: int | None = None,
    ):
        self.spark, self.work, self.suffix = spark, work, suffix
        self.folders = [folders] if isinstance(folders, str) else list(folders)
        self.range_bytes, self.tail_cap = range_bytes, tail_cap_bytes
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.system = self.path(work).getFileSystem(spark._jsc.hadoopConfiguration())
        self.system.mkdirs(self.path(f"{work}/ranges"))

    def _exists(self, name: str) -> bool:
        return self.system.exists(self.path(f"{self.work}/{name}"))

    def version(self) -> int:
        """The newest whole version of the offsets, -1 before the first."""
        if not self._exists("offsets"):
            return -1
        names = [s.getPath().getName() for s in self.system.listStatus(self.path(f"{self.work}/offsets"))]
        return max((int(n.rpartition("=")[2]) for n in names if self._exists(f"offsets/{n}/_SUCCESS")), default=-1)

    def offsets(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if version < 0:
            return self.spark.createDataFrame([], OFFSETS)
        return self.spark.read.schema(OFFSETS).parquet(f"{self.work}/offsets/version={version}")

    def _publish(self, version: int) -> None:
        """The ranges of a version, which appear under their name only when whole."""
        name, made = f"ranges/version={version}", f"{self.work}/_ranges-{version}"
        if version >= 0 and not self._exists(name):
            byte_ranges(self.offsets(version), self.range_bytes).write.mode("overwrite").parquet(made)
            self.system.rename(self.path(made), self.path(f"{self.work}/{name}"))

    def poll(self) -> bool:
        """Look at the logs once; whether any of them has new bytes or was replaced."""
        before = self.version()
        self._publish(before)  # a stop after the offsets were written left it out
        name = f"offsets/version={before + 1}"
        planned = next_offsets(self.offsets(before), listed_logs(self.spark, self.folders, self.suffix), self.tail_cap)
        planned.write.mode("overwrite").parquet(f"{self.work}/{name}")
        changed = not self.offsets(before + 1).filter("bytes > start OR restarted").isEmpty()
        if not changed:
            self.system.delete(self.path(f"{self.work}/{name}"), True)
        else:
            self._publish(before + 1)
            if before > 0:
                self.system.delete(self.path(f"{self.work}/offsets/version={before - 1}"), True)
        return changed

    def lines(self) -> DataFrame:
        """Stream of completed lines; a replaced log begins with a row without a line."""
        found = self.spark.readStream.schema(RANGES).parquet(f"{self.work}/ranges")
        return found.repartition("log", "start").mapInArrow(range_lines, LINES)

    def records(self) -> DataFrame:
        """Stream of log records; see ``parse_records``."""
        text = F.regexp_replace("value", r"^\s+|\s+$", "")
        return parse_records(self.lines().withColumn("value", text).filter("value IS NULL OR value <> ''"))


def range_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of byte ranges, with their offset in the log as ``ord``."""
    for batch in batches:
        for r in batch.to_pylist():
            offsets, texts, held = ([-1], [None], 0) if r["restarted"] else ([], [], 0)
            for offset, line in completed_lines(r["log"], r["start"], r["stop"]):
                if r["cut"] and offset <= r["start"]:
                    continue  # the line the cut fell into
                offsets.append(offset)
                texts.append(line[:-1].decode("utf-8", errors="replace"))
                held += len(line)
                if held >= CHUNK_BYTES:
                    yield _lines(r, offsets, texts)
                    offsets, texts, held = [], [], 0
            yield _lines(r, offsets, texts)


def _lines(r: dict, offsets: list[int], texts: list[str | None]) -> pa.RecordBatch:
    n = len(offsets)
    session = r["log"].rpartition("/")[2].rsplit(".", 1)[0]
    return pa.RecordBatch.from_pydict({
        "session_id": pa.array([session] * n, pa.string()),
        "epoch": pa.array([r["epoch"]] * n, pa.int64()),
        "ord": pa.array(offsets, pa.int64()),
        "block": pa.array([max(0, o) // RANGE_BYTES for o in offsets], pa.int64()),
        "value": pa.array(texts, pa.string()),
        "tail_only": pa.array([r["tail_only"]] * n, pa.bool_()),
    })
