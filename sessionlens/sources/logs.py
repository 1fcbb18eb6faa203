"""Session logs on disk: one JSON record per line, one file per session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.jsonvalue import field, is_object, text_at
from ..plans.blocks import computed_once, with_row_number

# Fixed value: bytes kept of a larger log when a tail cap is asked for.
TAIL_CAP_BYTES = 50_000_000
# Splits are at least this large, so a split number fits the upper bits of a position.
SPLIT_BITS, ROW_BITS = 20, 33


def _position(split_start: Column, row: Column) -> Column:
    """Line position in its file from the split's first byte and the row in the task.

    Rows of a split keep file order inside one task and splits of a file start at
    least 1 MiB apart, so the pair packed into one number is unique and increasing.
    """
    within = row.bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return F.shiftleft(F.shiftright(split_start, SPLIT_BITS), ROW_BITS) + within


def read_lines(spark: SparkSession, folder: str, pattern: str = "*.jsonl") -> DataFrame:
    """Every line of every log with its position; no line is dropped or reordered."""
    settings = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    for name in settings:
        if int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
            spark.conf.get(name)
        )) < 1 << SPLIT_BITS:
            raise ValueError(f"{name} must be at least 1 MiB for log positions")
    return (
        spark.read.option("pathGlobFilter", pattern)
        .text(folder)
        .select(
            "value",
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_name").alias("file_name"),
            F.col("_metadata.file_size").alias("file_size"),
            F.col("_metadata.file_modification_time").alias("mtime"),
            _position(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("ord"),
        )
        .withColumn("block", F.shiftright("ord", ROW_BITS))
        .withColumn("session_id", F.regexp_replace("file_name", r"\.[^.]*$", ""))
    )


def tail_of(lines: DataFrame, cap: int) -> DataFrame:
    """Lines of large logs that lie wholly in the last ``cap`` bytes, flagged as partial.

    Bytes after a line are summed per (log, block) first; only one row per block
    meets in the log's own window.
    """
    size = F.octet_length("value") + 1
    group = ["session_id", "block"]
    blocks = lines.groupBy(*group).agg(F.sum(size).alias("bytes"))
    later = Window.partitionBy("session_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        *group,
        F.coalesce(F.sum("bytes").over(later), F.lit(0)).alias("_later"),
        F.sum("bytes").over(Window.partitionBy("session_id")).alias("_counted"),
    )
    inside = Window.partitionBy(*group).orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, 0)
    return (
        lines.withColumn("_from_here", F.sum(size).over(inside))
        .join(offsets, group)
        .withColumn("tail_only", F.col("file_size") > cap)
        # a last line without a newline was counted one byte too long
        .withColumn("_to_end", F.expr("_from_here + _later - greatest(0, _counted - file_size)"))
        # the line the cut falls into is dropped, as is a line that starts exactly there
        .filter(~F.col("tail_only") | (F.col("_to_end") < cap))
        .drop("_from_here", "_later", "_counted", "_to_end")
    )


def read_records(
    spark: SparkSession,
    folder: str,
    pattern: str = "*.jsonl",
    tail_cap_bytes: int | None = None,
    self_prefix: str = "[A-Za-z0-9_-]+",
) -> DataFrame:
    """All records of the logs in ``folder``, one row per non-blank line.

    record_kind is wire (a JSON object), raw (not JSON; kept as text), bad (JSON but
    no object) or self (written by a recorder about itself: ``type`` is
    ``<self_prefix>.<word>`` and there is no ``frame``, ``raw`` or ``dir``).  By default whole logs are read; a tail cap keeps the
    last bytes of larger logs and flags them.
    """
    lines = read_lines(spark, folder, pattern)
    if tail_cap_bytes is None:
        lines = lines.withColumn("tail_only", F.lit(False))
    else:
        lines = tail_of(lines, tail_cap_bytes)
    text = F.regexp_replace("value", r"^\s+|\s+$", "")
    return parse_records(lines.withColumn("value", text).filter("value <> ''"), self_prefix)


def read_written(spark: SparkSession, folder: str, self_prefix: str = "[A-Za-z0-9_-]+") -> DataFrame:
    """Records of the logs that ``write_lines`` wrote: a folder a log, its files in order."""
    # Spark lists up to 10,000 folders in a task each, which costs more than the listing
    setting = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(setting)
    spark.conf.set(setting, min(int(before), 4 * spark.sparkContext.defaultParallelism))
    try:
        lines = read_lines(spark, f"{folder}/document=*", "part-*")
    finally:
        spark.conf.set(setting, before)
    part = F.regexp_extract("file_name", r"^part-(\d+)", 1).cast("bigint")
    # a file of a log is under 1 TiB, so its splits fit below the number of the file
    block = F.shiftleft(part, SPLIT_BITS) + F.col("block")
    text = F.regexp_replace("value", r"^\s+|\s+$", "")
    placed = lines.withColumns({
        "session_id": F.regexp_extract("file_path", r"/document=([^/]*)/[^/]*$", 1),
        "ord": F.shiftleft(part, SPLIT_BITS + ROW_BITS) + F.col("ord"), "block": block,
        "value": text, "tail_only": F.lit(False),
    })
    return parse_records(placed.filter("value <> ''"), self_prefix)


def parse_records(lines: DataFrame, self_prefix: str = "[A-Za-z0-9_-]+") -> DataFrame:
    """Log lines (column ``value``) as typed records."""
    entry = F.col("entry")
    parsed = computed_once(lines, F.try_parse_json("value").alias("entry"))
    return computed_once(
        parsed,
        F.coalesce(is_object(entry), F.lit(False)).alias("_object"),
        text_at(entry, "$.type").alias("type"),
        F.coalesce(*[F.when(field(entry, f"$.{name}").isNotNull(), True) for name in ("frame", "raw", "dir")], F.lit(False)).alias("_traffic"),
    ).select(
        *[c for c in lines.columns if c != "value"],
        F.when(entry.isNull(), "raw")
        .when(~F.col("_object"), "bad")
        .when(F.col("type").rlike(rf"^{self_prefix}\.") & ~F.col("_traffic"), "self")
        .otherwise("wire")
        .alias("record_kind"),
        "type",
        text_at(entry, "$.schema_version").alias("schema_version"),
        F.try_variant_get(entry, "$.seq", "bigint").alias("seq"),
        F.coalesce(text_at(entry, "$.ts"), F.lit("")).alias("ts"),
        text_at(entry, "$.dir").alias("dir"),
        field(entry, "$.frame").alias("frame"),
        F.when(entry.isNull() | ~F.col("_object"), F.col("value")).otherwise(text_at(entry, "$.raw")).alias("raw"),
        field(entry, "$.gate").alias("gate"),
        F.try_variant_get(entry, "$.sse_meta", "map<string,string>").alias("sse_meta"),
        F.try_variant_get(entry, "$.frames_seen", "bigint").alias("frames_seen"),
        F.try_variant_get(entry, "$.frames_blocked", "bigint").alias("frames_blocked"),
        F.try_variant_get(entry, "$.session_duration_s", "double").alias("session_duration_s"),
        F.try_variant_get(entry, "$.log_bytes", "bigint").alias("log_bytes"),
    )


def wire_frames(records: DataFrame) -> DataFrame:
    """Records that are traffic: the input of the event operators."""
    return records.filter("record_kind <> 'self'")


def metrics_records(records: DataFrame) -> DataFrame:
    """The recorder's own metrics records."""
    return records.filter("record_kind = 'self' AND type LIKE '%.metrics'")


def list_logs(records: DataFrame) -> DataFrame:
    """One row per log: lines, modification time, partial flag."""
    return records.groupBy("session_id").agg(
        F.count("*").alias("frames"),
        F.max("mtime").alias("mtime"),
        F.max("tail_only").alias("tail_only"),
        (F.count_if(F.col("record_kind") == "wire") == 0).alias("unreadable"),
    )


def numbered_lines(lines: DataFrame) -> DataFrame:
    """1-based line number of every line of ``read_lines``, blank lines counted."""
    return with_row_number(lines, ["session_id"], "line_no")
