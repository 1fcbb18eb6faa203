"""A stable place for every row, so that two passes over the same rows can meet again."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import shared_dir, written

ROWS_SHIFT = 9
BATCH_ROWS = 1024


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with Arrow batches of its session small enough for rows of long texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def with_place(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns (new name = old name) with ``_file``, ``_row`` and ``_part``, which
    is 512 consecutive rows of a file; other columns are left out, so none can clash.

    Rows of files are known by file and row number, which do not depend on how the scan is
    split or on which executors are alive.  Other frames are written once to the shared folder.
    """
    small_batches(df)
    chosen = [F.col(f"`{old}`").alias(new) for new, old in columns.items()]
    try:
        placed = df.select(
            *chosen, F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")
        )
    except AnalysisException:
        numbered = df.select(*chosen).withColumn("_file", F.lit(0).cast("bigint"))
        placed = written(numbered.withColumn("_row", F.monotonically_increasing_id()))
    return placed.withColumn("_part", F.shiftright("_row", ROWS_SHIFT))


def discard(df: DataFrame) -> None:
    """Remove the files of a table that ``written`` made and nothing reads any more."""
    spark = df.sparkSession
    shared = shared_dir(spark).rstrip("/")
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if folder.rpartition("/")[2].startswith("table-") and shared.rpartition("/")[2] in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
