"""Lineage cuts that survive the loss of an executor, and dense numbering."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints: the one the cluster names, a fresh one in local tests."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        named = tempfile.mkdtemp(prefix="sessionlens-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read back.

    Unlike a checkpoint the result is columnar: later plans read the columns they
    use and push their filters down.
    """
    folder = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    table = df.sparkSession.read.schema(df.schema).parquet(folder)
    table.written_to = folder
    return table


def discard(*tables: DataFrame) -> None:
    """Remove the files of tables that ``written`` made and nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df``."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def with_dense_number(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str
) -> DataFrame:
    """Add a 1-based number within ``keys`` by ``order`` without one task per key.

    Rows are range-partitioned by keys and order, so a hot key spans many
    partitions; the slice of a key inside one partition is numbered there and
    shifted by the sizes of the key's earlier slices.  ``order`` must be unique
    within a key.  The sorted rows are checkpointed because two branches read the
    partition number.
    """
    slices = durable(
        df.repartitionByRange(*keys, *order).withColumn("_slice", F.spark_partition_id())
    )
    sizes = slices.groupBy(*keys, "_slice").agg(F.count("*").alias("_rows"))
    offsets = sizes.select(
        *keys,
        "_slice",
        (
            F.sum("_rows").over(Window.partitionBy(*keys).orderBy("_slice")) - F.col("_rows")
        ).alias("_offset"),
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    return (
        slices.withColumn("_inside", F.row_number().over(inside))
        .join(offsets, [*keys, "_slice"])
        .withColumn(out, (F.col("_inside") + F.col("_offset")).cast("bigint"))
        .drop("_inside", "_offset", "_slice")
    )
