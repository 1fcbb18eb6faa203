"""Source trees: every file of every repository below a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Vendored or generated directories.
SKIPPED = (
    "node_modules", ".git", "__pycache__", "venv", ".venv",
    "dist", "build", ".tox", ".mypy_cache", ".pytest_cache",
)


def read_trees(spark: SparkSession, folder: str, max_file_bytes: int | None = None) -> DataFrame:
    """Files as (repo, path, text); the first directory level names the repository.

    Directories of vendored code are skipped, as are files over a size limit the caller names.
    Bytes that are no UTF-8 become replacement characters.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(folder)
    )
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath().rstrip("/")
    below = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/+", "/"), f"^.*?\\Q{root}\\E/", "")
    placed = files.withColumn("below", below)
    return trees(placed, max_file_bytes)


def trees(files: DataFrame, max_file_bytes: int | None = None) -> DataFrame:
    """(below, length, content) rows as source files of repositories."""
    parts = F.split("below", "/")
    skipped = F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*[F.lit(d) for d in SKIPPED]))
    kept = files.filter(~skipped & (F.size(parts) > 1))
    if max_file_bytes is not None:
        kept = kept.filter(F.col("length") <= max_file_bytes)
    return kept.select(
        F.element_at(parts, 1).alias("repo"),
        F.array_join(F.slice(parts, 2, F.size(parts)), "/").alias("path"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("text"),
    )
