"""Small reference inputs: registry answers and custom patterns."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.catalogue import ScanConfig, declared_patterns
from ..functions.jsonvalue import field, text_at


def read_registry(spark: SparkSession, folder: str) -> DataFrame:
    """Registry answers kept as <ecosystem>/<name>.json."""
    answer = F.try_parse_json("value")
    path = F.col("_metadata.file_path")
    return (
        spark.read.option("wholetext", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .text(folder)
        .select(
            F.regexp_extract(path, "([^/]+)/[^/]+$", 1).alias("ecosystem"),
            F.url_decode(F.regexp_extract(path, r"([^/]+)\.json$", 1)).alias("name"),
            text_at(answer, "$.status").alias("status"),
            F.coalesce(field(answer, "$.payload"), F.parse_json(F.lit("{}"))).alias("payload"),
            text_at(answer, "$.fetched_at").alias("fetched_at"),
        )
        .filter("status IS NOT NULL")
    )


def registry_key(name):
    """The file name under which a package's answer is kept."""
    return F.regexp_replace(name, "[^A-Za-z0-9._@-]", "_")


def read_patterns(
    spark: SparkSession, path: str, config: ScanConfig = ScanConfig(), strict: bool = True
) -> ScanConfig:
    """A config extended by the patterns of a JSON-array file.

    All patterns are checked before any is used.  A wrong file raises when strict;
    otherwise the config is returned as it was and the problem is printed.  The
    pattern file is configuration that every task gets, so it is read on the driver.
    """
    try:
        texts = [row.value for row in spark.read.option("wholetext", True).text(path).take(2)]
        if len(texts) != 1:
            raise ValueError(f"{path}: expected one file")
        rows = json.loads(texts[0])
        if not isinstance(rows, list) or not all(isinstance(row, dict) for row in rows):
            raise ValueError(f"{path}: expected a JSON array of patterns")
        return config.with_pattern(*declared_patterns(rows))
    except Exception as problem:
        if strict:
            raise
        print(f"custom patterns ignored ({path}): {problem}")
        return config
