"""Ordered operators over groups of any size.

Rows of a session are ordered by ``ord``, which is unique in the session.  ``block``
is a coarse, monotone function of ``ord`` and holds a bounded number of rows (one
file split, or ``BLOCK_ROWS`` consecutive row numbers).  A window partitioned
by the session alone would put a hot session into one task, so every ordered
operator here runs in two levels: inside ``(keys, block)``, and over one summary
row per block whose result is carried back.  The shuffle key always contains the
block, so a session holding a third of all rows spreads over its blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 1 << 17


def block_of(row_number: Column, block_rows: int = BLOCK_ROWS) -> Column:
    """Block id of a unique, increasing row number."""
    return F.shiftright(row_number.cast("bigint"), block_rows.bit_length() - 1)


def computed_once(df: DataFrame, *columns: Column) -> DataFrame:
    """Add columns that later filters refer to without being evaluated again.

    A plain projection is substituted into every filter above it, which repeats
    costly parsing; a generator over a one-element array is not.
    """
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def balanced(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Spread an input of fewer splits than cores by its unique key.

    A small table, or one of few unsplittable row groups, would run its parsing in a
    few tasks.  An input with enough splits is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *key)


def with_previous(df: DataFrame, keys: Sequence[str], payload: Column, out: str) -> DataFrame:
    """Add ``payload`` of the row just before, within ``keys`` in log order."""
    group = [*keys, "block"]
    inside = Window.partitionBy(*group).orderBy("ord")
    tagged = df.withColumn("_payload", payload)
    tails = tagged.groupBy(*group).agg(F.max_by("_payload", "ord").alias("_tail"))
    over_blocks = Window.partitionBy(*keys).orderBy("block")
    carry = tails.select(
        *[F.col(k).alias(f"_k_{k}") for k in group],
        F.lag("_tail").over(over_blocks).alias("_carry"),
    ).filter("_carry IS NOT NULL")
    match = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in group]
    return (
        tagged.withColumn("_before", F.lag("_payload").over(inside))
        .join(carry, match, "left")
        .withColumn(out, F.coalesce("_before", "_carry"))
        .drop("_payload", "_before", "_carry", *[f"_k_{k}" for k in group])
    )


def with_last_before(df: DataFrame, keys: Sequence[str], value: Column, out: str) -> DataFrame:
    """Add the latest non-null ``value`` of the rows before, within ``keys``."""
    group = [*keys, "block"]
    before = Window.partitionBy(*group).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    tagged = df.withColumn("_value", value)
    tails = (
        tagged.filter("_value IS NOT NULL")
        .groupBy(*group)
        .agg(F.max_by("_value", "ord").alias("_tail"))
    )
    # every block needs its carry-in, also blocks that hold no value themselves
    summary = tagged.select(*group).distinct().join(tails, group, "left")
    over_blocks = (
        Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = summary.select(
        *group, F.last("_tail", ignorenulls=True).over(over_blocks).alias("_carry")
    ).filter("_carry IS NOT NULL")
    return (
        tagged.withColumn("_inside", F.last("_value", ignorenulls=True).over(before))
        .join(carry, group, "left")
        .withColumn(out, F.coalesce("_inside", "_carry"))
        .drop("_value", "_inside", "_carry")
    )


def with_first_after(df: DataFrame, keys: Sequence[str], value: Column, out: str) -> DataFrame:
    """Add the earliest non-null ``value`` of the rows after, within ``keys``."""
    group = [*keys, "block"]
    after = Window.partitionBy(*group).orderBy("ord").rowsBetween(1, Window.unboundedFollowing)
    tagged = df.withColumn("_value", value)
    heads = (
        tagged.filter("_value IS NOT NULL")
        .groupBy(*group)
        .agg(F.min_by("_value", "ord").alias("_head"))
    )
    summary = tagged.select(*group).distinct().join(heads, group, "left")
    over_blocks = (
        Window.partitionBy(*keys).orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    )
    carry = summary.select(
        *group, F.first("_head", ignorenulls=True).over(over_blocks).alias("_carry")
    ).filter("_carry IS NOT NULL")
    return (
        tagged.withColumn("_inside", F.first("_value", ignorenulls=True).over(after))
        .join(carry, group, "left")
        .withColumn(out, F.coalesce("_inside", "_carry"))
        .drop("_value", "_inside", "_carry")
    )


def with_row_number(df: DataFrame, keys: Sequence[str], out: str, total: str | None = None) -> DataFrame:
    """Add the 1-based row number within ``keys`` in log order, and the group's size."""
    group = [*keys, "block"]
    sizes = df.groupBy(*group).agg(F.count("*").alias("_rows"))
    over_blocks = Window.partitionBy(*keys).orderBy("block")
    offsets = sizes.select(
        *group,
        (F.sum("_rows").over(over_blocks) - F.col("_rows")).alias("_offset"),
        F.sum("_rows").over(Window.partitionBy(*keys)).alias("_total"),
    )
    inside = Window.partitionBy(*group).orderBy("ord")
    numbered = (
        df.withColumn("_inside", F.row_number().over(inside))
        .join(offsets, group)
        .withColumn(out, (F.col("_inside") + F.col("_offset")).cast("bigint"))
    )
    if total:
        numbered = numbered.withColumn(total, F.col("_total"))
    return numbered.drop("_inside", "_offset", "_total")


def keep_matching(rows: DataFrame, facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join that can only broadcast the facts, never the rows.

    From file sizes Spark may take the rows for the smaller side of an inner join and
    build a hash table of them; an outer join has no such choice.
    """
    joined = rows.join(facts.withColumn("_matched", F.lit(True)), list(keys), "left")
    kept = computed_once(joined, F.coalesce("_matched", F.lit(False)).alias("_kept"))
    return kept.filter("_kept").drop("_matched", "_kept")


def spread_join(rows: DataFrame, facts: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join one small fact row per ``keys`` group to rows whose groups may be hot.

    The fact rows are repeated once per block the group really has (once for an
    ordinary group, often for a hot one), so the shuffle key is ``(keys, block)``
    and no task gets a whole hot group.  Spark broadcasts the facts when their
    measured size is under its threshold.  ``how`` is left or inner.
    """
    group = [*keys, "block"]
    spread = keep_matching(rows.select(*group).distinct(), facts, keys)
    if how == "inner":
        return keep_matching(rows, spread, group)
    return rows.join(spread, group, "left")
