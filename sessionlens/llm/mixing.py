"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame functions only.

Each source has a weight and a cap; the mix is a share of all words, and what a capped source
cannot take goes to the others by weight.  The mix is dealt in blocks of equally many words.
Sources get integer quotas of blocks by the highest quotients target / (2 k + 1), then each
source's shards get theirs in the same way; the quotas are not enumerated: quotients well
above the last one that wins are counted, and only those near it are ranked.

A shard holds about a million words of one source, chosen by a hash of the id, so a source
with a third of all rows is spread over many shards.  Inside a shard documents are laid end
to end in seeded order, and the shard's blocks are taken in that order: whole rounds first,
then the first blocks of the next round.

Defined results: a null text has size 0 and takes nothing; null sources are one source, the
last; an empty table gives an empty one; repeated rows are documents of their own; ties are
settled by source, shard, id and size, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.durable import with_dense_number, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE, MOST_REPEATS = 1.5, 2
BLOCK_WORDS = 16
SHARD_WORDS = 1 << 20
SEED = "mix-1"


def words_in(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, repeats: int) -> DataFrame:
    """``source, source_size, weight, target`` of a table ``source, source_size``.

    With sources sorted by cap over weight, those before some place are capped and the others
    share the rest by weight; a source is capped if its cap is below its share of what the
    sources from it on can take.
    """
    named = sizes.withColumn("_null", F.col("source").isNull().cast("int")).withColumn("_name", F.coalesce("source", F.lit("")))
    numbered = with_dense_number(named.withColumn("_all", F.lit(0)), ["_all"], ["_null", "_name"], "_number")
    weight = F.get(F.array(*map(F.lit, weights)), F.pmod(F.col("_number") - 1, F.lit(len(weights))).cast("int")).cast("bigint")
    table = numbered.withColumn("weight", weight).withColumn("cap", F.col("source_size") * repeats)
    # sums over sources, one row each
    rising = Window.partitionBy("_all").orderBy(F.col("cap") / F.col("weight"), "_number")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    onward = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(Window.partitionBy("_all")) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    table = table.withColumn("_left", left).withColumn("_weights", F.sum("weight").over(onward))
    free = F.col("cap") > F.col("_left") * F.col("weight") / F.col("_weights")
    table = table.withColumn("_free", free)
    first = F.first(F.when(F.col("_free"), F.struct("_left", "_weights")), ignorenulls=True).over(
        rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    table = table.withColumn("_rate", first)
    target = F.when(
        F.col("_free"), F.col("_rate._left") * F.col("weight") / F.col("_rate._weights")
    ).otherwise(F.col("cap").cast("double"))
    return table.select("source", "source_size", "weight", target.alias("target"), F.col("_number").alias("source_number"))


def sainte_lague(cells: DataFrame, group: list[str], order: list[str], share: str, seats: str, out: str) -> DataFrame:
    """Integer quotas ``out`` of ``seats`` (a column, equal inside a group) by ``share``.

    With n cells, the house for any divisor differs from the sum of exact quotas by at most
    n / 2.  Seats sure at a divisor for 1.5 n seats fewer are given; the quotients down to
    a divisor for 1.5 n seats more, about four a cell, are ranked for the rest.
    """
    whole = Window.partitionBy(*group)
    total, n = F.sum(share).over(whole), F.count("*").over(whole)
    sure = F.floor(F.col(share) / F.col("_total") * F.greatest(F.col(seats) - 1.5 * F.col("_n"), F.lit(0.0)) + 0.5)
    most = F.floor(F.col(share) / F.col("_total") * (F.col(seats) + 1.5 * F.col("_n")) + 0.5) + 1
    table = (
        cells.withColumn("_total", total).withColumn("_n", n)
        .withColumn("_sure", F.when(F.col("_total") > 0, sure).otherwise(0).cast("bigint"))
        .withColumn("_most", F.when(F.col("_total") > 0, most).otherwise(0).cast("bigint"))
    )
    table = table.withColumn("_open", (F.col(seats) - F.sum("_sure").over(whole)).cast("bigint"))
    near = table.filter("_most > _sure").withColumn("_k", F.explode(F.sequence(F.col("_sure"), F.col("_most") - 1)))
    best = Window.partitionBy(*group).orderBy(F.desc(F.col(share) / (2 * F.col("_k") + 1)), *order, "_k")
    won = near.withColumn("_place", F.row_number().over(best)).filter("_place <= _open").groupBy(*group, *order).agg(F.count("*").alias("_won"))
    return (
        table.join(won, [*group, *order], "left")
        .withColumn(out, F.col("_sure") + F.coalesce("_won", F.lit(0)))
        .drop("_total", "_n", "_sure", "_most", "_open", "_won")
    )


def mixed_documents(
    documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = MOST_REPEATS,
    block: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: str = SEED, carry: tuple[str, ...] = (),
) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` per row, and the columns in ``carry``."""
    rows = written(documents.select("doc_id", "source", words_in().alias("size"), *carry))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = written(source_targets(sizes, weights, share, repeats).withColumn("_all", F.lit(0)))
    sources = sources.withColumn("seats", F.round(F.sum("target").over(Window.partitionBy("_all")) / block).cast("bigint"))
    sources = written(sainte_lague(sources, ["_all"], ["source_number"], "target", "seats", "quota"))

    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    joined = rows.join(sources.select("source", "source_size", "target", "source_number", "quota").withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "source")
    dealt = (
        joined.withColumn("_key", key)
        .withColumn("shards", F.floor(F.col("source_size") / shard_words) + 1)
        .withColumn("shard", F.pmod(F.conv(F.substring("_key", 1, 8), 16, 10).cast("bigint"), "shards"))
    )
    cells = dealt.groupBy("source_number", "shard").agg(
        F.sum("size").alias("cell_size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("quota").alias("quota")
    ).withColumn("cell_share", F.col("target") * F.col("cell_size") / F.greatest("source_size", F.lit(1)))
    cells = sainte_lague(cells, ["source_number"], ["shard"], "cell_share", "quota", "blocks")
    words = F.least(F.col("blocks") * block, F.col("cell_size") * repeats)
    cells = cells.withColumn("words", words).select("source_number", "shard", "cell_size", "words")

    # a shard of a source holds about ``shard_words`` words
    laid = Window.partitionBy("source_number", "shard").orderBy("_key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumn("_end", F.sum("size").over(laid)).join(cells, ["source_number", "shard"])
    rounds = F.floor(F.col("words") / F.greatest("cell_size", F.lit(1)))
    rest = F.col("words") - rounds * F.col("cell_size")
    part = F.least(F.greatest(rest - (F.col("_end") - F.col("size")), F.lit(0)), "size")
    taken = (rounds * F.col("size") + part).cast("bigint")
    return placed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), *carry)


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents, weights 3, 1, 2, a mix of 150 % of all words, sources taken twice at most."""
    return mixed_documents(spark.read.parquet(f"{folder}/documents.parquet"))


OP5_SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
    md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS k FROM documents),
src AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w,
    row_number() OVER (ORDER BY source IS NULL, source) AS no
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)),
s1 AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE * {SHARE} - coalesce(sum({MOST_REPEATS} * source_size) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS l,
    (sum(w) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS ws
  FROM src WINDOW r AS (ORDER BY {MOST_REPEATS} * source_size::DOUBLE / w, no)),
s2 AS (SELECT *, {MOST_REPEATS} * source_size > l * w / ws AS free FROM s1),
rate AS (SELECT l AS rl, ws AS rws FROM s2 WHERE free ORDER BY {MOST_REPEATS} * source_size::DOUBLE / w, no LIMIT 1),
s3 AS (SELECT source, source_size, no, CASE WHEN free THEN rl * w / rws ELSE ({MOST_REPEATS} * source_size)::DOUBLE END AS target FROM s2 LEFT JOIN rate ON true),
h AS (SELECT round(sum(target) / {BLOCK_WORDS})::BIGINT AS seats, sum(target) AS t, count(*) AS n FROM s3),
s4 AS (SELECT no, count(*) FILTER (place <= seats - base) + any_value(own) AS quota FROM (
    SELECT no, seats, own, sum(CASE WHEN k = own THEN own ELSE 0 END) OVER () AS base,
      row_number() OVER (ORDER BY target / (2 * k + 1) DESC, no, k) AS place
    FROM (SELECT no, target, seats, own, unnest(range(own, own + 6 * n::BIGINT + 6)) AS k
      FROM (SELECT *, greatest(floor(target / t * seats)::BIGINT - 3 * n::BIGINT, 0) AS own FROM s3, h))) GROUP BY no),
s AS (SELECT s3.*, quota FROM s3 JOIN s4 USING (no)),
j AS (
  SELECT doc_id, size, k, s.*, ('0x' || substr(k, 1, 8))::BIGINT % (source_size // {SHARD_WORDS} + 1) AS shard
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
c AS (
  SELECT no, shard, sum(size)::BIGINT AS cell_size, any_value(quota) AS quota, count(*) OVER (PARTITION BY no) AS n,
    any_value(target) * sum(size)::DOUBLE / greatest(any_value(source_size), 1) AS share FROM j GROUP BY no, shard),
c2 AS (SELECT no, shard, any_value(cell_size) AS cell_size, count(*) FILTER (place <= quota - base) + any_value(own) AS blocks FROM (
    SELECT *, sum(CASE WHEN k = own THEN own ELSE 0 END) OVER (PARTITION BY no) AS base,
      row_number() OVER (PARTITION BY no ORDER BY share / (2 * k + 1) DESC, shard, k) AS place
    FROM (SELECT *, unnest(range(own, own + 6 * n + 6)) AS k FROM (
      SELECT *, greatest(floor(share / greatest(sum(share) OVER (PARTITION BY no), 1e-300) * quota)::BIGINT - 3 * n, 0) AS own FROM c))) GROUP BY no, shard),
p AS (
  SELECT j.*, cell_size, least(blocks * {BLOCK_WORDS}, cell_size * {MOST_REPEATS}) AS words,
    sum(size) OVER (PARTITION BY no, shard ORDER BY k, size ROWS UNBOUNDED PRECEDING) - size AS pos
  FROM j JOIN c2 USING (no, shard))
SELECT doc_id, size, source_size, target,
  (words // greatest(cell_size, 1) * size + least(greatest(words - words // greatest(cell_size, 1) * cell_size - pos, 0), size))::BIGINT AS taken
FROM p
"""
