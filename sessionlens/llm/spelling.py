"""Spelling variants: words one edit apart, found in bidirectional FM-indexes of the vocabulary.

Two words one edit apart agree in one half of either word: the edit of the query lies in its
second half or in its first.  So a search matches one half exactly, and extends across the
other allowing one error (see ``fm_index``).  Both halves hold at least three code points, so
the two words share their first three or their last three.  The vocabulary is dealt by these:
each word goes to one shard of its beginning and, reversed, to one of its end, and all shards
of a side run the same search.  Work grows with the vocabulary, not with its square.

A beginning or end with more code points than a shard holds is cut into b blocks of words,
and each block is searched for each block of queries: b^2 tasks of bounded size.  Words of
more than ``LONG`` code points are compared by hashes of the word without each of its code
points, whose groups hold near words only.  No pair is lost and none is found twice.

A word's form is its near word of the largest count, if that is ``ratio`` times its own or
more; counts along forms grow by that factor, so roots are found in a number of pointer
doublings that follows from the largest count.

Defined results: null and empty texts have no runs, a null id hashes as the empty id;
repeated rows count again; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.blocks import computed_once
from ..plans.durable import discard, written
from .fm_index import FMIndex

RUNS = "[a-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS, MIN_COUNT, RATIO = 6, 5, 5
#: The half that two near words share has at least this many code points.
KEY = MIN_CHARS // 2
#: Code points of the words that one index may hold.
SHARD_CHARS = 1 << 17
#: Shards share tasks beyond this many.
MOST_TASKS = 1 << 14
#: Longer words are compared by hashes.
LONG = 64
TYPO_EVERY = 199
NEAR = "word string, near string, near_n bigint"


def spelled_runs(documents: DataFrame, id_column: str, text_column: str, typo_every: int) -> DataFrame:
    """Every run of letters of every text, A-Z lowered; where ``typo_every`` divides the hash
    of document and run, without the code point that the hash names."""
    text = F.translate(F.col(f"`{text_column}`"), UPPER, LOWER)
    runs = documents.select(
        F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(text, F.lit(RUNS), F.lit(0))).alias("run"),
    )
    # of shorter runs no word can come
    hashed = runs.filter(F.length("run") >= MIN_CHARS).select("run", F.crc32(F.concat_ws(":", "id", "run")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return hashed.select(F.when(F.col("h") % typo_every == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n`` of the words that are long and frequent enough."""
    counted = words.filter(F.length("word") >= MIN_CHARS).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= min_count)


def near_words(words: DataFrame, shard_chars: int = SHARD_CHARS, long: int = LONG) -> DataFrame:
    """``word, near, near_n`` for every two of the distinct words one edit apart, both ways.

    ``words`` has ``word`` and ``n`` and is read several times.
    """
    short = words.filter(F.length("word") <= long + 1)
    sides = short.select(
        "word", "n",
        F.explode(F.array(
            F.struct(F.lit(0).alias("side"), F.col("word").alias("read")),
            F.struct(F.lit(1).alias("side"), F.reverse("word").alias("read")),
        )).alias("s"),
    ).select("word", "n", "s.side", F.col("s.read").alias("read"), F.substring("s.read", 1, KEY).alias("key"))
    sizes = sides.groupBy("side", "key").agg(F.sum(F.length("read") + 1).alias("chars"))
    # ordinary keys share shards; a key of its own blocks is one that would fill more than one
    bound = F.lit(float(shard_chars))
    blocks = sizes.select("side", "key", F.ceil(F.col("chars") / bound).cast("int").alias("blocks"))
    shards = max(1, -(-(words.agg(F.sum(F.length("word") + 1)).first()[0] or 0) // shard_chars) * 2)
    spread = computed_once(
        sides.join(blocks, ["side", "key"]).withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")),
        F.when(F.col("blocks") == 1, F.array(F.struct(F.lit(True).alias("held"), F.lit(True).alias("asked"), F.pmod(F.xxhash64("key"), F.lit(shards)).cast("string").alias("shard"))))
        .otherwise(F.concat(
            F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: _block_role(True, F.col("block"), k)),
            F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: _block_role(False, k, F.col("block"))),
        )).alias("roles"),
    ).select("side", "read", "n", F.inline("roles"))
    # a task a shard or so: the rows of many shards are few bytes, but not little work
    dealt = spread.repartition(max(spread.sparkSession.sparkContext.defaultParallelism, min(2 * shards, MOST_TASKS)), "side", "shard")
    found = dealt.groupBy("side", "shard").applyInArrow(_searched(long), NEAR)
    return found.unionAll(near_long_words(words.filter(F.length("word") > long)))


def _block_role(held: bool, index: Column, query: Column) -> Column:
    shard = F.concat_ws("/", F.col("key"), index, query)
    return F.struct(F.lit(held).alias("held"), F.lit(not held).alias("asked"), shard.alias("shard"))


def _searched(long: int):
    def search(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = key[0].as_py()
        table = pa.Table.from_batches(list(batches))
        read = [w.encode("latin-1") for w in table.column("read").to_pylist()]
        held, asked = table.column("held").to_pylist(), table.column("asked").to_pylist()
        n = dict(zip(read, table.column("n").to_pylist(), strict=True))
        index_words = [w for w, h in zip(read, held, strict=True) if h]
        queries = [w for w, a in zip(read, asked, strict=True) if a]
        out: list = [[], [], []]
        if index_words and queries:
            # the first half of a word has half its code points, rounded down
            half = np.array([len(q) - len(q) // 2 if side else len(q) // 2 for q in queries])
            query, near = FMIndex(index_words).near(queries, half)
            for q, w in zip(query.tolist(), near, strict=True):
                word = queries[q]
                if len(word) > long and len(w) > long:
                    continue  # two long words are compared by hashes
                if side:
                    word, w, back = word[::-1], w[::-1], w
                    if w.startswith(word[: len(word) // 2]):
                        continue  # found from the other side
                    out[2].append(n[back])
                else:
                    out[2].append(n[w])
                out[0].append(word.decode("latin-1"))
                out[1].append(w.decode("latin-1"))
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], names=["word", "near", "near_n"])

    return search


def near_long_words(words: DataFrame) -> DataFrame:
    """The same for long words, by hashes: a word equals a longer one without one code point,
    or two words are equal without the code point of one place.  Each key holds words that are
    near each other; only ids of words are shuffled, and pairs are verified."""
    known = words.select("word", "n", F.xxhash64("word").alias("id"))
    cut = known.select("id", "word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("i")).select(
        "id", "i",
        F.xxhash64(F.concat(F.substring(F.col("word"), F.lit(1), F.col("i") - 1), F.substring(F.col("word"), F.col("i") + 1, F.length("word")))).alias("rest"),
    )
    shorter = cut.select(F.col("id").alias("a"), F.col("rest").alias("b")).join(known.select(F.col("id").alias("b")), "b").select("a", "b")
    other = cut.select(F.col("id").alias("b"), "i", "rest")
    replaced = cut.withColumnRenamed("id", "a").join(other, ["i", "rest"]).filter("a <> b").select("a", "b")
    pairs = shorter.unionAll(shorter.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionAll(replaced).distinct()
    return (
        pairs.join(known.select(F.col("id").alias("a"), "word"), "a")
        .join(known.select(F.col("id").alias("b"), F.col("word").alias("near"), F.col("n").alias("near_n")), "b")
        .filter(F.levenshtein("word", "near", 1) == 1)
        .select("word", "near", "near_n")
    )


def spelling_variants(
    documents: DataFrame, min_count: int = MIN_COUNT, ratio: int = RATIO, typo_every: int = TYPO_EVERY,
    id_column: str = "doc_id", text_column: str = "text", shard_chars: int = SHARD_CHARS, long: int = LONG,
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the vocabulary."""
    words = written(vocabulary(spelled_runs(documents, id_column, text_column, typo_every), min_count))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    near = near_words(words, shard_chars, long).groupBy("word").agg(F.count("*").alias("n_near"), best)
    judged = words.join(near, "word", "left")
    has_form = -F.col("best.less") >= ratio * F.col("n")
    formed = written(judged.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(has_form, F.col("best.near")).alias("form"), F.when(has_form, -F.col("best.less")).alias("form_n"),
    ))
    discard(words)
    most = formed.filter("form IS NOT NULL").agg(F.max("form_n")).first()[0]
    roots = formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    if most is not None:
        # each step multiplies the count, which begins at min_count or more
        steps = 1 + max(0, math.floor(math.log(most / min_count, ratio) + 1e-9))
        done = []
        for _ in range(math.ceil(math.log2(steps))):
            further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
            roots = written(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
            done.append(roots)
        discard(*done[:-1])
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """The vocabulary of all documents."""
    return spelling_variants(spark.read.parquet(f"{folder}/documents.parquet"))
