"""Quality rules: word statistics, and logistic regression on hashed word and character n-grams.

The model is trained on labelled rows in one task: of each label, the ``TRAINING_ROWS`` rows
with the least hash of their id (a documented bound; the rest of the labels is not needed).
A fifth of them calibrates the probability.  All documents are scored in Arrow batches; a
document is kept if it passes the base rules and its probability of quality is at least
``THRESHOLD``, set low so that clean documents stay.

Defined results: a null or empty text has no words and fails the base rules; without labelled
rows of both kinds every probability is 1; rows of labels that are null or out of 0 and 1, or
match no document, are not used; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.durable import written
from .features import calibrate, fit_logistic, scores
from .places import small_batches
from .words import hash_spans, row_of, slices, text_buffer, windows, word_spans

TRAINING_ROWS = 1500
THRESHOLD = 0.1
LEAST_WORDS, MOST_REPEATED = 50, 50
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def training_rows(documents: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """At most ``rows`` texts of each label, by the least hash of the id: ``text, label``."""
    known = labels.filter("quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    order = F.md5(F.col("doc_id").cast("string"))
    chosen = [
        known.filter(F.col("label") == k).orderBy(order, "doc_id").limit(rows).select("doc_id", "label") for k in (0, 1)
    ]
    few = written(chosen[0].unionByName(chosen[1]))
    # at most 2 * rows ids, so the texts are not shuffled
    return documents.select("doc_id", "text").join(F.broadcast(few), "doc_id").dropDuplicates(["doc_id"])


def fit_quality(training: DataFrame) -> tuple[np.ndarray, float, float, float]:
    """Weights, bias, slope and offset, fitted in one task on the bounded training rows."""

    def fit(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by("doc_id").combine_chunks()
        text, label = pa.concat_arrays(table.column("text").chunks), table.column("label").to_numpy().astype(float)
        if len(set(label.tolist())) < 2:
            return
        held = np.arange(len(label)) % 5 == 0
        w, bias = fit_logistic(text.filter(pa.array(~held)), label[~held])
        slope, offset = calibrate(scores(text.filter(pa.array(held)), w, bias), label[held])
        yield pa.RecordBatch.from_arrays([pa.array([w.tolist()], pa.list_(pa.float64())), pa.array([[bias, slope, offset]])], names=["w", "rest"])

    model = training.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(fit, "w array<double>, rest array<double>").collect()
    if not model:
        return np.zeros(1 << 14), 0.0, 0.0, 30.0
    return np.array(model[0][0]), *model[0][1]


def statistics(text: pa.Array) -> dict[str, np.ndarray]:
    """The word statistics of every row."""
    raw, offsets = text_buffer(text)
    out = {k: np.zeros(len(text), np.int64) for k in STATISTICS}
    for a, b in slices(offsets):
        part, own = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, lengths, firsts = word_spans(part, own)
        h = hash_spans(part, starts, lengths)
        row = row_of(firsts)
        out["n_words"][a:b] = np.diff(firsts)
        letter = np.r_[0, np.cumsum((part & 0xC0) != 0x80)]  # code points before each byte
        size = letter[starts + lengths] - letter[starts]
        out["word_chars"][a:b] = np.bincount(row, weights=size, minlength=b - a)
        byte_row = np.repeat(np.arange(b - a), np.diff(own))
        out["n_symbols"][a:b] = np.bincount(byte_row[SYMBOL[part]], minlength=b - a)

        # lines with a word, equal to an earlier one of the same row
        feeds = np.flatnonzero(part == 0x0A)
        ends = np.sort(np.r_[feeds, own[1:][np.diff(own) > 0]])
        begins = np.sort(np.r_[feeds + 1, own[:-1][np.diff(own) > 0]])
        counts = np.searchsorted(starts, ends, "left") - np.searchsorted(starts, begins, "left")
        begins, ends = begins[counts > 0], ends[counts > 0]
        line = hash_spans(part, begins, ends - begins)
        at = np.searchsorted(own, begins, "right") - 1
        order = np.lexsort((line, at))
        again = (line[order[1:]] == line[order[:-1]]) & (at[order[1:]] == at[order[:-1]])
        out["n_dup_lines"][a:b] = np.bincount(at[order[1:][again]], minlength=b - a)

        # words in windows of three found twice or more in the row
        key, first = windows(h, firsts, 3)
        order = np.argsort(key)
        order = order[np.argsort(row[first[order]], kind="stable")]
        k, r = key[order], row[first[order]]
        same = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
        twice = np.zeros(len(k), bool)
        twice[1:] |= same
        twice[:-1] |= same
        covered = np.zeros(len(starts) + 2, bool)
        for n in range(3):
            covered[first[order[twice]] + n] = True
        out["n_repeat_words"][a:b] = np.bincount(row[covered[: len(row)]], minlength=b - a)
    return out


def judged(documents: DataFrame, model: tuple[np.ndarray, float, float, float], threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``documents`` with the statistics, ``base_failed``, ``probability`` and ``kept``,
    packed in one last column ``verdict``, renamed where that name is taken."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    name = "verdict"
    while name in documents.columns:
        name += "_"
    kind = T.StructType(
        [T.StructField(k, T.LongType()) for k in STATISTICS]
        + [T.StructField("base_failed", T.BooleanType()), T.StructField("probability", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, slope, offset = shared.value
        for batch in batches:
            text = batch.column("text")
            found = statistics(text)
            n = found["n_words"]
            failed = (n < LEAST_WORDS) | (100 * found["n_repeat_words"] > MOST_REPEATED * n)
            p = 1 / (1 + np.exp(-np.clip(slope * scores(text, weights, bias) + offset, -30, 30)))
            columns = [pa.array(found[k]) for k in STATISTICS] + [pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))]
            verdict = pa.StructArray.from_arrays(columns, names=[f.name for f in kind])
            yield pa.RecordBatch.from_arrays([*batch.columns, verdict], names=[*batch.schema.names, name])

    schema = T.StructType([*documents.schema.fields, T.StructField(name, kind)])
    return small_batches(documents).mapInArrow(judge, schema)


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics and verdict of every document."""
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    model = fit_quality(training_rows(documents, spark.read.parquet(f"{folder}/labels.parquet")))
    rows = judged(documents.select("doc_id", "text"), model).select("doc_id", "verdict.*")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("probability", 6).alias("probability"))
