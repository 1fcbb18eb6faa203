"""Toxicity by class-conditional Kneser-Ney models of words.

Two bigram models, of toxic and of ordinary documents, are counted over all labelled rows of
the training folds; every word and every pair of both classes is kept.  Both interpolate with
the class's continuation counts (of how many different words a word follows), these with the
continuation counts of the first seven characters, then of the first four, and these with those
of both classes together.  So inflections of a rare word join, words that begin alike stay
apart, and an expression that is rare in one class is judged by the shared counts.
Continuation counts also keep copies of one text from passing for evidence.

A word is read whole, a run of ASCII letters, digits and other characters; in scripts without
spaces every character is a word, so their texts are judged by characters and pairs of them.

The models are Spark tables under 64-bit hashes and are never gathered.  The margin of a pair
in neither class is a sum of a part of each of its words, so a table holds per word these parts
and per pair what it differs by.  A part of ``1 << PART_SHIFT`` rows of a file asks for each of
its words, prefixes and pairs once, so a frequent pair has a row per part and not per document;
the answers meet the part's texts again.

A document's margin is the difference of its length-normalised log-likelihoods; a second margin
is that of its ``STRONGEST`` most toxic words by continuation alone, as toxic words may be few
in a long text; both are taken again of the prefixes' continuation.  The margins become a probability by logistic regression on the calibration fold, of which at most
``CALIBRATION_ROWS`` documents are used.

Defined results: a word without a count is judged by its longest counted prefix, and one
without any says nothing; a null or empty text has margins of 0; without labelled rows of both kinds
every score is 0; labels that are null, not 0 or 1 or match no document are not used; a
document with several labels is toxic if one says so; repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.durable import written
from .places import with_place
from .words import BASE, LOWER, U, hash_spans, mixed, row_of, slices, text_buffer, word_spans

FOLDS, HELD_OUT, CALIBRATION = 5, 0, 4
CALIBRATION_ROWS = 20_000
BROADCAST_LABELS = 1_000_000
STRONGEST = 2
DISCOUNT = 0.75
#: Characters of the prefixes that whole words back off to.
PREFIXES = (7, 4)
#: Code points of scripts written without spaces: Thai, Lao, Tibetan, Myanmar, Tai, Khmer,
#: Kana, Han and the forms made for both.
UNSPACED = (
    (0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19FF), (0x1A20, 0x1AAF), (0x2E80, 0x312F), (0x31A0, 0x9FFF),
    (0xA9E0, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1AFF0, 0x1B16F), (0x20000, 0x3FFFF),
)
MARGINS = 2 + 2 * len(PREFIXES)
PART_SHIFT = 10
LEVEL = {k: U(k * int(BASE) % 2**64) for k in PREFIXES}
BEGIN = U(1)  # the word before the first
NO_WORD = np.ones(256, bool)
NO_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS))


def code_points(raw: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """The code points of the UTF-8 characters that begin at ``heads``."""
    padded = np.r_[raw, np.zeros(3, np.uint8)].astype(np.int32)
    lead = padded[heads]
    code, more = lead.copy(), [padded[heads + k] & 0x3F for k in (1, 2, 3)]
    two, three, four = (lead >= 0xC0) & (lead < 0xE0), (lead >= 0xE0) & (lead < 0xF0), lead >= 0xF0
    code[two] = ((lead & 0x1F) << 6 | more[0])[two]
    code[three] = ((lead & 0x0F) << 12 | more[0] << 6 | more[1])[three]
    code[four] = ((lead & 0x07) << 18 | more[0] << 12 | more[1] << 6 | more[2])[four]
    return code


def words_of(text: pa.Array):
    """Yields (first row, last row, bytes, starts, lengths, rows' first words) of lower-cased
    runs of letters and digits; a character of a script without spaces is a word."""
    raw, offsets = text_buffer(text)
    for a, b in slices(offsets):
        part, own = LOWER[raw[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
        starts, lengths, firsts = word_spans(part, own, NO_WORD)
        wide = np.flatnonzero(part >= 0xE0)
        code = code_points(part, wide)
        alone = np.zeros(len(code), bool)
        for first, last in UNSPACED:
            alone |= (code >= first) & (code <= last)
        if alone.any():
            heads = wide[alone]
            size = np.where(part[heads] >= 0xF0, 4, 3)
            ends = starts + lengths
            # a word begins at such a character and after it, where its run goes on
            cuts = np.unique(np.concatenate([heads, heads + size]))
            run = np.searchsorted(starts, cuts, "right") - 1
            cuts = cuts[(cuts > starts[run]) & (cuts < ends[run])]
            starts = np.sort(np.concatenate([starts, cuts]))
            lengths = np.sort(np.concatenate([ends, cuts])) - starts
            firsts = np.searchsorted(starts, own, "left").astype(np.int64)
        yield a, b, part, starts, lengths, firsts


def prefixes(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """Hashes of the words' first characters, for each length of ``PREFIXES``."""
    heads = np.flatnonzero((raw & 0xC0) != 0x80)
    at = np.searchsorted(heads, starts)
    out = []
    for k in PREFIXES:
        end = np.r_[heads, np.full(k, len(raw))][at + k] if len(heads) else starts + lengths
        out.append(mixed(hash_spans(raw, starts, np.minimum(lengths, end - starts)) + LEVEL[k]))
    return out


def chained(h: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The word before each, ``BEGIN`` at the first word of a row."""
    previous = np.r_[BEGIN, h[:-1]] if len(h) else h
    previous[firsts[:-1][np.diff(firsts) > 0]] = BEGIN
    return previous


def pair_hash(previous: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(previous * BASE + word)


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def count_pairs(training: DataFrame) -> DataFrame:
    """``pair, previous, word, n0, n1`` over all training rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column("label").to_numpy()
            for a, b, raw, starts, lengths, firsts in words_of(batch.column("text")):
                h = hash_spans(raw, starts, lengths)
                previous, toxic = chained(h, firsts), label[a:b][row_of(firsts)]
                key, first, at = np.unique(pair_hash(previous, h), return_index=True, return_inverse=True)
                n = [pa.array(np.bincount(at[toxic == c], minlength=len(key))) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([signed(key), signed(previous[first]), signed(h[first]), *n], names=["pair", "previous", "word", "n0", "n1"])

    counted = training.select("text", "label").mapInArrow(count, "pair bigint, previous bigint, word bigint, n0 bigint, n1 bigint")
    return counted.groupBy("pair", "previous", "word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def count_forms(training: DataFrame) -> DataFrame:
    """``word, long, short``: the training words and their prefixes."""

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, raw, starts, lengths, _ in words_of(batch.column("text")):
                word, first = np.unique(hash_spans(raw, starts, lengths), return_index=True)
                both = prefixes(raw, starts[first], lengths[first])
                yield pa.RecordBatch.from_arrays([signed(word), *map(signed, both)], names=["word", "long", "short"])

    return training.select("text").mapInArrow(forms, "word bigint, long bigint, short bigint").groupBy("word").agg(F.first("long").alias("long"), F.first("short").alias("short"))


def fit_toxicity(training: DataFrame) -> DataFrame | None:
    """``key, x, y``: of a word, its margin by continuation and what it adds to the word after
    it; of a prefix, the margin of words not counted; of a pair, what its margin differs by from
    the sum of both.  ``training`` has ``text, label``; None if a class has no words."""
    pairs = written(count_pairs(training))
    some = lambda c: F.count_if(F.col(c) > 0)
    before = pairs.groupBy("previous").agg(F.sum("n0").alias("c0"), F.sum("n1").alias("c1"), some("n0").alias("f0"), some("n1").alias("f1"))
    after = pairs.groupBy("word").agg(some("n0").alias("a0"), some("n1").alias("a1"))
    words = written(after.join(count_forms(training), "word"))
    sums = [F.sum("a0").alias("a0"), F.sum("a1").alias("a1"), F.count("*").alias("kinds")]
    long = written(words.groupBy("long", "short").agg(*sums))
    short = written(long.groupBy("short").agg(*sums))
    total, different = [], []
    for table in (words, long, short):
        row = table.agg(F.sum("a0"), F.sum("a1"), some("a0"), some("a1"), F.count("*")).first()
        if not row[0] or not row[1]:
            return None
        total, different = row[:2], [*different, row[2:]]
    lower = [[DISCOUNT * kinds[c] / total[c] for c in (0, 1)] for kinds in different]
    seen = F.col("a0") + F.col("a1")

    def level(k: int, below: list[Column], share: Column) -> list[Column]:
        return [F.greatest(F.col(f"a{c}") - DISCOUNT, F.lit(0.0)) / total[c] + lower[k][c] * below[c] * share for c in (0, 1)]

    def under(table: DataFrame, parent: DataFrame, k: int, on: str) -> DataFrame:
        share = (seen + 0.5) / (F.col("seen") + 0.5 * (F.col("kinds_") + 1))
        held = parent.select(on, "p0", "p1", (F.col("a0") + F.col("a1")).alias("seen"), F.col("kinds").alias("kinds_"))
        p = level(k, [F.col("p0"), F.col("p1")], share)
        return table.join(held, on).withColumns({"q0": p[0], "q1": p[1]}).drop("p0", "p1", "seen", "kinds_").withColumnsRenamed({"q0": "p0", "q1": "p1"})

    every = (seen + 0.5) / (sum(total) + 0.5 * (different[2][2] + 1))
    p = level(2, [F.lit(1.0), F.lit(1.0)], every)
    short = short.withColumns({"p0": p[0], "p1": p[1]})
    long = written(under(long, short, 1, "short"))
    words = written(under(words, long.drop("short"), 0, "long").select("word", "p0", "p1"))
    ratio = F.log(F.col("p1") / F.col("p0"))
    weight = {f"w{c}": F.when(F.col(f"c{c}") > 0, DISCOUNT * F.col(f"f{c}") / F.col(f"c{c}")).otherwise(1.0) for c in (0, 1)}
    before = written(before.withColumns(weight))
    adds = F.log(F.col("w1") / F.col("w0"))
    known = pairs.join(before, "previous").join(words, "word")
    exact = [
        F.when(F.col(f"c{c}") > 0, F.greatest(F.col(f"n{c}") - DISCOUNT, F.lit(0.0)) / F.col(f"c{c}") + F.col(f"w{c}") * F.col(f"p{c}")).otherwise(F.col(f"p{c}"))
        for c in (0, 1)
    ]
    zero = F.lit(0.0)
    singles = words.join(before.withColumnRenamed("previous", "word"), "word", "full")
    tables = [
        singles.select(F.col("word").alias("key"), F.coalesce(ratio, zero).alias("x"), F.coalesce(adds, zero).alias("y")),
        long.select("long", ratio, zero), short.select("short", ratio, zero),
        known.select("pair", F.log(exact[1] / exact[0]) - adds - ratio, zero),
    ]
    out = tables[0]
    for table in tables[1:]:
        out = out.unionAll(table)
    return written(out)


def asked(docs: DataFrame) -> DataFrame:
    """``_asks, key``: the words, prefixes and pairs of every part, each once."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            part = batch.column("_asks").to_numpy()
            for own in np.unique(part):
                if own not in held:
                    yield from answer(held)
                text = batch.column("text").filter(pa.array(part == own))
                keys = [held.pop(own, np.zeros(0, U)), np.array([BEGIN])]
                for _, _, raw, starts, lengths, firsts in words_of(text):
                    h = hash_spans(raw, starts, lengths)
                    word, first = np.unique(h, return_index=True)
                    keys += [word, np.unique(pair_hash(chained(h, firsts), h)), *prefixes(raw, starts[first], lengths[first])]
                held[own] = np.unique(np.concatenate(keys))
        yield from answer(held)

    def answer(held: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for own in list(held):
            keys = held.pop(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), own, np.int64)), signed(keys)], names=["_asks", "key"])

    return docs.select("_asks", "text").mapInArrow(ask, "_asks bigint, key bigint")


def margins(text: pa.Array, key: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """[rows, MARGINS]: mean margin of the words and that of the most toxic ones by continuation,
    then both by continuation of each prefix; ``key`` is sorted."""
    out = np.zeros((len(text), MARGINS))

    def value(column: np.ndarray, h: np.ndarray, other: np.ndarray | float = 0.0) -> np.ndarray:
        if not len(key):
            return np.zeros(len(h)) + other
        at = np.minimum(np.searchsorted(key, h), len(key) - 1)
        return np.where(key[at] == h, column[at], other)

    for a, b, raw, starts, lengths, firsts in words_of(text):
        h = hash_spans(raw, starts, lengths)
        previous = chained(h, firsts)
        word, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        alone = [np.zeros(len(word))]
        for prefix in reversed(prefixes(raw, starts[first], lengths[first])):
            alone.append(value(x, prefix, alone[-1]))
        alone = [level[inverse] for level in (value(x, word, alone[-1]), *alone[:0:-1])]
        row, n = row_of(firsts), np.diff(firsts)
        rank = np.arange(len(h)) - np.repeat(firsts[:-1], n)
        best = rank < STRONGEST
        means = [alone[0] + value(y, previous) + value(x, pair_hash(previous, h)), *alone[1:]]
        for k, level in enumerate(alone):
            order = np.argsort(-level, kind="stable")
            order = order[np.argsort(row[order], kind="stable")]
            out[a:b, 2 * k] = np.bincount(row, weights=means[k], minlength=b - a) / np.maximum(n, 1)
            out[a:b, 2 * k + 1] = np.bincount(row[best], weights=level[order][best], minlength=b - a) / STRONGEST
    return out


def regression(x: np.ndarray, label: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Weights of the columns of x and a constant, by Newton steps with a slight penalty."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), x.T @ (p - label) + 1e-2 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def toxic_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, margins`` of every row of ``documents``."""
    placed = with_place(documents, doc_id="doc_id", text="text")
    docs = placed.select("doc_id", "text", F.xxhash64("_file", F.shiftright("_row", PART_SHIFT)).alias("_asks"))
    known = labels.filter("toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label")).filter(fold(F.col("doc_id")) != HELD_OUT)
    # a million ids and labels at most are broadcast, more are joined by a shuffle
    side = F.broadcast(known) if known.count() <= BROADCAST_LABELS else known
    training = docs.join(side, "doc_id").filter(fold(F.col("doc_id")) != CALIBRATION)
    model = fit_toxicity(training)
    held = (fold(F.col("doc_id")) == HELD_OUT).alias("held_out")
    if model is None:
        return docs.select("doc_id", held, F.lit(0.0).alias("score"), F.array().cast("array<double>").alias("margins"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = asked(docs).join(model, "key").select("_asks", "key", F.col("x").cast("float").alias("x"), F.col("y").cast("float").alias("y"))

    def judge(part: pa.Table, answers: pa.Table) -> pa.Table:
        key = answers.column("key").to_numpy().view(U)
        order = np.argsort(key)
        x, y = (answers.column(c).to_numpy()[order].astype(float) for c in "xy")
        m = margins(part.column("text").combine_chunks(), key[order], x, y)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), MARGINS).cast(pa.list_(pa.float64()))
        return pa.table({"doc_id": part.column("doc_id"), "margins": lists})

    scored = written(docs.groupBy("_asks").cogroup(found.groupBy("_asks")).applyInArrow(judge, f"doc_id {kind}, margins array<double>"))
    few = known.filter(fold(F.col("doc_id")) == CALIBRATION).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(CALIBRATION_ROWS)
    rows = scored.join(F.broadcast(few), "doc_id").orderBy("doc_id", "margins").limit(2 * CALIBRATION_ROWS).select("margins", "label").collect()
    x = np.array([r[0] for r in rows], float).reshape(-1, MARGINS)
    w = regression(x, np.array([r[1] for r in rows], float)).tolist() if rows else [1.0] * MARGINS + [0.0]
    z = sum((F.get("margins", F.lit(k)) * w[k] for k in range(MARGINS)), F.lit(w[-1]))
    return scored.select("doc_id", held, (1 / (1 + F.exp(-z))).alias("score"), "margins")


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Every document scored; a fifth of the ids is held out of training."""
    rows = toxic_scores(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
