"""Benchmark decontamination: Wu-Manber search of every benchmark window in every document.

Texts are sequences of words over ``[0-9a-z]`` and all code points above 0x7F, in lower case
A-Z.  A window is 10 consecutive words of an item; an item of fewer words is one window of its
own length.  The symbols of the search are words, and a block is two of them (one, where the
windows are single words).  For the windows of one length:

* the shift table maps the hash of a block to the distance from its last place in any window
  to the window's end; a block in no window lets the search skip ``length - 1`` words;
* at shift zero the block is the suffix of some window; the buckets of a suffix are divided by
  the hash of all words of a window, so one look-up selects what can match, however many
  windows end alike;
* the bytes of each word of the window are compared with those of the document.

All places of a batch of documents move in step, one array operation a round; a document is
cut into runs of places of a fixed number, so a long one takes no more rounds than others.

Windows are held in shards of at most ``SHARD_WORDS`` benchmark words.  A shard is of bounded
size and is broadcast; documents are read once a shard, and what several shards find in a
document meets by its place.  Nothing else is shuffled: a task reports a document's hits as
intervals of words, so common passages make no group.

Defined results: a null or empty text has no words and is not hit, a null or wordless item has
no window; items of one id are one item, a null id counts as the id ''; repeated rows count by
themselves; an empty table gives an empty one, an empty benchmark no hit; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .places import with_place
from .words import BASE, LOWER, U, hash_spans, mixed, rolling, row_of, slices, text_buffer, word_spans

WINDOW = 10
#: Benchmark words that one broadcast shard may hold (some 60 bytes each).
SHARD_WORDS = 1 << 20
#: Windows of an item that travel together; a longer item is cut, with its windows whole.
SEGMENT = 1 << 12
#: Places of a document that one run of the search walks through.
RUN = 128

OUTSIDE = np.ones(256, bool)
OUTSIDE[0x30:0x3A] = OUTSIDE[0x61:0x7B] = OUTSIDE[0x80:] = False

SEGMENTS = "item string, width int, words string, n_words bigint"
FOUND = "doc_id {id}, _file bigint, _row bigint, n_words bigint, hits array<struct<first:bigint,last:bigint>>, items array<string>"


def item_segments(benchmark: DataFrame, window: int, id_column: str, text_column: str) -> DataFrame:
    """Items as runs of words joined by one space, with the width of their windows."""
    rows = benchmark.select(F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{text_column}`").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict = {"item": [], "width": [], "words": [], "n_words": []}
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text"), strict=True):
                words = LOWER[np.frombuffer(text.as_buffer(), np.uint8)] if text.is_valid and len(text.as_buffer()) else LOWER[:0]
                words = np.where(OUTSIDE[words], np.uint8(0x20), words).tobytes().split()
                for at in range(0, max(1, len(words) - window + 1), SEGMENT):
                    part = words[at : at + SEGMENT + window - 1]
                    if part:
                        for key, value in zip(out, (item, min(window, len(words)), b" ".join(part).decode(), len(part)), strict=True):
                            out[key].append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["item"], pa.string()), pa.array(out["width"], pa.int32()), pa.array(out["words"], pa.string()), pa.array(out["n_words"], pa.int64())],
                names=list(out),
            )

    return rows.mapInArrow(cut, SEGMENTS)


def lowered_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and start, byte length and rows' first words of their words."""
    raw, offsets = text_buffer(column)
    raw = LOWER[raw]
    return raw, *word_spans(raw, offsets, OUTSIDE)


def same_bytes(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether each byte span of ``a`` equals that of ``b``, eight bytes a step."""
    views = []
    for raw in (a, b):
        padded = np.zeros(len(raw) + 8, np.uint8)
        padded[: len(raw)] = raw
        views.append(np.ndarray((len(raw) + 1,), "<u8", buffer=padded, strides=(1,)))
    keep = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], U)
    equal, rows, step = np.ones(len(at), bool), np.flatnonzero(lengths > 0), 0
    while len(rows):
        differ = (views[0][at[rows] + step] ^ views[1][bt[rows] + step]) & keep[np.minimum(lengths[rows] - step, 8)]
        equal[rows[differ != 0]] = False
        step += 8
        rows = rows[(differ == 0) & (lengths[rows] > step)]
    return equal


class WindowTable:
    """Shift table, suffix buckets and bytes of the different windows of one width."""

    def __init__(self, width: int, words: pa.Array, items: np.ndarray):
        raw, starts, lengths, firsts = lowered_words(words)
        hashes = hash_spans(raw, starts, lengths)
        row = row_of(firsts)
        whole = np.flatnonzero(row[: max(0, len(row) - width + 1)] == row[width - 1 :])
        key = rolling(hashes, width)[whole]
        order = np.lexsort((items[row[whole]], key))
        key, whole, owner = key[order], whole[order], items[row[whole]][order]
        fresh = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
        # a second window of one hash and other words keeps its own entry
        span = starts[whole + width - 1] + lengths[whole + width - 1] - starts[whole]
        if len(key):
            alike = (span[1:] == span[:-1]) & same_bytes(raw, starts[whole[1:]], raw, starts[whole[:-1]], np.minimum(span[1:], span[:-1]))
            fresh[1:] |= ~alike
        self.width, self.block = width, min(2, width)
        self.raw, self.starts, self.lengths = raw, starts, lengths
        self.owners, self.owner_ends = owner, np.r_[np.flatnonzero(fresh), len(owner)]
        first = whole[fresh]
        ends = first + width - 1
        bucket = self.bucket(self.blocks(hashes, ends), key[fresh].copy())
        self.order = np.argsort(bucket, kind="stable")
        self.buckets, self.first = bucket[self.order], first
        places = width - self.block + 1
        self.bits = U(max(10, int(len(ends) * places * 8).bit_length()))
        self.shift = np.full(1 << int(self.bits), places, np.uint8)
        for k in range(places - 1, -1, -1):
            self.shift[self.slot(self.blocks(hashes, ends - k))] = k

    def blocks(self, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hash of the block of words that ends at each place."""
        return hashes[at] if self.block == 1 else mixed(hashes[at] + hashes[at - 1] * BASE)

    def slot(self, blocks: np.ndarray) -> np.ndarray:
        return (blocks >> (U(64) - self.bits)).astype(np.int64)

    @staticmethod
    def bucket(suffix: np.ndarray, key: np.ndarray) -> np.ndarray:
        return mixed(suffix ^ mixed(key))

    def window_keys(self, hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of all words of the window that ends at each place."""
        key = np.zeros(len(ends), U)
        for k in range(self.width - 1, -1, -1):
            key = key * BASE + hashes[ends - k]
        return key

    def search(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word and window of every occurrence inside one row."""
        counts = np.diff(firsts)
        long_enough = np.flatnonzero(counts >= self.width)
        runs = -(-(counts[long_enough] - self.width + 1) // RUN)
        of = np.repeat(long_enough, runs)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(runs) - runs, runs)
        at = firsts[of] + self.width - 1 + nth * RUN
        stop = np.minimum(at + RUN, firsts[of + 1])
        zero = []
        while len(at):
            step = self.shift[self.slot(self.blocks(hashes, at))]
            zero.append(at[step == 0])
            at = at + np.maximum(step, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        ends = np.concatenate(zero) if zero else np.zeros(0, np.int64)
        sought = self.bucket(self.blocks(hashes, ends), self.window_keys(hashes, ends))
        low = np.searchsorted(self.buckets, sought, "left")
        size = np.searchsorted(self.buckets, sought, "right") - low
        ends, low = np.repeat(ends, size), np.repeat(low, size)
        nth = np.arange(len(ends)) - np.repeat(np.cumsum(size) - size, size)
        first, window = ends - self.width + 1, self.order[low + nth]
        for k in range(self.width):
            at, pattern = first + k, self.first[window] + k
            equal = lengths[at] == self.lengths[pattern]
            equal[equal] = same_bytes(raw, starts[at[equal]], self.raw, self.starts[pattern[equal]], lengths[at[equal]])
            first, window = first[equal], window[equal]
        return first, window


def window_tables(segments: list) -> tuple[list[WindowTable], pa.Array]:
    """A table for each width that some segment has, and the items they refer to."""
    items = sorted({s.item for s in segments})
    number = {item: k for k, item in enumerate(items)}
    tables = []
    for width in sorted({s.width for s in segments}):
        own = [s for s in segments if s.width == width]
        tables.append(WindowTable(width, pa.array([s.words for s in own], pa.string()), np.array([number[s.item] for s in own])))
    return tables, pa.array(items, pa.string())


def occurrences(text: pa.Array, tables: list[WindowTable], items: pa.Array) -> Iterator[tuple[int, list, list]]:
    """Words, hit intervals and items of each text."""
    _, offsets = text_buffer(text)
    for a, b in slices(offsets):
        raw, starts, lengths, firsts = lowered_words(text.slice(a, b - a))
        hashes = hash_spans(raw, starts, lengths)
        depth = np.zeros(len(starts) + 1, np.int64)
        row, of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for table in tables:
            first, window = table.search(raw, starts, lengths, hashes, firsts)
            np.add.at(depth, first, 1)
            np.subtract.at(depth, first + table.width, 1)
            # equal pairs of row and window first, as a window may have many owners
            where = np.searchsorted(firsts, first, "right") - 1
            pairs = np.unique(np.stack([where, window]), axis=1) if len(first) else np.zeros((2, 0), np.int64)
            size = table.owner_ends[pairs[1] + 1] - table.owner_ends[pairs[1]]
            nth = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            row.append(np.repeat(pairs[0], size))
            of.append(table.owners[np.repeat(table.owner_ends[pairs[1]], size) + nth])
        row, of = np.unique(np.stack([np.concatenate(row), np.concatenate(of)]), axis=1)
        bounds = np.searchsorted(row, np.arange(b - a + 1))
        hit = np.cumsum(depth[:-1]) > 0
        inside = row_of(firsts)
        joined = hit[1:] & hit[:-1] & (inside[1:] == inside[:-1])
        begin, end = np.flatnonzero(hit & ~np.r_[False, joined]), np.flatnonzero(hit & ~np.r_[joined, False])
        edges = np.searchsorted(begin, firsts)
        for k in range(b - a):
            spans = [
                {"first": int(x - firsts[k]), "last": int(y - firsts[k])}
                for x, y in zip(begin[edges[k] : edges[k + 1]].tolist(), end[edges[k] : edges[k + 1]].tolist(), strict=True)
            ]
            yield int(firsts[k + 1] - firsts[k]), spans, items.take(pa.array(of[bounds[k] : bounds[k + 1]])).to_pylist()


def benchmark_hits(
    documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS,
    id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id",
) -> DataFrame:
    """``doc_id, n_words, hits, items``: hits are the maximal intervals of words inside any
    occurrence, counted from 0, the last word included; items are sorted as strings."""
    spark = documents.sparkSession
    segments = item_segments(benchmark, window, item_column, "text")
    size = segments.agg(F.sum("n_words")).first()[0] or 0
    shards = max(1, -(-2 * size // shard_words))
    placed = with_place(documents, doc_id=id_column, text=text_column).select("doc_id", "_file", "_row", "text")
    schema = FOUND.format(id=placed.schema["doc_id"].dataType.simpleString())
    parts = []
    for shard in range(shards):
        own = segments.filter(F.pmod(F.xxhash64("words"), F.lit(shards)) == shard)
        parts.append(placed.mapInArrow(_finder(spark, own.collect(), shard == 0), schema))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionAll(part)
    if shards > 1:
        found = found.groupBy("_file", "_row").agg(
            F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
            F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("items")).alias("items"),
        ).mapInArrow(_merge, schema)
    return found.select("doc_id", "n_words", "hits", "items")


SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What several shards found in a document: intervals that touch or overlap made one."""
    for batch in batches:
        hits, items = [], []
        for found, names in zip(batch.column("hits").to_pylist(), batch.column("items").to_pylist(), strict=True):
            done: list[dict] = []
            for h in sorted(found, key=lambda h: h["first"]):
                if done and h["first"] <= done[-1]["last"] + 1:
                    done[-1]["last"] = max(done[-1]["last"], h["last"])
                else:
                    done.append(h)
            hits.append(done)
            items.append(sorted(set(names)))
        yield _found(batch, batch.column("n_words"), hits, items)


def _found(batch: pa.RecordBatch, n_words: pa.Array, hits: list, items: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [batch.column(k) for k in ("doc_id", "_file", "_row")] + [n_words, pa.array(hits, SPANS), pa.array(items, pa.list_(pa.string()))],
        names=["doc_id", "_file", "_row", "n_words", "hits", "items"],
    )


def _finder(spark: SparkSession, segments: list, every: bool):
    """Search of one shard; ``every`` also reports documents without a hit."""
    tables = spark.sparkContext.broadcast(window_tables(segments))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, items = tables.value
        for batch in batches:
            found = list(occurrences(batch.column("text"), held, items))
            out = _found(batch, pa.array([f[0] for f in found], pa.int64()), [f[1] for f in found], [sorted(f[2]) for f in found])
            yield out if every else out.filter(pa.array([bool(f[1]) for f in found], pa.bool_()))

    return find


def op12_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of ten words of all benchmark items, in all documents."""
    found = benchmark_hits(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet"))
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda n, h: n + h["last"] - h["first"] + 1)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


OP12_SQL = r"""
WITH words AS (
    SELECT row_number() OVER () AS place, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), items AS (
    SELECT coalesce(item_id::VARCHAR, '') AS item,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), item_windows AS (
    SELECT DISTINCT item, least(10, len(w)) AS width, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS words
    FROM items, unnest(range(1, greatest(0, len(w) - 9) + CASE WHEN len(w) BETWEEN 1 AND 9 THEN 2 ELSE 1 END)) AS t(i)
    WHERE len(w) > 0
), widths AS (SELECT DISTINCT width FROM item_windows),
document_windows AS (
    SELECT place, width, i, array_to_string(w[i:i + width - 1], ' ') AS words
    FROM words, widths, unnest(range(1, len(w) - width + 2)) AS t(i)
), found AS (
    SELECT place, i, width, item FROM document_windows JOIN item_windows USING (width, words)
), hit AS (
    SELECT place, count(DISTINCT p) AS n_hit
    FROM (SELECT DISTINCT place, i, width FROM found), unnest(range(i, i + width)) AS t(p)
    GROUP BY place
), named AS (
    SELECT place, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
    FROM (SELECT DISTINCT place, item FROM found) GROUP BY place
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM words LEFT JOIN hit USING (place) LEFT JOIN named USING (place)
"""
