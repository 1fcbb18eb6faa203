"""Substring dedup: Rabin-Karp hashes of every window of words, counted in Spark.

A window that starts at two places, in one document or two, is repeated; overlapping
repeated windows merge into maximal intervals, whose words are removed.  Windows are judged
on the input.  Counting keeps one copy of a hash per part of a file (see ``repeats``), so a
passage in a third of all documents makes no large group.

Hashes have 64 bits: with n windows, n^2 / 2^65 pairs of different windows are expected to
look alike (0.0003 for 10^8 windows).

Defined results: a null or empty text, or one with fewer words than a window, loses nothing;
repeated rows count as different places; an empty table gives an empty one; further columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .places import with_place
from .repeats import mark, shared_keys
from .words import hash_spans, slices, text_buffer, windows, word_spans

WINDOW = 35
RESULT = "doc_id {id}, n_words bigint, removed array<struct<first:bigint,last:bigint>>, kept_text string"


def window_hashes(text: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, list]:
    """Hash and row of every window, and per slice of rows what locates it."""
    raw, offsets = text_buffer(text)
    keys, rows, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], []
    for a, b in slices(offsets):
        part, own = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, lengths, firsts = word_spans(part, own)
        h, at = windows(hash_spans(part, starts, lengths), firsts, width)
        keys.append(h)
        rows.append(a + np.searchsorted(firsts, at, "right") - 1)
        places.append((a, b, part, starts, lengths, firsts, at))
    return np.concatenate(keys), np.concatenate(rows), places


def substring_dedup(documents: DataFrame, width: int = WINDOW, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_words, removed, kept_text``: the removed intervals count words from 0, the
    last one included; kept words are joined by one space."""
    placed = with_place(documents, doc_id=id_column, text=text_column)
    size = placed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    answers = shared_keys(placed, lambda text: window_hashes(text, width)[:2], size // 5)
    schema = RESULT.format(id=placed.schema["doc_id"].dataType.simpleString())

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("_row").combine_chunks()
        text = left.column("text").combine_chunks() if left.num_rows else pa.array([], pa.string())
        text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
        found: list = []

        def keys_of(column: pa.Array):
            keys, rows, places = window_hashes(column, width)
            found[:] = places
            return keys, rows

        _, _, hit = mark(text, left.column("_row").to_numpy(), right, keys_of)
        counts, gone, kept, done = [], [], [], 0
        for _, _, raw, starts, lengths, firsts, at in found:
            start = at[hit[done : done + len(at)]]
            done += len(at)
            depth = np.zeros(len(starts) + 1, np.int32)
            depth[start] += 1
            np.subtract.at(depth, start + width, 1)
            out = np.cumsum(depth[:-1]) > 0
            for f, t in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
                drop = out[f:t]
                words = raw[starts[f] : starts[t - 1] + lengths[t - 1]].tobytes().split() if t > f else []
                edges = np.flatnonzero(np.diff(np.r_[False, drop, False].astype(np.int8)))
                if len(edges):
                    words = [w for w, d in zip(words, drop.tolist(), strict=True) if not d]
                counts.append(t - f)
                gone.append([{"first": int(x), "last": int(y) - 1} for x, y in zip(edges[::2], edges[1::2], strict=True)])
                kept.append(b" ".join(words).decode())
        spans = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        return pa.table(
            {"doc_id": left.column("doc_id"), "n_words": pa.array(counts, pa.int64()), "removed": pa.array(gone, spans), "kept_text": pa.array(kept, pa.string())}
        )

    place = ["_file", "_part"]
    return placed.groupBy(*place).cogroup(answers.groupBy(*place)).applyInArrow(cut, schema)


def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of 35 words over all documents."""
    found = substring_dedup(spark.read.parquet(f"{folder}/documents.parquet"))
    removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, r: n + r["last"] - r["first"] + 1)
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))
