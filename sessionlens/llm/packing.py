"""Packing of documents into sequences by swap-based local search.

A document is its token ids and an end id.  Longer ones are cut into full pieces after a first,
shorter one, so a document leaves at most one piece that is not full.  Full pieces are
sequences of their own.  The others are dealt by a hash of their place into groups of about
16,384, each packed in one task: best fit of falling lengths to begin with, then a local
search that empties the least filled bin by moves and by exchanges of one for one, two for one
and one for two.  Each step moves length from a bin to a fuller one, which increases the sum
of squared fills, so the search ends; it stops early at the lower bound.  A group gives away
less than a sequence against packing all at once.

Defined results: a null or empty text is the end id alone; repeated rows are packed each; ids
may be null or repeated; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .places import with_place
from .tokens import encoder, vocabulary

LENGTH = 1024
END_ID = 2
GROUP_DOCUMENTS = 1 << 14
TRIES = 64
PIECE = "doc_id {id}, group bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item, by falling length into the fullest bin that has room."""
    out = np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, bins = 0, 0  # rooms: bit r is set if a bin has room r
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        fit = rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            b, room, bins = bins, capacity, bins + 1
        out[k] = b
        if room > n:
            by_room[room - n].append(b)
            rooms |= 1 << (room - n)
    return out


def local_search(lengths: np.ndarray, where: np.ndarray, capacity: int, tries: int = TRIES) -> np.ndarray:
    """Fewer bins, by steps that empty the least filled one into fuller ones.

    After ``tries`` bins in a row that no step could empty the search gives up.
    """
    where = where.copy()
    fill = np.bincount(where, weights=lengths).astype(np.int64)
    # no two items above half a bin share one
    least = max(-(-int(lengths.sum()) // capacity), int((2 * lengths > capacity).sum()))
    stuck = np.zeros(len(fill), bool)
    failed = 0
    while np.count_nonzero(fill) > least and failed < tries:
        open_ = np.flatnonzero((fill > 0) & (fill < capacity) & ~stuck)
        if not len(open_):
            break
        v = int(open_[np.argmin(fill[open_])])
        moved = 0
        while fill[v] and (step := _step(lengths, where, fill, v, capacity)):
            give, take, u = step
            gain = int(lengths[give].sum() - lengths[take].sum())
            where[give], where[take] = u, v
            fill[u] += gain
            fill[v] -= gain
            moved += gain
        if moved:
            # other bins may find room now; squared fill has grown, so this comes to an end
            stuck[:] = False
            failed = 0 if not fill[v] else failed + 1
        else:
            failed += 1
        stuck[v] = bool(fill[v])
    return np.unique(where, return_inverse=True)[1]


def _step(lengths: np.ndarray, where: np.ndarray, fill: np.ndarray, v: int, capacity: int):
    """Items to give from bin v, items to take for them, and the fuller bin to trade with."""
    mine = np.flatnonzero(where == v)
    mine = mine[np.argsort(-lengths[mine], kind="stable")]
    able = (fill >= fill[v]) & (fill < capacity)
    able[v] = False
    room = np.where(able, capacity - fill, -1)
    # move
    for k in mine.tolist():
        fit = np.flatnonzero(room >= lengths[k])
        if len(fit):
            return [k], [], int(fit[np.argmin(room[fit])])
    others = np.flatnonzero(room[where] > 0)
    size, space = lengths[others], room[where[others]]
    # one or two of mine for one of theirs: the gain must be positive and fit into their room
    single = [[k] for k in mine.tolist()]
    double = [[a, b] for i, a in enumerate(mine[:16].tolist()) for b in mine[i + 1 : 16].tolist()]
    for give in single + double:
        gain = int(lengths[give].sum()) - size
        good = np.flatnonzero((gain > 0) & (gain <= space))
        if len(good):
            j = good[np.argmax(gain[good])]
            return give, [int(others[j])], int(where[others[j]])
    # one of mine for two of theirs
    order = np.lexsort((size, where[others]))
    pair = np.flatnonzero(where[others[order[1:]]] == where[others[order[:-1]]])
    both = size[order[pair]] + size[order[pair + 1]]
    for k in mine.tolist():
        gain = int(lengths[k]) - both
        good = np.flatnonzero((gain > 0) & (gain <= space[order[pair]]))
        if len(good):
            j = pair[good[np.argmax(gain[good])]]
            return [k], [int(others[order[j]]), int(others[order[j + 1]])], int(where[others[order[j]]])
    return None


def pack_pieces(pieces: DataFrame, capacity: int = LENGTH) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with ``group`` and ``length`` (at most the capacity)."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name != "group")

    def pack(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        group = table.column("group")[0].as_py()
        short = np.flatnonzero(lengths < capacity)
        number = np.zeros(len(lengths), np.int64)
        if len(short):
            number[short] = local_search(lengths[short], best_fit(lengths[short], capacity), capacity)
        full = np.flatnonzero(lengths >= capacity)
        number[full] = np.arange(len(full)) + (number[short].max() + 1 if len(short) else 0)
        order = np.argsort(number, kind="stable")
        ends = np.cumsum(lengths[order])
        first = np.r_[True, number[order[1:]] != number[order[:-1]]]
        before = ends - lengths[order]
        offset = np.empty(len(lengths), np.int64)
        offset[order] = before - np.repeat(before[first], np.diff(np.r_[np.flatnonzero(first), len(order)]))
        out = table.drop_columns(["group"])
        return out.append_column("sequence_id", pa.array(number + (group << 36))).append_column("offset", pa.array(offset))

    return pieces.groupBy("group").applyInArrow(pack, schema + ", sequence_id bigint, offset bigint")


def token_pieces(documents: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """One row per piece with the group it is packed in; ``with_ids`` adds the ids (32-bit
    little-endian) themselves."""
    placed = with_place(documents, doc_id="doc_id", text="text")
    groups = placed.count() // GROUP_DOCUMENTS + 1
    dealt = placed.select("doc_id", "text", F.pmod(F.xxhash64("_file", "_row"), F.lit(groups)).alias("group"))
    schema = PIECE.format(id=placed.schema["doc_id"].dataType.simpleString()) + (", ids binary" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bounds = encoder(tokenizer).encode(batch.column("text"))
            n = np.diff(bounds) + 1
            count = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            head = n - (count - 1) * capacity
            start = np.where(piece > 0, head[row] + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, head[row])
            # every document's ids with its end id, one document after another
            wide = np.insert(ids.astype("<u4"), bounds[1:], end_id)
            at = (bounds[:-1] + np.arange(len(n)))[row] + start
            blobs = [wide[a : a + k] for a, k in zip(at.tolist(), length.tolist(), strict=True)]
            columns = [
                batch.column("doc_id").take(pa.array(row)), batch.column("group").take(pa.array(row)), pa.array(piece.astype(np.int32)),
                pa.array(start), pa.array(length), pa.array([zlib.crc32(b) for b in blobs], pa.int64()),
            ]
            names = ["doc_id", "group", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array([b.tobytes() for b in blobs], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return dealt.mapInArrow(cut, schema)


def packed_documents(documents: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``) per piece."""
    return pack_pieces(token_pieces(documents, tokenizer, end_id, capacity, with_ids), capacity)


def op10_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of 1,024 tokens."""
    return packed_documents(spark.read.parquet(f"{folder}/documents.parquet"), vocabulary())
