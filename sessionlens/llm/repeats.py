"""Which 64-bit keys of a part occur in another part as well, for keys too many to shuffle as rows.

Every part (a run of rows of one file) sorts its distinct keys and sends them as packed
slices, one per range of key values.  The task of a range finds the keys that two parts
share and answers each slice with a bitmap, so the way back costs a bit per key.  A key is
sent once per part however often it occurs there, so no key makes a range large.  Keys are
mixed first, so that ranges are alike whatever the keys mean.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import mixed

KEYS_PER_RANGE = 1 << 20
SLICE = "range bigint, _file bigint, _part bigint, first bigint, last bigint, keys binary"
ANSWER = "range bigint, _file bigint, _part bigint, first bigint, last bigint, bits binary"
KeysOf = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def range_bits(keys: int) -> int:
    """Bits of a key that choose its range, for about a million keys in each."""
    return max(0, (max(1, keys) // KEYS_PER_RANGE).bit_length())


def ranges_of(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The ranges met by sorted keys and the bounds of their slices."""
    which = keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64)
    starts = np.flatnonzero(np.r_[True, which[1:] != which[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return which[starts].astype(np.int64), np.r_[starts, len(keys)]


def distinct_sorted(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys


def shared_keys(placed: DataFrame, keys_of: KeysOf, keys: int) -> DataFrame:
    """Answers for ``keys_of`` applied to the text column of ``placed``; see ``mark``."""
    bits = range_bits(keys)

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            file, part, row = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("_file", "_part", "_row"))
            cut = np.flatnonzero((file[1:] != file[:-1]) | (part[1:] != part[:-1])) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
                own = distinct_sorted(mixed(keys_of(batch.column("text").slice(a, b - a))[0].copy()))
                which, bounds = ranges_of(own, bits)
                n = len(which)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(which)]
                    + [pa.array(np.full(n, v[a if v is not row else k])) for v, k in ((file, a), (part, a), (row, a), (row, b - 1))]
                    + [pa.array([own[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())],
                    names=["range", "_file", "_part", "first", "last", "keys"],
                )

    def answer(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        table = pa.Table.from_batches(held)
        blobs = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("keys")]
        every = np.sort(np.concatenate(blobs))
        twice = every[1:][every[1:] == every[:-1]]
        marks, keep = [], []
        for k, own in enumerate(blobs):
            at = np.searchsorted(twice, own)
            hit = at < len(twice)
            hit[hit] = twice[at[hit]] == own[hit]
            if hit.any():
                keep.append(k)
                marks.append(np.packbits(hit).tobytes())
        out = table.drop_columns(["keys"]).take(pa.array(keep, pa.int64()))
        yield from out.append_column("bits", pa.array(marks, pa.binary())).to_batches()

    sent = placed.select("_file", "_part", "_row", "text").mapInArrow(slices, SLICE)
    return sent.groupBy("range").applyInArrow(answer, ANSWER).withColumn("bits_of", F.lit(bits))


def mark(text: pa.Array, rows: np.ndarray, answers: pa.Table, keys_of: KeysOf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a part's rows, the row of each, and whether the key occurs elsewhere too.

    ``rows`` are the ascending row numbers of ``text``.  A key that occurs twice in the part
    counts as well.
    """
    plain, row = keys_of(text)
    keys = mixed(plain.copy())
    hit = np.zeros(len(keys), bool)
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    if not answers.num_rows:
        return plain, row, hit
    first, last, which = (answers.column(k).to_numpy() for k in ("first", "last", "range"))
    bits = answers.column("bits").to_pylist()
    shift = answers.column("bits_of")[0].as_py()
    where = rows[row]
    for a, b in sorted(set(zip(first.tolist(), last.tolist(), strict=True))):
        mine = np.flatnonzero((where >= a) & (where <= b))
        own = distinct_sorted(keys[mine])
        found, bounds = ranges_of(own, shift)
        at = dict(zip(found.tolist(), range(len(found)), strict=True))
        repeated = np.zeros(len(own), bool)
        for k in np.flatnonzero((first == a) & (last == b)).tolist():
            i = at[int(which[k])]
            size = bounds[i + 1] - bounds[i]
            repeated[bounds[i] : bounds[i + 1]] = np.unpackbits(np.frombuffer(bits[k], np.uint8), count=size).view(bool)
        hit[mine] |= repeated[np.searchsorted(own, keys[mine])]
    return plain, row, hit
