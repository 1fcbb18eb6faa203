"""Words, hashes and windows of whole Arrow text columns, without a Python object per word.

A word is a run of bytes outside ``\\x20\\x09-\\x0D``; no byte of a multi-byte character
falls in that set, so byte positions are safe on UTF-8.  A null text has no words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

# memory that a batch used goes back to the system, as workers live longer than tasks
pa.set_memory_pool(pa.system_memory_pool())

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
MIX1, MIX2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
LONG_WORD = 1 << 10
SLICE_BYTES = 1 << 20

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and its n + 1 offsets; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]] if len(offsets) else raw[:0], offsets - (offsets[0] if len(offsets) else 0)


def slices(offsets: np.ndarray, size: int = SLICE_BYTES):
    """Ranges of consecutive rows of about ``size`` bytes, so that arrays stay in cache."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, in place."""
    h ^= h >> U(30)
    h *= MIX1
    h ^= h >> U(27)
    h *= MIX2
    h ^= h >> U(31)
    return h


def hash_spans(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes a step over all spans at once."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    words = np.ndarray((len(raw) + 1,), "<u8", buffer=padded, strides=(1,))
    keep = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], U)
    h = (lengths.astype(U) + U(1)) * BASE
    short = lengths <= LONG_WORD
    rows, step = np.flatnonzero(short), 0
    while len(rows):
        left = lengths[rows] - step
        if step:
            rows, left = rows[left > 0], left[left > 0]
            if not len(rows):
                break
        v = words[starts[rows] + step] & keep[np.minimum(left, 8)]
        x = (h[rows] ^ v) * MIX1
        x ^= x >> U(29)
        h[rows] = x * BASE
        step += 8
    for k in np.flatnonzero(~short):
        span = raw[starts[k] : starts[k] + lengths[k]].tobytes()
        h[k] = U(int.from_bytes(hashlib.blake2b(span, digest_size=8).digest(), "little"))
    return mixed(h)


def word_spans(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and byte length of every word, and the rows' first words (n + 1 entries);
    ``space`` marks the bytes outside words."""
    rows = len(offsets) - 1
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(rows + 1, np.int64)
    word = ~space[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | edge[1:-1]
    ends = word
    ends[:-1] &= ~word[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    lengths = np.flatnonzero(ends) + 1 - starts
    return starts, lengths, np.searchsorted(starts, offsets, "left").astype(np.int64)


def row_of(firsts: np.ndarray) -> np.ndarray:
    """The row of each word, from the rows' first words."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hashes sum(h[i + k] * B^(width-1-k)) mod 2^64 of all windows, by doubling."""
    if len(h) < width:
        return np.zeros(0, U)
    if width == 1:
        return h.copy()
    half = width // 2
    low = rolling(h, half)
    n = len(h) - 2 * half + 1
    out = low[:n] * U(pow(int(BASE), half, 2**64))
    out += low[half : half + n]
    if width % 2:
        out = out[:-1] * BASE
        out += h[width - 1 :]
    return out


def windows(h: np.ndarray, firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows inside one row, and the word each starts at."""
    rolled = rolling(h, width)
    if not len(rolled):
        return rolled, np.zeros(0, np.int64)
    row = row_of(firsts)
    at = np.flatnonzero(row[: len(rolled)] == row[width - 1 :])
    return mixed(rolled[at]), at
