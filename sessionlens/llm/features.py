"""Hashed word and character n-gram counts of Arrow text columns, and logistic regression on them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .words import hash_spans, rolling, row_of, slices, text_buffer, word_spans

BUCKETS = 1 << 14


def hashed_counts(text: pa.Array, buckets: int = BUCKETS):
    """Yields (first row, last row, row, bucket, value) for slices of the column.

    Features are single words, pairs of words and runs of 1 to 3 bytes inside a text; values are
    1 + log(count), scaled to length one in each row.  A text without words has none.
    """
    raw, offsets = text_buffer(text)
    for a, b in slices(offsets, 1 << 18):
        part, own = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, lengths, firsts = word_spans(part, own)
        h = hash_spans(part, starts, lengths)
        row = row_of(firsts)
        bits = np.uint64(64 - int(buckets).bit_length() + 1)
        keys, rows = [h >> bits], [row]
        pairs = rolling(h, 2)
        if len(pairs):
            inside = row[:-1] == row[1:]
            keys.append((pairs[inside] * np.uint64(0xD6E8FEB86659FD93)) >> bits)
            rows.append(row[:-1][inside])
        byte_row = np.repeat(np.arange(b - a), np.diff(own))
        code = part.astype(np.uint64)
        gram = code.copy()
        for n in (1, 2, 3):
            if n > 1:
                if len(part) < n:
                    break
                gram = gram[:-1] * np.uint64(257) + code[n - 1 :]
            inside = byte_row[: len(gram)] == byte_row[n - 1 :]
            keys.append(((gram[inside] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> bits)
            rows.append(byte_row[: len(gram)][inside])
        cell = np.concatenate(rows) * buckets + np.concatenate(keys).astype(np.int64)
        table = np.bincount(cell, minlength=(b - a) * buckets) if (b - a) * buckets <= 4 * len(cell) + (1 << 16) else None
        if table is None:
            cell = np.sort(cell)
            first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
            count = np.diff(np.r_[first, len(cell)])
            cell = cell[first]
        else:
            cell = np.flatnonzero(table)
            count = table[cell]
        r, bucket = np.divmod(cell, buckets)
        value = 1 + np.log(count)
        norm = np.sqrt(np.bincount(r, weights=value * value, minlength=b - a))
        yield a, b, r, bucket, value / norm[r]


def scores(text: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    """Linear scores of all rows; a text without words scores the bias alone."""
    out = np.full(len(text), bias)
    for a, b, r, bucket, value in hashed_counts(text, len(weights)):
        out[a:b] += np.bincount(r, weights=value * weights[bucket], minlength=b - a)
    return out


def fit_logistic(text: pa.Array, label: np.ndarray, buckets: int = BUCKETS, rounds: int = 200, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch gradient steps with momentum, classes weighted alike."""
    parts = list(hashed_counts(text, buckets))
    row = np.concatenate([a + r for a, _, r, _, _ in parts]) if parts else np.zeros(0, np.int64)
    bucket = np.concatenate([k for _, _, _, k, _ in parts]) if parts else np.zeros(0, np.int64)
    value = np.concatenate([v for _, _, _, _, v in parts]) if parts else np.zeros(0)
    w, bias = np.zeros(buckets), 0.0
    share = np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum()))
    speed, drift = np.zeros(buckets), 0.0
    for _ in range(rounds):
        z = np.bincount(row, weights=value * w[bucket], minlength=len(label)) + bias
        error = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label)
        speed = 0.9 * speed - 8.0 * (np.bincount(bucket, weights=value * error[row], minlength=buckets) + decay * w)
        drift = 0.9 * drift - 8.0 * float(error.sum())
        w, bias = w + speed, bias + drift
    return w, bias


def calibrate(z: np.ndarray, label: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Slope and offset that turn scores into probabilities of label 1 (Platt), by Newton steps."""
    slope, offset = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(slope * z + offset, -30, 30)))
        g = np.array([((p - label) * z).sum() + 1e-3 * (slope - 1), (p - label).sum() + 1e-3 * offset])
        s = p * (1 - p)
        hess = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-3]])
        step = np.linalg.solve(hess, g)
        slope, offset = slope - step[0], offset - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(slope), float(offset)
