"""Token ids of whole Arrow text columns by a byte-level tokenizer, each distinct piece encoded once.

The tokenizer splits a text into words before it looks for merges, so a text may be cut where
a split is certain, and the ids of the pieces put together are the ids of the text.  Cuts are
made before a space that a non-space follows, around a line feed between two non-spaces, and
between an ASCII letter and the ASCII sign after it.  Pieces are known by hash; a task keeps
the ids of the pieces it has met, up to a bound.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from .words import IS_SPACE, hash_spans, slices, text_buffer

KEPT_PIECES = 1 << 22
ENCODE_AT_ONCE = 1 << 15


def _bytes(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a:b] = True
    return out


LETTER = _bytes((0x41, 0x5B), (0x61, 0x7B))
SIGN = _bytes((0x21, 0x27), (0x28, 0x30), (0x3A, 0x41), (0x5B, 0x61), (0x7B, 0x7F))  # no apostrophe
#: First bytes of characters among which there is white space outside ASCII.
MAY_BE_SPACE = np.zeros(256, bool)
MAY_BE_SPACE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
MAY_BE_SPACE[0x1C:0x20] = True


def cuts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ascending byte positions at which pieces begin."""
    if not len(raw):
        return np.zeros(0, np.int64)
    begin = np.zeros(len(raw) + 1, bool)
    begin[offsets] = True
    solid = ~(IS_SPACE | MAY_BE_SPACE)[raw]
    begin[1:-2] |= (raw[1:-1] == 0x20) & solid[2:]
    begin[1:-1] |= LETTER[raw[:-1]] & SIGN[raw[1:]]
    feed = np.flatnonzero(raw[1:-1] == 0x0A) + 1 if len(raw) > 2 else np.zeros(0, np.int64)
    feed = feed[solid[feed - 1] & (raw[feed - 1] < 0x80) & solid[feed + 1]]
    begin[feed] = begin[feed + 1] = True
    return np.flatnonzero(begin[: len(raw)])


class Encoder:
    """Ids of text columns; ``path`` names the tokenizer's file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # a byte-level vocabulary shows each byte as a printable character: itself, or one from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        self.shown = {b: chr(256 + k) for k, b in enumerate(others)}
        self.clear()

    def clear(self) -> None:
        self.table = np.full(1 << 20, -1, np.int32)
        self.hash = np.zeros(1 << 18, np.uint64)
        self.first = np.zeros(1 << 18, np.int32)
        self.size = np.zeros(1 << 18, np.int32)
        self.ids = np.zeros(1 << 20, np.uint16)
        self.pieces = self.used = 0

    def _look_up(self, h: np.ndarray) -> np.ndarray:
        """Number of each piece, -1 if not met; slots are probed one after another."""
        mask = len(self.table) - 1
        out = np.full(len(h), -1, np.int64)
        slot = (h & np.uint64(mask)).astype(np.int64)
        open_ = np.arange(len(h))
        while len(open_):
            piece = self.table[slot[open_]]
            same = (piece >= 0) & (self.hash[piece] == h[open_])
            out[open_[same]] = piece[same]
            open_ = open_[(piece >= 0) & ~same]
            slot[open_] = (slot[open_] + 1) & mask
        return out

    def _add(self, h: np.ndarray, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        """Encode pieces not met before (distinct hashes) and keep their ids."""
        texts = [raw[a : a + n].tobytes().decode() for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
        for k in range(0, len(texts), ENCODE_AT_ONCE):
            got = self._ids(texts[k : k + ENCODE_AT_ONCE])
            flat = np.fromiter((i for ids in got for i in ids), np.uint16)
            count = np.fromiter(map(len, got), np.int32, len(got))
            while self.used + len(flat) > len(self.ids):
                self.ids = np.r_[self.ids, np.zeros_like(self.ids)]
            while self.pieces + len(got) > len(self.hash):
                self.hash, self.first, self.size = (np.r_[v, np.zeros_like(v)] for v in (self.hash, self.first, self.size))
            self.ids[self.used : self.used + len(flat)] = flat
            new = np.arange(self.pieces, self.pieces + len(got))
            self.hash[new] = h[k : k + len(got)]
            self.first[new] = self.used + np.cumsum(count) - count
            self.size[new] = count
            self.used, self.pieces = self.used + len(flat), self.pieces + len(got)
            if self.pieces * 2 > len(self.table):
                self.table = np.full(4 * len(self.table), -1, np.int32)
                new = np.arange(self.pieces)
            self._place(new)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of each piece; a word of Latin letters is one split, so it goes to the merges directly."""
        model, space, out, rest = self.tokenizer.model, self.shown[0x20], [], []
        for text in texts:
            word = text[1:] if text[0] == " " else text
            if text.isascii() and word.isalpha():
                # of its bytes only the space is shown as another character
                out.append([t.id for t in model.tokenize(text if word is text else space + word)])
            elif word.isalpha() and max(word) < "\u0250":
                out.append([t.id for t in model.tokenize(text.encode().decode("latin-1").translate(self.shown))])
            else:
                out.append(None)
                rest.append(text)
        got = iter(self.tokenizer.encode_batch_fast(rest, add_special_tokens=False))
        return [next(got).ids if ids is None else ids for ids in out]

    def _place(self, new: np.ndarray) -> None:
        mask = len(self.table) - 1
        slot = (self.hash[new] & np.uint64(mask)).astype(np.int64)
        while len(new):
            free = self.table[slot] < 0
            self.table[slot[free]] = new[free]  # of several for a slot the last stays
            rest = self.table[slot] != new
            new, slot = new[rest], (slot[rest] + 1) & mask

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after another (uint16) and n + 1 bounds; nulls have none."""
        raw, offsets = text_buffer(column)
        out, bounds = [np.zeros(0, np.uint16)], [np.zeros(1, np.int64)]
        total = 0
        for a, b in slices(offsets):
            part, own = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            starts = cuts(part, own)
            sizes = np.diff(np.r_[starts, len(part)])
            h = hash_spans(part, starts, sizes)
            piece = self._look_up(h)
            missing = np.flatnonzero(piece < 0)
            if len(missing):
                if self.pieces > KEPT_PIECES:
                    self.clear()
                    missing = np.arange(len(h))
                order = missing[np.argsort(h[missing], kind="stable")]
                order = order[np.r_[True, h[order[1:]] != h[order[:-1]]]]
                self._add(h[order], part, starts[order], sizes[order])
                piece[missing] = self._look_up(h[missing])
            count = self.size[piece].astype(np.int64)
            ends = np.r_[0, np.cumsum(count)]
            at = np.arange(ends[-1]) + np.repeat(self.first[piece] - ends[:-1], count)
            out.append(self.ids[at])
            bounds.append(total + ends[np.searchsorted(starts, own[1:], "left")])
            total += int(ends[-1])
        return np.concatenate(out), np.concatenate(bounds)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
