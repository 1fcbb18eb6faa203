"""Token ids in binary files, by an adaptive context-mixing range coder.

A file row is a chunk: the ids of consecutive documents in ascending order of ``doc_id``, cut
into blocks of 1,024 ids.  Every block is coded from fresh models and carries its own length
and CRC-32, so one can be read without the others and a damaged one is noticed.

In a block, the contexts of order 2 and order 1 (the last two ids, the last id) each predict
the id that followed last time, with a confidence; order 0 is the rate at which predictions
hold.  The three are mixed in the logistic domain by weights learned on the way, which gives
the probability that the predicted id comes.  If another comes, its high byte is coded by the
block's own frequencies of order 0, its low byte as it is.  All arithmetic is on integers, so
the reader's models agree with the writer's on any machine.

The blocks of a chunk are coded side by side, one id of each at a time: an array has an entry
per block, and there are up to 8,192 of them, so that what a step costs is its arithmetic.  A
range of 64 bits holds all of an id at once; it is refilled by 32 bits.  Ids must be below 65,536.

Defined results: a null or empty text is the end id alone; documents of null id come first;
repeated rows are written each, in the order of their texts; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.durable import shared_dir
from .places import small_batches
from .tokens import encoder, vocabulary

BLOCK = 1024
CHUNK = 1 << 23
END_ID = 0
SLOTS = 1024
MAGIC = b"TID2"
HEAD = struct.Struct("<HHI")  # ids, 32-bit words, CRC-32 of the ids
#: Steps before which the shares of the high bytes are taken again.
REFRESH = (0, 16, 32, 64, 128, 192, 256, 384, 512, 704)
SIXTEEN = np.int32(16)

_x = np.arange(4096)
#: Logistic function and its inverse on 12-bit integers.
SQUASH = np.clip(np.rint(4096 / (1 + np.exp(-(_x - 2048) / 256.0))), 32, 4064).astype(np.int32)
STRETCH = np.clip(np.rint(256 * np.log((_x + 0.5) / (4095.5 - _x))), -2047, 2047).astype(np.int32)

#: What a guess says if it is not the one proposed, then if it is.
AGREES = np.concatenate([-STRETCH >> 1, STRETCH])
#: Change of a confidence, by what it is, after a wrong guess and then after a right one.
GAIN = np.array([-((c + 1) >> 1) for c in range(8)] + [1] * 7 + [0], np.int32)

#: How slowly the rates of the orders follow.
PACE = np.array([[4], [4], [5]], np.int32)


class Models:
    """The models of ``lanes`` blocks, one entry each.  Only the first ``live`` are followed.

    Tables of several entries a block hold the blocks side by side: entry, then block.  Rows of
    an array are orders: 2, 1 and, where there is a third, 0."""

    def __init__(self, lanes: int):
        self.lanes = lanes
        self.lane = np.arange(lanes)
        both = np.arange(2)[:, None]
        self.base = (self.lane * SLOTS + both * lanes * SLOTS).astype(np.int32)
        self.guess = np.zeros(2 * lanes * SLOTS, np.int32)  # id << 3 | confidence
        self.place = (self.lane + both * lanes * 8).astype(np.int32)
        self.rate = np.full(2 * lanes * 8, 1 << 14, np.int32)  # 16 bits, by confidence
        self.odds = np.full((3, lanes), 1 << 13, np.int32)
        self.same = np.ones((3, lanes), bool)
        self.weight = np.full((3, lanes), 1 << 14, np.int32)
        self.count = np.ones(lanes * 256, np.int32)
        self.sums = np.zeros((257, lanes), np.int32)
        self.flat = self.sums.ravel()
        self.last = np.zeros(lanes, np.int32)
        self.before = np.zeros(lanes, np.int32)
        self.seen: list[np.ndarray] = []
        self.step = 0

    def narrow(self, live: int) -> None:
        """Follow the first ``live`` blocks only."""
        if live < len(self.lane):
            for name in ("lane", "base", "place", "odds", "same", "weight", "last", "before"):
                setattr(self, name, getattr(self, name)[..., :live].copy())

    def refresh(self) -> None:
        """Shares of the high bytes, of 4,096, from the ids so far."""
        for at in self.seen:
            self.count[at] += 24
        self.seen = []
        # all blocks have counted as many ids; the first byte has what rounding leaves
        scale = np.int32(((4096 - 256) << 16) // (256 + 24 * self.step))
        part, total = np.empty(self.lanes, np.int32), np.zeros(self.lanes, np.int32)
        for high in range(256):
            np.multiply(self.count[high * self.lanes : (high + 1) * self.lanes], scale, out=part)
            np.right_shift(part, SIXTEEN, out=part)
            total += part
            np.add(total, np.int32(high + 1), out=self.sums[high + 1])
        rounding = 4096 - self.sums[256]
        for row in self.sums[1:]:
            row += rounding
        self.steps16 = self.sums[16:256:16].copy()

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """The predicted ids and the probability of each, of 4,096."""
        if self.step in REFRESH:
            self.refresh()
        self.at = np.empty_like(self.base)
        np.multiply(self.last, np.int32(40503), out=self.at[0])
        self.at[0] += self.before
        np.multiply(self.last, np.int32(2 * 40503), out=self.at[1])
        self.at >>= 3
        self.at &= SLOTS - 1
        self.at += self.base
        self.held = self.guess.take(self.at, mode="clip")
        self.sure = self.held & 7
        self.ids = self.held >> 3
        self.guessed = np.where(self.sure[0], self.ids[0], self.ids[1])
        np.equal(self.ids, self.guessed, out=self.same[:2])
        self.slot = self.sure * self.lanes
        self.slot += self.place
        self.rate.take(self.slot, mode="clip", out=self.odds[:2])
        where = self.odds >> 4
        where += self.same * np.int32(4096)
        self.input = AGREES.take(where, mode="clip")
        dot = (self.weight * (self.input >> 1)).sum(axis=0, dtype=np.int32)
        dot >>= 14
        dot += 2048
        self.p = SQUASH.take(dot, mode="clip")
        return self.guessed, self.p

    def update(self, ids: np.ndarray, hit: np.ndarray, high: np.ndarray) -> None:
        """Learn the ids; ``high`` has the places of their high bytes."""
        error = ((hit * np.int32(4096)) - self.p) * 6
        change = self.input * error
        change += 0x2000
        change >>= 14
        self.weight += change
        if self.step % 64 == 0:
            # a step adds less than 1 << 12, so sums of three products stay within 32 bits
            np.clip(self.weight, -(1 << 17), 1 << 17, out=self.weight)
        change = (self.same == hit) * np.int32(65535)
        change -= self.odds
        change >>= PACE
        self.odds += change
        self.rate[self.slot] = self.odds[:2]
        # a right guess gains confidence, a wrong one loses half or, if of low confidence, is replaced
        case = (self.ids == ids) * np.int32(8)
        case += self.sure
        self.held += GAIN.take(case, mode="clip")
        np.copyto(self.held, ids << 3 | 1, where=case <= 3)
        self.guess[self.at] = self.held
        if self.step < REFRESH[-1]:
            self.seen.append(high)
        self.before, self.last = self.last * np.int32(27191), ids
        self.step += 1


def lives(sizes: np.ndarray) -> list[int]:
    """How many blocks hold an id at each step; ``sizes`` fall."""
    return np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(sizes) else 0), "left").tolist()


def code_blocks(ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Code words of blocks: ``ids`` [steps, lanes], lanes sorted by falling size."""
    steps, lanes = ids.shape
    models = Models(lanes)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    flat = np.zeros(lanes * (steps + 2), np.uint32)
    place = np.arange(lanes) * (steps + 2)

    def carry(at: np.ndarray) -> None:
        while len(at):
            flat[at] += np.uint32(1)
            at = at[flat[at] == 0] - 1

    for t, n in enumerate(lives(sizes)):
        models.narrow(n)
        own, lows, spans = ids[t, :n], low[:n], span[:n]
        guess, p = models.predict()
        hit = guess == own
        unit = spans >> np.uint64(12)
        first = unit * p.view(np.uint32)
        # a missed id has a part of the rest: its high byte of 12 bits, in that its low byte
        at = (own >> 8) * lanes + models.lane
        start = models.flat.take(at, mode="clip")
        size = models.flat.take(at + lanes, mode="clip") - start
        start <<= 8
        start += (own & 255) * size
        rest = ((unit << np.uint64(12)) - first) >> np.uint64(20)
        new = lows + np.where(hit, np.uint64(0), first + rest * start.view(np.uint32))
        width = np.where(hit, first, rest * size.view(np.uint32))
        carry(place[np.flatnonzero(new < lows)] - 1)
        out = np.flatnonzero(width < np.uint64(1 << 32))
        full, to = new[out], place[out]
        flat[to] = full >> np.uint64(32)
        place[out] = to + 1
        new[out] = full << np.uint64(32)
        width[out] <<= np.uint64(32)
        low[:n], span[:n] = new, width
        models.update(own, hit, at)
    # one more word names a number in the last span: the next one that ends in 32 zeros
    end = low + np.uint64(2**32 - 1)
    carry(place[end < low] - 1)
    flat[place] = end >> np.uint64(32)
    coded, first = flat.astype("<u4"), np.arange(lanes) * (steps + 2)
    return [coded[a : b + 1].tobytes() for a, b in zip(first.tolist(), place.tolist(), strict=True)]


def read_blocks(codes: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """The ids [steps, lanes] of code words, lanes sorted by falling size."""
    lanes, steps = len(codes), int(sizes[0]) if len(sizes) else 0
    models = Models(lanes)
    first = np.cumsum([0] + [len(c) // 4 + 2 for c in codes])
    words = np.frombuffer(b"".join(c + b"\0\0\0\0\0\0\0\0" for c in codes), "<u4").astype(np.uint64)
    place = first[:-1] + 2
    code = words[first[:-1]] << np.uint64(32) | words[first[:-1] + 1]
    span = np.full(lanes, 2**64 - 1, np.uint64)
    out = np.zeros((steps, lanes), np.int32)
    for t, n in enumerate(lives(sizes)):
        models.narrow(n)
        codes_, spans = code[:n], span[:n]
        guess, p = models.predict()
        unit = spans >> np.uint64(12)
        part = unit * p.view(np.uint32)
        hit = codes_ < part
        # the rest is worked out for all; it means nothing where the guess was right
        beyond = codes_ - part
        rest = ((unit << np.uint64(12)) - part) >> np.uint64(20)
        value = np.minimum(beyond // rest, np.uint64((1 << 20) - 1)).astype(np.int32)
        upper = value >> 8
        high = (models.steps16[:, :n] <= upper).view(np.int8).sum(axis=0, dtype=np.int8).astype(np.int32) << 4
        at = high * lanes + models.lane
        for step in (8, 4, 2, 1):
            more = models.flat.take(at + step * lanes, mode="clip") <= upper
            at += more * (step * lanes)
            high += more * np.int32(step)
        start = models.flat.take(at, mode="clip")
        size = models.flat.take(at + lanes, mode="clip") - start
        start <<= 8
        byte = (value - start) // size
        start += byte * size
        own = np.where(hit, guess, high << 8 | byte)
        left = np.where(hit, codes_, beyond - rest * start.view(np.uint32))
        width = np.where(hit, part, rest * size.view(np.uint32))
        more = np.flatnonzero(width < np.uint64(1 << 32))
        from_ = place[more]
        left[more] = left[more] << np.uint64(32) | words.take(from_, mode="clip")
        place[more] = from_ + 1
        width[more] <<= np.uint64(32)
        code[:n], span[:n] = left, width
        models.update(own, hit, np.where(hit, (guess >> 8) * lanes + models.lane, at))
        out[t, :n] = own
    return out


def encode_chunk(ids: np.ndarray) -> bytes:
    """The bytes of a chunk: magic, number of blocks, block heads, code words."""
    n = -(-len(ids) // BLOCK)
    padded = np.zeros(n * BLOCK, np.int32)
    padded[: len(ids)] = ids
    sizes = np.minimum(BLOCK, len(ids) - np.arange(n) * BLOCK)
    codes = code_blocks(np.ascontiguousarray(padded.reshape(n, BLOCK).T[: int(sizes[0])]), sizes)
    wide = ids.astype("<u4")
    heads = [HEAD.pack(int(s), len(c) // 4, zlib.crc32(wide[k * BLOCK : k * BLOCK + int(s)])) for k, (s, c) in enumerate(zip(sizes, codes, strict=True))]
    return MAGIC + struct.pack("<I", n) + b"".join(heads) + b"".join(codes)


def decode_chunks(chunks: list[bytes]) -> list[np.ndarray]:
    """The ids of chunks, checked block by block; a damaged block raises ``ValueError``."""
    sizes, codes, sums, blocks = [], [], [], []
    for data in chunks:
        if data[:4] != MAGIC:
            raise ValueError("not a chunk of token ids")
        n = struct.unpack_from("<I", data, 4)[0]
        at = 8 + n * HEAD.size
        blocks.append(n)
        for k in range(n):
            size, words, crc = HEAD.unpack_from(data, 8 + k * HEAD.size)
            sizes.append(size)
            sums.append(crc)
            codes.append(data[at : at + 4 * words])
            at += 4 * words
        if at != len(data):
            raise ValueError("a chunk of another length than its heads say")
    order = np.argsort(-np.array(sizes, np.int64), kind="stable")
    ids = np.ascontiguousarray(read_blocks([codes[k] for k in order], np.array(sizes, np.int64)[order]).T).astype("<u4")
    back = np.argsort(order)
    parts = [ids[back[k], : sizes[k]] for k in range(len(sizes))]
    for k, part in enumerate(parts):
        if zlib.crc32(part) != sums[k]:
            raise ValueError(f"block {k} is damaged")
    ends = np.cumsum([0, *blocks])
    return [np.concatenate(parts[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def runs(sizes: Sequence[int]) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive chunks of ``CHUNK`` ids at most together, or of one chunk."""
    low, held = 0, 0
    for k, size in enumerate(sizes):
        if k > low and held + size > CHUNK:
            yield low, k
            low, held = k, 0
        held += int(size)
    if low < len(sizes):
        yield low, len(sizes)


def write_token_files(documents: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Write the ids of all documents, ascending by ``doc_id`` over the files of ``folder``.

    A row has ``part`` (ascending), ``chunk`` (ascending in the part), the documents' ids and
    numbers of token ids, and the coded bytes.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    ordered = small_batches(documents).select("doc_id", F.col("text").cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts, held, total, chunk = [], [], [], 0, 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([chunk], pa.int64()), pa.array([pa.concat_arrays(names).to_pylist()], pa.list_(names[0].type)),
                    pa.array([np.concatenate(counts).tolist()], pa.list_(pa.int64())), pa.array([encode_chunk(np.concatenate(held))], pa.binary()),
                ],
                names=["chunk", "doc_ids", "n_tokens", "coded"],
            )

        for batch in batches:
            column, doc = batch.column("text"), batch.column("doc_id")
            ids, bounds = encoder(tokenizer).encode(column)
            wide = np.insert(ids, bounds[1:], end_id)
            n = np.diff(bounds) + 1
            ends = np.cumsum(n)
            a = 0
            while a < len(n):
                # documents up to the end of the chunk; a document is never divided
                before = int(ends[a - 1]) if a else 0
                b = int(np.searchsorted(ends, before + CHUNK - total, "left")) + 1
                b = min(b, len(n))
                names.append(doc.slice(a, b - a))
                counts.append(n[a:b])
                held.append(wide[before : int(ends[b - 1])])
                total += int(ends[b - 1]) - before
                a = b
                if total >= CHUNK:
                    yield row()
                    names, counts, held, total, chunk = [], [], [], 0, chunk + 1
        if names:
            yield row()

    coded = ordered.mapInArrow(encode, f"chunk bigint, doc_ids array<{kind}>, n_tokens array<bigint>, coded binary")
    coded.withColumn("part", F.spark_partition_id().cast("bigint")).write.parquet(folder)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """``part, chunk, at, doc_id, start, n_tokens, ids`` (32-bit little-endian) per document."""
    files = spark.read.parquet(folder)
    # a row per chunk, which is eight million ids or the last of its part
    sizes = files.select("part", "chunk", F.aggregate("n_tokens", F.lit(0).cast("bigint"), lambda a, b: a + b).alias("all"))
    parts = sizes.groupBy("part").agg(F.sum("all").alias("part_all"))
    before = parts.select(F.col("part").alias("p"), (F.sum("part_all").over(Window.orderBy("part")) - F.col("part_all")).alias("part_start"))
    inside = sizes.select(
        F.col("part").alias("p"), F.col("chunk").alias("c"), (F.sum("all").over(Window.partitionBy("part").orderBy("chunk")) - F.col("all")).alias("chunk_start")
    )
    starts = inside.join(before, "p").select("p", "c", (F.col("chunk_start") + F.col("part_start")).alias("first"))
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column("n_tokens")).to_pylist()
            flat = pc.list_flatten(batch.column("n_tokens")).to_numpy()
            sizes = np.add.reduceat(np.r_[flat, 0], np.cumsum([0, *sizes[:-1]])) if sizes else []
            for low, high in runs(sizes):
                few = batch.slice(low, high - low)
                chunks = decode_chunks([x.as_py() for x in few.column("coded")])
                for k, ids in enumerate(chunks):
                    n = np.array(few.column("n_tokens")[k].as_py(), np.int64)
                    ends = np.cumsum(n)
                    columns = [
                        pa.array(np.full(len(n), few.column("part")[k].as_py())), pa.array(np.full(len(n), few.column("chunk")[k].as_py())),
                        pa.array(np.arange(len(n))), few.column("doc_ids")[k].values, pa.array(ends - n), pa.array(n),
                        pa.array([ids[e - m : e].tobytes() for e, m in zip(ends.tolist(), n.tolist(), strict=True)], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["part", "chunk", "at", "doc_id", "inside", "n_tokens", "ids"])

    rows = files.select("part", "chunk", "doc_ids", "n_tokens", "coded").mapInArrow(
        decode, f"part bigint, chunk bigint, at bigint, doc_id {kind}, inside bigint, n_tokens bigint, ids binary"
    )
    located = rows.join(starts, (F.col("part") == F.col("p")) & (F.col("chunk") == F.col("c")))
    return located.select("part", "chunk", "at", "doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids")


def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """All documents written as token files in the shared folder, and read back."""
    import uuid

    out = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(spark.read.parquet(f"{folder}/documents.parquet"), out, vocabulary())
    return read_token_files(spark, out).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
