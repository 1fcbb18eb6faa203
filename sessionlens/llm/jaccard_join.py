"""N-gram Jaccard join: documents whose sets of word shingles overlap enough, exactly.

Sets are ordered by one global order: shingles that are frequent in the corpus last, others
by hash.  Two sets of similarity t share one of their first n - ceil(t n) + 1 shingles, so
only shingles that occur in the prefixes of two parts of the data (see ``repeats``) are kept,
and documents without one have no partner.  With k - 1 more shingles the prefixes share k of
them: k is a fifth of the smaller set, so that documents with many common phrases, of which
fewer are elsewhere, are left out as well.  Documents of one and the same set are one class
from here on.

Classes that share a prefix shingle are compared through its smallest class first.  Classes
found connected need no further comparison, so a group of thousands of near copies costs a
number of comparisons in proportion to its size.  Only the classes of shingles that still
lie in several components are compared with each other, block against block inside tasks, by
sizes, places in the order and sketches of 1,024 parities, each a bound on the overlap.  Of
the pairs that no bound rules out, the lightest forest by sketches leaves a block first: as
many pairs as join its components, fewer than it has classes.  Those that hold contract the
components; all pairs that then still lie in two components leave their blocks and are
compared.  Nothing is capped; the frequent shingles only choose the order.

Comparisons of one class with many run over a trie of their ordered sets, held as sorted sets
with the length of the prefix that neighbours share: overlaps of a shared prefix are counted
once, and a subtree ends where the overlap so far and the lengths left cannot reach what is
needed.

Shingles are 58-bit hashes; a collision inside one pair of sets of 500 shingles has a
probability of 10^-12.

Defined results: words are lower-cased in A-Z only; a text of fewer words than a shingle is
one shingle; a null text or one without words has an empty set and is linked with nothing;
repeated rows are copies of each other; documents of null id are grouped, and take part in
no minimum.  An empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.durable import written
from .graph import components
from .places import discard, with_place
from .repeats import mark, shared_keys
from .words import LOWER, hash_spans, mixed, rolling, row_of, slices, text_buffer, word_spans

FREQUENT = 1 << 16
LOCAL_COUNT, LOCAL_KEYS = 4, 1 << 20
CLASS_SHIFT = np.uint64(58)
EXTRA = 5
PARTNERS_PER_TASK = 256
SKETCH_BITS = 1024
CLASSES_PER_BLOCK = 1024
PAIRS_AT_ONCE = 1 << 16


def shingle_sets(text: pa.Array, width: int, frequent: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ordered distinct shingles of all rows, one row after another, and n + 1 bounds.

    A shingle is the class of its frequency (0 for all but the frequent ones) above 58 bits
    of hash, so that sets sort by the global order.
    """
    raw, offsets = text_buffer(text)
    out, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in slices(offsets):
        part, own = LOWER[raw[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
        starts, lengths, firsts = word_spans(part, own)
        h = hash_spans(part, starts, lengths)
        count = np.diff(firsts)
        row = row_of(firsts)
        rolled = rolling(h, width)
        inside = row[: len(rolled)] == row[width - 1 :] if len(rolled) else np.zeros(0, bool)
        keys, rows = [mixed(rolled[inside])], [row[: len(rolled)][inside]]
        for n in range(1, width):
            short = np.flatnonzero(count == n)
            if len(short):
                whole = rolling(h, n)[firsts[short]] + np.uint64(n)
                keys.append(mixed(whole))
                rows.append(short)
        key, r = np.concatenate(keys) >> np.uint64(6), np.concatenate(rows)
        if frequent is not None and len(frequent[0]):
            at = np.minimum(np.searchsorted(frequent[0], key), len(frequent[0]) - 1)
            key = key | np.where(frequent[0][at] == key, frequent[1][at], np.uint64(0))
        order = np.argsort(key)
        order = order[np.argsort(r[order], kind="stable")]
        key, r = key[order], r[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (r[1:] != r[:-1])] if len(key) else np.zeros(0, bool)
        out.append(key[new])
        sizes.append(np.bincount(r[new], minlength=b - a))
    return np.concatenate(out), np.r_[0, np.cumsum(np.concatenate(sizes))].astype(np.int64)


def frequent_shingles(placed: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """At most 65,536 shingles of the most documents, with their class: an order, not a filter.

    A task counts its shingles some millions at a time and reports those in four or more documents.
    """

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.sort(np.concatenate(held))
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        counts = np.diff(np.r_[starts, len(keys)])
        many = counts >= LOCAL_COUNT
        return pa.RecordBatch.from_arrays([pa.array(keys[starts[many]].astype(np.int64)), pa.array(counts[many])], names=["key", "docs"])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.uint64)]
        for batch in batches:
            held.append(shingle_sets(batch.column("text"), width)[0])
            if sum(map(len, held)) >= LOCAL_KEYS:
                yield counted(held)
                held = held[:1]
        yield counted(held)

    top = (
        placed.select("text").mapInArrow(local, "key bigint, docs bigint")
        .groupBy("key").agg(F.sum("docs").alias("docs"))
        .orderBy(F.desc("docs"), "key").limit(FREQUENT).collect()
    )
    key = np.array([r[0] for r in top], np.uint64)
    level = np.array([int(r[1]).bit_length() for r in top], np.uint64) << CLASS_SHIFT
    order = np.argsort(key)
    return key[order], level[order]


def _needed(a: int, b: int, num: int, den: int) -> int:
    """Least overlap of sets of these sizes with den * overlap >= num * union."""
    return -(-num * (a + b) // (num + den))


def probe(owner: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> list[int]:
    """Which ordered sets are similar enough to ``owner``, by a walk over their trie."""
    order = sorted(range(len(sets)), key=lambda k: sets[k].astype(">u8").tobytes())
    found, before, count, stop = [], np.zeros(0, np.uint64), np.zeros(1, np.int64), None
    for k in order:
        own = sets[k]
        m = min(len(own), len(before))
        differs = own[:m] != before[:m]
        shared = int(np.argmax(differs)) if differs.any() else m
        need = _needed(len(owner), len(own), num, den)
        if stop is not None and shared >= stop:
            # still below the node where the last set ended: the same bound, for this length
            left = min(len(own) - stop, len(owner) - int(np.searchsorted(owner, own[stop - 1], "right")))
            if count[stop] + left < need:
                continue
        known = min(shared, len(count) - 1)
        at = np.searchsorted(owner, own[known:])
        hit = at < len(owner)
        hit[hit] = owner[at[hit]] == own[known:][hit]
        count = np.r_[count[: known + 1], count[known] + np.cumsum(hit)]
        depth = np.arange(known + 1, len(own) + 1)
        bound = count[known + 1 :] + np.minimum(len(own) - depth, len(owner) - at - hit)
        short = np.flatnonzero(bound < need)
        stop = int(depth[short[0]]) if len(short) else None
        before = own
        if stop is None and count[len(own)] >= need:
            found.append(k)
    return found


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs ``a, b`` whose sets are similar enough.

    The partners of a class are dealt in groups of about 256, so a class with many partners
    is compared in many tasks.
    """
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS_PER_TASK).alias("groups"))
    dealt = pairs.join(counts, "a").withColumn("salt", F.pmod(F.xxhash64("b"), "groups"))
    partners = dealt.join(sets.select(F.col("set").alias("b"), "shingles"), "b").select("a", "salt", "b", "shingles")
    owners = (
        counts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("groups") - 1)))
        .join(sets.select(F.col("set").alias("a"), "shingles"), "a")
        .select(F.col("a").alias("owner"), F.col("salt").alias("part"), F.col("shingles").alias("owned"))
    )

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        owner = np.frombuffer(left.column("owned")[0].as_buffer(), np.uint64)
        held = [np.frombuffer(x.as_buffer(), np.uint64) for x in right.column("shingles")]
        names = right.column("b").take(pa.array(probe(owner, held, num, den), pa.int64()))
        return pa.table({"a": pa.array([left.column("owner")[0].as_py()] * len(names), pa.int64()), "b": names})

    return owners.groupBy("owner", "part").cogroup(partners.groupBy("a", "salt")).applyInArrow(compare, "a bigint, b bigint")


def sketch(keys: np.ndarray) -> np.ndarray:
    """Parities of the numbers of shingles in 1,024 buckets, as 16 words.

    Two sets differ in at least as many shingles as their sketches in bits.
    """
    odd = np.bincount((keys & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def near(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs ``a, b`` but for those whose sketches differ too much."""
    ends = {x: sets.select(F.col("set").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}")) for x in "ab"}
    differ = F.aggregate(
        F.zip_with("s_a", "s_b", lambda p, q: F.bit_count(p.bitwiseXOR(q)).cast("bigint")), F.lit(0).cast("bigint"), lambda x, y: x + y
    )
    both = F.col("n_a") + F.col("n_b")
    return pairs.join(ends["a"], "a").join(ends["b"], "b").filter((both - differ) * (num + den) >= both * 2 * num).select("a", "b")


def lightest_forest(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Edges of a lightest spanning forest: each component takes its lightest edge, round by round."""
    order = np.argsort(weight, kind="stable")
    nodes, ends = np.unique(np.concatenate([a, b])[np.r_[order, order + len(a)]], return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    edge, taken = np.arange(len(a)), [np.zeros(0, np.int64)]
    while len(edge):
        best = np.full(len(nodes), len(a))
        np.minimum.at(best, x, edge)
        np.minimum.at(best, y, edge)
        has = np.flatnonzero(best < len(a))
        taken.append(np.unique(best[has]))
        at = np.searchsorted(edge, best[has])
        parent = np.arange(len(nodes))
        parent[has] = np.where(x[at] == has, y[at], x[at])
        # edges are of different rank, so two components at most take the same one and no other ring can be
        both = parent[parent] == np.arange(len(nodes))
        parent = np.where(both & (np.arange(len(nodes)) < parent), np.arange(len(nodes)), parent)
        while (parent != parent[parent]).any():
            parent = parent[parent]
        x, y = parent[x], parent[y]
        open_ = x != y
        x, y, edge = x[open_], y[open_], edge[open_]
    return order[np.concatenate(taken)]


def across(side: DataFrame, num: int, den: int, forest: bool = False) -> DataFrame:
    """Pairs ``a, b`` of classes that share a shingle, lie in different components and are not
    ruled out by sizes, places in their orders or sketches; with ``forest`` only the lightest
    of each block that join its components.

    The classes of a shingle are dealt in blocks of about 1,024 and blocks compared inside
    tasks, so what leaves a task are the pairs that are left, not all pairs.
    """
    blocks = F.ceil(F.col("classes") / CLASSES_PER_BLOCK)
    dealt = (
        side.withColumn("own", F.pmod(F.xxhash64("set"), blocks))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
        .select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "set", "n", "at", "least", "root", "sketch")
    )
    names = ["token", "i", "j", "own", "set", "n", "at", "least", "root"]

    def compared(cols: dict[str, np.ndarray], sketches: np.ndarray, a: int, b: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        c = {k: v[a:b] for k, v in cols.items()}
        halves, words = c["i"][0] != c["j"][0], sketches[a:b]
        left = c["n"] - c["at"]
        step = max(1, PAIRS_AT_ONCE // (b - a))
        for k in range(0, b - a, step):
            x = slice(k, k + step)
            n_x, n_y = c["n"][x, None], c["n"][None]
            ok = (c["set"][x, None] < c["set"][None]) & (c["root"][x, None] != c["root"][None]) & (c["set"] != c["least"])[x, None]
            ok &= np.minimum(n_x, n_y) * den >= np.maximum(n_x, n_y) * num
            overlap = np.minimum(c["at"][x, None], c["at"][None]) + np.minimum(left[x, None], left[None])
            ok &= overlap * (num + den) >= (n_x + n_y) * num
            if halves:
                ok &= c["own"][x, None] != c["own"][None]
            p, q = np.nonzero(ok)
            p += k
            differ = np.bitwise_count((words[p] ^ words[q]).view(np.uint64)).sum(axis=1, dtype=np.int64)
            both = c["n"][p] + c["n"][q]
            rest = (both - differ) * (num + den) >= both * 2 * num
            if not forest:
                yield c["set"][p[rest]], c["set"][q[rest]]
                continue
            # the forest of a forest and further edges is that of all edges
            held = [np.r_[v, w] for v, w in zip(held, (p[rest], q[rest], (differ / both)[rest]), strict=True)]
            chosen = lightest_forest(c["root"][held[0]], c["root"][held[1]], held[2])
            held = [v[chosen] for v in held]
        if forest:
            yield c["set"][held[0]], c["set"][held[1]]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = {k: np.zeros(0, np.int64) for k in names}
        sketches = np.zeros((0, SKETCH_BITS // 64), np.int64)

        def done(bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                for x, y in compared(cols, sketches, a, b):
                    if len(x):
                        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

        for batch in batches:
            cols = {k: np.r_[v, batch.column(k).to_numpy()] for k, v in cols.items()}
            sketches = np.r_[sketches, batch.column("sketch").flatten().to_numpy().reshape(-1, SKETCH_BITS // 64)]
            new = (cols["token"][1:] != cols["token"][:-1]) | (cols["i"][1:] != cols["i"][:-1]) | (cols["j"][1:] != cols["j"][:-1])
            # the last block may go on in the next batch
            bounds = np.r_[0, np.flatnonzero(new) + 1] if len(cols["token"]) else np.zeros(1, np.int64)
            yield from done(bounds)
            cols, sketches = {k: v[bounds[-1] :] for k, v in cols.items()}, sketches[bounds[-1] :]
        if len(sketches):
            yield from done(np.array([0, len(sketches)]))

    return dealt.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(compare, "a bigint, b bigint")


def links(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Linked pairs of classes that connect all classes linked directly or not."""
    posting = sets.select("set", "n", F.posexplode("rare").alias("at", "token"))
    fits = F.least("n", "n_a") * den >= F.greatest("n", "n_a") * num
    tokens = posting.groupBy("token").agg(
        F.min("set").alias("a"), F.max("set").alias("z"), F.min_by("n", "set").alias("n_a"), F.count("*").alias("classes")
    ).filter("a <> z")
    stars = posting.join(tokens, "token").filter((F.col("set") != F.col("a")) & fits)
    stars = near(written(stars.select("a", F.col("set").alias("b")).distinct()), sets, num, den)
    first = written(verified(written(stars), sets, num, den))
    groups = components(first, "a", "b")

    # shingles of three classes or more that lie in several components: block against block
    for forest in (True, False):
        side = open_sides(posting, tokens, groups, sets)
        more = verified(written(across(side, num, den, forest).distinct()), sets, num, den)
        first = written(first.unionByName(more))
        if forest:
            groups = components(first, "a", "b")
    return first


def open_sides(posting: DataFrame, tokens: DataFrame, groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Postings of the shingles whose classes lie in several components."""
    root = F.coalesce("root", "set").alias("root")
    placed = (
        posting.join(tokens.filter("classes > 2").select("token", F.col("a").alias("least"), "classes"), "token")
        .join(groups.withColumnRenamed("node", "set"), "set", "left").select("token", "set", "n", "at", "least", "classes", root)
    )
    open_tokens = placed.groupBy("token").agg(F.min("root").alias("r"), F.max("root").alias("s")).filter("r <> s")
    return placed.join(open_tokens.select("token"), "token").join(sets.select("set", "sketch"), "set")


def jaccard_groups(documents: DataFrame, width: int, num: int, den: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, class_id`` (same for equal sets, null for
    empty ones), ``group_id`` (of all that links reach, null likewise) and its place ``_file, _row``.

    Documents link when den * intersection >= num * union.
    """
    placed = with_place(documents, doc_id=id_column, text=text_column)
    size = placed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    frequent = placed.sparkSession.sparkContext.broadcast(frequent_shingles(placed, width))

    def prefixes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        keys, bounds = shingle_sets(text, width, frequent.value)
        n = np.diff(bounds)
        length = n - -(-num * n // den) + 1
        length = np.minimum(length + np.maximum(n // EXTRA, 1) - 1, n)
        length[n == 0] = 0
        row = np.repeat(np.arange(len(n)), length)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
        return keys[bounds[row] + inside], row

    answers = shared_keys(placed, prefixes, int(size * ((den - num) / den + 1 / EXTRA)) // 5)
    kind = placed.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, _file bigint, _row bigint, n_shingles bigint, class_id string, rare array<bigint>, sketch array<bigint>, shingles binary"

    def describe(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("_row").combine_chunks()
        text = pa.concat_arrays(left.column("text").chunks) if left.num_rows else pa.array([], pa.string())
        keys, bounds = shingle_sets(text, width, frequent.value)
        token, row, hit = mark(text, left.column("_row").to_numpy(), right, prefixes)
        ends = np.searchsorted(row, np.arange(len(text) + 1))
        spot = np.arange(len(row)) - ends[row]
        sigs, rare, sketches, blobs = [], [], [], []
        for k in range(len(text)):
            own = keys[bounds[k] : bounds[k + 1]]
            sigs.append(hashlib.blake2b(own.tobytes(), digest_size=16).hexdigest() if len(own) else None)
            mine = np.flatnonzero(hit[ends[k] : ends[k + 1]]) + ends[k]
            some = token[mine]
            # the smaller set of a pair may have fewer shingles by the threshold
            enough = len(some) >= max(1, -(-num * len(own) // den) // EXTRA)
            # the plain prefix is all that pairs are made from
            some = some[: int(np.searchsorted(spot[mine], len(own) - -(-num * len(own) // den), "right"))]
            rare.append(some.astype(np.int64) if enough else None)
            sketches.append(sketch(own) if enough else None)
            blobs.append(own.tobytes() if enough else None)
        return pa.table({
            "doc_id": left.column("doc_id"), "_file": left.column("_file"), "_row": left.column("_row"),
            "n_shingles": pa.array(np.diff(bounds)), "class_id": pa.array(sigs, pa.string()),
            "rare": pa.array(rare, pa.list_(pa.int64())),
            "sketch": pa.array(sketches, pa.list_(pa.int64())), "shingles": pa.array(blobs, pa.binary()),
        })

    place = ["_file", "_part"]
    rows = written(placed.groupBy(*place).cogroup(answers.groupBy(*place)).applyInArrow(describe, schema))
    sets = written(
        rows.filter("rare IS NOT NULL").groupBy(F.col("class_id").alias("sig"))
        .agg(F.first("n_shingles").alias("n"), F.first("rare").alias("rare"), F.first("sketch").alias("sketch"), F.first("shingles").alias("shingles"))
        .withColumn("set", F.monotonically_increasing_id())
    )
    slim = written(rows.select("doc_id", "_file", "_row", "n_shingles", "class_id"))
    discard(rows)
    name = sets.select("set", "sig")
    groups = components(links(sets, num, den), "a", "b")
    groups = groups.join(name.select(F.col("set").alias("node"), F.col("sig").alias("class_id")), "node")
    groups = written(groups.join(name.select(F.col("set").alias("root"), F.col("sig").alias("group_id")), "root").select("class_id", "group_id"))
    discard(sets)
    return (
        slim.join(groups, "class_id", "left")
        .select("doc_id", "_file", "_row", "n_shingles", "class_id", F.coalesce("group_id", "class_id").alias("group_id"))
    )


def op8_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Three-word shingles of all documents, linked from a similarity of 0.9."""
    rows = jaccard_groups(spark.read.parquet(f"{folder}/documents.parquet"), 3, 90, 100)
    rows = written(rows.select("doc_id", "n_shingles", "group_id"))
    least = rows.filter("group_id IS NOT NULL").groupBy("group_id").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "group_id", "left").select(
        "doc_id", "n_shingles", F.when(F.col("group_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )
