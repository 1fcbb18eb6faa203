"""Embedding near-duplicates by dual traversal of cover trees, exactly.

Vectors of length one are compared by their distance, sqrt(2 - 2 cos).  The top of the tree is
a bounded sample of vectors (a sample is no limit: every vector hangs below its nearest one),
whose cells are spread over tasks as chunks of about 4,096 vectors.  Below, each chunk builds
its part of the tree, with covering radii halving by level from the largest of 1, 1/2, 1/4, ...
within the threshold: nodes that are wider can hardly be left out, as no two centres are more
than 2 apart, and would only be opened.  Two nodes can be left out
when the distance of their centres less both covering radii is above the threshold, and taken
whole when the distance plus both radii is within it; only others go down a level.  Chunks
whose cells are too far apart never meet.

Each tree is stored once.  A task compares the trees of two parts of that table, which it reads
itself, so no tree is shuffled and the disk grows with the vectors, not with the pairs of trees.

Equal vectors are one vector with a count.  A cell whose radius is within half the threshold
needs no comparison inside.  So large groups of copies cost what they hold, not its square.
Tasks send links as counts and as a tree over the linked vectors, never as all pairs.

Defined results: vectors that are null, empty or zero, or hold null or a non-finite component,
link with nothing, nor do vectors of different lengths; repeated rows link with each other;
rows without ``vec_id`` count as links but in no minimum, and an unlinked one has a null
component and is not kept; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from contextlib import contextmanager
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.durable import discard, written
from .graph import components

TOP_NODES = 1024
CHUNK_VECTORS = 4096
LEVELS = 4
STRIP = 256
#: Bytes of trees that a comparing task keeps to meet them again.
KEPT_BYTES = 64 << 20
#: Vectors and edges whose sums it holds before it sends them.
HELD_VECTORS = 1 << 20
#: Numbers in the vectors that are multiplied pair by pair at a time.
PAIR_VALUES = 1 << 22
#: Nodes linked whole are told as pairs of points up to so many.
FEW_PAIRS = 16
#: Tasks that compare, at most.
PAIR_TASKS = 1024
#: A vector's number has its tree's number above these bits and its place in the tree below.
POSITION_BITS = 32
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Classes of radii up to the threshold.
RADII = 4
MARGIN = 1e-9


def raw(column: pa.Array) -> np.ndarray:
    """Vectors (all of one length) as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors (all of one length) as rows of length one."""
    return unit(raw(column))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one."""
    x = x.astype(float)
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Tree:
    """A cover tree in arrays.  Points are reordered so that each node holds a range of them;
    ``first[l]`` has the nodes' first points (and the end) on level l, ``radius[l]`` the largest
    distance from a node's centre, its first point, to a point below it, ``child[l]`` the first
    node below on the next level.  The last level are the points."""

    def __init__(self, x: np.ndarray, top: float = 1.0, levels: int = LEVELS):
        order = np.arange(len(x))
        bounds = [np.array([0, len(x)])]
        for level in range(levels):
            least = 1 - (top * 0.5**level) ** 2 / 2
            new = []
            for a, b in zip(bounds[-1][:-1].tolist(), bounds[-1][1:].tolist(), strict=True):
                rest, at = order[a:b].copy(), a
                while len(rest):
                    # the next centres are among the first points left: a strip of them against all
                    points = x[rest]
                    near = points[:STRIP] @ points.T >= least
                    free = np.ones(len(rest), bool)
                    for k in range(len(near)):
                        if free[k]:
                            mine = near[k] & free
                            mine[k] = True
                            found = rest[mine]
                            new.append(at)
                            order[at : at + len(found)] = found
                            at += len(found)
                            free[mine] = False
                    rest = rest[free]
            bounds.append(np.array([*new, len(x)]))
        self.order = order
        self.points = x[order]
        self.first = [*bounds[1:], np.arange(len(x) + 1)]
        self.measure()

    def measure(self) -> None:
        """Children and radii, from the points and the nodes' first points."""
        self.centres = self.points[self.first[0][:-1]].astype(np.float32)
        self.child = [np.searchsorted(low[:-1], up) for up, low in zip(self.first[:-1], self.first[1:], strict=True)]
        self.radius = []
        for first in self.first[:-1]:
            # a node of one point has radius 0
            size = np.diff(first)
            several = np.repeat(size > 1, size)
            gap = np.zeros(len(self.points))
            centre = np.repeat(first[:-1], size)[several]
            gap[several] = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", self.points[several], self.points[centre])))
            self.radius.append(np.maximum.reduceat(gap, first[:-1]) if len(size) else gap)
        self.radius.append(np.zeros(len(self.points)))


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[k], start[k] + 1, ... count[k] numbers for each k."""
    return np.arange(count.sum()) + np.repeat(start - (np.cumsum(count) - count), count)


def met(a: Tree, b: Tree, limit: float):
    """Yields the nodes of the first levels that may hold linked points, some strips at a time.

    Nodes of like radii share one bound, and dot products are taken in single precision; both
    only let more through, never less."""
    x, y = a.centres, b.centres
    # what rounding may take off a product of two vectors of length one
    slack = MARGIN + (x.shape[1] + 16) * 2.0**-23
    step_a, step_b = (np.ceil(t.radius[0] / limit * RADII if limit else t.radius[0] > 0).astype(int) for t in (a, b))
    for k in np.unique(step_b).tolist():
        columns = np.flatnonzero(step_b == k)
        other = np.ascontiguousarray(y[columns].T)
        for m in np.unique(step_a).tolist():
            rows = np.flatnonzero(step_a == m)
            wide = limit + a.radius[0][rows].max() + b.radius[0][columns].max()
            least = np.float32(_least_dot(wide) - slack)
            for low in range(0, len(rows), STRIP):
                strip = rows[low : low + STRIP]
                i, j = np.divmod(np.flatnonzero(x[strip] @ other >= least), len(columns))
                yield strip[i], columns[j]


def dual(a: Tree, b: Tree, cosine: float, same: bool):
    """Yields links of two trees, a bounded number at a time: (points of a, points of b) one by
    one, and pairs of ranges linked whole."""
    limit = np.sqrt(2 - 2 * cosine)
    room = max(1, PAIR_VALUES // a.points.shape[1])
    last = len(a.first) - 1
    for nodes, others in met(a, b, limit):
        # on a level: nodes of a, each with a range of nodes of b; the deepest come first
        work = [(0, nodes, others, np.ones(len(nodes), int))]
        while work:
            level, i, j, count = work.pop()
            now = max(1, int(np.searchsorted(np.cumsum(count), room, "right")))
            if now < len(i):
                work.append((level, i[now:], j[now:], count[now:]))
            i, j = np.repeat(i[:now], count[:now]), spread(j[:now], count[:now])
            fa, fb = a.first[level], b.first[level]
            if same:
                keep = i < j if level == last else i <= j
                i, j = i[keep], j[keep]
            dot_ij = np.einsum("ij,ij->i", a.points[fa[i]], b.points[fb[j]])
            if level == last:
                hit = dot_ij >= cosine
                yield i[hit], j[hit], []
                continue
            gap = np.sqrt(np.maximum(0, 2 - 2 * dot_ij))
            ra, rb = a.radius[level][i], b.radius[level][j]
            near = gap - ra - rb <= limit + MARGIN
            full = near & (gap + ra + rb <= limit - MARGIN) & ~((i == j) if same else np.zeros(len(i), bool))
            if full.any():
                p, q = i[full], j[full]
                na, nb = fa[p + 1] - fa[p], fb[q + 1] - fb[q]
                few = na * nb <= FEW_PAIRS
                left, times = spread(fa[p[few]], na[few]), np.repeat(nb[few], na[few])
                yield (
                    np.repeat(left, times), spread(np.repeat(fb[q[few]], na[few]), times),
                    [(fa[c], fa[c + 1], fb[d], fb[d + 1]) for c, d in zip(p[~few].tolist(), q[~few].tolist(), strict=True)],
                )
            i, j = i[near & ~full], j[near & ~full]
            if len(i):
                ca, cb = a.child[level], b.child[level]
                na, nb = ca[i + 1] - ca[i], cb[j + 1] - cb[j]
                work.append((level + 1, spread(ca[i], na), np.repeat(cb[j], na), np.repeat(nb, na)))


def first_reach(limit: float) -> float:
    """The covering radius of the first level: the largest 1, 1/2, 1/4, ... within the threshold."""
    return 0.5 ** min(30, np.ceil(-np.log2(limit))) if 0 < limit < 1 else 1.0


def _least_dot(distance: np.ndarray) -> np.ndarray:
    """Dot product of unit vectors at a distance (at most 2)."""
    return 1 - np.minimum(distance, 2) ** 2 / 2


def summed(a: Tree, b: Tree, count_a: np.ndarray, count_b: np.ndarray, cosine: float, same: bool):
    """Per point of a then b (a alone if the same): weighted number of links, and a label that
    linked points share."""
    shift = 0 if same else len(a.points)
    counts = count_a if same else np.r_[count_a, count_b]
    n = len(counts)
    links, label = np.zeros(n), np.arange(n)
    for x, y, whole in dual(a, b, cosine, same):
        if not len(x) and not whole:
            continue
        links += np.bincount(x, weights=counts[y + shift], minlength=n) + np.bincount(y + shift, weights=counts[x], minlength=n)
        heads, tails = [x], [y + shift]
        for a0, a1, b0, b1 in whole:
            links[a0:a1] += count_b[b0:b1].sum()
            links[b0 + shift : b1 + shift] += count_a[a0:a1].sum()
            heads += [np.full(b1 - b0, a0), np.arange(a0, a1)]
            tails += [np.arange(b0, b1) + shift, np.full(a1 - a0, b0 + shift)]
        label = tied(label, np.concatenate(heads), np.concatenate(tails))
    return links.astype(np.int64), label


def tied(label: np.ndarray, head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Labels (the least point of a part) when further points are linked."""
    head, tail = label[head], label[tail]
    apart = head != tail
    head, tail = head[apart], tail[apart]
    least = np.arange(len(label))
    while len(head):
        low = np.minimum(least[head], least[tail])
        new = least.copy()
        np.minimum.at(new, head, low)
        np.minimum.at(new, tail, low)
        new = new[new]
        if (new == least).all():
            break
        least = new
    return least[label]


class Sums:
    """Links found by a task, summed a vector, and edges that connect what they link."""

    def __init__(self):
        self.links: dict[int, np.ndarray] = {}
        # a vector that each one is connected with: at first itself, later the least that was met
        self.root: dict[int, np.ndarray] = {}
        self.edges: list[np.ndarray] = []
        self.held = 0

    def add(self, chunks: list[int], links: np.ndarray, label: np.ndarray, cut: int) -> None:
        """Links and labels of the vectors of one tree or two, the first of which holds ``cut``."""
        if not links.any():
            return
        ranges = dict(zip(chunks, (slice(0, cut), slice(cut, len(links))), strict=False))
        number = np.concatenate([(c << POSITION_BITS) + np.arange(r.stop - r.start) for c, r in ranges.items()])
        old = np.concatenate([self.root.get(c, number[r]) for c, r in ranges.items()])
        least = old.copy()
        np.minimum.at(least, label, old)
        new = least[label]
        # what leaves its root ties that one to the next; its own edge leads to the last
        moved = (new != old) & (old != number)
        self.edges.append(np.unique(np.stack([old[moved], new[moved]], axis=1), axis=0))
        self.held += len(self.edges[-1])
        for c, r in ranges.items():
            if c not in self.links:
                self.links[c] = np.zeros(r.stop - r.start, np.int64)
                self.held += r.stop - r.start
            self.links[c] += links[r]
            self.root[c] = new[r]

    def out(self) -> Iterator[pa.RecordBatch]:
        """Rows ``id, links, root`` of all so far, which is then forgotten."""
        names = ["id", "links", "root"]
        for chunk, links in self.links.items():
            at = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array((chunk << POSITION_BITS) + at), pa.array(links[at]), pa.array(self.root[chunk][at])], names=names)
        if self.edges:
            edges = np.concatenate(self.edges)
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(np.zeros(len(edges), np.int64)), pa.array(edges[:, 1])], names=names)
        self.__init__()


def keyed(column: pa.Array) -> list[bytes | None]:
    """16 bytes a vector, the same for equal ones; null for a vector that links with nothing."""
    size = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    keys: list[bytes | None] = [None] * len(column)
    for d in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero(size == d)
        # nulls become NaN, and -0.0 becomes 0.0
        x = raw(column.take(pa.array(at))) + 0.0
        at = at[good := np.isfinite(x).all(axis=1) & x.any(axis=1)]
        whole, step = x[good].tobytes(), d * x.itemsize
        for k, i in enumerate(at.tolist()):
            keys[i] = blake2b(whole[k * step : (k + 1) * step], digest_size=16).digest()
    return keys


def least_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vectors with the least keys of a task, TOP_NODES different ones at most."""
    least: dict[bytes, list[float]] = {}
    for batch in batches:
        column = batch.column("embedding")
        new = {key: k for k, key in enumerate(keyed(column)) if key is not None}
        least = {key: least[key] if key in least else column[new[key]].as_py() for key in heapq.nsmallest(TOP_NODES, least.keys() | new.keys())}
        kind = column.type
    if least:
        yield pa.RecordBatch.from_arrays([pa.array(least.keys(), pa.binary()), pa.array(least.values(), kind)], names=["key", "embedding"])


def sample(rows: DataFrame) -> dict[int, np.ndarray]:
    """The top of the tree by dimension: vectors with the least keys, at most TOP_NODES and
    about the root of the number of different vectors, which the greatest of the keys shows."""
    kind = rows.schema["embedding"].dataType.simpleString()
    least = rows.select("embedding").mapInArrow(least_keys, f"key binary, embedding {kind}")
    top = least.groupBy("key").agg(F.first("embedding").alias("embedding")).orderBy("key").limit(TOP_NODES).collect()
    different = len(top) if len(top) < TOP_NODES else TOP_NODES * 2**128 / (int.from_bytes(top[-1].key) + 1)
    heads: dict[int, list] = {}
    for r in top[: max(1, int(np.sqrt(different)))]:
        heads.setdefault(len(r.embedding), []).append(r.embedding)
    return {d: matrix(pa.array(x, pa.list_(pa.float64()))) for d, x in heads.items()}


def near_groups(groups: list[dict], tight: list[bool], heads: dict[int, np.ndarray], limit: float) -> list[list[int]]:
    """For each group of cells the groups it has to be compared with."""
    near = np.zeros((len(groups), len(groups)), bool)
    for d in {g["dim"] for g in groups}:
        at = [k for k, g in enumerate(groups) if g["dim"] == d]
        near[np.ix_(at, at)] = True
        if d in heads:
            cells, far = (np.concatenate([groups[k][c] for k in at]) for c in ("cells", "far"))
            m = heads[d][cells.astype(int)]
            gap = np.sqrt(np.maximum(0, 2 - 2 * m @ m.T))
            first = np.cumsum([0, *(len(groups[k]["cells"]) for k in at[:-1])])
            close = gap - far[:, None] - far[None, :] <= limit + MARGIN
            near[np.ix_(at, at)] = np.logical_or.reduceat(np.logical_or.reduceat(close, first, axis=0), first, axis=1)
    near[np.arange(len(groups)), np.arange(len(groups))] &= ~np.array(tight, bool)
    return [np.flatnonzero(x).tolist() for x in near]


def near_duplicates(vectors: DataFrame, cosine: float = 0.9) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row."""
    spark = vectors.sparkSession
    limit = float(np.sqrt(2 - 2 * cosine))
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select("vec_id", F.col("embedding").cast(kind).alias("embedding"))
    heads = sample(rows)
    shared = spark.sparkContext.broadcast(heads)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            keys = keyed(column)
            # the first of the equal vectors of a batch stands for all
            first = {key: k for k, key in reversed([*enumerate(keys)]) if key is not None}
            copies = np.zeros(len(keys), np.int64)
            np.add.at(copies, [first[key] for key in keys if key is not None], 1)
            one = copies > 0
            dims = np.where(one, pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int32)
            cell, far = np.zeros(len(dims), np.int64), np.full(len(dims), 2.0)
            for d in np.unique(dims).tolist():
                if d in shared.value:
                    at = np.flatnonzero(dims == d)
                    dot = matrix(column.take(pa.array(at))) @ shared.value[d].T
                    cell[at] = dot.argmax(axis=1)
                    far[at] = np.sqrt(np.maximum(0, 2 - 2 * dot.max(axis=1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(copies), column.take(pa.array(np.arange(len(keys)), mask=~one)), pa.array(dims), pa.array(cell), pa.array(far)],
                names=["vec_id", "key", "copies", "embedding", "dim", "cell", "far"],
            )

    id_kind = vectors.schema["vec_id"].dataType.simpleString()
    placed = written(rows.mapInArrow(assign, f"vec_id {id_kind}, key binary, copies bigint, embedding {kind}, dim int, cell bigint, far double"))
    # at most TOP_NODES cells for a dimension of the top, one for each other dimension
    cells = placed.filter("copies > 0").groupBy("dim", "cell").agg(F.count("*"), F.max("far")).orderBy("dim", "cell").collect()
    groups: list[dict] = []
    for d, c, n, far in cells:
        last = groups[-1] if groups else None
        if last is None or last["dim"] != d or last["n"] + n > CHUNK_VECTORS:
            groups.append({"dim": d, "n": 0, "cells": [], "far": []})
        groups[-1]["n"] += n
        groups[-1]["cells"].append(c)
        groups[-1]["far"].append(far)
    parts = [max(1, -(-g["n"] // CHUNK_VECTORS)) for g in groups]
    base = np.cumsum([0, *parts]).tolist()
    tight = [2 * g["far"][0] <= limit - MARGIN and len(g["cells"]) == 1 for g in groups]
    table = spark.createDataFrame(
        [(int(g["dim"]), int(c), k, base[k], parts[k]) for k, g in enumerate(groups) for c in g["cells"]],
        "dim int, cell bigint, grp int, base bigint, parts int",
    )
    # a row per group
    meet = spark.createDataFrame(
        [*zip(range(len(groups)), tight, near_groups(groups, tight, heads, limit), strict=True)], "grp int, tight boolean, partners array<int>"
    )
    # a row per cell
    located = placed.filter("copies > 0").join(F.broadcast(table), ["dim", "cell"]).select(
        (F.col("base") + F.pmod(F.xxhash64("key"), F.col("parts"))).alias("chunk"), "grp", "key", "copies", "embedding"
    )

    def build(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).sort_by("key").combine_chunks()
        keys = t.column("key").to_pylist()
        first = np.array([k for k in range(len(keys)) if not k or keys[k] != keys[k - 1]])
        points = pa.concat_arrays(t.column("embedding").chunks).take(pa.array(first))
        tree = Tree(matrix(points), first_reach(limit))
        copies = np.add.reduceat(t.column("copies").to_numpy(), first)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([key[0].as_py()]), pa.array([t.column("grp")[0].as_py()], pa.int32()),
                pa.array([[keys[k] for k in first[tree.order].tolist()]], pa.list_(pa.binary())), pa.array([copies[tree.order]], pa.list_(pa.int64())),
                pa.array([raw(points)[tree.order].tobytes()], pa.binary()), pa.array([[f.astype(np.int32).tobytes() for f in tree.first]], pa.list_(pa.binary())),
            ],
            names=["chunk", "grp", "keys", "copies", "points", "first"],
        )

    trees = written(
        located.groupBy("chunk").applyInArrow(build, "chunk bigint, grp int, keys array<binary>, copies array<bigint>, points binary, first array<binary>")
    )
    names = written(placed.select("vec_id", "key"))
    discard(placed)
    # every tree with every other: each task reads the stored trees of two scan tasks, so none is shuffled
    chunk, other = F.col("chunk"), F.col("chunk_2")
    side = trees.select("chunk", "grp", "copies", "points", "first")
    both = side.join(F.broadcast(meet), "grp").drop("tight").hint("shuffle_replicate_nl").join(
        side.select(*[F.col(c).alias(f"{c}_2") for c in side.columns]),
        F.array_contains("partners", F.col("grp_2")) & ((chunk == other) | ((chunk < other) == ((chunk + other) % 2 == 0))),
    )
    size = np.dtype(np.float32 if kind == "array<float>" else np.float64)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, Tree] = {}
        sums = Sums()
        a = at_a = None

        def tree(row: dict, chunk: int, end: str) -> Tree:
            if chunk not in kept:
                new = loaded(row[f"points{end}"], row[f"first{end}"], size)
                if sum(t.points.nbytes for t in kept.values()) + new.points.nbytes > KEPT_BYTES:
                    kept.clear()
                kept[chunk] = new
            return kept[chunk]

        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                p, q = row["chunk"].as_py(), row["chunk_2"].as_py()
                if p != at_a:
                    a, at_a = tree(row, p, ""), p
                b = a if p == q else tree(row, q, "_2")
                ca, cb = (row[c].values.to_numpy() for c in ("copies", "copies_2"))
                sums.add([p] if p == q else [p, q], *summed(a, b, ca, cb, cosine, p == q), len(ca))
                if sums.held > HELD_VECTORS:
                    yield from sums.out()
        yield from sums.out()

    with batches_of(spark, 1):
        found = written(both.drop("grp", "grp_2", "partners").coalesce(PAIR_TASKS).mapInArrow(compare, "id bigint, links bigint, root bigint"))
    classes = (
        trees.join(F.broadcast(meet), "grp").select("chunk", "grp", "tight", F.posexplode(F.arrays_zip("keys", "copies")))
        .select((F.shiftleft("chunk", POSITION_BITS) + F.col("pos")).alias("id"), "grp", "tight", "col.keys", "col.copies").withColumnRenamed("keys", "key")
    )
    inside = classes.filter("tight")
    balls = inside.groupBy("grp").agg(F.sum("copies").alias("all"), F.min("id").alias("root"))
    near = inside.join(F.broadcast(balls), "grp").select("id", (F.col("all") - F.col("copies")).alias("links"), "root")
    links = found.unionByName(near)
    linked = links.groupBy("id").agg(F.sum("links").alias("links"))
    groups_of = components(links, "id", "root")
    known = (
        classes.select("id", "key", "copies").join(linked, "id", "left").join(groups_of.withColumnRenamed("node", "id"), "id", "left")
        .select("key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("root", "id").alias("root"))
    )
    result = written(names.join(known, "key", "left").drop("key"))
    discard(trees, names, found)
    least = result.filter("root IS NOT NULL").groupBy("root").agg(F.min("vec_id").alias("component_id"))
    return result.join(least, "root", "left").select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(F.col("root").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows for what is written inside."""
    was = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH, was)


def loaded(points: pa.Scalar, first: pa.Scalar, kind: np.dtype) -> Tree:
    """A tree from its stored points and levels."""
    tree = Tree.__new__(Tree)
    tree.first = [np.frombuffer(f.as_buffer(), np.int32).astype(int) for f in first]
    tree.points = unit(np.frombuffer(points.as_buffer(), kind).reshape(tree.first[0][-1], -1))
    tree.measure()
    return tree


def op3_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """All embeddings, linked from a cosine of 0.9."""
    return near_duplicates(spark.read.parquet(f"{folder}/embeddings.parquet"), 0.9)
