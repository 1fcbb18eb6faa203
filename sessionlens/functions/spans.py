"""Spans of a text as column expressions: places of matches, containment, islands, splicing.

A span is a struct with ``a`` and ``b``, its first place and the one after its last.  All work
stays in the row.  Running sums and maxima go through chunks of ``CHUNK`` values, and text is
cut out of blocks of ``BLOCK`` characters, so the work is in proportion to spans and text but
for a fixed factor.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 256
BLOCK = 1 << 12


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda n, v: n + v)


def _largest(values: Column) -> Column:
    return F.coalesce(F.array_max(values), F.lit(-1).cast("bigint"))


def running(values: Column, largest: bool = False) -> Column:
    """Sum, or maximum, of all values before each one; 0, or -1, before the first."""
    fold = _largest if largest else _total
    join = (lambda x, y: F.greatest(x, y)) if largest else (lambda x, y: x + y)

    def inside(chunk: Column, base: Column) -> Column:
        return F.transform(chunk, lambda _, k: join(base, fold(F.slice(chunk, 1, k))))

    def carried(chunks: Column) -> Column:
        totals = F.transform(chunks, fold)
        bases = let(totals, lambda t: F.transform(t, lambda _, k: fold(F.slice(t, 1, k))))
        return F.flatten(F.zip_with(chunks, bases, inside))

    def chunked(held: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(held) - 1) / CHUNK).cast("int"))
        chunks = F.transform(starts, lambda k: F.slice(held, k * CHUNK + 1, CHUNK))
        none = F.array().cast("array<bigint>")
        return F.when(F.size(held) == 0, none).otherwise(let(chunks, carried))

    return let(values, chunked)


def match_starts(pieces: Column, matches: Column) -> Column:
    """First place of each match, from the text between matches and the matches."""
    steps = F.zip_with(pieces, matches, lambda p, m: (F.length(p) + F.coalesce(F.length(m), F.lit(0))).cast("bigint"))
    return let(running(steps), lambda before: F.transform(matches, lambda _, k: F.get(before, k) + F.length(F.get(pieces, k))))


def not_inside(spans: Column, holder: Callable[[Column], Column], held: Callable[[Column], Column]) -> Column:
    """Spans without those that are ``held`` and lie wholly inside a ``holder``.

    In order of their beginnings, holders first, a span lies in a holder if the largest end of
    the holders before it is not under its own.  Spans begin with ``a``.
    """
    def kept(ordered: Column) -> Column:
        ends = F.transform(ordered, lambda s: F.when(holder(s["span"]), s["span"]["b"]).otherwise(F.lit(-1).cast("bigint")))
        marked = F.zip_with(ordered, running(ends, largest=True), lambda s, top: F.struct(s["span"].alias("span"), top.alias("top")))
        free = F.filter(marked, lambda s: ~(held(s["span"]) & (s["top"] >= s["span"]["b"])))
        return F.transform(free, lambda s: s["span"])

    keyed = F.transform(spans, lambda s: F.struct(s["a"].alias("a"), F.when(holder(s), 0).otherwise(1).alias("side"), s.alias("span")))
    return F.when(F.exists(spans, holder), let(F.array_sort(keyed), kept)).otherwise(spans)


def firsts(spans: Column, same: Callable[[Column], Column], order: Callable[[Column], Column]) -> Column:
    """One span of each ``same`` value: the least by ``order``."""
    keyed = F.transform(spans, lambda s: F.struct(same(s).alias("same"), order(s).alias("order"), s.alias("span")))

    def distinct(held: Column) -> Column:
        again = lambda s, k: F.coalesce((k > 0) & (s["same"] == F.get(held, k - 1)["same"]), F.lit(False))
        numbered = F.transform(held, lambda s, k: F.struct(s["span"].alias("span"), again(s, k).alias("again")))
        fresh = F.filter(numbered, lambda s: ~s["again"])
        return F.transform(fresh, lambda s: s["span"])

    return let(F.array_sort(keyed), distinct)


def islands(spans: Column, order: Callable[[Column], Column]) -> Column:
    """Overlapping spans made one: the first span of each island as ``head``, its end ``stop``
    and whether it is ``merged`` of several.  Spans that only touch stay apart."""
    keyed = F.transform(spans, lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), order(s).alias("order"), s.alias("span")))

    def found(held: Column) -> Column:
        ends = F.transform(held, lambda s: s["b"])
        marked = F.zip_with(held, running(ends, largest=True), lambda s, top: F.struct(s.alias("s"), top.alias("top")))
        numbered = F.transform(marked, lambda m, k: F.struct(m["s"].alias("s"), m["top"].alias("top"), k.alias("k")))
        heads = F.filter(numbered, lambda m: m["s"]["a"] >= m["top"])

        def closed(each: Column) -> Column:
            def one(m: Column, k: Column) -> Column:
                after = F.get(each, k + 1)
                last = F.coalesce(after["k"], F.size(held))
                return F.struct(
                    m["s"]["span"].alias("head"), m["s"]["a"].alias("start"),
                    F.coalesce(after["top"], F.array_max(ends)).alias("stop"), (last - m["k"] > 1).alias("merged"),
                )

            return F.transform(each, one)

        return let(heads, closed)

    return let(F.array_sort(keyed), found)


def spliced(text: Column, parts: Column, shown: Callable[[Column], Column]) -> Column:
    """The text with each part (``start``, ``stop``, in order and apart) replaced."""
    def cut(blocks: Column, first: Column, last: Column) -> Column:
        at = F.floor(first / BLOCK).cast("int")
        upto = F.floor((last - 1) / BLOCK).cast("int")
        window = F.array_join(F.slice(blocks, at + 1, upto - at + 1), "")
        inside = F.substring(window, (first - at * BLOCK + 1).cast("int"), (last - first).cast("int"))
        return F.when(last > first, inside).otherwise("")

    def written(blocks: Column) -> Column:
        def piece(p: Column, k: Column) -> Column:
            before = F.coalesce(F.get(parts, k - 1)["stop"], F.lit(0))
            return F.concat(cut(blocks, F.when(k == 0, F.lit(0)).otherwise(before), p["start"]), shown(p))

        tail = cut(blocks, F.element_at(parts, -1)["stop"], F.length(text).cast("bigint"))
        return F.concat(F.array_join(F.transform(parts, piece), ""), tail)

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return F.when(F.size(parts) == 0, text).otherwise(let(blocks, written))
