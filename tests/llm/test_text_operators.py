"""Fill-in-middle, benchmark decontamination and spelling variants against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sessionlens.llm.decontaminate import benchmark_hits
from sessionlens.llm.fill_middle import draws, fill_in_middle, restored
from sessionlens.llm.fm_index import FMIndex
from sessionlens.llm.queries import QUERIES
from sessionlens.llm.spelling import spelling_variants
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
CLASHING = "doc_id bigint, text string, n bigint, form string, word string, hits int, _file string, _row int, h string, key string"


def table(spark, texts):
    rows = [(k if k != 3 else None, t, 1, "f", "w", 2, "x", 3, "h", "k") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[-1:], CLASHING)


# ---- fill in the middle ------------------------------------------------------------------

LINES = [
    None, "", "\n", "\n\n\n", "one", "one\n", "one\ntwo", "a\r\nb\r\n\nc", "x <P> y\nz", "<\nP>\nS><S\n<M\n>", "$1\\$2\n{3}\n(?s)\n",
    "é\n𝄞𝄞\nñ", " \n\x85\n\x0b", "\n".join(f"line {k}" for k in range(30_000)), "x" * 300_000 + "\n" + "y" * 300_000, "tie\ntie\ntie",
]


def expected_cut(doc, text, rate=100, spm=50, seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return n, "plain", None, None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return n, "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("rate,spm,seed", [(100, 50, 7), (60, 0, 1), (100, 100, 2)])
def test_fill_in_middle(spark, rate, spm, seed):
    rows = table(spark, LINES)
    made = fill_in_middle(rows, rate, spm, seed)
    assert made.columns == ["doc_id", "n", "form", "prefix", "middle", "suffix", "output"]
    got = Counter(tuple(r) for r in made.collect())
    assert got == Counter((r.doc_id, *expected_cut(r.doc_id, r.text, rate, spm, seed)) for r in rows.collect())
    back = made.select("doc_id", restored(F.col("output"), F.col("form")).alias("text"))
    assert Counter(map(tuple, back.collect())) == Counter((r.doc_id, r.text or "") for r in rows.collect())
    assert fill_in_middle(rows.limit(0)).count() == 0


def test_every_cut_is_found(spark):
    rows = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a\nbb\n\n𝄞\nlast").alias("text"))
    got = {tuple(r) for r in fill_in_middle(rows).collect()}
    assert got == {(k, *expected_cut(k, "a\nbb\n\n𝄞\nlast")) for k in range(400)}
    assert len({(r[3], r[4]) for r in got}) > 15
    assert len(spark.range(1).select(*draws(F.col("id"), 7)).first()) == 4


# ---- benchmark decontamination -----------------------------------------------------------

def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected_hits(documents, items, window=10):
    windows = {}
    for item, text in items:
        w = bench_words(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in documents:
        w, hit, names = bench_words(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                found = windows.get(tuple(w[i : i + size]))
                if found:
                    hit |= set(range(i, i + size))
                    names |= found
        out.append((doc, len(w), sorted(hit), sorted(names)))
    return sorted(out, key=str)


def found_hits(frame):
    return sorted(
        ((r.doc_id, r.n_words, [k for h in r.hits for k in range(h["first"], h["last"] + 1)], list(r.items_)) for r in frame.withColumnRenamed("items", "items_").collect()),
        key=str,
    )


def bench_tables(seed):
    rng = random.Random(seed)
    make = lambda n: [rng.choice(["a", "b", "Cc", "été", "ß", "0", "數據", "x" * 40]) for _ in range(n)]
    mix = lambda w: "".join(x + rng.choice([" ", "  ", ", ", "\n", "-", "\x00", "\u007f"]) for x in w)
    items = [(k if k != 2 else None, mix(make(rng.choice([0, 1, 3, 9, 10, 11, 14, 40])))) for k in range(12)]
    items += [(50, None), (51, ""), (7, items[4][1]), (52, items[5][1]), (53, " ".join(make(9000)))]
    texts = [None, "", "...", "a"] + [mix(make(rng.randint(1, 300))) for _ in range(12)]
    for _, text in items:
        if text:
            texts += [mix(make(5)) + text.upper() + " " + mix(make(5)), text[: len(text) // 2]]
    return items, texts + [mix(make(20_000))]


@pytest.mark.parametrize("seed,shard_words", [(1, 1 << 20), (2, 3000)])
def test_benchmark_hits(spark, seed, shard_words):
    items, texts = bench_tables(seed)
    rows = table(spark, texts)
    bench = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id bigint, text string, item string, width int")
    found = benchmark_hits(rows, bench, shard_words=shard_words)
    assert found_hits(found) == expected_hits([(r.doc_id, r.text) for r in rows.collect()], items)
    starts = [(r.hits[k]["last"], r.hits[k + 1]["first"]) for r in found.collect() for k in range(len(r.hits) - 1)]
    assert all(b > a + 1 for a, b in starts)


def test_benchmark_without_rows(spark):
    rows = table(spark, ["a b c", None])
    bench = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert benchmark_hits(rows.limit(0), bench).count() == 0
    assert [(r.n_words, r.hits, r["items"]) for r in benchmark_hits(rows, bench.limit(0)).collect()] == [(3, [], []), (0, [], []), (0, [], [])]


# ---- spelling variants -------------------------------------------------------------------

def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def expected_variants(documents, min_count=5, ratio=5, typo_every=199):
    count = Counter()
    for doc, text in documents:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % typo_every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= min_count}
    near = {w: [x for x in words if abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= ratio * words[w]:
            form[w] = best
    out = []
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, words[w], len(near[w]), words[form[w]] if w in form else None))
    return sorted(out)


@pytest.mark.parametrize("seed,shard_chars,long", [(1, 1 << 17, 64), (2, 60, 64), (3, 200, 9)])
def test_spelling_variants(spark, seed, shard_chars, long):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdé×ß") for _ in range(rng.randint(5, 12))) for _ in range(12)]
    base += ["abcabc" + b for b in base[:6]] + ["long" + "é" * 70 + "x", "long" + "é" * 70 + "y", "long" + "é" * 69 + "x", "é" * 64, "é" * 65, "é" * 66, "aaaaaa", "aaaaaaa"]
    texts = [None, "", "12 ŕ 34"]
    for k, word in enumerate(base):
        variants = [word] + [word[:i] + rng.choice("aé") + word[i + rng.randint(0, 1) :] for i in (0, 2, len(word) // 2, len(word))]
        for v, w in enumerate(variants):
            texts += [" ".join([w.upper() if k % 2 else w] * rng.choice([5, 25, 125, 4])) + "," + variants[v - 1]]
    rows = table(spark, texts)
    made = spelling_variants(rows, typo_every=7, shard_chars=shard_chars, long=long)
    assert made.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(r) for r in made.collect()]
    expected = expected_variants([(r.doc_id, r.text) for r in rows.collect()], typo_every=7)
    assert sorted(got) == expected
    assert any(r[1] and r[2] != r[1] for r in expected) or seed != 1
    assert spelling_variants(rows.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in QUERIES["op13_spelling_variants"](spark, SMALL).collect())
    assert got == expected_variants([tuple(r) for r in rows])


@pytest.mark.parametrize("seed", range(40))
def test_index_against_comparison(seed):
    rng = random.Random(seed)
    word = lambda letters: bytes(rng.choice(letters) for _ in range(rng.randint(2, 8)))
    held, asked = list({word(b"ab\xff") for _ in range(rng.randint(1, 80))}), [word(b"abc\xff") for _ in range(40)]
    for up in (0, 1):
        half = [(len(q) + up) // 2 for q in asked]
        query, near = FMIndex(held).near(asked, np.array(half))
        expected = [
            (k, w) for k, q in enumerate(asked) for w in held
            if w[: half[k]] == q[: half[k]] and one_edit(q[half[k] :].decode("latin-1"), w[half[k] :].decode("latin-1"))
        ]
        assert sorted(zip(query.tolist(), near, strict=True)) == sorted(expected)
