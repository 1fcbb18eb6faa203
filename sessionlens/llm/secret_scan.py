"""Secret scan over a trigram inverted index, in DataFrame functions only.

Each rule's pattern is reduced to a Boolean query of trigrams: alternatives of which one must
hold, each a set of trigrams that must all occur.  Documents are indexed under the trigrams
that some rule asks for; the postings of an alternative are intersected by document, and the
pattern itself decides on the candidates.  A rule with an alternative without trigrams (hex)
scans every text.

Index and patterns see whole texts.  Postings hold the place of a row, never its text, and are
counted by document, so a trigram that every document holds makes no large group.

Defined results: a null text is empty; an empty text has no spans; repeated rows are scanned
each; ``doc_id`` may be null or repeated; an empty table gives an empty one.  Spans count code
points, the end excluded.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.blocks import computed_once
from ..plans.durable import written
from .places import with_place


@dataclass(frozen=True)
class Rule:
    """A kind of secret; matches whose ``group`` is shorter than ``least`` are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE_RULES = (
    Rule(
        "assign",
        "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
        "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        8,
    ),
    Rule("access", "AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", "[0-9a-f]{32,}"),
)
#: A private key from its header over all of its body: up to the END line, or, if none comes before
#: other dashes than those of header fields and marked lines, to the last long run of base64 and the
#: short line after it.  The body is followed by character classes, which take no stack.
PEM = (
    "-----BEGIN [A-Z ]*PRIVATE KEY-----"
    "(?:[^-]*(?:-[^-]+){0,400}-{5,6}END [A-Z ]*PRIVATE KEY-----"
    "|(?:[ \\t\\r\\n]*[A-Za-z][A-Za-z-]*: [^\\n]*\\n){0,8}[A-Za-z0-9+/=\\\\ \\t\\r\\n]*[A-Za-z0-9+/=]{20,}"
    "(?:[ \\t\\r\\n]+[A-Za-z0-9+/]+={1,2}|[ \\t\\r]*\\n[ \\t]*[A-Za-z0-9+/]+[ \\t\\r]*(?:\\n|$))?)?"
)
#: Public token formats.
MORE_RULES = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", "sk_live_[A-Za-z0-9]{24,}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}"),
    Rule("pem", PEM),
)
RULES = BASE_RULES + MORE_RULES
MOST_ALTERNATIVES = 512
BREAK = "\0"


def _repeated(inner: set[str], times: int) -> set[str]:
    """Strings of ``times`` inner ones each, or of fewer if there were too many."""
    out = inner
    for _ in range(times - 1):
        if len(out) * len(inner) > MOST_ALTERNATIVES:
            break
        out = {a + b for a in out for b in inner}
    return out


def _strings(items) -> set[str]:
    """Lower-cased strings a parsed pattern may match, with breaks for what is not fixed."""
    out = {""}
    for op, value in items:
        if op is sre.LITERAL:
            part = {chr(value).lower()}
        elif op is sre.IN:
            chars = {chr(v).lower() for o, v in value if o is sre.LITERAL}
            part = chars if len(chars) <= 5 and all(o is sre.LITERAL for o, _ in value) else {BREAK}
        elif op is sre.SUBPATTERN:
            part = _strings(value[-1])
        elif op is sre.BRANCH:
            part = set().union(*(_strings(branch) for branch in value[1]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, inner = value
            if (least, most) == (0, 1):
                part = _strings(inner) | {""}
            elif least == 0:
                part = {BREAK}
            else:
                part = {s + BREAK for s in _repeated(_strings(inner), min(least, 8))}
        else:
            part = {BREAK}
        out = {a + b for a in out for b in part}
        if len(out) > MOST_ALTERNATIVES:
            out = {BREAK}
    return out


def trigram_query(pattern: str) -> list[list[str]] | None:
    """Alternatives of mandatory trigrams (lower case), or None if one has no trigram."""
    found = set()
    for text in _strings(sre_parser.parse(pattern)):
        grams = {run[i : i + 3] for run in text.split(BREAK) for i in range(len(run) - 2)}
        if not grams:
            return None
        found.add(frozenset(grams))
    least = [g for g in found if not any(h < g for h in found)]
    return sorted(sorted(g) for g in least)


def postings(placed: DataFrame, grams: list[str]) -> DataFrame:
    """The inverted index: one row per trigram asked for and document that holds it."""
    lowered = computed_once(placed.select("_file", "_row", "text"), F.lower("text").alias("_low"))
    held = F.filter(F.array(*map(F.lit, grams)), lambda g: F.contains("_low", g))
    return lowered.select("_file", "_row", F.explode(held).alias("gram"))


def candidates(placed: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``_file, _row, rule``: the documents whose postings satisfy a rule's Boolean query, and
    those that hold a match of a rule scanned fully."""
    spark = placed.sparkSession
    queries = [(n, trigram_query(rule.pattern)) for n, rule in enumerate(rules)]
    clauses = [(n, k, gram, len(grams)) for n, q in queries if q for k, grams in enumerate(q) for gram in grams]
    found = None
    if clauses:
        index = written(postings(placed, sorted({c[2] for c in clauses})))
        asked = spark.createDataFrame(clauses, "rule int, clause int, gram string, size int")
        found = (
            index.join(F.broadcast(asked), "gram")  # a row per trigram of the rules
            .groupBy("_file", "_row", "rule", "clause").agg(F.count("*").alias("held"), F.first("size").alias("size"))
            .filter("held = size").select("_file", "_row", "rule").distinct()
        )
    for n, query in queries:
        if query is None:
            every = placed.filter(F.col("text").rlike(rules[n].pattern)).select("_file", "_row", F.lit(n).alias("rule"))
            found = every if found is None else found.unionByName(every)
    return found


def _sums_before(values: Column, sums: Column, n: Column, block: int = 256) -> Column:
    """Sum of the values before each, from the sums of whole blocks before its block."""
    zero = F.lit(0)
    add = lambda a, b: a + b
    return F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.get(sums, F.floor(i / block).cast("int"))
        + F.aggregate(F.slice(values, F.floor(i / block).cast("int") * block + 1, F.pmod(i, F.lit(block))), zero, add),
    )


def located(rows: DataFrame) -> DataFrame:
    """Rows ``text, pattern, group, least`` with ``found``: start and end of every match kept.

    The text between matches and the matches give the places; sums run over blocks of 256
    matches, so many matches in one text stay cheap.
    """
    zero, add = F.lit(0), lambda a, b: a + b
    matches = F.regexp_extract_all("text", F.col("pattern"), F.lit(0))
    rows = computed_once(
        rows,
        F.transform(matches, F.length).alias("_size"),
        F.transform(F.split("text", F.col("pattern"), -1), F.length).alias("_gap"),
        F.transform(F.regexp_extract_all("text", F.col("pattern"), F.col("group")), F.length).alias("_held"),
    ).filter(F.size("_size") > 0)
    step = F.zip_with(F.slice("_gap", 1, F.size("_size")), "_size", lambda g, s: g + s)
    rows = computed_once(rows, step.alias("_step"))
    blocks = F.sequence(F.lit(0), F.floor((F.size("_step") - 1) / 256).cast("int"))
    rows = computed_once(rows, F.transform(blocks, lambda b: F.aggregate(F.slice("_step", b * 256 + 1, 256), zero, add)).alias("_block"))
    rows = computed_once(rows, F.transform(blocks, lambda b: F.aggregate(F.slice("_block", F.lit(1), b), zero, add)).alias("_sums"))
    rows = computed_once(rows, _sums_before(F.col("_step"), F.col("_sums"), F.size("_step")).alias("_before"))
    spans = F.transform(
        F.arrays_zip("_before", "_gap", "_size", "_held"),
        lambda m: F.struct((m["_before"] + m["_gap"]).alias("start"), (m["_before"] + m["_gap"] + m["_size"]).alias("end"), m["_held"].alias("held")),
    )
    # the gap after the last match has no match of its own
    kept = F.filter(F.slice(spans, 1, F.size("_size")), lambda m: m["held"] >= F.col("least"))
    return rows.withColumn("found", kept)


def secret_spans(placed: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``_file, _row, spans`` of documents with secrets; spans (start, rule, kind, end) are
    sorted.  ``placed`` comes from ``with_place`` and has a ``text``."""
    spark = placed.sparkSession
    table = spark.createDataFrame(
        [(n, r.kind, r.pattern, r.group, r.least) for n, r in enumerate(rules)],
        "rule int, kind string, pattern string, group int, least int",
    )
    chosen = written(candidates(placed, rules)).join(F.broadcast(table), "rule")  # a row per rule
    found = located(placed.select("_file", "_row", "text").join(chosen, ["_file", "_row"]))
    spans = F.transform("found", lambda m: F.struct(m["start"].alias("start"), F.col("rule"), F.col("kind"), m["end"].alias("end")))
    return (
        found.filter(F.size("found") > 0).select("_file", "_row", spans.alias("spans"))
        .groupBy("_file", "_row").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    )


def span_list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Every secret of every document, with the base kinds counted."""
    placed = with_place(spark.read.parquet(f"{folder}/documents.parquet"), doc_id="doc_id", text="text")
    found = written(secret_spans(placed))
    spans = F.coalesce("spans", F.array().cast(found.schema["spans"].dataType))
    base = F.filter(spans, lambda s: s["rule"] < len(BASE_RULES))
    counts = [count_of(spans, r.kind).alias(f"n_{r.kind}") for r in BASE_RULES]
    return placed.select("doc_id", "_file", "_row").join(found, ["_file", "_row"], "left").select(
        "doc_id", *counts, F.sha2(span_list(base), 256).alias("base_sha256"), span_list(spans).alias("spans")
    )


def _rule_sql(n: int, rule: Rule) -> str:
    p = rule.pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {n} AS rule, '{rule.kind}' AS kind, unnest(list_filter(list_transform(range(1, len(m) + 1), lambda i: {{
    's': list_sum(list_transform(gap[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0),
    'n': length(m[i]), 'held': length(g[i])}}), lambda x: x.held >= {rule.least})) AS span
  FROM (SELECT doc_id, regexp_extract_all(text, '{p}', 0) AS m, regexp_extract_all(text, '{p}', {rule.group}) AS g,
        regexp_split_to_array(text, '{p}') AS gap FROM documents WHERE regexp_matches(text, '{p}'))"""


OP1_SQL = f"""
WITH found AS ({' UNION ALL '.join(_rule_sql(n, r) for n, r in enumerate(RULES))}),
one AS (SELECT doc_id, rule, kind, span.s AS s, kind || ':' || CAST(span.s AS BIGINT) || ':' || CAST(span.s + span.n AS BIGINT) AS t FROM found),
joined AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex, string_agg(t, ',' ORDER BY s, rule) FILTER (rule < 3) AS base,
    string_agg(t, ',' ORDER BY s, rule) AS spans
  FROM one GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN joined j ON d.doc_id = j.doc_id
"""
