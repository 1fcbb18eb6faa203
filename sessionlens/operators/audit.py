"""Risk scores of source trees by a fixed rubric."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..functions.jsonvalue import field, members, text_at
from ..functions.python_facts import FACTS, project_names, python_facts
from ..functions.source_rules import (
    NETWORK_MODULES,
    PYTHON_CALLS,
    TEXT_RULES,
    UNSEEN,
    WRITING,
    HIDDEN,
    candidate,
    folded,
    suppression,
)
from ..plans.blocks import computed_once
from ..plans.durable import with_dense_number

RUBRIC_VERSION = "0.3"
# Points taken once per rule by its worst severity, in order of severity.
WEIGHTS = {"critical": 25, "high": 15, "medium": 8, "low": 3, "note": 0, "info": 0}
# Lowest score of each grade.
GRADES = ((90, "A"), (80, "B"), (70, "C"), (60, "D"))
# Dependency counts above which a surface is large, and very large.
LARGE, VERY_LARGE = 20, 50

# Rule, default severity and category; titles and advice are our words.
RULES = (
    ("secret-hardcoded", "critical", "secrets", "Credential written into source",
     "Anyone who can read the package can use the credential.",
     "Load it from the environment or a secrets store, and rotate it."),
    ("tool-poisoning", "critical", "tool_poisoning", "Text that instructs the model",
     "Instructions hidden in descriptions act on the agent, not on its user.",
     "Delete the instruction; a description only describes."),
    ("unicode-hidden", "high", "tool_poisoning", "Invisible or direction-changing characters",
     "They hide text from a reviewer that a parser or model still reads.",
     "Remove the characters and review what they concealed."),
    ("exec-dynamic", "high", "supply_chain", "Code run from data",
     "Evaluated text escapes review and hides what is loaded.",
     "Dispatch explicitly, or isolate the input and document it."),
    ("shell-injection", "high", "permissions", "Shell command built from values",
     "One quote in a value runs another command.",
     "Pass an argument list and no shell."),
    ("runtime-install", "high", "supply_chain", "Packages fetched at run time",
     "Whatever the registry serves at launch is executed unreviewed.",
     "Install a pinned version beforehand."),
    ("cmd-exec", "note", "permissions", "Starts other programs",
     "A capability to compare with the declared purpose; the dangerous form has its own rule.",
     "Remove it when it is not needed."),
    ("fs-delete", "medium", "permissions", "Deletes files or directories",
     "Deletion by a tool server deserves a deliberate yes.",
     "Keep deletions inside a declared workspace."),
    ("dep-surface", "medium", "supply_chain", "Many direct dependencies",
     "Each direct dependency is one more party to trust.",
     "Audit the list and drop what is unused."),
    ("fs-write", "note", "permissions", "Writes files",
     "A capability; deleting is scored separately.",
     "Keep writes inside a declared workspace."),
    ("net-egress", "low", "permissions", "Uses the network",
     "Data can leave the machine.",
     "Check that the destinations fit the declared purpose."),
    ("no-license", "info", "provenance", "No license file at the root",
     "Not a risk in itself, but it weakens accountability.",
     "Prefer sources with an explicit license."),
)

SOURCE_SUFFIXES = (".py", ".js", ".ts", ".mjs", ".cjs")
MARKERS = ("sessionlens",)


def rules_table(spark: SparkSession) -> DataFrame:
    """The rubric: one row per rule with its weight and advice."""
    rows = [(*rule, WEIGHTS[rule[1]]) for rule in RULES]
    return spark.createDataFrame(
        rows, "rule string, severity string, category string, title string, why string, fix string, weight int"
    )


def rule_severity(rule: Column) -> Column:
    entries = [F.lit(x) for r in RULES for x in (r[0], r[1])]
    return F.try_element_at(F.create_map(*entries), rule)


def severity_rank(severity: Column) -> Column:
    """0 for critical to 5 for info."""
    return F.array_position(F.array(*[F.lit(w) for w in WEIGHTS]), severity).cast("int") - 1


def severity_of_rank(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), rank + 1)


def file_kind(path: Column) -> Column:
    """python, script or package for scanned files; null for all others."""
    name = F.substring_index(path, "/", -1)
    return (
        F.when(name.endswith(".py"), "python")
        .when(name.rlike(r"\.(js|ts|mjs|cjs)$"), "script")
        .when(name == "package.json", "package")
    )


_PROJECT = StructType([
    StructField("package_name", StringType()),
    StructField("dependency_count", LongType()),
    StructField("names", ArrayType(StringType())),
])


def project_facts():
    """Arrow function over pyproject texts: package name, dependency count, names."""

    @F.pandas_udf(_PROJECT)
    def facts(texts: pd.Series) -> pd.DataFrame:
        rows = [("", 0, []) if t is None else project_names(t) for t in texts]
        return pd.DataFrame(rows, columns=["package_name", "dependency_count", "names"])

    return facts


def with_kind(sources: DataFrame) -> DataFrame:
    """Every scanned file with its kind."""
    return sources.withColumn("kind", file_kind(F.col("path"))).filter("kind IS NOT NULL")


def scan_files(sources: DataFrame) -> DataFrame:
    """Every scanned file with its kind, depth and, for Python, its calls and imports."""
    files = with_kind(sources)
    scanned = computed_once(files, python_facts()(F.when(F.col("kind") == "python", F.col("text"))).alias("facts"))
    depth = F.when(F.col("facts").isNotNull(), "ast").when(F.col("kind").isin("python", "script"), "pattern")
    return scanned.select("repo", "path", "kind", "text", depth.alias("depth"), "facts")


# ---- hits of the rules ------------------------------------------------------------------------

#: Place of the hits of calls and imports among those of the text rules.
_CALLS = len(TEXT_RULES)
_MARKER = _CALLS + 1
_HITS = "array<struct<rule:string,line:bigint,detail:string,same:string>>"
#: Stands around matches while a text is cut; no text holds this noncharacter, else it is searched thrice.
_CUT = "\uffff"


def _quoted(text: Column) -> Column:
    """Text between quotes, with line ends and tabs written out."""
    for char, name in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(char), F.lit(name))
    quote = F.when(F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"')), '"').otherwise("'")
    return F.concat(quote, text, quote)


def _lines(pieces: Column, found: Column) -> Column:
    """Line of each match, from the text between matches and the matches.

    Only line ends and one mark a match are kept of both, so the marks on a line of what is
    left are the matches that begin on this line of the text: one pass, however many matches.
    """
    ends = lambda s: F.regexp_replace(s, r"[^\n]+", "")
    left = F.transform(
        pieces, lambda s, k: F.concat(ends(s), F.when(k < F.size(found), F.concat(F.lit("x"), ends(F.get(found, k)))).otherwise(""))
    )
    marks = F.split(F.array_join(left, ""), "\n", -1)
    return F.flatten(F.transform(marks, lambda x, k: F.array_repeat((k + 1).cast("bigint"), F.length(x))))


def _called(facts: Column) -> Column:
    """Hits of calls and imports by the fixed tables."""
    by_name = F.create_map(*[F.lit(x) for pair in PYTHON_CALLS.items() for x in pair])

    def judged(fact: Column) -> Column:
        name, line = fact["name"], fact["line"]

        def hit(rule, condition, detail):
            made = F.struct(rule.alias("rule"), line.alias("line"), detail.alias("detail"), F.lit(None).cast("string").alias("same"))
            return F.when(condition, made)

        call, spawns = fact["verb"] == "call", name.startswith("subprocess.")
        reaches = F.substring_index(name, ".", 1).isin(*NETWORK_MODULES)
        rule = F.try_element_at(by_name, name)
        return F.filter(F.array(
            hit(rule, call & rule.isNotNull(), F.concat(name, F.lit("()"))),
            hit(F.lit("cmd-exec"), call & spawns, F.concat(name, F.lit("()"))),
            hit(F.lit("shell-injection"), call & spawns & fact["shell"], F.concat(name, F.lit("(shell=True)"))),
            hit(F.lit("fs-write"), call & (name == "open") & fact["mode"].rlike(WRITING),
                F.concat(F.lit("open(mode='"), fact["mode"], F.lit("')"))),
            hit(F.lit("net-egress"), (fact["verb"] == "import") & reaches, F.concat(F.lit("imports "), name)),
            hit(F.lit("net-egress"), (fact["verb"] == "from") & reaches, F.concat(F.lit("imports from "), name)),
        ), lambda h: h.isNotNull())

    return F.flatten(F.transform(facts, judged))


def _matched() -> Column:
    """Hits of the text rule of a row, from the columns ``shown``, ``found`` and ``lines``."""
    rule = F.col("rule")
    detail = lambda text: (
        F.when(rule == "secret-hardcoded", F.concat("label", F.lit(": '"), F.substring(text, 1, 4), F.lit("…(redacted)'")))
        .when(rule == UNSEEN.rule, F.concat(F.size("found").cast("string"), F.lit(" "), "label", F.lpad(F.hex(F.ascii(text)), 4, "0")))
        .when(F.col("once"), F.col("label"))
        .otherwise(F.concat("label", F.lit(": "), _quoted(text)))
    )
    # a directive that several patterns find at one line is one hit
    hits = F.transform("shown", lambda text, k: F.struct(
        rule.alias("rule"), F.get("lines", k).alias("line"),
        F.when(F.col("no") == _MARKER, text).otherwise(detail(text)).alias("detail"),
        F.when(rule == "tool-poisoning", text).alias("same"),
    ))
    return F.when(F.col("once"), F.slice(hits, 1, 1)).otherwise(hits)


def _cut() -> list[Column]:
    """What a row's rule finds in its text, its values and the text between: one search, however
    many matches, from the columns ``searched``, ``regex`` and ``group``."""
    text, regex, group = F.col("searched"), F.col("regex"), F.col("group")
    marks = F.concat(F.lit(f"{_CUT}$0{_CUT}$"), group.cast("string"), F.lit(_CUT))
    parts = F.split(F.regexp_replace(text, regex, marks), _CUT, -1)

    def each_third(first: int, apart: Column) -> Column:
        together = F.filter(parts, lambda _, k: k % 3 == first)
        return F.when(F.contains(text, F.lit(_CUT)), apart).otherwise(together)

    return [
        each_third(1, F.regexp_extract_all(text, regex, F.lit(0))).alias("found"),
        each_third(2, F.regexp_extract_all(text, regex, group)).alias("shown"),
        each_third(0, F.split(text, regex, -1)).alias("pieces"),
    ]


def rule_hits(files: DataFrame, markers: tuple[str, ...] = MARKERS, parsed: DataFrame | None = None) -> DataFrame:
    """Every hit that its line does not suppress: ``repo, path, no, nth, rule, line, detail, same``.

    One map over the files finds the rules that match, then the rows of these rules only are
    searched for places.  Hits, not texts, are shuffled, by file.  Calls and imports come from
    ``files``, or from the rows of ``parsed``.
    """
    remark = suppression(markers)
    rules = (*TEXT_RULES, None, remark)
    text, kind = F.col("text"), F.col("kind")
    visible = F.regexp_replace(text, HIDDEN, "")
    ends = F.regexp_replace(text, "\r\n|[\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]", "\n")
    # nothing of an ASCII text is hidden or folds to a letter
    ascii_only = F.octet_length(text) == F.length(text)
    read = computed_once(
        files.select("repo", "path", "kind", "text", "facts"),
        F.when(ascii_only, F.lower(text)).otherwise(folded(visible)).alias("small"),
        F.when(~ascii_only & text.rlike(HIDDEN), visible).alias("visible"),
    )
    tried = [
        F.col("visible").isNotNull() if r is UNSEEN
        else candidate(r, F.coalesce("visible", "text") if r.reads == "visible" else text, F.col("small"), kind)
        for r in TEXT_RULES
    ]
    tried.append(F.size(F.coalesce("facts", F.array())) > 0)
    tried.append(candidate(remark, ends, F.col("small"), kind))
    numbers = F.filter(F.array(*[F.when(t, F.lit(k)) for k, t in enumerate(tried)]), lambda k: k.isNotNull())
    rows = read.select("repo", "path", "text", "visible", "facts", F.explode(numbers).alias("no"))

    def of_rule(value) -> Column:
        return F.element_at(F.array(*[F.lit(value(r)) if r else F.lit(None) for r in rules]), F.col("no") + 1)

    reads = of_rule(lambda r: r.reads)
    known = computed_once(
        rows,
        F.when(reads == "visible", F.coalesce("visible", "text")).when(reads == "lines", ends).when(reads == "raw", text).alias("searched"),
        of_rule(lambda r: r.regex()).alias("regex"), of_rule(lambda r: r.rule).alias("rule"), of_rule(lambda r: r.label).alias("label"),
        of_rule(lambda r: r.group).alias("group"), F.coalesce(of_rule(lambda r: r.once), F.lit(False)).alias("once"),
    )
    searched = computed_once(known, *_cut())
    placed = computed_once(searched, _lines(F.col("pieces"), F.col("found")).alias("lines"))
    hits = F.when(F.col("no") == _CALLS, _called(F.col("facts"))).otherwise(_matched()).cast(_HITS)
    each = placed.select("repo", "path", "no", F.posexplode(hits).alias("nth", "hit")).select("repo", "path", "no", "nth", "hit.*")
    if parsed is not None:
        called = parsed.select("repo", "path", F.lit(_CALLS).alias("no"), F.posexplode(_called(F.col("facts")).cast(_HITS)).alias("nth", "hit"))
        each = each.unionByName(called.select("repo", "path", "no", "nth", "hit.*"))
    own_line = Window.partitionBy("repo", "path", "line")
    is_remark = F.col("no") == _MARKER
    remarked = each.repartition("repo", "path").withColumn(
        "scope", F.min(F.when(is_remark, F.struct("nth", F.col("detail").alias("names")))).over(own_line)["names"]
    )
    named = F.transform(F.split("scope", ","), lambda n: F.trim(n))
    dropped = F.coalesce((F.col("scope") == "") | F.array_contains(named, F.col("rule")), F.lit(False))
    return remarked.filter(~is_remark & ~dropped).drop("scope")


def _surface(count: Column) -> Column:
    return F.when(count > VERY_LARGE, "medium").when(count > LARGE, "low")


def package_facts(files: DataFrame) -> DataFrame:
    """Name, version and direct dependency count of every package.json."""
    data = F.try_parse_json("text")
    return files.filter("kind = 'package'").select(
        "repo", "path",
        text_at(data, "$.name").alias("package_name"),
        text_at(data, "$.version").alias("version"),
        F.coalesce(F.size(F.map_keys(members(field(data, "$.dependencies")))), F.lit(0))
        .cast("bigint").alias("dependency_count"),
    )


def project_rows(sources: DataFrame) -> DataFrame:
    """Name and direct dependency count of the pyproject at each root."""
    at_root = sources.filter("path = 'pyproject.toml'")
    return at_root.withColumn("project", project_facts()(F.col("text"))).select(
        "repo", "path", "project.package_name", F.lit("").alias("version"), "project.dependency_count"
    )


def audit_findings(sources: DataFrame, markers: tuple[str, ...] = MARKERS, parsed: DataFrame | None = None) -> DataFrame:
    """One finding per (repository, rule, file): worst place first, with the hit count.

    ``parsed`` are the rows of ``scan_files`` where the caller keeps them: Python files are then
    not parsed again.
    """
    if parsed is None:
        files = scan_files(sources)
    else:
        files = with_kind(sources).withColumn("facts", F.lit(None).cast(FACTS))
    first = F.min(F.struct("no", "nth", "line", "detail"))
    once = rule_hits(files, markers, parsed).groupBy(
        "repo", "path", "rule", "line", F.coalesce("same", F.concat_ws("/", "no", "nth")).alias("same")
    ).agg(first.alias("first"))
    in_text = once.groupBy("repo", "path", "rule").agg(F.min("first").alias("first"), F.count("*").alias("count")).select(
        "repo", "path", "rule", "first.line", "first.detail", "count", rule_severity(F.col("rule")).alias("severity")
    )
    manifests = package_facts(with_kind(sources)).unionByName(project_rows(sources))
    surface = manifests.filter(F.col("dependency_count") > LARGE).select(
        "repo", "path", F.lit("dep-surface").alias("rule"), F.lit(1).cast("bigint").alias("line"),
        F.format_string("%d direct dependencies declared", "dependency_count").alias("detail"),
        F.lit(1).cast("bigint").alias("count"), _surface(F.col("dependency_count")).alias("severity"),
    )
    unlicensed = (
        sources.groupBy("repo")
        .agg(F.max(F.col("path").rlike("^(LICENSE|COPYING)[^/]*$")).alias("licensed"))
        .filter("NOT licensed")
        .select(
            "repo", F.lit(".").alias("path"), F.lit("no-license").alias("rule"),
            F.lit(0).cast("bigint").alias("line"), F.lit("no LICENSE/COPYING file found").alias("detail"),
            F.lit(1).cast("bigint").alias("count"), F.lit("info").alias("severity"),
        )
    )
    return in_text.unionByName(surface).unionByName(unlicensed)


def explained(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings with category, title, reason and advice of their rule."""
    facts = rules.select("rule", "category", "title", "why", "fix")
    return findings.join(F.broadcast(facts), "rule", "left")


def in_report_order(findings: DataFrame) -> DataFrame:
    """Findings numbered from 1 within each repository: worst first, then by rule and path.

    The numbers come from range partitions, so a repository is not one task.
    """
    ranked = findings.withColumn("rank", severity_rank(F.col("severity")))
    return with_dense_number(ranked, ["repo"], ["rank", "rule", "path"], "nth").drop("rank")


def deductions(findings: DataFrame) -> DataFrame:
    """Points per (repository, rule): its worst severity, once."""
    return (
        findings.groupBy("repo", "rule")
        .agg(F.min(severity_rank(F.col("severity"))).alias("rank"), F.sum("count").alias("hits"))
        .withColumn("points", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS.values()]), F.col("rank") + 1))
        .filter("points > 0")
        .select("repo", "rule", severity_of_rank(F.col("rank")).alias("severity"), "points", "hits")
    )


def grade(score: Column) -> Column:
    letter = F.when(F.lit(False), "")
    for floor, name in GRADES:
        letter = letter.when(score >= floor, name)
    return letter.otherwise("F")


def scores(repos: DataFrame, findings: DataFrame) -> DataFrame:
    """Score and grade of every repository."""
    taken = deductions(findings).groupBy("repo").agg(F.sum("points").alias("points"))
    return (
        repos.select("repo").distinct()
        .join(taken, "repo", "left")
        .withColumn("score", F.greatest(F.lit(0), 100 - F.coalesce("points", F.lit(0))).cast("int"))
        .select("repo", "score", grade(F.col("score")).alias("grade"))
    )


def profiles(sources: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """Runtime, depth, size and package facts of every repository; ``parsed`` as in ``audit_findings``."""
    files = scan_files(sources) if parsed is None else parsed
    counted = files.groupBy("repo").agg(
        F.count("*").alias("files_scanned"),
        F.count_if(F.col("kind") == "python").alias("python_files"),
        F.count_if(F.col("kind") == "script").alias("script_files"),
        F.count_if(F.col("depth") == "ast").alias("depth_ast"),
        F.count_if(F.col("depth") == "pattern").alias("depth_pattern"),
    )
    named = F.when(F.col("package_name") != "", F.col("package_name"))
    versioned = F.when(F.col("version") != "", F.col("version"))
    packages = package_facts(with_kind(sources)).groupBy("repo").agg(
        F.max_by(named, F.when(named.isNotNull(), F.col("path"))).alias("package_name"),
        F.max_by(versioned, F.when(versioned.isNotNull(), F.col("path"))).alias("version"),
        F.max_by(
            "dependency_count", F.when(F.col("dependency_count") > 0, F.col("path"))
        ).alias("package_count"),
    )
    projects = project_rows(sources).groupBy("repo").agg(F.max("dependency_count").alias("project_count"))
    runtime = (
        F.when(F.expr("python_files > 0 AND (script_files > 0 OR package_name <> '')"), "mixed")
        .when(F.expr("python_files > 0"), "python")
        .when(F.expr("script_files > 0 OR package_name <> ''"), "node")
        .otherwise("unknown")
    )
    return (
        counted.join(packages, "repo", "left")
        .join(projects, "repo", "left")
        .na.fill("", ["package_name", "version"])
        .withColumn("dependency_count", F.greatest(F.coalesce("package_count", F.lit(0)), F.coalesce("project_count", F.lit(0))))
        .withColumn("runtime", runtime)
        .drop("package_count", "project_count")
    )


# ---- survey over many repositories -----------------------------------------------------------


def prevalence(repos: DataFrame, findings: DataFrame) -> DataFrame:
    """Number and share of repositories each rule fires in.

    Every repository also counts once under a null rule; that row is the total.
    """
    every = repos.select("repo", F.lit(None).cast("string").alias("rule"))
    counts = (
        every.union(findings.select("repo", "rule"))
        .distinct()
        .groupBy("rule")
        .agg(F.count("*").alias("servers"))
    )
    total = F.max(F.expr("CASE WHEN rule IS NULL THEN servers END")).over(Window.partitionBy())
    return (
        counts.withColumn("total", total)
        .filter("rule IS NOT NULL")
        .select("rule", "servers", F.round(100 * F.col("servers") / F.col("total"), 1).alias("pct"))
    )


def survey_rows(scored: DataFrame, findings: DataFrame) -> DataFrame:
    """Every repository with score, grade and its rules (at most one name a rule), numbered
    from the lowest score; equal scores by name."""
    tripped = findings.groupBy("repo").agg(F.array_sort(F.collect_set("rule")).alias("rules"))
    rows = scored.join(tripped, "repo", "left").withColumn("rules", F.coalesce("rules", F.array().cast("array<string>")))
    return with_dense_number(rows.withColumn("all", F.lit(0)), ["all"], ["score", "repo"], "nth").drop("all")


def score_summary(scored: DataFrame) -> DataFrame:
    """Number of repositories and their median score (the upper one of two).

    Scores are 0 to 100, so the median comes from a histogram of at most 101 rows.
    """
    histogram = scored.groupBy("score").agg(F.count("*").alias("n"))
    ordered = Window.orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    return (
        histogram.withColumn("below", F.sum("n").over(ordered) - F.col("n"))
        .withColumn("total", F.sum("n").over(everything))
        .filter("below <= floor(total / 2) AND floor(total / 2) < below + n")
        .select(F.col("total").alias("servers_audited"), F.col("score").alias("median_score"))
    )
