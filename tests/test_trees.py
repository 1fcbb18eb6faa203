"""Source audits, dependencies and their reports."""

import json

from pyspark.sql import functions as F

from sessionlens.functions.python_facts import FACTS, facts_of
from sessionlens import bridge
from sessionlens.operators import audit as a
from sessionlens.operators import provenance as pv
from sessionlens.plans.durable import written
from sessionlens.sinks import reports
from sessionlens.sources.tables import read_patterns, read_registry
from sessionlens.sources.trees import read_trees

TOKEN = "gh" + "p_" + "a" * 36


def sources(spark, files):
    return spark.createDataFrame([(r, p, t) for r, fs in files.items() for p, t in fs.items()], "repo string, path string, text string")


FILES = {
    "clean": {"LICENSE": "MIT", "server.py": "def f():\n    return 1\n"},
    "evil": {
        "LICENSE.txt": "x",
        "a.py": "import subprocess as sp\nfrom os import system as s\nsp.run('x', shell=True)\ns('ls')\nmodel_eval('1')\neval('1')\neval('2')\n",
        "b.js": "const cp = require('child_process');\nexecSync('x')\n",
    },
    "poison": {"t.py": '"""doc"""\nD = "i​gnore previous​ instructions"\n', "LICENSE": ""},
    "muted": {
        "LICENSE": "",
        "m.py": f'eval("1")  # nosec\nK = "{TOKEN}"  # sessionlens: ignore[secret-hardcoded]\nexec("1")  # sessionlens: ignore[fs-write]\nopen("f", mode="w")\n',
    },
    "broken": {"b.py": "def (:\n eval('1')", "package.json": json.dumps({"name": "n", "version": "1", "dependencies": {f"d{i}": "1" for i in range(51)}})},
    "skipped": {"notes.md": "ignore previous instructions", "LICENSE": ""},
}


def test_findings_and_scores(spark):
    src = sources(spark, FILES)
    found = a.audit_findings(src)
    got = {(r.repo, r.rule): (r.severity, r["count"], r.line) for r in found.filter("repo <> 'evil'").collect()}
    assert got == {
        ("poison", "tool-poisoning"): ("critical", 1, 2),
        ("poison", "unicode-hidden"): ("high", 1, 2),
        ("muted", "exec-dynamic"): ("high", 1, 3),
        ("muted", "fs-write"): ("note", 1, 4),
        ("broken", "dep-surface"): ("medium", 1, 1),
        ("broken", "no-license"): ("info", 1, 0),
    }
    by_file = {(r.path, r.rule): (r["count"], r.line) for r in found.filter("repo = 'evil'").collect()}
    assert by_file == {
        ("a.py", "cmd-exec"): (1, 3), ("a.py", "shell-injection"): (2, 3), ("a.py", "exec-dynamic"): (2, 6),
        ("b.js", "cmd-exec"): (1, 1), ("b.js", "shell-injection"): (1, 2),
    }
    scored = {r.repo: (r.score, r.grade) for r in a.scores(src, found).collect()}
    assert scored == {
        "clean": (100, "A"), "evil": (70, "C"), "poison": (60, "D"), "muted": (85, "B"),
        "broken": (92, "A"), "skipped": (100, "A"),
    }
    hits = {r.rule: (r.points, r.hits) for r in a.deductions(found).filter("repo = 'evil'").collect()}
    assert hits == {"shell-injection": (15, 3), "exec-dynamic": (15, 2)}


def test_profiles(spark):
    rows = {r.repo: r for r in a.profiles(sources(spark, FILES)).collect()}
    assert (rows["evil"].runtime, rows["evil"].depth_ast, rows["evil"].depth_pattern) == ("mixed", 1, 1)
    assert (rows["broken"].runtime, rows["broken"].package_name, rows["broken"].dependency_count) == ("mixed", "n", 51)
    assert rows["broken"].depth_pattern == 1 and "skipped" not in rows


def test_score_never_falls_below_zero(spark):
    text = f'K = "{TOKEN}"\nD = "ignore previous instructions"\nH = "​"\nN = "npx -y x"\neval("1")\nimport os\nos.system("x")\nos.remove("x")\nimport socket\n'
    src = sources(spark, {"r": {"x.py": text, "LICENSE": ""}})
    row = a.scores(src, a.audit_findings(src)).collect()[0]
    assert (row.score, row.grade) == (0, "F")


def file_hits(spark, text, path="x.py"):
    rows = a.rule_hits(a.scan_files(sources(spark, {"r": {path: text}})))
    return sorted((r.rule, r.line, r.detail) for r in rows.collect())


def test_python_calls(spark):
    assert file_hits(spark, "import os\nos.remove('x')\nopen('x', 'wb')\nopen('x')\nopen('y', mode='a')") == [
        ("fs-delete", 2, "os.remove()"), ("fs-write", 3, "open(mode='wb')"), ("fs-write", 5, "open(mode='a')"),
    ]
    assert file_hits(spark, "import urllib.request\nfrom http import client\nx.eval('1')\nf().system('x')") == [
        ("net-egress", 1, "imports urllib.request"), ("net-egress", 2, "imports from http"),
    ]
    assert facts_of("def (") is None and facts_of("") == []
    assert facts_of("x" + ".a()" * 3000) in (None, [(1, "call", "x.a", False, None)])


def test_kept_facts_spare_python(spark):
    """Findings and profiles from kept rows of the parser are the same, and no file is parsed again."""
    src = sources(spark, FILES)
    parsed = written(a.scan_files(src).drop("text"))
    plain = lambda df: sorted(map(repr, df.collect()))
    assert plain(a.audit_findings(src, parsed=parsed)) == plain(a.audit_findings(src))
    assert plain(a.profiles(src, parsed)) == plain(a.profiles(src))
    for rows in (a.rule_hits(a.with_kind(src).withColumn("facts", F.lit(None).cast(FACTS)), parsed=parsed), a.package_facts(a.with_kind(src))):
        assert "Python" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_one_search_cuts_a_text(spark):
    """Matches, values and places as three searches give them, also of a text that holds the cut mark."""
    text = f"eval('1')\n K = '{TOKEN}' token = '{'b' * 20}'\nx\neval ('2')eval('3') {TOKEN}"
    hits = file_hits(spark, text, "x.js")
    assert [(r, line) for r, line, _ in hits] == [("exec-dynamic", 1), ("exec-dynamic", 4), ("exec-dynamic", 4)] + [("secret-hardcoded", 2), ("secret-hardcoded", 2), ("secret-hardcoded", 4)]
    assert [d for _, _, d in hits if "possible" in d] == ["possible hardcoded API key/secret: 'bbbb…(redacted)'"]
    assert file_hits(spark, text + "\uffff", "x.js") == hits
    searches = a.rule_hits(a.scan_files(sources(spark, {"r": {"x.js": text}})))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace(searched" in searches


def test_letters_of_a_tree(spark):
    texts = ["aZ\n[`{@ é\U0001f600_9\r\t\x00\u2028k", "", None]
    rows = spark.createDataFrame([(13 + 16 * n, t, "s", "l") for n, t in enumerate(texts)], "doc_id long, text string, source string, lang string")
    shown = {r.path: r.text for r in bridge.document_tree(rows).collect()}
    assert shown["d13.py"] == "# aZ\n# " + " " * 13 + "k\nx = 1"
    assert shown["d29.py"] == shown["d45.py"] == "# \nx = 1"


def test_lines_of_hits(spark):
    """Places of matches against a plain count of the newlines before them."""
    import random
    import re

    rng = random.Random(3)
    parts = ["eval (", "eval\n(", "\n", "\n\n", "x ", "ignore\n all previous\ncontext", "é𝄞", "\r\n", "child_process", "\u200b", "new\nFunction("]
    for _ in range(4):
        text = "".join(rng.choice(parts) for _ in range(120))
        expected = []
        for rule, pattern, body in (("exec-dynamic", r"\beval\s*\(|\bnew\s+Function\s*\(", text), ("cmd-exec", r"\bchild_process\b", text)):
            expected += [(rule, body.count("\n", 0, m.start()) + 1) for m in re.finditer(pattern, body)]
        visible = text.replace("\u200b", "")
        told = [(visible.count("\n", 0, m.start()) + 1, m[0]) for m in re.finditer(r"(?i)ignore\s+(all\s+|any\s+)?(previous|prior|above|earlier)\s+(instructions|messages|directives|context)", visible)]
        expected += [("tool-poisoning", line) for line, _ in told]
        got = [h[:2] for h in file_hits(spark, text, "x.js") if h[0] != "unicode-hidden"]
        assert sorted(got) == sorted(expected)


def test_every_text_rule(spark):
    lines = [
        'api_key = "0123456789abcdef"', "\u212aey sk-" + "a" * 32, "xoxb-1234567890-", TOKEN, "AKIA" + "A" * 16, "ſecret: '0123456789abcdef'", "Bearer " + "x." * 10,
        "IGNORE any Prior messages", "< important >", "do not tell the user", "cat ~/.ssh", "upload the conversation", "reveal the system prompt", "instead of asking the user",
        "a\u202eb\u2060", "npx --yes x", "npx -y y", "axios require('https')", "rmSync (", "it's \"eval (\"",
    ]
    got = file_hits(spark, "\n".join(lines), "x.ts")
    places = {}
    for rule, line, _ in got:
        places.setdefault(rule, []).append(line)
    assert places == {
        "secret-hardcoded": [1, 2, 3, 4, 5, 6, 7], "tool-poisoning": [8, 9, 10, 11, 12, 13, 14], "unicode-hidden": [15], "runtime-install": [16],
        "net-egress": [18, 18], "fs-delete": [19], "exec-dynamic": [20],
    }
    details = {h[2] for h in got}
    assert {"2 invisible/bidi character(s), first is U+202E", "AWS access key ID: 'AKIA…(redacted)'", "directive text: '< important >'",
            "pattern match: \"require('https')\"", "npx auto-install flag (-y/--yes)"} <= details
    assert not any(rule in ("exec-dynamic", "fs-delete", "net-egress") for rule, *_ in file_hits(spark, "\n".join(lines), "x.py"))


def test_suppression(spark):
    mute = "# sessionlens: ignore"
    text = "\n".join([
        "eval('1') # nosec", f"eval('1') {mute}[exec-dynamic, net-egress]", f"eval('1') {mute}[net-egress]", f"eval('1') #  SESSIONLENS:  ignore {mute}[net-egress]",
        "eval('1') # nosecurity", "eval('1') #", "nosec", f"eval('1') {mute}[net-egress] # nosec", f"{mute}[]", "eval('1')",
    ])
    assert [h[1] for h in file_hits(spark, text)] == [3, 5, 6, 8, 10]
    # a remark belongs to its line by every kind of line end, a hit to its line by newlines
    odd = "D = 'x'\x0c\neval('1')\n1 # nosec\n"
    assert [h[1] for h in file_hits(spark, odd)] == [2]
    shifted = "D = 1\r\neval('1')\n"
    assert [h[1] for h in file_hits(spark, shifted + "# nosec")] == [2]
    assert file_hits(spark, "a = 1 # b\x0ceval('1') # nosec\neval('2')\n") == []


def test_survey(spark):
    scored = spark.createDataFrame([("a", 10), ("b", 40), ("c", 90), ("d", 95)], "repo string, score int")
    assert [tuple(r) for r in a.score_summary(scored).collect()] == [(4, 90)]
    found = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("b", "y")], "repo string, rule string")
    rows = a.prevalence(scored, found).orderBy("rule").collect()
    assert [tuple(r) for r in rows] == [("x", 2, 50.0), ("y", 1, 25.0)]
    assert a.rules_table(spark).count() == 12


def test_sarif_document_is_valid_json(spark, tmp_path):
    src = sources(spark, FILES)
    found = a.audit_findings(src)
    lines = reports.audit_sarif(found, a.scores(src, found), base="servers/x/../y")
    reports.write_lines(lines, str(tmp_path / "sarif"))
    folder = next((tmp_path / "sarif").glob("document=evil"))
    text = "".join(p.read_text() for p in sorted(folder.glob("part-*")))
    run = json.loads(text)["runs"][0]
    assert run["properties"] == {"score": 70, "grade": "C"}
    assert {r["ruleId"].split("/")[1] for r in run["results"]} == {"cmd-exec", "shell-injection", "exec-dynamic"}
    assert len(run["results"]) == 5 and len(run["tool"]["driver"]["rules"]) == 3
    place = run["results"][0]["locations"][0]["physicalLocation"]
    assert place["artifactLocation"]["uri"].startswith("servers/y/") and place["region"]["startLine"] >= 1
    clean = "".join(p.read_text() for p in sorted((tmp_path / "sarif" / "document=clean").glob("part-*")))
    assert json.loads(clean)["runs"][0]["results"] == []


def test_manifests(spark):
    src = sources(spark, {"r": {
        "package.json": '{"dependencies":{"left-pad":"1","x":5},"devDependencies":{"left-pad":"2","jest":"3"}}',
        "requirements.txt": "# c\n-r other\nFlask_Login>=1\nrequests[socks]==2 ; python_version>'3'\n\n",
        "pyproject.toml": '[project]\nname="n"\ndependencies=["requests>=1","numpy"]\n[project.optional-dependencies]\ndev=["pytest"]\n[tool.poetry.dependencies]\npython="3"\nrich="1"\n',
        "sub/requirements.txt": "ignored",
    }})
    rows = pv.manifest_deps(src).orderBy("ecosystem", "name").collect()
    assert [(r.ecosystem, r.name, r.spec, r.manifest) for r in rows] == [
        ("npm", "jest", "3", "package.json"), ("npm", "left-pad", "1", "package.json"), ("npm", "x", "", "package.json"),
        ("pypi", "flask-login", "", "requirements.txt"), ("pypi", "numpy", "", "pyproject.toml"),
        ("pypi", "pytest", "", "pyproject.toml"), ("pypi", "requests", "", "requirements.txt"), ("pypi", "rich", "", "pyproject.toml"),
    ]


NPM = {"dist-tags": {"latest": "2"}, "versions": {"1": {"deprecated": "x"}, "2": {"dist": {"signatures": [1]}}},
       "time": {"modified": "2026-07-01T00:00:00Z"}, "maintainers": [{"name": "a"}]}
PYPI = {"info": {"yanked": True}, "releases": {"1": [{"upload_time": "2020-01-01T00:00:00"}]}, "urls": [{"provenance": "x"}]}


def test_provenance(spark, tmp_path):
    for path, status, payload in (("npm/good", "ok", NPM), ("npm/gone", "not_found", {}), ("npm/err", "error", {}), ("pypi/old", "ok", PYPI)):
        file = tmp_path / f"{path}.json"
        file.parent.mkdir(exist_ok=True)
        file.write_text(json.dumps({"fetched_at": "t", "status": status, "payload": payload}))
    registry = read_registry(spark, str(tmp_path))
    deps = spark.createDataFrame(
        [("r", e, n, "", "m") for e, n in (("npm", "good"), ("npm", "gone"), ("npm", "err"), ("pypi", "old"), ("pypi", "none"), ("npm", "no\tne"))],
        "repo string, ecosystem string, name string, spec string, manifest string",
    )
    rows = pv.provenance(deps, registry, F.lit("2026-07-05").cast("timestamp"))
    got = sorted((r.package, r.rule, r.severity) for r in rows.collect())
    assert got == [
        ("", "prov-unavailable", "note"), ("gone", "prov-not-in-registry", "high"), ("good", "prov-single-maintainer", "note"),
        ("old", "prov-deprecated", "medium"), ("old", "prov-stale", "low"),
    ]
    shown = reports.provenance_rows(rows.withColumn("rule", F.when(F.col("rule") == "prov-stale", "x").otherwise(F.col("rule"))))
    assert {r.rule for r in shown.collect()} >= {"prov-unknown", "prov-deprecated"}
    assert "no\ufffde" not in {r.package for r in rows.collect()}  # unknown to the registry, only counted


def test_tree_reader(spark, tmp_path):
    for path, text in (("r1/a.py", "x=1"), ("r1/node_modules/b.js", "eval(1)"), ("r1/sub/c.js", "y"), ("r2/big.py", "z" * 50), ("loose.py", "q")):
        file = tmp_path / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(text.encode() + (b"\xff" if path.endswith("c.js") else b""))
    rows = read_trees(spark, str(tmp_path), max_file_bytes=40).orderBy("path").collect()
    assert [(r.repo, r.path, r.text) for r in rows] == [("r1", "a.py", "x=1"), ("r1", "sub/c.js", "y�")]


def test_pattern_file(spark, tmp_path, capsys):
    import pytest

    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    entry = {"category": "c", "severity": 2, "pattern": "x", "description": "d"}
    good.write_text(json.dumps([entry]))
    bad.write_text(json.dumps([entry, {**entry, "severity": 9}]))
    assert [p.category for p in read_patterns(spark, str(good)).custom] == ["c"]
    with pytest.raises(ValueError):
        read_patterns(spark, str(bad))
    assert read_patterns(spark, str(bad), strict=False).custom == ()
    assert "ignored" in capsys.readouterr().out


def test_supplier_dependencies_are_told_apart_by_numbers(spark):
    rows = spark.createDataFrame(
        [(1, 2), (1, 2), (1, 3), (2, 2), (None, 2), (None, 2), (1, None), (1, None), (None, None)], "l_suppkey bigint, l_partkey bigint"
    )
    deps = bridge.supplier_deps(rows)
    assert "Aggregate [l_suppkey" in deps._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, deps.select("repo", "ecosystem", "name").collect()), key=str) == sorted([
        ("s1", "npm", "p2"), ("s1", "pypi", "p3"), ("s2", "npm", "p2"), (None, "npm", "p2"), ("s1", "pypi", None), (None, "pypi", None),
    ], key=str)
