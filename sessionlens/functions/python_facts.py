"""What Python files and project files say, as plain rows; rules are applied to these in Spark."""

from __future__ import annotations

import ast
import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

#: A call or an import in the order of the source; ``shell`` and ``mode`` are constant arguments.
FACTS = "array<struct<line:bigint,verb:string,name:string,shell:boolean,mode:string>>"
DOTTED = re.compile(r"[^\W\d]\w*(\.[^\W\d]\w*)*")


def _constants(call: ast.Call) -> dict:
    """Constant keyword arguments, and the second positional one as ``mode``."""
    second = {"mode": a.value for a in call.args[1:2] if isinstance(a, ast.Constant)}
    return second | {k.arg: k.value.value for k in call.keywords if isinstance(k.value, ast.Constant)}


def facts_of(text: str) -> list[tuple] | None:
    """Calls and imports of a Python text, with names as imported; None if it does not parse."""
    try:
        waiting = [ast.parse(text)]
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    known: dict[str, str] = {}
    facts = []
    while waiting:
        node = waiting.pop()
        waiting += reversed(list(ast.iter_child_nodes(node)))
        if isinstance(node, ast.Import):
            for item in node.names:
                top = item.name.split(".", 1)[0]
                known[item.asname or top] = item.name
                facts.append((node.lineno, "import", item.name, None, None))
        elif isinstance(node, ast.ImportFrom):
            source = node.module or ""
            known |= {item.asname or item.name: f"{source}.{item.name}" for item in node.names}
            facts.append((node.lineno, "from", source, None, None))
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name | ast.Attribute):
            try:
                written = ast.unparse(node.func)
            except RecursionError:
                continue  # a chain that deep is no plain name
            if DOTTED.fullmatch(written):
                first, dot, rest = written.partition(".")
                constant = _constants(node)
                mode = constant.get("mode")
                facts.append((node.lineno, "call", known.get(first, first) + dot + rest, bool(constant.get("shell")), mode if isinstance(mode, str) else None))
    return facts


def python_facts():
    """Arrow function over Python texts; a null text, and one that does not parse, gives null."""

    @F.pandas_udf(FACTS)
    def facts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        keys = ("line", "verb", "name", "shell", "mode")
        for texts in batches:
            found = [None if t is None else facts_of(t) for t in texts]
            yield pd.Series([None if f is None else [dict(zip(keys, x, strict=True)) for x in f] for f in found], dtype=object)

    return facts


# ---- manifests ------------------------------------------------------------------------------

REQUIREMENT = r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)"


def _requirement(spec: object) -> list[str]:
    found = re.match(REQUIREMENT, str(spec))
    return [found.group(1)] if found else []


def project_names(text: str) -> tuple[str, int, list[str]]:
    """Package name, number of direct dependencies and all dependency names of a pyproject."""
    try:
        data = tomllib.loads(text)
    except (tomllib.TOMLDecodeError, RecursionError):
        return "", 0, []
    project = data.get("project") or {}
    direct = project.get("dependencies") or []
    extras = [spec for group in (project.get("optional-dependencies") or {}).values() for spec in group or []]
    poetry = ((data.get("tool") or {}).get("poetry") or {}).get("dependencies") or {}
    names = [name for spec in [*direct, *extras] for name in _requirement(spec)]
    return str(project.get("name") or ""), len(direct), names + [n for n in poetry if n != "python"]
