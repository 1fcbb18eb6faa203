"""The rules that source text is matched against, as patterns of Spark's regular expressions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .unicode import HIDDEN_CLASS

HIDDEN = f"[{HIDDEN_CLASS}]"


@dataclass(frozen=True)
class TextRule:
    """A pattern, the files it is for, and the words of which a text must hold one.

    ``words`` are in lower case; they only spare a search that cannot succeed.
    ``reads`` names the form of the text: raw, visible (without hidden characters, which
    leaves line numbers as they are) or lines (every kind of line end as a newline).
    """

    rule: str
    pattern: str
    words: tuple[str, ...]
    label: str = ""
    group: int = 0
    reads: str = "raw"
    scripts_only: bool = False
    once: bool = False

    def regex(self) -> str:
        """The pattern with the character classes and case rules of Unicode; four control
        characters count as white space in the recorded form of the rules."""
        spaced = self.pattern.replace(r"\s", r"[\s\x1c-\x1f]")
        return "(?iuU)" + spaced[4:] if spaced.startswith("(?i)") else "(?U)" + spaced


_PRIVATE = (".ssh", "id_rsa", ".env", "credentials", "apikey", "api_key", "api key")

# Credential shapes in source, the value is the last group.
SECRETS = (
    TextRule("secret-hardcoded",
             r"(?i)\b(api[_-]?key|apikey|secret|token|password|passwd)\s*[=:]\s*[\"']([A-Za-z0-9_\-]{16,})[\"']",
             ("api", "secret", "token", "passw"), "possible hardcoded API key/secret", 2),
    TextRule("secret-hardcoded", r"\b(sk-[A-Za-z0-9]{32,})", ("sk-",), "OpenAI-style secret key", 1),
    TextRule("secret-hardcoded", r"\b(xoxb-[A-Za-z0-9\-]{10,})", ("xoxb-",), "Slack bot token", 1),
    TextRule("secret-hardcoded", r"\b(ghp_[A-Za-z0-9]{36})", ("ghp_",), "GitHub personal access token", 1),
    TextRule("secret-hardcoded", r"\b(AKIA[0-9A-Z]{16})", ("akia",), "AWS access key ID", 1),
    TextRule("secret-hardcoded", r"(?i)\bbearer\s+([A-Za-z0-9\-_.]{20,})", ("bearer",), "hardcoded Bearer token", 1),
)

# Text that steers a model, read without hidden characters.
DIRECTIVES = tuple(
    TextRule("tool-poisoning", pattern, words, "directive text", reads="visible")
    for pattern, words in (
        (r"(?i)ignore\s+(all\s+|any\s+)?(previous|prior|above|earlier)\s+(instructions|messages|directives|context)", ("ignore",)),
        (r"(?i)<\s*important\s*>", ("important",)),
        (r"(?i)do\s+not\s+(tell|inform|mention|reveal|alert|notify)\b[^.\n]{0,60}\b(user|human)", ("user", "human")),
        (r"(?i)\b(read|cat|open)\b[^.\n]{0,60}(\.ssh|id_rsa|\.env\b|credentials|api[_ ]?keys?)", _PRIVATE),
        (r"(?i)\b(send|upload|post|forward|exfiltrate)\b[^.\n]{0,60}"
         r"(\.ssh|id_rsa|\.env\b|credentials|api[_ ]?keys?|conversation|system prompt)",
         (*_PRIVATE, "conversation", "system prompt")),
        (r"(?i)reveal\s+the\s+system\s+prompt", ("reveal",)),
        (r"(?i)instead\s+of\s+(telling|showing|asking)\s+the\s+user", ("instead",)),
    )
)
UNSEEN = TextRule("unicode-hidden", HIDDEN, (), "invisible/bidi character(s), first is U+", once=True)
# Fixed value: the flag that installs what is not there.
INSTALL = TextRule("runtime-install", r"\bnpx\s+(-y|--yes)\b", ("npx",), "npx auto-install flag (-y/--yes)", once=True)

# Calls in scripts.
SCRIPT_CALLS = tuple(
    TextRule(rule, pattern, words, "pattern match", scripts_only=True)
    for rule, pattern, words in (
        ("exec-dynamic", r"\beval\s*\(", ("eval",)),
        ("exec-dynamic", r"\bnew\s+Function\s*\(", ("function",)),
        ("shell-injection", r"\bexecSync\s*\(", ("execsync",)),
        ("cmd-exec", r"\bchild_process\b", ("child_process",)),
        ("fs-delete", r"\b(unlinkSync|rmSync|rmdirSync)\s*\(", ("unlinksync", "rmsync", "rmdirsync")),
        ("net-egress", r"\brequire\(\s*['\"]https?['\"]\s*\)|\b(axios|node-fetch|undici)\b", ("require(", "axios", "node-fetch", "undici")),
    )
)

#: All of them in the order in which hits of a file count.
TEXT_RULES = (*SECRETS, *DIRECTIVES, UNSEEN, INSTALL, *SCRIPT_CALLS)


def suppression(markers: tuple[str, ...]) -> TextRule:
    """A remark that takes back the findings of its line, or those of the rules it names."""
    names = "|".join(rf"\Q{m}\E" for m in markers)
    blank = r"[\s&&[^\n]]*"
    pattern = rf"(?i)#{blank}(?:nosec\b|(?:{names}):{blank}ignore(?:\[([a-z0-9,_\- ]+)\])?)"
    return TextRule("", pattern, ("nosec", "ignore"), group=1, reads="lines")


def folded(text: Column) -> Column:
    """Lower-case text in which every letter that patterns take for an ASCII letter is one."""
    return F.lower(F.translate(text, "ſKıİ", "skii"))


def candidate(rule: TextRule, text: Column, small: Column, kind: Column) -> Column:
    """Does the rule match the text?  ``small`` is the folded text."""
    wanted = text.rlike(rule.regex())
    if rule.words:
        wanted = reduce(Column.__or__, [F.contains(small, F.lit(w)) for w in rule.words]) & wanted
    return (kind == "script") & wanted if rule.scripts_only else wanted


# Python calls by rule, modules that reach the network, and modes that write.
PYTHON_CALLS = {
    "eval": "exec-dynamic", "exec": "exec-dynamic", "compile": "exec-dynamic",
    "__import__": "exec-dynamic",
    "os.system": "shell-injection", "os.popen": "shell-injection",
    "shutil.rmtree": "fs-delete", "os.remove": "fs-delete", "os.unlink": "fs-delete",
    "os.rmdir": "fs-delete", "os.removedirs": "fs-delete",
}
NETWORK_MODULES = (
    "socket", "urllib", "http", "requests", "aiohttp", "httpx", "ftplib", "smtplib", "websockets",
)
WRITING = "[wax]"
