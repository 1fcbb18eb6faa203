"""Hosts named in JSON values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts and domains whose presence only lowers a finding.
TRUSTED_HOSTS = ("localhost", "127.0.0.1", "::1", "0.0.0.0")
TRUSTED_DOMAINS = (
    "amazonaws.com", "cloudfront.net", "googleapis.com", "googleusercontent.com",
    "azure.com", "azurewebsites.net", "windows.net", "cloudflare.com",
    "fastly.net", "akamai.net", "openai.com", "anthropic.com",
    "modelcontextprotocol.io",
)

# URL and bare-domain shapes.
_URL = r"(?i)(?:https?|wss?)://([A-Za-z0-9.\-]+)(?::[0-9]+)?"
_BARE = r"^[a-z0-9.\-]+\.[a-z]{2,}$"
_NETLOC = r"(?i)https?://([^/\s\"'<>\\]+)"


def string_values(json_text: Column) -> Column:
    """All string values (not keys) inside compact JSON text.

    Escapes become one neutral character each (white space for white space), which
    leaves hosts untouched and makes every remaining quote a delimiter.
    """
    opened = F.regexp_replace(json_text, r"\\([^ntrfu])", "\u0001")
    spaced = F.regexp_replace(opened, r"\\[ntrf]", " ")
    plain = F.regexp_replace(spaced, r"\\u[0-9a-fA-F]{4}", "\u0001")
    # a key is consumed with its colon and leaves the group empty
    found = F.regexp_extract_all(plain, F.lit(r'"[^"]*":|"([^"]*)"'), F.lit(1))
    return F.filter(found, lambda v: v != "")


def egress_hosts(value: Column) -> Column:
    """Lower-case hosts of a VARIANT: URLs in any string, and strings that are a domain."""
    text = F.to_json(value)
    # a host needs a scheme or a dot; other texts skip the work
    nameable = F.contains(text, F.lit("://")) | F.contains(text, F.lit("."))
    strings = string_values(F.when(nameable, text))
    in_urls = F.flatten(
        F.transform(strings, lambda s: F.regexp_extract_all(s, F.lit(_URL), F.lit(1)))
    )
    trimmed = F.transform(strings, lambda s: F.lower(F.trim(s)))
    found = F.array_distinct(
        F.concat(
            F.transform(in_urls, lambda h: F.lower(h)),
            F.filter(trimmed, lambda s: s.rlike(_BARE)),
        )
    )
    return F.coalesce(found, F.array().cast("array<string>"))


def netloc_hosts(text: Column) -> Column:
    """Hosts of http(s) URLs in a text: user part and trailing punctuation cut, port kept."""
    found = F.regexp_extract_all(text, F.lit(_NETLOC), F.lit(1))
    hosts = F.transform(
        found,
        lambda n: F.lower(F.regexp_replace(F.substring_index(n, "@", -1), r"[.,;:)\]}\"']+$", "")),
    )
    return F.array_distinct(F.filter(hosts, lambda h: h != ""))


def is_trusted(host: Column) -> Column:
    """The host is trusted, or equals or lies under a trusted domain."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    return host.isin(*TRUSTED_HOSTS) | F.arrays_overlap(
        suffixes, F.array(*[F.lit(d) for d in TRUSTED_DOMAINS])
    )
