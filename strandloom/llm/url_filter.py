"""Verdicts on urls: host and path rules, and a weighted vocabulary that one automaton finds in a pass."""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch

# (host, path, verdict) of the query.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
# The vocabulary: one strict term rejects, as do SOFT_LEAST different soft ones.
STRICT = ("porn", "porno", "xxx", "hentai", "escort", "escorts", "casino", "viagra", "warez", "torrent")
SOFT = ("ad", "ads", "adserver", "banner", "bet", "bonus", "cheap", "click", "coupon", "deal", "doubleclick", "free", "loan", "pills", "poker", "popup", "promo", "redirect", "sex", "slots", "spam", "sponsor", "tag", "track", "tracker", "tracking", "utm", "win")
SOFT_LEAST = 2
PARTS = re.compile(r"(?s).*?://([^/?#]*)([^?#]*)")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(url: str) -> tuple[str, str]:
    """Host, with A-Z lower-cased, and path of a url; both empty without ://."""
    found = PARTS.match(url)
    return (found[1].translate(LOWER), found[2]) if found else ("", "")


def fitting(host: str, path: str, rules: dict[str, list[tuple[str, str]]]) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule, host and path together, that fits; equally long ones: the longer host."""
    best, at = None, 0
    while host and at >= 0:
        own = host[at:]
        for prefix, verdict in rules.get(own, ()):
            if path.startswith(prefix) and (best is None or len(own) + len(prefix) > len(best[0])):
                best = (own + prefix, verdict)
        at = host.find(".", at) + 1 or -1
    return best


def vocabulary(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for kind, terms in (("soft", soft), ("strict", strict)):  # a term of both is strict
        for t in terms:
            out.add_word(t.translate(LOWER), (kind, t.translate(LOWER)))
    out.make_automaton()
    return out


def hits(url: str, terms: ahocorasick.Automaton) -> tuple[list[str], ...]:
    """The different strict and soft terms of a url, sorted, with neither a letter nor a digit before or after.

    Overlapping terms all count. Escapes such as %20 are read as they stand.
    """
    text, found = url.translate(LOWER), set()
    for last, (kind, term) in terms.iter(text):
        first = last + 1 - len(term)
        if not (first and text[first - 1].isalnum()) and not (last + 1 < len(text) and text[last + 1].isalnum()):
            found.add((kind, term))
    return tuple(sorted(t for k, t in found if k == kind) for kind in ("strict", "soft"))


def judged(pages: DataFrame, rules: tuple = RULES, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT, least: int = SOFT_LEAST) -> DataFrame:
    """(page_id, host, path, rule, verdict, strict, soft) of every row of pages(page_id, url), in one pass without a shuffle.
    strict and soft are the different terms found, sorted and comma-joined.

    A rule (host, path, verdict) fits its host and its subdomains where the path starts with the rule's; the longest
    wins, and no term is heard. Otherwise one strict term or `least` different soft ones block. A null url is an empty
    one: no host, no rule, allowed. Repeated rows are judged alike, null ids kept; no rows give no rows. Rules and
    terms are parameters that go with the tasks, so as many as a task can hold.
    """
    if any(not t for t in (*strict, *soft)):
        raise ValueError("an empty term is in every url")
    by_host: dict[str, list[tuple[str, str]]] = {}
    for host, path, verdict in rules:
        by_host.setdefault(host.translate(LOWER), []).append((path, verdict))

    def judge(batch: pa.RecordBatch) -> dict:
        terms = vocabulary(strict, soft)  # a few dozen words a batch; an automaton is not sent
        out: dict[str, list] = {c: [] for c in ("host", "path", "rule", "verdict", "strict", "soft")}
        for url in batch.column("url").to_pylist():
            host, path = split(url or "")
            rule = fitting(host, path, by_host)
            hard, weak = hits(url or "", terms)
            said = rule[1] if rule else "block" if hard or len(weak) >= least else "allow"
            for c, v in zip(out, (host, path, rule and rule[0], said, ",".join(hard), ",".join(weak))):
                out[c].append(v)
        return {"page_id": batch.column("page_id")} | out

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url")
    return per_batch(rows, judge, "page_id long, host string, path string, rule string, verdict string, strict string, soft string")


def oracle() -> str:
    """The query in SQL. Boundaries are there by regular expression, a term at a time."""

    def found(terms: tuple[str, ...]) -> str:
        cases = (f"CASE WHEN regexp_matches(low, '(^|[^\\p{{L}}\\p{{N}}]){t}($|[^\\p{{L}}\\p{{N}}])') THEN '{t}' END" for t in sorted(terms))
        return f"concat_ws(',', {', '.join(cases)})"

    fits = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p} {v}'" for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1])))
    return f"""
WITH parts AS (
  SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages),
ruled AS (SELECT *, CASE {fits} END AS fit, {found(STRICT)} AS strict, {found(SOFT)} AS soft FROM parts)
SELECT page_id, host, path, split_part(fit, ' ', 1) AS rule,
  CASE WHEN fit IS NOT NULL THEN split_part(fit, ' ', 2) WHEN strict <> '' OR len(string_split(soft, ',')) >= {SOFT_LEAST} THEN 'block' ELSE 'allow' END AS verdict, strict, soft
FROM ruled"""
