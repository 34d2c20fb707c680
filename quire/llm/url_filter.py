"""URL filters: rules indexed by their rarest literal token.

A rule is (verdict, host, path): it fits its host and every subdomain when the URL's path starts with the
rule's path. Every rule is filed under one literal token that any fitting URL must hold: a label of its
host or a whole segment of its path, the one that the fewest rules share. A URL's own tokens fetch the
rules filed under them; only those run their regular expression, and the longest fit wins (ties: the
smaller rule text, then allow before block).

Everything is DataFrame functions. Up to INLINE_RULES rules the index is a map literal and no row moves.
Longer lists are joined by token, over the distinct (host, path) pairs, so copies of a URL cost one probe.

Defined cases: a null URL or one without `://` has the host '' and the path ''; it fits only rules without
host. A URL that no rule fits gets DEFAULT_VERDICT and a null rule. Rows are kept one for one, repeated rows
and clashing extra columns included; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, fresh

INLINE_RULES = 256
DEFAULT_VERDICT = "allow"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return f"{self.host}{self.path}"

    @property
    def pattern(self) -> str:
        """A Java regular expression over host followed by path."""
        quoted = lambda s: "".join(c if c.isalnum() else f"\\{c}" if c.isascii() else c for c in s)
        host = f"(?:[^/]*\\.)?{quoted(self.host)}" if self.host else "[^/]*"
        return f"\\A{host}{quoted(self.path)}" if self.path else f"\\A{host}(?=/|\\z)"


def parse_rule(verdict: str, text: str) -> Rule:
    host, slash, rest = text.partition("/")
    return Rule(verdict, host, slash + rest)


def literal_tokens(rule: Rule) -> list[str]:
    """Tokens that each fitting URL holds: host labels, and path segments that the rule's path closes."""
    labels = [f"h:{x}" for x in rule.host.split(".") if x]
    closed = rule.path.split("/")[1:-1]
    return labels + [f"p:{x}" for x in closed if x]


def index_rules(rules: Sequence[Rule]) -> dict[str, list[Rule]]:
    """Rules by their rarest literal token; those without one under ''."""
    shared = Counter(t for r in rules for t in set(literal_tokens(r)))
    filed: dict[str, list[Rule]] = {}
    for r in sorted(set(rules)):
        key = min(literal_tokens(r), key=lambda t: (shared[t], -len(t), t), default="")
        filed.setdefault(key, []).append(r)
    return filed


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(host: Column, path: Column) -> Column:
    labels = F.transform(F.split(host, "\\."), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(labels, segments, F.array(F.lit(""))))


def _rule_struct(r: Rule) -> Column:
    # The order of the fields is the order of preference for array_max.
    return F.struct(
        F.lit(len(r.text)).alias("length"),
        F.lit(r.text).alias("rule"),
        F.lit(r.verdict).alias("verdict"),
        F.lit(r.pattern).alias("pattern"),
    )


def _best(candidates: Column, subject: Column) -> Column:
    fitting = F.filter(candidates, lambda r: F.regexp_like(subject, r["pattern"]))
    longest = F.array_max(F.transform(fitting, lambda r: r["length"]))
    ties = F.filter(fitting, lambda r: r["length"] == longest)
    return F.array_min(F.transform(ties, lambda r: F.struct(r["rule"], r["verdict"])))


def filter_urls(pages: DataFrame, rules: Sequence[Rule], url: str = "url", inline_rules: int = INLINE_RULES) -> DataFrame:
    """pages with host, path, rule and verdict; such columns of pages are replaced, whatever their case."""
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    (best,) = fresh(pages, "best")
    parts = pages.select(*kept, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rules = sorted(set(rules))
    if not rules:
        return parts.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(DEFAULT_VERDICT)})
    subject, tokens = F.concat("host", "path"), url_tokens(F.col("host"), F.col("path"))
    if len(rules) <= inline_rules:
        filed = index_rules(rules)
        index = F.create_map(*[x for k, rs in filed.items() for x in (F.lit(k), F.array(*map(_rule_struct, rs)))])
        known = F.array(*[F.lit(k) for k in filed])
        fetched = F.flatten(F.transform(F.array_intersect(tokens, known), lambda t: index[t]))
        return _judged(parts.withColumn(best, _best(fetched, subject)), kept, best)
    rows = [(k, len(r.text), r.text, r.verdict, r.pattern) for k, rs in index_rules(rules).items() for r in rs]
    table = pages.sparkSession.createDataFrame(rows, "token string, length int, rule string, verdict string, pattern string")
    distinct = parts.select("host", "path").distinct()
    fits = (
        distinct.select("host", "path", F.explode(tokens).alias("token"))
        .join(table, "token")
        .filter(F.regexp_like(subject, F.col("pattern")))
        .groupBy("host", "path")
        .agg(F.min(F.struct((-F.col("length")).alias("rank"), "rule", "verdict")).alias(best))
    )
    return _judged(parts.join(fits, ["host", "path"], "left"), kept, best)


def _judged(found: DataFrame, kept: list[Column], best: str) -> DataFrame:
    rule, verdict = (F.col(best)[x] for x in ("rule", "verdict"))
    return found.select(*kept, "host", "path", rule.alias("rule"), F.coalesce(verdict, F.lit(DEFAULT_VERDICT)).alias("verdict"))


#: The production rules of the query op4.
RULES = [
    parse_rule("block", "com/en/"),
    parse_rule("allow", "example.com/en/7"),
    parse_rule("allow", "net/de/"),
    parse_rule("block", "example.net/de/8"),
    parse_rule("block", "org/es/"),
]


def matches(rule: Rule, host: str, path: str) -> bool:
    """The brute-force reading of a rule, for tests and for small tools."""
    return bool(re.match(rf"(?:.*\.)?{re.escape(rule.host)}\Z", host, re.S) if rule.host else True) and path.startswith(rule.path)
