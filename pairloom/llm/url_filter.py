"""URL filters: pattern rules indexed by their rarest literal token.

A rule's pattern is `host/path-prefix` (the host and its subdomains, paths that start so); `^literal^`, a literal in host
and path that stands between separators (anything but A-Z, a-z, 0-9) or at an end; or `*literal*`, one anywhere. The
letters A to Z of literals are met in either case. Each rule is filed under one token that any URL it fits must contain whole, the one that fewest URLs
contain; a rule without such a token is filed under the rarest GRAM characters of its literal. A URL's distinct tokens, and
if any rule is filed so its grams, fetch candidate rules from a hash table, and only candidates run their regular expression.
There is no rule that is tried on every URL: one with neither a token nor GRAM characters is refused.

The hash table is one constant of the plan, parsed once from JSON: no join and no shuffle of URLs, no Python. MAX_RULES
bounds its size and MAX_PATTERN that of a rule; more or longer ones are an error.

Defined cases: a null URL or one without `://` has an empty host and path, fits no rule and is allowed. Repeated rows
are judged alike; repeated rules count once; a very long URL is judged whole. An empty table gives an empty result, with no
rules every URL is allowed. Extra columns of the input pass through unless they clash with an output column, which wins.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RULES, MAX_PATTERN = 100_000, 400
TOKEN = r"[a-z0-9]+"
GRAM = 3
#: Begins a gram's key in the table; no token holds it.
GRAM_MARK = "~"


def _lower(s: str) -> str:
    """A-Z to a-z, other letters as they are, like `lowered`."""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    pattern: str
    verdict: str  # allow or block

    @property
    def literal(self) -> str:
        """What stands as it is in every URL that the rule fits, but for the case of letters."""
        if self.pattern[:1] in ("*", "^"):
            return self.pattern[1:-1] if self.pattern[-1:] == self.pattern[:1] and len(self.pattern) > 1 else self.pattern[1:]
        return self.pattern

    @property
    def regex(self) -> str:
        """Java regular expression over host + path."""
        if self.pattern.startswith("*"):
            return "(?i)" + re.escape(self.literal)
        if self.pattern.startswith("^"):
            return "(?i)(?:^|[^a-z0-9])" + re.escape(self.literal) + "(?:$|[^a-z0-9])"
        host, _, path = self.pattern.partition("/")
        return r"^(?:[^/]*\.)?" + re.escape(host) + re.escape("/" + path)

    def keys(self) -> list[str]:
        """Tokens that stand whole, between other characters, in whatever the rule fits; without any, its grams."""
        body = _lower(self.literal)
        ends = (self.pattern.startswith("^"), self.pattern.startswith("^")) if self.pattern[:1] in ("*", "^") else (True, False)
        # a token at an end of the literal may go on in the URL, unless a separator or the host's start stands there
        whole = [m[0] for m in re.finditer(TOKEN, body) if (m.start() > 0 or ends[0]) and (m.end() < len(body) or ends[1])]
        return whole or [GRAM_MARK + body[i : i + GRAM] for i in range(len(body) - GRAM + 1)]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, url.substr(at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    return lowered(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def url_keys(where: Column, grams: bool) -> Column:
    """The distinct tokens of host + path, in small letters, and its grams if any rule is filed under one."""
    small = lowered(where)
    tokens = F.regexp_extract_all(small, F.lit(TOKEN), F.lit(0))
    if grams:
        every = F.regexp_extract_all(small, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1))
        tokens = F.concat(tokens, F.transform(every, lambda g: F.concat(F.lit(GRAM_MARK), g)))
    return F.array_distinct(tokens)


def key_counts(urls: DataFrame, url: str, keys: list[str]) -> dict[str, int]:
    """How many URLs contain each of the rules' keys: at most as many rows come to the driver as the rules have keys."""
    host, path = host_and_path(F.col(url))
    own = F.broadcast(urls.sparkSession.range(1).select(F.explode(F.from_json(F.lit(json.dumps(keys)), "array<string>")).alias("key")))
    found = urls.select(F.explode(url_keys(F.concat(host, path), any(k.startswith(GRAM_MARK) for k in keys))).alias("key"))
    return {r["key"]: r["n"] for r in found.join(own, "key").groupBy("key").agg(F.count(F.lit(1)).alias("n")).collect()}


def filed(rules: list[Rule], counts: dict[str, int]) -> list[str]:
    """The key that each rule is filed under."""
    return [min(rule.keys(), key=lambda t: (counts.get(t, 0), -len(t), t)) for rule in rules]


KIND = "array<array<struct<rank:int,key:string,first:boolean,pattern:string,regex:string,verdict:string>>>"


def rule_table(rules: list[tuple], size: int) -> Column:
    """Rows (rank, key, first, pattern, regex, verdict) as one array of `size` buckets, by the key's crc32: a constant."""
    buckets: list[list[dict]] = [[] for _ in range(size)]
    for r in rules:
        buckets[zlib.crc32(r[1].encode()) % size].append(dict(zip(("rank", "key", "first", "pattern", "regex", "verdict"), r, strict=True)))
    return F.from_json(F.lit(json.dumps(buckets)), KIND)


def url_filter(pages: DataFrame, rules: list[Rule], fallback: list[Rule] = (), url: str = "url") -> DataFrame:
    """pages with host, path, rule, pattern_rule and verdict.

    Of the rules that fit, the longest pattern wins, then the smaller in code-point order. Where none of `rules` fits,
    the same holds among `fallback`, whose pattern goes to pattern_rule; where none fits either, the URL is allowed.
    """
    both = list(dict.fromkeys((r, True) for r in rules)) + list(dict.fromkeys((r, False) for r in fallback))
    host, path = host_and_path(F.col(url))
    out = pages.withColumns({"host": host, "path": path})
    if not both:
        return out.withColumns({"rule": F.lit(None).cast("string"), "pattern_rule": F.lit(None).cast("string"), "verdict": F.lit("allow")})
    if len(both) > MAX_RULES:
        raise ValueError(f"{len(both)} rules; the table holds {MAX_RULES} at most")
    for r, _ in both:
        if not r.keys() or len(r.pattern) > MAX_PATTERN:
            raise ValueError(f"a rule needs a whole token or {GRAM} characters, and {MAX_PATTERN} at most: {r.pattern!r}")
    own = [r for r, _ in both]
    keys = filed(own, key_counts(pages, url, sorted({t for r in own for t in r.keys()})))

    # precedence: rules before fallback, then the longer pattern, then the smaller in code-point order
    ranked = sorted(range(len(both)), key=lambda k: (not both[k][1], -len(own[k].pattern), own[k].pattern, k))
    rows = [(len(both) - i, keys[k], both[k][1], own[k].pattern, own[k].regex, own[k].verdict) for i, k in enumerate(ranked)]
    size = 1 << max(3, len(rows).bit_length())
    where = F.concat(F.col("host"), F.col("path"))
    found = url_keys(where, any(k.startswith(GRAM_MARK) for k in keys))

    table = rule_table(rows, size)
    fetched = F.flatten(F.transform(found, lambda t: F.filter(F.element_at(table, (F.crc32(t.cast("binary")) % size + 1).cast("int")), lambda r: r["key"] == t)))
    best = F.array_max(F.filter(fetched, lambda r: F.rlike(where, r["regex"])))
    return (
        out.withColumn("_best", best)
        .withColumns({
            "rule": F.when(F.col("_best.first"), F.col("_best.pattern")),
            "pattern_rule": F.when(~F.col("_best.first"), F.col("_best.pattern")),
            "verdict": F.coalesce(F.col("_best.verdict"), F.lit("allow")),
        })
        .drop("_best")
    )
