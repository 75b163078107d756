"""URL filters: pattern rules indexed by their rarest literal token.

Two kinds of rules decide. A host rule such as ``example.org/es/`` fits its host and all subdomains where the path starts
with the rule's; the longest one that fits wins. Where none fits, filter patterns decide: ``||`` is the start of the host or
of one of its labels, ``|`` an end of the URL, ``*`` anything, ``^`` a separator or the end; the rest is literal, without
case. A fitting allowing pattern beats blocking ones, and a URL that nothing fits is allowed.

Every rule becomes a regular expression and gets one token, the rarest in the URLs of those that each of its matches holds as
a whole run of ASCII letters and digits. The index, an array of buckets of rules by the hash of that token, is a literal of
the plan, so a URL looks its tokens up, and only the rules found run their expressions: one projection, without a shuffle or
a join. Rules without a whole token are in the list of every URL. Rules are a parameter and bounded by the caller.

NULL URLs and URLs without ``://`` have an empty host and path, and no host rule fits them; a NULL URL is allowed. Repeated
rows are judged alike; empty tables stay empty, and without URLs all tokens are equally rare.
"""

from __future__ import annotations

import json
import re
import string
import zlib
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The host rules of the query: action, host and path.
HOST_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: The method's own patterns: advertising, spam, and pages that hold forms, lists or no text.
PATTERNS = (
    ("block", "||ads-track."), ("block", "||ads."), ("block", "||adserver."), ("block", "||doubleclick.net^"),
    ("block", "||cheap-pills."), ("block", "||casino."), ("block", "||*.casino-*^"), ("block", "||free-coupons."),
    ("block", "/ads/"), ("block", "/adserver/*"), ("block", "/banners/*.gif|"), ("block", "/tracking-pixel^"),
    ("block", "/wp-login.php"), ("block", "/cart/checkout^"), ("block", "/search?*q="), ("block", "/tag/*/page/"),
    ("block", "?replytocom="), ("block", "&sessionid="), ("block", "^calendar^*date="), ("block", ".exe|"),
    ("allow", "/about-ads/"), ("allow", "||docs.*/search?"),
)

_WHOLE_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_ENTRY = "struct<token:string,by_host:boolean,allow:boolean,name:string,at:int,regex:string>"
_RUN = re.compile("[a-z0-9]+")


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return lowered(F.coalesce(F.regexp_extract(url, _WHOLE_URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _WHOLE_URL, 2), F.lit(""))


def tokens_of(url: Column) -> Column:
    """The distinct runs of ASCII letters and digits of a URL in lower case."""
    return F.array_distinct(F.split(lowered(F.coalesce(url, F.lit(""))), "[^a-z0-9]+"))


@dataclass(frozen=True)
class Rule:
    """A compiled rule; ``tokens`` are those that every URL it fits holds as whole runs."""

    name: str
    action: str
    by_host: bool
    regex: str
    tokens: tuple[str, ...]

    @staticmethod
    def host(action: str, host: str, path: str) -> Rule:
        """A rule on host and path, matched against the two together; a path is matched with its case."""
        body = host.lower() + path
        return Rule(body, action, True, r"^([^/]*\.)?" + re.escape(body), _whole_runs(body.lower(), True, False))

    @staticmethod
    def pattern(action: str, pattern: str) -> Rule:
        """A filter pattern, matched against the whole URL in lower case."""
        body = pattern.lower()
        start = "||" if body.startswith("||") else "|" if body.startswith("|") else ""
        body = body[len(start):]
        ended = body.endswith("|")
        body = body[: len(body) - ended]
        wild = {"*": ".*", "^": r"([^a-z0-9_.%-]|\z)"}
        middle = "".join(wild.get(c) or re.escape(c) for c in body)
        regex = {"||": r"^[^:]*://([^/?#]*\.)?", "|": "^", "": ""}[start] + middle + (r"\z" if ended else "")
        return Rule(pattern, action, False, "(?s)" + regex, _whole_runs(body, bool(start), ended))


def _whole_runs(body: str, start: bool, end: bool) -> tuple[str, ...]:
    """Runs of letters and digits that nothing can lengthen: no wildcard and no open end beside them."""
    runs = []
    for m in _RUN.finditer(body):
        before = body[m.start() - 1] != "*" if m.start() else start
        after = body[m.end()] != "*" if m.end() < len(body) else end
        if before and after:
            runs.append(m.group())
    return tuple(dict.fromkeys(runs))


def rules(
    host_rules: Iterable[tuple[str, str, str]] = HOST_RULES, patterns: Iterable[tuple[str, str]] = PATTERNS,
) -> list[Rule]:
    return [*(Rule.host(*r) for r in host_rules), *(Rule.pattern(*p) for p in patterns)]


def token_counts(pages: DataFrame, compiled: Sequence[Rule], url: str = "url") -> dict[str, int]:
    """In how many URLs each token of the rules stands; the driver gets at most one number per token of a rule."""
    vocabulary = sorted({t for r in compiled for t in r.tokens})
    known = F.from_json(F.lit(json.dumps(vocabulary)), "array<string>")
    hits = pages.select(F.explode(F.array_intersect(tokens_of(F.col(url)), known)).alias("token"))
    return {r["token"]: r["n"] for r in hits.groupBy("token").agg(F.count("*").alias("n")).collect()}


@dataclass(frozen=True)
class Index:
    """Rules by the hash of their rarest token, and those without one."""

    buckets: Column
    size: int
    always: Column
    tokens: tuple[str | None, ...]

    @staticmethod
    def build(compiled: Sequence[Rule], counts: dict[str, int]) -> Index:
        rarest = [min(r.tokens, key=lambda t: (counts.get(t, 0), -len(t), t), default=None) for r in compiled]
        size = max(1, 2 * len(compiled))
        buckets: list[list[dict]] = [[] for _ in range(size)]
        always: list[dict] = []
        for at, (rule, token) in enumerate(zip(compiled, rarest, strict=True)):
            entry = {"token": token, "by_host": rule.by_host, "allow": rule.action == "allow", "name": rule.name, "at": at, "regex": rule.regex}
            (always if token is None else buckets[_bucket(token, size)]).append(entry)
        return Index(
            F.from_json(F.lit(json.dumps(buckets)), f"array<array<{_ENTRY}>>"), size,
            F.from_json(F.lit(json.dumps(always)), f"array<{_ENTRY}>"), tuple(rarest),
        )

    def candidates(self, url: Column) -> Column:
        """The rules whose token the URL holds, and those without a token."""
        def bucket(token: Column) -> Column:
            found = F.get(self.buckets, F.pmod(F.crc32(token.cast("binary")), F.lit(self.size)).cast("int"))
            return F.filter(found, lambda r: r["token"] == token)

        return F.concat(F.flatten(F.transform(tokens_of(url), bucket)), self.always)


def _bucket(token: str, size: int) -> int:
    return zlib.crc32(token.encode()) % size


def matches(url: Column, index: Index) -> Column:
    """The rules that fit a URL: of the candidates, those whose regular expression does."""
    site = F.concat(host_of(url), path_of(url))
    whole = lowered(F.coalesce(url, F.lit("")))
    return F.filter(index.candidates(url), lambda r: F.rlike(F.when(r["by_host"], site).otherwise(whole), r["regex"]))


def judge(pages: DataFrame, index: Index, url: str = "url", out: str = "filter") -> DataFrame:
    """``pages`` with a struct column ``out``, which replaces one of that name: ``host``, ``path``, ``rule``, ``verdict``, ``patterns``.

    ``rule`` is the winning host rule, of equally long ones the first; ``patterns`` are the other rules that fit, in their order.
    """
    fitting = pages.withColumn(out, F.struct(host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), matches(F.col(url), index).alias("fit")))
    fit = F.col(out)["fit"]
    ranked = F.transform(F.filter(fit, lambda r: r["by_host"]), lambda r: F.struct(F.length(r["name"]).alias("n"), (-r["at"]).alias("first"), r["name"].alias("name"), r["allow"].alias("allow")))
    others = F.array_sort(F.filter(fit, lambda r: ~r["by_host"]), lambda a, b: a["at"] - b["at"])
    best = fitting.withColumn(out, F.struct(F.col(out)["host"].alias("host"), F.col(out)["path"].alias("path"), F.array_max(ranked).alias("best"), others.alias("others")))
    got, patterns = F.col(out)["best"], F.col(out)["others"]
    blocked = F.exists(patterns, lambda r: ~r["allow"]) & ~F.exists(patterns, lambda r: r["allow"])
    allowed = F.coalesce(got["allow"], ~blocked)
    return best.withColumn(out, F.struct(
        F.col(out)["host"].alias("host"), F.col(out)["path"].alias("path"), got["name"].alias("rule"),
        F.when(allowed, "allow").otherwise("block").alias("verdict"), F.transform(patterns, lambda r: r["name"]).alias("patterns"),
    ))


def filtered(pages: DataFrame, compiled: Sequence[Rule] | None = None, url: str = "url", out: str = "filter") -> DataFrame:
    """Count the rules' tokens over all URLs, index the rules and judge every row."""
    compiled = rules() if compiled is None else compiled
    return judge(pages, Index.build(compiled, token_counts(pages, compiled, url)), url, out)


def sql(compiled: Sequence[Rule], table: str = "pages", key: str = "page_id") -> str:
    """The same judgement in DuckDB's SQL, without an index: every rule against every URL."""
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    by_host = sorted((r for r in compiled if r.by_host), key=lambda r: -len(r.name))
    fits = [f"regexp_matches(host || path, {quoted(r.regex)})" for r in by_host]
    rule = "CASE " + " ".join(f"WHEN {c} THEN {quoted(r.name)}" for c, r in zip(fits, by_host, strict=True)) + " END"
    action = "CASE " + " ".join(f"WHEN {c} THEN '{r.action}'" for c, r in zip(fits, by_host, strict=True)) + " END"

    def any_of(action: str) -> str:
        return " OR ".join(f"regexp_matches(whole, {quoted(r.regex)})" for r in compiled if not r.by_host and r.action == action) or "false"

    upper, lower = quoted(string.ascii_uppercase), quoted(string.ascii_lowercase)
    return f"""
    WITH cut AS (
      SELECT {key}, translate(coalesce(url, ''), {upper}, {lower}) AS whole,
             CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
      FROM {table}),
    parts AS (
      SELECT {key}, whole, translate(regexp_extract(rest, '^[^/?#]*'), {upper}, {lower}) AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
      FROM cut)
    SELECT {key}, host, path, {rule} AS rule,
           coalesce({action}, CASE WHEN {any_of('allow')} THEN 'allow' WHEN {any_of('block')} THEN 'block' ELSE 'allow' END) AS verdict
    FROM parts"""
