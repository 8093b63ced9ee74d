"""URL filters: pattern rules behind an index by their rarest literal token; DataFrame functions only.

A rule is a regular expression over ``host + path`` with literal tokens that any matching URL must have. A pass over
all URLs counts how many of them have each of the rules' tokens; a rule is then filed under its rarest one. Judging a
URL looks up its own tokens, and only the rules found so run their regular expressions (rules without any literal
token run on all). Of the rules that match, the longest wins, then the largest by name.

The index is a hash table in the plan: an array of buckets of rules, a token's bucket being its crc32 modulo their
number, so a look-up reads one bucket whatever the number of rules, no row is moved and no URL or host can be hot.
Its size follows the list of rules the caller passes, which ``MAX_RULES`` bounds, not the data.

Edge cases: a null URL, or one without ``://``, has empty host and path and only rules that match the empty string
could hold; no rule at all leaves the default verdict; repeated URLs are judged alike, each row for itself; an empty
table gives an empty result; extra columns pass through, those that have the name of an output are replaced.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RULES = 50_000
_OUT = ("host", "path", "rule", "verdict", "by")
_CUT = "[^0-9A-Za-z\\u0080-\\x{10FFFF}]+"


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    pattern: str  # found anywhere in host + path, so anchor it
    tokens: tuple[str, ...]
    weight: int  # the largest of the matching rules' weights wins
    kind: str = "rule"


def _tokens(text: str) -> list[str]:
    return [t.lower() for t in re.split("[^0-9A-Za-z\\u0080-\\U0010ffff]+", text) if t]


def domain_rule(verdict: str, host: str, path: str = "/") -> Rule:
    """A rule for ``host`` and its subdomains whose path starts with ``path``."""
    pattern = "^(?:[^/]*\\.)?" + re.escape(host) + re.escape(path)
    whole = path[: path.rfind("/") + 1]  # a path segment without its end may be part of a longer token
    return Rule(host + path, verdict, pattern, tuple(_tokens(host) + _tokens(whole)), len(host + path))


#: The contract's domain rules.
DOMAIN_RULES = (
    domain_rule("allow", "com"),
    domain_rule("block", "example.com", "/en/"),
    domain_rule("allow", "www.example.com", "/en/"),
    domain_rule("block", "net", "/es/"),
    domain_rule("block", "net", "/fr/"),
)
#: What the method itself blocks where no domain rule fits: hosts and paths that serve no text of their own, as
#: (name, regular expression, literal tokens that any match has whole). Fixed values.
PATTERNS = (
    ("admin pages of wp", "(?i)/wp-admin(?:/|$)", ("wp", "admin")),
    ("login of wp", "(?i)/wp-login[.]php$", ("wp", "login", "php")),
    ("remote calls", "(?i)/xmlrpc[.]php$", ("xmlrpc", "php")),
    ("scripts", "(?i)/cgi-bin/", ("cgi", "bin")),
    ("sessions", "(?i);jsessionid=", ("jsessionid",)),
    ("login", "(?i)/(?:user|users|account|accounts|member|members)/login(?:/|[.]|$)", ("login",)),
    ("sign up", "(?i)/(?:user|users|account|accounts|member|members)/sign[-_]?up(?:/|[.]|$)", ()),
    ("cart", "(?i)/cart/checkout(?:/|$)", ("cart", "checkout")),
    ("ad servers", "(?i)^ads[0-9]*[.]", ()),
    ("pixels", "(?i)/(?:pixel|spacer|blank)[.]gif$", ("gif",)),
    ("adult dating", "(?i)(?:^|[-_./])adult[-_./]+dating(?:[-_./]|$)", ("adult", "dating")),
    ("online casino", "(?i)(?:^|[-_./])casino[-_./]+bonus(?:[-_./]|$)", ("casino", "bonus")),
    ("cheap pills", "(?i)(?:^|[-_./])(?:buy|cheap)[-_./]+viagra(?:[-_./]|$)", ("viagra",)),
    ("cracked software", "(?i)(?:keygen|serial)[-_./]+(?:crack|download)", ()),
    ("torrents", "(?i)/torrent/[^/]+/download(?:/|$)", ("torrent", "download")),
)
METHOD_RULES = tuple(Rule(name, "block", pattern, tokens, -1, "method") for name, pattern, tokens in PATTERNS)


def with_parts(pages: DataFrame, url: str) -> DataFrame:
    """Adds host (A-Z lower-cased) and path."""
    u = F.col(url)
    at = F.locate("://", u)
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return pages.withColumn("host", F.translate(host, upper, lower)).withColumn("path", path)


def url_tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.split(F.lower(F.concat_ws("/", host, path)), _CUT))


def token_counts(parted: DataFrame, rules: tuple[Rule, ...]) -> dict[str, int]:
    """How many rows have each token of the rules; rows of the result: tokens of the rules."""
    wanted = sorted({t for r in rules for t in r.tokens})
    spark = parted.sparkSession
    table = spark.createDataFrame([(t,) for t in wanted], "token string")
    tokens = parted.select(F.explode(url_tokens(F.col("host"), F.col("path"))).alias("token"))
    counts = tokens.join(F.broadcast(table), "token").groupBy("token").agg(F.count("*").alias("n"))
    return {r.token: r.n for r in counts.collect()} if wanted else {}


def index(rules: tuple[Rule, ...], counts: dict[str, int]) -> tuple[list[list[dict]], list[dict]]:
    """(buckets of rules, the rules that have no token)."""
    buckets: list[list[dict]] = [[] for _ in range(max(8, 2 * len(rules)))]
    always = []
    for r in sorted(rules, key=lambda r: (-r.weight, r.name)):
        entry = {"token": "", "name": r.name, "verdict": r.verdict, "pattern": r.pattern, "weight": r.weight, "kind": r.kind}
        if r.tokens:
            entry["token"] = min(r.tokens, key=lambda t: (counts.get(t, 0), t))
            buckets[zlib.crc32(entry["token"].encode()) % len(buckets)].append(entry)
        else:
            always.append(entry)
    return buckets, always


_ENTRY = "struct<token:string,name:string,verdict:string,pattern:string,weight:int,kind:string>"


def judge(pages: DataFrame, rules: tuple[Rule, ...] = (*DOMAIN_RULES, *METHOD_RULES), url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (the winning domain rule, or null), verdict, and by (rule, method or default)."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; the index in the plan is bounded by MAX_RULES = {MAX_RULES}")
    if again := [n for n, k in Counter((r.name, r.kind) for r in rules).items() if k > 1]:
        raise ValueError(f"rules of one name: {again[:5]}")
    parted = with_parts(pages.drop(*[c for c in _OUT if c in pages.columns]), url)
    buckets, always = index(rules, token_counts(parted, rules))
    table = F.from_json(F.lit(json.dumps(buckets)), f"array<array<{_ENTRY}>>")
    rest = F.from_json(F.lit(json.dumps(always)), f"array<{_ENTRY}>")
    bucket = lambda t: F.get(table, F.pmod(F.crc32(t), F.lit(len(buckets))).cast("int"))
    found = F.flatten(F.transform(F.col("__tokens"), lambda t: F.filter(bucket(t), lambda r: r.token == t)))
    fits = F.filter(F.concat(found, rest), lambda r: F.regexp_like(F.col("__target"), r.pattern))
    best = F.array_max(F.transform(fits, lambda r: F.struct(r.weight.alias("w"), r["name"].alias("name"), r.verdict.alias("verdict"), r.kind.alias("kind"))))
    out = parted.withColumn("__target", F.concat("host", "path")).withColumn("__tokens", url_tokens(F.col("host"), F.col("path")))
    out = out.withColumn("__best", best)
    return out.select(
        *parted.columns,
        F.when(F.col("__best.kind") == "rule", F.col("__best.name")).alias("rule"),
        F.coalesce("__best.verdict", F.lit(default)).alias("verdict"),
        F.coalesce("__best.kind", F.lit("default")).alias("by"),
    )
