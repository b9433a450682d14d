"""URL filters on DataFrame functions alone.

Every rule is filed under one literal token that its URLs must hold: the one that is rarest among the
table's URLs (ties: the smaller token). The index is a hash table: one constant array of slots, a token's
slot following from its hash, so a URL's tokens fetch their rules without regard to how many rules there
are, and only the rules fetched run their regular expression. The rule list is a parameter held by the
driver, of at most ``MOST_RULES`` rules, so nothing that grows with the table is collected or broadcast.

Defined results: a null url, or one without ``://``, has an empty host and path and fits no rule; ports
and user names are part of the host; patterns do not tell A-Z from a-z, listed rules do in paths; null
ids stay, repeated rows are judged alike, and other columns are kept out.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MOST_RULES = 10_000


@dataclass(frozen=True)
class Rule:
    """A verdict for URLs. ``regex`` runs on host + path (lower-cased for rules that are not listed); ``literals`` are tokens that each match holds."""

    name: str
    verdict: str
    regex: str
    literals: tuple[str, ...]
    listed: bool  # a rule of the list: the longest one wins over all patterns

    @classmethod
    def prefix(cls, name: str, verdict: str) -> Rule:
        """``host/path``: the host with all its subdomains, and paths that start with the path."""
        host = name.split("/", 1)[0]
        return cls(name, verdict, r"\A(?:[^/]*\.)?" + re.escape(host) + re.escape(name[len(host) :]), _tokens(name), True)

    @classmethod
    def pattern(cls, text: str, verdict: str = "block") -> Rule:
        """A pattern over host and path: ``*`` stands for any text, ``^`` for one separator or the end, a leading ``||`` for
        the host or one of its parent domains, ``|`` at an end for the begin or the end; else it may lie anywhere."""
        body = text.translate(str.maketrans(UPPER, LOWER))
        domain, start = body.startswith("||"), body.startswith("|")
        stop = body.endswith("|")
        body = body.lstrip("|").rstrip("|")
        parts = {"*": r"[\s\S]*", "^": r"(?:[^a-z0-9_.%-]|\z)"}
        regex = (r"\A(?:[^/]*\.)?" if domain else r"\A" if start else "") + "".join(parts.get(c) or re.escape(c) for c in body) + (r"\z" if stop else "")
        bounded = ("." if start else "*") + body + ("." if stop else "*")  # tokens beside an open end may go on there
        return cls(text, verdict, regex, _tokens(re.sub(r"(?<=\*)[a-z0-9]+|[a-z0-9]+(?=\*)", ".", bounded)), False)

    @classmethod
    def word(cls, word: str, verdict: str = "block") -> Rule:
        """A whole word among the hyphenated parts of the host's labels."""
        return cls(word, verdict, rf"\A(?:[^/]*[.-])?{re.escape(word)}(?:[.:/-]|\z)", _tokens(word), False)


def _tokens(text: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(t for t in re.split("[^a-z0-9]+", text.translate(str.maketrans(UPPER, LOWER))) if t))


#: The list that the registered query applies.
LISTED = (
    Rule.prefix("net/", "block"),
    Rule.prefix("example.net/en/", "allow"),
    Rule.prefix("example.com/de/", "block"),
    Rule.prefix("org/fr/", "allow"),
)
#: Words in host names that block a URL to which no listed rule applies.
WORDS = ("adult", "ads", "bets", "betting", "casino", "escort", "loans", "pills", "poker", "porn", "spam", "tracker", "viagra", "warez", "xxx")
#: Places of advertising, tracking and login pages that block a URL to which no listed rule applies.
PATTERNS = ("||ads.*/banner/", "/track/*.gif|", "/cgi-bin/*.exe|", "/wp-login.php^", "^affiliate^*^click^", "||doorway.*^redirect^", "/xmlrpc.php|", "^utm-spam^")
DEFAULT_RULES = (*LISTED, *map(Rule.word, WORDS), *map(Rule.pattern, PATTERNS))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(_host(url), UPPER, LOWER)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def _host(url: Column) -> Column:
    return F.substring_index(F.substring_index(F.substring_index(_rest(url), "/", 1), "?", 1), "#", 1)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    rest = _rest(url)
    after = F.substring(rest, F.length(_host(url)) + 1, F.length(rest))
    return F.substring_index(F.substring_index(after, "?", 1), "#", 1)


def _url_tokens(host: str, path: str) -> Column:
    return F.array_distinct(F.split(F.concat(F.col(host), F.translate(F.col(path), UPPER, LOWER)), "[^a-z0-9]+"))


def _slot(token: Column, slots: int) -> Column:
    return F.pmod(F.crc32(token.cast("binary")), F.lit(slots)).cast("int")


def _index(rules: Sequence[Rule], rarity: dict[str, int]) -> tuple[Column, int]:
    """The hash table, as a constant array of slots that hold rules with their tokens, and the number of slots."""
    slots = 1 << max(4, (2 * len(rules)).bit_length())
    table: list[list[dict]] = [[] for _ in range(slots)]
    for r in rules:
        token = min(r.literals, key=lambda t: (rarity.get(t, 0), t))
        table[zlib.crc32(token.encode()) % slots].append({"token": token, "regex": r.regex, "listed": r.listed, "size": len(r.name), "name": r.name, "verdict": r.verdict})
    kind = "array<array<struct<token: string, regex: string, listed: boolean, size: int, name: string, verdict: string>>>"
    return F.from_json(F.lit(json.dumps(table)), kind), slots


def filter_urls(pages: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule (the longest listed rule that fits, else null), verdict, patterns (of the
    unlisted rules that fit, sorted). Where no listed rule fits, a blocking pattern blocks and else the URL is allowed."""
    if not rules:
        raise ValueError("there are no rules")
    if len(rules) > MOST_RULES or any(not r.literals for r in rules):
        raise ValueError(f"at most {MOST_RULES} rules, each with a literal token")
    split = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    known = pages.sparkSession.createDataFrame([(t,) for t in sorted({t for r in rules for t in r.literals})], "token string")
    tokens = split.select(F.explode(_url_tokens("host", "path")).alias("token"))
    counted = tokens.join(F.broadcast(known), "token").groupBy("token").count()  # the rules' tokens, bounded by MOST_RULES
    index, slots = _index(rules, {t: n for t, n in counted.collect()})  # a row for each literal token of the rules at most
    subject = F.concat("host", "path")
    fetched = split.withColumn("subject", subject).withColumn("lowered", F.translate(subject, UPPER, LOWER))
    own = lambda t: F.filter(F.element_at(index, _slot(t, slots) + 1), lambda r: r["token"] == t)
    fetched = fetched.withColumn("fetched", F.flatten(F.transform(_url_tokens("host", "path"), own)))
    fits = fetched.withColumn("fits", F.filter("fetched", lambda r: F.rlike(F.when(r["listed"], F.col("subject")).otherwise(F.col("lowered")), r["regex"])))
    best = fits.withColumn("best", F.array_max(F.transform(F.filter("fits", lambda r: r["listed"]), lambda r: F.struct(r["size"], r["name"], r["verdict"]))))
    return best.select(
        F.col(key),
        "host",
        "path",
        F.col("best.name").alias("rule"),
        F.coalesce("best.verdict", F.when(F.exists("fits", lambda r: ~r["listed"] & (r["verdict"] == "block")), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.array_join(F.array_sort(F.transform(F.filter("fits", lambda r: ~r["listed"]), lambda r: r["name"])), ",").alias("patterns"),
    )


def oracle(rules: Sequence[Rule] = DEFAULT_RULES) -> str:
    """DuckDB SQL for ``filter_urls`` over ``pages``."""
    text = lambda x: "'" + x.replace("'", "''") + "'"
    listed = ", ".join(f"('{r.name}', '{r.name.split('/', 1)[0]}', '{r.name[r.name.index('/') :]}', '{r.verdict}')" for r in rules if r.listed)
    others = ", ".join(f"({text(r.name)}, {text(r.verdict)}, {text(r.regex)})" for r in rules if not r.listed)
    return f"""
WITH cut AS (
  SELECT page_id, CASE WHEN coalesce(strpos(url, '://'), 0) > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosted AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut),
parts AS (
  SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path,
         row_number() OVER () AS n FROM hosted),
listed(name, h, p, v) AS (VALUES {listed}),
best AS (
  SELECT n, arg_max(name, length(name)) AS rule, arg_max(v, length(name)) AS verdict
  FROM parts JOIN listed ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n),
others(name, v, regex) AS (VALUES {others}),
fitting AS (
  SELECT n, string_agg(name, ',' ORDER BY name) AS patterns, bool_or(v = 'block') AS blocked
  FROM parts JOIN others ON regexp_matches(translate(host || path, '{UPPER}', '{LOWER}'), regex) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict, coalesce(patterns, '') AS patterns
FROM parts LEFT JOIN best USING (n) LEFT JOIN fitting USING (n)"""
