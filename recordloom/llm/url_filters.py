"""URL filters: pattern rules are found through their rarest literal token."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules by host and path: (verdict, host + path).
PLACES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Pattern rules. ``||`` begins a host or a subdomain, ``|`` is the begin or end of the
#: url, ``^`` a separator or the end, ``*`` anything; ``@@`` makes an exception.
PATTERNS = (
    "||ads-track.",
    "||casino-win.",
    "||cheap-pills.",
    "||free-bets.",
    "||spam-farm.",
    "/adserver/",
    "/banners/*.gif|",
    "?utm_source=spam^",
    "@@||example.org^help^",
    "@@||example.net^about^",
)
#: Rules that one broadcast index holds; more rules are applied block by block.
MAX_RULES = 50_000
TOKEN = "[a-z0-9]+"
SEPARATOR = "(?:[^a-z0-9_.%-]|$)"


def lowered(url: Column) -> Column:
    """A-Z in lower case; other letters stay."""
    capitals = "".join(map(chr, range(65, 91)))
    return F.translate(url, capitals, capitals.lower())


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty without ``://``."""
    return lowered(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def place_rule(
    host: Column, path: Column, rules: Iterable[tuple[str, str]], what: str = "rule"
) -> Column:
    """The longest rule whose host is the url's, or a domain above it, and whose path begins
    the url's path: its text, or its verdict with ``what="verdict"``. NULL if none fits."""
    out = F
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        out = out.when(fits, F.lit(rule if what == "rule" else verdict))
    return F.lit(None).cast("string") if out is F else out


def parsed(rule: str) -> tuple[bool, str, set[str]]:
    """Whether the rule is an exception, its regular expression, and its literal tokens.

    A token counts if the pattern fixes the characters on both its sides, so that a url that
    matches has the same whole token.
    """
    allow = rule.startswith("@@")
    text = rule.removeprefix("@@").lower()
    begin = "^" if text.startswith("|") else ""
    if text.startswith("||"):
        begin = r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?"
    end = "$" if len(text) > 2 and text.endswith("|") else ""
    body = text.lstrip("|") if begin else text
    body = body[:-1] if end else body
    pieces = {"*": ".*", "^": SEPARATOR}
    regex = begin + "".join(pieces.get(c) or re.escape(c) for c in body) + end
    tokens = set()
    for m in re.finditer(TOKEN, body):
        left = body[m.start() - 1] if m.start() else ("|" if begin else "*")
        right = body[m.end()] if m.end() < len(body) else ("|" if end else "*")
        if left != "*" and right != "*":
            tokens.add(m[0])
    return allow, regex, tokens


def token_counts(df: DataFrame, url_column: str, tokens: Iterable[str]) -> dict[str, int]:
    """How many urls have each of the rules' tokens. One row a token reaches the driver."""
    wanted = df.sparkSession.createDataFrame([(t,) for t in sorted(tokens)], "token string")
    found = F.array_distinct(F.split(lowered(F.col(url_column)), "[^a-z0-9]+"))
    counted = df.select(F.explode(found).alias("token")).join(
        F.broadcast(wanted), "token", "left_semi"
    )
    return {r["token"]: r["n"] for r in counted.groupBy("token").agg(F.count("*").alias("n")).collect()}


def build_index(rules: Iterable[str], counts: dict[str, int]) -> tuple[dict, list]:
    """Rules by their rarest token, and the rules without a token, which are always run."""
    index: dict[str, list] = {}
    always = []
    for rule in dict.fromkeys(rules):
        allow, regex, tokens = parsed(rule)
        entry = (allow, rule, regex)
        if tokens:
            index.setdefault(min(tokens, key=lambda t: (counts.get(t, 0), t)), []).append(entry)
        else:
            always.append(entry)
    return index, always


class Matcher:
    """Runs the candidates of a url; compiles a rule when it first becomes one."""

    def __init__(self, index: dict, always: list):
        self.index, self.always, self.compiled = index, always, {}

    def candidates(self, url: str) -> list:
        tokens = set(re.findall(TOKEN, url))
        return [*self.always, *(r for t in sorted(tokens) for r in self.index.get(t, ()))]

    def match(self, url: str) -> str | None:
        """The first matching exception, else the first matching rule, in order of text."""
        best = None
        for allow, rule, regex in self.candidates(url):
            key = (not allow, rule)
            if best is None or key < best:
                pattern = self.compiled.get(regex)
                if pattern is None:
                    pattern = self.compiled[regex] = re.compile(regex, re.DOTALL)
                if pattern.search(url):
                    best = key
        return best and best[1]


def ascii_lower(url: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), url)


def _decide(index: dict, always: list):
    """The deciding rule of each url, by one index."""

    @F.pandas_udf("string")
    def decide(urls: pd.Series) -> pd.Series:
        matcher = Matcher(index, always)
        known = {u: matcher.match(ascii_lower(u)) for u in urls.dropna().unique()}
        return urls.map(known.get).astype(object)

    return decide


def pattern_rule(df: DataFrame, url_column: str, rules: Iterable[str]) -> Column:
    """The pattern rule that decides a url, NULL if none matches. Exceptions win.

    The index is a closure of at most ``MAX_RULES`` rules; each further block of rules has
    an index and a pass of its own.
    """
    rules = list(dict.fromkeys(rules))
    counts = token_counts(df, url_column, {t for r in rules for t in parsed(r)[2]})
    found = []
    for first in range(0, len(rules), MAX_RULES):
        index, always = build_index(rules[first : first + MAX_RULES], counts)

        found.append(_decide(index, always)(F.col(url_column)))
    if not found:
        return F.lit(None).cast("string")
    exceptions = [F.when(c.startswith("@@"), c) for c in found]
    return F.coalesce(*exceptions, *found)


def judged(
    df: DataFrame,
    url_column: str = "url",
    places: Iterable[tuple[str, str]] = PLACES,
    patterns: Iterable[str] = PATTERNS,
) -> DataFrame:
    """``df`` with the columns host, path, rule, pattern and verdict.

    A rule by place decides if one fits; else a pattern rule blocks, unless it is an
    exception; else the url is allowed. A NULL or empty url, or one without ``://``, has an
    empty host and path, matches no rule by place and is mostly allowed. Rows are judged one
    by one: repeated rows are alike, an empty table stays empty. Columns of ``df`` with the
    names of the new ones are replaced; the url column must not be one of them.
    """
    url = F.col(url_column)
    out = df.withColumns({"host": host_of(url), "path": path_of(url)})
    host, path = F.col("host"), F.col("path")
    out = out.withColumns(
        {
            "rule": place_rule(host, path, places),
            "verdict": place_rule(host, path, places, "verdict"),
            "pattern": pattern_rule(df, url_column, patterns),
        }
    )
    blocked = F.col("pattern").isNotNull() & ~F.col("pattern").startswith("@@")
    by_pattern = F.when(blocked, "block").otherwise("allow")
    return out.withColumn("verdict", F.coalesce("verdict", by_pattern))


def oracle() -> str:
    """The same over ``pages``, every rule run on every url."""

    def text(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    fits = []
    for verdict, rule in sorted(PLACES, key=lambda r: -len(r[1])):
        name, _, rest = rule.partition("/")
        test = f"(host = {text(name)} OR ends_with(host, {text('.' + name)}))"
        fits.append((f"{test} AND starts_with(path, {text('/' + rest)})", rule, verdict))
    case = lambda k: "CASE " + " ".join(f"WHEN {f[0]} THEN {text(f[k])}" for f in fits) + " END"
    found = sorted((not parsed(r)[0], r, parsed(r)[1]) for r in PATTERNS)
    test = " ".join(f"WHEN regexp_matches(u, {text(x)}) THEN {text(r)}" for _, r, x in found)
    return rf"""
    WITH a AS (
      SELECT page_id, coalesce(url, '') AS url,
             translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz') AS u
      FROM pages
    ), b AS (
      SELECT page_id, u, regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1) AS host,
             regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
      FROM a
    ), c AS (
      SELECT *, {case(1)} AS rule, {case(2)} AS placed, CASE {test} END AS pattern FROM b
    )
    SELECT page_id, host, path, rule, pattern,
           coalesce(placed, CASE WHEN pattern IS NULL OR starts_with(pattern, '@@')
                                 THEN 'allow' ELSE 'block' END) AS verdict
    FROM c
    """
