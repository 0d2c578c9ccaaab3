"""URL filters (operator 7): pattern rules behind a rarest-token index.

Two layers judge a URL.  Site rules (host suffix + path prefix, longest wins)
decide first.  URLs without a site rule go to the pattern rules: each pattern
declares literal tokens, or choices of tokens, that any matching URL must
contain; it is filed under the one that is rarest in the URL table, a choice
under each of its tokens.  A URL's own tokens fetch the filed
patterns and only those run their regular expression.  A pattern without any
token runs on every URL.

``read_filter_list`` makes pattern rules of the filter lists that ad blockers
share: ``||`` (host), ``|`` (end), ``*``, ``^`` (separator), ``@@`` (exception).

Defined cases: a null URL, or one without ``://``, has empty host and path, no
rule, and verdict allow.  Ties between site rules of equal length go to the
rule listed first.  Repeated rows are judged one by one; extra columns are not
read.  Very long URLs are read whole; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import url_lists

TOKEN = re.compile(r"[a-z0-9]+")
#: The same in Catalyst's dialect, for the token statistics.
TOKEN_SQL = "[a-z0-9]+"


@dataclass(frozen=True)
class SiteRule:
    verdict: str  # allow or block
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    """``pattern`` is searched in the lower-cased URL; ``tokens`` are whole
    [a-z0-9]+ tokens that every matching URL has, a tuple among them a choice
    of which it has one at least.  Exceptions allow."""

    name: str
    pattern: str
    tokens: tuple
    verdict: str = "block"

    @property
    def choices(self) -> list[tuple]:
        return [(t,) if isinstance(t, str) else tuple(t) for t in self.tokens]


SITE_RULES = (
    SiteRule("allow", "com"), SiteRule("block", "example.com", "/en/"), SiteRule("allow", "www.example.com", "/en/"),
    SiteRule("block", "net", "/es/"), SiteRule("block", "net", "/fr/"),
)

PATTERN_RULES = (
    PatternRule("ad-host", r"^[a-z]+://([^/?#]*\.)?ads?-[^/?#]*", (("ads", "ad"),)),
    PatternRule("ad-host-single", r"^[a-z]+://([^/?#]*\.)?ad-[^/?#]*", ("ad",)),
    PatternRule("ad-path", r"/ads?/", (("ads", "ad"),)),
    PatternRule("adult-host", r"^[a-z]+://([^/?#]*\.)?adult-[^/?#]*", ("adult",)),
    PatternRule("casino-host", r"^[a-z]+://([^/?#]*\.)?casino[^a-z0-9][^/?#]*", ("casino",)),
    PatternRule("tracker-host", r"^[a-z]+://([^/?#]*[^a-z0-9])?tracker\.", ("tracker",)),
    PatternRule("track-pixel", r"/track/pixel\.(gif|png)", ("track", "pixel")),
    PatternRule("login-page", r"/(login|signin)(\.html?)?/?([?#]|$)", (("login", "signin"),)),
    PatternRule("cart-page", r"/cart/checkout", ("cart",)),  # also /cart/checkout2
    PatternRule("session-id", r"[?&;]phpsessid=", ("phpsessid",)),
    PatternRule("print-view", r"[?&]print=1", ("print",)),  # also print=10
    PatternRule("org-docs", r"^[a-z]+://docs\.[^/?#]*\.org/", ("docs", "org"), "allow"),
)


SEPARATOR = "(?:[^a-z0-9_.%-]|$)"
OPTIONS = re.compile(r"\$[~a-z0-9_-]+(?:[,=|][^/]*)?$")


def filter_rule(line: str) -> PatternRule | None:
    """The pattern rule of a filter list's line, None for comments and for rules
    on page elements, referring pages (``domain=``) or by regular expression.
    Other options name kinds of requests, which URLs don't tell, and are dropped."""
    text = line.strip().lower()
    if not text or text[0] in "![" or re.search("#[@?$]?#", text):
        return None
    verdict, body = ("allow", text[2:]) if text.startswith("@@") else ("block", text)
    if options := OPTIONS.search(body):
        if "domain=" in options[0]:
            return None
        body = body[: options.start()]
    if len(body) > 1 and body[0] == body[-1] == "/":
        return None
    lead, tail = "", ""
    if body.startswith("||"):
        lead, body = r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?", body[2:]
    elif body.startswith("|"):
        lead, body = "^", body[1:]
    if body.endswith("|"):
        tail, body = "$", body[:-1]
    if not body.strip("*^"):
        return None
    # a token is whole in every match if neither side of it may be a letter, a digit or anything
    framed = ("|" if lead else "*") + body + ("|" if tail else "*")
    tokens = tuple(m[0] for m in TOKEN.finditer(framed) if framed[m.start() - 1] != "*" and framed[m.end()] != "*")
    pattern = "".join(".*" if c == "*" else SEPARATOR if c == "^" else re.escape(c) for c in body)
    return PatternRule(line.strip(), lead + pattern + tail, tokens, verdict)


def read_filter_list(lines) -> tuple[PatternRule, ...]:
    return tuple(r for r in map(filter_rule, lines) if r)


#: What the registered query runs: the rules above and the list's.
REGISTERED_RULES = PATTERN_RULES + read_filter_list(url_lists.lines())


def split_url(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[: min((i for i in map(path.find, "?#") if i >= 0), default=len(path))]


class SiteIndex:
    """Site rules by host; a URL probes its own host suffixes only."""

    def __init__(self, rules=SITE_RULES):
        self.by_host: dict = defaultdict(list)
        for i, r in enumerate(rules):
            self.by_host[r.host].append((-len(r.name), i, r))
        for v in self.by_host.values():
            v.sort(key=lambda x: x[:2])

    def find(self, host: str, path: str) -> SiteRule | None:
        found, rest = [], host
        while rest:
            found += [x for x in self.by_host.get(rest, ()) if path.startswith(x[2].path)][:1]
            rest = rest.partition(".")[2]
        return min(found, key=lambda x: x[:2])[2] if found else None


class PatternIndex:
    """Pattern rules filed under their rarest literal token or choice of tokens."""

    def __init__(self, rules=REGISTERED_RULES, frequency: dict | None = None):
        frequency = frequency or {}
        self.filed: dict = defaultdict(list)
        self.always = []
        for i, r in enumerate(rules):
            entry = (r.verdict != "allow", i, r.name, re.compile(r.pattern), r.verdict)
            if not r.tokens:
                self.always.append(entry)
                continue
            rarest = min(r.choices, key=lambda c: (sum(frequency.get(t, 0) for t in c), -min(map(len, c)), c))
            for t in rarest:
                self.filed[t].append(entry)

    def find(self, url: str) -> tuple[str, str] | None:
        """(name, verdict): exceptions before blocks, then list order."""
        low = url.lower()
        hits = {c for t in set(TOKEN.findall(low)) & self.filed.keys() for c in self.filed[t]}.union(self.always)
        return next(((name, verdict) for _, _, name, p, verdict in sorted(hits, key=lambda c: c[:2]) if p.search(low)), None)


def token_frequency(pages: DataFrame, url_col: str, rules) -> dict:
    """How many URLs hold each token of the rules: counted over all rows with a
    partial aggregate; the result has one row per rule token at most."""
    wanted = sorted({t for r in rules for c in r.choices for t in c})
    if not wanted:
        return {}
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.col(url_col)), F.lit(TOKEN_SQL), F.lit(0)))
    hit = F.array_intersect(tokens, F.array(*map(F.lit, wanted)))
    rows = pages.select(F.explode(hit).alias("t")).groupBy("t").count().collect()  # at most len(wanted) rows
    return {r["t"]: r["count"] for r in rows}


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", sites=SITE_RULES, patterns=REGISTERED_RULES) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, pattern."""
    frequency = token_frequency(pages, url_col, patterns)
    kind = dict(pages.select(id_col).dtypes)[id_col]

    def run(batches):
        site, pattern = SiteIndex(sites), PatternIndex(patterns, frequency)
        for b in batches:
            out: list[tuple] = []
            for url in b.column("url_").to_pylist():
                host, path = split_url(url)
                rule = site.find(host, path)
                hit = None if rule or not host else pattern.find(url)
                out.append((host, path, rule and rule.name, rule.verdict if rule else hit[1] if hit else "allow", hit and hit[0]))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column("id_"), *(pa.array(list(c), pa.string()) for c in cols)], names=[id_col, "host", "path", "rule", "verdict", "pattern"])

    return pages.selectExpr(f"`{id_col}` as id_", f"cast(`{url_col}` as string) as url_").mapInArrow(run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string, pattern string")
