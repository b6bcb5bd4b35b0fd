"""URL filters: pattern rules indexed by their rarest literal token.

A rule is an action, a host and a path prefix, or a regular expression.  Every rule names literal tokens
that each URL it fits must contain; it is filed under the one that the fewest rules share.  A URL's own
tokens fetch the rules filed under them, and only those are run.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """``host`` with its subdomains and paths that start with ``path``; or else ``pattern`` over host, line end and path, which needs ``tokens``."""

    action: str
    host: str = ""
    path: str = ""
    pattern: str = ""
    tokens: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return self.host + self.path if self.host else self.pattern

    def regex(self) -> str:
        return rf"(?:.*\.)?{re.escape(self.host)}\n{re.escape(self.path)}" if self.host else self.pattern

    def literals(self) -> tuple[str, ...]:
        """Whole tokens of any URL that fits; a path's last token may go on in the URL, so only those before a separator count."""
        if not self.host:
            return self.tokens
        path = self.path[: max((i + 1 for i, c in enumerate(self.path) if not c.isalnum()), default=0)]
        return tuple(_TOKEN.findall(self.host)) + tuple(t for t in _TOKEN.findall(path) if path)


#: The rules of the production query.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)
#: The method's own patterns, asked where no rule above fits: token, action, and the regular expression over host, line end and path.
#: They block pages that are never prose - advertising, gambling, shops' carts, accounts, feeds, listings of an archive - and allow a few that look like them.
_PATTERNS = r"""
doubleclick block (?:.*\.)?doubleclick\.[a-z]+\n.*
adservice block (?:.*\.)?adservice\.[a-z.]+\n.*
googlesyndication block (?:.*\.)?googlesyndication\.com\n.*
taboola block (?:.*\.)?taboola\.com\n.*
outbrain block (?:.*\.)?outbrain\.com\n.*
ads block (?:.*\.)?ads\.[a-z0-9-]+\.[a-z]+\n.*
banner block [^\n]*\n.*/banner/\d+x\d+.*
casino block [^\n]*\n.*\bcasino\b.*
casino block (?:.*[.-])?casino(?:[.-].*)?\n.*
poker block [^\n]*\n.*\bpoker\b.*
betting block [^\n]*\n.*\bbetting\b.*
viagra block [^\n]*\n.*\bviagra\b.*
xxx block (?:.*\.)?xxx\n.*
xxx block [^\n]*\n.*\bxxx\b.*
porn block [^\n]*\n.*\bporn\b.*
login block [^\n]*\n.*\b(?:wp-)?login\b.*
signin block [^\n]*\n.*\bsignin\b.*
signup block [^\n]*\n.*\bsignup\b.*
register block [^\n]*\n(?:/[a-z]{2})?/register/?
password block [^\n]*\n.*\bpassword[/_-](?:reset|forgot|recovery)\b.*
password block [^\n]*\n.*\b(?:reset|forgot|recover)[/_-]password\b.*
admin block [^\n]*\n.*/(?:wp-)?admin/.*
xmlrpc block [^\n]*\n.*/xmlrpc\.php
cgi block [^\n]*\n/cgi-bin/.*
cart block [^\n]*\n(?:/[a-z]{2})?/cart(?:/.*)?
checkout block [^\n]*\n.*/checkout(?:/.*)?
wishlist block [^\n]*\n.*/wishlist(?:/.*)?
feed block [^\n]*\n.*/feed/?
rss block [^\n]*\n.*/rss(?:\.xml)?/?
sitemap block [^\n]*\n.*/sitemap(?:[_-]\w+)?\.xml(?:\.gz)?
robots block [^\n]*\n/robots\.txt
calendar block [^\n]*\n.*/calendar/\d{4}(?:/\d{1,2}){0,2}/?
archive block [^\n]*\n.*/archive/\d{4}(?:/\d{1,2}){0,2}/?
page block [^\n]*\n.*/page/\d{3,}/?
print block [^\n]*\n.*/print/\d+/?
download block [^\n]*\n.*/download/.*\.(?:zip|gz|exe|dmg|iso|apk)
localhost block localhost(?::\d+)?\n.*
wikipedia allow (?:.*\.)?wikipedia\.org\n/wiki/.*
arxiv allow (?:.*\.)?arxiv\.org\n/(?:abs|pdf)/.*
archive allow (?:.*\.)?archive\.org\n/details/.*
"""
PATTERNS = tuple(Rule(action, pattern=pattern, tokens=(token,)) for token, action, pattern in (line.split(" ", 2) for line in _PATTERNS.strip().splitlines()))


def parts(url: str | None) -> tuple[str, str]:
    """Host, its A-Z lowered, and path; both empty for null or without ``://``."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    m = re.search(r"[/?#]", rest)
    host, tail = (rest[: m.start()], rest[m.start() :]) if m else (rest, "")
    return host.translate(_LOWER), re.split(r"[?#]", tail, maxsplit=1)[0]


_LOWER = {c: c + 32 for c in range(65, 91)}


class Index:
    """Rules under their rarest token; of the rules that fit, the longest host and path win, ``allow`` of equal ones."""

    def __init__(self, rules: tuple[Rule, ...]):
        shared = Counter(t for r in rules for t in set(r.literals()))
        self.under: dict[str, list[tuple[Rule, re.Pattern]]] = {}
        for r in rules:
            rarest = min(r.literals() or ("",), key=lambda t: (shared[t], t))
            self.under.setdefault(rarest, []).append((r, re.compile(r.regex(), re.S | re.A)))

    def candidates(self, host: str, path: str):
        """Each rule is filed once, so each comes once; those without a literal always come."""
        for token in {"", *_TOKEN.findall(host), *_TOKEN.findall(path), *_TOKEN.findall(path.lower())}:
            yield from self.under.get(token, ())

    def match(self, host: str, path: str) -> Rule | None:
        subject = f"{host}\n{path}"
        fits = [r for r, regex in self.candidates(host, path) if regex.fullmatch(subject) or (r.host and regex.match(subject))]
        return max(fits, key=lambda r: (len(r.name), r.action == "allow", r.name), default=None)


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, patterns: tuple[Rule, ...] = PATTERNS) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict.

    A host rule that fits decides; where none does, rule is null and the patterns decide, of those that fit the longest, ``allow`` if none of them does.
    Null urls have an empty host and path and are allowed.  Repeated rows and null ids are kept as they are, other columns are left out, and
    an empty table gives an empty one.
    """

    def run(batches):
        own, method = Index(rules), Index(patterns)
        for batch in batches:
            rows = [parts(u) for u in batch.column("url").to_pylist()]
            found = [own.match(h, p) if h else None for h, p in rows]
            verdict = [r.action if r else (m.action if h and (m := method.match(h, p)) else "allow") for r, (h, p) in zip(found, rows, strict=True)]
            cols = [pa.array([h for h, _ in rows], pa.string()), pa.array([p for _, p in rows], pa.string()), pa.array([r.name if r else None for r in found], pa.string()), pa.array(verdict, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *cols], ["page_id", "host", "path", "rule", "verdict"])

    rows = pages.select("page_id", "url")
    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, verdict string")


#: Each pattern stands for itself here, so that the index of tokens is checked against running them all.
_SQL_PATTERNS = ", ".join(f"('{r.action}', '{r.pattern}')" for r in PATTERNS)
ORACLE = rf"""
WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hp AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*', 0)) + 1), '^[^?#]*', 0) AS path FROM p),
rules(action, rhost, rpath) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
fit AS (SELECT page_id, rhost || rpath AS rule, action, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, action, rhost || rpath DESC) AS rk
  FROM hp JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT hp.page_id, host, path, rule, coalesce(action, (SELECT arg_max(a, length(p) * 2 + (a = 'allow')::INT) FROM (VALUES {_SQL_PATTERNS}) t(a, p) WHERE host <> '' AND regexp_full_match(host || chr(10) || path, p)), 'allow') AS verdict
FROM hp LEFT JOIN fit ON hp.page_id = fit.page_id AND rk = 1
"""
