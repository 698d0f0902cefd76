"""URL filters: host rules, and pattern rules indexed by their rarest literal token.

A pattern rule is a regular expression over the URL with A-Z lower-cased.  Its
tokens, runs of a-z and digits that stand by themselves in every match, are read
from the expression: what can't be proved to stand by itself is no token.  Each
rule is filed under that of its tokens which the fewest rules have, and one
without tokens is tried on every URL.  A URL's tokens fetch the rules filed
under them, and only those run their expressions: the work for a URL doesn't
grow with the rules that share none of its tokens.

The verdict: the longest fitting host rule decides (a rule fits its host and
all subdomains if the path begins with its path).  Else patterns decide: block
if a block pattern matches and no allow pattern does, else allow.

Rules are parameters or tables (``read_rules``).  They are sent with the tasks
in parts of ``MOST_RULES``; with more than one part, pages pass the parts one
after the other and take along what was found.  Pages are judged where they are
read, without a shuffle, and only ids and URLs are read.

Cases: a null URL or one without ``://`` has an empty host and path, no rule,
and the patterns' verdict over its text (a null one: allow).  Equal hosts and
paths with two verdicts: the first rule counts.  Repeated rows, null ids and
other columns make no difference; an empty table of pages or rules is fine.
"""

from __future__ import annotations

import re
import re._parser as _re  # the parse trees of expressions
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.common import LOWER, UPPER, table

#: (verdict, host, path)
HOST_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: (verdict, expression over the URL with A-Z lower-cased)
PATTERN_RULES = (
    ("block", r"://([^/?#]*[.-])?casino[.-]"),
    ("block", r"://([^/?#]*\.)?cheap-pills\."),
    ("block", r"://([^/?#]*\.)?free-bets\."),
    ("block", r"://([^/?#]*\.)?spam-[a-z]+\."),
    ("block", r"://([^/?#]*\.)?ads-track\."),
    ("block", r"[?&]utm_source=feed(&|#|$)"),
    ("allow", r"\.org/de/[0-9]+([./?#]|$)"),
)
MOST_RULES = 200_000
_TOKEN = re.compile(r"[a-z0-9]+")
_TO_LOWER = str.maketrans(UPPER, LOWER)


def _tokenless(items: list, side: int) -> tuple[bool, bool]:
    """(whether a sequence surely ends, on a side, at a character of no token or an anchor; whether it may be empty)."""
    for kind, value in items if side > 0 else reversed(items):
        match kind:
            case _re.LITERAL:
                return not _TOKEN.fullmatch(chr(value)), False
            case _re.IN:
                return _no_token_in(value), False
            case _re.AT:
                return value in (_re.AT_BEGINNING, _re.AT_BEGINNING_STRING, _re.AT_END, _re.AT_END_STRING), False
            case _re.SUBPATTERN:
                sure, empty = _tokenless(list(value[3]), side)
            case _re.BRANCH:
                each = [_tokenless(list(branch), side) for branch in value[1]]
                sure, empty = all(s or e for s, e in each), any(e for _, e in each)
            case _re.MAX_REPEAT | _re.MIN_REPEAT:
                sure, empty = _tokenless(list(value[2]), side)
                sure, empty = sure or empty, empty or value[0] == 0
            case _:
                return False, False
        if not sure or not empty:
            return sure, empty
    # what is empty says nothing about what is beside it
    return True, True


def _no_token_in(members: list) -> bool:
    """Whether a character class (not a negated one) has no a-z and no digit."""
    for kind, value in members:
        if kind is _re.LITERAL and not _TOKEN.fullmatch(chr(value)):
            continue
        if kind is _re.RANGE and not any(_TOKEN.fullmatch(chr(c)) for c in range(value[0], min(value[1], 127) + 1)):
            continue
        return False
    return True


def tokens_of(expression: str) -> tuple[str, ...]:
    """Tokens that stand by themselves in every match of ``expression``, in order."""
    tree = list(_re.parse(expression))
    found, at = [], 0
    while at < len(tree):
        end = at
        while end < len(tree) and tree[end][0] is _re.LITERAL and _TOKEN.fullmatch(chr(tree[end][1])):
            end += 1
        if end > at:
            # beside it there must be something, and that no part of a token
            (left, none), (right, nothing) = _tokenless(tree[:at], -1), _tokenless(tree[end:], 1)
            if left and not none and right and not nothing:
                found.append("".join(chr(value) for _, value in tree[at:end]))
        at = max(end, at + 1)
    return tuple(dict.fromkeys(found))


class Filter:
    """Host rules (verdict, host, path) and pattern rules (verdict, expression), ready to judge URLs."""

    def __init__(self, hosts: Sequence[tuple[str, str, str]], patterns: Sequence[tuple[str, str]]):
        self.hosts: dict[str, list[tuple[str, str]]] = {}
        for verdict, host, path in hosts:
            self.hosts.setdefault(host, []).append((path, verdict))
        tokens = {expression: tokens_of(expression) for _, expression in patterns}
        had = Counter(t for own in tokens.values() for t in own)
        self.filed: dict[str | None, list[tuple[str, re.Pattern]]] = {}
        for verdict, expression in patterns:
            rarest = min(tokens[expression], key=lambda t: (had[t], -len(t), t), default=None)
            self.filed.setdefault(rarest, []).append((verdict, re.compile(expression)))

    def host_rule(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest fitting rule."""
        best, tail = None, host
        while tail:
            for start, verdict in self.hosts.get(tail, ()):
                if path.startswith(start) and (best is None or len(tail + start) > len(best[0])):
                    best = tail + start, verdict
            tail = tail.partition(".")[2]
        return best

    def pattern_verdict(self, url: str) -> str | None:
        """``allow`` if an allow pattern matches, else ``block`` if a block pattern does, else None."""
        low = url.translate(_TO_LOWER)
        verdict = None
        for token in [None, *dict.fromkeys(_TOKEN.findall(low))]:
            for own, expression in self.filed.get(token, ()):
                if expression.search(low):
                    if own == "allow":
                        return "allow"
                    verdict = "block"
        return verdict

    def judge(self, url: str | None) -> tuple[str, str, str | None, str]:
        """host, path, rule, verdict"""
        host, path = split(url)
        rule, verdict, pattern = self.found(url, host, path)
        return host, path, rule, verdict or pattern or "allow"

    def found(self, url: str | None, host: str, path: str) -> tuple[str | None, str | None, str | None]:
        """rule, its verdict, and the patterns' verdict."""
        rule, verdict = self.host_rule(host, path) or (None, None)
        return rule, verdict, self.pattern_verdict(url or "")


def split(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    before = re.split(r"[?#]", rest, maxsplit=1)[0]
    host, slash, path = before.partition("/")
    return host.translate(_TO_LOWER), slash + path


def filters(hosts: Sequence[tuple[str, str, str]], patterns: Sequence[tuple[str, str]], most: int = MOST_RULES) -> list[Filter]:
    """Filters of at most ``most`` rules each, one at least."""
    rules = [(h, None) for h in hosts] + [(None, p) for p in patterns]
    parts = [rules[at : at + most] for at in range(0, len(rules), most)] or [[]]
    return [Filter([h for h, _ in part if h], [p for _, p in part if p]) for part in parts]


def read_rules(hosts: DataFrame, patterns: DataFrame, most: int = MOST_RULES) -> list[Filter]:
    """Filters of tables (verdict, host, path) and (verdict, expression), in the tables' order by text."""
    return filters([tuple(r) for r in hosts.select("host", "path", "verdict").orderBy("host", "path", "verdict").select("verdict", "host", "path").toLocalIterator()], [tuple(r) for r in patterns.select("verdict", "expression").orderBy("expression", "verdict").toLocalIterator()], most)


def judge_pages(pages: DataFrame, rules: Filter | Sequence[Filter], *, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict for each row; no shuffle."""
    names = ["key", "url", "host", "path", "rule", "verdict", "pattern"]
    now = pages.select(pages[key].alias("key"), pages[url].alias("url"))
    kind = now.schema["key"].dataType.simpleString()
    for part in [rules] if isinstance(rules, Filter) else rules:
        now = now.mapInArrow(_judged(part, names), f"key {kind}, " + ", ".join(f"{n} string" for n in names[1:]))
    verdict = F.coalesce("verdict", "pattern", F.lit("allow"))
    return now.select(F.col("key").alias(key), "host", "path", "rule", verdict.alias("verdict"))


def _judged(rules: Filter, names: list[str]):
    """One part of the rules over batches of key and url, or of what former parts found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = batch.column(1).to_pylist()
            former = [batch.column(n).to_pylist() for n in range(4, 7)] if batch.num_columns > 2 else [[None] * len(urls)] * 3
            rows = []
            for address, rule, verdict, pattern in zip(urls, *former, strict=True):
                host, path = split(address)
                own = rules.found(address, host, path)
                if rule is None or (own[0] is not None and len(own[0]) > len(rule)):
                    rule, verdict = own[:2]
                rows.append((host, path, rule, verdict, "allow" if "allow" in (pattern, own[2]) else pattern or own[2]))
            columns = [pa.array(c, pa.string()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.string())] * 5
            yield pa.record_batch([batch.column(0), batch.column(1), *columns], names=names)

    return run


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_pages(table(spark, sf_dir, "pages"), filters(HOST_RULES, PATTERN_RULES))


def _sql() -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in HOST_RULES)
    either = {kind: " OR ".join(f"regexp_matches(low, '{e}')" for v, e in PATTERN_RULES if v == kind) for kind in ("allow", "block")}
    return f"""
WITH rules(verdict, host, path) AS (VALUES {rules}),
p AS (
  SELECT page_id, row_number() OVER () AS r, coalesce(url, '') AS url,
         translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS low,
         CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
q AS (
  SELECT page_id, r, low, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path
  FROM p),
fits AS (
  SELECT r, rules.host || rules.path AS rule, rules.verdict,
         row_number() OVER (PARTITION BY r ORDER BY length(rules.host || rules.path) DESC) AS place
  FROM q JOIN rules ON (q.host = rules.host OR ends_with(q.host, '.' || rules.host)) AND starts_with(q.path, rules.path))
SELECT page_id, q.host, q.path, rule,
       coalesce(verdict, CASE WHEN ({either["block"]}) AND NOT ({either["allow"]}) THEN 'block' ELSE 'allow' END) AS verdict
FROM q LEFT JOIN fits ON fits.r = q.r AND place = 1
"""


SQL = _sql()
