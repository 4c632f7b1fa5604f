"""URL filters: rules indexed by their rarest literal token.

A rule is a regular expression over ``host + path``. Its literal tokens are
the whole runs of ASCII letters and digits that any match must contain. How
often each of those occurs among all urls is counted first; each rule is filed
under its rarest. The tokens of a url then fetch the candidate rules, and only
those run. Rules without a token are tried on every url, so the index never
changes a verdict.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"[0-9A-Za-z]+")
#: Verdict of a url that no rule matches.
DEFAULT = "allow"


@dataclass(frozen=True)
class Rule:
    """``tokens``: literals that stand in every match as whole tokens. Of the matching rules of the lowest ``level`` the longest wins."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...] = ()
    level: int = 0


def prefix_rule(name: str, verdict: str) -> Rule:
    """The rule for a host, all its subdomains and a path prefix, such as ``example.net/en/``.

    The last token of the prefix is whole only if something follows it.
    """
    host, slash, rest = name.partition("/")
    path = slash + rest
    tail = ".*" if path else "(?:/.*)?"  # a host ends where the path begins
    whole = _TOKEN.findall(host) + [t for t in _TOKEN.findall(path) if not re.search(rf"{t}$", path)]
    return Rule(name, verdict, rf"(?s)(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}{tail}", tuple(whole))


#: Host and path rules: block net/, allow example.net/en/, block example.com/de/, allow org/fr/.
HOST_RULES = [prefix_rule("net/", "block"), prefix_rule("example.net/en/", "allow"), prefix_rule("example.com/de/", "block"), prefix_rule("org/fr/", "allow")]

#: Patterns for what those leave open.
PATTERN_RULES = [
    Rule("spam host", "block", r"(?s)(?:[^/]*[.-])?spam[.-][^/]*(?:/.*)?", ("spam",), 1),
    Rule("link farm", "block", r"(?s)[^/]*-farm\.[^/]*(?:/.*)?", ("farm",), 1),
    Rule("casino", "block", r"(?s)(?:.*[./_-])?casino(?:[./_-].*)?", ("casino",), 1),
    Rule("ad server", "block", r"(?s)ads?\d*\.[^/]*(?:/.*)?", (), 1),
    Rule("tracker path", "block", r"(?s)[^/]*/(?:.*/)?track(?:/.*)?", ("track",), 1),
    Rule("login page", "block", r"(?s)[^/]*/(?:.*/)?login(?:\.[a-z]+)?(?:/.*)?", ("login",), 1),
    Rule("tag listing", "block", r"(?s)[^/]*/(?:.*/)?tag/[^/]+/page/\d+/?", ("tag", "page"), 1),
]


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased, and path; both empty without a ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub(r"[A-Z]+", lambda m: m[0].lower(), host), path


class RuleIndex:
    """Rules filed under their rarest token."""

    def __init__(self, rules: Sequence[Rule], counts: dict[str, int]):
        self.filed: dict[str, list[tuple[Rule, re.Pattern]]] = {}
        self.always: list[tuple[Rule, re.Pattern]] = []
        for rule in rules:
            entry = rule, re.compile(rule.pattern)
            if rule.tokens:
                self.filed.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(entry)
            else:
                self.always.append(entry)

    def judge(self, host: str, path: str) -> tuple[Rule | None, int]:
        """The rule that wins, and how many expressions ran."""
        if not host and not path:
            return None, 0
        target = host + path
        tokens = set(_TOKEN.findall(target))
        candidates = [*self.always, *(e for t in tokens if t in self.filed for e in self.filed[t])]
        fits = [rule for rule, pattern in candidates if pattern.fullmatch(target)]
        return min(fits, key=lambda r: (r.level, -len(r.name), r.name), default=None), len(candidates)


def token_counts(pages: DataFrame, rules: Sequence[Rule], url_col: str = "url") -> dict[str, int]:
    """In how many urls of the table each token of a rule occurs; as many entries as the rules have tokens."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    tokens = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(url_col), F.lit("")), F.lit(_TOKEN.pattern), F.lit(0)))
    row = pages.agg(*(F.count_if(F.array_contains(tokens, t)).alias(t) for t in wanted)).first()
    return {t: row[t] for t in wanted}


def judged(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", host_rules: Sequence[Rule] = HOST_RULES, pattern_rules: Sequence[Rule] = PATTERN_RULES, default: str = DEFAULT) -> DataFrame:
    """The verdict on every url.

    Columns: ``id_col``, ``host``, ``path``, ``rule`` (the host rule that
    wins, else null), ``verdict`` (that rule's; else the longest matching
    pattern rule's; else ``default``), ``pattern`` (that pattern rule's name)
    and ``n_run`` (expressions that ran).

    A url that is null or has no ``://`` has an empty host and path and gets
    the default. Ids may be null or repeated: one row for each input row.
    Columns of other names are not read.
    """
    rules = [*host_rules, *pattern_rules]
    index_of = {r.name for r in host_rules}
    counts = token_counts(pages, rules, url_col)
    kind = pages.schema[id_col].dataType.simpleString()
    names = ["host", "path", "rule", "verdict", "pattern", "n_run"]
    types = [pa.string()] * 5 + [pa.int32()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RuleIndex(rules, counts)
        for batch in batches:
            rows = []
            for url in batch.column(1).to_pylist():
                host, path = host_and_path(url)
                found, ran = index.judge(host, path)
                own = found and found.name in index_of
                rows.append((host, path, found.name if own else None, found.verdict if found else default, found.name if found and not own else None, ran))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[id_col, *names])

    return pages.select(F.col(id_col), F.col(url_col).cast("string").alias("u")).mapInArrow(work, f"`{id_col}` {kind}, host string, path string, rule string, verdict string, pattern string, n_run int")
