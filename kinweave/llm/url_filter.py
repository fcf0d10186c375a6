"""URL verdicts by pattern rules that are indexed by their rarest literal token.

A rule fits the address of a page: its host in lower case, then its path. Rules are lines of a list:

    ||example.com/en/   begins at the host or at a label of it, so subdomains count
    |http               begins, and with the sign at the end ends, where the address does
    ^casino^            ^ is either end of the address or anything but a letter or a digit
    /ads/*/banner^      * is anything; letters fit without regard to case
    @@^casino^          allows what it fits; without @@ a rule blocks
    ! a comment

A rule's tokens are its runs of letters and digits that must stand whole in any address that it fits. The
index holds each rule under that one of its tokens that the fewest URLs hold, counted over all URLs; a rule
without such a token is refused. A URL's distinct tokens fetch candidate rules, and only those run their
expressions. Host rules (a host with its subdomains, and a path's beginning, case and all) win over rules
of lists, the longest first; else an allowing rule of a list wins over a blocking one, and the first by
name among those; anything else is allowed.

Rules are configuration: at most ``MOST_RULES`` are sent to each task. Null URLs and URLs without ``://``
have an empty host and path and fit no host rule. Very long URLs are judged like any other. Repeated rows
and null keys are judged one by one; an empty table gives no row. Only the key and the URL are read, so
other columns may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_RULES = 1_000_000
_TOKEN = re.compile(r"[a-z0-9]+")
_HOST = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_SUBDOMAINS = r"\A(?:[^/]*\.)?"


@dataclass(frozen=True)
class Rule:
    """``expression`` is searched in host and path; an address that it fits holds ``tokens`` whole."""

    name: str
    verdict: str
    expression: str
    tokens: tuple[str, ...]
    length: int = 0  # of a host rule; 0 for a rule of a list


def _whole_runs(parts: list[str]) -> tuple[str, ...]:
    """Runs of letters and digits beside neither ``*`` nor an open end. ``parts``: characters, ``*``, and ``""`` for bounds."""
    text = "".join("\n" if x == "" else "*" if x == "*" else "\n" if x == "^" else x for x in parts).translate(_LOWER)
    return tuple(m[0] for m in _TOKEN.finditer(text) if text[m.start() - 1 : m.start()] not in ("", "*") and text[m.end() : m.end() + 1] not in ("", "*"))


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits a host and its subdomains if the path starts with the rule's."""
    host = host.translate(_LOWER)
    tokens = _whole_runs(["", *(x for x in host if x != "*"), *(["\n"] if not path else []), *(x.replace("*", "+") for x in path)])
    return Rule(host + path, verdict, _SUBDOMAINS + re.escape(host) + (re.escape(path) if path else r"(?:/|\Z)"), tokens, len(host + path))


def list_rule(line: str) -> Rule | None:
    """The rule of a line; nothing for blank lines and comments."""
    name = line.strip()
    if not name or name[0] == "!":
        return None
    body, verdict = (name[2:], "allow") if name.startswith("@@") else (name, "block")
    lead, parts = "", []
    if body.startswith("||"):
        lead, body, parts = _SUBDOMAINS, body[2:], [""]
    elif body.startswith("|"):
        lead, body, parts = r"\A", body[1:], [""]
    end = body.endswith("|")
    body = body[:-1] if end else body
    said = "".join(".*" if x == "*" else r"(?:[^A-Za-z0-9]|\A|\Z)" if x == "^" else re.escape(x) for x in body)
    tokens = _whole_runs([*parts, *body, *([""] if end else [])])
    if not tokens:
        raise ValueError(f"rule {name} has no literal token")
    return Rule(name, verdict, "(?i)" + lead + said + (r"\Z" if end else ""), tokens)


def list_rules(lines: Iterable[str]) -> tuple[Rule, ...]:
    return tuple(x for x in map(list_rule, lines) if x)


def rules_of(table: DataFrame, column: str = "rule") -> tuple[Rule, ...]:
    """The rules of a table of lines."""
    lines = [x[0] for x in table.select(column).where(F.col(column).isNotNull()).limit(MOST_RULES + 1).collect()]
    if len(lines) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules aren't sent to tasks")
    return list_rules(lines)


#: What the method blocks by itself where no host rule fits.
BLOCK_LIST = ("^porn^", "^xxx^", "^casino^", "^viagra^", "/login|", "/login/", "/signin|", "/signin/", "/wp-admin/", "||doubleclick.net^")


def split_url(url: str | None) -> tuple[str, str]:
    found = _HOST.search(url) if url else None
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...], *, key: str = "page_id", url: str = "url", otherwise: str = "allow") -> DataFrame:
    """key, host, path, rule, verdict and the name of the list's rule that fits, for every row."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; more than {MOST_RULES} aren't sent to tasks")
    if lost := [x.name for x in rules if not x.tokens]:
        raise ValueError(f"rules without a literal token: {', '.join(lost[:5])}")
    spark = pages.sparkSession
    asked = F.broadcast(spark.createDataFrame(sorted({(x,) for rule in rules for x in rule.tokens}), "t string"))  # of the rules
    held = pages.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(url)), F.lit("[a-z0-9]+"), F.lit(0)))).alias("t"))
    counts = {x["t"]: x["count"] for x in held.join(asked, "t").groupBy("t").count().collect()}  # a row for each token of the rules at most
    index: dict[str, list[Rule]] = {}
    for rule in rules:
        index.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(rule)
    sent = spark.sparkContext.broadcast(index)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = {t: [(re.compile(r.expression, re.DOTALL).search, r) for r in found] for t, found in sent.value.items()}
        for batch in batches:
            rows = []
            for value in batch.column(1):
                host, path = split_url(value.as_py())
                text = host + path
                best = listed = None
                for token in set(_TOKEN.findall(text.translate(_LOWER))) & ready.keys():
                    for fits, rule in ready[token]:
                        if rule.length and (best is None or (rule.length, rule.name) > (best.length, best.name)):
                            best = rule if fits(text) else best
                        elif not rule.length and (listed is None or (rule.verdict, rule.name) < (listed.verdict, listed.name)):
                            listed = rule if fits(text) else listed
                found = best or listed
                rows.append((host, path, best and best.name, found.verdict if found else otherwise, listed and listed.name))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(x, pa.string()) for x in columns)], names=[key, "host", "path", "rule", "verdict", "pattern"])

    return pages.select(F.col(key).cast("long"), url).mapInArrow(judge, f"{key} long, host string, path string, rule string, verdict string, pattern string")
