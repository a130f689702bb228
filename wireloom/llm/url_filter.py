"""URL filters: explicit rules first, else a weighted vocabulary found by one Aho-Corasick pass.

A term counts where neither neighbour is an ASCII letter or digit.  A url is rejected when the weights
of its distinct terms reach ``THRESHOLD``: one strict term does, or two different soft ones; the same
soft term twice does not.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule with a host,
and its vocabulary verdict is that of its text (null: allow).  Repeated rows are judged alike.  Rules
and terms are small driver-side lists (a parameter), sent to tasks with the function; urls never move.  A very long
url takes one pass like any other; an empty table gives no rows; columns pass through, and one named like the
result (``judged``, or the parameter ``out``) is replaced by it.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wireloom.llm.common import lower_ascii, ready, unused

STRICT = (
    "porn", "porno", "xxx", "sex", "sexcam", "adult", "hentai", "escort", "escorts", "nude", "nudes",
    "casino", "casinos", "gambling", "viagra", "cialis", "camgirl", "camgirls", "warez",
)
SOFT = (
    "ads", "bet", "bets", "betting", "bonus", "cheap", "click", "crack", "dating", "deals", "discount",
    "farm", "free", "hot", "jackpot", "keygen", "lesbian", "loan", "loans", "lottery", "milf", "pills",
    "pharmacy", "poker", "promo", "replica", "slots", "spam", "teen", "torrent", "track", "tracker",
    "win", "winner",
)
STRICT_WEIGHT, SOFT_WEIGHT, THRESHOLD = 2, 1, 2


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def host(url: Column) -> Column:
    """Between ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return lower_ascii(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


@functools.cache
def _automaton(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for weight, terms in ((SOFT_WEIGHT, soft), (STRICT_WEIGHT, strict)):
        for term in terms:
            found.add_word(term, (term, len(term), weight))
    found.make_automaton()
    return found


def _edge(text: str, at: int) -> bool:
    return not (0 <= at < len(text) and text[at].isascii() and text[at].isalnum())


def terms_in(url: str, strict: tuple[str, ...], soft: tuple[str, ...]) -> dict[str, int]:
    """The distinct bounded terms of a lower-cased url with their weights."""
    return {
        term: weight
        for end, (term, size, weight) in _automaton(strict, soft).iter(url)
        if _edge(url, end - size) and _edge(url, end + 1)
    }


def best_rule(by_host: dict[str, list[Rule]], host: str, path: str) -> Rule | None:
    """The longest rule whose host is the url's or a parent of it and whose path begins the url's path."""
    found, rest = None, host
    while rest:
        for rule in by_host.get(rest, ()):
            if path.startswith(rule.path) and (found is None or len(rule.text) > len(found.text)):
                found = rule
        rest = rest.partition(".")[2]
    return found


def judge_urls(
    df: DataFrame,
    url: str = "url",
    rules: Sequence[Rule] = RULES,
    strict: Sequence[str] = STRICT,
    soft: Sequence[str] = SOFT,
    threshold: int = THRESHOLD,
    out: str = "judged",
) -> DataFrame:
    """Add a struct ``out``: host, path, rule, verdict, strict_hits, soft_hits, terms (sorted)."""
    ready(df.sparkSession)
    by_host: dict[str, list[Rule]] = {}
    for rule in rules:
        by_host.setdefault(rule.host, []).append(rule)
    strict, soft = tuple(strict), tuple(soft)

    @F.pandas_udf("rule string, verdict string, strict_hits int, soft_hits int, terms array<string>")
    def method(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for urls, hosts, paths in parts:
            rows = []
            for u, h, p in zip(urls, hosts, paths, strict=True):
                rule = best_rule(by_host, h, p)
                hits = terms_in(u, strict, soft)
                weights = list(hits.values())
                verdict = rule.verdict if rule else "block" if sum(weights) >= threshold else "allow"
                rows.append((rule and rule.text, verdict, weights.count(STRICT_WEIGHT), weights.count(SOFT_WEIGHT), sorted(hits)))
            yield pd.DataFrame(rows, columns=["rule", "verdict", "strict_hits", "soft_hits", "terms"])

    u = F.coalesce(F.col(f"`{url}`"), F.lit(""))
    made = unused(df, "_judged")
    found = df.withColumn(made, method(lower_ascii(u), host(u), path(u)))
    whole = F.struct(host(u).alias("host"), path(u).alias("path"), f"{made}.*")
    return found.withColumn(out, whole).drop(made)
