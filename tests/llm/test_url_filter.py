from __future__ import annotations

import pytest

from wireloom.llm import url_filter
from wireloom.llm.url_filter import RULES, SOFT, STRICT, best_rule, terms_in

BY_HOST: dict = {}
for _r in RULES:
    BY_HOST.setdefault(_r.host, []).append(_r)


@pytest.mark.parametrize(
    ("url", "hits"),
    [
        ("http://casino.example", {"casino"}),
        ("http://casinox.example/xcasino", set()),
        ("http://free-bets.example/free", {"free", "bets"}),
        ("casino", {"casino"}),
        ("http://wins.example/a_win", {"win"}),
        ("http://é-pills.example/üwin/rwin", {"pills", "win"}),
        ("", set()),
    ],
)
def test_bounded_terms(url, hits):
    assert set(terms_in(url, STRICT, SOFT)) == hits


def test_longest_rule_wins():
    assert best_rule(BY_HOST, "a.example.org", "/es/1").text == "example.org/es/"
    assert best_rule(BY_HOST, "a.example.org", "/fr/1").text == "org/"
    assert best_rule(BY_HOST, "badexample.org", "/es/1").text == "org/"
    assert best_rule(BY_HOST, "org", "") is None
    assert best_rule(BY_HOST, "", "/") is None


def test_odd_rows_and_clashing_columns(spark):
    rows = [
        (1, "HTTP://WWW.Example.ORG/en/123?x=1#y", "a"), (2, None, "b"), (3, "", "c"), (4, "no scheme casino", "d"),
        (4, "no scheme casino", "d"), (None, "http://x.com?free=1&bets=2", "e"), (6, "ftp://h" + "/a" * 50_000, "f"),
        (7, "http://free.example.net/free", "g"), (8, "://", "h"), (9, "http://[::1]:80/fr/", "i"),
    ]
    df = spark.createDataFrame(rows, "page_id bigint, url string, host string")
    got = [(r.page_id, *r.judged[:6]) for r in url_filter.judge_urls(df).collect()]
    assert got[0] == (1, "www.example.org", "/en/123", "example.org/en/1", "block", 0, 0)
    assert got[1] == (2, "", "", None, "allow", 0, 0)
    assert got[3] == got[4] == (4, "", "", None, "block", 1, 0)
    assert got[5] == (None, "x.com", "", None, "block", 0, 2)
    assert got[6][2] == "/a" * 50_000
    assert got[7][4:] == ("allow", 0, 1)
    assert got[8][1:4] == ("", "", None)
    assert url_filter.judge_urls(df.limit(0)).count() == 0
