import random
import re

import pytest

from paperloom.llm import url_filter as U


def brute(glob, text):
    return re.fullmatch("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob), text, re.S) is not None


def test_automaton_equals_regular_expressions():
    rng = random.Random(4)
    word = lambda n, alphabet: "".join(rng.choice(alphabet) for _ in range(rng.randint(0, n)))
    globs = [word(9, "ab*?é") for _ in range(120)] + ["", "*", "?", "**", "a" * 100 + "*" + "b" * 40]
    texts = [word(14, "abé🎉") for _ in range(200)] + ["", "a" * 100 + "zz" + "b" * 40]
    got = U.Automaton(globs).match(texts)
    assert [[bool(x) for x in r] for r in got] == [[brute(g, t) for g in globs] for t in texts]


URLS = [
    "  HTTP://WWW.Example.COM:80/Path/?utm_source=x&a=1&ref=q#frag ", "https://example.com:443", "http://spam-farm.example.org/x", "http://a.spam-farm.example.org/x", "https://a.example.com/en/casino", "ftp://files.example.org/a", "http://x.y/casino", "", None, "no scheme/At/all//",
    "http://x.y/" + "long/" * 5000 + "page.html", "http://x.y/p?page=3&z=1", "http://x.y/p?utm_a=1", "http://x.y/de/Straße",
]


def pages(spark, urls, clash=False):
    df = spark.createDataFrame([(k, u, "x", "y") for k, u in urls], "page_id long, url string, r string, rules string" if clash else "page_id long, url string, html string, x string")
    return df.repartition(2)


def test_matches_sql(spark, same):
    df = pages(spark, [*enumerate(URLS), (0, URLS[0]), (None, URLS[2])], clash=True)
    same(U.apply(df, U.RULES), U.SQL, pages=df)


def test_canonical_and_cases(spark):
    got = {r["page_id"]: r for r in U.apply(pages(spark, enumerate(URLS)), U.RULES).collect()}
    assert got[0]["canonical_url"] == "http://example.com/Path/?a=1" and got[1]["canonical_url"] == "https://example.com"
    assert got[2]["blocked"] and got[3]["blocked"] and not got[4]["blocked"] and got[5]["blocked"] and got[10]["blocked"]
    assert got[8]["canonical_url"] is None and got[8]["rules"] == "" and not got[8]["blocked"] and not got[7]["blocked"]


@pytest.mark.parametrize("urls", [[], [(1, "http://x.y/casino")]])
def test_no_rules_or_rows(spark, urls):
    assert [r["blocked"] for r in U.apply(pages(spark, urls), []).collect()] == [False] * len(urls)
