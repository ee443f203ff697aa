"""URL filters against the plain definition, over nested rules, hot hosts and odd urls."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from loomframe.llm.urls import RULES, filter_urls, rules_table

PAGES = "page_id long, url string, html string, host string, path string, key string, range string, stack string, copies string, id string"
ODD = [
    None, "", "no scheme", "http://", "://", "http://?q", "http://#x", "HTTP://EXAMPLE.Org/es/", "http://example.org", "http://example.org/es", "http://a.example.org/es/x?y#z",
    "http://notexample.org/es/", "ftp://x.com/fr/1://y", "http://org/", "http://.org/", "http://org./", "http://a..org/en/1", "http://com/de/#?", "http://x.com\n/de/\n1", "http://ÉX.com/fr/é日",
    "http://" + "a." * 3_000 + "com/fr/", "http://example.org/en/1" + "9" * 20_000, "http://u:p@example.org:80/en/1",
]


def plain(url, rules, default="allow"):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    fits = [
        (len(h) + len(p), len(h), h + p, v)
        for h, p, v in ((re.sub("[A-Z]", lambda m: m[0].lower(), h), p, v) for h, p, v in rules if None not in (h, p, v))
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=(0, 0, None, default))
    return host, path, best[2], best[3]


def check(spark, rows, rules, default="allow"):
    pages = spark.createDataFrame([(k, u, *["q"] * 8) for k, u in rows], PAGES).repartition(5)
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = Counter(tuple(r) for r in filter_urls(pages, table, default=default).collect())
    assert got == Counter((k, *plain(u, rules, default)) for k, u in rows)


@pytest.fixture(params=["true", "false"])
def ranges(spark, request):
    """Both as few ranges as the data ask for and many."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, request.param)
    yield
    spark.conf.set(name, "true")


def some_rules(rng, n):
    hosts = ["org", "com", "example.org", "a.example.org", "b.com", "x.b.com", "EXAMPLE.org", "é.org", "", "org."]
    path = lambda: "/" + "/".join(rng.choice(["a", "b", "ab", "日", "en"]) for _ in range(rng.randint(0, 4)))
    return [(rng.choice(hosts), path()[: rng.randint(0, 9)], rng.choice(["allow", "block", "review"])) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_nested_rules(spark, ranges, seed):
    rng = random.Random(seed)
    rules = some_rules(rng, 150) + [(None, "/", "block"), ("org", None, "block"), ("com", "/", None), ("bad/host", "/", "block"), ("q?", "", "block")]
    hosts = ["org", "com", "example.org", "www.a.example.org", "x.b.com", "y.x.b.com", "b.com", "é.org", "other.net", "", "org.", "a.org."]
    rows = [(k, f"https://{rng.choice(hosts)}/{'/'.join(rng.choice(['a', 'b', 'ab', 'abc', '日', 'en']) for _ in range(rng.randint(0, 4)))}{rng.choice(['', '?q=/a', '#b'])}") for k in range(400)]
    hot = "http://www.a.example.org/a/b"
    check(spark, rows + [(k, hot) for k in range(300)] + [(None, hot)] * 50 + [(7, hot)] * 5 + [(None, u) for u in ODD] + [(9, u) for u in ODD], rules)


def test_stated_rules_and_odd_urls(spark, ranges):
    check(spark, [(k, u) for k, u in enumerate(ODD)], RULES)
    check(spark, [(k, u) for k, u in enumerate(ODD)], RULES, default="block")


def test_many_rules_of_one_host(spark, ranges):
    rules = [("b.com", f"/{k:04d}", "block") for k in range(2_000)] + [("b.com", "/", "allow"), ("com", "/00", "block")]
    check(spark, [(k, f"http://w.b.com/{k % 3000:04d}/x") for k in range(3_000)], rules)


def test_empty_tables(spark):
    none = spark.createDataFrame([], PAGES)
    assert filter_urls(none, rules_table(spark)).collect() == []
    no_rules = rules_table(spark).filter("false")
    some = spark.createDataFrame([(1, "http://a.org/", *["q"] * 8)], PAGES)
    assert [tuple(r) for r in filter_urls(some, no_rules, default="block").collect()] == [(1, "a.org", "/", None, "block")]


def test_main_path_is_native(spark, capsys):
    pages = spark.createDataFrame([(1, "http://a.org/", *["q"] * 8)], PAGES)
    filter_urls(pages, rules_table(spark)).explain("formatted")
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", capsys.readouterr().out)
