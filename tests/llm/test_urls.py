"""URL filters: trie and join against a plain search of all rules."""

import random

import pytest

from loomtext.llm import urlfilter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    path = rest[end:]
    return rest[:end].translate(LOWER), path[: min((path.index(c) for c in "?#" if c in path), default=len(path))]


def plain(url, rules, default):
    host, path = parts(url)
    fits = [(h.count("."), len(p), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


URLS = [
    None, "", "no scheme", "x://net", "x://NET/", "a://b://net/", "http://a.org/fr/x?y", "http://aorg/fr/", "://example.net/en", "http://example.net#/en/", "http://x.example.com/de/\n/k",
    "http://example.net:80/en/", "http://..net/", "http://net./", "http://É.NET/", "http:///en/", "http://h" + ".net" * 400 + "/x", "http://net/" + "y" * 100_000, "http://a.b.net/e/n//?",
]


@pytest.mark.parametrize("most", [1000, 0])
def test_rules(spark, most):
    rng = random.Random(2)
    labels, folders = ["net", "org", "a", "b", "example"], ["", "en", "e", "n", "de"]
    rules = {}
    for _ in range(60):
        host = ".".join(rng.choices(labels, k=rng.randint(1, 3)))
        path = rng.choice(["", "/", "/e", "/" + "/".join(rng.choices(folders, k=rng.randint(1, 3)))])
        rules[host, path] = rng.choice(["allow", "block"])
    rules = [(h, p, v) for (h, p), v in rules.items()]
    urls = URLS + [f"http://{'.'.join(rng.choices(labels, k=rng.randint(1, 4)))}/{'/'.join(rng.choices(folders, k=rng.randint(0, 4)))}" for _ in range(300)]
    pages = spark.createDataFrame([(i, u, "k", 1) for i, u in enumerate(urls + urls[:9])], "page_id int, url string, filter string, host int")
    got = urlfilter.judge_urls(pages, urlfilter.rule_table(spark, rules), default="block", broadcast_rules=most)
    assert got.columns == ["page_id", "url", "host", "filter"]
    rows = got.collect()
    assert len(rows) == pages.count()
    for r in rows:
        assert tuple(r.filter) == plain(r.url, rules, "block"), r.url


@pytest.mark.parametrize("most", [1000, 0])
def test_odd_rules(spark, most):
    rules = [("NET", None, "block"), (None, "/", "block"), ("", "/", "block"), ("org", "/", "deny"), ("a.net", "/k", "allow"), ("a.net", "/k", "block"), ("b.net", "/", "allow"), ("b.net", "/", "allow")]
    pages = spark.createDataFrame([("http://x.net",), ("http://a.net/key",), ("http://b.net/",), ("http://org/",), (None,)], "url string")
    table = spark.createDataFrame(rules, urlfilter.RULES)
    got = {r.url: (r.filter.rule, r.filter.verdict) for r in urlfilter.judge_urls(pages, table, broadcast_rules=most).collect()}
    assert got == {"http://x.net": ("net", "block"), "http://a.net/key": ("a.net/k", "block"), "http://b.net/": ("b.net/", "allow"), "http://org/": (None, "allow"), None: (None, "allow")}
    assert urlfilter.judge_urls(pages.limit(0), table, broadcast_rules=most).count() == 0
    assert {r.filter.verdict for r in urlfilter.judge_urls(pages, table.limit(0), broadcast_rules=most).collect()} == {"allow"}
