import itertools
import re
import time

import pytest

from tessera.llm import urls

LISTED = ["tionsh.example.net/en/41230", "blog.thernt.example.net/en/45446", "h.net/%2F%zz%C3", "port.net:8080/a", "port.net/b", "x", ""]
ROWS = [
    (1, "http://Example.ORG/es/x?q#f"), (2, "https://a.example.org/en/17"), (3, "http://x.org/other"), (4, "http://x.org"), (5, None), (6, ""), (7, "no scheme/es/"),
    (8, "http://de.com/de/1"), (8, "http://de.com/de/1"), (9, "HTTP://B.com/fr/?x=://y"), (10, "http://notexample.org/es/"), (11, "http://tionsh.example.net/en/41230?utm"), (12, "ftp://u:p@h.com:80/de/"), (None, "http://a.org/"), (13, "x" * 100_000 + "://q.org/" + "p" * 100_000),
    (14, "http://Blog.thernt.example.net/en/45446/"), (15, "http://blog.thernt.example.net/en/45446//"), (16, "http://h.net/%2f%zz%c3/"), (17, "http://port.net:8080/a"), (18, "http://port.net:80/b"), (19, "https://port.net:443/b/#x"), (20, "http://port.net:81/b"), (21, "http://./"), (22, "http://a..org"), (23, "http://.org/"),
]


def brute_canonical(host, path):
    path = re.sub("%([0-9a-fA-F]{2})", lambda m: "%" + m[1].upper(), path)
    return re.sub(":(80|443)$", "", host) + (path[:-1] if path.endswith("/") else path)


def brute(url, rules=urls.RULES, listed=LISTED):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if h is not None and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    return host, path, None, "block" if brute_canonical(host, path) in listed else "allow"


def judged(spark, rows, rules=urls.RULES, listed=LISTED):
    pages = spark.createDataFrame([(i, u, "x", "y", 1) for i, u in rows], "page_id long, url string, host string, key string, block int")
    return urls.url_verdicts(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), spark.createDataFrame([(x,) for x in [*listed, None]], "url string")).collect()


def check(spark, rows, **lists):
    got = judged(spark, rows, **lists)
    assert sorted(map(repr, ((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got))) == sorted(map(repr, ((i, *brute(u, **lists)) for i, u in rows)))


def test_rules_and_list(spark):
    check(spark, ROWS)


@pytest.mark.parametrize("blocks", [0, 250_000])
@pytest.mark.parametrize("keys", [0, 50_000])
def test_filter_joined_by_block(spark, monkeypatch, blocks, keys):
    monkeypatch.setattr(urls, "FILTER_BYTES", 0)
    monkeypatch.setattr(urls, "BROADCAST_BLOCKS", blocks)
    monkeypatch.setattr(urls, "BROADCAST_KEYS", keys)
    check(spark, ROWS)


def test_conflicting_rules_in_any_order(spark):
    rules = [("a.org", "/x", "allow"), ("a.org", "/x", "block"), ("org", "/", "allow"), (None, "/x", "block"), ("a.org", None, "block"), ("a.org", "/x", "allow")]
    for order in (rules, rules[::-1]):
        got = judged(spark, [(1, "http://a.org/xy"), (2, "http://b.org/xy")], rules=order)
        assert {(r.page_id, r.rule, r.verdict) for r in got} == {(1, "a.org/x", "block"), (2, "org/", "allow")}


def test_many_path_lengths_and_labels(spark):
    rules = [("h.net", "/" + "p" * k, "block" if k % 2 else "allow") for k in range(400)] + [(".".join("abc"[:k]) + ".deep.net" * (k > 1), "/", "block") for k in range(4)]
    check(spark, [(k, f"http://{s}h.net/{'p' * n}") for k, (s, n) in enumerate(itertools.product(["", "w.", "xh"], [0, 1, 200, 399, 500]))] + [(99, "http://z.a.b.deep.net/"), (100, "http://a.b.c.deep.net/q")], rules=rules)


def test_a_host_of_many_labels(spark):
    judged(spark, ROWS)
    start = time.time()
    check(spark, [(1, "http://" + "a." * 20_000 + "example.org/es/")])
    assert time.time() - start < 15


def test_the_registered_list(spark):
    some = {r.url for r in urls.listed_urls(spark, 3).collect()}
    assert len(some) == 3 * len(urls.LISTED_HOSTS) * 2 and "m.spam-farm.example.com/es/2" in some
    rows = [(1, "http://m.spam-farm.example.com/es/2/?x"), (2, "http://m.spam-farm.example.com/es/2.html"), (3, "http://casino-win.example.com:80/en/0"), (4, "http://spam-farm.example.com/fr/1")]
    check(spark, rows, listed=sorted(some))


def test_empty(spark):
    assert judged(spark, []) == []
    none = spark.createDataFrame([], "host string, path string, verdict string")
    out = urls.url_verdicts(spark.createDataFrame(ROWS, "page_id long, url string"), none, spark.createDataFrame([], "url string")).collect()
    assert len(out) == len(ROWS) and all(r.rule is None and r.verdict == "allow" for r in out)
