import random

import numpy as np

from quarry.llm import url_filter as U

URLS = [None, "", "no scheme", "http://", "http:///path", "HTTPS://WWW.Spam-Farm.example.COM/a", "http://example.net", "http://example.net/", "http://a.example.net/en/x?y#z", "http://example.net/en", "ftp://example.com/de/", "http://badexample.com/de/x",
        "http://x.example.com/de/?q", "http://spam-farm.example.org/fr/1", "http://a.b.org/fr/", "http://org/fr/", "http://net", "http://net/", "x://y://z/w", "http://h?://q", "http://a#b/c", "http://casino-win.example.com.evil.org/", "http://é.net/ü", "http://a\nb/c\nd"]


def expected(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
    best = None
    for h, p, v in U.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    listed = any(host == b or host.endswith("." + b) for b in U.BLOCKED)
    return host, path, best[0] if best else None, best[1] if best else "block" if listed else "allow"


def test_verdicts_equal_brute_force(spark):
    rng = random.Random(2)
    urls = URLS + [f"http://{rng.choice(['', 'a.', 'www.'])}{rng.choice([b for b in U.BLOCKED] + ['fine.org', 'ok.example.com', 'z.net'])}{rng.choice(['', '/', '/en/1', '/de/2', '/fr/3?x'])}" for _ in range(300)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    for r in U.url_filter(pages).collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == expected(urls[r["page_id"]]), urls[r["page_id"]]


def test_cascades_are_exact_over_their_universe_whole_or_dealt(spark):
    listed = {f"k{i}" for i in range(0, 3000, 7)}
    keys = spark.createDataFrame([(f"k{i}", f"k{i}" in listed) for i in range(3000)], "key string, listed boolean")
    universe = keys.select(*[h.alias(n) for h, n in zip(U.hashes(keys["key"]), ("h1", "h2"))], "listed")
    rows = universe.toPandas()
    h1, h2 = rows["h1"].to_numpy(np.int64), rows["h2"].to_numpy(np.int64)
    for max_bits in (U.MAX_BITS, 500):
        cascades = U.build(universe, max_bits)
        assert (len(cascades) > 1) == (max_bits == 500)
        assert all(level.bits <= max(64, 3 * max_bits) for c in cascades for level in c)
        for part, cascade in enumerate(cascades):
            mine = h1 % len(cascades) == part
            assert (U.listed(cascade, h1[mine], h2[mine]) == rows["listed"].to_numpy()[mine]).all()
    assert len(U.build(universe)[0]) >= 2


def test_many_cascades_judge_as_one(spark, monkeypatch):
    monkeypatch.setattr(U, "MAX_BITS", 64)
    made = []
    whole = U.build
    monkeypatch.setattr(U, "build", lambda *args: made.append(whole(*args)) or made[-1])
    hosts = [f"h{i}.site{i % 50}.com" for i in range(400)]
    pages = spark.createDataFrame([(i, f"http://{h}/") for i, h in enumerate(hosts)], "page_id bigint, url string")
    blocked = spark.createDataFrame([(f"SITE{i}.com",) for i in range(0, 50, 3)] + [("h1.site1.com",), (None,), ("",)], "host string")
    got = {r["page_id"]: r["verdict"] for r in U.url_filter(pages, blocked, rules=()).collect()}
    assert got == {i: "block" if i % 50 % 3 == 0 or i == 1 else "allow" for i in range(400)}
    assert len(made[0]) > 1


def test_empty_lists_and_tables(spark):
    pages = spark.createDataFrame([(1, "http://spam-farm.example.org/x")], "page_id bigint, url string")
    none = spark.createDataFrame([], "host string")
    assert U.url_filter(pages, none).first()["verdict"] == "allow"
    assert U.url_filter(pages).first()["verdict"] == "block"
    assert U.url_filter(pages.limit(0)).collect() == []


def test_clashing_columns_long_urls_and_repeated_rows(spark):
    url = "http://www.spam-farm.example.com/" + "x" * 500_000 + "/fr/"
    rows = [(1, url, "mine", 5, "r"), (1, url, "mine", 5, "r"), (2, None, None, None, None), (2, "http://fine.org/fr/", "h", 1, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string, keys int, verdict string")
    got = sorted((r["page_id"], len(r["path"]), r["rule"] or "", r["verdict"]) for r in U.url_filter(pages).collect())
    assert got == [(1, 500_005, "", "block"), (1, 500_005, "", "block"), (2, 0, "", "allow"), (2, 4, "org/fr/", "allow")]
