import re

import pytest

from matchloom.llm import urlfilter

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    return re.match(r"[^/?#]*", rest)[0].translate(LETTERS), re.match(r"[^/?#]*([^?#]*)", rest)[1]


def key(url):
    host, path = parts(url)
    return re.sub(r"^www\.", "", re.sub(r":(80|443)$", "", host)) + re.sub(r"(\.html?)?/*$", "", path, count=1) if host else None


URLS = [
    None, "", "no scheme", "http://", "https://EXAMPLE.net/en/1", "https://example.net/de/1", "http://a.b.example.net/en/x?utm_source=feed", "http://example.net", "http://notexample.net/en/",
    "http://m.example.com/de/1", "http://m.example.com/De/1", "http://example.com/en/1.html", "https://www.example.com:443/en/1/", "http://x.org/fr/2#top", "http://x.org/fr", "http://org/fr/", "http://ÉCOLE.org/a",
    "http://host?x=://other/de/", "ftp://listed.com/p", "http://listed.com/p.htm?q", "http://listed.com/p/q", "http://a.b://c.net/", "http://listed.com/p\nq", "HTTP://Listed.COM/p/",
]


@pytest.mark.parametrize("broadcast", [8 << 20, 0])
def test_judgement(spark, broadcast):
    listed = ["http://listed.com/p", "https://www.example.com/en/1", None, "nonsense", "http://example.com/de/1"] + [f"http://other{i}.com/{i}" for i in range(300)]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)] + [(0, URLS[4], "again")], "page_id long, url string, key string")
    got = urlfilter.judge(pages, spark.createDataFrame([(u,) for u in listed], "url string"), RULES, most_broadcast=broadcast).collect()
    assert len(got) == len(URLS) + 1
    keys = {key(u) for u in listed} - {None}
    for r in got:
        url = URLS[4] if r.page_id == 0 and r.host else URLS[r.page_id]
        host, path = parts(url)
        assert (r.host, r.path) == (host, path)
        fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert r.rule == (max(fits)[1] if fits else None)
        assert r.listed == (key(url) in keys)
        assert r.verdict == (max(fits)[2] if fits else "block" if key(url) in keys else "allow")
        assert r.possible or not r.listed


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    listed = spark.range(5000).selectExpr("concat('http://l', id, '.com/', id) AS url")
    pages = spark.range(20000).selectExpr("id AS page_id", "concat('http://l', id, '.com/', id) AS url")
    got = urlfilter.judge(pages, listed).groupBy("listed", "possible").count().collect()
    counts = {(r.listed, r.possible): r["count"] for r in got}
    assert counts[True, True] == 5000 and (True, False) not in counts
    assert counts.get((False, True), 0) < 0.02 * 15000


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    some = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert urlfilter.judge(none, some).count() == 0
    assert urlfilter.judge(some, none).first().verdict == "allow"
