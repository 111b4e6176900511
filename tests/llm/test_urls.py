import pytest

from sparqa.llm import urls

URLS = [
    None, "", "no scheme", "http://", "http://com", "http://com/", "https://WWW.Example.com/en/x?y#z", "https://a.example.com/en/", "https://example.com/en",
    "https://example.com/english/", "http://x.net/es/1", "http://x.net/fr/", "http://net/fr/a/b", "http://badnet/fr/", "ftp://user@EXAMPLE.com:80/en/", "http://example.com?x=/en/",
    "http://é.com/ü", "x://y://z.com/en/", "http://www.example.com/en/en/", "http://m.www.example.com/en/", "http://example.com./en/", "http://\nexample.com/en/\nq", "http://a.com/" + "p/" * 3000]
RULES = list(urls.RULES) + [("com", "/en", "block"), ("a.com", "/p/p/", "block"), ("net", "/fr/a/", "allow"), ("net", "/fr/a/", "block"), ("", "/", "block"), ("example.com", "", "allow")]


def brute(url, rules, default):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min((i for i in (path.find(c) for c in "?#") if i >= 0), default=len(path))]
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


@pytest.mark.parametrize("rules", [list(urls.RULES), RULES])
@pytest.mark.parametrize("limit", [200_000, 0])
def test_same_as_all_rules(spark, monkeypatch, rules, limit):
    monkeypatch.setattr(urls, "BROADCAST_RULES", limit)
    pages = spark.createDataFrame([(i % 20, u, "clash", "clash") for i, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    as_table = spark.createDataFrame(rules + [(None, "/", "block")], "host string, path string, verdict string")
    for given in (rules, as_table):
        got = urls.judge(pages, given, "block").collect()
        assert len(got) == len(URLS)
        for r in got:
            assert (r.host, r.path, r.rule, r.verdict) == brute(r.url, rules, "block"), r.url


def test_empty(spark):
    pages = spark.createDataFrame([("a", "http://x.com/")], "page_id string, url string")
    assert urls.judge(pages.limit(0)).count() == 0
    assert urls.judge(pages, []).first().verdict == urls.DEFAULT
