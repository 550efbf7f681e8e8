from mnemoframe.llm import url_filter
from mnemoframe.llm.queries import URL_HOSTS, URL_RULES

URLS = [
    "http://a.NET/x", "http://en.example.net/en/1?x", "https://example.com/de/9#f", "http://www.spam-farm.example.org/en/1", "http://q.org/fr/1", "http://q.org/fr", "ftp://net/", "http://net?x",
    "example.net/en/", "", None, "http://xnet/en/", "http://example.net/EN/1", "x://y://z/en", "http://h.example.com/de", "http://éÄ.net/ü",
]


def plain(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        for c in "?#":
            rest = rest.split(c, 1)[0]
        host, slash, tail = rest.partition("/")
        host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), slash + tail
    best = None
    for rule, verdict in URL_RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    if best:
        return host, path, *best
    hit = any(host == h or host.endswith("." + h) for h, _ in URL_HOSTS)
    return host, path, None, "block" if hit else "allow"


def test_rules_and_hosts(spark):
    rows = list(enumerate(URLS)) + [(3, URLS[3])]
    df = spark.createDataFrame([(i, u, "clash") for i, u in rows], "page_id long, url string, host string")
    want = sorted(((i, *plain(u)) for i, u in rows), key=str)
    for make in (lambda: url_filter.filter_urls(df, URL_RULES, URL_HOSTS), lambda: url_filter._joined(df, URL_RULES, URL_HOSTS, "url", "page_id", "allow")):
        assert sorted((tuple(r) for r in make().collect()), key=str) == want
    assert url_filter.filter_urls(df, [], []).filter("verdict = 'block'").count() == 0
    assert url_filter.filter_urls(df.limit(0), URL_RULES).count() == 0


def test_collisions_are_confirmed(monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda b, *a: len(b))
    array = url_filter.DigestArray.of([("aa", "block"), ("bb", "allow"), ("c", "block")])
    assert array.find([b"aa", b"bb", b"cc", b"c", b"ddd"]) == ["block", "allow", None, "block", None]
