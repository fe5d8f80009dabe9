import re

from gneiss.llm import registry, urls
from tests.oracle import compare

SF = "/root/testdata/sf0.01"


def slow(url, listed):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for rule, verdict in urls.RULES:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    if best:
        return host, path, *best
    canon = re.sub(r"^(www|m)\.", "", re.sub(r":(80|443)$", "", host)) + re.sub("/$", "", path)
    return host, path, None, "block" if host and canon in listed else "allow"


def test_matches_brute_force(spark):
    made = ["https://A.example.ORG/es/x?y#z", "http://example.org/en/12", "http://org/", "http://xorg/", "ftp://b.com/fr/", "http://b.com/fr", "http://b.com/de/q://r/s", None, "", "no scheme", "://x.net/a", "http://", "http://x.net?u=/a#b", "http://www.x.net:80/a/", "http://x.net/a#c", "http://x.net/b", "HTTP://M.X.NET/a\nb", "http://x.net", "http://x.net/"]
    made += [f"http://h{i % 7}.net/p{i}" for i in range(300)]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(made)] + [(None, "http://x.net/a", "c")], "page_id long, url string, word string")
    listed = ["x.net/a", "x.net", None, "x.net/a"] + [f"h{i % 7}.net/p{i}" for i in range(0, 300, 3)]
    for most in (64 << 20, 0):  # with and without broadcast
        got = urls.filter_urls(pages, spark.createDataFrame([(u,) for u in listed], "url string"), bits_per_url=4, broadcast_bytes=most).collect()
        assert len(got) == len(made) + 1
        for r in got:
            url = made[r.page_id] if r.page_id is not None else "http://x.net/a"
            assert (r.host, r.path, r.rule, r.verdict) == slow(url, set(listed)), url
    none = urls.filter_urls(pages.limit(0), spark.createDataFrame([], "url string"))
    assert none.count() == 0


def test_filter_has_no_false_negative_and_few_false_positives(spark):
    listed = spark.range(4000).selectExpr("concat('host.net/', id) AS url")
    bloom = urls.bloom_filter(listed, 4000 * 16 // 64)
    other = spark.range(4000, 12000).selectExpr("concat('host.net/', id) AS url")

    def passing(rows):
        mask = urls._mask(rows.url, 5)
        return rows.join(bloom, urls._block(rows.url, 1000) == bloom.block).where(bloom.word.bitwiseAND(mask) == mask).count()

    assert passing(listed) == 4000
    assert passing(other) < 0.03 * 8000


def test_oracle(spark):
    compare(spark, registry.QUERIES["op4_url_filter"], registry.ORACLES["op4_url_filter"], SF)
