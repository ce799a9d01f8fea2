from pyspark.sql import functions as F

from tallygrid.llm import urls


def plain(url, listed):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host, rest = rest[:cut], rest[cut:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = rest[:next((i for i, c in enumerate(rest) if c in "?#"), len(rest))]
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if fits else None
    verdict = best[2] if best else "block" if host + path in listed else "allow"
    return host, path, best[1] if best else None, verdict


CASES = [None, "", "no scheme", "http://", "http://A.example.ORG/es/x?y://z", "https://example.org/en/1#f", "https://xexample.org/es/",
         "http://m.b.com/de/1", "http://com/fr/", "http://com", "ftp://u@h:8/p/q?r", "http://org", "http://org/", "x://é.Ö.net/\n/a", "http://a..com/de/",
         "http://" + "a." * 300 + "org/" + "p" * 5000, "http://listed.net/page?utm_source=1", "http://listed.net/page"]


def test_rules_and_list(spark):
    rows = [(i, u, "x", "y") for i, u in enumerate(CASES)] + [(0, CASES[0], "x", "y"), (None, CASES[4], "x", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, key string")
    listed = pages.where(F.col("url") == "http://listed.net/page").select("url")
    out = urls.judge_urls(spark, pages, "page_id", "url", listed, urls.RULES).collect()
    want = sorted(((r[0], *plain(r[1], {"listed.net/page"})) for r in rows), key=str)
    assert sorted((tuple(r) for r in out), key=str) == want
    assert urls.judge_urls(spark, pages.limit(0), "page_id", "url", listed.limit(0), urls.RULES).count() == 0


def test_a_full_filter_only_passes_more(spark):
    pages = spark.range(300).select(F.col("id").alias("page_id"), F.format_string("http://h%d.net/p", F.col("id")).alias("url"))
    listed = pages.where("page_id % 3 = 0").select("url")
    for most in (1, 1 << 10):
        out = urls.judge_urls(spark, pages, "page_id", "url", listed, [], most_blocks=most)
        assert {r["id"] for r in out.where("verdict = 'block'").collect()} == set(range(0, 300, 3))


def test_filter_keeps_all_it_holds(spark):
    keys = spark.range(500).select(F.col("id").cast("string").alias("key"))
    bloom = urls.bloom_filter(keys, 32)
    assert urls.may_hold(keys, bloom, 32).count() == 500
    other = spark.range(1000, 6000).select(F.col("id").cast("string").alias("key"))
    assert urls.may_hold(other, bloom, 32).count() < 500
