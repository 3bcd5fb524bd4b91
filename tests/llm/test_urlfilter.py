import re

from loomfold.llm import urlfilter as m

RULES = [(h, p, v) for v, h, p in m.RULES]
URLS = [None, "", "no scheme", "http://a.com", "http://A.COM/", "https://www.example.com/en/x", "http://m.www.Example.com/en/", "http://example.com/en", "http://x.example.com/en/?q=/fr/", "http://b.net/es/1#z", "http://net/fr/", "http://notnet/fr/", "http://c.net?a/fr/", "x://y://z.com/a", "http://com/", "http://u@v.net:80/fr/", "http://example.com./en/", "http:///fr/"]


def brute(url, rules):
    found = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), found[1]), found[2]) if found else ("", "")
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit)[2] if fit else None, max(fit)[3] if fit else "allow"


def check(spark, rules, urls, **how):
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = m.filter_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), **how).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute(urls[r["page_id"]], rules), r


def test_rules(spark):
    check(spark, RULES, URLS)
    check(spark, RULES, URLS, most_shapes=0)
    check(spark, RULES, URLS, broadcast_bytes=0)


def test_a_broadcast_list_needs_no_exchange_of_pages(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)], "page_id long, url string, html string")
    out = m.filter_urls(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 8 and plan.count("Project [page_id") >= 1
    out.collect()
    physical = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in physical


def test_long_urls_and_many_shapes(spark):
    rules = [(".".join(["a"] * k + ["org"]), "/" + "p" * (7 * k), "block") for k in range(1, 30)]
    urls = [f"http://{'.'.join(['a'] * k + ['org'])}/{'p' * 300}{'x' * 50_000}" for k in range(0, 33, 3)]
    check(spark, rules, urls)


def test_a_long_list_and_its_false_positives(spark):
    rules = [(f"h{i}.example.org", f"/{'p' * (i % 5)}", "block") for i in range(3000)]
    check(spark, rules, [f"http://{s}h{i}.example.org/{'p' * (i % 7)}x" for i in range(0, 6000, 11) for s in ("", "www.")])


def test_repeats_nulls_and_nothing(spark):
    kind = "page_id long, url string, html string"
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(None, "http://a.com/", None), (None, "http://a.com/", None), (1, None, None), (1, None, None), (2, "http://q.net/es/", None)], kind)
    got = m.filter_urls(pages, rules).collect()
    assert len(got) == 5 and [r["rule"] for r in got if r["url"] == "http://a.com/"] == ["com/", "com/"]
    assert m.filter_urls(spark.createDataFrame([], kind), rules).count() == 0
    assert {r["verdict"] for r in m.filter_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_filter_has_no_false_negatives(spark):
    keys = spark.range(5000).selectExpr("concat('k', id) AS key")
    blocks = 120
    probe = spark.range(20_000).selectExpr("id", "concat('k', id) AS key")
    hit = probe.withColumn("block", m._block(probe["key"], blocks)).join(m.bloom_blocks(keys, blocks), "block").where(m.might_hold(probe["key"]))
    assert hit.where("id < 5000").count() == 5000
    assert hit.where("id >= 5000").count() < 1500
