import re

import cases
from pyspark.sql import functions as F

from lotwise.llm import url_filter
from lotwise.llm.common import ready

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
URLS = [
    None, "", "no scheme", "://", "http://", "http://EXAMPLE.com/en/x", "http://www.example.com/en/1", "https://a.b.net/es/é",
    "http://net/fr/", "http://xnet/fr/", "http://badexample.com/en/", "http://example.com", "http://example.com?q=/en/",
    "ftp://m.example.org:81/a.html#x", "http://example.org/a/", "http://example.org/a?b=http://c/d", "x://y://z/w",
    "http://www.example.org/a", "http://Example.ORG/a.html?utm=1", "http://other.org/b", "http://example.com/en",
]


def split(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return host.translate(LOWER), re.match(r"[^?#]*", rest[len(host) :]).group()


def canonical(url):
    host, path = split(url)
    host = re.sub(r"^(www|m)\.", "", re.sub(r":[0-9]*\Z", "", host))
    return host + re.sub(r"(\.html|/)\Z", "", path) if host else None


def brute(url, listed):
    host, path = split(url)
    fits = [
        (len(h + p), h + p, kind)
        for kind, h, p in url_filter.RULES
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    is_listed = canonical(url) in listed and canonical(url) is not None
    if fits:
        _, rule, verdict = max(fits)
    else:
        rule, verdict = None, "block" if is_listed else "allow"
    return host, path, rule, verdict, is_listed


def pages(spark, urls):
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return frame.withColumn("block", F.lit("clash")).withColumn("canonical", F.lit("clash")).withColumn("host", F.lit(1))


def check(spark, urls, list_, bits=url_filter.BLOCK_BITS):
    ready(spark)
    frame = spark.createDataFrame([(u,) for u in list_], "url string")
    rows = url_filter.judge(pages(spark, urls), frame, bits=bits).collect()
    listed = {canonical(u) for u in list_} - {None}
    assert {r["page_id"]: tuple(r)[1:] for r in rows} == {k: brute(u, listed) for k, u in enumerate(urls)}
    assert len(rows) == len(urls)


def test_rules_and_list_match_brute_force(spark):
    check(spark, URLS, ["http://example.org/a", "https://www.other.org/b/", None, "nothing", "http://example.org/a"])


def test_a_full_filter_is_corrected_by_the_join(spark):
    """With one block nearly every bit is set and everything is a possible hit."""
    listed = [f"http://site{k}.org/{k}" for k in range(500)]
    check(spark, URLS + listed[:50] + [f"http://site{k}.org/x" for k in range(200)], listed, bits=0)


def test_the_filter_has_no_false_negatives_and_few_false_positives(spark):
    ready(spark)
    inside = spark.range(5000).select(F.concat(F.lit("in.org/"), "id").alias("url"))
    blocks = url_filter.bloom(inside, 10)
    probe = inside.withColumn("real", F.lit(1)).unionByName(
        spark.range(5000).select(F.concat(F.lit("out.org/"), "id").alias("url"), F.lit(0).alias("real"))
    )
    found = probe.join(blocks, url_filter._block(F.col("url"), 10) == F.col("block"), "left")
    passed = found.filter(url_filter._possible(F.col("url"), F.col("words"))).groupBy("real").count().collect()
    counts = {r["real"]: r["count"] for r in passed}
    assert counts[1] == 5000 and counts.get(0, 0) < 50


def test_empty_tables(spark):
    check(spark, [], ["http://example.org/a"])
    check(spark, URLS, [])


def test_the_plan_has_no_python(spark):
    frame = spark.createDataFrame([("http://a.org/b",)], "url string")
    plan = url_filter.judge(pages(spark, URLS), frame)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert cases.empty(spark).count() == 0
