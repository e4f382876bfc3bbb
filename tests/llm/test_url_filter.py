import random
import re

from pyspark.sql import functions as F

from riskflow.llm import url_filter as u


def brute(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):], re.S)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def brute_rule(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in u.RULES if ("." + host).endswith("." + h) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = ["http://Www.Example.com/en/1", "https://a.b.example.com/en/x?q=1", "https://example.com/fr/x#top", "http://x.net/es/1", "http://x.net/fr",
        "http://net/fr/9", "https://spam-farm.site.org/a/", "http://m.spam-farm.site.org/a.html?x", "https://blog.spam-farm.site.org/b#c",
        "https://notexample.com/en/1", "ftp://h", "no scheme", "", None, "http://", "http:///p", "a://b://c/d", "http://ex.org?x/y", "http://ÄX.org/ü",
        "http://other.org/a", "http://h.org/" + "x" * 50000, "http://example.com/en/1\n2", "http://www.example.com/EN/1"]


def pages(spark, urls):
    return spark.createDataFrame([(i if i % 7 else None, x, "c", 1) for i, x in enumerate(urls)], "page_id long, url string, host string, rule int")


def test_rules_and_parts(spark):
    table = pages(spark, URLS + URLS[:3])
    out = u.filter_urls(table.withColumn("n", F.col("page_id")), u.spam_list(table)).collect()
    got = sorted((str(r["page_id"]), r["host"], r["path"], str(r["rule"])) for r in out)
    want = []
    for i, x in enumerate(URLS + URLS[:3]):
        h, p = brute(x)
        want.append((str(i if i % 7 else None), h, p, str(brute_rule(h, p)[0])))
    assert got == sorted(want)
    for r in out:
        rule, verdict = brute_rule(r["host"], r["path"])
        listed = rule is None and "spam-farm" in r["host"].split(".")
        assert r["verdict"] == (verdict or ("block" if listed else "allow"))


def test_bloom_has_no_false_negative_and_join_removes_false_positives(spark):
    rng = random.Random(5)
    every = [f"h{rng.randrange(10**9)}.org/p{i}" for i in range(20000)]
    listed = spark.createDataFrame([(x,) for x in every[:5000]], "canonical string")
    urls = spark.createDataFrame([(x,) for x in every], "canonical string")
    assert {r[0] for r in u.listed_of(urls, listed).collect()} == set(every[:5000])
    filter_, blocks = u.bloom(listed)
    h = u.url_hash(F.col("canonical"))
    possible = (urls.withColumns({"block": u.block_of(h, blocks), "probe": u.block_mask(h)}).join(filter_, "block")
                .where(F.col("mask").bitwiseAND(F.col("probe")) == F.col("probe")).count())
    assert 5000 <= possible < 5000 + 0.05 * 15000


BAD, FINE, SHARED = ("bad passage that only the toxic documents hold, long enough", "fine passage that only the clean documents hold, long enough",
                     "passage of both kinds of documents, also long enough to count")


def corpus(spark):
    texts = [(1, f"intro\n {BAD} \n{SHARED}"), (2, f"{FINE}\n{SHARED}"), (3, BAD), (4, None), (5, ""), (6, f"{FINE} two"), (None, FINE), (7, f"{BAD} twice")]
    documents = spark.createDataFrame([(*r, "p") for r in texts], "doc_id long, text string, passage string")
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0), (4, 0, 1), (5, 0, 1), (6, 0, None), (None, 0, 1), (7, 0, 1), (7, 0, 0), (1, 0, 1)],
                                   "doc_id long, quality int, toxic int")
    return documents, labels


def test_list_from_what_pages_hold(spark):
    documents, labels = corpus(spark)
    found = u.evidence(documents, labels)
    lines = spark.createDataFrame([(x,) for x in (BAD, FINE, SHARED)], "line string").select("line", F.md5("line").alias("passage"))
    assert [r["line"] for r in lines.join(found, "passage").collect()] == [BAD]
    html = [("http://www.good.org/a/", f"<p>{BAD}</p>"), ("http://m.good.org/a.html?x=1", "<p>nothing here</p>"), ("http://good.org/b", f"<p>{SHARED}<br>{FINE}</p>"),
            ("http://other.org/a", f"<p>x {BAD}</p>"), ("http://good.org/c", None), (None, f"<p>{BAD}</p>"), ("http://x.net/es/1", f"<b>{BAD}"),
            ("http://www.good.org/a/", f"<p>{BAD}</p>"), ("http://far.org", "<p>" + "long " * 20000 + f"</p>{BAD}<p>")]
    pages = spark.createDataFrame([(i, x, h, "c") for i, (x, h) in enumerate(html)], "page_id long, url string, html string, canonical string")
    listed = u.content_list(pages, found)
    assert {r[0] for r in listed.collect()} == {"good.org/a", "x.net/es/1", "far.org/"}
    got = {r["page_id"]: r["verdict"] for r in u.filter_urls(pages, listed).collect()}
    assert got == {0: "block", 1: "block", 2: "allow", 3: "allow", 4: "allow", 5: "allow", 6: "block", 7: "block", 8: "block"}


def test_evidence_of_empty_tables(spark):
    documents, labels = corpus(spark)
    assert u.evidence(documents.limit(0), labels).collect() == [] and u.evidence(documents, labels.limit(0)).collect() == []
    some = spark.createDataFrame([(1, "http://good.org/a", f"<p>{BAD}</p>")], "page_id long, url string, html string")
    assert u.content_list(some, u.evidence(documents, labels.limit(0))).collect() == []


def test_empty(spark):
    table = pages(spark, URLS).limit(0)
    assert u.filter_urls(table, u.spam_list(table)).collect() == []
