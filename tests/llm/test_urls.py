import random

import pytest
from pyspark.sql import functions as F

from strandloom.llm import urls

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("example.com", "/", "block"), ("net", "", "allow"), ("a.net", "/x", "block"), ("COM", "/en/9", "allow"), ("b.a.net", "/x/y", "allow")]


def slow(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    rest = rest.split("#")[0]
    host = rest.split("?")[0].split("/")[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    bare = rest.split("?")[0]
    path = bare[bare.index("/") :] if "/" in bare else ""
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in ((h.lower(), p, v) for h, p, v in RULES) if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def made(n, seed=0):
    rnd = random.Random(seed)
    hosts = ["example.com", "x.example.com", "xexample.com", "com", "a.net", "b.a.net", "ba.net", "C.B.a.NET", "other.org", "", "example.com:80"]
    return [rnd.choice(["http", "HTTPS", ""]) + rnd.choice(["://", "://", ":/"]) + rnd.choice(hosts) + rnd.choice(["", "/", "/en/", "/en/71", "/x/y/z", "/en/9?q=/x", "#/en/", "?a=/en/7"]) for _ in range(n)]


@pytest.mark.parametrize("sampled", [32, 1])
def test_against_all_rules_one_by_one(spark, monkeypatch, sampled):
    monkeypatch.setattr(urls, "SAMPLED_KEYS", sampled)
    given = [*made(400), None, "", "http://", "://example.com/en/7", "http://a.net/x" + "y" * 50_000] + ["http://x.example.com/en/7"] * 300
    pages = spark.createDataFrame(list(enumerate(given)), "page_id long, url string").withColumn("HOST", F.lit("clash")).withColumn("part", F.lit(0)).withColumn("key", F.lit(0))
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages, rules).collect()}
    assert got == {k: slow(u) for k, u in enumerate(given)}


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.com/en/")], "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert urls.judge(pages.where("false"), rules).count() == 0
    assert urls.judge(pages, rules.where("false")).first()["verdict"] == "allow"
