"""URL filter against a plain reading of its rules."""

import random

import numpy as np
from pyspark.sql import functions as F

from lexilake.llm import urls

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
         ("com", "/de/", "block"), ("a.b", "", "block")]


def judged(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:at])
    path = rest[at:]
    return host, path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]


def test_rules(spark):
    pick = random.Random(1)
    hosts = ["org", "a.org", "Example.ORG", "x.example.org", "notexample.org", "com", "b.com", "com.net", "a.b", "x.a.b", "ä.ORG", "u@org:80", ".org", ""]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/123?q", "/en/2#x", "/fr/a", "/de/b/", "?a", "#b", "/a://b", "/\n/x"]
    given = [None, "", "nohost", "://", "http://", "a://b://c/fr/", "HTTP://ORG/"] + [
        f"{s}://{h}{p}" for s in ("http", "") for h in hosts for p in paths]
    pick.shuffle(given)
    pages = spark.createDataFrame(list(enumerate(given + given[:5])), "page_id long, url string").withColumn("verdict", F.lit("clash")).withColumn("host", F.lit(1))
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    listed = spark.createDataFrame([("http://b.com/en/2?session=1",), ("https://notexample.org/",)], "url string")
    for with_list in (False, True):
        got = {r["page_id"]: r for r in urls.judge_urls(pages, rules, listed if with_list else None).collect()}
        assert len(got) == len(given) + 5
        for i, url in enumerate(given + given[:5]):
            host, path = judged(url)
            fits = [(len(h) + len(p), h + p, v) for h, p, v in RULES if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
            rule = max(fits, default=(0, None, None))
            verdict = rule[2] or ("block" if with_list and (host, path) in (("b.com", "/en/2"), ("notexample.org", "/")) else "allow")
            assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule[1], verdict), url
    assert {r["verdict"] for r in urls.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}
    assert urls.judge_urls(pages.limit(0), rules).count() == 0


def test_the_filter_loses_nothing_and_stops_most(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("key"))
    table, blocks = urls.build_filter(keys)
    assert len(table) == blocks
    assert urls.maybe_listed(keys, table).count() == 5000
    others = spark.range(10_000, 60_000).select(F.xxhash64("id").alias("key"))
    assert urls.maybe_listed(others, table).count() < 1500
    assert not np.array(urls.build_filter(keys.limit(0))[0]).any()
