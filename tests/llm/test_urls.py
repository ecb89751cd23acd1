"""URL rules, canonical forms, and the filter before the exact join."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from kvspace.llm import urls

URLS = [
    (1, "http://Www.Example.COM/en/7x?q#f"), (2, "https://example.com/en/8"), (3, "http://a.example.net/de/8"), (4, "x://net/de/"), (5, None), (6, "no url"), (7, "http://evil.org"),
    (8, "http://b.org/es/a/"), (9, "https://www.B.org:443/es/a?x=://y"), (10, "http://badexample.com/en/7"), (11, "a://b://c/d"), (12, "http:///en/"), (12, "http:///en/"), (13, "http://u@z.io:80/p//"), (14, "http://z.io/p"),
]


def test_judge(spark):
    pages = spark.createDataFrame(URLS, "page_id long, url string").selectExpr("*", "'c' AS host", "1 AS canonical")
    found = {r.page_id: tuple(r)[1:] for r in urls.judge(pages).collect()}
    assert found[1] == ("www.example.com", "/en/7x", "example.com/en/7", "allow", False)
    assert found[2][2:4] == ("com/en/", "block") and found[3][2:4] == ("example.net/de/8", "block") and found[4][:4] == ("net", "/de/", "net/de/", "allow")
    assert found[5] == found[6] == ("", "", None, "allow", False) and found[12] == ("", "/en/", None, "allow", False)
    assert found[8][2:] == ("org/es/", "block", True) and found[9][0] == "www.b.org:443" and found[9][4]
    assert found[10][2] == "com/en/" and found[11][:2] == ("b:", "//c/d")
    assert found[13][3:] == found[14][3:] == ("block", True)
    assert urls.judge(pages).count() == len(URLS) and urls.judge(pages.limit(0)).count() == 0


def test_list_in_parts(spark):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("h/"), F.col("id") % 1500).alias("canonical"))
    listed = spark.range(0, 3000, 3).select(F.concat(F.lit("h/"), "id").alias("canonical"))
    for most in (urls.MAX_LISTED, 300):
        found = urls.listed_flag(pages, listed, most).collect()
        assert len(found) == 3000 and all(r.listed == (int(r.canonical[2:]) % 3 == 0) for r in found)


def test_filter_has_no_false_negative(spark):
    keys = np.random.default_rng(3).integers(-(1 << 63), 1 << 63, 20_000)
    frame = spark.createDataFrame([(int(k),) for k in keys[:10_000]], "key long")
    words = urls.build_filter(frame, 10_000)
    assert words.nbytes <= 2 * 10_000 + 64
    other = spark.createDataFrame([(int(k),) for k in keys], "key long")
    hit = [r.m for r in other.select(urls.maybe_listed(F.col("key"), words, spark).alias("m")).collect()]
    assert all(hit[:10_000]) and sum(hit[10_000:]) < 300
