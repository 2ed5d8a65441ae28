"""The cascade against plain sets."""

import random

import numpy as np

from vellumix.llm import urlfilter as u


def pages(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")


def listed(spark, names):
    return spark.createDataFrame([(n,) for n in names], "key string")


def test_keys(spark):
    cases = {
        "HTTP://u:p@A.b.Example.com.:80/x/Y/?q#f": ["a.b.example.com", "b.example.com", "example.com", "a.b.example.com/x/y"],
        "https://localhost": ["localhost"],
        "https://example.com?x=/a": ["example.com"],
        "no url": [],
        "": [],
        None: [],
    }
    got = [r.k for r in pages(spark, cases).select(u.keys(u.F.col("url")).alias("k")).collect()]
    assert got == list(cases.values())


def test_exact_over_the_universe(spark):
    r = random.Random(4)
    urls = [f"http://{r.choice('abc')}.d{r.randrange(4000)}.example.com/{r.randrange(9)}" for _ in range(6000)]
    names = [f"d{i}.example.com" for i in range(0, 4000, 3)] + [f"a.d{i}.example.com/4" for i in range(900)] + ["not.seen.example", None, "", "d0.example.com"]
    known = set(names)
    got = u.flag(pages(spark, urls), listed(spark, names)).collect()
    assert len(got) == len(urls)
    for x in got:
        host, _, path = x.url[7:].partition("/")
        assert x.host == host and x.blocked == (host in known or host.partition(".")[2] in known or f"{host}/{path}" in known)
    assert sum(x.blocked for x in got) not in (0, len(got))


def test_shards_and_levels(spark, monkeypatch):
    urls = [f"http://d{i}.example.com" for i in range(3000)]
    names = [f"d{i}.example.com" for i in range(0, 3000, 7)]
    rows, uni = u._keyed(listed(spark, names)), u._keyed(listed(spark, [x[7:] for x in urls]))
    monkeypatch.setattr(u, "FIRST_RATE", 0.4)
    levels = u.build(uni, 1000, rows)
    assert len(levels) > 3
    both = uni.toArrow()
    assert u.decide(levels, both["h1"].to_numpy(), both["h2"].to_numpy()).tolist() == [k in set(names) for k in both["key"].to_pylist()]
    monkeypatch.setattr(u, "SHARD_KEYS", 100)
    assert {x.page_id for x in u.flag(pages(spark, urls), listed(spark, names)).collect() if x.blocked} == set(range(0, 3000, 7))


def test_cases(spark):
    urls = ["https://x.bad.example.com/a", None, "", "http://bad.example.com", "http://notbad.example.com", "http://bad.example.com", "http://ok.example.com/" + "y" * 100_000]
    df = pages(spark, urls).selectExpr("*", "1 AS key", "2 AS blocked", "3 AS host")
    names = listed(spark, ["Bad.Example.com "])
    assert [x.blocked for x in u.flag(df, names).orderBy("page_id").collect()] == [True, False, False, True, False, True, False]
    kept = u.filter_pages(df, names)
    assert kept.columns == df.columns and sorted(x.page_id for x in kept.collect()) == [1, 2, 4, 6]
    assert not any(x.blocked for x in u.flag(df, names.limit(0)).collect()) and u.filter_pages(df, names.limit(0)).count() == 7
    assert u.flag(df.limit(0), names).count() == 0
    assert np.all(u.Bloom(np.arange(50), np.arange(50), 0.01, 0).has(np.arange(50), np.arange(50)))


def test_listed_keys_however_they_are_written(spark):
    pages = spark.createDataFrame([(1, "https://a.bad.org/x/y"), (2, "http://good.org/p/q/?z"), (3, "http://good.org/p"), (4, "http://b.net.:8080/"), (5, None)], "page_id long, url string")
    listed = spark.createDataFrame([("HTTPS://Bad.ORG:443/",), ("good.org/p/q/",), ("b.net.",), (None,), ("",)], "key string")
    assert {r.page_id: r.blocked for r in u.flag(pages, listed).collect()} == {1: True, 2: True, 3: False, 4: True, 5: False}
    assert sorted(r.page_id for r in u.filter_pages(pages, listed).collect()) == [3, 5]
    plan = u.filter_pages(pages.withColumn("html", pages.url), listed)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInArrow" not in plan
