"""URL rules against a plain scan of all rules."""

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import url_filter as uf

URLS = [
    None, "", "no scheme", "http://", "https://COM/x", "http://example.com/en/a?x#y", "http://www.example.com/en/", "http://www.example.com/en",
    "http://EXAMPLE.com/en/../x", "http://example.comx/en/", "http://notexample.com/en/1", "ftp://a.b.net/es/", "x://net/fr/?://net/es/",
    "http://net?/fr/", "http://net#/fr/", "http://a.net/ES/", "http://.com/", "http://com./", "http://user@example.com/en/a", "http://example.com:80/en/",
    "://www.example.com/en/x://example.com/en/", "http://Ä.example.com/en/ü", "http://" + "a." * 3000 + "com/" + "p/" * 3000, "http://example.com",
]


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    path = rest[cut:]
    end = min((path.index(c) for c in "?#" if c in path), default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), path[:end]


def model(url, rules):
    host, path = parse(url)
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, uf.DEFAULT, None))
    return host, path, best[3], best[2]


MORE = [*uf.RULES, ("com", "/e", "block"), ("com", "", "allow"), ("b.net", "/es/x", "allow"), ("com", "/e", "allow"), ("ä.example.com", "/en/ü", "block")]


@pytest.mark.parametrize("rules", [uf.RULES, MORE, []])
@pytest.mark.parametrize("bound", [0, 500_000])
def test_equals_a_scan_of_all_rules(spark, monkeypatch, rules, bound):
    monkeypatch.setattr(uf, "BROADCAST_RULES", bound)
    rows = [(i if i % 5 else None, u, "extra") for i, u in enumerate([*URLS, *URLS[4:9], *["http://a.com/1"] * 30])]
    urls = spark.createDataFrame(rows, "page_id long, url string, digest string").repartition(4)
    got = sorted(map(tuple, uf.judge(urls, uf.rule_table(spark, rules)).collect()), key=repr)
    assert got == sorted((((i, u, d, *model(u, rules))) for i, u, d in rows), key=repr)


def test_equal_prefixes_are_confirmed_by_the_digest(spark, monkeypatch):
    monkeypatch.setattr(uf, "PREFIX", 1)
    rules = [(f"h{i}.net", "/", "block") for i in range(60)]
    urls = spark.createDataFrame([(i, f"http://h{i}.net/x") for i in range(120)], "page_id long, url string")
    assert {r["page_id"] for r in uf.judge(urls, uf.rule_table(spark, rules)).where("verdict = 'block'").collect()} == set(range(60))


def test_equal_urls_take_one_shuffle_and_no_python(spark):
    urls = spark.range(1000).select(F.lit(None).cast("long").alias("page_id"), F.lit("http://a.com/1").alias("url"))
    df = uf.judge(urls, uf.rule_table(spark, uf.RULES))
    assert df.where("rule = 'com/'").count() == 1000
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_empty_table_and_clashing_names(spark):
    assert uf.judge(spark.createDataFrame([], "page_id long, url string"), uf.rule_table(spark, uf.RULES)).collect() == []
    with pytest.raises(ValueError, match="host"):
        uf.judge(spark.createDataFrame([(1, "x", "y")], "page_id long, url string, host string"), uf.rule_table(spark, uf.RULES))
