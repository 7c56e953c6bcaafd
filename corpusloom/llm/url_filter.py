"""URL filters: rules for hosts and paths, found by hash prefixes of a URL's expressions.

A rule ``host, path, verdict`` fits its host and all subdomains where the URL's path starts with
the rule's. A URL is expanded into expressions, a host suffix with a path prefix each. Only shapes
that some rule has (labels of the host, length of the path) are expanded, so that any path
may be a rule's and long hosts stay linear. The first eight hexadecimal digits of an
expression's SHA-256 are the join key; rows that meet are confirmed by the full digest. Of the rules
that fit the longest wins (host and path together, then the host; block before allow for one rule
given twice). The work is built-in expressions only: equal rows are counted together in one
shuffle, and everything after it (expansion, join, precedence) keeps that partitioning.

Defined cases: a null URL or one without ``://`` has empty host and path and gets ``DEFAULT``, as does
any URL that no rule fits; a rule's host is lower-cased like a URL's; an empty rule table judges
everything by ``DEFAULT``. Repeated rows come back as often as they were, null ids are
ids like any other. All columns of the input are passed on, and since equal rows are counted by
them, pass keys rather than texts; names of results must not be present.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.skew import salted_join

DEFAULT = "allow"
PREFIX = 8
BROADCAST_RULES = 500_000
RESULTS = ("host", "path", "rule", "verdict")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The rules of the registered query.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path; both empty for null and where ``://`` is missing."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, path), 256)


def prepared(rules: DataFrame) -> DataFrame:
    """``prefix, digest, labels, reach, rule, rank, ruled``, one row for each host and path."""
    host = F.translate(F.coalesce("host", F.lit("")), _UPPER, _LOWER)
    single = rules.groupBy(host.alias("host"), F.coalesce("path", F.lit("")).alias("path")).agg(F.max("verdict").alias("ruled"))
    digest = _digest(F.col("host"), F.col("path"))
    return single.select(
        F.substring(digest, 1, PREFIX).alias("prefix"),
        digest.alias("digest"),
        _labels(F.col("host")).alias("labels"),
        F.length("path").alias("reach"),
        F.concat("host", "path").alias("rule"),
        F.struct(F.length("host") + F.length("path"), F.length("host")).alias("rank"),
        "ruled",
    )


def expressions(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """Digests of the host suffixes and path prefixes of ``shapes`` (labels, path length)."""
    listed = F.array(*(F.struct(F.lit(k).alias("labels"), F.lit(m).alias("reach")) for k, m in shapes))
    fitting = F.filter(listed, lambda s: (s["labels"] <= _labels(host)) & (s["reach"] <= F.length(path)))
    suffix = lambda s: F.call_function("substring_index", host, F.lit("."), -s["labels"])
    return F.transform(fitting, lambda s: _digest(suffix(s), F.substring(path, F.lit(1), s["reach"])))


def judge(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """``urls`` with ``host, path, rule, verdict``."""
    clash = set(RESULTS) & set(urls.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are results")
    known = prepared(rules)
    # bounded by the lengths of hosts and paths, not by the number of rules
    shapes = sorted((r["labels"], r["reach"]) for r in known.select("labels", "reach").distinct().collect())
    keys = [*urls.columns]
    row, times, found = "__row", "__times", "__found"
    counted = urls.groupBy(*keys).agg(F.count(F.lit(1)).alias(times))
    host, path = host_and_path(F.col(url_col))
    parsed = counted.withColumns({"host": host, "path": path})
    if not shapes:
        judged = parsed.withColumn(found, F.lit(None).cast("struct<rule:string,ruled:string>"))
    else:
        digests = F.explode_outer(expressions(F.col("host"), F.col("path"), shapes))
        asked = parsed.withColumn("__digest", digests).withColumn("__prefix", F.substring("__digest", 1, PREFIX))
        held = known.select(F.col("prefix").alias("__prefix"), F.col("digest").alias("__full"), "rule", "rank", "ruled")
        if known.count() <= BROADCAST_RULES:
            met = asked.join(F.broadcast(held), "__prefix", "left")
        else:
            met = salted_join(asked, held, ["__prefix"])
        confirmed = F.col("__digest") == F.col("__full")
        best = F.max_by(F.struct("rule", "ruled"), F.when(confirmed, F.col("rank")))
        judged = met.groupBy(*keys, "host", "path", times).agg(best.alias(found))
    again = judged.withColumn(row, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))))
    return again.select(
        *keys,
        "host",
        "path",
        F.col(f"{found}.rule").alias("rule"),
        F.coalesce(F.col(f"{found}.ruled"), F.lit(DEFAULT)).alias("verdict"),
    )


def op13_hash_prefix_rules(spark, sf_dir: str) -> DataFrame:
    urls = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(urls, rule_table(spark, RULES)).drop("url")


SQL = f"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(h, p, v) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
m AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM p AS q JOIN r ON (q.host = r.h OR ends_with(q.host, '.' || r.h)) AND starts_with(q.path, r.p) GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(v, '{DEFAULT}') AS verdict FROM p LEFT JOIN m USING (page_id)
"""
