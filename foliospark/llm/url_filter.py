"""URL filters: host-suffix and path-prefix expressions met by hash prefix, full digest and precedence."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import ascii_lower, fresh

#: Rules of the contract: verdict, host, path.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    """From the end of the host up to ?, # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rules_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", prefix_digits: int = 8) -> DataFrame:
    """The verdict of the longest rule that fits each url, else default.

    rules: verdict (block or allow), host, path. A rule fits its host and all subdomains when the url's path
    starts with the rule's. Of rules as long as each other a block wins, then the first by text. Rows of
    rules with a null fit nothing. A null url, or one without ://, has an empty host and path and gets
    default. Adds host, path, rule (host and path, null without a fit) and verdict; columns so named go.

    Each distinct url is expanded into its host suffixes times those prefixes of its path whose length some
    rule has (the lengths are a set no larger than the longest path of a rule). Expressions meet rules by
    equality of the first hex digits of their digests; the whole digests then decide. Distinct urls bound
    the work of a hot url, and the join back may split it.
    """
    spark = pages.sparkSession
    digest = lambda c: F.sha2(c, 256)
    known = rules.dropna().distinct().select(
        F.concat("host", "path").alias("rule"), F.concat_ws("\n", ascii_lower(F.col("host")), "path").alias("e"), "verdict", F.length("path").alias("n")
    )
    lengths = sorted(r.n for r in known.select("n").distinct().collect())
    known = known.select("rule", "verdict", digest(F.col("e")).alias("full")).withColumn("short", F.substring("full", 1, prefix_digits))
    one = pages.select(F.col(url).alias("url")).where(F.col("url").isNotNull()).distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))
    prefixes = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]) if lengths else F.array().cast("array<string>")
    fits = (
        one.select("url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
        .where(F.col("host") != "")
        .withColumn("labels", labels)
        .select("url", F.explode(suffixes).alias("suffix"), F.array_compact(prefixes).alias("prefixes"))
        .select("url", "suffix", F.explode("prefixes").alias("prefix"))
        .select("url", digest(F.concat_ws("\n", "suffix", "prefix")).alias("own"))
        .withColumn("short", F.substring("own", 1, prefix_digits))
        .join(known, "short")
        .where(F.col("own") == F.col("full"))
        .groupBy("url")
        .agg(F.min(F.struct((-F.length("rule")).alias("n"), F.when(F.col("verdict") == "block", 0).otherwise(1).alias("o"), "rule", "verdict")).alias("best"))
    )
    u, r, v = fresh(pages, "_u", "_r", "_v")
    best = fits.select(F.col("url").alias(u), F.col("best.rule").alias(r), F.col("best.verdict").alias(v))
    own = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return pages.join(best, F.col(f"`{url}`") == F.col(u), "left").select(
        *own, url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"), F.col(r).alias("rule"), F.coalesce(v, F.lit(default)).alias("verdict")
    )


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, rules_table(spark)).select("page_id", "host", "path", "rule", "verdict")


SQL = """
WITH r(verdict, host, path) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'),
  ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages
), m AS (
  SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST, r.verdict DESC) AS k
  FROM p LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
