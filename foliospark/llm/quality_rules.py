"""Quality rules: failures of a document's rules, pooled by host under an empirical beta prior.

Each host has a posterior of its own for each rule. Where it lies surely above the rule's prior mean, the host is over the
rule; surely below, under it. What a failure means for a document depends on that verdict of its host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import WS, WS_CLASS, fresh, row_key, written

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Rules by name, over the counts. The first two are the base rules; each alone rejects a document.
BASE = {"short": "n_words < 50", "repetitive": "100 * n_repeat_words > 50 * n_words"}
#: A failure of a firm rule rejects the document, unless its host is under the rule; one of a soft rule only where its host is over it.
FIRM = {"symbols": "10 * n_symbols > word_chars"}
SOFT = {"dup_lines": "10 * n_dup_lines > 3 * n_lines"}
RULES = BASE | FIRM | SOFT
SURE = 1.6448536269514722  # deviations of a normal distribution that 95 % stay under
BASE_FAILED = " OR ".join(f"({rule})" for rule in BASE.values())
#: Over host_rates(): the document fails a rule of which its host's verdict makes that count.
HOST_FAILED = " OR ".join(f"(({rule}) AND coalesce(counts_{name}, false))" for name, rule in (FIRM | SOFT).items())


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    r"""docs and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (all long).

    Null counts as empty: no words, one line without words. Columns so named are replaced.
    Repeats in a text of n words: each 3-word window becomes its 64-bit hash and its position, these are sorted,
    and neighbours with equal hashes give the positions that are covered. So a long text takes n log n steps in
    one row and no shuffle.
    """
    body, words, hashes, wins, again, lines, worded = fresh(docs, "_t", "_w", "_h", "_s", "_r", "_l", "_worded")
    c = F.col

    def window(h: Column, i: Column) -> Column:
        return F.struct(F.xxhash64(h, F.get(c(hashes), i + 1), F.get(c(hashes), i + 2)).alias("h"), i.alias("i"))

    def shared(x: Column, i: Column) -> Column:
        near = lambda j: F.coalesce(F.get(c(wins), j)["h"] == x["h"], F.lit(False))
        return near(i - 1) | near(i + 1)

    covered = F.array_distinct(F.flatten(F.transform(c(again), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    trimmed = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(WS))
    own = [x for x in docs.columns if x not in (*COUNTS, "n_lines")]
    return (
        docs.select(*[f"`{x}`" for x in own])
        .withColumn(body, trimmed)
        .withColumn(words, F.when(c(body) == "", F.array().cast("array<string>")).otherwise(F.split(body, WS_CLASS + "+", -1)))
        .withColumn(lines, F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1))
        .withColumns({hashes: F.transform(words, lambda w: F.xxhash64(w)), "n_words": F.size(words).cast("long"), "word_chars": F.length(F.array_join(words, "")).cast("long")})
        .withColumn(wins, F.sort_array(F.transform(F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - 2, F.lit(0))), window)))
        .withColumn(again, F.filter(wins, shared))
        .withColumn(worded, F.filter(lines, lambda x: F.btrim(x, F.lit(WS)) != ""))
        .select(
            *[f"`{x}`" for x in own], "n_words", "word_chars",
            F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            (F.size(worded) - F.size(F.array_distinct(worded))).cast("long").alias("n_dup_lines"),
            F.size(covered).cast("long").alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
        )
    )


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", max_host_rate: float = 0.75, min_hosts: int = 2) -> DataFrame:
    """One row per row of docs: its id, the row key k1, k2, the counts, base_failed, host_rate, host_failed and kept.

    A document that fails a base rule is rejected. The failures of each rule are summed by host, and each host gets
    a beta posterior of its rate, from a prior whose mean is the rule's rate over all hosts and whose strength is fitted to the
    spread between hosts (method of moments). A posterior whose mean is SURE deviations above the prior mean makes the
    host over the rule, as many below under it. host_failed: the document fails a firm rule and its host is not under it, or a soft
    rule and its host is over it. A host one of whose posterior means is over max_host_rate is rejected with all its
    documents. Where hosts differ by no more than chance, the prior is so strong that no host is over or under a rule.
    A null host has no verdict, so that only base rules act; with fewer than min_hosts hosts there is no spread to
    fit, rates stay raw, and none is over or under. Repeated rows count each.
    """
    k1, k2 = row_key(F.col(doc_id), F.col(text))
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), k1.alias("k1"), k2.alias("k2"), F.col(text).alias("text"))
    counted = written(with_counts(own).drop("text"), "quality-counts")
    failed = F.expr(BASE_FAILED)
    return (
        counted.join(host_rates(counted, min_hosts), F.col("host") == F.col("h"), "left")
        .withColumns({"base_failed": failed, "host_failed": F.expr(HOST_FAILED)})
        .drop("h", *[f"counts_{name}" for name in FIRM | SOFT])
        .withColumn("kept", ~failed & ~F.col("host_failed") & (F.coalesce("host_rate", F.lit(0.0)) <= max_host_rate))
    )


def host_rates(counted: DataFrame, min_hosts: int = 2) -> DataFrame:
    """h, host_rate: the largest of the posterior means of each host; counts_ and each firm or soft rule: a failure of it
    rejects documents of this host. counted: host and the counts."""
    hosts = written(
        counted.where("host IS NOT NULL").groupBy("host").agg(
            F.count("*").alias("n"), *[F.sum(F.expr(rule).cast("long")).alias(f"f_{name}") for name, rule in RULES.items()]
        ), "host-failures", small=True,
    )
    moments = hosts.agg(
        F.count("*").alias("hosts"), F.avg(F.lit(1) / F.col("n")).alias("inv"),
        *[F.expr(f"try_divide(sum(f_{r}), sum(n)) AS m_{r}") for r in RULES],
        *[F.expr(f"var_pop(f_{r} / n) AS v_{r}") for r in RULES],
    ).first()

    def posterior(rule: str) -> tuple[Column, Column]:
        """The mean, and its distance from the prior mean in deviations of the posterior."""
        m, v = moments[f"m_{rule}"] or 0.0, moments[f"v_{rule}"] or 0.0
        spread = v - m * (1 - m) * (moments["inv"] or 0.0)  # what the binomial noise does not explain
        strength = 0.0 if moments["hosts"] < min_hosts else 1e6 if spread <= 0 else max(0.0, min(1e6, m * (1 - m) / spread - 1))
        mean = (F.col(f"f_{rule}") + m * strength) / (F.col("n") + strength)
        return mean, F.coalesce(F.try_divide(mean - m, F.sqrt(mean * (1 - mean) / (F.col("n") + strength + 1))), F.lit(0.0))

    counts = [(posterior(r)[1] > -SURE if r in FIRM else posterior(r)[1] >= SURE).alias(f"counts_{r}") for r in FIRM | SOFT]
    return hosts.select(F.col("host").alias("h"), F.greatest(*[posterior(r)[0] for r in RULES]).alias("host_rate"), *counts)


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", max_host_rate: float = 0.75, min_hosts: int = 2) -> DataFrame:
    """The rows of docs that judge() keeps, with the columns of docs.

    The rows are written once with their counts, so that the hosts and the verdicts read these instead of texts.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = written(with_counts(docs.select(own, F.col(text).alias("text"), F.col(host).alias("host"))).drop("text"), "quality-rows")
    judged = rows.where(F.expr(f"NOT ({BASE_FAILED})")).join(host_rates(rows, min_hosts), F.col("host") == F.col("h"), "left")
    good = F.expr(f"NOT ({HOST_FAILED})") & (F.coalesce("host_rate", F.lit(0.0)) <= max_host_rate)
    return judged.where(good).select("row.*")


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return judge(docs).select("doc_id", *COUNTS, "base_failed", "kept")


#: The strength of the prior and the shrunk rates as in judge(), for DuckDB.
SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest([w[j:j+2] for j in range(1, len(w) - 1)]) AS gram FROM w
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + o) AS n FROM again, (VALUES (0), (1), (2)) AS o(o) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n_lines,
    count(*) FILTER (WHERE regexp_matches(line, '[^\x20\x09-\x0D]')) - count(DISTINCT line) FILTER (WHERE regexp_matches(line, '[^\x20\x09-\x0D]')) AS dup
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) GROUP BY doc_id
), c AS (
  SELECT w.doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, dup AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, n_lines
  FROM w JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
), f AS (
  SELECT *, (n_words < 50)::BIGINT AS a, (100 * n_repeat_words > 50 * n_words)::BIGINT AS b,
    (10 * n_symbols > word_chars)::BIGINT AS d, (10 * n_dup_lines > 3 * n_lines)::BIGINT AS e FROM c
), h AS (
  SELECT source, count(*) AS n, unnest([sum(a), sum(b), sum(d), sum(e)]) AS f, unnest([1, 2, 3, 4]) AS r FROM f WHERE source IS NOT NULL GROUP BY source
), m AS (
  SELECT r, count(*) AS hosts, sum(f) / sum(n) AS m, var_pop(f / n) - (sum(f) / sum(n)) * (1 - sum(f) / sum(n)) * avg(1 / n) AS spread FROM h GROUP BY r
), s AS (
  SELECT r, m, CASE WHEN hosts < 2 THEN 0 WHEN spread <= 0 THEN 1e6 ELSE greatest(0, least(1e6, m * (1 - m) / spread - 1)) END AS k FROM m
), z AS (
  SELECT source, r, m, n + k + 1 AS size, (f + m * k) / (n + k) AS rate FROM h JOIN s USING (r)
), v AS (
  SELECT source, max(rate) AS rate,
    bool_or(r = 3 AND coalesce((rate - m) / nullif(sqrt(rate * (1 - rate) / size), 0), 0) > -1.6448536269514722) AS counts_d,
    bool_or(r = 4 AND coalesce((rate - m) / nullif(sqrt(rate * (1 - rate) / size), 0), 0) >= 1.6448536269514722) AS counts_e
  FROM z GROUP BY source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (a + b > 0) AS base_failed,
  a + b = 0 AND NOT (d = 1 AND coalesce(counts_d, false)) AND NOT (e = 1 AND coalesce(counts_e, false)) AND coalesce(rate, 0) <= 0.75 AS kept
FROM f LEFT JOIN v USING (source)
"""
