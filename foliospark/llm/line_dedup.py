"""Line dedup: lines that many documents share go, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import WS, ascii_lower, fresh, row_key, written


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(WS)))


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    r"""Drops every line whose key stands in min_docs documents or more, from all of them.

    Texts split at \n; a null or empty text is one empty line. Each row counts as one document, a repeated
    row as another one. Keys under min_chars code points always stay. Returns the columns of docs with the
    text of the kept lines, and n_lines (before dropping) and n_dropped, which replace columns so named.

    Plan: distinct keys of each row are hashed to 128 bits and counted with map-side partial sums, so a hot
    line is one row per task. The frequent hashes are written; their measured size decides between a
    broadcast and a shuffle join that may split a hot key. Only positions travel back to the documents; a task's
    share of them is hashed, which is a small part of the share of texts that it meets (4 bytes for a dropped line).
    """
    k1, k2, lines, keys, gone = fresh(docs, "_k1", "_k2", "_lines", "_keys", "_gone")
    a, b = row_key(F.col(doc_id), F.col(text))
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(a.alias("k1"), b.alias("k2"), F.transform(F.split(body, "\n", -1), line_key).alias("keys"))
    long_enough = lambda c: F.length(c) >= min_chars
    h1, h2 = row_key(F.col("key"))
    frequent = written(
        keyed.select(F.explode(F.array_distinct(F.filter("keys", long_enough))).alias("key"))
        .select(h1.alias("h1"), h2.alias("h2"))
        .groupBy("h1", "h2").count().where(F.col("count") >= min_docs).select("h1", "h2"),
        "frequent-lines", small=True)
    dropped = (
        keyed.select("k1", "k2", F.posexplode("keys").alias("pos", "key"))
        .where(long_enough(F.col("key")))
        .select("k1", "k2", "pos", h1.alias("h1"), h2.alias("h2"))
        .join(frequent, ["h1", "h2"])
        .groupBy("k1", "k2").agg(F.collect_set("pos").alias("gone"))
        .select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("gone").alias(gone))
    )
    split = F.split(body, "\n", -1)
    stays = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    rest = F.array_join(F.transform(F.array_sort(stays), lambda i: F.get(F.col(lines), i)), "\n")
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return (
        docs.withColumns({k1: a, k2: b})
        .join(dropped.hint("shuffle_hash"), [k1, k2], "left")
        .withColumn(lines, split)
        .select(
            *[F.when(F.col(gone).isNull(), body).otherwise(rest).alias(text) if c == text else F.col(f"`{c}`") for c in own],
            F.size(lines).cast("long").alias("n_lines"),
            F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"),
        )
    )


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(s, 1) AS pos, unnest(s) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), m AS (
  SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
