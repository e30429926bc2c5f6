"""Bounded samples of labelled rows, the same at each run."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import written

MOST_CLASSES = 256
MOST_BYTES = 128 << 20


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def class_counts(labelled: DataFrame, label: str, most_classes: int = MOST_CLASSES) -> dict:
    """Rows of each class, of the most_classes largest ones (ties: the first); a null label is no class."""
    found = labelled.where(F.col(label).isNotNull()).groupBy(label).count().orderBy(F.col("count").desc(), label).limit(most_classes)
    return {r[label]: r["count"] for r in found.collect()}


def per_class(labelled: DataFrame, label: str, key: str, most: int, counts: dict, seed: int = 0) -> DataFrame:
    """About most of the distinct rows of each class of counts, by a hash of the key: all of them where a class has no more.

    A class of n rows gives those whose hash is below most / n of its range, so no class is gathered and only the
    sample is made distinct. What comes back is at most twice most rows of each, and has the hash as _u.
    """
    u = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, min(1.0, most / n))])
    taken = labelled.where(F.col(label).isin(*counts)).where(u < share[F.col(label)] * (1 << 30))
    return taken.distinct().withColumn("_u", u).orderBy("_u", key, label).limit(2 * most * len(counts))


def sampled(
    docs: DataFrame, labels: DataFrame, label: str, most: int, key: str = "doc_id", text: str = "text",
    most_classes: int = MOST_CLASSES, most_bytes: int = MOST_BYTES, most_rows: int | None = None,
) -> tuple[pd.DataFrame, dict]:
    """Key as a string, label and whole text of a bounded sample, and the number of labelled rows of each class.

    labels: key and label. Rows of labels that repeat count each, and give one example. A key with two labels gives an example of each; of rows of docs
    that share a key one text stands for all (the least by hash, then by itself), so a key that repeats adds no rows.
    Null keys and null texts are left out. The driver gets at most 2 * most rows of each of most_classes classes and
    most_bytes of text: a text of over an eighth of that is left out, and where the rest is more, the rows of
    the smallest hashes stay. most_rows bounds most times the number of classes. No rows give an empty frame and no classes.
    """
    pairs = labels.select(key, label).where(F.col(key).isNotNull() & F.col(label).isNotNull())
    counts = class_counts(pairs, label, most_classes)
    if not counts:
        return pd.DataFrame({key: [], label: [], text: []}), {}
    most = max(1, min(most, most_rows // len(counts))) if most_rows else most
    few = per_class(pairs, label, key, most, counts)
    met = docs.select(F.col(key), F.col(text).alias("_t")).where(F.col("_t").isNotNull()).join(F.broadcast(few), key)
    size = F.octet_length("_t")
    one = met.where(size <= most_bytes // 8).groupBy(key, label, "_u").agg(F.min(F.struct(F.xxhash64("_t").alias("h"), F.col("_t").alias("t")))["t"].alias("_t"))
    taken = written(one, "examples", small=True)
    sizes = taken.select("_u", size.alias("n")).toPandas().sort_values("_u", kind="stable")
    over = sizes._u[sizes.n.cumsum() > most_bytes]
    taken = taken.where(F.col("_u") < int(over.iloc[0])) if len(over) else taken
    rows = taken.select(F.col(key).cast("string").alias(key), label, F.col("_t").alias(text)).toPandas()
    return rows.sort_values([key, label], kind="stable").reset_index(drop=True), counts
