"""Exact dedup over a log-structured merge index of digests in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import ascii_lower, drop_table, passing, row_key, shared_dir, slots_of, written

MEMTABLE_ROWS = 200_000


def _merged(parts: list[pa.Table], largest: bool) -> pa.Table:
    best = "max" if largest else "min"
    table = pa.concat_tables(parts).group_by("digest").aggregate([("id", best), ("n", "sum")])
    return table.rename_columns(["digest", "id", "n"])


def _memtable(largest: bool, rows: int):
    """Batches of digest, id to sorted runs of digest, id, n: a flush for each `rows` distinct digests."""

    def flush(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            held.append(pa.table({"digest": batch.column(0), "id": batch.column(1), "n": pa.repeat(pa.scalar(1, pa.int64()), batch.num_rows)}))
            if sum(t.num_rows for t in held) >= rows:
                held = [_merged(held, largest)]
                if held[0].num_rows >= rows // 2:
                    yield from held.pop().sort_by("digest").to_batches()
        if held:
            yield from _merged(held, largest).sort_by("digest").to_batches()

    return flush


class DigestIndex:
    """Runs of (digest, id, n) by level, sorted by digest and with Parquet's Bloom filters, below one folder.

    insert() lets each task fill a memtable and flush it as sorted pieces of one run of level 0. A level of FANOUT runs
    is merged into one run of the next level; compact() merges all of them. A merge deals the runs by equal ranges of
    digests, and keeps, of each digest, the smallest id (or the largest) and the sum of n; an id of null counts as
    none. Files are only written anew, so a lost executor's work is done again; runs that were merged are deleted.
    """

    FANOUT = 4

    def __init__(self, spark: SparkSession, keep: str = "smallest", path: str | None = None, memtable_rows: int = MEMTABLE_ROWS):
        if keep not in ("smallest", "largest"):
            raise ValueError("keep is smallest or largest")
        self.spark, self.largest, self.rows = spark, keep == "largest", memtable_rows
        self.path = path or f"{shared_dir(spark)}/foliospark/digests-{uuid.uuid4().hex}"
        self.levels: list[list[str]] = [[]]
        self.made = 0

    @property
    def runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def _write(self, df: DataFrame, level: int) -> None:
        run = f"{self.path}/level{level}-{self.made}"
        self.made += 1
        bloom = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": str(self.rows)}
        df.write.options(**bloom).parquet(run)
        drop_table(self.spark, run, at_exit=True)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)

    def insert(self, fingerprints: DataFrame) -> None:
        """fingerprints: digest binary, id."""
        rows = fingerprints.select("digest", "id")
        kind = rows.schema["id"].dataType.simpleString()
        self._write(rows.mapInArrow(_memtable(self.largest, self.rows), f"digest binary, id {kind}, n long"), 0)
        level = 0
        while len(self.levels[level]) >= self.FANOUT:
            self._merge(self.levels[level], level + 1)
            level += 1

    def _merge(self, runs: list[str], level: int) -> None:
        best = F.max if self.largest else F.min
        span = F.conv(F.hex(F.substring("digest", 1, 2)), 16, 10).cast("int")  # digests are spread evenly
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = self.spark.read.parquet(*runs).withColumn("span", F.floor(span * parts / F.lit(1 << 16)).cast("int"))
        merged = dealt.repartition(parts, "span").groupBy("span", "digest").agg(best("id").alias("id"), F.sum("n").alias("n"))
        old = list(runs)
        self._write(merged.sortWithinPartitions("span", "digest").drop("span"), level)
        for names in self.levels:
            names[:] = [x for x in names if x not in old]
        for run in old:
            drop_table(self.spark, run)

    def compact(self) -> DataFrame:
        """The index as one run: a row for each digest."""
        self._merge(self.runs, len(self.levels))
        return self.table()

    def table(self) -> DataFrame:
        return self.spark.read.parquet(*self.runs)

    def probe(self, digests: list[bytes]) -> DataFrame:
        """Entries of a few digests; the filters spare the files that have none of them."""
        return self.table().where(F.col("digest").isin([bytearray(d) for d in digests]))


def slot(digest: Column, bits: int) -> Column:
    """The leading bits of a digest as a number; a shorter digest is padded with zeros."""
    return F.shiftright(F.conv(F.rpad(F.hex(F.substring(digest, 1, 4)), 8, "0"), 16, 10).cast("long"), 32 - bits)


def sha_digest(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


@passing("exact")
def exact_duplicates(docs: DataFrame, keep: str = "smallest", text: str = "text", doc_id: str = "doc_id", digest=sha_digest) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are so after lower-casing A-Z; null counts as empty. Of equal texts the row
    with the smallest (or largest) id stays. Rows that repeat both text and id share their verdict and count
    each in group_size; a null id stays only where all ids of its group are null.

    Digests, ids and counts go through the index. Digests of more than one row are verified: the texts behind
    them are compared byte by byte (least and greatest text of a digest, with map-side partial results, so that a hot
    group sends one pair per task). Which texts may be behind them a broadcast table of digest slots tells
    (slots_of()): other texts stay where they are. Should different texts share a
    digest, these are grouped by the text itself.
    """
    spark = docs.sparkSession
    body = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    a, b = row_key(F.col(doc_id), F.col(text))
    prints = written(
        docs.select(F.col(doc_id).alias("id"), a.alias("k1"), b.alias("k2"), body.alias("body"))
        .select("id", "k1", "k2", digest(F.col("body")).alias("digest"), F.sha2("body", 256).alias("text_sha256")),
        "fingerprints",
    )
    index = DigestIndex(spark, keep)
    index.insert(prints)
    hits = written(index.compact().where("n > 1").select("digest", F.col("id").alias("keep"), "n"), "hits", small=True)
    for run in index.runs:
        drop_table(spark, run)
    slots, own = slots_of(hits, lambda bits: slot(F.col("digest"), bits))
    texts = docs.select(body.alias("body")).withColumn("digest", digest(F.col("body")))
    maybe = texts.withColumn("_slot", own).join(slots, "_slot", "left_semi")
    false_hits = written(maybe.groupBy("digest").agg(F.min("body").alias("lo"), F.max("body").alias("hi")).where("lo <> hi").select("digest"), "false-hits", small=True)
    best = F.max if keep == "largest" else F.min
    by_digest = prints.select("id", "digest", "text_sha256")
    parts = [by_digest.join(hits, "digest", "left").select("id", "keep", "n", "text_sha256")]
    if not false_hits.isEmpty():
        parts = [by_digest.join(false_hits, "digest", "left_anti").join(hits, "digest", "left").select("id", "keep", "n", "text_sha256")]
        mixed = prints.join(false_hits, "digest", "left_semi").select("k1", "k2", "id", "text_sha256")
        exact = docs.select(a.alias("k1"), b.alias("k2"), body_of(text).alias("body")).distinct().join(mixed, ["k1", "k2"])
        groups = exact.groupBy("body").agg(best("id").alias("keep"), F.count("*").alias("n"))
        parts.append(exact.join(groups, "body").select("id", "keep", "n", "text_sha256"))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    keep_id = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep"))
    return out.select(
        F.col("id").alias(doc_id), keep_id.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep_id).alias("kept"), "text_sha256",
    )


def body_of(text: str) -> Column:
    return ascii_lower(F.coalesce(F.col(text), F.lit("")))


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_duplicates(docs, keep="largest")


SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)
"""
