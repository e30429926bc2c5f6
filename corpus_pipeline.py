"""The corpus pipeline: quality rules, line dedup, near duplicates, mixing, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes what each returns
to the shared folder and reads it again. The last stage returns the columns of documents but text, and the pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import line_dedup, mixing, ngram_join, quality_rules, sentencepiece_sampling
from foliospark.llm.common import fresh, row_key, slots_of, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Shares of the tokens for what the stages before leave, nearly all of it good: toxic texts are halved, poor ones get nothing more.
TARGETS = {"q1t0": 0.95, "q1t1": 0.05}
PULL = 0.01  # few documents of a domain cannot be made to stand for many


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: null, empty and short texts too. Repeated rows share their verdict; columns stay."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten documents or more go; n_chars follows the text. Null texts become empty, rows that repeat count each."""
    cleaned = line_dedup.dedup_lines(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that 5-gram similarities of 0.8 or more join, that with the smallest doc_id stays, once.

    Null ids come last, equal ones go by their row key. A repeated row is one of the group; texts without words all stay.
    """
    k1, k2, slot, gone, again = fresh(docs, "_k1", "_k2", "_slot", "_gone", "_again")
    found = ngram_join.near_duplicates(docs).where("component IS NOT NULL").select("component", "doc_id", "k1", "k2")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k1", "k2")
    best = found.groupBy("component").agg(F.count("*").alias("n"), F.min(rank).alias("best")).where("n > 1").select("component", "best")
    stays = (F.col("k1") == F.col("best.k1")) & (F.col("k2") == F.col("best.k2"))
    rows = found.groupBy("component", "k1", "k2").count().join(best, "component").select("k1", "k2", (~stays).alias("gone"), (F.col("count") > 1).alias("again"))
    touched = written(rows.where("gone OR again").select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("gone").alias(gone), F.col("again").alias(again)), "touched", small=True)
    slots, own = slots_of(touched, lambda bits: F.shiftrightunsigned(F.col(k1), 64 - bits))
    keyed = docs.withColumns(dict(zip((k1, k2), row_key(F.col("doc_id"), F.col("text")), strict=True))).withColumn(slot, own)
    filled = slots.withColumnRenamed("_slot", slot)
    met = keyed.join(filled, slot, "left_semi").join(touched, [k1, k2], "left").where(f"NOT coalesce({gone}, false)")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    once = met.where(again).groupBy(k1, k2).agg(F.first(whole).alias("row")).select("row.*")
    others = keyed.join(filled, slot, "left_anti").select(*[f"`{c}`" for c in docs.columns])
    return others.unionByName(met.where(f"{again} IS NULL").select(*[f"`{c}`" for c in docs.columns])).unionByName(once)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says, at most MOST_RATE times, so that expected domain tokens meet the targets. Without labels all stay once."""
    labels = mixing.label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixing.mix(docs, mixing.train_domains(docs, labels), TARGETS, pull=PULL)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled SentencePiece ids instead of the text; null pieces for a null text, none for an empty one."""
    return sentencepiece_sampling.encode_sampled(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near duplicates", near_duplicates), ("mixing", mixture), ("sentencepiece", pieces)]
#: The Jaccard join's components, the fitted rates and the sampled pieces have no SQL; tests/llm has brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
