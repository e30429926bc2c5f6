"""Tables by name, and the views of them that searches and dashboards work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, root: str, table: str, *columns: str) -> DataFrame:
    """A Parquet table below root; only the named columns are read when some are."""
    df = spark.read.parquet(f"{root}/{table}.parquet")
    return df.select(*columns) if columns else df


def pages(spark: SparkSession, root: str) -> DataFrame:
    """documents as pages: page_id, folder, engine, text, confidence (0 to 100, from the id) ."""
    return load(spark, root, "documents").select(
        F.col("doc_id").alias("page_id"), F.col("source").alias("folder"), F.col("lang").alias("engine"), "text",
        ((F.col("doc_id") * 37) % 101).cast("double").alias("confidence"),
    )


def proceedings(spark: SparkSession, root: str) -> DataFrame:
    """orders as dated proceedings of folders: id, folder_id, kind, day, officer, verified."""
    return load(spark, root, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("folder_id"), F.col("o_orderpriority").alias("kind"),
        F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("amount"), (F.col("o_orderstatus") == "F").alias("verified"),
    )


def audit(spark: SparkSession, root: str) -> DataFrame:
    """events as an audit log: id, ts, user_id, action, value, props."""
    return load(spark, root, "events").select(F.col("event_id").alias("id"), "ts", "user_id", F.col("event_type").alias("action"), "value", "props")


def lookup(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small catalog given in code. The planner does not see the size of rows that come from Python, so it is told to broadcast them."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log of one JSON object per line; malformed lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def file_listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path, size and time of the files below path, without their content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")


def assemble(pages: DataFrame, doc: str, order: str, text: str, separator: str = "\n\n") -> DataFrame:
    """One row per document: its non-null texts in order, joined."""
    parts = F.sort_array(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(F.col(order).alias("o"), F.col(text).alias("t")))))
    return pages.groupBy(doc).agg(F.array_join(parts["t"], separator).alias("text"))
