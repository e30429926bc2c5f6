"""Gaps, alerts, timelines and folder statistics of dated proceedings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def priority(days: Column) -> Column:
    return F.when(days >= 365, "critical").when(days >= 270, "high").when(days >= 180, "medium").otherwise("low")


def gaps(df: DataFrame, least: int = 180, most: int | None = 1825, strict: bool = False, group: str = "folder_id", day: str = "day", order: str = "id") -> DataFrame:
    """group, from_day, to_day, days, priority of neighbouring days that far apart; gaps of 0 and over most are left out."""
    following = F.lead(day).over(Window.partitionBy(group).orderBy(day, order))
    out = df.where(F.col(day).isNotNull()).select(group, F.col(day).alias("from_day"), following.alias("to_day")).withColumn("days", F.datediff("to_day", "from_day"))
    wide = F.col("days") > least if strict else F.col("days") >= least
    out = out.where(wide & (F.col("days") > 0))
    return (out.where(F.col("days") <= most) if most else out).withColumn("priority", priority(F.col("days")))


def idle(df: DataFrame, now: str, least: int = 90, group: str = "folder_id", day: str = "day") -> DataFrame:
    """group, last_day, days since then, priority of groups idle for longer than least days."""
    out = df.groupBy(group).agg(F.max(day).alias("last_day")).withColumn("days", F.datediff(F.lit(now).cast("date"), "last_day"))
    return out.where(F.col("days") > least).withColumn("priority", F.when(F.col("days") > 180, "high").otherwise("medium"))


def folder_statistics(df: DataFrame, group: str = "folder_id", day: str = "day") -> DataFrame:
    """Counts, first and last day, span, mean gap and share verified of each group, in one pass."""
    n = F.count(day)
    return df.groupBy(group).agg(
        F.count("*").alias("n"), F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.datediff(F.max(day), F.min(day)).alias("span_days"),
        F.round(F.try_divide(F.datediff(F.max(day), F.min(day)).cast("double"), (n - 1)), 4).alias("mean_gap"),
        F.count_if("verified").alias("n_verified"), F.round(100.0 * F.count_if("verified") / F.count("*"), 2).alias("verified_pct"),
    )


def enumerated(df: DataFrame, group: str = "folder_id", day: str = "day", order: str = "id") -> DataFrame:
    """place: the rank of each row by day within its group, rows without a day last."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.col(day).asc_nulls_last(), order)))


def offsets(pages: DataFrame, doc: str, order: str, text: str, gap: int = 2) -> DataFrame:
    """Where each page starts and ends in the text of its document joined with gap characters."""
    before = F.sum(F.length(text) + gap).over(Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return pages.withColumn("start", F.coalesce(before, F.lit(0))).withColumn("end", F.col("start") + F.length(text))


def overlapped(pages: DataFrame, doc: str, order: str, text: str, tail: int = 300) -> DataFrame:
    """joined: each text after the last tail characters of the one before it."""
    last = F.lag(F.right(F.col(text), F.lit(tail))).over(Window.partitionBy(doc).orderBy(order))
    return pages.withColumn("joined", F.trim(F.concat(F.coalesce(last, F.lit("")), F.lit(" "), F.col(text))))


def page_of(positions: DataFrame, pages: DataFrame, doc: str, at: str = "position") -> DataFrame:
    """The page that holds each position: the last one that starts at or before it, by one sorted pass per document."""
    events = pages.select(doc, F.col("start").alias("at"), F.lit(0).alias("side"), F.col("page"), F.lit(None).cast(positions.schema[at].dataType).alias(at))
    events = events.unionByName(positions.select(doc, F.col(at).alias("_p")).select(doc, F.col("_p").alias("at"), F.lit(1).alias("side"), F.lit(None).cast(pages.schema["page"].dataType).alias("page"), F.col("_p").alias(at)))
    known = F.last("page", ignorenulls=True).over(Window.partitionBy(doc).orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("page", known).where("side = 1").select(doc, at, "page")


def last_mark(rows: DataFrame, doc: str, order: str, mark: str) -> DataFrame:
    """rows with, in place of mark, the last one that is not null at or before each row of its document (as of it)."""
    upto = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(mark, F.last(mark, ignorenulls=True).over(upto))


def wide_gaps(df: DataFrame, now: str, least: int = 60, group: str = "folder_id", day: str = "day", order: str = "id") -> DataFrame:
    """group, kind, from_day, to_day, days, priority: gaps over least days (medium over twice that, else low), and groups idle since."""
    following = F.lead(day).over(Window.partitionBy(group).orderBy(day, order))
    gap = df.where(F.col(day).isNotNull()).select(group, F.lit("gap").alias("kind"), F.col(day).alias("from_day"), following.alias("to_day"))
    gap = gap.withColumn("days", F.datediff("to_day", "from_day")).where(F.col("days") > least).withColumn("priority", F.when(F.col("days") > 2 * least, "medium").otherwise("low"))
    rest = idle(df, now, group=group, day=day).select(group, F.lit("idle").alias("kind"), F.col("last_day").alias("from_day"), F.lit(now).cast("date").alias("to_day"), "days", "priority")
    return gap.unionByName(rest)
