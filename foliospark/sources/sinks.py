"""Writers: exports, keyed overwrites, appended entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import browser_label


def scrubbed(c: Column | str, placeholder: str = "-") -> Column:
    """One line for a CSV cell: line ends become spaces, a null the placeholder."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.regexp_replace(c.cast("string"), r"[\r\n]+", " "), F.lit(placeholder))


def export_rows(df: DataFrame, agent: str | None = None, most: int | None = None) -> DataFrame:
    """All columns as CSV cells; agent is shortened to browser and system; most rows at most, when given."""
    out = df.select(*[(browser_label(F.col(c)) if c == agent else scrubbed(c)).alias(c) for c in df.columns])
    return out.limit(most) if most is not None else out


def write_csv(df: DataFrame, path: str, **options: str) -> None:
    df.write.options(header="true", quoteAll="true", **options).csv(path)


def exported(df: DataFrame, path: str) -> DataFrame:
    """df written as quoted CSV below path and read again, as text. Cells of several lines stay whole; a null comes back empty."""
    write_csv(df, path, escape='"')
    schema = ", ".join(f"`{c}` string" for c in df.columns)
    return df.sparkSession.read.schema(schema).options(header="true", escape='"', multiLine="true", nullValue="\x00").csv(path)


def appended(df: DataFrame, path: str) -> DataFrame:
    """The rows of path with those of df behind them."""
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.parquet(path)


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those of the same keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def newest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of each key the row of the greatest order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last()))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def as_categories(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A row per key and category with its value as JSON."""
    entries = F.array(*[F.struct(F.lit(c).alias("category"), F.to_json(F.struct(F.col(c).alias("value"))).alias("result")) for c in columns])
    return df.select(key, F.inline(entries))


def replace_groups(df: DataFrame, path: str, group: str) -> None:
    """Overwrites the partitions of the groups that df has, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(group).parquet(path)
