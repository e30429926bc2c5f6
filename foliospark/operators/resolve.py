"""Duplicates and entities: exact and folded keys, record clusters, golden records. likeness has what is like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import text as T


def first_by_key(df: DataFrame, key: Column, *order: Column, group: tuple[str, ...] = ()) -> DataFrame:
    """The first row of each key (within group)."""
    rank = F.row_number().over(Window.partitionBy(*group, key).orderBy(*order))
    return df.withColumn("_k", rank).where("_k = 1").drop("_k")


def keys(column: str) -> dict[str, Column]:
    """Keys by how much they forgive."""
    c = F.col(column)
    return {"exact": c, "case": F.lower(F.trim(c)), "space": F.lower(T.squeeze(c)), "folded": T.name_key(c)}


def repeated(df: DataFrame, by: list[str], least: int = 2) -> DataFrame:
    return df.groupBy(*by).count().where(F.col("count") >= least)


def seeds(pairs: DataFrame) -> DataFrame:
    """member, seed: each row of a pair under the smallest row that it is directly like."""
    return pairs.groupBy(F.col("b").alias("member")).agg(F.min("a").alias("seed"))


def possible_duplicates(df: DataFrame) -> DataFrame:
    """id, other: rows of a folder with the same kind and day, or the same place in the order. Two joins by equality, without the pairs that both find."""
    def met(*by: str) -> DataFrame:
        a, b = df.select("folder_id", *by, "id"), df.select("folder_id", *by, F.col("id").alias("other"))
        return a.join(b, ["folder_id", *by]).where("id < other").select("id", "other")

    return met("kind", "day").unionByName(met("place")).distinct()


def merged(df: DataFrame, key: str, into: DataFrame, columns: list[str]) -> DataFrame:
    """Golden records: into has key and keep; rows that give way go, and what the kept row lacks comes from them."""
    lost = df.join(into, key).groupBy("keep").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(key))).alias(f"_{c}") for c in columns]).withColumnRenamed("keep", key)
    kept = df.join(into.select(key), key, "left_anti").join(lost, key, "left")
    return kept.select(*[F.coalesce(c, f"_{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


def edited(df: DataFrame, edits: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """df with the non-null values of edits."""
    new = edits.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return df.join(new, key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in df.columns])


def deleted(df: DataFrame, gone: DataFrame, *on: str) -> DataFrame:
    return df.join(gone.select(*on), list(on), "left_anti")
