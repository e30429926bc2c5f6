"""Deletes that go down a tree of any depth: for good, or by a mark that readers heed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.session import stored


def below(roots: DataFrame, tree: DataFrame) -> DataFrame:
    """node, depth: the roots (node; depth 0) that are in the tree (node, parent) and all below them, each once, with its least depth.

    Each round joins the nodes found last with their children, and leaves out those known already, so that cycles end. Rounds are as many as the tree is deep, and
    are written: the lineage stays short, and no limit on rows or levels cuts a deep or wide tree, as it would a recursive query.
    """
    links = tree.select(F.col("node").alias("child"), F.col("parent").alias("node")).where("node IS NOT NULL AND child IS NOT NULL").distinct()
    last = stored(roots.select("node").distinct().join(tree.select("node").distinct(), "node", "left_semi"), "level")
    found, depth = last.withColumn("depth", F.lit(0)), 0
    while not last.isEmpty():
        depth += 1
        last = stored(links.join(last, "node").select(F.col("child").alias("node")).distinct().join(found.select("node"), "node", "left_anti"), "level")
        found = found.unionByName(last.withColumn("depth", F.lit(depth)))
    return found


def deleted(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """df without the rows whose key is a node that goes. Rows with a null key stay."""
    return df.join(gone.select(F.col("node").alias(key)), key, "left_anti").select(*df.columns)


def marked(df: DataFrame, gone: DataFrame, key: str, at: Column) -> DataFrame:
    """df with deleted_at: when the row went, of those that were marked before as it was; null for rows that stay."""
    mark = gone.select(F.col("node").alias(key), at.alias("_at"))
    before = F.col("deleted_at") if "deleted_at" in df.columns else F.lit(None).cast("timestamp")
    return df.join(mark, key, "left").withColumn("deleted_at", F.coalesce(before, "_at")).drop("_at").select(*[c for c in df.columns if c != "deleted_at"], "deleted_at")


def restored(df: DataFrame, back: DataFrame, key: str) -> DataFrame:
    """df without the mark on rows whose key is among the nodes that come back."""
    mark = back.select(F.col("node").alias(key), F.lit(True).alias("_back"))
    return df.join(mark, key, "left").withColumn("deleted_at", F.when(F.col("_back").isNull(), F.col("deleted_at"))).drop("_back").select(*df.columns)


def visible(df: DataFrame) -> DataFrame:
    return df.where(F.col("deleted_at").isNull())
