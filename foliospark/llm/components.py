"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import passing, written


@passing("components")
def components(edges: DataFrame) -> DataFrame:
    """node, root for every node that has an edge to another one; nodes share a root when edges join them.

    edges: a, b (long, well spread, such as hashes). Each round gives a node the least id among itself and its
    neighbours and rewrites the edges to these, which at least halves the nodes of any graph on average; the
    rounds' tables in the shared folder hold node labels, never whole components. Minima are taken with
    map-side partial results, and joins meet written tables, so that a hot node is split.
    """
    left = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges", small=True)
    labels = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to")), "labels", small=True)
        if labels is None:
            labels = least.select("node", F.col("to").alias("root"))
        else:
            step = least.select(F.col("node").alias("root"), "to")
            labels = written(labels.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots", small=True)
        a = least.select(F.col("node").alias("a"), F.col("to").alias("x"))
        b = least.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = left.join(a, "a").join(b, "b").where("x <> y")
        left = written(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges", small=True)
    return labels if labels is not None else left.select(F.col("a").alias("node"), F.col("b").alias("root"))
