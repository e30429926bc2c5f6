"""Similarity search in a catalog by an index of trigrams, and the checks of addresses that suggest from it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.functions.similarity import trigram_similarity, trigrams
from foliospark.operators.automaton import occurrences

QUERIES, VALUES = 8192, 16384  # of a block that meet in one task
STEP, COLUMNS = 512, 1024  # queries and trigrams that are multiplied at once


def gram_index(values: DataFrame, block: list[str], value: str) -> DataFrame:
    """block, value, gram, size: a row for each trigram of each distinct value of a block, and how many the value has.

    Written bucketed by block and gram, it answers searches without a shuffle of the catalog.
    """
    once = values.select(*block, F.col(value).alias("value")).where(F.col("value").isNotNull()).distinct()
    return once.withColumn("g", trigrams("value")).select(*block, "value", F.size("g").alias("size"), F.explode("g").alias("gram"))


def nearest_values(queries: DataFrame, index: DataFrame, block: list[str], query: str, least: float, n: int) -> DataFrame:
    """block, query, value, similarity, rank: of each distinct query of a block the n values of the index most like it, with a similarity over least.

    The similarity is that of the sets of trigrams. What they share is counted by products of incidence matrices, of a slice of the queries and one of the
    values of a block in one task, which keeps the n best of its values for each query: trigrams that all values have cost no more than others, and
    no pair leaves its task unless it is one of these. Ties go by the value.
    """
    asked = queries.select(*block, F.col(query).alias("query")).where("query IS NOT NULL").distinct().withColumn("grams", F.array_join(trigrams("query"), "")).where("grams <> ''")
    known = index.groupBy(*block, "value").agg(F.array_join(F.collect_list("gram"), "").alias("grams"))
    count = lambda df, name, most: df.groupBy(*block).agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    cuts = count(asked, "_q", QUERIES).join(count(known, "_v", VALUES), block) if block else count(asked, "_q", QUERIES).crossJoin(count(known, "_v", VALUES))
    deal = lambda df, c, own, other: (df.join(cuts, block) if block else df.crossJoin(cuts)).select(
        *block, c, "grams", F.pmod(F.xxhash64(c), own).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other)
    )
    kinds = ", ".join(f"{b} {asked.schema[b].dataType.simpleString()}" for b in block)

    def meet(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        words = sorted(zip(right["value"].to_pylist(), right["grams"].to_pylist(), strict=True))
        texts = left["query"].to_pylist()
        at, which, score = _best([w for _, w in words], left["grams"].to_pylist(), least, n)
        own = {b: pa.array([k.as_py()] * len(at), left.schema.field(b).type) for b, k in zip(block, key, strict=False)}
        return pa.table(own | {"query": pa.array([texts[i] for i in at], pa.string()), "value": pa.array([words[i][0] for i in which], pa.string()), "similarity": pa.array(score, pa.float64())})

    keys = [*block, "_q", "_v"]
    met = deal(asked, "query", "_q", "_v").groupBy(*keys).cogroup(deal(known, "value", "_v", "_q").groupBy(*keys)).applyInArrow(meet, f"{kinds + ', ' if block else ''}query string, value string, similarity double")
    rank = F.row_number().over(Window.partitionBy(*block, "query").orderBy(F.col("similarity").desc(), "value"))
    return met.withColumn("rank", rank).where(F.col("rank") <= n).select(*block, "query", "value", "similarity", "rank")


def _best(values: list[str], queries: list[str], least: float, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query the n values with the largest similarity over least, ties to the earlier value: places in queries and values, similarities.

    Both are sets of trigrams, written after each other.
    """
    none = np.zeros(0, np.int64)
    if not values or not queries:
        return none, none, np.zeros(0)
    sizes = np.array([len(g) // 3 for g in [*values, *queries]])
    flat = np.frombuffer("".join([*values, *queries]).encode("utf-32-le"), "<U3")
    _, column = np.unique(flat, return_inverse=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    v = len(values)
    both = np.intersect1d(column[row < v], column[row >= v])
    place = np.full(column.max() + 1, -1)
    place[both] = np.arange(len(both))
    column = place[column]
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    found = []
    for q in range(0, len(queries), STEP):
        asked = sizes[v + q : v + q + STEP]
        shared = np.zeros((len(asked), v), np.float32)
        for c in range(0, len(both), COLUMNS):
            r, k = (x[slice(*np.searchsorted(column, (c, c + COLUMNS)))] for x in (row, column))
            a, b = (r >= v + q) & (r < v + q + STEP), r < v
            x, y = (np.zeros((size, min(COLUMNS, len(both) - c)), np.float32) for size in (len(asked), v))
            x[r[a] - v - q, k[a] - c] = 1
            y[r[b], k[b] - c] = 1
            shared += x @ y.T
        alike = shared / (asked[:, None] + sizes[:v] - shared.astype(np.float64))
        floor = np.partition(alike, v - n, axis=1)[:, v - n] if v > n else np.zeros(len(asked))
        i, j = np.nonzero((alike >= floor[:, None]) & (alike > least))
        s = alike[i, j]
        by = np.lexsort((j, -s, i))
        i, j, s = i[by], j[by], s[by]
        top = np.arange(len(i)) - np.searchsorted(i, i) < n
        found.append((i[top] + q, j[top], s[top]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def autocompleted(typed: DataFrame, catalog: DataFrame, value: str, query: str = "typed", least: float = 0.2, n: int = 10) -> DataFrame:
    """query, value, similarity, rank: for each distinct text that was typed the n values of the catalog with the largest trigram similarity, of those
    with one over least and those that hold it, in any case. Ties go by the value. What holds a text is found by an automaton of all of them."""
    known = catalog.select(F.col(value).alias("value")).where("value <> ''").distinct()
    asked = typed.select(F.col(query).alias("query")).where("query <> ''").distinct()
    near = nearest_values(asked, gram_index(known, [], "value"), [], "query", least, n).select("query", "value", "similarity")
    hits = occurrences(known.select(F.col("value").alias("id"), F.lower("value").alias("text")), asked.select(F.lower("query").alias("term")))
    held = hits.join(asked.withColumn("term", F.lower("query")), "term").select("query", F.col("id").alias("value"), trigram_similarity("query", "id").alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("similarity").desc(), "value"))
    return near.unionByName(held).distinct().withColumn("rank", rank).where(F.col("rank") <= n).select("query", "value", F.round("similarity", 6).alias("similarity"), "rank")


def checked_address(addresses: DataFrame, catalog: DataFrame, n: int = 5, least: float = 0.3) -> DataFrame:
    """addresses (id, postal_code, area, road, number) with known_code, known_pair, suggestions and faults.

    catalog: postal_code, area. Each step is asked only where the one before it holds: is there a code, is it known, is there an area, is it one of
    the code's; then the parts that lack. Where the area is not one of the code's, suggestions has up to n of the code's areas like it.
    Names are compared in lower case and without marks. An id tells rows apart; null parts count as missing.
    """
    known = catalog.select("postal_code", "area").where("postal_code IS NOT NULL").distinct()
    codes = known.select("postal_code").distinct().withColumn("known_code", F.lit(True))
    key = lambda c: F.lower(T.fold(c))
    pairs = known.select("postal_code", key("area").alias("_a")).distinct().withColumn("known_pair", F.lit(True))
    own = addresses.withColumn("_a", key("area")).join(codes, "postal_code", "left").join(pairs, ["postal_code", "_a"], "left")
    odd = own.where("known_code AND known_pair IS NULL AND trim(area) <> ''").select("postal_code", "area")
    near = nearest_values(odd, gram_index(known, ["postal_code"], "area"), ["postal_code"], "area", least, n)
    lists = near.groupBy("postal_code", F.col("query").alias("area")).agg(F.sort_array(F.collect_list(F.struct("rank", "value")))["value"].alias("suggestions"))
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c)) == "")
    code, pair = F.coalesce("known_code", F.lit(False)), F.coalesce("known_pair", F.lit(False))
    faults = F.array(
        F.when(blank("postal_code"), "no code").when(~code, "unknown code"),
        F.when(blank("area"), "no area").when(code & ~pair, "area of another code"),
        F.when(blank("road"), "no road"), F.when(blank("number"), "no number"),
    )
    met = own.join(lists, ["postal_code", "area"], "left")
    return met.select("id", "postal_code", "area", code.alias("known_code"), pair.alias("known_pair"), F.coalesce("suggestions", F.array().cast("array<string>")).alias("suggestions"), F.array_compact(faults).alias("faults"))
