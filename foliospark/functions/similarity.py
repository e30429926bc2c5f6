"""Similarities of strings and vectors. Only Ratcliff-Obershelp and Jaro-Winkler need Python, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from foliospark.functions.text import col


@pandas_udf(DoubleType())
def ratio(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratcliff-Obershelp ratio of two strings; null with a null."""
    from difflib import SequenceMatcher
    from functools import lru_cache

    @lru_cache(100_000)
    def one(a: str, b: str) -> float:
        return SequenceMatcher(None, a, b).ratio()

    for a, b in parts:
        yield pd.Series([None if x is None or y is None else one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def jaro_winkler_of(a: str, b: str, scale: float = 0.1) -> float:
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    taken, pairs = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                pairs.append(c)
                break
    if not pairs:
        return 0.0
    m = len(pairs)
    swapped = sum(x != y for x, y in zip(pairs, (b[j] for j in range(len(b)) if taken[j]), strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    same = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + same * scale * (1 - jaro) if jaro > 0.7 else jaro


@pandas_udf(DoubleType())
def jaro_winkler(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in parts:
        yield pd.Series([None if x is None or y is None else jaro_winkler_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def trigrams(c: Column | str) -> Column:
    """The set of trigrams of the words, each padded with two blanks before and one after."""
    words = F.filter(F.split(F.lower(col(c)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def trigram_similarity(a: Column | str, b: Column | str) -> Column:
    x, y = trigrams(a), trigrams(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 where a vector is zero or the dimensions differ; null with a null."""
    size = F.size(col(a)) == F.size(col(b))
    return F.when(~size, 0.0).otherwise(F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.when(col(a).isNotNull() & col(b).isNotNull(), 0.0)))
