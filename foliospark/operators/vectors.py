"""Vector search over stored embeddings, and a pluggable embedder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.functions.similarity import cosine


def cleaned(c: Column | str, most: int = 1000) -> Column:
    """Without punctuation, squeezed, cut to most characters."""
    c = T.squeeze(F.regexp_replace(T.col(c), r"[^\p{L}\p{N}\s]", " "))
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def similar(vectors: DataFrame, query: list[float], least: float = 0.3, n: int | None = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key and similarity of vectors at least that similar, the best n. The query is a literal, no join."""
    q = F.array(*[F.lit(float(x)) for x in query])
    out = vectors.select(key, F.round(cosine(vector, q), 6).alias("similarity")).where(F.col("similarity") >= least)
    return out.orderBy(F.col("similarity").desc(), F.col(key)).limit(n) if n else out


def concepts(vectors: DataFrame, queries: dict[str, list[float]], least: float = 0.2, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, concepts (sorted, joined), n_concepts and the best similarity over several query vectors."""
    each = F.array(*[F.struct(F.lit(c).alias("concept"), F.round(cosine(vector, F.array(*[F.lit(float(x)) for x in q])), 6).alias("s")) for c, q in queries.items()])
    found = vectors.select(key, F.filter(each, lambda x: x["s"] >= least).alias("f")).where(F.size("f") > 0)
    return found.select(key, F.array_join(F.array_sort(F.transform("f", lambda x: x["concept"])), ",").alias("concepts"), F.size("f").alias("n_concepts"), F.array_max(F.transform("f", lambda x: x["s"])).alias("best"))


def query_snippet(text: str, words: list[str], around: int = 100) -> Column:
    """around the earliest of the words; the head of the text without any."""
    low = F.lower(text)
    at = F.array_min(F.filter(F.array(*[F.locate(w.lower(), low) for w in words]), lambda p: p > 0))
    return F.when(at.isNull(), F.substring(text, 1, 2 * around)).otherwise(F.substring(F.col(text), F.greatest(at - around, F.lit(1)), F.lit(2 * around)))


def hashing_embedder(size: int = 64) -> Callable[[list[str]], np.ndarray]:
    """Unit vectors of hashed words: deterministic, without a model."""
    def embed(texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), size))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % size] += 1 if h & 0x80000000 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return embed


def embedded(pages: DataFrame, embed: Callable[[list[str]], np.ndarray], key: str = "page_id", text: str = "text", least: int = 10) -> DataFrame:
    """key and embedding of texts of least characters or more; embed is called on Arrow batches."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "embedding": list(embed(batch[text].tolist()))})

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, cleaned(text).alias(text)).where(F.length(text) >= least).mapInPandas(run, f"{key} {kind}, embedding array<double>")


def missing_embeddings(pages: DataFrame, known: DataFrame, key: str = "page_id") -> DataFrame:
    return pages.join(known.select(key), key, "left_anti")


def with_fallback(near: DataFrame, pages: DataFrame, word: str, similarity: float = 0.8, key: str = "page_id") -> DataFrame:
    """key, mode, similarity: near ones, and of the other pages those with the word."""
    rest = pages.where(T.contains_ci("text", word)).join(near.select(key), key, "left_anti")
    return near.select(key, F.lit("vector").alias("mode"), "similarity").unionByName(rest.select(key, F.lit("substring").alias("mode"), F.lit(similarity).alias("similarity")))
