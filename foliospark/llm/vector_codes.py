"""Vector codes: product quantisation in integers, nearest entries found within an annulus of norms.

Tasks assign the parts of their rows in Arrow batches and return sums for each (part, entry), of which Spark adds up at most
parts * entries rows; the codebooks, of that size too, travel back to the tasks with the next job.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import written

SCALE = 256
MOST = 1 << 24  # integer components end here, that is, at 65 536: squared distances of any sum of parts fit 64 bits
AT_ONCE = 1 << 20  # distances that are computed at once


def annulus_nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of the nearest entry to each row of parts, ties to the lower one, and its squared distance (int64).

    An entry's distance is at least the difference of the norms. So entries are sorted by norm; the one whose norm is nearest
    gives a first distance; a binary search finds the interval of norms within it, ends included and
    widened by what rounding may take; only the entries in that annulus are evaluated, in integers.
    """
    n = len(parts)
    norm = np.sqrt((entries.astype(float) ** 2).sum(1))
    order = np.argsort(norm, kind="stable")
    norm, entries = norm[order], entries[order]
    own = np.sqrt((parts.astype(float) ** 2).sum(1))
    right = np.clip(np.searchsorted(norm, own), 1, max(1, len(norm) - 1))
    first = np.where(np.abs(norm[np.minimum(right, len(norm) - 1)] - own) < np.abs(norm[right - 1] - own), np.minimum(right, len(norm) - 1), right - 1)
    reach = np.sqrt(((parts - entries[first]) ** 2).sum(1).astype(float))
    slack = 1e-9 * (own + reach) + 1e-9
    low = np.searchsorted(norm, own - reach - slack, "left")
    high = np.searchsorted(norm, own + reach + slack, "right")
    index, least = np.empty(n, np.int64), np.empty(n, np.int64)
    ends = np.cumsum(high - low)
    start = 0
    while start < n:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + AT_ONCE, "right")))
        count = (high - low)[start:stop]
        at = np.cumsum(count) - count
        row = np.repeat(np.arange(start, stop), count)
        entry = np.arange(len(row)) - np.repeat(at, count) + np.repeat(low[start:stop], count)
        distance = ((parts[row] - entries[entry]) ** 2).sum(1)
        least[start:stop] = np.minimum.reduceat(distance, at)
        tied = np.where(distance == np.repeat(least[start:stop], count), order[entry], len(order))
        index[start:stop] = np.minimum.reduceat(tied, at)
        start = stop
    return index, least


@dataclass
class Codebooks:
    """entries: int64, part by entry by position within the part."""

    entries: np.ndarray

    def assign(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance by row and part."""
        many, _, width = self.entries.shape
        found = [annulus_nearest(rows[:, i * width : (i + 1) * width], self.entries[i]) for i in range(many)]
        return np.stack([x[0] for x in found], 1), np.stack([x[1] for x in found], 1)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def whole(vector: Column) -> Column:
    """Not null, not empty, all components finite."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def quantised(vectors: DataFrame, vector: str, vec_id: str, parts: int = 16) -> tuple[DataFrame, int]:
    """The rows of vectors with whole vectors of the commonest length (of equally common ones the larger), and that length.

    _v holds floor(256 * x) as longs, at most MOST away from 0, followed by zeros up to a multiple of parts.
    """
    good = vectors.where(whole(F.col(vector)))
    size = F.size(vector)
    common = good.groupBy(size.alias("n")).count().orderBy(F.col("count").desc(), F.col("n").desc()).first()
    length = common["n"] if common else 0
    ints = F.transform(vector, lambda x: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(x.cast("double") * SCALE))).cast("long"))
    padded = F.concat(ints, F.array_repeat(F.lit(0).cast("long"), -length % parts))
    return good.where(size == length).withColumn("_v", padded), length


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _sums(rows: DataFrame, books: Codebooks) -> np.ndarray:
    """Sums of the parts of rows (_v) by part and entry, and at the end of each their number."""
    many, size, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((many, size, width + 1), np.int64)
        for batch in batches:
            values = _matrix(batch.column(0), many * width)
            codes, _ = books.assign(values)
            for i in range(many):
                own = np.concatenate([values[:, i * width : (i + 1) * width], np.ones((len(values), 1), np.int64)], 1)
                np.add.at(total[i], codes[:, i], own)
        part, entry = np.nonzero(total[:, :, -1])
        kept = total[part, entry]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), *map(pa.array, kept.T)], names=["part", "entry", *(f"s{i}" for i in range(width + 1))])

    kinds = ", ".join(f"s{i} long" for i in range(width + 1))
    each = rows.select("_v").mapInArrow(run, f"part long, entry long, {kinds}")
    out = np.zeros((many, size, width + 1), np.int64)
    for r in each.groupBy("part", "entry").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(width + 1)]).collect():  # parts * entries rows
        out[r["part"], r["entry"]] = r[2:]
    return out


def train(rows: DataFrame, vec_id: str, length: int, parts: int = 16, entries: int = 64, rounds: int = 2) -> Codebooks:
    """Codebooks of rows of quantised(): each part of those with the entries smallest ids (ties by the vector), then rounds of
    assigning and replacing an entry by the floor of its parts' mean; unused entries stay. Fewer rows give fewer entries."""
    first = [r["_v"] for r in rows.select(vec_id, "_v").orderBy(F.col(vec_id).asc_nulls_last(), "_v").limit(entries).collect()]
    width = -(-length // parts)
    books = Codebooks(np.array(first, np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy())
    for _ in range(rounds):
        got = _sums(rows, books)
        used = got[:, :, -1] > 0
        books = Codebooks(np.where(used[:, :, None], got[:, :, :-1] // np.maximum(got[:, :, -1:], 1), books.entries))
    return books


def encode(rows: DataFrame, books: Codebooks, own: tuple[str, ...]) -> DataFrame:
    """The own columns of rows of quantised(), code (two hex digits a part) and error (the parts' squared distances)."""
    many, _, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, distances = books.assign(_matrix(batch.column(0), many * width))
            text = codes.astype(np.uint8).tobytes().hex()
            step = 2 * many
            hexes = [text[i : i + step] for i in range(0, len(text), step)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(hexes, pa.string()), pa.array(distances.sum(1))], names=[*(f"_c{i}" for i in range(len(own))), "code", "error"])

    kinds = ", ".join(f"_c{i} {rows.schema[c].dataType.simpleString()}" for i, c in enumerate(own))
    found = rows.select("_v", *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(own)]).mapInArrow(run, f"{kinds}, code string, error long")
    return found.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(own)], "code", "error")


def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """One row per row of vectors that quantised() keeps: vec_id, code, error, label_error, codebooks_sha256.

    label_error sums error over equal labels, nulls together; it is added up by partial sums, and the join with the labels'
    totals is broadcast only where these are small. Repeated rows count each. entries is at most 256. Vectors that are null or empty,
    hold null or non-finite components, or have another length than the commonest, are left out; no rows give none.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte a part: at most 256 entries")
    kept, length = quantised(vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("v")), "v", "vec_id", parts)
    rows = written(kept.drop("v"), "quantised")  # each round reads it
    books = train(rows, "vec_id", length, parts, entries, rounds) if length else Codebooks(np.zeros((parts, 0, 0), np.int64))
    coded = written(encode(rows, books, ("vec_id", "label")), "codes")
    totals = coded.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error"))
    met = coded.join(totals, F.col("label").eqNullSafe(F.col("l")))
    return met.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


def _round(n: int) -> str:
    """SQL of one assignment (a) under the entries e and its update (e of the next round)."""
    return f"""a{n} AS (
  SELECT vec_id, p, v, arg_min(j, d * 64 + j) AS j, min(d) AS d
  FROM (SELECT x.vec_id, x.p, x.v, j, list_sum(list_transform(list_zip(x.v, e.v), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::BIGINT AS d FROM x JOIN e{n} e USING (p)) GROUP BY ALL
), e{n + 1} AS (
  SELECT e.p, e.j, coalesce(m.v, e.v) AS v FROM e{n} e LEFT JOIN (
    SELECT p, j, [{", ".join(f"(sum(v[{i}]) // count(*) - (sum(v[{i}]) % count(*) < 0)::INT)::BIGINT" for i in range(1, 5))}] AS v FROM a{n} GROUP BY p, j
  ) m USING (p, j)
)"""


#: Every part against every entry, for vectors of 64 components.
SQL = f"""
WITH k AS (
  SELECT vec_id, label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), x AS (
  SELECT vec_id, unnest(range(16)) AS p, unnest([v[i*4+1:i*4+4] for i in range(16)]) AS v FROM k
), f AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS j FROM (SELECT vec_id FROM k ORDER BY vec_id LIMIT 64)
), e0 AS (
  SELECT p, j, v FROM x JOIN f USING (vec_id)
), {_round(0)}, {_round(1)}, {_round(2)}, c AS (
  SELECT vec_id, label, string_agg(lower(printf('%02x', j)), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 JOIN k USING (vec_id) GROUP BY vec_id, label
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, j)) FROM e2) AS codebooks_sha256
FROM c
"""
