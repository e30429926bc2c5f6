"""Approximate nearest neighbours: a robust-pruned directed graph for each shard, searched with beams.

Inner products become distances by one more component: scaled to a largest norm of 1, x gets sqrt(1 - |x|²) and a query 0, so
that the nearest is the one with the largest product. That component must not be what tells vectors apart, so a shard
holds vectors of about one norm. Its rows are in the order of their hashes; they enter the graph in batches of at
most its own size: beam searches propose neighbours, relaxed pruning keeps those that no kept one stands for, and the
edges are added in reverse where they fit or survive the same pruning.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.common import row_key, written
from foliospark.llm.vector_codes import whole

BANDS = 4  # of norms, for each doubling
ENTRIES = 64  # nodes that each search starts from: all of a shard that has no more
BATCH, AT_ONCE = 512, 4  # searches in lockstep; nodes that each expands in a step


@dataclass(frozen=True)
class Shape:
    """degree: most edges of a node. beam: candidates that a search keeps. relax: how much farther than a node's own distance
    the way over a kept neighbour may be for the neighbour to stand for it. shard: nodes of a shard, about."""

    degree: int = 32
    beam: int = 96
    relax: float = 1.2
    shard: int = 8192


def lifted(vectors: np.ndarray) -> np.ndarray:
    """float32 vectors of norm 1: scaled by the largest norm, with one more component."""
    x = vectors / np.abs(vectors).max()  # squares of very large components are finite
    norm = np.sqrt((x * x).sum(1))
    x = x / norm.max()
    rest = np.sqrt(np.maximum(0.0, 1.0 - (norm / norm.max()) ** 2))
    return np.concatenate([x, rest[:, None]], 1).astype(np.float32)


def asked(queries: np.ndarray) -> np.ndarray:
    x = queries / np.abs(queries).max(1, keepdims=True)
    x = x / np.sqrt((x * x).sum(1, keepdims=True))
    return np.concatenate([x, np.zeros((len(x), 1))], 1).astype(np.float32)


def beam_search(x: np.ndarray, edges: np.ndarray, n: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Node and distance (1 - product) of the beam nodes nearest to each query that a search over the first n nodes meets, nearest
    first; node -1 and an infinite distance where there are fewer."""
    found, far = np.full((len(queries), beam), -1, np.int32), np.full((len(queries), beam), np.inf, np.float32)
    for at in range(0, len(queries), BATCH):
        q = queries[at : at + BATCH]
        rows = np.arange(len(q))
        start = np.arange(min(n, ENTRIES, beam), dtype=np.int32)
        seen = np.zeros((len(q), n + 1), bool)  # the last column stands for no node
        seen[:, start] = seen[:, n] = True
        first = 1 - q @ x[start].T
        order = np.argsort(first, 1, kind="stable")
        nodes = np.full((len(q), beam), n, np.int32)
        distance = np.full((len(q), beam), np.inf, np.float32)
        nodes[:, : len(start)], distance[:, : len(start)] = start[order], np.take_along_axis(first, order, 1)
        done = nodes == n
        while len(rows):
            pick = np.argsort(done, 1, kind="stable")[:, :AT_ONCE]
            from_ = np.where(np.take_along_axis(done, pick, 1), n, np.take_along_axis(nodes, pick, 1))
            np.put_along_axis(done, pick, True, 1)
            near = np.where((from_ < n)[:, :, None], edges[np.minimum(from_, n - 1)], -1).reshape(len(rows), -1)
            near = np.sort(np.where(near < 0, n, near), 1)
            here = np.arange(len(rows))[:, None]
            near[:, 1:][near[:, 1:] == near[:, :-1]] = n
            near[seen[here, near]] = n
            seen[here, near] = True
            new = 1 - np.matmul(x[np.minimum(near, n - 1)], q[:, :, None])[:, :, 0]
            new[near == n] = np.inf
            both, spans = np.concatenate([nodes, near], 1), np.concatenate([distance, new], 1)
            ready = np.concatenate([done, near == n], 1)
            order = np.argsort(spans, 1, kind="stable")[:, :beam]
            nodes, distance, done = (np.take_along_axis(v, order, 1) for v in (both, spans, ready))
            ended = done.all(1)
            if ended.any():
                out = rows[ended] + at
                found[out], far[out] = np.where(np.isfinite(distance[ended]), nodes[ended], -1), distance[ended]
                rows, q, seen, nodes, distance, done = (v[~ended] for v in (rows, q, seen, nodes, distance, done))
    return found, far


def pruned(x: np.ndarray, own: np.ndarray, near: np.ndarray, shape: Shape) -> np.ndarray:
    """Edges of the nodes own out of the candidates near (by row; -1 for none): the nearest stays, and those go to which it is
    closer than their own distance over relax; again with the nearest of the rest, until degree are kept."""
    out = np.full((len(own), shape.degree), -1, np.int32)
    step = max(1, (1 << 23) // (near.shape[1] ** 2 + 1))
    for at in range(0, len(own), step):
        me, c = own[at : at + step], near[at : at + step]
        c = np.sort(np.where(c == me[:, None], -1, c), 1)
        c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
        apart = 1 - np.matmul(x[c], x[me][:, :, None])[:, :, 0]  # half the squared distance
        apart[c < 0] = np.inf
        order = np.argsort(apart, 1, kind="stable")
        c, apart = np.take_along_axis(c, order, 1), np.take_along_axis(apart, order, 1)
        between = 1 - np.matmul(x[c], x[c].transpose(0, 2, 1))
        alive, rows = c >= 0, np.arange(len(me))
        for i in range(shape.degree):
            if not alive.any():
                break
            best = alive.argmax(1)
            some = alive[rows, best]
            out[at + rows[some], i] = c[rows, best][some]
            alive &= shape.relax**2 * between[rows, best] > apart
            alive[rows, best] = False
    return out


def _reversed(x: np.ndarray, edges: np.ndarray, new: np.ndarray, shape: Shape) -> None:
    """Adds to edges those from the neighbours of the nodes new back to these."""
    to, at = edges[new].ravel(), np.repeat(new, edges.shape[1])
    to, at = to[to >= 0], at[to >= 0]
    order = np.argsort(to, kind="stable")
    to, at = to[order], at[order]
    nodes, begin, count = np.unique(to, return_index=True, return_counts=True)
    by_count = np.argsort(count, kind="stable")
    for i in range(0, len(nodes), 1024):  # neighbours with about as many new edges
        part = by_count[i : i + 1024]
        wide = np.full((len(part), int(count[part].max())), -1, np.int32)
        row = np.repeat(np.arange(len(part)), count[part])
        place = np.arange(len(row)) - np.repeat(np.cumsum(count[part]) - count[part], count[part])
        wide[row, place] = at[np.repeat(begin[part], count[part]) + place]
        all_ = np.concatenate([edges[nodes[part]], wide], 1)
        fits = (all_ >= 0).sum(1) <= shape.degree
        edges[nodes[part][fits]] = -np.sort(-all_[fits], 1)[:, : shape.degree]
        if not fits.all():
            edges[nodes[part][~fits]] = pruned(x, nodes[part][~fits], all_[~fits], shape)


def grown(x: np.ndarray, shape: Shape) -> np.ndarray:
    """The edges of lifted vectors: int32, node by degree, -1 for none."""
    n, edges, many = len(x), np.full((len(x), shape.degree), -1, np.int32), min(len(x), ENTRIES)
    edges[:many] = pruned(x, np.arange(many), np.tile(np.arange(many, dtype=np.int32), (many, 1)), shape)
    while many < n:
        new = np.arange(many, min(n, 2 * many, many + 2 * BATCH))
        near, _ = beam_search(x, edges, many, x[new], shape.beam)
        edges[new] = pruned(x, new, near, shape)
        _reversed(x, edges, new, shape)
        many += len(new)
    return edges


def _matrix(lists: pa.ChunkedArray | pa.Array) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, added from the first component to the last."""
    total = np.zeros(np.broadcast_shapes(left.shape[:-1], right.shape[:-1]))
    for i in range(left.shape[-1]):
        total += left[..., i] * right[..., i]
    return total


def usable(v: Column) -> Column:
    return whole(v) & F.exists(v, lambda x: x != 0)


def nodes_of(vectors: DataFrame, most: int) -> DataFrame:
    """h1, h2 (128 bits of the vector), v, ids: each distinct vector (vec_id, h1, h2, v) once, with its most smallest ids.

    Copies are combined before the shuffle, and ids beyond the smallest are dropped there too: what is nearest never needs more.
    """
    once = vectors.groupBy("h1", "h2").agg(F.first("v").alias("v"))
    rank = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    few = vectors.select("h1", "h2", "vec_id").distinct().withColumn("r", rank).where(F.col("r") <= most)
    return once.join(few.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), ["h1", "h2"])


def _listed(parts: list[tuple[int, int, int]]) -> Column:
    each = [F.struct(F.lit(d).alias("dim"), F.lit(b).alias("band"), F.lit(n).alias("n")) for d, b, n in parts]
    return F.array(*each).cast("array<struct<dim:int,band:int,n:int>>")


def build_index(vectors: DataFrame, most: int, shape: Shape = Shape()) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """The index as a table: dim, band, shard, node, h1, h2, v, ids, edges; and (dim, band, number of shards) of its parts.

    All distinct vectors are in it; those of a length (dim) and a band of norms are dealt to shards by their hashes, so that these
    have about shape.shard nodes whatever copies there are. edges are numbers of nodes of the same shard. The driver
    gets a row for each length and band: BANDS for each doubling of the norm that occurs, far from 0.5 for norms of 1.
    """
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / F.col("top")) ** 2))
    norm = F.log2(F.array_max(F.transform("v", F.abs))) + F.log2(size)
    made = nodes_of(vectors, most).withColumn("top", F.array_max(F.transform("v", F.abs)))
    nodes = written(made.withColumns({"dim": F.size("v"), "band": F.floor(norm * BANDS + 0.5).cast("int")}).drop("top"), "nodes")
    parts = [(r["dim"], r["band"], -(-r["count"] // shape.shard)) for r in nodes.groupBy("dim", "band").count().orderBy("dim", "band").collect()]
    shards = sum(n for _, _, n in parts)

    def build(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("h1", "ascending"), ("h2", "ascending")])
        edges = grown(lifted(_matrix(table["v"])), shape)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(edges) + 1) * edges.shape[1], pa.int32()), pa.array(edges.ravel()))
        return table.append_column("node", pa.array(np.arange(len(edges)), pa.int32())).append_column("edges", lists)

    keys = ("dim", "band", "shard")
    n = F.filter(_listed(parts), lambda p: (p["dim"] == F.col("dim")) & (p["band"] == F.col("band")))[0]["n"]
    dealt = nodes.withColumn("shard", F.pmod("h2", n).cast("int")).repartition(max(1, min(4 * shards, 1 << 16)), *keys)
    kinds = "h1 long, h2 long, v array<double>, ids array<long>, dim int, band int, shard int, node int, edges array<int>"
    return written(dealt.select("h1", "h2", "v", "ids", *keys).groupBy(*keys).applyInArrow(build, kinds), "vector-graph"), parts


def search(index: DataFrame, parts: list[tuple[int, int, int]], queries: DataFrame, most: int, shape: Shape = Shape(), block: int = 8192) -> DataFrame:
    """Beam searches of all shards: q1, q2, hits (array<struct<score, vec_id>>, best first, ties to smaller ids, at most most) of queries (h1, h2, v: distinct).

    Each shard meets the queries in blocks: a task holds one shard's graph and one block. Only the most best nodes of
    a shard leave its task, and of these only the most best of a query leave the next one.
    """
    blocks, shards = max(1, -(-queries.count() // block)), sum(n for _, _, n in parts)

    def meet(key: tuple, graph: pa.Table, asking: pa.Table) -> pa.Table:
        if not len(graph) or not len(asking):
            return pa.table({"q1": pa.array([], pa.int64()), "q2": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "ids": pa.array([], pa.list_(pa.int64()))})
        graph = graph.sort_by("node").combine_chunks()
        v, q = _matrix(graph["v"]), _matrix(asking["v"])
        edges = graph["edges"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
        found, _ = beam_search(lifted(v), edges, len(v), asked(q), max(shape.beam, most))
        row, place = np.nonzero(found[:, : most + most // 2] >= 0)
        node = found[row, place]
        score = products(v[node], q[row])
        order = np.lexsort((-score, row))
        row, node, score = row[order], node[order], score[order]
        best = np.arange(len(row)) - np.searchsorted(row, row) < most
        row, node, score = row[best], node[best], score[best]
        return pa.table({"q1": asking["h1"].take(pa.array(row)), "q2": asking["h2"].take(pa.array(row)), "score": pa.array(score), "ids": graph["ids"].take(pa.array(node))})

    keys = ("dim", "band", "shard", "block")
    each_shard = lambda p: F.transform(F.sequence(F.lit(0), p["n"] - 1), lambda i: F.struct(p["band"].alias("band"), i.alias("shard")))
    to = F.flatten(F.transform(F.filter(_listed(parts), lambda p: p["dim"] == F.size("v")), each_shard))
    spread = queries.select("h1", "h2", "v", F.size("v").alias("dim"), F.pmod("h2", F.lit(blocks)).cast("int").alias("block"), F.explode(to).alias("to")).select("h1", "h2", "v", "dim", "to.*", "block")
    copies = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("node", "v", "ids", "edges", *keys)
    many = max(1, min(4 * shards * blocks, 1 << 16))
    met = copies.repartition(many, *keys).groupBy(*keys).cogroup(spread.repartition(many, *keys).groupBy(*keys)).applyInArrow(meet, "q1 long, q2 long, score double, ids array<long>")
    own = Window.partitionBy("q1", "q2")
    best = met.withColumn("r", F.row_number().over(own.orderBy(F.col("score").desc(), F.col("ids")[0]))).where(F.col("r") <= most)
    each = best.select("q1", "q2", "score", F.explode("ids").alias("vec_id")).withColumn("r", F.row_number().over(own.orderBy(F.col("score").desc(), "vec_id"))).where(F.col("r") <= most)
    hits = F.sort_array(F.collect_list(F.struct("r", "score", "vec_id")))
    return each.groupBy("q1", "q2").agg(F.transform(hits, lambda h: F.struct(h["score"].alias("score"), h["vec_id"].alias("vec_id"))).alias("hits"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", shape: Shape = Shape()) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of vectors with the largest inner products that are found for each query row.

    is_query is over vec_id. Equal vectors are one node and one search, whatever their number; a query's own id is not among
    its hits. Rows with a null id, and vectors that are null, empty, zero or hold null or non-finite components take no
    part. Vectors meet those of their own length. Rows that repeat count once; rows that share an id but not the
    vector are rows of their own, none a hit of the other. Ties go to the smaller id. No rows give none.
    """
    a, b = row_key(F.col("v"))
    good = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    rows = good.withColumns({"h1": a, "h2": b})
    index, parts = build_index(rows, k + 1, shape)
    if not parts:
        return good.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    asking = rows.where(is_query)
    queries = written(asking.groupBy("h1", "h2").agg(F.first("v").alias("v")), "vector-queries", small=True)
    found = written(search(index, parts, queries, k + 1, shape), "vector-hits", small=True)
    met = asking.select("vec_id", "h1", "h2").distinct().join(found, (F.col("h1") == F.col("q1")) & (F.col("h2") == F.col("q2")))
    others = met.select(F.col("vec_id").alias("query_id"), F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("vec_id")), 1, k).alias("hits"))
    flat = others.select("query_id", F.posexplode("hits").alias("at", "hit"))
    return flat.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


def op11_vector_graph(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)
