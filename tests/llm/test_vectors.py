"""Operators 11 and 12 against brute force, with odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import vector_codes, vector_graph

NAN, INF = float("nan"), float("inf")


def exact(rows, is_query, k):
    """query_id: [(score, vec_id)] by brute force over distinct rows."""
    good = {(i, tuple(float(np.float32(x)) for x in v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for q, v in good:
        if is_query(q):
            hits = sorted(((-sum_products(v, w), i) for i, w in good if i != q and len(w) == len(v)))
            out[q] = [(-s, i) for s, i in hits[:k]]
    return out


def sum_products(v, w):
    total = 0.0
    for x, y in zip(v, w, strict=True):
        total += x * y
    return total


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    return out


ODD = [(0, None), (20, []), (40, [0.0, 0.0]), (60, [1.0, None]), (80, [NAN, 1.0]), (100, [INF, 1.0]), (None, [1.0, 1.0])]


def test_few_vectors_are_all_found(spark):
    rng = np.random.default_rng(5)
    rows = ODD + [(i, [float(x) for x in rng.normal(size=2)]) for i in range(200, 245)] + [(i, [1.0, 2.0]) for i in range(300, 340)]
    rows += [(400, [1.0, 2.0, 3.0]), (401, [3.0, 2.0, 1.0]), (220, [5.0, 5.0]), (500, [-1.0, -2.0]), (260, [1.0, 2.0]), (260, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, rank string").repartition(3)
    got = found(vector_graph.nearest(df, F.col("vec_id") % 20 == 0, k=5))
    want = exact(rows, lambda q: q % 20 == 0, 5)
    want[220], got[220] = sorted(want[220]), sorted((s, i) for _, s, i in got[220])  # two rows share this id
    assert set(got) == set(want) and 500 in got and 400 in got
    for q in got:
        if q != 220:
            assert got[q] == [(n + 1, s, i) for n, (s, i) in enumerate(want[q])], q
    assert len(got[220]) == 10 and set(want[220]) <= set(got[220])
    assert [i for _, _, i in got[400]] == [401]


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vector_graph.nearest(df, F.col("vec_id") % 20 == 0).collect() == []
    only = spark.createDataFrame(ODD, "vec_id long, embedding array<float>")
    assert vector_graph.nearest(only, F.col("vec_id") % 20 == 0).collect() == []
    assert vector_codes.compress(df.withColumn("label", F.lit(1))).collect() == []


@pytest.mark.parametrize("spread", [0.0, 0.6])
def test_recall_of_shards(spark, spread):
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(12, 24))[rng.integers(0, 12, 4000)] + 0.7 * rng.normal(size=(4000, 24))).astype(np.float32)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True) * rng.lognormal(0, spread, (4000, 1))).astype(np.float32)
    x[1000:2300] = x[999]  # a third are copies
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    shape = vector_graph.Shape(degree=24, beam=64, shard=1000)
    got = found(vector_graph.nearest(df, F.col("vec_id") % 20 == 0, k=10, shape=shape))
    assert len(got) == 200 and all([r for r, _, _ in v] == list(range(1, 11)) for v in got.values())
    y, hit = x.astype(float), 0
    for q, v in got.items():
        scores = y @ y[q]
        scores[q] = -np.inf
        least = np.sort(scores)[-10]
        assert len({i for _, _, i in v} | {q}) == 11
        for _, s, i in v:
            assert s == pytest.approx(float(y[i] @ y[q]), rel=1e-12)
            hit += s >= least - 1e-12
        if 999 <= q < 2300 and scores.max() < y[999] @ y[999] + 1e-9:  # copies of the largest product, by id
            assert [i for _, _, i in v] == [i for i in range(999, 1011) if i != q][:10]
    assert hit >= 0.95 * 2000


def test_pruning_keeps_diverse_edges():
    x = vector_graph.lifted(np.array([[1, 0.0], [1, 0.1], [1, 0.11], [1, -0.2], [-1, 0]]))
    edges = vector_graph.pruned(x, np.array([0]), np.array([[0, 1, 2, 3, 4, 4]]), vector_graph.Shape(degree=4, relax=1.0))
    assert edges[0].tolist() == [1, 3, 4, -1]  # 2 is nearer to 1 than to 0


def test_annulus_against_all_entries():
    rng = np.random.default_rng(3)
    for width, size, most in ((4, 64, 60), (1, 5, 3), (3, 1, 9), (4, 64, 1 << 23)):
        entries = rng.integers(-most, most + 1, (size, width))
        entries[size // 2 :] = entries[: size - size // 2]  # ties
        parts = np.concatenate([rng.integers(-most, most + 1, (700, width)), entries, np.zeros((1, width), np.int64)])
        index, least = vector_codes.annulus_nearest(parts, entries)
        distance = ((parts[:, None] - entries[None]) ** 2).sum(2)
        assert (least == distance.min(1)).all() and (index == distance.argmin(1)).all()


def brute_codes(rows, parts, entries, rounds):
    """vec_id: (code, error) and label sums, in plain Python integers."""
    kept = [(i, l, [max(-(1 << 24), min(1 << 24, int(np.floor(256 * float(np.float32(x)))))) for x in v]) for i, v, l in rows if v and None not in v and np.isfinite(v).all()]
    sizes = [len(v) for _, _, v in kept]
    length = max(set(sizes), key=lambda n: (sizes.count(n), n))
    kept = [(i, l, v + [0] * (-length % parts)) for i, l, v in kept if len(v) == length]
    w = -(-length // parts)
    first = sorted((i is None, i or 0, v) for i, _, v in kept)[:entries]
    books = [[v[p * w : p * w + w] for _, _, v in first] for p in range(parts)]

    def near(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            of = {}
            for _, _, v in kept:
                of.setdefault(near(v[p * w : p * w + w], books[p])[1], []).append(v[p * w : p * w + w])
            books[p] = [[sum(c) // len(of[j]) for c in zip(*of[j], strict=True)] if j in of else e for j, e in enumerate(books[p])]
    out, sums = [], {}
    for i, l, v in kept:
        got = [near(v[p * w : p * w + w], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{j:02x}" for _, j in got), sum(d for d, _ in got), l))
        sums[l] = sums.get(l, 0) + out[-1][2]
    return sorted(((i, c, e, sums[l]) for i, c, e, l in out), key=str)


@pytest.mark.parametrize("parts", [2, 3])
def test_codes_against_brute_force(spark, parts):
    rng = np.random.default_rng(7)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4)], [None, 1, 2][i % 3]) for i in range(60)]
    rows += [(5, [0.5, 0.5, 0.5, 0.5], None), (5, [0.5, 0.5, 0.5, 0.5], None), (None, [1.0, 2.0, 3.0, 4.0], 2), (70, [1e30, -1e30, 0.0, 1.0], 9)]
    rows += [(71, None, 1), (72, [], 1), (73, [1.0, None, 1.0, 1.0], 1), (74, [NAN, 1.0, 1.0, 1.0], 1), (75, [1.0, -INF, 1.0, 1.0], 1), (76, [1.0], 1)]
    df = spark.createDataFrame([(i, v, l, "c") for i, v, l in rows], "vec_id long, embedding array<float>, label int, code string").repartition(4)
    got = vector_codes.compress(df, parts=parts, entries=8, rounds=2).collect()
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=str) == brute_codes(rows, parts, 8, 2)
    assert len({r.codebooks_sha256 for r in got}) == 1


def test_fewer_vectors_than_entries(spark):
    df = spark.createDataFrame([(3, [1.0, 2.0], 1), (4, [1.0, 2.0], 1)], "vec_id long, embedding array<float>, label int")
    assert [(r.vec_id, r.code, r.error, r.label_error) for r in vector_codes.compress(df, parts=2).orderBy("vec_id").collect()] == [(3, "0000", 0, 0), (4, "0000", 0, 0)]
