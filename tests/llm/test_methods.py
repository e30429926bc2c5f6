"""Methods that SQL can't express, against brute force, exact round trips and held-out labels."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliospark.llm import examples, language_id, mixing, ngram_join, quality_rules, sentencepiece_sampling, textkernel, toxicity
from foliospark.llm.components import components

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute_components(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(s), find(i)) for i, s in sets}


def near_copies(n=90, words=120, seed=3):
    """Chains and stars of near copies around both thresholds, short texts, and a passage that many share."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in rng.integers(0, 5000, words)]
    passage, rows = [f"p{i}" for i in range(60)], []
    for i in range(n):
        text = list(base)
        for j in rng.integers(0, words, rng.integers(0, 6)):
            text[j] = f"x{rng.integers(0, 9999)}"
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, " ".join([*passage, *(f"y{x}" for x in rng.integers(0, 9999, 80))])) for i in range(80)]
    graded = [f"g{i}" for i in rng.integers(0, 9000, 400)]
    rows += [(3000 + i, " ".join(graded[: 100 + 4 * i])) for i in range(70)]
    rows += [(2000 + i, t) for i, t in enumerate(["a b", "A  b", "a", "", None, "a b c d e", "a b c d e f", "a b c d e f g h i j k l m n o p q r s t"])]
    return rows


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80), (2, 50)])
def test_components_of_near_copies(spark, k, percent, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 16)
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", 4000)
    monkeypatch.setattr(ngram_join, "SHORT_LIST", 8)
    rows = near_copies()
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(rows, k, percent)


def test_a_frequent_ngram_joins_only_sets_whose_bins_are_close(spark):
    """300 sets share one n-gram; edges join those of a kind, and none of different kinds or sizes: neither short nor long sets."""
    rng, rows, kind = np.random.default_rng(4), [], {}
    for size, width, kinds in ((300, ngram_join.FEW_BINS, 40), (2000, ngram_join.MANY_BINS, 20)):
        for c in range(kinds):
            base = rng.multinomial(size - 1, [1 / width] * width)
            for i in range(5):
                bins = base.copy()
                bins[i] += 1
                rows.append((len(rows), size, bytearray(bins.astype(np.uint8).tobytes()), [7]))
                kind[len(rows) - 1] = (size, c)
    sets = spark.createDataFrame(rows, "node long, n long, bins binary, tokens array<long>")
    edges = ngram_join._candidates(sets, sets, 90).collect()
    assert all(kind[r.a] == kind[r.b] for r in edges)
    joined = {r.a for r in edges} | {r.b for r in edges}
    assert joined == set(kind) and len(edges) == 60 * 4


def test_counts_of_bins_over_a_byte_stay_a_lower_bound():
    x, y = np.array([[250, 3], [255, 0]]), np.array([[260, 3], [256, 700]])
    assert (ngram_join._apart(x.astype(np.uint8), y.astype(np.uint8)) <= np.abs(x - y).sum(1)).all()
    assert ngram_join._apart(x.astype(np.uint8), y.astype(np.uint8)).tolist()[0] == 10


def test_sets_that_share_a_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "NODE_BITS", 5)
    rows = near_copies(20) + [(9000, None), (9001, "a b")]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(rows, 3, 80)


def test_blocks_are_bounded_in_rows_and_ngrams(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", 10_000)
    sets = spark.range(3000).selectExpr("id AS node", "10 + id % 400 AS n", "id AS k1", "id AS k2")
    clusters = sets.select("node", F.when(F.col("node") < 2900, 1).otherwise(F.col("node")).cast("long").alias("root"))
    got = ngram_join._placed(sets, clusters, 90).join(sets.select("node", "n"), "node").cache()
    assert got.where("node >= 2900").select("cut", "above", "below", "band").distinct().collect() == [(1, 0, 0, 0)]
    big = got.where("node < 2900").groupBy("band").agg(F.first("cut").alias("cut"), F.sum("n").alias("n"), F.count("*").alias("c"), F.min("n").alias("lo"), F.max("n").alias("hi")).collect()
    assert all(r.n <= r.cut * 10_000 and r.c <= r.cut * ngram_join.BLOCK_ROWS and 100 * r.lo >= 89 * r.hi for r in big) and len(big) > 10


def test_components_of_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = ngram_join.near_duplicates(docs, 3, 90)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(rows, 3, 90)


def test_overlaps_by_columns(monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_COLUMNS", 7)
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(20)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert (ngram_join.overlaps(sets) == want).all()
    assert (ngram_join.overlaps(sets[:5], sets[5:]) == np.array(want)[:5, 5:]).all()


def test_contraction_of_paths_and_cliques(spark):
    edges = [(i, i + 1) for i in range(50)] + [(a, b) for a in range(100, 108) for b in range(100, a)] + [(7, 7)]
    spread = lambda x: F.xxhash64(F.lit(0), x)
    df = spark.createDataFrame(edges, "x long, y long").select(spread("x").alias("a"), spread("y").alias("b"))
    assert sorted(r["count"] for r in components(df).groupBy("root").count().collect()) == [8, 51]


def test_words_and_hashes():
    texts = ["a b\x0bc", "", "  ", "ab", "a b c", "é x y"]
    data, offsets = textkernel.packed(texts)
    starts, ends, at = textkernel.words(data, offsets)
    spans = [data[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)]
    assert [spans[a:b] for a, b in itertools.pairwise(at)] == [WORD.findall(t) for t in texts]
    h = textkernel.span_hashes(data, starts, ends)
    assert h[0] == h[4] and h[3] not in (h[0], h[1])


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "lang")
    got = language_id.op5_language_id(spark, MIDDLE).join(docs, "doc_id").where("held_out")
    assert got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_held_out_toxicity(spark):
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    got = toxicity.op7_toxicity(spark, MIDDLE).join(labels, "doc_id").where("held_out")
    found = {(r.toxic, r.predicted): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert found.get((0, 1), 0) <= 0.05 * found[(0, 0)] and found[(1, 1)] >= found.get((1, 0), 0)
    assert got.where("size(evidence) = 0").count() == 0


def test_scores_against_brute_force(spark):
    """Every score of the query from whole dictionaries of weights: cosines with all examples, votes, calibration."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    labels = sorted({(str(r.doc_id), r.toxic) for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 and r.doc_id in rows})
    term = lambda t: Counter(re.findall(r"[a-z0-9'\u0080-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)))
    counts = {i: term(t) for i, t in rows.items()}
    examples = [(counts[int(i)], y) for i, y in labels]
    n, n1, m = len(examples), sum(y for _, y in examples), len({t for c, _ in examples for t in c})
    df = Counter(t for c in counts.values() for t in c)
    weight = {}
    for t in {t for c, _ in examples for t in c}:
        o = [[sum(1 for c, y in examples if (t in c) == there and y == label) for label in (0, 1)] for there in (False, True)]
        e = [[sum(o[there]) * (n - n1, n1)[label] / n for label in (0, 1)] for there in (0, 1)]
        g = 2 * sum(o[a][b] * math.log(o[a][b] / e[a][b]) for a in (0, 1) for b in (0, 1) if o[a][b])
        weight[t] = (math.log((1 + len(rows)) / (1 + df[t])) + 1e-3) * min(1, max(toxicity.LEAST, g / (1.5 * math.log(m))))

    def unit(c):
        v = {t: (1 + math.log(k)) * weight[t] for t, k in c.items() if t in weight}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()}

    index = [unit(c) for c, _ in examples]

    def vote(c, without=None):
        q = unit(c)
        if not q:
            return None
        sims = sorted(((-round(s, 12), i, s) for i, e in enumerate(index) if i != without and (s := sum(x * e.get(t, 0) for t, x in q.items())) > 0))[:25]
        w = [1 / (1.05 - min(s, 1)) for _, _, s in sims]
        return (sum(x * examples[i][1] for x, (_, i, _) in zip(w, sims, strict=True)) + n1 / n) / (sum(w) + 1)

    votes = [vote(c, i) for i, (c, _) in enumerate(examples)]
    logit = lambda p: math.log(max(p, 1e-6) / max(1 - p, 1e-6))
    model = toxicity.NearestExamples(None, None, None, [], None, None, 0.0, 0.0, 25)
    model.calibrate(np.array([logit(p) for p in votes]), np.array([float(y) for _, y in examples]), np.ones(n))
    got = {r.doc_id: r.score for r in toxicity.op7_toxicity(spark, SMALL).collect()}
    for i, c in counts.items():
        p = vote(c)
        if p is not None:
            assert got[i] == pytest.approx(model.score(p), abs=1e-6), i


def test_domains_of_held_out_rows(spark):
    labels = mixing.label_domains(spark.read.parquet(f"{MIDDLE}/labels.parquet"))
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "text")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = mixing.train_domains(docs, labels.where(~out))
    got = mixing.mixed(docs, model, mixing.TARGETS).join(labels.where(out), "doc_id").select("posteriors", "domain").collect()
    right = sum(model.domains[int(np.argmax(r.posteriors))] == r.domain for r in got) / len(got)
    assert right > 0.9


def test_a_repeated_key_gives_one_example(spark):
    docs = spark.range(50_000).selectExpr("'k' AS doc_id", "concat('text ', id % 3) AS text").unionByName(spark.createDataFrame([("a", "other"), ("b", "x" * 4000), ("c", None), (None, "null key")], "doc_id string, text string"))
    labels = spark.createDataFrame([("k", 1)] * 500 + [("k", 0), ("a", 0), ("b", 1), ("c", 1), (None, 1), ("a", None)], "doc_id string, y int")
    rows, counts = examples.sampled(docs, labels, "y", 1000)
    assert counts == {1: 502, 0: 2}
    assert sorted(zip(rows.doc_id, rows.y, strict=True)) == [("a", 0), ("b", 1), ("k", 0), ("k", 1)]
    few, _ = examples.sampled(docs, labels, "y", 1000, most_bytes=8000)
    assert sorted(set(few.doc_id)) == ["a", "k"]
    tight, _ = examples.sampled(docs, labels, "y", 1000, most_bytes=56)
    assert 0 < tight.text.str.len().sum() <= 56 and len(tight) < 4
    one, counts = examples.sampled(docs, labels, "y", 1000, most_classes=1)
    assert set(one.y) == {1} and counts == {1: 502}


def test_texts_without_telling_terms_are_searched(spark):
    rows = [(i, f"idiot a{i} b{i}" if i % 2 else f"c{i} d{i}") for i in range(200)] + [(200, "zork quux c2 c4"), (201, "Zork, quux"), (202, "nowhere"), (203, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(200, 1)], "doc_id long, toxic int")
    model = toxicity.train_toxicity(docs, labels, docs)
    got = {r.doc_id: [e.key for e in r.evidence] for r in toxicity.score_toxicity(docs.where("doc_id > 200"), model).collect()}
    assert got == {201: ["200"], 202: [], 203: []}


@pytest.mark.parametrize("frequent", [0, 5, 40])
def test_block_max_search_is_exact(frequent):
    rng = np.random.default_rng(5)
    x = rng.random((500, 40)) * (rng.random((500, 40)) < 0.15)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    row, term = np.nonzero(x)
    index = toxicity.BlockMaxIndex.build(500, 40, row, term, x[row, term], frequent)
    for _ in range(50):
        q = np.sort(rng.choice(40, 4, replace=False))
        w = rng.random(4)
        sims = x[:, q] @ w
        ids, got = index.nearest(q, w, 10)
        want = [i for i in np.lexsort((np.arange(500), -np.round(sims, 12))) if sims[i] > 0][:10]
        assert ids.tolist() == want and np.allclose(got, sims[want])


def assert_optimal(n, p, rate, goal, most=mixing.MOST_RATE):
    """The conditions under which rates in the box are the closest to the goal, and of these the closest to 1."""
    miss = (rate * n) @ p / n.sum() - goal
    assert np.allclose(rate, np.clip(1 - p @ miss / mixing.PULL, 0, most), atol=1e-3)


def test_rates_meet_targets(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.3, 0.3, 0.3], 400)
    n = rng.integers(1, 500, 400)
    members = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p, strict=True)], "n_tokens long, p array<double>").repartition(3)
    for goal, most in (([0.2, 0.3, 0.5], mixing.MOST_RATE), ([0.05, 0.05, 0.9], 100.0)):  # the second one is out of reach of smaller rates
        rows = mixing.fit_rates(members, np.array(goal), most_rate=most).collect()
        m, q, rate = np.array([r.n_tokens for r in rows]), np.array([r.p for r in rows]), np.array([r.rate for r in rows])
        assert np.allclose((rate * m) @ q / n.sum(), goal, atol=1e-4) and rows[0].missed < 1e-4
        assert_optimal(m, q, rate, goal, most)
    rows = mixing.fit_rates(members.where("p[0] < 0.1"), np.array([1.0, 0.0, 0.0]), most_rate=3.0).collect()  # out of reach
    m, q, rate = np.array([r.n_tokens for r in rows]), np.array([r.p for r in rows]), np.array([r.rate for r in rows])
    assert 0 <= rate.min() and rate.max() <= 3.0 and rows[0].missed > 0.5
    assert rows[0].missed == pytest.approx(np.abs((rate * m) @ q / m.sum() - [1, 0, 0]).max())
    assert_optimal(m, q, rate, [1, 0, 0], 3.0)


def test_hundred_domains_in_little_memory(spark):
    """The model's chosen terms do not shrink with the number of domains, and the driver stays far below a gigabyte."""
    import tracemalloc

    rng = np.random.default_rng(8)
    texts = [" ".join([f"own{d}x{k}" for k in rng.integers(0, 6, 5)] + [f"w{k}" for k in rng.integers(0, 300, 30)]) for d in range(100) for _ in range(12)]
    labels = [f"d{d:03}" for d in range(100) for _ in range(12)]
    tracemalloc.start()
    model = mixing.DomainModel.fit(texts, labels, dict.fromkeys(labels, 12))
    assert tracemalloc.get_traced_memory()[1] < 1 << 30 and len(model.vocabulary) >= 400
    tracemalloc.stop()
    p = model.posteriors(*textkernel.packed(texts))
    assert np.mean([model.domains[i] == x for i, x in zip(p.argmax(1), labels, strict=True)]) > 0.9


def test_mixing_query_against_brute_force(spark):
    """The query's rates meet the targets, stay in the box and are optimal by conditions computed over all documents as one array."""
    rows = mixing.op3_mixing(spark, MIDDLE).collect()
    n, p, rate = np.array([r.n_tokens for r in rows], float), np.array([r.posteriors for r in rows]), np.array([r.rate for r in rows])
    model = mixing.train_domains(spark.read.parquet(f"{MIDDLE}/documents.parquet"), mixing.label_domains(spark.read.parquet(f"{MIDDLE}/labels.parquet")))
    goal = np.array([mixing.TARGETS[x] for x in model.domains])
    goal = goal / goal.sum()
    assert (rate >= 0).all() and (rate <= mixing.MOST_RATE).all()
    assert_optimal(n, p, rate, goal)
    assert rows[0].missed == pytest.approx(np.abs((rate * n) @ p / n.sum() - goal).max(), abs=1e-9)
    assert abs(sum(r.copies for r in rows) - rate.sum()) < 4 * len(rows) ** 0.5


def test_copies_follow_rates(spark):
    rows = [(i, f"word{i} " * 20) for i in range(2000)]
    model = mixing.DomainModel.fit([t for _, t in rows[:40]], ["a", "b"] * 20, {"a": 20, "b": 20})
    out = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string"), model, {"a": 0.7, "b": 0.3}).agg(F.sum("rate"), F.sum("copies")).first()
    assert out[1] == pytest.approx(out[0], rel=0.05)


def test_sampled_pieces_have_their_chances():
    v = sentencepiece_sampling.vocabulary(sentencepiece_sampling.MODEL)
    known = {}
    for i, key in enumerate(v.pieces):
        if isinstance(key, bytes) and key:
            known[key.decode(errors="replace").replace(" ", "▁")] = i
    score = {int(i): s for i, s in zip(v.ids, v.scores, strict=True)}
    alpha, n, word = 3e-4, 20_000, "there"

    def ways(s):
        if not s:
            yield ()
        for k in range(1, len(s) + 1):
            if s[:k] in known:
                for rest in ways(s[k:]):
                    yield (known[s[:k]], *rest)

    chance = {w: math.exp(alpha * sum(score[i] for i in w)) for w in ways("▁" + word)}
    total = sum(chance.values())
    data, offsets = textkernel.packed([word] * n)
    ids, to = sentencepiece_sampling.sample(data, offsets, np.arange(n).astype(np.uint64), v, alpha, 1)
    counts = Counter(tuple(ids[a:b].tolist()) for a, b in itertools.pairwise(to))
    assert set(counts) <= set(chance)
    for w, c in chance.items():
        p = c / total
        assert abs(counts[w] / n - p) <= 5 * math.sqrt(p * (1 - p) / n) + 1e-4


def test_pipeline_against_brute_force(spark):
    """Each of the first three stages on what the stage before it kept, whole."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality rules"](spark, docs, SMALL)
    verdict = {r.doc_id: r.kept for r in quality_rules.judge(docs).collect()}
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, k in verdict.items() if k)
    cleaned = stages["line dedup"](spark, kept, SMALL)
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    texts = {i: (rows[i].text or "").split("\n") for i, k in verdict.items() if k}
    often = Counter(k for ls in texts.values() for k in {key(x) for x in ls} if k)
    want = {i: "\n".join(x for x in ls if often[key(x)] < 10) for i, ls in texts.items()}
    got = {r.doc_id: r.text for r in cleaned.collect()}
    assert got == want and cleaned.columns == docs.columns
    single = stages["near duplicates"](spark, cleaned, SMALL)
    ids = brute_components(sorted(want.items()), 5, 80)
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i, (_, c) in ids.items() if c == i)
    mixed = stages["mixing"](spark, single, SMALL)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.select("doc_id").collect()} <= set(got)
    copies = Counter(r.doc_id for r in mixed.select("doc_id").collect())
    assert max(copies.values()) <= max(mixing.MOST_RATE, 0.01 * sum(copies.values())) and len(copies) > 0.85 * single.count()
    pieces = stages["sentencepiece"](spark, mixed, SMALL)
    assert pieces.where("NOT lossless").count() == 0 and pieces.count() == mixed.count()


def lattice_ways(v, text, alpha):
    """Every segmentation of the text (its space first), as piece ids, with its chance."""
    ids = {p: i for i, p in enumerate(v.pieces) if p and i not in set(v.bytes_.tolist())}
    score = dict(zip(v.ids.tolist(), v.scores.tolist(), strict=True))
    letters = [" ", *text]

    def ways(at):
        if at == len(letters):
            yield (), 0.0
        for to in range(at + 1, len(letters) + 1):
            part = letters[at:to]
            key = "".join(part).encode()
            plain = "\u2581" not in part  # a literal one is no space
            if plain and key in ids:
                for rest, w in ways(to):
                    yield (ids[key], *rest), alpha * score[ids[key]] + w
            elif to == at + 1:
                for rest, w in ways(to):
                    yield (*v.bytes_[list(key)].tolist(), *rest), w

    found = dict(ways(0))
    top = max(found.values())
    total = sum(math.exp(x - top) for x in found.values())
    return {w: math.exp(x - top) / total for w, x in found.items()}


@pytest.mark.parametrize("text", ["a\u2581b c", "ñ😀x  yes", "\x00\nab"])
def test_lattices_with_bytes_against_brute_force(text):
    v = sentencepiece_sampling.vocabulary(sentencepiece_sampling.MODEL)
    want, n = lattice_ways(v, text, 1e-3), 8000
    data, offsets = textkernel.packed([text] * n)
    ids, to = sentencepiece_sampling.sample(data, offsets, np.arange(n).astype(np.uint64), v, 1e-3, 3)
    got = Counter(tuple(ids[a:b].tolist()) for a, b in itertools.pairwise(to))
    assert set(got) <= set(want)
    for w, p in want.items():
        assert abs(got[w] / n - p) <= 5 * math.sqrt(p * (1 - p) / n) + 1e-3
    assert sentencepiece_sampling.same_rows(ids, to, v, data, offsets).all()


def test_single_lanes_draw_as_many_lanes_do(monkeypatch):
    v = sentencepiece_sampling.vocabulary(sentencepiece_sampling.MODEL)
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("abcdehilnorst ñ"), 300)) for _ in range(20)] + ["", None, "x" * 5000]
    data, offsets = textkernel.packed(texts)
    keys = np.arange(len(texts)).astype(np.uint64)
    many = sentencepiece_sampling.sample(data, offsets, keys, v, 1e-3, 0)
    monkeypatch.setattr(sentencepiece_sampling, "FEW", 1 << 30)
    one = sentencepiece_sampling.sample(data, offsets, keys, v, 1e-3, 0)
    assert (many[0] == one[0]).all() and (many[1] == one[1]).all()


def test_unbroken_text_of_a_million_characters():
    v = sentencepiece_sampling.vocabulary(sentencepiece_sampling.MODEL)
    text = "".join(np.random.default_rng(1).choice(list("abcdefghij"), 1_000_000))
    data, offsets = textkernel.packed([text])
    ids, to = sentencepiece_sampling.sample(data, offsets, np.zeros(1, np.uint64), v, 1e-3, 0)
    assert sentencepiece_sampling.decode(ids, v) == text


def test_wrong_pieces_are_told():
    v = sentencepiece_sampling.vocabulary(sentencepiece_sampling.MODEL)
    data, offsets = textkernel.packed(["one two", "", "three", "four"])
    ids, to = sentencepiece_sampling.sample(data, offsets, np.arange(4).astype(np.uint64), v, 1e-3, 0)
    ids = ids.copy()
    ids[to[2]] = ids[to[0]]
    assert sentencepiece_sampling.same_rows(ids, to, v, data, offsets).tolist()[::2] == [True, False]
    assert sentencepiece_sampling.same_rows(ids, to, v, data, offsets)[[1, 3]].all()
