"""The similarity joins and the greedy choice against all pairs in Python."""

import itertools
import random
from difflib import SequenceMatcher

import pytest

from foliospark.functions.similarity import jaro_winkler_of
from foliospark.operators import likeness
from tests.compare import ROOT

WORDS = ["almond", "antique", "aqua", "azure", "beige", "bisque", "blush", "coral", "cream", "cyan", "Ñandú", "x"]


def names(seed, n):
    rng = random.Random(seed)
    made = [" ".join(rng.sample(WORDS, rng.randint(1, 5))) for _ in range(n)] + ["", "a", "b", "ab", "ba", "abc", "a" * 30, "a" * 31, "b" * 30, "\U0001f600 almond", "a\nb"]
    for v in rng.sample(made, n // 2):  # small changes
        at = rng.randrange(len(v) + 1)
        made.append(v[:at] + rng.choice(["", "q", "zz"]) + v[at + rng.randint(0, 2) :])
    return made


def difflib_ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


@pytest.mark.parametrize(("measure", "score"), [(likeness.ratcliff(0.85), difflib_ratio), (likeness.ratcliff(0.6), difflib_ratio), (likeness.ratcliff(0.78), difflib_ratio), (likeness.winkler(0.88), jaro_winkler_of), (likeness.winkler(0.7), jaro_winkler_of)])
def test_pairs_against_all_pairs(spark, measure, score):
    values = sorted(set(names(1, 60)))
    df = spark.createDataFrame([(v, i % 2) for i, v in enumerate(values)] + [(None, 0)], "v string, half int")
    got = [(r.v, r.w) for r in likeness.alike(df.drop("half"), [], measure).collect()]
    want = {(a, b) for a, b in itertools.combinations(values, 2) if a and b and score(a, b) >= measure.least}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 5
    half = dict((v, i % 2) for i, v in enumerate(values))
    blocks = {(r.v, r.w) for r in likeness.alike(df, ["half"], measure).collect()}
    assert blocks == {(a, b) for a, b in want if half[a] == half[b]}


def brute_greedy(rows, least, score, longest_first=False):
    rows = sorted(rows)
    if longest_first:
        rows = sorted(reversed(rows), key=lambda r: -len(r[1] or ""))
    kept, ids = [], []
    for i, v in rows:
        v = (v or "").lower()
        if not any(score(v, k) >= least or (longest_first and v in k) for k in kept):
            kept.append(v)
            ids.append(i)
    return sorted(ids)


@pytest.mark.parametrize("longest", [False, True])
def test_greedy_against_one_after_the_other(spark, longest):
    measure, score = (likeness.ratcliff(0.78), difflib_ratio) if longest else (likeness.winkler(0.88), jaro_winkler_of)
    rng = random.Random(3)
    groups = {g: [(100 * g + i, v) for i, v in enumerate(rng.choices(names(g, 40), k=90) + [None, "Almond AQUA", "almond aqua"])] for g in (1, 2)}
    groups[None] = [(5000, "same"), (5001, "Same"), (5002, "other")]
    df = spark.createDataFrame([(g, i, v, "x") for g, rows in groups.items() for i, v in rows], "folder int, id int, name string, g string").repartition(3)
    got = likeness.greedy(df, "folder", "name", "id", measure, longest)
    assert got.columns == df.columns
    assert sorted(r.id for r in got.collect()) == sorted(i for rows in groups.values() for i in brute_greedy(rows, measure.least, score, longest))
    assert likeness.greedy(df.limit(0), "folder", "name", "id", measure, longest).count() == 0


def test_parts_of_the_table_in_one_group(spark):
    part = spark.read.parquet(f"{ROOT}/part.parquet").selectExpr("1 AS one", "p_partkey", "p_name")
    rows = [(r.p_partkey, r.p_name) for r in part.collect()]
    got = sorted(r.p_partkey for r in likeness.greedy(part, "one", "p_name", "p_partkey", likeness.ratcliff(0.78), True).collect())
    assert got == brute_greedy(rows, 0.78, difflib_ratio, True)


def test_few_of_all_pairs_meet(spark):
    """Sets of two trigrams: of 320 000 pairs of random words under one in a hundred meet, and all those that are alike."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    values = [" ".join(word() for _ in range(4)) for _ in range(400)]
    values += [v[:-2] + "qq" for v in values]
    measure = likeness.ratcliff(0.85)
    met = {(r.v, r.w) for r in likeness._candidates(spark.createDataFrame([(v,) for v in values], "v string"), [], measure, measure.bands[-1]).collect()}
    assert measure.bands[-1].q == 3 and len(met) < 3200
    assert all((min(v, w), max(v, w)) in met for v, w in zip(values[:400], values[400:], strict=True))


@pytest.mark.parametrize("longest", [False, True])
def test_small_groups_need_no_search_by_q_grams(spark, longest, monkeypatch):
    """Groups of one value and of a few: the rows that one after the other leaves, without a plan for large groups."""

    def unasked(*_):
        raise AssertionError("a search by q-grams for groups of a few values")

    monkeypatch.setattr(likeness, "likely", unasked)
    monkeypatch.setattr(likeness, "containing", unasked)
    rng, measure = random.Random(5), likeness.ratcliff(0.78)
    groups = {g: [(100 * g + i, v) for i, v in enumerate(rng.sample(names(g, 40), g % 13 + 1) + [None] * (g % 2))] for g in range(40)}
    df = spark.createDataFrame([(g, i, v) for g, rows in groups.items() for i, v in rows], "folder int, id int, name string")
    got = sorted(r.id for r in likeness.greedy(df, "folder", "name", "id", measure, longest).collect())
    assert got == sorted(i for rows in groups.values() for i in brute_greedy(rows, 0.78, difflib_ratio, longest)) and len(got) < df.count()
