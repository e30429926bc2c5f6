"""Catalogs of any size against a scan in Python."""

import random
from difflib import SequenceMatcher

from foliospark.operators import automaton


def test_five_thousand_terms_and_one_of_one_letter(spark):
    """The same answers whatever the size of the catalog, in slices and parts or in one."""
    rng = random.Random(2)
    texts = [(i, rng.choice(["ab", "x", "Ñ", ""]) + f" TERM{rng.randrange(9000)} zz" * rng.randint(0, 3)) for i in range(80)] + [(500, None), (501, ""), (502, "tErm7"), (503, "a" * 100_000 + "term4999")]
    few = [("AB", "first", 1), ("term7", "seven", 1), ("Z", "one letter", 3), ("TERM", "stem", 2)]
    many = [(f"TERM{i}", f"t{i}", 2) for i in range(5000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in texts], "id int, text string, term string").repartition(3)
    for catalog in (few, few + many):
        want = {}
        for i, t in texts:
            best = [((p, -len(w), w.upper()), c) for w, c, p in catalog if t is not None and w.upper() in t.upper()]
            if best:
                want[i] = min(best)[1]
        terms = spark.createDataFrame([*catalog, (None, "null", 0)], "term string, canonical string, priority int")
        got = {r.id: r.canonical for r in automaton.contained(df, "text", terms, "id").collect()}
        assert got == want
    sliced = automaton.occurrences(df.select("id", "text"), terms.select("term"), slice_=700, part=50_000)
    assert sorted(map(tuple, sliced.collect())) == sorted((i, w) for i, t in texts for w, _, _ in few + many if t is not None and w in t)


def test_the_empty_term_and_empty_tables(spark):
    texts = spark.createDataFrame([(1, "a"), (2, ""), (3, None)], "id int, text string")
    terms = spark.createDataFrame([("",), ("a",)], "term string")
    assert sorted(map(tuple, automaton.occurrences(texts, terms).collect())) == [(1, ""), (1, "a"), (2, "")]
    assert automaton.occurrences(texts.limit(0), terms).collect() == [] == automaton.occurrences(texts, terms.limit(0)).collect()


def test_what_contains_no_term_goes_by_ratio(spark):
    terms = [("FISCALIA CENTRAL", "central", 2), ("ROBO", "theft", 1), ("FRAUDE", "fraud", 1), ("FRAUDES", "frauds", 1)]
    values = ["fiscalia de la central", "Fiscala Centrl", "rob", "robos", "frude", "otro", "", None, "fraudee"]
    df = spark.createDataFrame(list(enumerate(values)), "id int, v string")
    want = {}
    for i, v in enumerate(values):
        parts = [((p, -len(t), t), c) for t, c, p in terms if v is not None and t in v.upper()]
        like = [((-SequenceMatcher(None, v.upper(), t).ratio(), p, -len(t), t), c) for t, c, p in terms if v and SequenceMatcher(None, v.upper(), t).ratio() > 0.7]
        if parts or like:
            want[i] = (min(parts)[1], "part") if parts else (min(like)[1], "like")
    got = {r.id: (r.canonical, r.how) for r in automaton.normalised(df, "v", spark.createDataFrame(terms, "term string, canonical string, priority int"), "id").collect()}
    assert got == want and {h for _, h in want.values()} == {"part", "like"}


def test_names_that_contain_each_other(spark):
    rng = random.Random(5)
    name = lambda: "".join(rng.choices("abC", k=rng.randint(0, 4))) or None
    a, b = [(i, name(), i % 9) for i in range(40)], [(i, name(), i % 7) for i in range(60)]
    left, right = spark.createDataFrame(a, "i int, x string, k int"), spark.createDataFrame(b, "j int, y string, m int")
    got = sorted((r.i, r.j) for r in automaton.either_contains(left, right, "x", "y", ("k", "m")).collect())
    fits = lambda x, y: x is not None and y is not None and (x.lower() in y.lower() or y.lower() in x.lower())
    assert got == sorted((i, j) for i, x, k in a for j, y, m in b if fits(x, y) or k == m)
