import re
from difflib import SequenceMatcher

import pytest

from foliospark.plans import registry
from tests.compare import ROOT, assert_same

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("key", sorted(SQL))
def test_matches_sql(spark, key):
    assert_same(QUERIES[key](spark, ROOT), SQL[key])


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, key):
    frame = QUERIES[key](spark, ROOT)
    assert frame.columns
    frame.count()


def test_every_inventoried_family_is_there():
    counts = {"SRC": 10, "SNK": 10, "FLT": 24, "JN": 17, "AGG": 29, "WIN": 12, "TOPK": 10, "DED": 15, "TXT": 23, "VEC": 9, "STR": 20, "DT": 8, "EXT": 31, "SIM": 9, "NRM": 16, "CLS": 19, "QRY": 19, "ACL": 6}
    skipped = {"SRC4", "SRC5"}
    for family, n in counts.items():
        missing = {f"{family}{i}" for i in range(1, n + 1)} - set(QUERIES) - skipped
        assert not missing, missing


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages labels conversations".split()


@pytest.mark.parametrize("key", sorted(SQL))
def test_sql_reads_a_table(key):
    assert any(re.search(rf"\b{t}\b", SQL[key]) for t in TABLES)


@pytest.mark.parametrize("key", ["JN10", "QRY19", "JN17", "NRM10", "SIM4", "SIM5", "SIM6", "SIM7", "SIM8", "SIM9", "NRM5", "DT6", "TXT14"])
def test_no_nested_loops(spark, key):
    plan = QUERIES[key](spark, ROOT)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan, plan


def test_close_words_against_difflib(spark):
    from foliospark.operators import correct

    words, tokens = ["standards", "polishes", "standing", "stander"], ["standard", "polished", "standings", "xyz", "stan"]
    df = spark.createDataFrame([(t,) for t in tokens], "t string")
    want = {}
    for t in tokens:
        each = [(SequenceMatcher(None, t, w).ratio(), w) for w in words if abs(len(t) - len(w)) <= 3 and t != w]
        each = sorted((-round(r + 0.1 * (t[:2] == w[:2]) + 0.05 * (len(t) == len(w)), 6), w) for r, w in each if r >= 0.75)
        if len(t) >= 4 and each:
            want[t] = [w for _, w in each[:3]]
    got = {}
    for r in correct.close_words(df, "t", words).orderBy("token", "rank").collect():
        got.setdefault(r.token, []).append(r.word)
    assert got == want
