"""The inverted index against a scan in Python."""

import math
import re

from pyspark.sql import functions as F

from foliospark.operators import fulltext

PAGES = [(1, "La Declaración del testigo; declaraciones, Año 2020."), (2, None), (3, ""), (4, "testigos TESTIGO testgo x"), (5, "nada aquí\n" * 3000 + "testigo"), (6, "la la la"), (None, "testigo"), (7, "testigo"), (7, "testigo")]


def frame(spark):
    return spark.createDataFrame([(i, t, "c", 1) for i, t in PAGES], "page_id long, text string, token string, bucket int").repartition(3)


def test_postings(spark):
    got = {(r.page_id, r.token): r.tf for r in fulltext.postings(frame(spark)).collect() if r.page_id in (1, 4, 5, 6)}
    assert got[1, "declaracion"] == 1 and got[1, "2020"] == 1 and got[6, "la"] == 3 and got[4, "testigo"] == 1 and got[5, "testigo"] == 1 and got[5, "nada"] == 3000
    stemmed = {(r.page_id, r.token): r.tf for r in fulltext.postings(frame(spark), fulltext.Analyser(("la", "del"), True)).collect() if r.page_id in (1, 4, 6)}
    assert stemmed[1, "declar"] == 2 and stemmed[4, "testig"] == 2 and (6, "la") not in stemmed


def min_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_search_against_a_scan(spark):
    index = fulltext.build(frame(spark))
    plain = [(i, re.findall(r"[^\W_]+", (t or "").lower().translate(str.maketrans("áéíóúñ", "aeioun")))) for i, t in PAGES]
    for query, fuzzy in (("Testigo la", False), ("testgos declaracion", True), ("zzz", True), ("", False), ("la", True)):
        words = fulltext.Analyser().words(query)
        vocabulary = {w for _, ws in plain for w in ws}
        weight = {w: max(1 - min_edits(q, w) / len(q) for q in words if min_edits(q, w) <= (fulltext.fuzziness(q) if fuzzy else 0)) for w in vocabulary if any(min_edits(q, w) <= (fulltext.fuzziness(q) if fuzzy else 0) for q in words)}
        df = {w: sum(w in ws for _, ws in plain) for w in weight}
        want = {}
        for i, ws in plain:
            own = sum(ws.count(w) * math.log((len(PAGES) + 1) / (df[w] + 1)) * weight[w] for w in weight)
            if any(w in ws for w in weight):
                want[i] = want.get(i, 0.0) + own
        got = {r.page_id: r.score for r in fulltext.search(index, query, 20, fuzzy).collect()}
        assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-5 for i in got), (query, got, want)


def test_a_search_opens_the_files_of_its_words(spark):
    index = fulltext.build(frame(spark))
    found = fulltext.search(index, "testigo")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and "PushedFilters" in plan and "In(token" in plan or "EqualTo(token" in plan


def test_highlights(spark):
    pages = frame(spark).where("page_id IN (4, 5)")
    index = fulltext.build(pages)
    got = {r.page_id: r.highlights for r in fulltext.highlighted(fulltext.search(index, "nada testigo"), pages).collect()}
    text = PAGES[4][1]
    assert got[4] == [PAGES[3][1]] and got[5] == [text[:150], text[155:305], text[305:455]]
    assert fulltext.build(pages.limit(0)).table("terms").agg(F.count("*")).first()[0] == 0


def test_distinct_words_are_analysed_once_in_a_block(spark):
    """A list for each token of a block of many pages, not one for each megabyte of text, with its counts beside it."""
    pages = spark.createDataFrame([(i, f"Año uno_dos ano w{i} " + "relleno " * 2000) for i in range(200)], "page_id long, text string").coalesce(1)
    got = {r.token: r for r in fulltext.lists(pages).where("token NOT LIKE 'w%'").collect()}
    assert fulltext.lists(pages).where("token = 'relleno'").count() == 1 and set(got) == {"ano", "uno", "dos", "relleno"}
    assert got["ano"].df == 200 and got["ano"].cf == 400 and got["relleno"].cf == 400_000 and sorted(got["dos"].pages) == list(range(200)) and set(got["ano"].tfs) == {2}


def test_a_fuzzy_search_does_not_move_the_lists(spark):
    """Also where the term table is over the size that is broadcast."""
    index = fulltext.build(spark.createDataFrame([(i, f"testigo w{i} v{i}") for i in range(3000)], "page_id long, text string"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10KB")
    try:
        found = fulltext.search(index, "testgos declaracion", fuzzy=True)
        assert found.count() == 20
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "hashpartitioning(bucket" not in plan, plan
