import datetime as dt
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from foliospark.functions import dates, similarity, text
from foliospark.operators import access, classify, correct, extract, fulltext, likeness, resolve, search, timeline, vectors
from foliospark.sources import catalog, sinks


def values(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: [(x is not None, x) for x in r])


@pytest.fixture
def fx(spark):
    rows = [(1, "a", "Abba abba ABBA"), (2, "a", None), (3, "b", ""), (4, "b", "100% _x_ términos Términos"), (5, None, "aaaa")]
    return spark.createDataFrame(rows, "page_id int, folder string, text string")


def test_positions_overlap_and_nulls(fx):
    assert values(search.hits(fx, "aa"), "page_id", "position") == [(5, 0), (5, 1), (5, 2)]
    assert values(search.hits(fx, "abba"), "page_id", "position") == [(1, 0), (1, 5), (1, 10)]
    assert values(search.hits(fx, "términos"), "page_id", "position") == [(4, 9), (4, 18)]


def test_literal_and_wildcard_terms(fx):
    assert values(fx.where(text.contains_ci("text", "0% _")), "page_id") == [(4,)]
    assert values(fx.where(text.like_ci("text", "a%a")), "page_id") == [(1,), (5,)]


def test_context_is_cut_at_words(spark):
    df = spark.createDataFrame([(1, "f", "word " * 100 + "needle" + " word" * 100)], "page_id int, folder string, text string")
    row = search.hits(df, "needle", around=12).first()
    assert row.context == "...word word word needle word word word..."
    assert row.position == 500


def test_snippet_without_hit(fx):
    assert fx.where("page_id = 3").select(text.snippet("text", "zz")).first()[0] == ""


def test_boolean_guards(fx):
    with pytest.raises(ValueError):
        search.boolean_search(fx, ["a"], "XOR")
    with pytest.raises(ValueError):
        search.hits(fx, "a")
    with pytest.raises(ValueError):
        search.require_share(1.5)


def test_dates(spark):
    rows = [("31/02/2020",), ("el 1 de enero de 2000",), (None,), ("",)]
    df = spark.createDataFrame(rows, "t string").select(dates.parse_date("t").alias("d"))
    assert [r.d for r in df.collect()] == [None, dt.date(2000, 1, 1), None, None]
    assert spark.range(1).select(dates.plausible(F.lit("1989-12-31").cast("date"), "2024-01-01"), dates.plausible(F.lit("2025-12-31").cast("date"), "2024-01-01")).first()[:] == (False, True)


@pytest.mark.parametrize("days,expected", [(179, None), (180, "medium"), (269, "medium"), (270, "high"), (364, "high"), (365, "critical"), (1825, "critical"), (1826, None), (0, None)])
def test_gap_thresholds(spark, days, expected):
    first = dt.date(2000, 1, 1)
    df = spark.createDataFrame([(1, 1, first), (2, 1, first + dt.timedelta(days)), (3, 1, None), (4, 2, first)], "id int, folder_id int, day date")
    got = timeline.gaps(df).collect()
    assert [r.priority for r in got] == ([expected] if expected else [])


def test_overlap_of_first_page(spark):
    df = spark.createDataFrame([(1, 1, "ab"), (1, 2, "cd")], "doc int, page int, text string")
    assert values(timeline.overlapped(df, "doc", "page", "text"), "page", "joined") == [(1, "ab"), (2, "ab cd")]


def test_page_of_position(spark):
    pages = spark.createDataFrame([(1, 1, 0), (1, 2, 10)], "doc int, page int, start int")
    at = spark.createDataFrame([(1, 0), (1, 9), (1, 10), (1, 99)], "doc int, position int")
    assert values(timeline.page_of(at, pages, "doc"), "position", "page") == [(0, 1), (9, 1), (10, 2), (99, 2)]


def test_similarities(spark):
    pairs = [("MARTHA", "MARHTA"), ("", ""), ("abc", "xyz"), ("casa", "caza")]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", similarity.ratio("a", "b").alias("r"), similarity.jaro_winkler("a", "b").alias("j")).collect():
        assert r.r == pytest.approx(SequenceMatcher(None, r.a, r.b).ratio())
    assert similarity.jaro_winkler_of("MARTHA", "MARHTA") == pytest.approx(0.961111, abs=1e-6)
    v = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0]), ([1.0], [1.0, 2.0])], "a array<float>, b array<float>")
    assert [r[0] for r in v.select(similarity.cosine("a", "b")).collect()] == [1.0, -1.0, 0.0, None, 0.0]


def test_near_names_are_greedy(spark):
    rows = [(1, 1, "Ana Ruiz Soto"), (2, 1, "Ana Ruiz Sotto"), (3, 1, "Luis Mora"), (4, 2, "Ana Ruiz Sotto"), (5, 1, None)]
    df = spark.createDataFrame(rows, "id int, page int, name string")
    assert values(likeness.greedy(df, "page", "name", "id", likeness.winkler(0.88)), "id") == [(1,), (3,), (4,), (5,)]


def test_merge_edit_delete(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "id int, v string")
    into = spark.createDataFrame([(2, 1)], "id int, keep int")
    assert values(resolve.merged(df, "id", into, ["v"]), "id", "v") == [(1, "x"), (3, "y")]
    assert values(resolve.edited(df, spark.createDataFrame([(3, "z")], "id int, v string"), "id", ["v"]), "id", "v") == [(1, None), (2, "x"), (3, "z")]
    assert values(resolve.deleted(df, into, "id"), "id") == [(1,), (3,)]


def test_access_fails_closed(spark):
    rows = spark.createDataFrame([(1,), (2,)], "folder_id int")
    grants = spark.createDataFrame([(7, 1, True, None, dt.datetime(2020, 1, 1)), (7, 2, False, None, None)], "user_id int, folder_id int, see boolean, starts timestamp, ends timestamp")
    assert values(access.visible(rows, grants, 9, "folder_id"), "folder_id") == []
    assert values(access.visible(rows, grants, 9, "folder_id", role="ADMIN"), "folder_id") == [(1,), (2,)]
    assert values(access.visible(rows, grants, 7, "folder_id", flag="see"), "folder_id") == [(1,)]
    assert values(access.visible(rows, grants, 7, "folder_id", now="2021-01-01"), "folder_id") == [(2,)]


def test_entities_of_nulls(fx):
    assert extract.spans(fx, extract.DATES).count() == 0
    assert fx.select(extract.phones("text").alias("p")).where("size(p) > 0").count() == 0
    assert fx.select(classify.cover_reason("text").alias("r")).where("r = 'empty'").count() == 2


def test_corrections_keep_line_ends(spark):
    df = spark.createDataFrame([("a  b\nc\t\td",)], "t string")
    assert df.select(correct.corrected("t")).first()[0] == "a b\nc d"
    assert df.select(text.without_controls(F.lit("a\x00b\nc"))).first()[0] == "ab\nc"


def test_embedder_is_deterministic(spark, fx):
    got = vectors.embedded(fx, vectors.hashing_embedder(8), least=3).collect()
    assert {r.page_id for r in got} == {1, 4, 5}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert values(catalog.json_lines(spark, str(tmp_path / "log.json"), "a int"), "a") == [(1,), (2,)]
    df = spark.createDataFrame([(1, "x\ny", None)], "id int, t string, u string")
    sinks.write_csv(sinks.export_rows(df), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()[0][:] == ("1", "x y", "-")
    both = spark.createDataFrame([(1, "a"), (2, "b")], "g int, v string")
    sinks.replace_groups(both, str(tmp_path / "out"), "g")
    sinks.replace_groups(both.where("g = 2").withColumn("v", F.lit("c")), str(tmp_path / "out"), "g")
    assert values(spark.read.parquet(str(tmp_path / "out")), "g", "v") == [(1, "a"), (2, "c")]


def test_initials_of_whole_texts(spark, tmp_path):
    from foliospark.plans import registry

    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(1).withColumn("text", F.lit("ann " * 20 + "Zoe Yu")).write.parquet(f"{tmp_path}/documents.parquet")
    assert registry.queries()["STR20"](spark, str(tmp_path)).first().initials.endswith("Z.Y.")


def test_written_dates(spark):
    rows = [("cinco de mayo de dos mil veinte",), ("treinta y uno de febrero de dos mil uno",), ("uno de enero de mil novecientos noventa y nueve",), ("algo de enero de mil",), (None,)]
    got = [r.d for r in spark.createDataFrame(rows, "t string").select(dates.written_date("t").alias("d")).collect()]
    assert got == [dt.date(2020, 5, 5), None, dt.date(1999, 1, 1), None, None]


def test_partial_dates(spark):
    rows = [("5-may-2020", dt.date(2020, 5, 5)), ("2020-07", dt.date(2020, 7, 1)), ("2020-07-09", None), ("5 de mayo de 2020", None), ("en mayo de 2020", dt.date(2020, 5, 1))]
    df = spark.createDataFrame([(t,) for t, _ in rows], "t string").select(dates.partial_date("t").alias("d"))
    assert [r.d for r in df.collect()] == [d for _, d in rows]


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "b a b, Á"), (2, ""), (3, None), (4, "casas casa")], "page_id int, text string")
    assert values(fulltext.postings(df), "page_id", "token", "tf") == [(1, "a", 2), (1, "b", 2), (4, "casa", 1), (4, "casas", 1)]
    assert values(fulltext.postings(df, fulltext.Analyser(("b",), True)), "page_id", "token", "tf") == [(1, "a", 2), (4, "casa", 2)]


def test_whole_words_and_case(fx):
    assert values(search.advanced(fx, "abba", whole_word=True), "page_id", "position", "match") == [(1, 0, "Abba"), (1, 5, "abba"), (1, 10, "ABBA")]
    assert values(search.advanced(fx, "abba", match_case=True, before=3, after=2), "page_id", "before", "after") == [(1, "ba ", " A")]
    assert values(search.advanced(fx, "aa", whole_word=True), "page_id") == []


def test_hits_of_whole_texts_are_shown(spark):
    df = spark.createDataFrame([(1, "x" * 5000 + " needle end")], "page_id int, text string")
    row = search.highlights(df, "needle", 5).first()
    assert (row.position, row.shown) == (5001, "...xxxx **needle** end")


def test_exported_cells_come_back_whole(spark, tmp_path):
    rows = [("a\n\"b\", c", "x"), (None, "y"), ("", "z"), ("\\", "é")]
    df = spark.createDataFrame(rows, "t string, u string")
    got = sinks.exported(sinks.export_rows(df), str(tmp_path / "csv")).collect()
    assert {tuple(r) for r in got} == {('a "b", c', "x"), ("-", "y"), ("", "z"), ("\\", "é")}


def test_appended_rows_stay_behind_the_old_ones(spark, tmp_path):
    one = spark.createDataFrame([(1,)], "v int")
    sinks.appended(one, str(tmp_path / "log"))
    assert sinks.appended(one, str(tmp_path / "log")).count() == 2


def test_names_are_split_before_their_particles(spark):
    want = {
        "María Luisa de la Vega": ("María Luisa", "de la Vega", None), "Ana Ruiz Paz": ("Ana", "Ruiz", "Paz"), "Ana Ruiz de la Vega": ("Ana", "Ruiz", "de la Vega"), "Pedro del Río Mora": ("Pedro", "del Río", "Mora"),
        "Juan Carlos de los Santos y Cruz": ("Juan Carlos de los Santos", "y", "Cruz"), "Rosa": ("Rosa", None, None), "Rosa Mora": ("Rosa", "Mora", None), "": ("", None, None), "José Luis": ("José", "Luis", None),
    }
    df = spark.createDataFrame([(n,) for n in want], "name string").select("name", *extract.name_parts("name"))
    assert {r.name: (r.given, r.paternal, r.maternal) for r in df.collect()} == want


def test_only_names_answer_for_a_page(spark):
    want = {
        "compareció ante el juez. Calle Hidalgo": None, "la agente María Luisa de la Vega y otros": "María Luisa de la Vega", "agente de turno": None, "Titular Lic. Pedro Mora, presente": "Pedro Mora",
        "ante la jueza Ana Ruiz Paz rindió": "Ana Ruiz Paz", "el titular de la unidad": None, "Agente Público": None, "AGENTE PEDRO MORA": None, "ante el fiscal Luis Soto": "Luis Soto", "": None,
    }
    df = spark.createDataFrame([(t,) for t in [*want, None]], "text string").select("text", extract.responsible("text").alias("officer"))
    assert {r.text: r.officer for r in df.collect()} == want | {None: None}


def test_an_officer_is_told_by_a_capital(spark):
    filler = " palabras sin más elementos que se repiten hasta llenar las cien letras que un párrafo necesita para contar"
    rows = [(1, "la agente de turno" + filler), (2, "la agente Rosa llega" + filler)]
    got = {r.page_id: r.relevance for r in extract.scored_paragraphs(spark.createDataFrame(rows, "page_id int, text string"), (), 0).collect()}
    assert got == {1: 0, 2: 2}


def test_deletes_go_down_trees_and_cycles(spark):
    from foliospark.operators import cascade

    links = [("a", None), ("b", "a"), ("c", "b"), ("c", "a"), ("d", "c"), ("x", "y"), ("y", "x"), (None, "a"), ("lone", None), ("b", "a")] + [(f"n{i}", f"n{i - 1}" if i else "d") for i in range(12)]
    tree = spark.createDataFrame(links, "node string, parent string")
    roots = lambda *n: spark.createDataFrame([(x,) for x in n], "node string")
    got = {r.node: r.depth for r in cascade.below(roots("b", "x", "not there", "x"), tree).collect()}
    assert got == {"b": 0, "c": 1, "d": 2, "x": 0, "y": 1} | {f"n{i}": i + 3 for i in range(12)}
    gone = cascade.below(roots("d"), tree)
    rows = spark.createDataFrame([("d", 1), ("n11", 2), ("a", 3), (None, 4)], "node string, v int")
    assert values(cascade.deleted(rows, gone, "node"), "v") == [(3,), (4,)]
    marked = cascade.marked(rows, gone, "node", F.lit("2024-01-02").cast("timestamp"))
    again = cascade.marked(marked, cascade.below(roots("a"), tree), "node", F.lit("2025-01-01").cast("timestamp"))
    assert {(r.v, r.deleted_at and r.deleted_at.year) for r in again.collect()} == {(1, 2024), (2, 2024), (3, 2025), (4, None)}
    assert values(cascade.visible(cascade.restored(again, roots("a"), "node")), "v") == [(3,), (4,)]
    assert cascade.below(roots("a"), tree.limit(0)).count() == 0


def test_similar_values_of_a_catalog(spark):
    from foliospark.operators import trigrams

    names = ["Centro", "Centro Histórico", "Roma Norte", "roma sur", "Condesa", "", None, "X", "Del Valle Centro"]
    catalog = spark.createDataFrame([(n, i % 2) for i, n in enumerate(names)] + [("Centro", 0)], "area string, rank int")
    typed = spark.createDataFrame([("centor",), ("oma",), ("x",), ("",), (None,), ("zzz",), ("centor",), ("centr",)], "typed string")
    got = trigrams.autocompleted(typed, catalog, "area", n=3).collect()

    def grams(t):
        words = "".join(c if c.isalnum() else " " for c in t.lower()).split()
        return {f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)}

    want = set()
    for q in ("centor", "oma", "x", "zzz", "centr"):
        score = {n: len(grams(n) & grams(q)) / len(grams(n) | grams(q)) for n in names if n}
        best = sorted((n for n in score if score[n] > 0.2 or q in n.lower()), key=lambda n: (-score[n], n))[:3]
        want |= {(q, n, round(score[n], 6), i + 1) for i, n in enumerate(best)}
    assert {tuple(r) for r in got} == want and len(got) == len(want) >= 5
    own = [(1, "06000", "Centro", "Calle", "1"), (2, "06000", "Cntro", "", None), (3, "99999", "Centro", "C", "1"), (4, None, None, "C", "1"), (5, "06000", "", "C", "1")]
    postal = spark.createDataFrame([("06000", "Centro"), ("06000", "Centro"), ("06000", "Roma"), (None, "x"), ("07000", "Cntra")], "postal_code string, area string")
    out = {r.id: (r.known_code, r.known_pair, r.suggestions, r.faults) for r in trigrams.checked_address(spark.createDataFrame(own, "id int, postal_code string, area string, road string, number string"), postal).collect()}
    assert out == {
        1: (True, True, [], []), 2: (True, False, ["Centro"], ["area of another code", "no road", "no number"]), 3: (False, False, [], ["unknown code"]),
        4: (False, False, [], ["no code", "no area"]), 5: (True, False, [], ["no area"]),
    }


def test_entities_like_longer_ones_go(spark):
    rows = [(1, "person", "Ana Ruiz Paz", 3), (1, "person", "Ana Ruiz", 40), (1, "person", "Ana Ruiz Pas", 60), (1, "date", "Ana Ruiz", 5), (2, "person", "Ana Ruiz", 1), (1, "person", "Luis Mora", 70), (1, "person", "LUIS MORA", 90)]
    found = spark.createDataFrame(rows, "page_id int, kind string, match string, position int").repartition(3)
    kept = extract.distinct_entities(found)
    assert values(kept, "page_id", "kind", "position") == [(1, "date", 5), (1, "person", 60), (1, "person", 90), (2, "person", 1)]
    assert values(extract.entity_summary(kept), "page_id", "n", "summary") == [(1, 3, "date: Ana Ruiz; person: Ana Ruiz Pas, LUIS MORA"), (2, 1, "person: Ana Ruiz")]


def test_proceedings_and_alerts_by_their_words(spark):
    texts = {1: "La ENTREVISTA y dos inspecciones; desinspección no. Oficio pendiente", 2: "no se pudo notificar, sin firma; sin firmas", 3: None, 4: "", 5: "cadena de custodia vencida. Cadenas de custodia"}
    df = spark.createDataFrame(list(texts.items()), "page_id int, text string")
    assert values(extract.worded(df, extract.ACTS), "page_id", "kind", "match") == [(1, "inspection", "inspecciones"), (1, "interview", "ENTREVISTA"), (1, "letter", "Oficio"), (5, "custody", "Cadenas de custodia"), (5, "custody", "cadena de custodia")]
    assert values(extract.alerts_in_text(df), "page_id", "alert", "n", "first") == [(1, "pending", 1, "pendiente"), (2, "missing", 1, "sin firma"), (2, "unserved", 1, "no se pudo notificar"), (5, "overdue", 1, "vencida")]


def test_lines_know_their_page(spark):
    text = "oficio antes\n** PÁGINA 3 **\nnada\nla audiencia\notra audiencia y oficio\npág. 4 oficio\n" + "x\n" * 9 + "Página: no\ninforme"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "book int, text string")
    got = extract.scanned_lines(df, around=1)
    assert values(got, "page", "line_no", "kind", "context") == [
        (None, 0, "letter", "oficio antes\n** PÁGINA 3 **"), (3, 3, "hearing", "nada\nla audiencia\notra audiencia y oficio"), (3, 4, "letter", "la audiencia\notra audiencia y oficio\npág. 4 oficio"),
        (4, 5, "letter", "otra audiencia y oficio\npág. 4 oficio\nx"), (4, 16, "report", "Página: no\ninforme"),
    ]


def test_nearest_values_in_slices_against_all_pairs(spark, monkeypatch):
    """Slices of a few queries and values give what holding each query against each value of its block gives, ties and values that share all but a trigram included."""
    from foliospark.operators import trigrams

    monkeypatch.setattr(trigrams, "QUERIES", 7)
    monkeypatch.setattr(trigrams, "VALUES", 5)
    monkeypatch.setattr(trigrams, "STEP", 2)
    monkeypatch.setattr(trigrams, "COLUMNS", 9)

    def grams(v):
        return {f"  {w} "[i : i + 3] for w in re.findall(r"\w+", v.lower()) for i in range(len(w) + 1)}

    values = [(i % 2, f"Supplier#{i * 37 % 1000:06d}") for i in range(60)] + [(0, "Ñandú \U0001f600 x"), (1, ""), (1, None), (2, "alone")]
    queries = [(i % 3, f"suplier {i * 53 % 1000:05d}") for i in range(40)] + [(0, "ñandú"), (1, ""), (0, None), (3, "no block")]
    index = trigrams.gram_index(spark.createDataFrame(values, "k int, v string"), ["k"], "v")
    got = trigrams.nearest_values(spark.createDataFrame(queries, "k int, q string"), index, ["k"], "q", 0.2, 4).collect()
    want = set()
    for k, q in set(queries):
        scored = [(-len(grams(q) & grams(v)) / len(grams(q) | grams(v)), v) for b, v in set(values) if q and b == k and v]
        want |= {(k, q, v, -s, i + 1) for i, (s, v) in enumerate(sorted(x for x in scored if -x[0] > 0.2)[:4])}
    assert {(r.k, r.query, r.value, r.similarity, r.rank) for r in got} == want and len(got) == len(want) > 100


def test_two_numbers_that_one_character_parts_are_read_as_in_sql(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    texts = ["5512345678 5598765432", "5512345678  5598765432", "x5512345678", "5512345678\n5598765432-5500000000", "55123456789", "", None, "5511111111,5511111111 5522222222"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "0L AS n_chars").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = db.execute(entry.oracle_sql()["EXT10"]).fetchall()
    assert sorted(map(tuple, entry.queries()["EXT10"](spark, str(tmp_path)).collect())) == sorted(want) and len(want) > 5


def test_phones_in_all_written_forms_as_in_sql(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    texts = {
        "Tel. 555-123-4567, cel. 555 1234568 y 555123 4569": {"5551234567", "5551234568", "5551234569"},
        "55-1234-5670 55 12345671 551234 5672": {"5512345670", "5512345671", "5512345672"},
        "+1 (838) 555-7235 (838)5557236 tel(838)-555 7237": {"8385557235", "8385557236", "8385557237"},
        "5512345678 5598765432;5512345678 55-1234-5678": {"5512345678", "5598765432"},
        "(55) 1234-5678 (838) 555-72356 5551234-567 555--123-4567 1555-123-4567 12345678 521234567890 555.123.4567": set(),
        "<555>-<123>-<4567> <5512345679> \n555\n1234567": {"5512345679"},
        "": set(),
        None: set(),
    }
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "0L AS n_chars").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(map(tuple, entry.queries()["EXT10"](spark, str(tmp_path)).collect()))
    assert got == sorted((i, x) for i, t in rows for x in texts[t]) == sorted(db.execute(entry.oracle_sql()["EXT10"]).fetchall())


def test_spans_mark_a_text_once_for_each_pattern(spark):
    """Functions of lambdas share no subexpressions, so what is named thrice there is done thrice."""
    from foliospark.operators import extract

    pages = spark.createDataFrame([(1, "a\x01b 12 und 345"), (2, None), (3, ""), (4, "7")], "page_id long, text string")
    found = extract.spans(pages, {"n": r"\d+", "w": r"[a-z]+"}, 2)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 2
    got = sorted((r.page_id, r.kind, r.match, r.position, r.context) for r in found.collect())
    assert got == [
        (1, "n", "12", 4, "b 12 u"), (1, "n", "345", 11, "d 345"), (1, "w", "a", 0, "a\x01b"), (1, "w", "b", 2, "a\x01b 1"), (1, "w", "und", 7, "2 und 3"), (4, "n", "7", 0, "7"),
    ]


def test_fuzzy_tokens_read_the_texts_once(spark):
    import random
    from collections import Counter
    from difflib import SequenceMatcher

    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("heon", k=rng.randint(3, 9))) for _ in range(400)) + " heheon HEHEONS" for _ in range(5)]
    found = search.fuzzy_tokens(spark.createDataFrame(list(enumerate(texts)), "page_id long, text string"), "Heheon", 0.7)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1
    like = lambda t: SequenceMatcher(None, t, "heheon").ratio()
    want = {(i, t, n, like(t)) for i, x in enumerate(texts) for t, n in Counter(x.lower().split()).items() if 0.7 <= like(t) < 1}
    assert {tuple(r) for r in found.collect()} == want and len(want) > 50


def test_a_catalog_in_code_does_not_move_the_rows(spark):
    few = catalog.lookup(spark, [("1-URGENT", "urgent")], "variant string, canonical string")
    joined = spark.range(1 << 22).selectExpr("id", "concat('1-URGENT', substr(string(id), 100)) AS variant").join(few, "variant")
    assert joined.count() == 1 << 22 and "SortMergeJoin" not in joined._jdf.queryExecution().sparkPlan().toString()


def test_words_are_counted_where_their_document_is(spark):
    from foliospark.plans import registry

    plan = registry.queries()["ARR2"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and "w#" not in plan.split("hashpartitioning(")[1].split(")")[0]
