"""Queries for text search, vectors, scalar functions and similarities."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions import dates as D
from foliospark.functions import similarity as S
from foliospark.functions import text as T
from foliospark.operators import access, automaton, correct, fulltext, search, vectors
from foliospark.plans import relational as R
from foliospark.plans.notes import N, notes, union
from foliospark.plans.registry import register
from foliospark.plans.relational import E, GRANTS, O, P
from foliospark.session import scratch
from foliospark.sources import sinks
from foliospark.sources.catalog import audit, load, pages, proceedings

FOLDERS = "(SELECT n_nationkey AS folder_id, n_name AS name FROM nation) f"


def folders(spark, d):
    return load(spark, d, "nation").select(F.col("n_nationkey").alias("folder_id"), F.col("n_name").alias("name"))


def _snip(term: str, around: int = 100, head: int = 200) -> str:
    n = len(term)
    at = f"strpos(lower(text), '{term}')"
    lo, hi = f"greatest({at} - 1 - {around}, 0)", f"least({at} - 1 + {n} + {around}, length(text))"
    cut = f"CASE WHEN {lo} > 0 THEN '...' ELSE '' END || substr(text, {lo} + 1, {hi} - {lo}) || CASE WHEN {hi} < length(text) THEN '...' ELSE '' END"
    return f"CASE WHEN {at} > 0 THEN {cut} ELSE substr(text, 1, {head}) || CASE WHEN length(text) > {head} THEN '...' ELSE '' END END"


@register("TXT1", f"SELECT 'title' AS kind, folder_id::VARCHAR AS ref, name AS shown, 1.0::DOUBLE AS relevance FROM {FOLDERS} WHERE contains(lower(name), 'an') UNION ALL SELECT 'body', page_id::VARCHAR, {_snip('an')}, 0.8 FROM {P} WHERE contains(lower(text), 'an')")
def txt1(spark, d):
    return search.titles_and_bodies(folders(spark, d), pages(spark, d), "an")


@register("TXT2", f"SELECT page_id, round(0.5 + 0.3 * (contains(lower(text), 'the')::INT + contains(lower(text), 'que')::INT) / 2 + 0.2 * confidence / 100, 6)::DOUBLE AS relevance FROM {P}")
def txt2(spark, d):
    return pages(spark, d).select("page_id", F.round(search.relevance("text", ["the", "que"], "confidence"), 6).alias("relevance"))


@register("TXT3", f"SELECT page_id, {_snip('con')} AS snippet FROM {P}")
def txt3(spark, d):
    return pages(spark, d).select("page_id", T.snippet("text", "con").alias("snippet"))


def _hits(term: str, where: str = "true") -> str:
    n = len(term)
    return f"SELECT page_id, folder, '{term}' AS term, i AS position FROM (SELECT page_id, folder, lower(text) AS t, unnest(range(0, length(text) - {n} + 1)) AS i FROM {P} WHERE contains(lower(text), '{term}') AND {where}) WHERE substr(t, i + 1, {n}) = '{term}'"


@register("TXT4", _hits("llll"))
def txt4(spark, d):
    return search.hits(pages(spark, d), "llll").select("page_id", "folder", "term", F.col("position").cast("long"))


@register("SNK4_hits", f"SELECT page_id::VARCHAR AS page_id, folder, term, position::VARCHAR AS position FROM ({_hits('llll')})")
def snk4_hits(spark, d):
    """The hits of a search as a file."""
    return sinks.exported(sinks.export_rows(txt4(spark, d)), scratch(spark, "export") + "/csv")


@register("TXT5", _hits("tion", "folder = 'src3' AND confidence >= 50"))
def txt5(spark, d):
    return search.hits(pages(spark, d).where("folder = 'src3' AND confidence >= 50"), "tion").select("page_id", "folder", "term", F.col("position").cast("long"))


@register("TXT6", f"SELECT folder, count(*) AS n_hits, count(DISTINCT page_id) AS n_pages FROM ({_hits('heit')}) GROUP BY folder")
def txt6(spark, d):
    return search.hits(pages(spark, d), "heit").groupBy("folder").agg(F.count("*").alias("n_hits"), F.countDistinct("page_id").alias("n_pages"))


@register("TXT7", f"SELECT coalesce(strftime(make_date(2020, 1 + (page_id % 12)::INT, 1), '%Y-%m'), 'undated') AS month, folder, count(*) AS n FROM {P} WHERE contains(lower(text), 'the') GROUP BY ALL")
def txt7(spark, d):
    month = F.coalesce(F.date_format(F.make_date(F.lit(2020), (1 + F.col("page_id") % 12).cast("int"), F.lit(1)), "yyyy-MM"), F.lit("undated"))
    return pages(spark, d).where(T.contains_ci("text", "the")).groupBy(month.alias("month"), "folder").agg(F.count("*").alias("n"))


_MATCH = "contains(lower(text), 'shing') AND contains(lower(text), 'blewh') AND NOT contains(lower(text), 'idiot')"


@register("TXT8", f"{_hits('shing', _MATCH)} UNION ALL {_hits('blewh', _MATCH)}")
def txt8(spark, d):
    return search.boolean_search(pages(spark, d), ["shing", "blewh"], "AND", without=("idiot",)).select("page_id", "folder", "term", F.col("position").cast("long"))


@register("TXT9", f"SELECT folder, page_id FROM (SELECT folder, page_id, row_number() OVER (PARTITION BY folder ORDER BY page_id) AS k FROM {P} WHERE contains(lower(text), 'the')) WHERE k <= 5")
def txt9(spark, d):
    return search.first_per_group(pages(spark, d).where(T.contains_ci("text", "the")), 5, ["folder"], F.col("page_id")).select("folder", "page_id")


@register("TXT10", f"SELECT page_id, i AS position, CASE WHEN i > 50 THEN '...' ELSE '' END || substr(text, greatest(i - 50, 0) + 1, i - greatest(i - 50, 0)) || '**the**' || substr(text, i + 4, 50) || CASE WHEN i + 53 < length(text) THEN '...' ELSE '' END AS shown FROM (SELECT page_id, text, unnest(range(0, length(text) - 2)) AS i FROM {P} WHERE contains(lower(text), 'the')) WHERE substr(lower(text), i + 1, 3) = 'the'")
def txt10(spark, d):
    return search.highlights(pages(spark, d), "the").select("page_id", F.col("position").cast("long"), "shown")


@register("TXT11", f"SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(string_split_regex(text, '[^\\p{{L}}\\p{{N}}_]+')) AS w FROM {P}) WHERE w = 'The' GROUP BY page_id")
def txt11(spark, d):
    """Whole words, their case kept."""
    return search.advanced(pages(spark, d), "The", whole_word=True, match_case=True).groupBy("page_id").agg(F.count("*").alias("n"))


@register("TXT11_fuzzy")
def txt11_fuzzy(spark, d):
    return search.fuzzy_tokens(pages(spark, d), "heheon", 0.8)


@register("TXT12", f"SELECT page_id, {_snip('ver')} AS snippet FROM {P} WHERE contains(lower(text), 'ver') AND page_id BETWEEN 1 AND 800 AND folder IN (SELECT 'src' || folder_id FROM {GRANTS} WHERE user_id = 1 AND can_search)")
def txt12(spark, d):
    mine = R.grants(spark, d).withColumn("folder", F.concat(F.lit("src"), F.col("folder_id").cast("string")))
    seen = access.visible(pages(spark, d), mine, 1, "folder", flag="can_search")
    return seen.where(T.contains_ci("text", "ver") & F.col("page_id").between(1, 800)).select("page_id", T.snippet("text", "ver").alias("snippet"))


@register("TXT13", f"SELECT page_id FROM {P} WHERE text ILIKE '%une%' OR folder ILIKE '%une%' ORDER BY page_id DESC LIMIT 50")
def txt13(spark, d):
    return search.top(pages(spark, d).where(T.any_of([T.like_ci(c, "une") for c in ("text", "folder")])).select("page_id"), 50, F.col("page_id").desc())


_INDEXES: dict[tuple, fulltext.Index] = {}


def page_index(spark, d: str, analyser: fulltext.Analyser = fulltext.Analyser()) -> fulltext.Index:
    """The index of the pages of d, built when it is first asked for in a session."""
    at = (spark.sparkContext.applicationId, d, analyser)
    if at not in _INDEXES:
        _INDEXES[at] = fulltext.build(pages(spark, d), analyser)
    return _INDEXES[at]


@register("TXT14", f"""WITH i AS (SELECT token, page_id, count(*) AS tf FROM {R._TOK} WHERE token IN ('shing', 'onthe', 'que') GROUP BY ALL), f AS (SELECT token, count(*) AS df FROM i GROUP BY token)
    SELECT page_id, round(sum(tf * ln(((SELECT count(*) FROM documents) + 1) / (df + 1))), 6) AS score, count(*) AS matched FROM i JOIN f USING (token) GROUP BY page_id ORDER BY score DESC, page_id LIMIT 20""")
def txt14(spark, d):
    return fulltext.search(page_index(spark, d), "shing onthe que").select("page_id", "score", "matched")


_NEAR = """(SELECT token, max(1 - levenshtein(term, token) / length(term)) AS weight FROM (SELECT DISTINCT token FROM {tokens}), (VALUES ('lucense'), ('idoit'), ('of')) q(term)
    WHERE levenshtein(term, token) <= CASE WHEN length(term) < 3 THEN 0 WHEN length(term) < 6 THEN 1 ELSE 2 END GROUP BY token)"""


@register("TXT14_fuzzy", f"""WITH t AS (SELECT token, page_id, count(*) AS tf FROM {R._TOK} WHERE token <> '' GROUP BY ALL), i AS (SELECT * FROM t JOIN {_NEAR.format(tokens='t')} USING (token)), f AS (SELECT token, count(*) AS df FROM i GROUP BY token)
    SELECT page_id, round(sum(tf * ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) * weight), 6) AS score, count(*) AS matched FROM i JOIN f USING (token) GROUP BY page_id ORDER BY score DESC, page_id LIMIT 20""")
def txt14_fuzzy(spark, d):
    """Words within the edits that their length allows; TXT14_highlights shows where."""
    return fulltext.search(page_index(spark, d), "lucense idoit of", fuzzy=True).select("page_id", "score", "matched")


@register("TXT14_highlights", f"""WITH i AS (SELECT token, page_id, count(*) AS tf FROM {R._TOK} WHERE token IN ('idiot', 'clown') GROUP BY ALL), f AS (SELECT token, count(*) AS df FROM i GROUP BY token),
    b AS (SELECT page_id, round(sum(tf * ln(((SELECT count(*) FROM documents) + 1) / (df + 1))), 6) AS score FROM i JOIN f USING (token) GROUP BY page_id ORDER BY score DESC, page_id LIMIT 20),
    m AS (SELECT page_id, score, text, ' ' || translate(lower(text), 'áéíóúàèìòùäëïöüâêîôûñç', 'aeiouaeiouaeiouaeiounc') || ' ' AS t FROM b JOIN {P} USING (page_id))
    SELECT page_id, score, substr(text, greatest(length(regexp_extract(t, '(?s)^(.*?[^\\p{{L}}\\p{{N}}])(?:idiot|clown)[^\\p{{L}}\\p{{N}}]', 1)) - 76, 0) + 1, 150) AS highlight FROM m""")
def txt14_highlights(spark, d):
    """The first highlight of each of the best pages."""
    found = fulltext.search(page_index(spark, d), "Idiot, clown!")
    shown = fulltext.highlighted(found, pages(spark, d))
    return shown.select("page_id", "score", F.get("highlights", F.lit(0)).alias("highlight"))


STOP = ("the", "and", "of", "to", "que", "de", "la", "der", "die", "und")


@register("TXT15", f"SELECT token, count(*) AS df, sum(tf)::BIGINT AS cf FROM (SELECT regexp_replace(token, '{fulltext.STEM}', '\\1') AS token, page_id, count(*) AS tf FROM {R._TOK} WHERE token <> '' AND token NOT IN {STOP} GROUP BY ALL) GROUP BY token")
def txt15(spark, d):
    """The terms of the index of analysed words: lower-cased, folded, stemmed, without stop words."""
    return page_index(spark, d, fulltext.Analyser(STOP, True)).table("terms").select("token", "df", "cf")


@register("TXT16", f"SELECT word, count(*) AS count FROM (SELECT unnest(string_split_regex(lower(text), '[^\\p{{L}}]+')) AS word FROM {P}) WHERE starts_with(word, 'sh') AND length(word) >= 3 GROUP BY word ORDER BY 2 DESC, 1 LIMIT 10")
def txt16(spark, d):
    return search.completions(pages(spark, d), "sh")


@register("TXT17", f"SELECT name FROM {FOLDERS} WHERE name ILIKE '%1%' ORDER BY name LIMIT 10")
def txt17(spark, d):
    return search.top(folders(spark, d).where(T.like_ci("name", "1")).select("name"), 10, F.col("name"))


@register("TXT18", f"SELECT token, sum(n)::BIGINT AS n FROM (SELECT token, count(*) AS n FROM {R._TOK} WHERE length(token) >= 4 GROUP BY token) GROUP BY token ORDER BY 2 DESC, 1 LIMIT 25")
def txt18(spark, d):
    words = fulltext.postings(pages(spark, d)).where(F.length("token") >= 4).groupBy("token").agg(F.sum("tf").alias("n"))
    return search.top(words, 25, F.col("n").desc(), F.col("token"))


@register("TXT19")
def txt19(spark, d):
    return search.categorised(pages(spark, d), {"digits": "[0-9]{4,}", "capitals": "[A-Z]{5,}"})


@register("TXT20", f"SELECT page_id, regexp_extract(text, '([0-9]{{5}})', 1) AS five, CASE WHEN contains(text, '@') THEN 'mail' WHEN regexp_matches(text, '[0-9]{{10}}') THEN 'phone' ELSE 'none' END AS contact FROM {P}")
def txt20(spark, d):
    return pages(spark, d).select("page_id", F.regexp_extract("text", "([0-9]{5})", 1).alias("five"), F.when(F.col("text").contains("@"), "mail").when(F.col("text").rlike("[0-9]{10}"), "phone").otherwise("none").alias("contact"))


@register("TXT21", f"SELECT page_id, len(regexp_extract_all(lower(text), 'ing'))::BIGINT AS n, strpos(lower(text), 'ing') - 1 AS first_at FROM {P}")
def txt21(spark, d):
    return pages(spark, d).select("page_id", T.count_hits("text", "ing").cast("long").alias("n"), (F.locate("ing", F.lower("text")) - 1).cast("long").alias("first_at"))


@register("TXT22", f"SELECT engine, count(*) AS n, round(avg(confidence), 2) AS mean, sum(length(text))::BIGINT AS chars FROM {P} GROUP BY engine")
def txt22(spark, d):
    return pages(spark, d).groupBy("engine").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 2).alias("mean"), F.sum(F.length("text")).alias("chars"))


@register("TXT23", f"SELECT user_id, ts, props FROM {E} WHERE action = 'view' AND user_id = 7 ORDER BY ts DESC, id LIMIT 20")
def txt23(spark, d):
    return search.top(audit(spark, d).where("action = 'view' AND user_id = 7"), 20, F.col("ts").desc(), F.col("id")).select("user_id", "ts", "props")


# vectors


@register("VEC1")
def vec1(spark, d):
    return vectors.embedded(pages(spark, d), vectors.hashing_embedder(16))


@register("VEC2", f"SELECT page_id, CASE WHEN length(c) > 1000 THEN substr(c, 1, 1000) || '...' ELSE c END AS cleaned FROM (SELECT page_id, trim(regexp_replace(regexp_replace(text, '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS c FROM {P})")
def vec2(spark, d):
    return pages(spark, d).select("page_id", vectors.cleaned("text").alias("cleaned"))


@register("VEC3", f"SELECT vec_id, round({R._COS}, 6) AS similarity FROM embeddings")
def vec3(spark, d):
    return vectors.similar(load(spark, d, "embeddings"), R._Q64, -1.0, None)


@register("VEC4", f"SELECT vec_id, s AS similarity FROM (SELECT vec_id, round({R._COS}, 6) AS s FROM embeddings JOIN documents ON doc_id = vec_id WHERE source IN (SELECT 'src' || folder_id FROM {GRANTS} WHERE user_id % 10 = 1 AND can_search)) WHERE s >= 0.05 ORDER BY s DESC, vec_id LIMIT 20")
def vec4(spark, d):
    """Over the pages that the user may search."""
    mine = R.grants(spark, d).withColumns({"folder": F.concat(F.lit("src"), F.col("folder_id").cast("string")), "user_id": F.col("user_id") % 10})
    seen = access.visible(pages(spark, d).select(F.col("page_id").alias("vec_id"), "folder"), mine, 1, "folder", flag="can_search")
    return vectors.similar(load(spark, d, "embeddings").join(seen.select("vec_id"), "vec_id", "left_semi"), R._Q64, 0.05, 20)


@register("VEC5", f"SELECT page_id, CASE WHEN a IS NULL THEN substr(text, 1, 200) ELSE substr(text, greatest(a - 100, 1), 200) END AS snippet FROM (SELECT page_id, text, list_min(list_filter([strpos(lower(text), 'heit'), strpos(lower(text), 'ción')], lambda x: x > 0)) AS a FROM {P})")
def vec5(spark, d):
    return pages(spark, d).select("page_id", vectors.query_snippet("text", ["heit", "ción"]).alias("snippet"))


@register("VEC6", f"SELECT vec_id, (round({R._COS}, 6) >= 0.02)::INT + (round(-{R._COS}, 6) >= 0.02)::INT AS n_concepts FROM embeddings WHERE abs(round({R._COS}, 6)) >= 0.02")
def vec6(spark, d):
    return vectors.concepts(load(spark, d, "embeddings"), {"plus": R._Q64, "minus": [-x for x in R._Q64]}, 0.02).select("vec_id", "n_concepts")


@register("VEC7", "SELECT doc_id AS vec_id, 16 AS size FROM documents WHERE length(text) >= 10 AND doc_id NOT IN (SELECT vec_id FROM embeddings)")
def vec7(spark, d):
    """What has no vector yet is embedded."""
    texts = load(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text").where(F.length("text") >= 10)
    new = vectors.missing_embeddings(texts, load(spark, d, "embeddings"), "vec_id")
    return vectors.embedded(new, vectors.hashing_embedder(16), "vec_id", least=1).select("vec_id", F.size("embedding").alias("size"))


@register("VEC8", "SELECT source AS folder, count(v.vec_id) AS covered, count(*) AS n FROM documents d LEFT JOIN embeddings v ON d.doc_id = v.vec_id GROUP BY source")
def vec8(spark, d):
    v = load(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("y"))
    return load(spark, d, "documents", "doc_id", "source").join(v, "doc_id", "left").groupBy(F.col("source").alias("folder")).agg(F.count("y").alias("covered"), F.count("*").alias("n"))


_NEAR = f"(SELECT vec_id AS page_id, round({R._COS}, 6) AS similarity FROM embeddings WHERE round({R._COS}, 6) >= 0.3)"


@register("VEC9", f"SELECT page_id, 'vector' AS mode, similarity FROM {_NEAR} UNION ALL SELECT page_id, 'substring', 0.8::DOUBLE FROM {P} WHERE contains(lower(text), 'eaux') AND page_id NOT IN (SELECT page_id FROM {_NEAR})")
def vec9(spark, d):
    """Pages near the query by their vectors; of the others those that have its word, at 0.8."""
    near = vectors.similar(load(spark, d, "embeddings").withColumnRenamed("vec_id", "page_id"), R._Q64, 0.3, None, "page_id")
    return vectors.with_fallback(near, pages(spark, d), "eaux")


# scalar functions


def _each(key: str, sql: str | None, *columns) -> None:
    @register(key, f"SELECT page_id, {sql} FROM {P}" if sql else None)
    def query(spark, d):
        return pages(spark, d).select("page_id", *[c() for c in columns])


_each("STR1", "upper(folder) AS up, lower(folder) AS low", lambda: F.upper("folder").alias("up"), lambda: F.lower("folder").alias("low"))
_each("STR2", "trim(regexp_replace(text, '\\s+', ' ', 'g')) AS squeezed", lambda: T.squeeze("text").alias("squeezed"))
_each("STR3", "CASE WHEN length(text) > 60 THEN rtrim(substr(text, 1, 57)) || '...' ELSE text END AS cut", lambda: T.ellipsis("text", 60).alias("cut"))
_each("STR4", None, lambda: T.first_sentence("text").alias("sentence"))
_each("STR5", "translate(text, 'áéíóúàèìòùäëïöüâêîôûñçÁÉÍÓÚÀÈÌÒÙÄËÏÖÜÂÊÎÔÛÑÇ', 'aeiouaeiouaeiouaeiouncAEIOUAEIOUAEIOUAEIOUNC') AS folded", lambda: T.fold("text").alias("folded"))
_each("STR6", "translate(text, '015', 'ols') AS letters", lambda: F.translate("text", "015", "ols").alias("letters"))
_each("STR7", "regexp_extract(text, '([A-Z][a-z]+)', 1) AS first_word, len(regexp_extract_all(text, '[A-Z][a-z]+'))::BIGINT AS n", lambda: F.regexp_extract("text", "([A-Z][a-z]+)", 1).alias("first_word"), lambda: F.regexp_count("text", F.lit("[A-Z][a-z]+")).cast("long").alias("n"))
_each("STR8", "regexp_replace(text, '([a-z]+)ing', '<\\1>', 'g') AS marked", lambda: F.regexp_replace("text", "([a-z]+)ing", "<$1>").alias("marked"))
_each("STR9", "regexp_replace(regexp_replace(text, '(\\p{L})-\\n(\\p{L})', '\\1\\2', 'g'), '\\n{3,}', chr(10) || chr(10), 'g') AS joined", lambda: T.unhyphenated("text").alias("joined"))
_each("STR10", "len(string_split(text, chr(10)))::BIGINT AS n_lines, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))::BIGINT AS n_words", lambda: F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"), lambda: T.word_count("text").cast("long").alias("n_words"))
_each("STR11", "round(length(regexp_replace(text, '[^\\p{L}]', '', 'g')) / length(text), 6) AS letters, regexp_matches(text, '[bcdfghjklm]{4,}') AS run", lambda: F.round(T.char_share("text", r"\p{L}"), 6).alias("letters"), lambda: F.col("text").rlike("[bcdfghjklm]{4,}").alias("run"))
_each("STR12", "length(text)::BIGINT AS n_chars", lambda: F.length("text").cast("long").alias("n_chars"))
_each("STR13", "len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) / length(text) < 0.05 AS sparse", lambda: (T.word_count("text") / F.length("text") < 0.05).alias("sparse"))
_each("STR14", None, lambda: T.changed_words("text", F.regexp_replace("text", "ing ", "in ")).alias("changed"))
_each("STR15", "md5(text) AS md5, sha256(text) AS sha", lambda: F.md5("text").alias("md5"), lambda: F.sha2("text", 256).alias("sha"))
_each("STR16", "regexp_replace(regexp_replace(text, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+', '') AS file_name", lambda: T.safe_name("text").alias("file_name"))
_each("STR18", "folder || ' / ' || engine || ': ' || (confidence::BIGINT) AS title", lambda: F.format_string("%s / %s: %d", F.col("folder"), F.col("engine"), F.col("confidence").cast("long")).alias("title"))
_each("STR20", None, lambda: T.masked_number("text").alias("masked"), lambda: T.initials(F.col("text")).alias("initials"))


_DAYS = "['uno', 'Quince', 'treinta y uno', 'cien', 'Veintidós']"


@register("STR17", f"SELECT c_custkey, list_extract([1, 15, 31, NULL, 22], (c_custkey % 5 + 1)::INT) AS day, 1900 + (c_custkey % 10) AS year FROM customer")
def str17(spark, d):
    c = load(spark, d, "customer", "c_custkey")
    word = F.element_at(F.array(*[F.lit(x) for x in ("uno", "Quince", "treinta y uno", "cien", "Veintidós")]), (F.col("c_custkey") % 5).cast("int") + 1)
    ones = F.element_at(F.array(*[F.lit(x) for x in ("", *(f" y {n}" for n in D.DAYS[:9]))]), (F.col("c_custkey") % 10).cast("int") + 1)
    year = D.written_year(F.concat(F.lit("mil novecientos"), F.regexp_replace(ones, " y ", " ")))
    return c.select("c_custkey", D.written_day(word).alias("day"), year.cast("long").alias("year"))


@register("STR19", "SELECT id, list_extract(['Edge (Windows)', 'Firefox (Linux)', 'Safari (macOS)', 'Chrome (Android)', '-'], (user_id % 5 + 1)::INT) AS label FROM " + E)
def str19(spark, d):
    agents = ("Mozilla (Windows NT) Chrome/1 Edg/1", "Mozilla (X11; Linux) Firefox/9", "Mozilla (Macintosh) Safari/6", "Mozilla (Linux; Android 9) Chrome/1 Safari/5", None)
    agent = F.element_at(F.array(*[F.lit(a).cast("string") for a in agents]), (F.col("user_id") % 5).cast("int") + 1)
    return audit(spark, d).select("id", T.browser_label(agent).alias("label"))


@register("DT1", union(("k IN (0, 1, 2)", "page_id", "day"), names="page_id, day"))
def dt1(spark, d):
    return notes(spark, d).select("page_id", D.full_date("text").alias("day")).where("day IS NOT NULL")


@register("DT2", union(("k IN (6, 8)", "page_id", "date_trunc('month', day)::DATE"), ("k = 7", "page_id", "day"), names="page_id, day"))
def dt2(spark, d):
    return notes(spark, d).select("page_id", D.partial_date("text").alias("day")).where("day IS NOT NULL")


_ONES = "['uno', 'dos', 'tres', 'cuatro', 'cinco', 'seis', 'siete', 'ocho', 'nueve']"


@register("DT3", "SELECT o_orderkey AS id, o_orderdate::DATE AS day FROM orders")
def dt3(spark, d):
    """Days in words out of dates, read back."""
    day = F.col("day")
    pick = lambda words, at: F.element_at(F.array(*[F.lit(w) for w in words]), at.cast("int"))
    ones = pick(D.DAYS[:9], F.greatest(F.year(day) % 10, F.lit(1)))
    year = F.when(F.year(day) < 2000, F.concat(F.lit("mil novecientos noventa y "), ones)).when(F.year(day) == 2000, "dos mil").otherwise(F.concat(F.lit("dos mil "), ones))
    text = F.concat_ws(" de ", pick(D.DAYS, F.dayofmonth(day)), pick(D.MONTHS, F.month(day)), year)
    return proceedings(spark, d).select("id", D.written_date(text).alias("day"))


@register("DT4", f"SELECT id, DATE '2001-08-01' - day AS age FROM {O}")
def dt4(spark, d):
    return proceedings(spark, d).select("id", F.datediff(F.lit("2001-08-01").cast("date"), "day").alias("age"))


@register("DT5", f"SELECT id, day FROM {O}")
def dt5(spark, d):
    """Days whose year was read wrong, repaired: before 2000 seen 70 too early by every other one, from 2000 with an 8 for the 0."""
    day = F.col("day")
    read = F.when(F.year(day) >= 2000, F.add_months(day, 12 * 800)).otherwise(day)
    return proceedings(spark, d).select("id", D.repaired_year(read).alias("day"))


@register("DT6", f"SELECT id, list_extract({list(D.MONTHS)}, month(day)::INT) AS month FROM {O}")
def dt6(spark, d):
    """Names of months with a letter lost or doubled, snapped back; distinct words are scored once."""
    month = F.element_at(F.array(*[F.lit(m) for m in D.MONTHS]), F.month("day"))
    rows = proceedings(spark, d).select("id", F.when(F.col("id") % 2 == 0, F.concat(month, F.right(month, F.lit(1)))).otherwise(F.concat(F.left(month, F.lit(1)), F.substring(month, 3, 20))).alias("token"))
    words = spark.createDataFrame([(m,) for m in D.MONTHS], "word string")
    best = correct.scored(rows.select("token").distinct(), words, 0.78, 4).groupBy("token").agg(F.max_by("word", "similarity").alias("month"))
    return rows.join(best, "token").select("id", "month")


@register("DT7", f"SELECT id, strftime(day, '%d/%m/%Y') AS shown FROM {O}")
def dt7(spark, d):
    return proceedings(spark, d).select("id", F.date_format("day", "dd/MM/yyyy").alias("shown"))


@register("DT8", f"SELECT page_id, CASE k WHEN 0 THEN 'statement' WHEN 1 THEN 'hearing' ELSE 'general' END AS class FROM {N}")
def dt8(spark, d):
    return notes(spark, d).select("page_id", D.date_class("text").alias("class"))


@register("MTH1", f"SELECT id, greatest(least(amount, 200000), 1000) AS clamped, round_even(amount, 0) AS even, ((id + 9) // 10)::BIGINT AS tens FROM {O}")
def mth1(spark, d):
    return proceedings(spark, d).select("id", F.greatest(F.least("amount", F.lit(200000.0)), F.lit(1000.0)).alias("clamped"), F.bround("amount", 0).alias("even"), F.floor((F.col("id") + 9) / 10).alias("tens"))


@register("MTH2", f"SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], {R._Q64}::DOUBLE[]), 5) AS dot, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm FROM embeddings")
def mth2(spark, d):
    q = F.array(*[F.lit(x) for x in R._Q64])
    return load(spark, d, "embeddings").select("vec_id", F.round(S.dot("embedding", q), 5).alias("dot"), F.round(S.norm("embedding"), 5).alias("norm"))


@register("ARR1", "SELECT vec_id, list_contains(list_transform(embedding, lambda x: x > 0.3), true) AS any_high, len(list_filter(embedding, lambda x: x > 0))::BIGINT AS positive FROM embeddings")
def arr1(spark, d):
    return load(spark, d, "embeddings").select("vec_id", F.exists("embedding", lambda x: x > F.lit(0.3).cast("float")).alias("any_high"), F.size(F.filter("embedding", lambda x: x > 0)).cast("long").alias("positive"))


@register("ARR2", "SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY ALL")
def arr2(spark, d):
    """Texts are dealt by document before they are split, so that words are counted where they are."""
    dealt = load(spark, d, "documents", "doc_id", "text").repartition("doc_id")
    return dealt.select("doc_id", F.explode(F.split("text", " ")).alias("w")).groupBy("doc_id", "w").agg(F.count("*").alias("n"))


@register("MAP1", f"SELECT user_id, count_if(action = 'click')::BIGINT AS clicks, count_if(action = 'view')::BIGINT AS views FROM {E} GROUP BY user_id")
def map1(spark, d):
    counts = audit(spark, d).groupBy("user_id", "action").count().groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("action", "count"))).alias("m"))
    return counts.select("user_id", *[F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(0)).alias(f"{k}s") for k in ("click", "view")])


@register("MAP2", f"SELECT id, '***' AS password, action AS name, (props->>'$.k') AS k FROM {E}")
def map2(spark, d):
    m = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("Password"), F.col("user_id").cast("string"), F.lit("name"), F.col("action")))
    masked = T.masked_keys(m)
    return audit(spark, d).select("id", masked["Password"].alias("password"), masked["name"].alias("name"), F.try_element_at(masked, F.lit("k")).alias("k"))


@register("JSN1", f"SELECT id, coalesce((props->>'$.k')::BIGINT, -1) AS k, props = '{{}}' AS empty FROM {E}")
def jsn1(spark, d):
    return audit(spark, d).select("id", F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(-1)).alias("k"), (F.col("props") == "{}").alias("empty"))


@register("JSN2", f"SELECT id, (props->>'$.k')::BIGINT AS k, true AS ignored FROM {E}")
def jsn2(spark, d):
    flagged = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("ignored"), F.lit("true")))
    return audit(spark, d).select("id", flagged["k"].cast("long").alias("k"), (flagged["ignored"] == "true").alias("ignored"))


# similarities


@register("SIM1")
def sim1(spark, d):
    n = load(spark, d, "nation", "n_name")
    return n.select(F.col("n_name").alias("a"), S.ratio(F.col("n_name"), F.reverse("n_name")).alias("ratio"))


@register("SIM2", "SELECT n_name AS a, round(jaro_winkler_similarity(n_name, upper(r_name)), 6) AS s FROM nation JOIN region ON n_regionkey = r_regionkey")
def sim2(spark, d):
    j = load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select(F.col("n_name").alias("a"), F.round(S.jaro_winkler(F.col("n_name"), F.upper("r_name")), 6).alias("s"))


_TRI = "list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@register("SIM3", f"SELECT p_partkey, round(len(list_intersect({_TRI.format('p_name')}, {_TRI.format('p_type')})) / greatest(len(list_distinct(list_concat({_TRI.format('p_name')}, {_TRI.format('p_type')}))), 1), 6) AS s FROM part")
def sim3(spark, d):
    return load(spark, d, "part").select("p_partkey", F.round(S.trigram_similarity("p_name", "p_type"), 6).alias("s"))


WORDS = ["economist", "standards", "polishes", "anodised", "burnish"]


def _types(spark, d):
    return load(spark, d, "part", "p_type")


@register("SIM4")
def sim4(spark, d):
    return correct.close_words(_types(spark, d), "p_type", WORDS)


@register("SIM5")
def sim5(spark, d):
    return correct.words_corrected(load(spark, d, "part", "p_partkey", "p_type"), "p_partkey", "p_type", WORDS, 0.75)


@register("SIM6")
def sim6(spark, d):
    return correct.snapped_variants(_types(spark, d), "p_type", {"economist": "cheap", "economy": "cheap", "standards": "usual", "promos": "offer"}, 0.75)


@register("SIM8")
def sim8(spark, d):
    """The nearest name from 0.8 on."""
    return correct.snapped(_types(spark, d), "p_type", WORDS, 0.8)


@register("SIM7", "SELECT token, arg_min(word, length(word)) AS word FROM (SELECT DISTINCT unnest(string_split_regex(lower(p_type), '[^\\p{L}]+')) AS token FROM part) JOIN (VALUES ('standards'), ('economysize'), ('promotional')) w(word) ON starts_with(word, token) AND length(token) >= 4 AND length(word) - length(token) BETWEEN 1 AND 4 GROUP BY token")
def sim7(spark, d):
    return correct.completed(load(spark, d, "part", "p_type"), "p_type", ["standards", "economysize", "promotional"])


@register("SIM9", "SELECT n_name, r_name FROM nation JOIN region ON contains(lower(n_name), lower(r_name)) OR contains(lower(r_name), lower(n_name)) OR n_regionkey = r_regionkey")
def sim9(spark, d):
    return automaton.either_contains(load(spark, d, "nation"), load(spark, d, "region"), "n_name", "r_name", ("n_regionkey", "r_regionkey")).select("n_name", "r_name")
