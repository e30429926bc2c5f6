"""Validation and classification as ordered rules: the first that fits names the reason or the class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import text as T

STOP_NAMES = ("calle", "colonia", "juzgado", "ministerio", "expediente")
TABLES = {"people": ["nombre", "edad", "domicilio"], "proceedings": ["fecha", "diligencia", "oficio"], "evidence": ["indicio", "cadena", "custodia"]}
COVER = ("expediente", "tomo", "carpeta", "fiscalía", "carátula")


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds; null when none does."""
    return F.coalesce(*[F.when(c, n) for n, c in rules])


def name_fault(c: Column | str, known: tuple[str, ...] = ()) -> Column:
    """Why a value is no name of a person; null for a name. Words in known vouch for a value."""
    c = T.col(c)
    t = F.trim(c)
    words = T.tokens(t)
    vouched = F.exists(words, lambda w: F.lower(w).isin(*known)) if known else F.lit(False)
    return first_reason([
        ("empty", c.isNull() | (t == "")), ("short", F.length(t) < 5), ("long", F.length(t) > 80), ("digits", t.rlike(r"\d")),
        ("one word", F.size(words) < 2), ("many words", F.size(words) > 6), ("no name word", F.exists(words, lambda w: F.lower(w).isin(*STOP_NAMES))),
        ("symbols", t.rlike(r"[^\p{L}\s.'-]")), ("no vowels", ~vouched & ~F.lower(T.fold(t)).rlike("[aeiou]")),
        ("consonants", ~vouched & F.lower(T.fold(t)).rlike("[bcdfghjklmnpqrstvwxyz]{5,}")), ("lower case", ~vouched & ~t.rlike(r"^\p{Lu}")),
    ])


def officer_fault(c: str) -> Column:
    """Why a value names nobody in charge; titles do not count as names."""
    title = r"(?iu)^(?:lic\.|licenciad[oa]|agente|mtr[oa]\.)\s*"
    rest = F.trim(F.regexp_replace(F.trim(F.col(c)), title, ""))
    return first_reason([
        ("empty", F.col(c).isNull() | (F.trim(c) == "")), ("title alone", rest == ""), ("short", F.length(rest) < 5), ("digits", rest.rlike(r"\d")), ("symbols", rest.rlike(r"[^\p{L}\s.'-]")),
    ])


def place_fault(c: str) -> Column:
    t = F.trim(F.col(c))
    return first_reason([("empty", F.col(c).isNull() | (t == "")), ("short", F.length(t) < 6), ("no letters", ~t.rlike(r"\p{L}{3,}")), ("symbols", T.char_share(t, r"\p{L}\p{N}\s") < 0.7), ("no name", t.rlike(r"^\d+$"))])


def proceeding_fault(kind: str, day: str, officer: str) -> Column:
    return first_reason([("no kind", F.col(kind).isNull() | (F.trim(kind) == "")), ("no day", F.col(day).isNull()), ("no officer", F.col(officer).isNull() | (F.length(F.trim(officer)) < 5))])


def split_by(df: DataFrame, fault: Column) -> tuple[DataFrame, DataFrame]:
    """The valid rows, and the rejected ones with their reason."""
    marked = df.withColumn("reason", fault)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def keyword_class(text: str, classes: dict[str, list[str]] = TABLES, least: float = 0.3) -> Column:
    """The class with the largest share of its keywords in the text (ties: the later name), if over least."""
    share = lambda ws: sum((T.contains_ci(text, w).cast("int") for w in ws), F.lit(0)) / len(ws)
    best = F.array_max(F.array(*[F.struct(share(ws).alias("share"), F.lit(c).alias("name")) for c, ws in classes.items()]))
    return F.when(best["share"] > least, best["name"]).otherwise("other")


def person_or_area(c: str, names: tuple[str, ...], areas: tuple[str, ...]) -> list[Column]:
    """verdict, certainty (0 to 100) and evidence of a value: points for name words against points for places."""
    words = T.tokens(F.lower(F.trim(c)))
    known = F.size(F.filter(words, lambda w: w.isin(*names)))
    tests = [
        ("in areas", F.lower(F.trim(c)).isin(*areas), -50), ("one name word", known == 1, 15), ("name words", known >= 2, 25),
        ("area word", F.col(c).rlike(r"(?iu)\b(colonia|barrio|unidad)\b"), -20), ("two to five words", F.size(words).between(2, 5), 10), ("digits", F.col(c).rlike(r"\d"), -20),
    ]
    points = sum((F.when(t, p).otherwise(0) for _, t, p in tests), F.lit(0))
    evidence = F.array_join(F.array_compact(F.array(*[F.when(t, n) for n, t, _ in tests])), ", ")
    return [F.when(points > 0, "person").when(points < 0, "area").otherwise("unknown").alias("verdict"), F.least(F.abs(points) / 50.0 * 100, F.lit(100.0)).alias("certainty"), evidence.alias("evidence")]


def cover_reason(text: str) -> Column:
    """Why a page is a cover or blank; null for a page of content."""
    t = F.coalesce(F.trim(text), F.lit(""))
    n = T.word_count(t)
    hits = sum((T.contains_ci(t, k).cast("int") for k in COVER), F.lit(0))
    return first_reason([("empty", t == ""), ("page number", t.rlike(r"^(?iu)(p[áa]gina\s*)?\d{1,4}$")), ("keywords", (hits >= 2) & (n <= 100)), ("sparse", (n < 50) & (n / F.greatest(F.length(t), F.lit(1)) < 0.05))])


def text_kind(text: str) -> Column:
    t = F.upper(text)
    return F.when(t.contains("SENTENCIA"), "judgement").when(t.contains("ACUERDO"), "agreement").when(t.contains("OFICIO"), "letter").when(t.contains("DECLARACI"), "statement").otherwise("other")


def extractable(text: str) -> Column:
    """50 characters, 10 words, 30 % letters."""
    return (F.length(text) >= 50) & (T.word_count(text) >= 10) & (T.char_share(text, r"\p{L}") >= 0.3)


def reading_score(text: str, confidence: str, language_words: tuple[str, ...] = ("de", "la", "que", "the", "and")) -> Column:
    """Confidence, 10 for a long text, 2 for each common word in it."""
    words = F.array_distinct(T.tokens(F.lower(text)))
    return F.coalesce(F.col(confidence), F.lit(0.0)) + F.when(F.length(text) > 500, 10).otherwise(0) + 2 * F.size(F.filter(words, lambda w: w.isin(*language_words)))


def problems(df: DataFrame, key: str, tests: dict[str, Column]) -> DataFrame:
    """key, problem: a row for each test that holds."""
    return df.select(key, F.explode(F.array_compact(F.array(*[F.when(t, n) for n, t in tests.items()]))).alias("problem"))


def suggestions(text: str, rules: dict[str, str]) -> Column:
    """array<string> of the suggestions whose pattern the text has."""
    return F.array_compact(F.array(*[F.when(F.col(text).rlike(p), n) for n, p in rules.items()]))


def grade(pct: Column) -> Column:
    return F.when(pct >= 80, "excellent").when(pct >= 60, "good").when(pct >= 40, "fair").otherwise("poor")
