"""Corrections of noisy transcriptions: rules, dictionary snaps over distinct tokens, catalogs, change logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.functions.similarity import ratio

#: This library's own small vocabularies; every operator takes others.
ABBREVIATIONS = [(r"(?iuU)\bart\.", "artículo"), (r"(?iuU)\bexp\.", "expediente"), (r"(?iuU)\bnúm\.", "número"), (r"(?iuU)\bcol\.", "colonia"), (r"(?iuU)\bav\.", "avenida"), (r"(?iuU)\blic\.", "licenciado")]
CONFUSIONS = [(r"rn(?=o\b)", "m"), (r"(?<=\p{L})0(?=\p{L})", "o"), (r"(?<=\p{L})1(?=\p{L})", "l"), (r"\|", "l"), (r"[ \t]{2,}", " ")]
TERMS = ["expediente", "diligencia", "declaración", "audiencia", "ministerio", "inspección", "colonia", "avenida"]


def expanded(c: Column | str, rules: list[tuple[str, str]] = ABBREVIATIONS, marked: bool = False) -> Column:
    return T.rules(c, [(p, f"[{r}]" if marked else r) for p, r in rules])


def corrected(c: Column | str, rules: list[tuple[str, str]] = CONFUSIONS) -> Column:
    """Rules one after the other; line ends stay."""
    return T.rules(c, rules)


def field_corrected(c: Column | str, rules: list[tuple[str, str]], least: int = 6) -> Column:
    """Only the rules whose word has least letters or more, which spares short words."""
    return T.rules(c, [(rf"(?iuU)\b\Q{w}\E\b", r) for w, r in rules if len(w) >= least])


def _vocabulary(df: DataFrame, vocabulary: list[str]) -> DataFrame:
    return df.sparkSession.createDataFrame([(w.lower(),) for w in dict.fromkeys(vocabulary)], "word string")


def scored(tokens: DataFrame, words: DataFrame, least: float, spread: int = 3) -> DataFrame:
    """token, word, similarity of at least least, of words whose lengths differ by spread at most: they meet by equal lengths."""
    near = words.select("word", F.explode(F.sequence(F.length("word") - spread, F.length("word") + spread)).alias("n"))
    met = tokens.withColumn("n", F.length("token")).join(near, "n").where(F.col("token") != F.col("word"))
    return met.select("token", "word", ratio(F.col("token"), F.col("word")).alias("similarity")).where(F.col("similarity") >= least)


def distinct_tokens(df: DataFrame, column: str, pattern: str = r"[^\p{L}\p{N}]+", least: int = 4) -> DataFrame:
    return df.select(F.explode(T.tokens(F.lower(column), pattern)).alias("token")).where(F.length("token") >= least).distinct()


def snapped(df: DataFrame, column: str, vocabulary: list[str], least: float = 0.82, spread: int = 3) -> DataFrame:
    """token, best, similarity: for each distinct token of the column the word it is most like, from least on.

    Tokens are scored once each however often they occur; only words of nearly their length are compared.
    """
    found = scored(distinct_tokens(df, column), _vocabulary(df, vocabulary), least, spread)
    return found.groupBy("token").agg(F.max_by("word", F.struct("similarity", "word")).alias("best"), F.round(F.max("similarity"), 6).alias("similarity"))


def close_words(df: DataFrame, column: str, vocabulary: list[str], n: int = 3, least: float = 0.75, spread: int = 3) -> DataFrame:
    """token, word, points, rank: the n best words from least on; the same start adds 0.1 and the same length 0.05."""
    found = scored(distinct_tokens(df, column), _vocabulary(df, vocabulary), least, spread)
    bonus = F.when(F.substring("token", 1, 2) == F.substring("word", 1, 2), 0.1).otherwise(0.0) + F.when(F.length("token") == F.length("word"), 0.05).otherwise(0.0)
    rank = F.row_number().over(Window.partitionBy("token").orderBy(F.col("points").desc(), "word"))
    return found.select("token", "word", F.round(F.col("similarity") + bonus, 6).alias("points")).withColumn("rank", rank).where(F.col("rank") <= n)


def snapped_variants(df: DataFrame, column: str, variants: dict[str, str], least: float = 0.8, spread: int = 3) -> DataFrame:
    """token, best, exact: a known variant's own word, else that of the variant it is most like (over least)."""
    known = df.sparkSession.createDataFrame([(k.lower(), v) for k, v in variants.items()], "word string, best string")
    tokens = distinct_tokens(df, column)
    exact = tokens.join(known, tokens.token == known.word).select("token", "best", F.lit(True).alias("exact"))
    found = scored(tokens.join(known, tokens.token == known.word, "left_anti"), known.select("word"), least, spread).where(F.col("similarity") > least)
    best = found.groupBy("token").agg(F.max_by("word", F.struct("similarity", "word")).alias("word"))
    return exact.unionByName(best.join(known, "word").select("token", "best", F.lit(False).alias("exact")))


def completed(df: DataFrame, column: str, vocabulary: list[str], most: int = 4) -> DataFrame:
    """token, word: the shortest word that a cut token begins. Words meet tokens by their prefixes."""
    n = F.length("word")
    starts = _vocabulary(df, vocabulary).select("word", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("cut")).where(n - F.col("cut") >= 4)
    starts = starts.select("word", F.substring(F.col("word"), F.lit(1), n - F.col("cut")).alias("token"))
    return distinct_tokens(df, column, r"[^\p{L}]+").join(starts, "token").groupBy("token").agg(F.min_by("word", F.struct(n, "word")).alias("word"))


def words_corrected(df: DataFrame, key: str, column: str, vocabulary: list[str], least: float = 0.82) -> DataFrame:
    """key, done: known words stay, others become the nearest word or the one they begin; case and punctuation stay."""
    tokens = distinct_tokens(df, column, r"[^\p{L}]+").join(_vocabulary(df, vocabulary).withColumnRenamed("word", "token"), "token", "left_anti")
    cut = completed(tokens, "token", vocabulary)
    fixes = snapped(tokens, "token", vocabulary, least).join(cut, "token", "full").select("token", F.coalesce("best", "word").alias("put"))
    shape = r"^(\P{L}*)(.*?)(\P{L}*)$"
    words = df.select(key, F.posexplode(F.split(column, " ")).alias("place", "w")).withColumn("core", F.regexp_extract("w", shape, 2))
    cased = F.when(F.substring("core", 1, 1).rlike(r"\p{Lu}"), F.initcap("put")).otherwise(F.col("put"))
    put = F.concat(F.regexp_extract("w", shape, 1), F.coalesce(cased, "core"), F.regexp_extract("w", shape, 3))
    met = words.join(fixes, F.lower("core") == F.col("token"), "left").select(key, F.struct("place", put.alias("w")).alias("s"))
    return met.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda x: x["w"]), " ").alias("done"))


def entities_fixed(c: Column | str) -> Column:
    """By line: in lines of places a digit between or before letters becomes a letter; in dates letters become digits."""
    def fix(line: Column) -> Column:
        letters = F.regexp_replace(line, r"0(?=\p{L})", "o")
        day = F.regexp_extract(line, r"^(\S+)( de \p{L}+ de )(\S+)$", 1)
        digits = lambda x: F.translate(x, "OolI", "0011")
        dated = F.concat(digits(day), F.regexp_extract(line, r"^(\S+)( de \p{L}+ de )(\S+)$", 2), digits(F.regexp_extract(line, r"^(\S+)( de \p{L}+ de )(\S+)$", 3)))
        return F.when(line.rlike("(?iu)estado|municipio|colonia"), letters).when(day != "", dated).otherwise(line)

    return F.array_join(F.transform(F.split(T.col(c), "\n", -1), fix), "\n")


def canonical(df: DataFrame, column: str, variants: DataFrame) -> DataFrame:
    """df with canonical: of variants (variant, canonical) the value's own, else the value."""
    v = variants.select(F.lower(F.trim("variant")).alias("_v"), "canonical")
    return df.join(v, F.lower(F.trim(column)) == F.col("_v"), "left").withColumn("canonical", F.coalesce("canonical", column)).drop("_v")


def change_log(df: DataFrame, key: str, before: str, rules: list[tuple[str, str, str]]) -> DataFrame:
    """key, kind, found, put: the rules (kind, word, replacement) that a text has reason for."""
    each = F.array(*[F.when(T.contains_ci(before, w), F.struct(F.lit(k).alias("kind"), F.lit(w).alias("found"), F.lit(r).alias("put"))) for k, w, r in rules])
    return df.select(key, F.inline(F.array_compact(each)))


def field_changes(df: DataFrame, key: str, pairs: dict[str, tuple[str, Column]]) -> DataFrame:
    """key, field, before, after of the fields that change. pairs: field to column and new value."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).alias("before"), n.alias("after")) for f, (c, n) in pairs.items()])
    return df.select(key, F.inline(each)).where(~F.col("before").eqNullSafe(F.col("after")))


def improved_confidence(old: Column, before: Column | str, after: Column | str) -> Column:
    """The old one, but no more than 100 less twice the percentage of changed words, at least 50."""
    pct = F.coalesce(F.try_divide(100.0 * T.changed_words(before, after), T.word_count(before)), F.lit(0.0))
    return F.least(old, F.greatest(F.lit(50.0), 100.0 - 2 * pct))


def post_processed(c: Column | str) -> Column:
    return T.squeeze(corrected(T.legible_lines(T.unhyphenated(T.without_controls(c)))))
