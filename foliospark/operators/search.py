"""Lexical search over page texts: hits with contexts, relevance, grouping, suggestions, token index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import text as T


def require(term: str, least: int = 2) -> str:
    """The term, if it has the least number of characters."""
    if len(term.strip()) < least:
        raise ValueError(f"a term needs {least} characters or more")
    return term.strip()


def require_share(value: float) -> float:
    if not 0 <= value <= 1:
        raise ValueError("a similarity lies between 0 and 1")
    return value


def context(text: Column, at: Column, size: int | Column, around: int = 150) -> tuple[Column, Column, Column]:
    """Start and end (from 0) of the hit's context, widened to the ends of the words there by up to 40 characters (a longer word is cut), and the trimmed
    context with dots where cut."""
    lo, hi = F.greatest(at - around, F.lit(0)), F.least(at + size + around, F.length(text))
    left = F.length(F.regexp_extract(F.substring(text, F.greatest(lo - 40, F.lit(0)) + 1, F.least(lo, F.lit(40))), r"\S*$", 0))
    right = F.length(F.regexp_extract(F.substring(text, hi + 1, F.lit(40)), r"^\S*", 0))
    start, end = lo - left, hi + right
    shown = F.concat(F.when(start > 0, "...").otherwise(""), F.trim(F.substring(text, start + 1, end - start)), F.when(end < F.length(text), "...").otherwise(""))
    return start, end, shown


def hits(pages: DataFrame, term: str, text: str = "text", around: int = 150, keep: tuple[str, ...] = ("page_id", "folder")) -> DataFrame:
    """A row per occurrence (overlapping ones too): keep, term, position, start, end, context."""
    require(term)
    found = pages.where(T.contains_ci(text, term)).select(*keep, text, F.explode(T.positions(text, term)).alias("position"))
    start, end, shown = context(F.col(text), F.col("position"), len(term), around)
    return found.select(*keep, F.lit(term).alias("term"), "position", start.alias("start"), end.alias("end"), shown.alias("context"))


def boolean_search(pages: DataFrame, terms: list[str], operator: str = "AND", phrase: str | None = None, without: tuple[str, ...] = (), text: str = "text", around: int = 150) -> DataFrame:
    """Hits of each term (and of the phrase) on the pages that match as a whole."""
    match = pages.where(T.boolean_match(text, terms, operator, phrase, without))
    wanted = F.array(*[F.lit(t.lower()) for t in [*terms, *([phrase] if phrase else [])]])
    each = match.select("page_id", "folder", text, F.explode(wanted).alias("term"))
    at = F.when(F.lit(False), F.array().cast("array<int>"))
    for t in [*terms, *([phrase] if phrase else [])]:
        at = F.when(F.col("term") == t.lower(), T.positions(text, t)).otherwise(at)
    found = each.select("page_id", "folder", text, "term", F.explode(at).alias("position"))
    start, end, shown = context(F.col(text), F.col("position"), F.length("term"), around)
    return found.select("page_id", "folder", "term", "position", start.alias("start"), end.alias("end"), shown.alias("context"))


def relevance(text: str, terms: list[str], confidence: str) -> Column:
    """0.5, and 0.3 times the share of terms found, and 0.2 times the confidence of 100."""
    found = sum((T.contains_ci(text, t).cast("int") for t in terms), F.lit(0))
    return F.lit(0.5) + F.lit(0.3) * found / len(terms) + F.lit(0.2) * F.coalesce(F.col(confidence), F.lit(0.0)) / 100


def titles_and_bodies(folders: DataFrame, pages: DataFrame, term: str) -> DataFrame:
    """Folders whose name has the term at relevance 1.0, then pages whose text has it at 0.8."""
    require(term)
    names = folders.where(T.contains_ci("name", term)).select(F.lit("title").alias("kind"), F.col("folder_id").cast("string").alias("ref"), F.col("name").alias("shown"), F.lit(1.0).alias("relevance"))
    bodies = pages.where(T.contains_ci("text", term)).select(F.lit("body").alias("kind"), F.col("page_id").cast("string").alias("ref"), T.snippet("text", term).alias("shown"), F.lit(0.8).alias("relevance"))
    return names.unionByName(bodies)


def top(df: DataFrame, n: int, *order: Column, skip: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(skip).limit(n)


def first_per_group(df: DataFrame, n: int, group: list[str], *order: Column) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def page_info(total: Column, limit: int, page: int) -> list[Column]:
    pages = F.floor((total + limit - 1) / limit)
    return [total.alias("total"), F.lit(page).alias("page"), pages.alias("pages"), (F.lit(page) < pages).alias("has_next"), F.lit(page > 1).alias("has_previous")]


def highlights(pages: DataFrame, term: str, around: int = 50, text: str = "text") -> DataFrame:
    """page_id, position, shown: each hit of the whole text with around characters on both sides, the term in bold."""
    found = pages.where(T.contains_ci(text, term)).select("page_id", text, F.explode(T.positions(text, term)).alias("position"))
    t, at, end = F.col(text), F.col("position"), F.col("position") + len(term)
    lo, hi = F.greatest(at - around, F.lit(0)), F.least(end + around, F.length(text))
    dots = lambda c: F.when(c, "...").otherwise("")
    shown = F.concat(dots(lo > 0), F.substring(t, lo + 1, at - lo), F.lit(f"**{term}**"), F.substring(t, end + 1, hi - end), dots(hi < F.length(text)))
    return found.select("page_id", "position", shown.alias("shown"))


def advanced(pages: DataFrame, term: str, whole_word: bool = False, match_case: bool = False, before: int = 150, after: int = 150, text: str = "text") -> DataFrame:
    """page_id, position, before, match, after: hits (not overlapping) with options, and as many characters around them as asked for."""
    from foliospark.operators.extract import spans

    word = rf"\Q{require(term)}\E"
    pattern = ("(?U)" if match_case else "(?iuU)") + (rf"\b{word}\b" if whole_word else word)
    likely = F.col(text).contains(term) if match_case else T.contains_ci(text, term)
    found = spans(pages.where(likely), {"hit": pattern}, 0, ("page_id", text), text)
    t, at, end = F.col(text), F.col("position"), F.col("position") + F.length("match")
    lo = F.greatest(at - before, F.lit(0))
    return found.select("page_id", "position", F.substring(t, lo + 1, at - lo).alias("before"), "match", F.substring(t, end + 1, F.lit(after)).alias("after"))


def completions(pages: DataFrame, prefix: str, n: int = 10, least: int = 3, text: str = "text") -> DataFrame:
    word = F.explode(T.tokens(F.lower(text), r"[^\p{L}]+"))
    words = pages.where(T.contains_ci(text, prefix)).select(word.alias("word")).where(F.col("word").startswith(prefix.lower()) & (F.length("word") >= least))
    return top(words.groupBy("word").count(), n, F.col("count").desc(), F.col("word"))


def fuzzy_tokens(pages: DataFrame, word: str, least: float = 0.8, text: str = "text") -> DataFrame:
    """page_id, token, n, similarity of tokens like the word but not the word, in one pass over the texts. A ratio of r
    needs lengths within a factor of r / (2 - r), and no more edits than 1 - r of both lengths: each edit leaves a letter of one of them without its like."""
    from foliospark.functions.similarity import ratio

    require_share(least)
    bound, asked = least / (2 - least), word.lower()
    longest = int(len(word) / bound) + 1 if bound else 1 << 30
    tokens = pages.select("page_id", F.explode(T.tokens(F.lower(text), r"[^\p{L}\p{N}]+")).alias("token")).where(F.length("token").between(max(3, int(len(word) * bound)), longest))
    most = (F.length("token") + len(asked)) * (1 - least) + 1e-6
    near = tokens.where((F.col("token") != asked) & (F.levenshtein("token", F.lit(asked)) <= most))
    counted = near.groupBy("page_id", "token").agg(F.count("*").alias("n"))
    return counted.withColumn("similarity", ratio(F.col("token"), F.lit(asked))).where((F.col("similarity") >= least) & (F.col("similarity") < 1))


def categorised(pages: DataFrame, patterns: dict[str, str], n: int = 3, text: str = "text") -> DataFrame:
    """Up to n distinct matches per page and category, in order of the text."""
    lists = F.array(*[F.struct(F.lit(c).alias("category"), F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(p), F.lit(0))), 1, n).alias("found")) for c, p in patterns.items()])
    return pages.select("page_id", F.inline(lists)).select("page_id", "category", F.posexplode("found").alias("place", "match"))
