"""Which terms of a catalog stand in which texts: multi-pattern automata over slices of the catalog, for catalogs and texts of any size."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.similarity import ratio
from foliospark.operators import likeness

SLICE, PART = 50_000, 32 << 20  # terms of an automaton; bytes of text that meet it in one task


def occurrences(texts: DataFrame, terms: DataFrame, slice_: int = SLICE, part: int = PART) -> DataFrame:
    """id, term: the distinct terms (of terms: term) that each text (of texts: id, text) contains, each once for a row of texts.

    Texts are dealt to parts of about part bytes by their ids, terms to slices by their hashes. A task builds the automaton of one slice and reads one
    part with it, in time that follows the text and the hits and not the number of terms, which may have one letter or thousands. Two
    sums over the inputs size the parts and slices. The empty term stands in every text but a null one; null terms in none.
    """
    known = terms.where("term IS NOT NULL").select("term").distinct()
    rows = texts.where("text IS NOT NULL").select("id", "text")
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    slices, parts = max(1, -(-known.count() // slice_)), max(1, -(-size // part))
    kind = texts.schema["id"].dataType.simpleString()

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        import ahocorasick

        words = right["term"].to_pylist()
        every = [w for w in words if w == ""]
        automaton = ahocorasick.Automaton()
        for w in words:
            if w:
                automaton.add_word(w, w)
        automaton.make_automaton()
        at, found = [], []
        for i, text in enumerate(left["text"].to_pylist()):
            hits = dict.fromkeys(every) | (dict.fromkeys(w for _, w in automaton.iter(text)) if len(automaton) else {})
            at += [i] * len(hits)
            found += hits
        return pa.table({"id": left["id"].take(pa.array(at, pa.int64())), "term": pa.array(found, pa.string())})

    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("part", deal("id", parts)).withColumn("slice", each(slices))
    right = known.withColumn("slice", deal("term", slices)).withColumn("part", each(parts))
    return left.groupBy("part", "slice").cogroup(right.groupBy("part", "slice")).applyInArrow(meet, f"id {kind}, term string")


def _order(priority: str = "priority", term: str = "term") -> Column:
    return F.struct(F.col(priority).alias("p"), (-F.length(term)).alias("n"), F.col(term).alias("t"))


def contained(df: DataFrame, column: str, catalog: DataFrame, key: str) -> DataFrame:
    """key, canonical: of the terms of the catalog (term, canonical, priority) that the column contains, in any case, that of the least priority, of these the
    longest, then the first. Rows that share a key count as one; those without a term have no row."""
    known = catalog.select(F.upper("term").alias("term"), "canonical", "priority")
    found = occurrences(df.select(F.col(key).alias("id"), F.upper(column).alias("text")), known)
    return found.join(known, "term").groupBy(F.col("id").alias(key)).agg(F.min_by("canonical", F.struct(_order(), "canonical")).alias("canonical"))


def normalised(df: DataFrame, column: str, catalog: DataFrame, key: str, least: float = 0.7) -> DataFrame:
    """key, canonical, how: what the column contains ("part"), else the term that it is likest to, with a ratio of over least ("like").

    Ties of the ratio go by the order of contained(). Only distinct values that contain no term are held against terms, by likeness.
    """
    parts = contained(df, column, catalog, key).withColumn("how", F.lit("part"))
    rest = df.join(parts.select(key), key, "left_anti").select(key, F.upper(column).alias("v")).where("v <> ''")
    known = catalog.select(F.upper("term").alias("term"), "canonical", "priority").where("term <> ''")
    both = rest.select("v", F.lit(0).alias("side")).unionByName(known.select(F.col("term").alias("v"), F.lit(1).alias("side"))).groupBy("v").agg(F.max("side").alias("side"))
    met = likeness.likely(both.select("v"), [], likeness.ratcliff(least))
    pairs = met.unionByName(met.select(F.col("w").alias("v"), F.col("v").alias("w"))).join(known, F.col("w") == F.col("term"))
    own = pairs.join(rest.select("v").distinct(), "v", "left_semi").withColumn("ratio", ratio(F.col("v"), F.col("term"))).where(F.col("ratio") > least)
    best = own.groupBy("v").agg(F.min_by("canonical", F.struct(-F.col("ratio"), _order(), "canonical")).alias("canonical"))
    return parts.unionByName(rest.join(best, "v").select(key, "canonical", F.lit("like").alias("how")))


def either_contains(a: DataFrame, b: DataFrame, x: str, y: str, or_equal: tuple[str, str]) -> DataFrame:
    """Rows of a with rows of b whose names (x, y) contain each other, in any case, or whose keys are equal; each pair of rows once.

    Both sides may be of any size: names meet by automata over the distinct names of either, keys by equality.
    """
    own = lambda df, c: df.select(F.lower(c).alias("id")).where("id IS NOT NULL").distinct().withColumn("text", F.col("id"))
    left, right = own(a, x), own(b, y)
    fits = occurrences(left, right.select(F.col("id").alias("term"))).select(F.col("id").alias("_x"), F.col("term").alias("_y"))
    back = occurrences(right, left.select(F.col("id").alias("term"))).select(F.col("term").alias("_x"), F.col("id").alias("_y"))
    names = fits.unionByName(back).distinct()
    p, q = a.withColumn("_x", F.lower(x)), b.withColumn("_y", F.lower(y))
    by_name = p.join(names, "_x").join(q, "_y").drop("_x", "_y")
    unnamed = p.join(q, F.col(or_equal[0]) == F.col(or_equal[1]))
    by_key = unnamed.join(names.withColumnsRenamed({"_x": "_u", "_y": "_v"}), (F.col("_x") == F.col("_u")) & (F.col("_y") == F.col("_v")), "left_anti").drop("_x", "_y")
    return by_name.select(*a.columns, *b.columns).unionByName(by_key.select(*a.columns, *b.columns))
