"""A persisted inverted index of analysed words, and searches that read one bucket for each term.

The index is three Parquet tables below one path: lists (token, df, cf, pages, tfs: a row for each token of a block of pages) and terms (token, df, cf) by
bucket of the token, and pages (page_id). A token's bucket is a partition of the files, so that a search opens
those of its terms only; within a bucket rows are sorted by token, so that the statistics of the row groups prune most of the rest.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.session import scratch, stored

BUCKETS, SPREAD = 32, 16  # by token; parts of each bucket, so that no word is one task's alone
BLOCK = 1 << 24
WORD, BETWEEN = re.compile(r"[^\W_]+"), r"[^\p{L}\p{N}]+"
#: Endings that the stemmer takes off words, the longest one that leaves four letters. They are folded, as the words are.
ENDINGS = (
    "amientos", "imientos", "amiento", "imiento", "aciones", "iciones", "mente", "acion", "icion", "iendo", "adores", "ador", "ando",
    "adas", "ados", "idas", "idos", "ada", "ado", "ida", "ido", "ings", "ing", "edly", "ies", "ed", "es", "as", "os", "s", "a", "e", "o",
)
STEM = rf"^(.{{4,}}?)(?:{'|'.join(ENDINGS)})$"
FOLDED = str.maketrans(T.MARKED, T.PLAIN)


@dataclass(frozen=True)
class Analyser:
    """Lower-cased, folded words of letters and digits, without stop words, stemmed or not."""

    stop: tuple[str, ...] = ()
    stem: bool = False

    def word(self, w: str) -> str:
        return re.sub(STEM, r"\1", w) if self.stem else w

    def words(self, query: str) -> list[str]:
        """The distinct analysed words of a query."""
        plain = query.translate(FOLDED).lower()
        return list(dict.fromkeys(self.word(w) for w in WORD.findall(plain) if w not in self.stop))

    def terms(self, words: pa.Array) -> pa.Array:
        """The analysed form of each lower-cased word; null for stop words and for none."""
        plain = pa.array([w if w.isascii() else w.translate(FOLDED) for w in words.to_pylist()], pa.string())
        kept = pc.if_else(pc.is_in(plain, pa.array(["", *self.stop])), pa.scalar(None, pa.string()), plain)
        return pc.replace_substring_regex(kept, STEM, r"\1") if self.stem else kept


def lists(pages: DataFrame, analyser: Analyser = Analyser(), text: str = "text", key: str = "page_id") -> DataFrame:
    """token, df, cf, pages, tfs: for each token of a block of pages their number, how often they have it, these pages and how often each has it; no shuffle.

    A block is what follows in the input, with about BLOCK bytes of text, or one longer page. Pages without words are in no list. Lower-casing is
    done by Spark, words are found and counted in Arrow batches: only the distinct words of a block are analysed.
    """
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64)
            blocks = np.cumsum(sizes) // BLOCK
            starts = [*np.flatnonzero(np.diff(blocks, prepend=-1)), batch.num_rows]
            for lo, hi in itertools.pairwise(starts):
                yield _listed(batch.column(0)[lo:hi], batch.column(1)[lo:hi], analyser)

    return pages.select(F.col(key).alias("page_id"), F.lower(text).alias("body")).mapInArrow(run, f"token string, df long, cf long, pages array<{kind}>, tfs array<int>")


def _listed(keys: pa.Array, bodies: pa.Array, analyser: Analyser) -> pa.RecordBatch:
    """lists() of one block of lower-cased texts."""
    pieces = pc.split_pattern_regex(pc.fill_null(bodies, ""), BETWEEN)
    words = pieces.flatten().dictionary_encode()
    tokens = analyser.terms(words.dictionary).dictionary_encode()
    ids, rows = tokens.indices.take(words.indices), pc.list_parent_indices(pieces)
    kept = pc.is_valid(ids)
    codes = ids.filter(kept).to_numpy().astype(np.int64) * len(keys) + rows.filter(kept).to_numpy()
    codes, tfs = np.unique(codes, return_counts=True)
    of, at = np.divmod(codes, len(keys))
    df, cf = (np.bincount(of, weights, len(tokens.dictionary)).astype(np.int64) for weights in (None, tfs))
    ends = pa.array(np.concatenate([[0], np.cumsum(df)]), pa.int32())
    columns = [tokens.dictionary, pa.array(df), pa.array(cf), pa.ListArray.from_arrays(ends, keys.take(pa.array(at))), pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int32()))]
    return pa.RecordBatch.from_arrays(columns, names=["token", "df", "cf", "pages", "tfs"])


def unlisted(rows: DataFrame, *others: str) -> DataFrame:
    """token, page_id, tf of lists(), and other columns of theirs."""
    each = rows.select("token", *others, F.inline(F.arrays_zip("pages", "tfs")))
    return each.select("token", F.col("pages").alias("page_id"), F.col("tfs").cast("long").alias("tf"), *others)


def postings(pages: DataFrame, analyser: Analyser = Analyser(), text: str = "text", key: str = "page_id") -> DataFrame:
    """token, page_id, tf of each page's distinct tokens; no shuffle."""
    return unlisted(lists(pages, analyser, text, key))


def bucket(token: Column | str) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def fuzziness(word: str) -> int:
    """Edits allowed by length: none up to two letters, one up to five, then two."""
    return 0 if len(word) < 3 else 1 if len(word) < 6 else 2


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    path: str
    analyser: Analyser
    kind: str  # of the pages' key

    def table(self, name: str) -> DataFrame:
        columns = {
            "lists": f"token string, df long, cf long, pages array<{self.kind}>, tfs array<int>, bucket int", "terms": "token string, df long, cf long, bucket int",
            "pages": f"page_id {self.kind}",
        }
        return self.spark.read.schema(columns[name]).parquet(f"{self.path}/{name}")


def build(pages: DataFrame, analyser: Analyser = Analyser(), path: str | None = None, text: str = "text", key: str = "page_id") -> Index:
    """Writes the index of all pages and their whole texts to path, by default to one in the shared folder that goes with the session.

    The words are found once; terms are counted from the written lists, with partial sums.
    """
    spark = pages.sparkSession
    path = path or scratch(spark, "index")
    found = lists(pages, analyser, text, key).withColumn("bucket", bucket("token"))
    dealt = found.repartition("bucket", F.pmod(F.xxhash64("pages"), F.lit(SPREAD))).sortWithinPartitions("bucket", "token")
    dealt.write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/lists")
    made = Index(spark, path, analyser, pages.schema[key].dataType.simpleString())
    terms = made.table("lists").groupBy("bucket", "token").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    terms.repartition("bucket").sortWithinPartitions("token").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/terms")
    pages.select(F.col(key).alias("page_id")).write.mode("overwrite").parquet(f"{path}/pages")
    return made


def _within(buckets: list[str], column: str, wanted: list[str]) -> Column:
    """Of a table by bucket the rows of these values. The buckets are literals, so that only their files are opened."""
    return F.col("bucket").isin(*buckets) & F.col(column).isin(*wanted)


def _buckets(spark: SparkSession, words: list[str]) -> list[int]:
    """The buckets of a query's words: a constant expression, which Spark evaluates without a job."""
    one = spark.range(1).select(F.array_distinct(F.transform(F.array(*[F.lit(w) for w in words]), bucket)).alias("b"))
    return list(one.first().b) if words else []


def expanded(index: Index, query: str, fuzzy: bool = False) -> DataFrame:
    """term, token, df, weight of the index's tokens for each word of the query: the word itself, with fuzzy those within fuzziness() edits too, which
    weigh less by their share of edited letters: the term table is read once for these, and only tokens of about a word's length are compared."""
    words = index.analyser.words(query)
    if not fuzzy:
        exact = index.table("terms").where(_within(_buckets(index.spark, words), "token", words) if words else F.lit(False))
        return exact.select(F.col("token").alias("term"), "token", "df", F.lit(1.0).alias("weight"))

    def near(w: str) -> Column:
        edits = F.levenshtein(F.lit(w), F.col("token"), fuzziness(w))  # -1 beyond
        return F.when((F.abs(F.length("token") - len(w)) <= fuzziness(w)) & (edits >= 0), F.struct(F.lit(w).alias("term"), edits.alias("edits")))

    each = F.array_compact(F.array(*map(near, words))).cast("array<struct<term:string,edits:int>>")
    met = index.table("terms").select("token", "df", F.explode(each).alias("q"))
    return met.select("q.term", "token", "df", (F.lit(1.0) - F.col("q.edits") / F.length("q.term")).alias("weight"))


def search(index: Index, query: str, n: int = 20, fuzzy: bool = False) -> DataFrame:
    """page_id, score, matched, tokens: the n pages of the largest score, ties to smaller ids.

    A token adds its tf times the logarithm of (pages + 1) / (df + 1), times its weight; matched counts the tokens. The words' buckets alone are read: those of
    an exact query are literals, the tokens of a fuzzy one are found first, as a table whose size is known, so that few of them do not move the lists.
    """
    total = index.table("pages").agg(F.count("*").alias("n")).scalar()
    tokens = expanded(index, query, fuzzy).withColumn("idf", F.log((total + 1) / (F.col("df") + 1)) * F.col("weight"))
    best = tokens.withColumn("k", F.row_number().over(Window.partitionBy("token").orderBy(F.col("weight").desc(), "term"))).where("k = 1").withColumn("bucket", bucket("token")).select("bucket", "token", "idf")
    best = stored(best, "tokens") if fuzzy else best
    words = index.analyser.words(query)
    rows = index.table("lists") if fuzzy else index.table("lists").where(_within(_buckets(index.spark, words), "token", words) if words else F.lit(False))
    met = unlisted(rows.join(best, ["bucket", "token"]), "idf")
    scored = met.groupBy("page_id").agg(F.round(F.sum(F.col("tf") * F.col("idf")), 6).alias("score"), F.count("*").alias("matched"), F.sort_array(F.collect_list("token")).alias("tokens"))
    return scored.orderBy(F.col("score").desc(), "page_id").limit(n)


def highlighted(found: DataFrame, pages: DataFrame, analyser: Analyser = Analyser(), fragments: int = 3, size: int = 150, text: str = "text") -> DataFrame:
    """found (page_id, tokens; few, as search() gives them) with highlights: up to that many fragments of size characters around the tokens in order, none
    overlapping another. Only the texts of these pages are read into words again."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = []
            for body, tokens in zip(batch.column("_folded").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                own: list[int] = []
                for m in WORD.finditer(body or ""):
                    at = max(m.start() - size // 2, 0)
                    if len(own) < fragments and (not own or at >= own[-1] + size) and m[0] not in analyser.stop and analyser.word(m[0]) in tokens:
                        own.append(at)
                starts.append(own)
            yield batch.append_column("_starts", pa.array(starts, pa.list_(pa.int32())))

    met = pages.select("page_id", F.col(text).alias("_body"), F.lower(T.fold(text)).alias("_folded")).join(found, "page_id")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in met.schema)
    shown = met.mapInArrow(run, f"{kinds}, _starts array<int>")
    return shown.withColumn("highlights", F.transform("_starts", lambda at: F.substring(F.col("_body"), at + 1, F.lit(size)))).drop("_body", "_folded", "_starts")
