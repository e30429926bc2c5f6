"""Similarity joins by the rarest q-grams, and the greedy choice of values as rounds over the pairs that they find.

Two values that score high share many q-grams, so in an order of all q-grams by frequency, rare ones first, they share some among
the first few of each (the prefix): at least one, or two, or three, of a prefix that is longer by none, one or two. Values meet by
equality of such sets of q-grams, never as all pairs of a group; bounds by length and by all shared q-grams drop most of
what meets, and only the rest is scored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.similarity import jaro_winkler, ratio
from foliospark.session import stored


@dataclass(frozen=True)
class Band:
    """Pairs whose lengths add up to low or more and less than high have at least shared(length, length) q-grams in
    common, counted as often as they occur in both; they meet by sets of ell of these."""

    q: int
    ell: int
    shared: Callable[[Column, Column], Column]
    low: int
    high: int


@dataclass(frozen=True)
class Measure:
    """A score of two strings, and what follows from a score of at least least. shorter: the least length of the shorter one, as a share of
    the longer one's."""

    score: Callable[[Column, Column], Column]
    least: float
    shorter: float
    bands: tuple[Band, ...]


ANY = 1 << 30  # no sum of lengths is larger
SMALL_GROUP = 16  # values that are held against each other in whole; those of larger groups meet by q-grams


def ratcliff(least: float) -> Measure:
    """Ratcliff-Obershelp: twice the matched characters M over both lengths, a + b.

    M characters are in common. They lie in at most (a + b)(1 - least) + 1 blocks, as a character without a match ends one, and a block of n
    characters has n - q + 1 q-grams. Short values meet by characters, where that bound says nothing.
    """
    slope = {q: least / 2 - (q - 1) * (1 - least) for q in (2, 3)}
    from_ = {q: int((q + 1) / slope[q]) + 1 if slope[q] > 0.02 else ANY for q in slope}
    cuts = [0, from_[2], max(from_[2], from_[3]), ANY]
    bound = lambda q: (lambda a, b: (a + b) * slope[q] - (q - 1)) if q > 1 else (lambda a, b: (a + b) * (least / 2))
    bands = [Band(q, 1 if q == 1 else 2, bound(q), cuts[q - 1], cuts[q]) for q in (1, 2, 3) if cuts[q - 1] < cuts[q]]
    return Measure(ratio, least, least / (2 - least), tuple(bands))


def winkler(least: float) -> Measure:
    """Jaro-Winkler with at most four common first letters: Jaro is at least j, so m matches have m/a + m/b of at least 3 j - 1."""
    j = max(0.0, (least - 0.4) / 0.6)
    shorter = max(0.0, 3 * j - 2)
    shared = lambda a, b: (3 * j - 1) * a * b / F.greatest(a + b, F.lit(1))
    # of lengths that add up to n, the shorter is at least n shorter / (1 + shorter)
    sure = (3 * j - 1) * shorter / (1 + shorter) ** 2
    cut = int(3 / sure) + 1 if sure > 0.02 else ANY
    return Measure(jaro_winkler, least, shorter, tuple(x for x in (Band(1, 1, shared, 0, cut), Band(1, 3, shared, cut, ANY)) if x.low < x.high))


def grams(c: Column, q: int) -> Column:
    """array<string>: the q-grams, the n-th of equal ones followed by n."""
    found = F.sort_array(F.regexp_extract_all(c, F.lit(rf"(?s)(?=(.{{{q}}}))"), F.lit(1)))
    return F.transform(found, lambda g, i: F.concat(g, F.lit(" "), (i - F.array_position(found, g)).cast("string")))


def _least(overlap: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(overlap - 1e-9).cast("int"))


def _sets(prefix: Column, ell: int) -> Column:
    """array<long>: hashes of all sets of ell elements of an array, in its order."""
    if ell == 1:
        return F.transform(prefix, lambda x: F.xxhash64(x))
    rest = lambda a, i: F.slice(a, i + 2, F.greatest(F.size(a) - i - 1, F.lit(0)))
    pairs = lambda a, *first: F.flatten(F.transform(a, lambda x, i: F.transform(rest(a, i), lambda y: F.xxhash64(*first, x, y))))
    return pairs(prefix) if ell == 2 else F.flatten(F.transform(prefix, lambda x, i: pairs(rest(prefix, i), x)))


def _candidates(values: DataFrame, block: list[str], measure: Measure, band: Band) -> DataFrame:
    """v, w in one block, v before w, that share a set of q-grams of their prefixes and pass the bound by length."""
    n = F.length("v")
    partner = F.ceil(n * measure.shorter)  # of its partners the shortest
    reach = F.floor(n / measure.shorter) if measure.shorter > 0 else F.lit(ANY)
    own = values.where((n + reach >= band.low) & (n + partner < band.high)).select(*block, "v", grams(F.col("v"), band.q).alias("grams")).where(F.size("grams") >= band.ell)
    each = own.select(*block, "v", F.explode("grams").alias("gram"))
    often = each.groupBy("gram").count()
    ranked = each.join(often, "gram").groupBy(*block, "v").agg(F.sort_array(F.collect_list(F.struct("count", "gram")))["gram"].alias("grams"))
    need = _least(band.shared(n, F.greatest(partner, F.lit(band.low) - n, F.lit(0))))
    first = F.slice("grams", F.lit(1), F.greatest(F.lit(0), F.least(F.size("grams"), F.size("grams") - need + band.ell)))
    keyed = ranked.select(*block, "v", n.alias("n"), F.explode(F.array_distinct(_sets(first, band.ell))).alias("set"))
    other = keyed.select(*block, "set", F.col("v").alias("w"), F.col("n").alias("n_"))
    both = F.col("n") + F.col("n_")
    met = keyed.join(other, [*block, "set"]).where((F.col("v") < F.col("w")) & (both >= band.low) & (both < band.high))
    return met.where(F.least("n", "n_") >= F.greatest("n", "n_") * measure.shorter - 1e-9).select(*block, "v", "w").distinct()


def likely(values: DataFrame, block: list[str], measure: Measure) -> DataFrame:
    """block, v, w: the pairs of alike(), and some that score less, none twice. The number of shared q-grams is checked in whole."""
    out = None
    for band in measure.bands:
        met = _candidates(values.where("v IS NOT NULL"), block, measure, band)
        common = F.size(F.array_intersect(grams(F.col("v"), band.q), grams(F.col("w"), band.q)))
        few = met.where(common >= _least(band.shared(F.length("v"), F.length("w"))))
        out = few if out is None else out.unionByName(few)
    return out


def alike(values: DataFrame, block: list[str], measure: Measure) -> DataFrame:
    """block, v, w, score of the distinct values v (strings) in one block that score at least measure.least, v before w.

    All such pairs, and none twice; a null or empty value has none. Blocks may be of any size, and [] joins the whole table.
    Only the score of what is likely needs Python, in Arrow batches.
    """
    return likely(values, block, measure).withColumn("score", measure.score(F.col("v"), F.col("w"))).where(F.col("score") >= measure.least)


def like_pairs(df: DataFrame, block: list[str], column: str, least: float, key: str = "id") -> DataFrame:
    """a, b, similarity: rows of one block whose different values have a ratio of least or more, in lower case."""
    pairs = alike(df.select(*block, F.lower(column).alias("v")).distinct(), block, ratcliff(least))
    rows = df.select(*block, F.col(key).alias("k"), F.lower(column).alias("x"))
    a, b = rows.select(*block, F.col("k").alias("a"), F.col("x").alias("v")), rows.select(*block, F.col("k").alias("b"), F.col("x").alias("w"))
    return pairs.join(a, [*block, "v"]).join(b, [*block, "w"]).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.round("score", 4).alias("similarity"))


def containing(values: DataFrame, block: list[str]) -> DataFrame:
    """block, v, w: values v that are a part of another value w of the block. They meet by the rarest trigram of v, or by all of v if it is
    shorter; the empty value is a part of all."""
    # values of up to three characters meet the parts of their own length, the others by one of their trigrams
    parts = lambda q: F.array_distinct(F.regexp_extract_all("v", F.lit(rf"(?s)(?=(.{{{q}}}))"), F.lit(1)))
    held = values.where("v <> ''")
    all_ = held.select(*block, F.col("v").alias("w"), F.explode(F.array_distinct(F.concat(*[parts(q) for q in (1, 2, 3)]))).alias("gram"))
    often = all_.where(F.length("gram") == 3).groupBy("gram").count()
    long = held.where(F.length("v") > 3).select(*block, "v", F.explode(parts(3)).alias("gram")).join(often, "gram")
    anchors = long.groupBy(*block, "v").agg(F.min(F.struct("count", "gram"))["gram"].alias("gram"))
    short = held.where(F.length("v") <= 3).select(*block, "v", F.col("v").alias("gram"))
    met = anchors.unionByName(short).join(all_, [*block, "gram"]).where((F.col("v") != F.col("w")) & F.contains("w", F.col("v")))
    return met.select(*block, "v", "w")


def first_independent(edges: DataFrame) -> DataFrame:
    """Of the nodes of edges (a before b, in one order of all nodes), those that go, as b: each that has an edge from an earlier node that stays.

    A round keeps the nodes that no edge leads to and drops those that they lead to, with all their edges, until no edge is left: the
    lexicographically first independent set, in as many rounds as the longest chain of dependent decisions, which is short.
    Edges and decisions are written each round, so that the lineage stays short and executors may be lost.
    """
    left, gone = stored(edges.select("a", "b").distinct(), "edges"), []
    while not left.isEmpty():
        stay = left.select("a").distinct().join(left.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        drop = stored(left.join(stay, "a", "left_semi").select("b").distinct(), "dropped")
        gone.append(drop)
        left = stored(left.join(drop, "b", "left_anti").join(drop.select(F.col("b").alias("a")), "a", "left_anti").join(stay, "a", "left_anti"), "edges")
    out = left.select("b")
    for drop in gone:
        out = out.unionByName(drop)
    return out


def _small_pairs(names: DataFrame, measure: Measure, parts: bool) -> DataFrame:
    """g, v, w, part: the pairs of values of small groups whose lengths let them be alike, and with parts those of which one is a part of the other."""
    met = names.join(names.select("g", F.col("v").alias("w")), "g").where("v < w")
    n, m = F.length("v"), F.length("w")
    part = F.contains("v", F.col("w")) | F.contains("w", F.col("v")) if parts else F.lit(False)
    near = F.least(n, m) >= F.greatest(n, m) * measure.shorter - 1e-9
    return met.withColumn("part", part).where(F.col("part") | near)


def greedy(df: DataFrame, group: str, column: str, order: str, measure: Measure, longest_first: bool = False) -> DataFrame:
    """The rows of df that stay when, within each group and in order, a row goes whose value is like one that stays before it.

    Values are compared in lower case, a null as the empty one. order tells all rows of a group apart. longest_first takes the longest values
    first, of equally long ones the last by order, and drops what a kept value contains too. Groups may be of any size.
    """
    text = F.coalesce(F.col(column), F.lit(""))
    rank = F.struct(-F.length(text), -F.col(order)) if longest_first else F.struct(F.col(order))
    rows = df.select(F.to_json(F.struct(group)).alias("g"), F.lower(text).alias("v"), rank.alias("rank"), F.col(order).alias("at"))  # a null group is one too
    values = stored(rows.groupBy("g", "v").agg(F.min("rank").alias("rank"), F.min_by("at", "rank").alias("at")), "values")
    several = values.groupBy("g").agg(F.count("*").alias("of")).where("of > 1")
    some = stored(values.join(several, "g"), "several")  # a value alone in its group stays
    names = some.where(F.col("of") > SMALL_GROUP).select("g", "v")
    pairs = _small_pairs(some.where(F.col("of") <= SMALL_GROUP).select("g", "v"), measure, longest_first)
    if not names.isEmpty():
        pairs = pairs.unionByName(likely(names, ["g"], measure).withColumn("part", F.lit(False)))
        if longest_first:
            full = some.where("v <> ''").groupBy("g").agg(F.min_by("v", "rank").alias("w"))
            empty = names.where("v = ''").join(full, "g")
            pairs = pairs.unionByName(containing(names, ["g"]).unionByName(empty).withColumn("part", F.lit(True)))
    x = some.select("g", "v", F.struct("rank", "g", "at", "v").alias("x"))
    met = pairs.join(x, ["g", "v"]).join(x.select("g", F.col("v").alias("w"), F.col("x").alias("y")), ["g", "w"])
    ordered = met.select("part", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    edges = ordered.where("part").unionByName(ordered.where(~F.col("part") & (measure.score(F.col("b.v"), F.col("a.v")) >= measure.least)))
    gone = first_independent(edges).select("b.g", "b.at")
    first = values.select("g", "at").join(gone, ["g", "at"], "left_anti").select(F.col("g").alias("_first_g"), F.col("at").alias("_first_at"))
    own = df.withColumn("_own_g", F.to_json(F.struct(group)))
    return own.join(first, (F.col("_own_g") == F.col("_first_g")) & (F.col(order) == F.col("_first_at")), "left_semi").select(*df.columns)
