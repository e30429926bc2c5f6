"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Two sets of sizes a and b link when 100 * overlap >= percent * union, so their overlap is at least
percent * (a + b) / (100 + percent). Hence, with the n-grams of each set in one order for all sets, linked
sets share one of the first a - ceil(percent * a / 100) + 1 of them. Only those columns of the incidence
matrix are multiplied first; the order puts n-grams last that many documents share. What is left is
multiplied whole, within bands of sizes that can link, in blocks whose rows and n-grams bound a task's memory.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import passing, row_key, written
from foliospark.llm.components import components
from foliospark.llm.textkernel import U64, lowered, mix, sliced, span_hashes, words

#: Counters of n-grams and of words. Their number is fixed, as each task sends its own: 9 MB for any share of a corpus.
GRAM_BITS, WORD_BITS, SEGMENT = 21, 18, 1 << 14
SHORT_LIST = 32  # postings up to here make pairs; longer ones a forest of what the bins' counts let link
BLOCK_ROWS, BLOCK_GRAMS, BLOCK_COLUMNS = 256, 1 << 19, 4096
FEW_BINS, MANY_BINS, LONG_SET = 64, 1024, 800  # a set of more than LONG_SET n-grams has MANY_BINS
FILTER_BITS = (16, 28)  # the least and most bits of a filter of row keys, of which there are 16 for a key: up to 32 MB
NODE_BITS = 64  # of the hashes that stand for sets; sets that share them all are told apart by as many others


def _bits(n: int, each: int, bounds: tuple[int, int]) -> int:
    """Bits of a table with `each` places for each of n things, within bounds."""
    return max(bounds[0], min(bounds[1], (max(1, n) * each - 1).bit_length()))


def _grams(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words, of the k-word windows that start at each (all words after each other), rows' offsets into the words."""
    low = lowered(data)
    starts, ends, at = words(low, offsets)
    w = span_hashes(low, starts, ends)
    g = np.zeros(max(0, len(w) - k + 1), U64)
    for i in range(k):
        g = g * U64(0x9E3779B97F4A7C15) + w[i : i + len(g)]
    return w, mix(g), at


def _whole(w: np.ndarray) -> np.ndarray:
    """The one n-gram of a text with fewer words than n."""
    h = np.array([len(w)], U64)
    for x in w:
        h = mix(h * U64(3) + x)
    return h


def _sketch(docs: DataFrame, k: int) -> np.ndarray:
    """How often n-grams and words occur in all texts, by hash. It only orders n-grams: results don't depend on it."""
    bits = GRAM_BITS
    grams, every = 1 << bits, (1 << bits) + (1 << WORD_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, held, size = np.zeros(every, np.float32), [], 0

        def add(held: list[np.ndarray]) -> None:
            place, times = np.unique(np.concatenate(held), return_counts=True)
            sums[place] += times

        for _, data, offsets in sliced(batches, 0):
            w, g, at = _grams(data, offsets, k)
            inside = np.ones(len(g), bool)
            for back in range(1, k):
                last = at[1:] - back
                inside[last[(last >= at[:-1]) & (last < len(g))]] = False
            held += [(g[inside] >> U64(64 - bits)).astype(np.int32), (w >> U64(64 - WORD_BITS)).astype(np.int32) + np.int32(grams)]
            size += len(held[-1]) * 2
            if size > 1 << 20:
                add(held)
                held, size = [], 0
        if held:
            add(held)
        task = TaskContext.get().partitionId()
        for i in range(0, every, SEGMENT):
            if (part := sums[i : i + SEGMENT]).any():
                yield pa.RecordBatch.from_arrays([pa.array([i // SEGMENT]), pa.array([task], pa.int64()), pa.array([part.tobytes()])], names=["segment", "task", "counts"])

    def add_up(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = np.zeros(SEGMENT, np.float32)
        for blob in table.column("counts"):
            total += np.frombuffer(blob.as_py(), np.float32)
        return pa.table({"segment": [key[0].as_py()], "task": pa.array([key[1].as_py()], pa.int64()), "counts": pa.array([total.tobytes()])})

    schema = "segment long, task long, counts binary"
    texts = docs.select("text")
    parts, tasks = texts.mapInArrow(count, schema), texts.rdd.getNumPartitions()
    while tasks > 1:  # a tree of sums, each of 64 at most
        parts = parts.withColumn("task", F.floor(F.col("task") / 64)).groupBy("segment", "task").applyInArrow(add_up, schema)
        tasks = -(-tasks // 64)
    out = np.zeros(every, np.float32)
    for r in parts.toLocalIterator():
        out[r.segment * SEGMENT : (r.segment + 1) * SEGMENT] += np.frombuffer(r.counts, np.float32)
    return out


def _sets(data: np.ndarray, offsets: np.ndarray, k: int, order: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """The sorted distinct n-grams of each row, and their rank keys if order holds the rank key of each window."""
    w, g, at = _grams(data, offsets, k)
    rank = order(w, g) if order is not None else None
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            distinct, first = np.unique(g[a : b - k + 1], return_index=True)
            yield distinct, rank[a + first] if rank is not None else None
        elif b > a:
            yield _whole(w[a:b]), np.zeros(1)
        else:
            yield np.zeros(0, U64), np.zeros(0)


def set_hash(distinct: np.ndarray, seed: int = 0x5851F42D4C957F2D) -> int:
    """One hash for the set, as a signed long."""
    with np.errstate(over="ignore"):
        total = mix(distinct ^ U64(seed)).sum(dtype=U64) + U64(len(distinct)) * U64(0xD6E8FEB86659FD93)
    return int(mix(np.array([total], U64)).view(np.int64)[0])


def _prefixes(docs: DataFrame, k: int, percent: int, sketch: np.ndarray) -> DataFrame:
    """doc_id, k1, k2, node and other (hashes of the set), n, bins, tokens (the columns that are multiplied first)."""
    shift = 64 - NODE_BITS
    held = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = held.value
        many = len(counts) - (1 << WORD_BITS)
        grams, common, drop = counts[:many], np.log2(1 + counts[many:]), U64(65 - many.bit_length())
        usual = float(grams.mean())
        heavy = usual + 4 * usual**0.5 + 8

        def order(w: np.ndarray, g: np.ndarray) -> np.ndarray:
            word = common[(w >> U64(64 - WORD_BITS)).astype(np.int64)]
            key = np.zeros(len(g), np.float32)
            for i in range(k):
                key += word[i : i + len(g)]
            seen = grams[(g >> drop).astype(np.int64)]
            return np.where(seen > heavy, 1e4 + seen, key)

        for part, data, offsets in sliced(batches, 3):
            node, other, n, bins, tokens = [], [], [], [], []
            for distinct, key in _sets(data, offsets, k, order):
                size = len(distinct)
                n.append(size)
                node.append(set_hash(distinct) >> shift if size else None)
                other.append(set_hash(distinct, 0x2545F4914F6CDD1D) if size else None)
                top, number = (10, MANY_BINS) if size > LONG_SET else (6, FEW_BINS)
                bins.append(np.bincount((distinct >> U64(64 - top)).astype(np.int64), minlength=number).astype(np.uint8).tobytes())  # modulo 256
                take = size + (percent * size) // -100 + 1 if size else 0
                tokens.append(distinct[np.lexsort((distinct, key))[:take]].view(np.int64))
            flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(t) for t in tokens])]), pa.int32()), pa.array(flat, pa.int64()))
            columns = [*part.columns[:3], pa.array(node, pa.int64()), pa.array(other, pa.int64()), pa.array(n, pa.int64()), pa.array(bins, pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "k1", "k2", "node", "other", "n", "bins", "tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "k1", "k2", "text").mapInArrow(run, f"doc_id {kind}, k1 long, k2 long, node long, other long, n long, bins binary, tokens array<long>")


def _distinct_sets(prints: DataFrame) -> DataFrame:
    """node, rep (its least id), k1 and k2 of one of its rows, n, bins, and the least and greatest other hash, of each set."""
    row = F.min(F.struct("k1", "k2")).alias("row")
    sets = prints.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), row, F.first("n").alias("n"), F.first("bins").alias("bins"), F.min("other").alias("lo"), F.max("other").alias("hi"))
    return written(sets.select("node", "rep", "row.k1", "row.k2", "n", "bins", "lo", "hi"), "sets")


def _told_apart(prints: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """prints and sets where sets of one node but other hashes have nodes of their own. At 64 bits hardly a corpus has such sets."""
    mixed = written(sets.where("lo <> hi").select("node", "lo"), "mixed-sets", small=True)
    if mixed.isEmpty():
        return prints, sets
    own = F.when(F.col("other") != F.col("lo"), F.xxhash64("node", "other")).otherwise(F.col("node"))
    prints = written(prints.join(mixed, "node", "left").withColumn("node", own).drop("lo"), "prefixes")
    return prints, _distinct_sets(prints)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each row how many n-grams two sets differ in at least, by the counts of their bins modulo 256."""
    off = x - y
    return np.minimum(off, -off).sum(1, dtype=np.int64)


def _most(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """In how many n-grams linked sets of these sizes differ at most."""
    return n + m + 2 * ((-percent * (n + m)) // (100 + percent))


def _few(bins: np.ndarray) -> np.ndarray:
    return bins.reshape(len(bins), FEW_BINS, bins.shape[1] // FEW_BINS).sum(2, dtype=np.uint8)


def _forest(n: np.ndarray, raw: list[bytes], percent: int) -> list[tuple[int, int]]:
    """Edges between sets, in order of their sizes n, that join all those whose sizes and bins let them link: less than there are sets.

    A set is held against the larger ones that nothing joins it to yet, so that a cluster of near copies takes one pass.
    """
    long = int(np.searchsorted(n, LONG_SET, "right"))
    wide = np.frombuffer(b"".join(raw[long:]), np.uint8).reshape(len(n) - long, MANY_BINS)
    few = np.concatenate([np.frombuffer(b"".join(raw[:long]), np.uint8).reshape(long, FEW_BINS), _few(wide)])
    label, edges = np.arange(len(n)), []
    upto = np.searchsorted(n, 100 * n // percent, "right") if percent else np.full(len(n), len(n))
    for i in range(len(n) - 1):
        j = i + 1 + np.flatnonzero(label[i + 1 : upto[i]] != label[i])
        most = _most(n[i], n[j], percent)
        near = _apart(few[j], few[i]) <= most
        j, most = j[near], most[near]
        if i >= long:
            j = j[_apart(wide[j - long], wide[i - long]) <= most]
        if len(j):
            other, first = np.unique(label[j], return_index=True)
            edges += [(i, int(x)) for x in j[first]]
            label[np.isin(label, other)] = label[i]
    return edges


def _candidates(prints: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: edges whose components hold every linked pair of sets. prints: node, n, tokens, for each row; sets: node, n, bins, for each set.

    No edge joins sets that their bins tell apart: n-grams that many sets share would else join all of a large corpus.
    """
    postings = prints.select("node", "n", F.explode("tokens").alias("t"))
    shared = written(postings.groupBy("t").agg(F.count("*").alias("m"), F.min("node").alias("lead"), F.max("node").alias("last")).where("lead <> last").select("t", "m"), "shared-ngrams", small=True)
    met = written(postings.join(shared, "t"), "met")
    after = lambda x, i: F.filter(F.slice("s", i + 2, F.lit(SHORT_LIST)), lambda y: 100 * x["n"] >= percent * y["n"])
    both = lambda x, i: F.transform(after(x, i), lambda y: F.struct(F.least(x["node"], y["node"]).alias("a"), F.greatest(x["node"], y["node"]).alias("b")))
    pairs = (
        met.where(F.col("m") <= SHORT_LIST).groupBy("t").agg(F.sort_array(F.collect_set(F.struct("n", "node"))).alias("s"))
        .select(F.explode(F.flatten(F.transform("s", both))).alias("p")).groupBy("p.a", "p.b").count()
    )

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(i).to_numpy() for i in (2, 3))
            raw = [batch.column(i).to_pylist() for i in (4, 5)]
            wide = [np.array([len(x) == MANY_BINS for x in r], bool) for r in raw]
            near = np.zeros(len(n), bool)
            for both in ((False, False), (False, True), (True, False), (True, True)):
                k = np.flatnonzero((wide[0] == both[0]) & (wide[1] == both[1]))
                if len(k):
                    x, y = (np.frombuffer(b"".join([r[i] for i in k]), np.uint8).reshape(len(k), -1) for r in raw)
                    if x.shape != y.shape:
                        x, y = _few(x), _few(y)
                    near[k] = _apart(x, y) <= _most(n[k], m[k], percent)
            yield batch.filter(pa.array(near)).select([0, 1])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of an n-gram follow each other, in order of size."""
        key, nodes, sizes, raw = None, [], [], []

        def done() -> pa.RecordBatch:
            edges = _forest(np.array(sizes, np.int64), raw, percent)
            ends = [pa.array([nodes[e[i]] for e in edges], pa.int64()) for i in (0, 1)]
            return pa.RecordBatch.from_arrays(ends, names=["a", "b"])

        for batch in batches:
            for t, node, n, bins in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if t != key:
                    if len(nodes) > 1:
                        yield done()
                    key, nodes, sizes, raw = t, [], [], []
                nodes.append(node)
                sizes.append(n)
                raw.append(bins)
        if len(nodes) > 1:
            yield done()

    few = sets.select("node", "n", "bins")
    a = few.select(F.col("node").alias("a"), F.col("n").alias("n"), F.col("bins").alias("x"))
    b = few.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("bins").alias("y"))
    known = pairs.join(a, "a").join(b, "b").select("a", "b", "n", "m", "x", "y")
    listed = met.where(F.col("m") > SHORT_LIST).select("t", "node").distinct().join(few, "node").select("t", "node", "n", "bins")
    joined = listed.repartition("t").sortWithinPartitions("t", "n").mapInArrow(join, "a long, b long")
    return known.mapInArrow(close, "a long, b long").unionByName(joined.distinct())


def _spanning(link: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix the least row of its component."""
    label = np.arange(len(link))
    while True:
        least = np.where(link, label[None, :], len(link)).min(1, initial=len(link))
        new = np.minimum(label, least)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of the intersections of sorted sets: the product of their incidence matrices, a block of columns at a time."""
    every = left if right is None else left + right
    flat = np.concatenate(every)
    row = np.repeat(np.arange(len(every)), [len(s) for s in every])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(left), len(left) if right is None else len(right)), np.float32)
    for at in range(0, int(shared.sum()), BLOCK_COLUMNS):
        a, b = np.searchsorted(column, (at, at + BLOCK_COLUMNS))
        x = np.zeros((len(every), min(BLOCK_COLUMNS, int(column[b - 1]) - at + 1)), np.float32)
        x[row[a:b], column[a:b] - at] = 1
        total += x @ x.T if right is None else x[: len(left)] @ x[len(left) :].T
    return total.astype(np.int64)


def _linked(nodes: np.ndarray, side: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what the links of one block join. side 0 and 1: only pairs between the sides."""
    size = np.array([len(s) for s in sets])
    if not side.any():
        link = (100 + percent) * overlaps(sets) >= percent * (size[:, None] + size)
    else:
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        link = np.zeros((len(sets), len(sets)), bool)
        if len(a) and len(b):
            cross = (100 + percent) * overlaps([sets[i] for i in a], [sets[i] for i in b]) >= percent * (size[a][:, None] + size[b])
            link[np.ix_(a, b)], link[np.ix_(b, a)] = cross, cross.T
    np.fill_diagonal(link, False)
    label = _spanning(link)
    moved = np.flatnonzero(label != np.arange(len(label)))
    return nodes[moved], nodes[label[moved]]


def _filter_of(keys: DataFrame) -> np.ndarray:
    """One bit for each hash of the keys (k1), packed: 32 MB at most for any number of keys."""
    size = 1 << _bits(keys.count(), 16, FILTER_BITS)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, bool)
        for batch in batches:
            bits[_bit(batch.column(0), size)] = True
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([np.packbits(bits).tobytes()])], names=["task", "bits"])

    def join(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = np.zeros(size // 8, np.uint8)
        for blob in table.column("bits"):
            total |= np.frombuffer(blob.as_py(), np.uint8)
        return pa.table({"task": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([total.tobytes()])})

    schema = "task long, bits binary"
    parts, tasks = keys.mapInArrow(mark, schema), keys.rdd.getNumPartitions()
    while tasks > 16:
        parts = parts.withColumn("task", F.floor(F.col("task") / 16)).groupBy("task").applyInArrow(join, schema)
        tasks = -(-tasks // 16)
    total = np.zeros(size // 8, np.uint8)
    for r in parts.toLocalIterator():
        total |= np.frombuffer(r.bits, np.uint8)
    return total


def _bit(k1: pa.Array, size: int) -> np.ndarray:
    return (mix(k1.to_numpy(zero_copy_only=False).astype(np.int64).view(U64)) >> U64(65 - size.bit_length())).astype(np.int64)


def _set_bits(k1: pa.Array, bits: np.ndarray) -> pa.Array:
    at = _bit(k1, len(bits) * 8)
    return pa.array((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1)


def _placed(sets: DataFrame, clusters: DataFrame, percent: int) -> DataFrame:
    """node, root, k1, k2 of the sets of each cluster, with their band and how many blocks it and its neighbours have.

    A cluster of one block has one band. In others a band holds sizes within a ratio of 100 / percent, so that sets
    link within a band or with the next one only.
    """
    wide = math.log(100 / percent) * (1 + 1e-6) if percent < 100 else 1e-3
    own = clusters.join(sets.select("node", "n", "k1", "k2"), "node").withColumn("band", F.floor(F.log("n") / wide).cast("int"))
    own = written(own, "sized", small=True)
    bands = written(own.groupBy("root", "band").agg(F.count("*").alias("sets"), F.sum("n").alias("grams")), "bands", small=True)
    blocks = F.greatest(F.ceil(F.col("sets") / BLOCK_ROWS), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("int")
    whole = bands.groupBy("root").agg(F.sum("sets").alias("sets"), F.sum("grams").alias("grams")).where(blocks == 1).select("root", F.lit(True).alias("one"))
    cuts = written(bands.select("root", "band", blocks.alias("cut")).join(whole, "root", "left_anti"), "cuts", small=True)
    near = lambda by, name: cuts.select("root", (F.col("band") - by).alias("band"), F.col("cut").alias(name))
    out = own.join(near(0, "cut"), ["root", "band"], "left").join(near(1, "above"), ["root", "band"], "left").join(near(-1, "below"), ["root", "band"], "left")
    some = lambda c, least: F.coalesce(c, F.lit(least)).alias(c)
    return written(out.select("node", "root", "k1", "k2", F.when(F.col("cut").isNull(), 0).otherwise(F.col("band")).alias("band"), some("cut", 1), some("above", 0), some("below", 0)), "active", small=True)


def _links(docs: DataFrame, sets: DataFrame, clusters: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b: edges that join what the links between the sets of each cluster join, from whole texts.

    A text whose key the filter lacks is in no cluster; the others' sets, not their texts, are shuffled. A block
    meets itself, the others of its band, and those of the band below.
    """
    active = _placed(sets, clusters, percent)
    held = docs.sparkSession.sparkContext.broadcast(_filter_of(active.select("k1")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in batches:
            some = batch.filter(_set_bits(batch.column(1), bits))
            for part, data, offsets in sliced(iter([some]), 0):
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array([s.tobytes() for s, _ in _sets(data, offsets, k)], pa.binary())], names=["k1", "k2", "grams"])

    rows = docs.select("text", "k1", "k2").mapInArrow(read, "k1 long, k2 long, grams binary").join(active, ["k1", "k2"])
    own = F.pmod(F.xxhash64("node"), F.col("cut")).cast("int")
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    place = lambda band, i, j, side: F.struct(band.alias("band"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"))
    met = F.concat(
        F.transform(upto("cut"), lambda j: place(F.col("band"), F.least(own, j), F.greatest(own, j), own > j)),
        F.transform(upto("above"), lambda j: place(F.col("band") + 1, -1 - own, j, F.lit(0))),
        F.transform(upto("below"), lambda i: place(F.col("band"), -1 - i, own, F.lit(1))),
    )
    blocks = rows.select("root", "node", "grams", F.explode(met).alias("b")).select("root", "b.band", "b.i", "b.j", "b.side", "node", "grams")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sides, sets_ = None, [], [], []

        def done() -> pa.RecordBatch:
            _, first = np.unique(np.array(nodes), return_index=True)  # rows that repeat an id and text
            a, b = _linked(np.array(nodes)[first], np.array(sides)[first], [sets_[i] for i in first], percent)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
            for new, side, node, raw in zip(keys, batch.column(4).to_pylist(), batch.column(5).to_pylist(), batch.column(6), strict=True):
                if new != key:
                    if len(nodes) > 1:
                        yield done()
                    key, nodes, sides, sets_ = new, [], [], []
                nodes.append(node)
                sides.append(side)
                sets_.append(np.frombuffer(raw.as_py(), U64))
        if len(nodes) > 1:
            yield done()

    return blocks.repartition("root", "band", "i", "j").sortWithinPartitions("root", "band", "i", "j").mapInArrow(multiply, "a long, b long")


@passing("near")
def near_duplicates(docs: DataFrame, words_per_gram: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id, k1, k2, component: one row per row of docs.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased. The set of a text: its distinct n-grams of
    words_per_gram words, or all its words as one when they are fewer. Texts link when 100 * overlap >=
    percent * union. component_id is the smallest doc_id that links reach, its own included. A null, empty or
    wordless text links with nothing and stands alone, with its own id (also where ids repeat); equal sets
    count as linked; a null id is ignored among others. k1, k2 are row_key(doc_id, text).
    component tells components apart, also those of one component_id; null where a text has no words.

    n-grams are told apart by 64-bit hashes, sets by 128 bits. Equal sets are one row from the start. The candidates'
    components are cut into bands of sizes that can link, and these into blocks of BLOCK_ROWS sets and BLOCK_GRAMS
    n-grams; a band of c blocks takes c * c / 2 products, none of which leaves a row behind but for a forest of its links.
    """
    a, b = row_key(F.col(doc_id), F.col(text))
    rows = docs.select(F.col(doc_id).alias("doc_id"), a.alias("k1"), b.alias("k2"), F.col(text).alias("text"))
    sketch = _sketch(rows, words_per_gram)
    prints = written(_prefixes(rows, words_per_gram, percent, sketch), "prefixes")
    prints, sets = _told_apart(prints, _distinct_sets(prints))
    clusters = components(_candidates(prints, sets, percent))
    linked = components(_links(rows, sets, clusters, words_per_gram, percent))
    named = written(linked.join(sets.select("node", "rep"), "node"), "linked", small=True)
    ids = written(named.groupBy("root").agg(F.min("rep").alias("component_id")), "component-ids", small=True)
    placed = named.select("node", "root").join(ids, "root").select("node", "component_id", "root")
    all_ids = written(sets.select("node", "rep").join(placed, "node", "left").select("node", F.coalesce("component_id", "rep").alias("component_id"), F.coalesce("root", "node").alias("component")), "set-ids")
    return prints.select("doc_id", "k1", "k2", "node", F.col("n").alias("n_shingles")).join(all_ids, "node", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "k1", "k2", "component"
    )


def op4_ngram_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, words_per_gram=3, percent=90).drop("k1", "k2", "component")
