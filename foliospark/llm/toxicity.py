"""Toxicity from the nearest labelled examples, by exact TF-IDF cosine over block-max inverted indexes."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.examples import fold, sampled
from foliospark.llm.textkernel import U64, sliced, terms, terms_of

BLOCK, BATCH = 256, 128
#: So many of the most frequent terms have whole rows of weights instead of postings.
FREQUENT = 512
#: The weight of a term that does not go with the label, to one that does.
LEAST = 0.1
MEMO = 4096  # votes on distinct texts that a task keeps for copies: some 2 MB


def known_terms(hashes: np.ndarray, at: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and count of the known terms of each row, by row and term. vocabulary is sorted."""
    if not len(vocabulary):
        return (np.zeros(0, np.int64),) * 3
    k = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    hit = np.flatnonzero(vocabulary[k] == hashes)
    row = np.searchsorted(at, hit, "right") - 1
    pair, count = np.unique(row * len(vocabulary) + k[hit], return_counts=True)
    return pair // len(vocabulary), pair % len(vocabulary), count


def likelihood_ratios(hashes: np.ndarray, at: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All terms, and of each the likelihood ratio G of its presence and the label as a share of 1.5 ln m for m
    terms, which chance gives to few (fewer still, as counts are whole numbers)."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    term, where = np.unique(hashes, return_inverse=True)
    pair = np.unique(row * len(term) + where)
    doc, where = pair // len(term), pair % len(term)
    a = np.bincount(where, y[doc], len(term))
    both = np.bincount(where, minlength=len(term)).astype(float)
    n, n1 = float(len(y)), float(y.sum())

    def part(o: np.ndarray, e: np.ndarray) -> np.ndarray:
        return np.where(o > 0, o * np.log(np.maximum(o, 1e-12) / np.maximum(e, 1e-12)), 0.0)

    b, c, d = both - a, n1 - a, n - n1 - (both - a)
    g = 2 * (part(a, both * n1 / n) + part(b, both * (n - n1) / n) + part(c, (n - both) * n1 / n) + part(d, (n - both) * (n - n1) / n))
    return term, g / (1.5 * np.log(max(len(term), 2)))


def choose_terms(hashes: np.ndarray, at: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """The terms whose presence goes with the label (likelihood_ratios() of 1 or more), at most most of them."""
    term, g = likelihood_ratios(hashes, at, y)
    good = np.flatnonzero(g >= 1)
    return np.sort(term[good[np.lexsort((term[good], -g[good]))][:most]])


def spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The whole numbers of all ranges from starts to ends, one range after the other."""
    size = ends - starts
    return np.repeat(ends - np.cumsum(size), size) + np.arange(size.sum())


@dataclass
class BlockMaxIndex:
    """Postings of unit TF-IDF vectors by term and block of examples, with the greatest weight of each such list.

    The FREQUENT terms, whose lists would hold most of the examples, are rows of a matrix instead: a batch of
    queries meets them in one product, whose greatest value in a block is part of the block's bound.
    """

    n: int
    row: np.ndarray
    value: np.ndarray
    at: np.ndarray  # where the list of each term and block starts among the postings, and the end
    block: np.ndarray
    top: np.ndarray
    cuts: np.ndarray  # where the lists of each term start, and the end
    place: np.ndarray  # the row of each frequent term, -1 of others
    whole: np.ndarray

    @classmethod
    def build(cls, n: int, n_terms: int, row: np.ndarray, term: np.ndarray, value: np.ndarray, frequent: int = FREQUENT) -> BlockMaxIndex:
        df = np.bincount(term, minlength=n_terms)
        often = np.argsort(-df, kind="stable")[:frequent]
        place = np.full(n_terms, -1, np.int32)
        place[often] = np.arange(len(often))
        whole = np.zeros((len(often), n))
        dense = place[term] >= 0
        whole[place[term[dense]], row[dense]] = value[dense]
        row, term, value = row[~dense], term[~dense], value[~dense]
        order = np.lexsort((row, term))
        row, term, value = row[order], term[order], value[order]
        starts = np.flatnonzero(np.diff(term * (n // BLOCK + 1) + row // BLOCK, prepend=-1))
        top = np.maximum.reduceat(value, starts) if len(starts) else np.zeros(0)
        return cls(n, row.astype(np.int32), value, np.append(starts, len(row)), row[starts] // BLOCK, top, np.searchsorted(term[starts], np.arange(n_terms + 1)), place, whole)

    def frequent(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the frequent terms add to the cosines of each query (terms and weights) with all examples."""
        q = np.zeros((len(queries), len(self.whole)))
        for i, (term, weight) in enumerate(queries):
            at = self.place[term]
            q[i, at[at >= 0]] = weight[at >= 0]
        return q @ self.whole

    def nearest(self, query: np.ndarray, weight: np.ndarray, k: int, part: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of greatest cosine above 0 (ties: the first examples) and their cosines, exactly.

        Blocks come by falling upper bound; the search ends when no block left can reach the k-th cosine. part is
        what frequent() has for the query.
        """
        part = self.frequent([(query, weight)])[0] if part is None else part
        rare = self.place[query] < 0
        query, weight = query[rare], weight[rare]
        lists = spans(self.cuts[query], self.cuts[query + 1])
        w, of = np.repeat(weight, self.cuts[query + 1] - self.cuts[query]), self.block[lists]
        bound = np.bincount(of, w * self.top[lists], self.n // BLOCK + 1).astype(float)
        firsts = np.arange(0, self.n, BLOCK)
        bound[: len(firsts)] += np.maximum.reduceat(part, firsts)
        blocks = np.argsort(-bound, kind="stable")
        blocks = blocks[bound[blocks] > 0]
        ids, sims, kth, at, width = np.zeros(0, np.int64), np.zeros(0), -1.0, 0, 8
        while at < len(blocks) and bound[blocks[at]] + 1e-9 >= kth:
            chosen = np.zeros(len(bound), bool)
            chosen[blocks[at : at + width]] = True
            at, width = at + width, width * 2
            here = chosen[of]
            a, b = self.at[lists[here]], self.at[lists[here] + 1]
            post = spans(a, b)
            sums = np.bincount(self.row[post], np.repeat(w[here], b - a) * self.value[post], self.n) + part
            found = np.flatnonzero((sums > max(0.0, kth - 1e-9)) & np.repeat(chosen, BLOCK)[: self.n])
            ids, sims = np.concatenate([ids, found]), np.concatenate([sims, sums[found]])
            if len(ids) > 4 * k:  # only those that can be among the k, ties with the k-th included
                likely = sims >= np.partition(sims, len(sims) - k)[len(sims) - k] - 1e-9
                ids, sims = ids[likely], sims[likely]
            best = np.lexsort((ids, -np.round(sims, 12)))[:k]
            ids, sims = ids[best], sims[best]
            kth = sims[-1] if len(ids) == k else -1.0
        return ids, sims


@dataclass
class NearestExamples:
    """Examples with labels, their index, and the calibration of votes."""

    vocabulary: np.ndarray
    idf: np.ndarray  # times the weight by label of the term
    index: BlockMaxIndex
    keys: list[str]
    y: np.ndarray
    weight: np.ndarray  # how many rows of the population an example stands for
    none: float  # the rate of label 1 among examples without a known term
    base: float
    k: int
    slope: tuple[float, float] = (1.0, 0.0)

    def unit(self, term: np.ndarray, count: np.ndarray) -> np.ndarray:
        v = (1 + np.log(count)) * self.idf[term]
        return v / np.maximum(np.sqrt((v * v).sum()), 1e-12)

    def votes(self, texts: list[tuple[np.ndarray, np.ndarray]], without: list[int] | None = None) -> Iterator[tuple[float, list]]:
        """Of each text (terms and counts) the distance-weighted share of label 1 among the k nearest, and these as
        (key, cosine). without: an example that each text is not to find."""
        for at in range(0, len(texts), BATCH):
            queries = [(term, self.unit(term, count)) for term, count in texts[at : at + BATCH]]
            for i, (query, part) in enumerate(zip(queries, self.index.frequent(queries), strict=True)):
                ids, sims = self.index.nearest(*query, self.k + (without is not None), part)
                if without is not None:
                    other = ids != without[at + i]
                    ids, sims = ids[other][: self.k], sims[other][: self.k]
                w = self.weight[ids] / (1.05 - np.minimum(sims, 1.0))
                prior = self.weight.mean()
                yield float((w @ self.y[ids] + prior * self.base) / (w.sum() + prior)), [(self.keys[i], float(s)) for i, s in zip(ids[:3], sims[:3], strict=True)]

    def score(self, p: float) -> float:
        a, b = self.slope
        x = np.log(max(p, 1e-6) / max(1 - p, 1e-6))
        return float(1 / (1 + np.exp(-(a * x + b))))

    def calibrate(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Platt's slope and offset on votes in which no example voted for itself; the slope stays positive."""
        a, b = 1.0, 0.0
        target = np.where(y == 1, 1 - 1e-3, 1e-3)
        w = weight / weight.sum()
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -60, 60)))
            g = np.array([(w * (p - target) * x).sum() + 1e-3 * (a - 1), (w * (p - target)).sum()])
            q = w * np.maximum(p * (1 - p), 1e-9)
            h = np.array([[(q * x * x).sum() + 1e-3, (q * x).sum()], [(q * x).sum(), q.sum() + 1e-9]])
            step = np.linalg.solve(h, g)
            a, b = max(0.05, a - step[0]), b - step[1]
            if np.abs(step).max() < 1e-9:
                break
        self.slope = (float(a), float(b))


def document_frequencies(docs: DataFrame, vocabulary: np.ndarray, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many rows of docs, all of them, each known term stands; and the number of rows."""

    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = held.value
        sums, rows = np.zeros(len(vocabulary), np.int64), 0
        for part, data, offsets in sliced(batches, 0):
            sums += np.bincount(known_terms(*terms(data, offsets), vocabulary)[1], minlength=len(vocabulary))
            rows += part.num_rows
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(sums[some], rows))], names=["term", "n"])

    got = docs.select(text).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas().set_index("term").n
    return got.reindex(np.arange(len(vocabulary)), fill_value=0).to_numpy(), int(got.get(-1, 0))


def train_toxicity(
    docs: DataFrame, labels: DataFrame, corpus: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text",
    per_class: int = 2000, k: int = 25,
) -> NearestExamples:
    """Examples from about per_class labelled rows of each class (at most twice that) with whole texts, as sampled() bounds them.

    docs and labels: rows that may be learned from; labels of 0 and 1, others are left out, a document with two
    labels is two examples. corpus: the texts whose document frequencies give the idf, all of them. All terms of
    the examples are indexed; their idf is multiplied by likelihood_ratios(), from LEAST to 1.
    """
    rows, counts = sampled(docs, labels.where(F.col(label).isin(0, 1)), label, per_class, key, text)
    y = rows[label].to_numpy(float) if len(rows) else np.zeros(0)
    sizes = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    weight = np.array([counts.get(int(c), 0) / sizes[int(c)] for c in y]) if len(y) else np.zeros(0)
    base = float((weight @ y) / weight.sum()) if len(y) else 0.0
    hashes, at = terms_of(rows[text].tolist())
    vocabulary, ratio = likelihood_ratios(hashes, at, y) if len(y) else (np.zeros(0, U64), np.zeros(0))
    df, n = document_frequencies(corpus, vocabulary, text) if len(vocabulary) else (np.zeros(0), 0)
    idf = (np.log((1 + n) / (1 + df)) + 1e-3) * np.clip(ratio, LEAST, 1.0)
    row, term, count = known_terms(hashes, at, vocabulary)
    value = (1 + np.log(count)) * idf[term]
    norm = np.sqrt(np.bincount(row, value * value, len(y)))
    index = BlockMaxIndex.build(len(y), len(vocabulary), row, term, value / norm[row])
    bare = norm == 0
    none = float((weight[bare] @ y[bare] + base) / (weight[bare].sum() + 1)) if bare.any() else base
    model = NearestExamples(vocabulary, idf, index, rows[key].tolist(), y, weight, none, base, k)
    known = np.flatnonzero(~bare)
    if len(known):
        cuts = np.searchsorted(row, np.arange(len(y) + 1))
        votes = np.array([p for p, _ in model.votes([(term[cuts[i] : cuts[i + 1]], count[cuts[i] : cuts[i + 1]]) for i in known], known.tolist())])
        model.calibrate(np.log(np.maximum(votes, 1e-6) / np.maximum(1 - votes, 1e-6)), y[known], weight[known])
    return model


def score_toxicity(docs: DataFrame, model: NearestExamples, text: str = "text") -> DataFrame:
    """docs without text, and score, predicted, evidence (key as text, and cosine, of up to three examples); columns so named go.

    A text that shares no term with any example, an empty and a null one too, gets the rate of label 1 among such examples
    and no evidence. Whole texts are read. The model is bounded by its numbers of examples and terms, and is broadcast.
    Repeated rows and texts get the same score. Ids are of any kind; rows keep theirs, null ones too.
    """
    own = [c for c in docs.columns if c not in (text, "score", "predicted", "evidence")]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(own)], F.col(text).alias("_text"))
    n = len(own)
    kind = pa.list_(pa.struct([("key", pa.string()), ("cosine", pa.float64())]))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = held.value, {}
        for part, data, offsets in sliced(batches, n):
            row, term, count = known_terms(*terms(data, offsets), model.vocabulary)
            score, evidence = np.full(part.num_rows, model.none), [[]] * part.num_rows
            cuts = np.searchsorted(row, np.arange(part.num_rows + 1))
            new, rows_of = {}, {}
            for i in np.flatnonzero(cuts[1:] > cuts[:-1]):
                t, c = term[cuts[i] : cuts[i + 1]], count[cuts[i] : cuts[i + 1]]
                same = hashlib.blake2b(t.tobytes() + c.tobytes(), digest_size=16).digest()
                rows_of.setdefault(same, []).append(i)
                if same not in known:
                    new[same] = t, c
            found = {same: (model.score(p), [{"key": k, "cosine": s} for k, s in near]) for same, (p, near) in zip(new, model.votes(list(new.values())), strict=True)}
            for same, at in rows_of.items():
                got = found[same] if same in found else known[same]
                for i in at:
                    score[i], evidence[i] = got
            if len(known) + len(found) > MEMO:
                known.clear()
            known.update(itertools.islice(found.items(), MEMO))
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:n], pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(evidence, kind)],
                names=[*(f"_c{i}" for i in range(n)), "score", "predicted", "evidence"],
            )

    kinds = ", ".join(f"_c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(own))
    out = rows.mapInArrow(run, f"{kinds}{', ' if own else ''}score double, predicted int, evidence array<struct<key: string, cosine: double>>")
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(own)], "score", "predicted", "evidence")


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    out = fold(F.col("doc_id"), 5) == 0
    model = train_toxicity(docs, labels.where(~out), docs)
    return score_toxicity(docs.select("doc_id", out.alias("held_out"), "text"), model)
