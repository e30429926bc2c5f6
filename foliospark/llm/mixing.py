"""Mixing sources to target weights: soft domains, and document rates fitted by projected gradients."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import fresh, row_key, written
from foliospark.llm.examples import sampled
from foliospark.llm.linear import logistic
from foliospark.llm.textkernel import U64, packed, row_sums, sliced, terms, terms_of, words
from foliospark.llm.textkernel import mix as mix_hash
from foliospark.llm.toxicity import choose_terms, known_terms

SHAPES = 5
BUCKET_BITS, SHARE_SCALE = 10, 1.0  # all terms, hashed; the weight of their shares
_SYMBOL = np.array([33 <= c < 127 and not chr(c).isalnum() and chr(c) not in ".,'" for c in range(256)])
#: Shares of the expected tokens by domain, as quality and toxicity; what labels lack gets nothing.
TARGETS = {"q1t0": 0.85, "q0t0": 0.11, "q1t1": 0.03, "q0t1": 0.01}
MOST_ROWS = 1 << 16  # labelled rows of all domains together, of which each gets the same share
MOST_RATE = 4.0  # no document is repeated more often: what a corpus gains from repeats wanes from there on
PULL = 1e-6  # the weight of a rate's squared distance from 1, to that of the targets


@dataclass
class DomainModel:
    """Softmax over one-against-rest logistic models of the shares of all terms (hashed), the presence of chosen
    terms and a few shares of characters and words."""

    domains: list[str]
    vocabulary: np.ndarray
    w: np.ndarray  # buckets, then shapes, then chosen terms
    b: np.ndarray

    @staticmethod
    def shape(data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Shares of other symbols, capitals and digits, of distinct terms, and the log of the number of terms."""
        kinds = np.stack([_SYMBOL[data], (data >= 65) & (data <= 90), (data >= 48) & (data <= 57)], 1).astype(np.float32)
        size, n = np.maximum(np.diff(offsets), 1)[:, None], np.maximum(np.diff(at), 1)
        row = np.repeat(np.arange(len(n)), np.diff(at)).astype(U64)
        distinct = np.unique(mix_hash(hashes + row * U64(0x9E3779B97F4A7C15)), return_index=True)[1]
        some = np.bincount(row[distinct].astype(np.int64), minlength=len(n)) / n
        return np.concatenate([row_sums(kinds, offsets) / size * 10, some[:, None] * 3, np.log(n)[:, None] / 3], 1).astype(np.float32)

    @staticmethod
    def buckets(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> U64(64 - BUCKET_BITS)).astype(np.int64)

    @classmethod
    def fit(cls, texts: list[str], labels: list[str], counts: dict[str, int], most_terms: int = 256) -> DomainModel:
        """most_terms: chosen terms of each domain. Memory grows with the texts and with 4 kB for each."""
        domains, many = sorted(set(labels)), 1 << BUCKET_BITS
        if not domains:
            return cls([], np.zeros(0, U64), np.zeros((many + SHAPES, 0), np.float32), np.zeros(0, np.float32))
        y = np.array([domains.index(x) for x in labels])
        size = np.bincount(y)
        hashes, at = terms_of(texts)
        chosen = [choose_terms(hashes, at, (y == i).astype(float), most_terms) for i in range(len(domains)) if 0 < size[i] < len(y)]
        vocabulary = np.unique(np.concatenate([np.zeros(0, U64), *chosen]))
        x = np.zeros((len(y), many + SHAPES), np.float32)
        for i, t in enumerate(texts):
            own = hashes[at[i] : at[i + 1]]
            data, offsets = packed([t])
            x[i, :many] = np.bincount(cls.buckets(own), minlength=many) * (SHARE_SCALE / max(1, len(own)))
            x[i, many:] = cls.shape(data, offsets, own, np.array([0, len(own)]))[0]
        row, term, _ = known_terms(hashes, at, vocabulary)
        share = np.array([counts[d] for d in domains], float)
        w, b = logistic(x, np.eye(len(domains), dtype=np.float32)[y], (share / size)[y], steps=400, ones=(row, term, len(vocabulary)))
        return cls(domains, vocabulary, w, b)

    def posteriors(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        hashes, at = terms(data, offsets)
        row, term, _ = known_terms(hashes, at, self.vocabulary)
        many, chosen = 1 << BUCKET_BITS, (1 << BUCKET_BITS) + SHAPES
        scores = row_sums(self.w[self.buckets(hashes)], at) * (SHARE_SCALE / np.maximum(np.diff(at), 1)[:, None])
        scores = scores + row_sums(self.w[chosen + term], np.searchsorted(row, np.arange(len(offsets))))
        scores = scores + self.shape(data, offsets, hashes, at) @ self.w[many:chosen] + self.b
        p = 1 / (1 + np.exp(-np.clip(scores, -30, 30)))
        return p / p.sum(1, keepdims=True)


def train_domains(docs: DataFrame, labels: DataFrame, per_domain: int = 1000, key: str = "doc_id", text: str = "text", domain: str = "domain") -> DomainModel:
    """A model of the domains of labels (key, domain), from about per_domain whole texts of each, at most twice that (and of MOST_ROWS in all).

    sampled() bounds what the driver gets; rows of labels with a null key or domain teach nothing. Without any
    labelled text there are no domains, and mixed() leaves all rates at 1.
    """
    rows, counts = sampled(docs, labels, domain, per_domain, key, text, most_rows=MOST_ROWS)
    return DomainModel.fit(rows[text].tolist(), rows[domain].tolist(), counts)


def label_domains(labels: DataFrame) -> DataFrame:
    """doc_id, domain of a table with quality and toxic; null where either is."""
    return labels.select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string")).alias("domain"))


def _memberships(docs: DataFrame, model: DomainModel, text: str) -> DataFrame:
    """docs, and n_tokens and p; columns so named go."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    own = [c for c in docs.columns if c not in ("n_tokens", "p")]
    at = own.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for part, data, offsets in sliced(batches, at):
            p = model.posteriors(data, offsets)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel().astype(float)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.diff(words(data, offsets)[2])), lists], names=[*(f"_c{i}" for i in range(len(own))), "n_tokens", "p"])

    rows = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(own)])
    kinds = ", ".join(f"_c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(own))
    return rows.mapInArrow(run, f"{kinds}, n_tokens long, p array<double>").select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(own)], "n_tokens", "p")


def rate_of(p: str, y: np.ndarray, most_rate: float = MOST_RATE) -> Column:
    """1 - p·y, held between 0 and most_rate."""
    move = F.aggregate(F.zip_with(p, F.array(*[F.lit(float(v)) for v in y]).cast("array<double>"), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return F.greatest(F.lit(0.0), F.least(F.lit(float(most_rate)), F.lit(1.0) - F.coalesce(move, F.lit(0.0))))


def _moments(members: DataFrame, y: np.ndarray, most_rate: float) -> np.ndarray:
    """Sums over members at the rates of y, a row of d + 2 numbers each: n p pᵀ of the documents whose rate is not held at an
    end (d rows); n rate p, then n (rate - 1)² / 2 and n; n rate p·y in the last.

    Tasks add up their Arrow batches, and each row is then added over the tasks: d + 2 groups of d + 2 numbers a task.
    """
    d = len(y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d + 2, d + 2))
        for batch in batches:
            n = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
            p = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(n), d)
            move = p @ y
            rate = np.clip(1.0 - move, 0.0, most_rate)
            free = n * ((rate > 0) & (rate < most_rate))
            total[:d, :d] += (p * free[:, None]).T @ p
            total[d, :d] += (n * rate) @ p
            total[d, d:] += (n @ (rate - 1) ** 2) / 2, n.sum()
            total[d + 1, d] += (n * rate) @ move
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d + 2)), pa.array(list(total), pa.list_(pa.float64()))], names=["row", "sums"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        sums = table["sums"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d + 2).sum(0)
        return pa.table({"row": table["row"].slice(0, 1), "sums": pa.array([sums], pa.list_(pa.float64()))})

    each = members.select("n_tokens", "p").mapInArrow(run, "row long, sums array<double>")
    out = np.zeros((d + 2, d + 2))
    for r in each.groupBy("row").applyInArrow(add, "row long, sums array<double>").collect():
        out[r["row"]] = r["sums"]
    return out


def fit_step(members: DataFrame, targets: np.ndarray, most_rate: float = MOST_RATE, pull: float = PULL, most_passes: int = 60, gap: float = 1e-8) -> tuple[np.ndarray, float]:
    """y, of which rate_of() makes rates between 0 and most_rate, and how far these miss the targets.

    members: n_tokens (n) and p. With all in shares of the tokens, minimises half the squared distance of the domains' expected tokens, sum of
    n rate p, from targets, plus pull times the sum of n (rate - 1)² / 2, by projected gradients: a step goes along the gradient, preconditioned with the
    second derivatives over the documents that no end holds, and projects each rate onto [0, most_rate]. After such a step
    a rate is 1 - p·y for one y of all documents, so y is all that travels, and a step is one pass over n and p. A step that does not
    raise the dual function (the least value that the rates of y prove) is halved. The pull is lowered to its value in
    powers of ten, as far targets under a small pull hold nearly all rates at their ends, where gradients tell little.
    It ends when the objective is within gap (a share of it) of the least that is proven, or after most_passes. The miss is the
    largest distance from a target as a share of all tokens; 0 without any.
    """
    d, y, passes = len(targets), np.zeros(len(targets)), 0

    def moments(y: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        return _moments(members, y, most_rate)

    sums = moments(y) if d else np.zeros((2, 2))
    total = sums[d, d + 1]
    if not total or not d:
        return y, 0.0

    def dual(y: np.ndarray, sums: np.ndarray, pull: float) -> float:
        return float(-pull * (y @ y) / 2 - y @ targets + (sums[d + 1, d] + sums[d, d]) / total)

    weight = max(0.1, pull)
    while True:
        while passes < most_passes:
            miss = sums[d, :d] / total - targets
            uphill, now = miss - weight * y, dual(y, sums, weight)
            if (miss @ miss) / 2 / weight + sums[d, d] / total - now <= gap * now + 1e-12:
                break
            step = np.linalg.solve(sums[:d, :d] / total + weight * np.eye(d), uphill)
            size, there = 1.0, moments(y + step)
            while dual(y + size * step, there, weight) < now + 1e-4 * size * float(step @ uphill) and size > 1e-6 and passes < most_passes:
                size /= 4
                there = moments(y + size * step)
            if dual(y + size * step, there, weight) <= now:
                break  # no step shows above rounding
            y, sums = y + size * step, there
        if weight <= pull or passes >= most_passes:
            return y, float(np.abs(sums[d, :d] / total - targets).max())
        ratio, weight = weight / max(pull, weight / 10), max(pull, weight / 10)
        far = moments(y * ratio)  # where the targets are out of reach, y grows as the pull falls
        if dual(y * ratio, far, weight) > dual(y, sums, weight):
            y, sums = y * ratio, far


def fit_rates(members: DataFrame, targets: np.ndarray, most_rate: float = MOST_RATE, **options) -> DataFrame:
    """members (with n_tokens and p), rate and missed of fit_step(), missed the same in each row."""
    y, missed = fit_step(members, targets, most_rate, **options)
    return members.withColumns({"rate": rate_of("p", y, most_rate), "missed": F.lit(missed)})


def _rated(rows: DataFrame, model: DomainModel, targets: dict[str, float], text: str, seed: int, key: tuple[Column, Column], gone: tuple[str, ...] = (), pull: float = PULL) -> DataFrame:
    """rows without the gone columns, with n_tokens, p, rate, missed and copies, written once with their memberships: no row is shuffled."""
    goal = np.array([max(0.0, targets.get(x, 0.0)) for x in model.domains])
    members = written(_memberships(rows, model, text).drop(*gone), "memberships")
    u = F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    return fit_rates(members, goal / goal.sum() if goal.sum() > 0 else goal, pull=pull).withColumn("copies", F.floor(F.col("rate") + u).cast("long"))


def mixed(docs: DataFrame, model: DomainModel, targets: dict[str, float], doc_id: str = "doc_id", text: str = "text", seed: int = 0, pull: float = PULL) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, posteriors, rate, missed (as in fit_rates()), copies, and row_key(doc_id, text) as k1, k2.

    n_tokens counts the words of the whole text, none for a null one. targets are shares by domain, scaled to
    sum to 1; domains without a target get 0, targets without a domain are left out. A rate becomes a
    number of copies at random by the row key and seed, with the rate as mean; repeated rows share theirs. No rate is over
    MOST_RATE: where that keeps a target from being met, missed says by how much.
    Empty texts have no tokens to mix; they keep the rate that their posteriors get.
    """
    a, b = row_key(F.col(doc_id), F.col(text))
    rows = docs.select(F.col(doc_id).alias("doc_id"), a.alias("k1"), b.alias("k2"), F.col(text).alias("text"))
    rated = _rated(rows, model, targets, "text", seed, (F.col("k1"), F.col("k2")), ("text",), pull)
    return rated.select("doc_id", "n_tokens", F.col("p").alias("posteriors"), "rate", "missed", "copies", "k1", "k2")


def mix(docs: DataFrame, model: DomainModel, targets: dict[str, float], doc_id: str = "doc_id", text: str = "text", seed: int = 0, pull: float = PULL) -> DataFrame:
    """docs with each row as often as mixed() says, in any order. A larger pull keeps rates nearer to 1, and misses targets by more."""
    own, k1, k2, body = fresh(docs, "_row", "_k1", "_k2", "_body")
    a, b = row_key(F.col(doc_id), F.col(text))
    rows = docs.select(F.struct(*[F.when(F.lit(c != text), F.col(f"`{c}`")).alias(c) for c in docs.columns]).alias(own), a.alias(k1), b.alias(k2), F.col(text).alias(body))
    rated = _rated(rows, model, targets, body, seed, (F.col(k1), F.col(k2)), pull=pull)
    again = rated.where("copies > 0").select(own, body, F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return again.select(*[(F.col(body) if c == text else F.col(own)[c]).alias(c) for c in docs.columns])


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train_domains(docs, label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return mixed(docs, model, TARGETS).drop("k1", "k2")
