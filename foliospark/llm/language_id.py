"""Language ID by error-correcting output codes over hashed byte n-grams."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.examples import fold, sampled
from foliospark.llm.linear import logistic
from foliospark.llm.textkernel import lowered, packed, row_sums, sliced

BUCKETS = 1 << 12
UNKNOWN = "und"
_LETTERS = np.zeros(256, bool)
_LETTERS[97:123] = True


def codewords(n: int, seed: int = 0) -> np.ndarray:
    """n rows of -1 and 1: the exhaustive code up to 7 languages, else the best of random dense codes."""
    if n <= 7:
        half = [c for c in itertools.product((-1, 1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(half or [(1,)] * 1, np.float32).reshape(len(half) or 1, n).T
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    tries = (np.where(rng.random((n, bits)) < 0.5, -1, 1).astype(np.float32) for _ in range(200))
    return max(tries, key=lambda c: np.abs((c @ c.T)[np.triu_indices(n, 1)]).max() * -1)


def _buckets(low: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The bucket of the n-gram that starts at each byte, for n of 2 and 3; BUCKETS where the text ends."""
    x = low.astype(np.uint32)
    pad = np.concatenate([x, np.zeros(2, np.uint32)])
    pairs = pad[:-2] * np.uint32(0x9E3779B1) + pad[1:-1] * np.uint32(0x85EBCA6B)
    threes = pairs * np.uint32(0xC2B2AE35) + pad[2:] * np.uint32(0x27D4EB2F)
    out = []
    for n, h in ((2, pairs), (3, threes)):
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        h = (h >> np.uint32(20)).astype(np.int32)
        for back in range(1, n):
            last = offsets[1:] - back
            h[last[(last >= offsets[:-1]) & (last < len(h))]] = BUCKETS
        out.append(h)
    return out


@dataclass
class EcocModel:
    """labels x bits codewords, their weights for decoding, and a logistic model of each bit."""

    labels: list[str]
    code: np.ndarray
    trust: np.ndarray
    w: np.ndarray  # n-gram size x bucket x bit
    b: np.ndarray
    margin: float

    @classmethod
    def fit(cls, texts: list[str], langs: list[str], margin: float = 0.1, seed: int = 0) -> EcocModel:
        labels = sorted(set(langs))
        code = codewords(max(1, len(labels)), seed)
        if len(labels) < 2:
            return cls(labels, code, np.ones_like(code), np.zeros((2, BUCKETS + 1, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32), margin)
        data, offsets = packed(texts)
        x = np.zeros((len(texts), 2 * BUCKETS), np.float32)
        for i, h in enumerate(_buckets(lowered(data), offsets)):
            row = np.repeat(np.arange(len(texts)), np.diff(offsets))
            k = h < BUCKETS
            np.add.at(x, (row[k], h[k] + i * BUCKETS), 1)
        x /= np.maximum(np.diff(offsets), 1)[:, None]
        scale = 1 / (x.std(0) + 1e-3 * x.std() + 1e-9)
        y = np.array([labels.index(c) for c in langs])
        size = np.bincount(y, minlength=len(labels))
        w, b = logistic(x * scale / np.sqrt(x.shape[1]), (code[y] > 0).astype(np.float32), 1 / size[y])
        w = w * scale[:, None] / np.sqrt(x.shape[1])
        right = ((x @ w + b) * code[y] > 0).astype(np.float32)
        trust = np.stack([right[y == i].mean(0) for i in range(len(labels))])
        whole = np.zeros((2, BUCKETS + 1, code.shape[1]), np.float32)
        whole[:, :BUCKETS] = w.reshape(2, BUCKETS, -1)
        return cls(labels, code, trust / np.maximum(trust.sum(1, keepdims=True), 1e-9), whole, b, margin)

    def bits(self, low: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        two, three = _buckets(low, offsets)
        got = self.w[0][two]
        got += self.w[1][three]
        return row_sums(got, offsets) / np.maximum(np.diff(offsets), 1)[:, None] + self.b

    def decode(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest codeword by weighted logistic loss, its share of softmax(-loss), and whether the next is close."""
        loss = np.stack([(np.logaddexp(0, -f * c) * t).sum(1) for c, t in zip(self.code, self.trust, strict=True)], 1) * self.code.shape[1]
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        top = np.sort(p, 1)
        near = top[:, -1] - top[:, -2] < self.margin if p.shape[1] > 1 else np.zeros(len(p), bool)
        return p.argmax(1), top[:, -1], near


def _has_letter(low: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    found = row_sums(_LETTERS[low].astype(np.int64), offsets) > 0
    for i in np.flatnonzero(~found & (offsets[1:] > offsets[:-1])):
        found[i] = any(c.isalpha() for c in low[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


def predict_language(docs: DataFrame, model: EcocModel, text: str = "text") -> DataFrame:
    """docs without text, and lang_pred, score, ambiguous; columns so named go.

    lang_pred is und, with score 0 and ambiguous, for a null text, one without letters, or a model that has seen no
    language. Whole texts are read; the model is a few hundred kB for a handful of languages.
    """
    own = [c for c in docs.columns if c not in (text, "lang_pred", "score", "ambiguous")]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(own)], F.col(text).alias("_text"))
    n = len(own)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        names = np.array([*model.labels, UNKNOWN], object)
        for part, data, offsets in sliced(batches, n, 1 << 18):
            low = lowered(data)
            known = _has_letter(low, offsets) & bool(model.labels)
            best, share, near = model.decode(model.bits(low, offsets)) if model.labels else (np.zeros(len(known), int), np.zeros(len(known)), np.ones(len(known), bool))
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:n], pa.array(np.where(known, names[best], UNKNOWN), pa.string()), pa.array(np.where(known, share, 0.0).astype(float)), pa.array(~known | near)],
                names=[*(f"_c{i}" for i in range(n)), "lang_pred", "score", "ambiguous"],
            )

    kinds = ", ".join(f"_c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(own))
    out = rows.mapInArrow(run, f"{kinds}{', ' if own else ''}lang_pred string, score double, ambiguous boolean")
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(own)], "lang_pred", "score", "ambiguous")


def train_language(docs: DataFrame, per_language: int = 300, lang: str = "lang", key: str = "doc_id", text: str = "text", **options) -> EcocModel:
    """A model of the languages of docs, from about per_language whole texts of each (at most twice that), as sampled() bounds them.

    Rows with a null key, language or text teach nothing.
    """
    rows, _ = sampled(docs, docs.where(F.col(text).isNotNull()).select(key, lang), lang, per_language, key, text)
    return EcocModel.fit(rows[text].tolist(), rows[lang].tolist(), **options)


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = fold(F.col("doc_id"), 4) == 2
    model = train_language(docs.where(~out))
    return predict_language(docs.select("doc_id", out.alias("held_out"), "text"), model)
