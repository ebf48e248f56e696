"""Language identification: sparse multinomial logistic regression on character n-grams."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, released, small_batches, written
from .toxicity import held_out, sampled

BITS = 15  # n-grams are hashed to 2^15 features
LETTER = re.compile(r"[^\W\d_]")
PRIMES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)  # fixed values: odd 32-bit constants


def counts_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, counts) of the character 1-, 2- and 3-grams of a lower-cased text, its ends marked by spaces."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    one = c * PRIMES[0]
    two = (one[:-1] ^ (c[1:] + np.uint32(1))) * PRIMES[1]
    three = (two[:-1] ^ (c[2:] + np.uint32(2))) * PRIMES[2]
    n = np.zeros(1 << BITS, dtype=np.int64)
    for g in (one, two, three):
        g = g ^ (g >> np.uint32(15))
        n += np.bincount((g * PRIMES[1]) >> np.uint32(32 - BITS), minlength=1 << BITS)
    some = np.flatnonzero(n)
    return some, n[some]


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray  # (languages, features)
    bias: np.ndarray
    temperature: float

    def vector(self, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[features]
        return x / max(1e-12, float(np.sqrt(x @ x)))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not LETTER.search(text) or not self.languages:
            return "und", 0.0
        features, counts = counts_of(text)
        z = (self.weights[:, features] @ self.vector(features, counts) + self.bias) / self.temperature
        p = np.exp(z - z.max())
        k = int(p.argmax())
        return self.languages[k], float(p[k] / p.sum())


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, lasso: float = 0.02, ridge: float = 0.1, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Follow-the-regularised-leader, one row at a time, with elastic-net penalties; weights (classes, features) and biases.

    A weight stays exactly zero until its accumulated gradient exceeds the lasso penalty; the bias has no penalty.
    """
    size = (1 << BITS) + 1
    z, n = np.zeros((classes, size)), np.zeros((classes, size))
    penalty = np.full(size, lasso)
    penalty[-1] = 0.0

    def weights(at):
        za, na = z[:, at], n[:, at]
        return np.where(np.abs(za) > penalty[at], -(za - np.sign(za) * penalty[at]) / ((beta + np.sqrt(na)) / alpha + ridge), 0.0)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            features, x, y = rows[k]
            at, x = np.append(features, size - 1), np.append(x, 1.0)
            w = weights(at)
            p = w @ x
            p = np.exp(p - p.max())
            p /= p.sum()
            p[y] -= 1
            g = p[:, None] * x
            step = (np.sqrt(n[:, at] + g * g) - np.sqrt(n[:, at])) / alpha
            z[:, at] += g - step * w
            n[:, at] += g * g
    w = weights(np.arange(size))
    return w[:, :-1], w[:, -1]


def temperature_of(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature at which held-back rows have the least log loss, by golden section; 1 where there are none."""

    def loss(log_t: float) -> float:
        z = logits / np.exp(log_t)
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]).sum()) / max(1, len(y)) + 1e-3 * log_t * log_t

    a, b, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1), strict=True):
            features, counts = counts_of(text.as_py() or "")
            yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()]), pa.array([features.astype(np.int16).tobytes()], pa.binary()), pa.array([np.minimum(counts, 1 << 30).astype(np.int32).tobytes()], pa.binary())], ["lang", "features", "counts"])


def calibration_rows(languages: list[int]) -> list[bool]:
    """Which rows set the temperature only: every fifth of each language, so one with fewer than five loses none."""
    seen: Counter[int] = Counter()
    aside = []
    for y in languages:
        seen[y] += 1
        aside.append(seen[y] % 5 == 0)
    return aside


def train(docs: DataFrame, most_rows: int = 4_000) -> Model:
    """A model from docs (doc_id, text, lang) with a language and a letter, held-out rows (crc32 of the id mod 4 is 2) left aside.

    Bound: about most_rows rows are used, chosen by a hash of id and text, null and repeated ids included. One in five of each language sets the temperature only.
    """
    letter = F.col("text").rlike(r"\p{L}")
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).filter(F.col("lang").isNotNull() & ~held_out())
    chosen = sampled(known.filter("text IS NOT NULL"), most_rows, 12).filter(letter)
    sample = written(mapped(chosen.select("text", "lang"), _featurise, "lang string, features binary, counts binary"), "language-sample")
    seen = sorted((r["lang"], bytes(r["features"]), bytes(r["counts"])) for r in sample.collect())
    languages = tuple(sorted({r[0] for r in seen}))
    size = 1 << BITS
    if not languages:
        return Model((), np.ones(size), np.zeros((0, size)), np.zeros(0), 1.0)
    raw = [(np.frombuffer(f, dtype=np.uint16).astype(np.int64), np.frombuffer(c, dtype=np.int32), languages.index(lang)) for lang, f, c in seen]
    texts = np.zeros(size)
    for f, *_ in raw:
        texts[f] += 1
    idf = 1 + np.log((1 + len(raw)) / (1 + texts))
    plain = Model(languages, idf, np.zeros((len(languages), size)), np.zeros(len(languages)), 1.0)
    rows = [(f, plain.vector(f, c), y) for f, c, y in raw]
    aside = calibration_rows([y for *_, y in rows])
    weights, bias = ftrl([r for r, a in zip(rows, aside, strict=True) if not a], len(languages))
    held = [r for r, a in zip(rows, aside, strict=True) if a]
    logits = np.array([weights[:, f] @ x + bias for f, x, _ in held]).reshape(-1, len(languages))
    return Model(languages, idf, weights, bias, temperature_of(logits, np.array([y for *_, y in held], dtype=int)))


def identify_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score (its calibrated probability) for every whole text of docs (doc_id, text, lang).

    Only the text decides a prediction. Null texts and those without a letter are "und" with score 0, and so is every
    text if no language could be learned; repeated rows get the same answer each; null ids count as not held out; an empty table gives no
    rows; other columns are ignored. Nothing is shuffled; the model (a few megabytes, whatever the corpus) is broadcast.
    """
    small_batches(docs.sparkSession)
    learned = train(docs)
    # a broadcast carries plain arrays; the class travels with the function
    parts = docs.sparkSession.sparkContext.broadcast((learned.languages, learned.idf, learned.weights, learned.bias, learned.temperature))

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Model(*parts.value)
        for texts in batches:
            found = [model.predict(t.as_py()) for t in texts]
            yield pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["lang_pred", "score"])
        released()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), predict("text").alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")
