"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined, mapped, released, small_batches, written

#: Cyrillic and Greek letters that look like Latin ones, and those.
LOOKALIKES = "авеорсухіјѕкмнтαεικνορτυχ", "abeopcyxijskmhtaeiknoptux"
#: Digits and signs that stand for letters, and those letters.
DIGITS = "0134578@", "oieastba"
FOLD = str.maketrans("".join(x[0] for x in (LOOKALIKES, DIGITS)), "".join(x[1] for x in (LOOKALIKES, DIGITS)))
#: Phrases in which a lexicon word is no insult.
EXCEPTIONS = ("trash can", "trash bag", "trash collection", "clown fish", "pond scum", "pathetic fallacy", "disgusting taste in his mouth")
#: Insults known without any label. Each counts as SUPPOSED toxic texts that hold it, besides those that are labelled.
KNOWN = ("idiot", "moron", "stupid", "scum", "worthless", "pathetic", "loser", "disgusting", "clown", "trash")
SUPPOSED = 15
SPACES = re.compile(r"[\W_]+")
BEGINNINGS = (4, 5, 6, 7)


def fold(text: str) -> str:
    """Lower case, compatible forms, look-alike letters and digit substitutions undone; words between single spaces."""
    text = text if text.isascii() else unicodedata.normalize("NFKC", text)
    return f" {SPACES.sub(' ', text.lower().translate(FOLD)).strip()} "


def terms(folded: str) -> set[str]:
    """Words (" word ") and beginnings of words (" begin") of a folded text."""
    words = set(folded.split())
    out = {f" {w} " for w in words if len(w) > 2}
    for w in words:
        out.update(f" {w[:n]}" for n in BEGINNINGS if n < len(w))
    return out


def likeness(folded: str) -> int:
    """The smallest hash of a word pair: most near copies of a text share it."""
    words = folded.split()
    return min((xxhash.xxh32_intdigest(a + " " + b) for a, b in zip(words, words[1:] or words, strict=False)), default=0)


#: Bias, weight of the logarithm of all matched weight, and of that per hundred words, before any label is seen.
PRIOR = (-3.0, 3.0, 0.3)


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, float]
    bias: float = PRIOR[0]
    total: float = PRIOR[1]
    density: float = PRIOR[2]

    def matcher(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for term, weight in self.lexicon.items():
            found.add_word(term, (len(term), weight))
        for phrase in EXCEPTIONS:
            found.add_word(f" {phrase} ", (len(phrase) + 2, -1.0))
        found.make_automaton()
        return found

    def measure(self, matcher, text: str | None) -> tuple[float, int]:
        """(matched weight, words): at each word the heaviest match counts, unless an exception phrase covers it."""
        folded = fold(text or "")
        best: dict[int, float] = {}
        free: list[tuple[int, int]] = []
        for end, (n, weight) in matcher.iter(folded):
            start = end - n + 1
            if weight < 0:
                free.append((start, end))
            elif weight > best.get(start, 0):
                best[start] = weight
        return sum(w for at, w in best.items() if not any(a <= at < b for a, b in free)), folded.count(" ") - 1

    def features(self, weight, words):
        return np.log1p(weight), np.log1p(100 * weight / np.maximum(words, 1))

    def score(self, weight, words):
        a, b = self.features(weight, words)
        return 1 / (1 + np.exp(-np.clip(self.bias + self.total * a + self.density * b, -30, 30)))


def _toxic_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch.column(0):
            folded = fold(text.as_py() or "")
            found = sorted(terms(folded))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([likeness(folded)] * len(found), pa.int64())], ["term", "like"])


def _clean_counts(wanted: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0):
                n.update(terms(fold(text.as_py() or "")) & wanted)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["term", "n"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, prior: tuple[float, ...] = PRIOR, penalty: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression, bias first, by Newton's method with steps halved until they help; they are drawn to the prior,
    which holds where there are no rows."""
    x = np.column_stack([np.ones(len(x)), x])
    start = np.array(prior)
    ridge = np.diag([1e-2] + [penalty] * (x.shape[1] - 1))

    def loss(w):
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + (w - start) @ ridge @ (w - start) / 2)

    w = start
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ (w - start))
        while loss(w + step) > loss(w) and np.abs(step).max() > 1e-8:
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sampled(rows: DataFrame, most_rows: int, seed: int) -> DataFrame:
    """About most_rows at most of rows (doc_id, text, ...), chosen by a hash of id and text; of rows with one id and one text one.

    So the bound is one on rows, also where ids are null or repeated.
    """
    share = int((1 << 30) * min(1.0, most_rows / max(1, rows.count())))
    keyed = rows.withColumn("_key", F.xxhash64("doc_id", "text"))
    return keyed.filter(F.pmod(F.xxhash64("_key", F.lit(seed)), F.lit(1 << 30)) <= share).dropDuplicates(["_key"]).drop("_key")


def lexicon_of(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int, least_texts: int = 5, least_weight: float = 3.0) -> dict[str, float]:
    """Weights of terms from the numbers of toxic and clean texts that hold each: the logarithm of how much likelier one is in toxic texts."""
    known = {f" {w} ": SUPPOSED for w in KNOWN}
    said_in = {t: toxic.get(t, 0) + known.get(t, 0) for t in {*toxic, *known}}
    weigh = lambda t: math.log((said_in[t] + 0.5) / (n_toxic + SUPPOSED + 1)) - math.log((clean.get(t, 0) + 0.5) / (n_clean + SUPPOSED + 1))
    lexicon: dict[str, float] = {}
    said: Counter[str] = Counter()  # toxic texts of a beginning that a longer term in the lexicon already explains
    for t in sorted(said_in, key=lambda t: (-round(weigh(t), 1), len(t), t)):
        weight = weigh(t)
        if weight < least_weight:
            break
        if said_in[t] - said[t] < least_texts or any(lexicon.get(t[:n], 0) >= weight - 1 for n in range(2, len(t))):
            continue
        lexicon[t] = weight  # a beginning that says as much stands for its longer forms
        for n in range(2, len(t)):
            said[t[:n]] = max(said[t[:n]], said_in[t])
    return lexicon


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 10_000, least_texts: int = 5, least_weight: float = 3.0) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic), held-out rows (crc32 of the id mod 4 is 2) left aside.

    Bound: about most_rows labelled rows are used, chosen by a hash of id and text. A term is a word or a word's beginning; its weight is
    the logarithm of how much likelier it is in toxic than in other texts. It needs least_texts toxic texts, near copies counted
    once; the words of KNOWN count as SUPPOSED more, so they hold until labels speak against them. Two coefficients and a bias, drawn to PRIOR, then turn
    matched weight into a score. Null labels and ids say nothing; of an id's labels the largest holds; without any label KNOWN and PRIOR are the model.
    """
    small_batches(docs.sparkSession)
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out())
    ids = ids.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = joined(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), written(ids, "toxic-ids"), "doc_id")
    sample = written(sampled(rows, most_rows, 11).select("text", "toxic"), "toxic-sample")
    many = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    texts = lambda toxic: sample.filter(F.col("toxic") == toxic).select("text")
    toxic = mapped(texts(1), _toxic_terms, "term string, like long").groupBy("term").agg(F.count_distinct("like").alias("n")).filter(F.col("n") >= least_texts)
    toxic = {r["term"]: r["n"] for r in toxic.collect()}  # no more than the sample's texts hold
    wanted = frozenset({*toxic, *(f" {w} " for w in KNOWN)})
    clean = mapped(texts(0), _clean_counts(wanted), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    lexicon = lexicon_of(toxic, {r["term"]: r["n"] for r in clean.collect()}, many.get(1, 0), many.get(0, 0), least_texts, least_weight)
    model = Model(lexicon)
    seen = mapped(sample, _measured(model), "toxic int, weight double, words long").collect()  # a row of the sample each
    columns = [np.array([r[k] for r in seen], dtype=float) for k in range(3)]
    bias, total, density = _logistic(np.column_stack(model.features(columns[1], columns[2])), columns[0])
    return Model(lexicon, float(bias), float(total), float(density))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string")) % 4 == 2, F.lit(False))


def _measured(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = model.matcher()
        for batch in batches:
            found = [model.measure(matcher, t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.int64())], ["toxic", "weight", "words"])

    return run


def scored(model: Model):
    """A column function: the toxicity of a whole text, 0 to 1."""

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = model.matcher()
        for texts in batches:
            found = np.array([model.measure(matcher, t.as_py()) for t in texts], dtype=float).reshape(-1, 2)
            yield pa.array(model.score(found[:, 0], found[:, 1]))
        released()

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from threshold up) for every whole text of docs (doc_id, text).

    Only the text decides a score. Null and empty texts have no match and get the score of one without; repeated rows get the same score
    each; null ids count as not held out; an empty table gives no rows; other columns are ignored. Nothing is shuffled.
    """
    score = scored(train(docs, labels))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that score below threshold, in their own columns, whatever their names.

    Null and empty texts match nothing and stay; repeated rows stay or go together; an empty table stays empty.
    """
    score = scored(train(docs, labels))
    return docs.filter(score(F.col("text")) < threshold)
