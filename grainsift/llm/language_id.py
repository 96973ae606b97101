"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained by follow-the-regularised-leader (FTRL-proximal) with elastic-net penalties, then calibrated by one
temperature fitted on rows that the training did not see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainsift.llm.common import bounded_batches
from grainsift.llm.features import bucket_counts, bucket_segments, class_quotas, collected_features, has_letter, held_out, letter_segments, sampled_rows

ORDERS, BITS = 3, 15
TRAIN_ROWS = 3000  # labelled rows that the weights are fitted on, at most; idf counts cover all of them
CALIBRATE = 5  # every fifth sampled row is kept for the temperature
EPOCHS = 3
MAX_CLASSES = 1024
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.01


@dataclass
class LanguageModel:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Best language and its calibrated probability; 'und' and 0 without a letter or a language."""
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        for i, t in enumerate(texts):
            at, x = tfidf(t or "", self.idf)
            if len(at) and self.langs:
                p = softmax((x @ self.weights[at] + self.bias) / self.temperature)
                langs[i], scores[i] = self.langs[int(p.argmax())], float(p.max())
        return langs, scores


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def tfidf(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and unit-length weights (1 + ln tf) * idf of a text; empty without a letter."""
    n = np.zeros(1 << BITS, np.int64)
    if has_letter(text):
        for part in bucket_segments(letter_segments(text), ORDERS, BITS):
            n += np.bincount(part, minlength=1 << BITS)
    at = np.flatnonzero(n)
    if not len(at):
        return at, np.zeros(0, np.float32)
    x = (1 + np.log(n[at])) * idf[at]
    return at, (x / max(1e-12, np.sqrt((x * x).sum()))).astype(np.float32)


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, size: int, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of FTRL-proximal on (class, buckets, values) rows, in their order."""
    z, n = np.zeros((size + 1, classes)), np.zeros((size + 1, classes))

    def current(at: np.ndarray) -> np.ndarray:
        za = z[at]
        w = -(za - np.sign(za) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        w[np.abs(za) <= L1] = 0
        return w

    for _ in range(epochs):
        for k, at, x in rows:
            at, x = np.append(at, size), np.append(x, 0.1)
            w = current(at)
            p = softmax(x @ w)
            p[k] -= 1
            g = np.outer(x, p)
            na = n[at]
            sigma = (np.sqrt(na + g * g) - np.sqrt(na)) / ALPHA
            z[at] += g - sigma * w
            n[at] = na + g * g
    w = current(np.arange(size + 1))
    return w[:-1], 0.1 * w[-1]


def fit_temperature(logits: np.ndarray, classes: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm."""
    if not len(classes):
        return 1.0

    def loss(t: float) -> float:
        z = logits / np.exp(t)
        z = z - z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(classes)), classes]).mean()) + 1e-4 * t * t

    lo, hi, g = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(50):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fit_language_model(docs: DataFrame, train: "F.Column", *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> LanguageModel:
    """Fit on the rows of docs where train holds and the language is known.

    Document frequencies cover all these rows and their whole texts; the weights are fitted on at most `rows`
    of them (or one for each language), of each language the smallest by a hash of the id, with a share for rare ones.
    """
    labelled = docs.where(train & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"))
    found = {r[0]: r[1] for r in labelled.groupBy("_lang").count().limit(MAX_CLASSES + 1).collect()}
    if len(found) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} languages")
    langs = sorted(found)
    size = 1 << BITS
    if not langs:
        return LanguageModel([], np.ones(size), np.zeros((size, 0)), np.zeros(0), 1.0)

    def present(text: str) -> np.ndarray:
        seen = np.zeros(size, bool)
        if has_letter(text):
            for part in bucket_segments(letter_segments(text), ORDERS, BITS):
                seen[part] = True
        return np.flatnonzero(seen)

    df, n = bucket_counts(labelled.select(F.lit(0).alias("_class"), "_text"), present, 1, BITS)
    idf = np.log((1 + n[0]) / (1 + df[0])) + 1
    classes = F.array_position(F.lit(langs), F.col("_lang")).cast("int") - 1
    sizes = {k: found[s] for k, s in enumerate(langs)}
    sample = labelled.select("_id", classes.alias("_class"), "_text").where(sampled_rows(sizes, rows))
    got = [(k, at, x) for _, k, at, x in collected_features(sample, lambda t: tfidf(t, idf), class_quotas(sizes, rows)) if len(at)]
    seen = [r for i, r in enumerate(got) if i % CALIBRATE] or got
    unseen = got[::CALIBRATE]
    weights, bias = ftrl(seen, len(langs), size)
    logits = np.array([x @ weights[at] + bias for _, at, x in unseen]).reshape(-1, len(langs))
    return LanguageModel(langs, idf, weights.astype(np.float32), bias, fit_temperature(logits, np.array([k for k, _, _ in unseen], int)))


def identify(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score for every row; narrow.

    Null texts and texts without a letter, and every text under a model without languages, get 'und' and 0.
    Ids may be null or repeat; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = shared.value.predict([t.as_py() for t in b.column(1)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, lang_pred string, score double").withColumnRenamed("_id", id_col)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: learn from rows that are not held out, predict all from their text alone."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit_language_model(docs, ~held_out(F.col("doc_id")))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
