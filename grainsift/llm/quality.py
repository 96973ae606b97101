"""Quality classifier: Naive Bayes support vectors on character n-gram indicators.

Indicators are scaled by class log-count ratios counted over all training rows; a linear hinge-loss model is
fitted on them by dual coordinate descent, drawn towards its mean weight as usual for this model, and its
margin is mapped to a probability by a sigmoid fitted on rows that the descent did not see.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainsift.llm.common import bounded_batches, give_back_memory
from grainsift.llm.features import SEGMENT, bucket_counts, bucket_segments, class_quotas, code_segments, collected_features, held_out, sampled_rows

ORDERS, BITS = 3, 16
TRAIN_ROWS = 4000  # labelled rows that the margin is fitted on, at most; class counts cover all of them
CALIBRATE = 5
SMOOTH, COST, BLEND, ROUNDS, DAMP = 1.0, 1.0, 0.25, 30, 0.25
THRESHOLD = 0.7
BROADCAST_LABELS = 1_000_000  # rows; beyond, labels meet documents in a shuffled join


REPEATS = 8  # longest run of repeated words that is told apart


def present(text: str) -> np.ndarray:
    """Buckets of the n-grams of a text, case and punctuation kept, and of its n-grams of repetition.

    The latter are over a second stream with a symbol for each word, same as the word before or not; only whether it holds
    1, 2, .. REPEATS repeats in a row matters, so the first buckets stand for these and the others for characters.
    """
    seen = np.zeros(1 << BITS, bool)
    for part in bucket_segments(code_segments(text), ORDERS, BITS):
        seen[np.maximum(part, REPEATS)] = True
    seen[:REPEATS] = False
    longest, run, before = 0, 0, None
    for word in text.split() if len(text) <= SEGMENT else map(re.Match.group, re.finditer(r"\S+", text)):
        run = run + 1 if word == before else 0
        if run > longest:
            longest = run
        before = word
    seen[: min(longest, REPEATS)] = True
    return np.flatnonzero(seen)


@dataclass
class QualityModel:
    weights: np.ndarray  # ratio * margin weight
    ratio: np.ndarray
    bias: float
    slope: float
    shift: float
    damp: float  # added to the squared length, so that a text of few n-grams stays near the prior

    def margin(self, at: np.ndarray) -> float:
        norm = np.sqrt((self.ratio[at] ** 2).sum() + self.damp)
        return float(self.weights[at].sum() / norm if norm > 0 else 0.0) + self.bias

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(present(text or "")) + self.shift, -30, 30))))


def dual_descent(rows: list[tuple[int, np.ndarray, np.ndarray]], size: int, cost: dict[int, float], rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights and bias of the L1-loss linear SVM on (y = -1 or 1, buckets, values), coordinates in a seeded order."""
    w, dual = np.zeros(size + 1), np.zeros(len(rows))
    rows = [(y, np.append(at, size), np.append(x, 1.0)) for y, at, x in rows]
    norms = [float((x * x).sum()) for _, _, x in rows]
    rng = np.random.default_rng(5)
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            y, at, x = rows[i]
            gradient = y * float(x @ w[at]) - 1
            new = min(max(dual[i] - gradient / norms[i], 0.0), cost[y])
            if new != dual[i]:
                w[at] += (new - dual[i]) * y * x
                worst = max(worst, abs(new - dual[i]))
                dual[i] = new
        if worst < 1e-3:
            break
    return w[:-1], float(w[-1])


def fit_sigmoid(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of least log loss (Platt's smoothed targets), by damped Newton steps."""
    pos, neg = float((y == 1).sum()), float((y == 0).sum())
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((p - target) * margins).sum() + 1e-3 * a, (p - target).sum() + 1e-3 * b])
        h = p * (1 - p)
        hess = np.array([[(h * margins**2).sum() + 1e-3, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(hess, g)
        step *= min(1.0, 5 / max(1e-12, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(float(a), 0.0), float(b)


def fit_quality_model(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> QualityModel:
    """Fit on docs that labels marks 0 or 1 (of several marks for one id the largest counts).

    Class counts cover the whole texts of all labelled rows; the margin and its sigmoid are fitted on at most
    `rows` of these (labels of other documents don't count), of each class the smallest by a hash of the id; the
    sigmoid is moved to the class shares of all labelled rows. Without rows of both classes every score is the
    smoothed share of class 1.
    """
    size = 1 << BITS
    marks = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_class"))
    small = marks.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    labelled = texts.join(F.broadcast(marks) if small else marks, "_id")
    count, n = bucket_counts(labelled, present, 2, BITS)
    prior = (n[1] + 1) / (n.sum() + 2)
    if n.min() == 0:
        return QualityModel(np.zeros(size), np.zeros(size), 0.0, 0.0, float(np.log(prior / (1 - prior))), 1.0)
    p, q = count[1] + SMOOTH, count[0] + SMOOTH
    ratio = np.log(p / (n[1] + 2 * SMOOTH)) - np.log(q / (n[0] + 2 * SMOOTH))
    ratio[(count.sum(0)) == 0] = 0

    def scaled(text: str) -> tuple[np.ndarray, np.ndarray]:
        at = present(text)
        return at, ratio[at]

    sizes = {k: int(n[k]) for k in (0, 1)}
    got = [(k, at, x.astype(np.float64)) for _, k, at, x in collected_features(labelled.where(sampled_rows(sizes, rows)), scaled, class_quotas(sizes, rows))]
    damp = DAMP * float(np.median([(x * x).sum() for _, _, x in got]))
    got = [(k, at, x / max(1e-12, np.sqrt((x * x).sum() + damp))) for k, at, x in got]
    seen = [(2 * k - 1, at, x) for i, (k, at, x) in enumerate(got) if i % CALIBRATE]
    unseen = [r for i, r in enumerate(got) if i % CALIBRATE == 0]
    few = {y: max(1, sum(r[0] == y for r in seen)) for y in (-1, 1)}
    w, bias = dual_descent(seen, size, {y: COST * len(seen) / (2 * m) for y, m in few.items()})
    used = np.abs(w[ratio != 0]).mean() if (ratio != 0).any() else 0.0
    w = BLEND * used + (1 - BLEND) * w  # the scaled indicators of class 1 are positive
    model = QualityModel(w * ratio, ratio, bias, 1.0, 0.0, damp)
    margins = np.array([model.margin(at) for _, at, _ in unseen])
    model.slope, model.shift = fit_sigmoid(margins, np.array([k for k, _, _ in unseen])) if len(unseen) else (1.0, 0.0)
    taken = [sum(k == y for k, _, _ in got) for y in (0, 1)]
    model.shift += float(np.log(n[1] / n[0]) - np.log(taken[1] / taken[0]))
    return model


def quality_scores(docs: DataFrame, model: QualityModel, *, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False) -> DataFrame:
    """id and score (0 to 1) for every row, or all columns and score; narrow.

    Null and empty texts hold no n-grams and get the score of a zero margin. Ids may be null or repeat; an empty table
    gives no rows; a column named score is replaced.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != "score"] if keep_columns else [id_col]
    rows = docs.select(*kept, F.col(text_col).alias("_text"))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [shared.value.score(t.as_py()) for t in b.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(scores, pa.float64())], [*kept, "score"])
        give_back_memory()

    return rows.mapInArrow(run, schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: learn from labels of rows that are not held out, score all from their text alone."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = fit_quality_model(docs, labels.where(~held_out(F.col("doc_id"))))
    scored = quality_scores(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
