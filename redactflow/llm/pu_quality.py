"""A quality classifier from trusted positives and unlabelled text.

Positive-unlabelled learning with the non-negative risk: the loss of negatives
is the unlabelled loss as negatives less the share that positives cause, which
is never let under zero.  The class prior comes from the labelled rows.  The
model is linear over shape features (letters, signs, repetition, words) and
the frequencies of trigrams of byte classes in the whole text, which are the
same for any language; its margin is then put on a
probability scale with the labelled training rows.

Training takes about ``SAMPLE_ROWS`` rows each of positives, unlabelled and
calibration rows, chosen by a hash of their id: a documented bound; the class
prior counts all labels.  Scoring reads every whole text where it lies and shuffles nothing.
Null and empty texts have all features zero and are scored like any other;
rows without doc_id are scored and teach nothing; without labels of both
values the score is the class prior (0.5 without any label).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactflow.llm.common import STEP_BYTES, hash_sample, held_out, table, text_bytes, windows_hash, word_hashes

SAMPLE_ROWS = 6_000
THRESHOLD = 0.3
CLASSES = 9
BINS = CLASSES**3
SHAPES = 20
_CLASS = np.zeros(256, np.int32)  # of a byte: 0 other, 1 lower, 2 upper, 3 digit, 4 blank, 5 line end, 6 full stop or comma, 7 sign, 8 beyond ASCII
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A] = 1, 2, 3
_CLASS[[0x20, 9, 11, 12, 13]], _CLASS[10] = 4, 5
_CLASS[[ord(c) for c in ".,"]], _CLASS[[ord(c) for c in "#*$%&<>!"]], _CLASS[0x80:] = 6, 7, 8


def features(raw: np.ndarray) -> np.ndarray:
    """SHAPES + BINS numbers of one text (its UTF-8 bytes)."""
    out = np.zeros(SHAPES + BINS, np.float32)
    if not len(raw):
        return out
    kinds, grams = np.zeros(CLASSES), np.zeros(BINS)
    for at in range(0, len(raw), STEP_BYTES):  # bounded memory for a very long text
        c = _CLASS[raw[at:at + STEP_BYTES + 2]]
        kinds += np.bincount(c[:STEP_BYTES], minlength=CLASSES)
        grams += np.bincount(c[:-2] * CLASSES**2 + c[1:-1] * CLASSES + c[2:], minlength=BINS)
    words = word_hashes(raw)
    n = max(1, len(words))
    out[:CLASSES] = kinds / len(raw)
    out[9] = np.log1p(len(raw)) / 10
    out[10] = len(raw) / n / 10
    out[11] = np.log1p(len(words)) / 10
    out[12] = len(np.unique(words)) / n
    triples = windows_hash(words, 3)
    out[13] = len(np.unique(triples)) / max(1, len(triples))
    out[14] = (words[1:] == words[:-1]).mean() if len(words) > 1 else 0
    out[15] = kinds[2] / max(1, kinds[1] + kinds[2])
    out[16] = kinds[5] / n
    out[17] = kinds[7] / n
    out[18] = kinds[0] / n
    out[19] = len(words) < 8
    out[SHAPES:] = np.sqrt(grams / max(1, grams.sum()))
    return out


def featured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` and the text's features as binary float32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, at = text_bytes(b.column(len(keep)))
            rows = [features(raw[at[i]:at[i + 1]]).tobytes() for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(rows, pa.binary())], [*keep, "features"])

    kinds = dict(docs.dtypes)
    return docs.select(*keep, "text").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", features binary")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    prior: float | None = None  # set when there is nothing to learn from

    def margin(self, x: np.ndarray) -> np.ndarray:
        return standard(x, self.mean, self.scale) @ self.weights + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(x), self.prior)
        return _sigmoid(self.slope * self.margin(x) + self.shift)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean.astype(np.float32)) / scale.astype(np.float32), -8, 8)


def non_negative_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-3) -> Model:
    """A linear model of least non-negative PU risk under the logistic loss (Adam, whole batch)."""
    n = len(positive) + len(unlabelled)
    mean = (positive.sum(0, np.float64) + unlabelled.sum(0, np.float64)) / n
    scale = np.sqrt((((positive - mean) ** 2).sum(0) + ((unlabelled - mean) ** 2).sum(0)) / n) + 1e-6
    p, u = standard(positive, mean, scale), standard(unlabelled, mean, scale)
    w, first, second = (np.zeros(p.shape[1] + 1) for _ in range(3))
    slope = lambda d, x: np.append(d @ x, d.sum()) / len(x)
    for t in range(1, steps + 1):
        at_p, at_u = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
        yes_p, yes_u = _sigmoid(at_p), _sigmoid(at_u)
        # the negatives' risk: unlabelled rows called negative, less the positives' share in it
        negative = np.logaddexp(0, at_u).mean() - prior * np.logaddexp(0, at_p).mean()
        down = slope(yes_u, u) - prior * slope(yes_p, p)
        grad = prior * slope(yes_p - 1, p) + down if negative >= 0 else -down  # under zero it is pushed back up
        grad[:-1] += decay * w[:-1]
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        w -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, w[:-1], float(w[-1]))


def calibrate(model: Model, x: np.ndarray, y: np.ndarray) -> None:
    """Slope and shift of a logistic curve over the margin (Newton steps, targets drawn in a little)."""
    z = model.margin(x)
    size = max(1e-6, float(np.abs(z).mean()))
    a = np.stack([z / size, np.ones(len(z))], 1)
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    w = np.zeros(2)
    for _ in range(50):
        q = _sigmoid(a @ w)
        w -= np.linalg.solve(a.T @ (a * (q * (1 - q))[:, None]) + 1e-3 * np.eye(2), a.T @ (q - target) + 1e-3 * w)
    model.slope, model.shift = max(0.0, float(w[0])) / size, float(w[1])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality): give it training rows only."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    totals = known.agg(F.count("*"), F.sum("quality")).first()
    prior = float(totals[1] or 0) / totals[0] if totals[0] else 0.5
    if not 0 < prior < 1:
        return Model(*[np.zeros(1)] * 3, 0.0, prior=prior)
    texts = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    named = lambda ids, kind: ids.select("doc_id", F.col("quality").cast("int").alias("quality"), F.lit(kind).alias("kind"))
    chosen = named(hash_sample(known.where("quality = 1"), sample_rows), "positive").union(named(hash_sample(known, sample_rows), "labelled"))
    # the chosen ids are few, so only their texts are joined
    picked = texts.join(F.broadcast(chosen), "doc_id").union(hash_sample(texts, sample_rows).select("doc_id", "text", F.lit(None).cast("int"), F.lit("unlabelled")))
    rows = featured(picked, ["doc_id", "quality", "kind"])

    def train(b: pd.DataFrame) -> pd.DataFrame:
        def matrix(kind: str) -> tuple[np.ndarray, np.ndarray]:
            own = b[b["kind"] == kind].drop_duplicates("doc_id").sort_values("doc_id")
            x = np.frombuffer(b"".join(own["features"]), np.float32).reshape(len(own), SHAPES + BINS)
            return x, own["quality"].to_numpy()

        positive, unlabelled, (x, y) = matrix("positive")[0], matrix("unlabelled")[0], matrix("labelled")
        if not len(positive) or not len(unlabelled) or len(set(y)) < 2:
            return pd.DataFrame({"model": []})
        model = non_negative_pu(positive, unlabelled, prior)
        calibrate(model, x, y.astype(float))
        return pd.DataFrame({"model": [pickle.dumps(model)]})

    # one task over the sample, whose size is bounded; the weights alone come here
    made = rows.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(train, "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else Model(*[np.zeros(1)] * 3, 0.0, prior=prior)


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The columns of ``docs`` with score and predicted, which take the place of columns of those names."""
    docs = docs.drop("score", "predicted")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            raw, at = text_bytes(pa.Array.from_pandas(batch, type=pa.string()))
            x = np.stack([features(raw[at[i]:at[i + 1]]) for i in range(len(batch))]) if len(batch) else np.zeros((0, SHAPES + BINS))
            yield pd.Series(sent.value.score(x))

    out = docs.withColumn("score", score(F.coalesce("text", F.lit(""))))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs.where(~held_out("doc_id")), table(spark, sf_dir, "labels").where(~held_out("doc_id")))
    return scored(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
