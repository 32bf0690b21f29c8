"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good; everything else is unlabelled web text. A linear
model over features of the text minimises the non-negative unbiased risk

    prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)])

whose negative part is kept from falling below zero, which is what overfitting does to it. Negative
labels are never used. The class prior is estimated from data too: a first model tells positives
from unlabelled texts on one half of each sample; on the other half the prior is the smallest ratio of the
unlabelled share to the positive share above a threshold, with a bound for chance.

Scale: the model is fitted on at most ``SAMPLE`` positives and ``SAMPLE`` unlabelled texts, chosen by
hash order; their features (some 3 kB each) are all that reaches the driver. Scoring is one pass over
all whole texts in Arrow batches, without a shuffle; only the text goes to Python.

Defined results: null and blank texts get the score of all-zero features; without positives or
without unlabelled texts every score is 0.5; null ids and ids without labels are scored like all
others and never teach; repeated rows get equal scores; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coralint.llm.common import give_back, small_batches

SAMPLE = 6000
PAIRS = 512  # hashed byte pairs
STYLE = 7
WIDTH = 256 + PAIRS + STYLE
STEPS, RATE, DECAY = 300, 0.02, 1e-3
FOLDS = 5


def features(text: str | None) -> np.ndarray:
    """Byte and byte-pair frequencies, repetition, compressibility and shape of a whole text."""
    out = np.zeros(WIDTH, np.float32)
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    words = (text or "").split()
    if not words:
        return out
    out[:256] = np.sqrt(np.bincount(raw, minlength=256) / len(raw))
    if len(raw) > 1:
        pair = (raw[:-1].astype(np.uint32) * 0x9E3B + raw[1:].astype(np.uint32) * 0x85EB) >> 3
        out[256 : 256 + PAIRS] = np.sqrt(np.bincount(pair % PAIRS, minlength=PAIRS) / (len(raw) - 1))
    n = len(words)
    out[256 + PAIRS :] = (
        np.log1p(n) / 10,
        len(set(words)) / n,
        sum(map(eq, words, words[1:])) / n,
        sum(map(eq, words, words[2:])) / n,
        min(1.5, len(zlib.compress(raw.tobytes(), 1)) / len(raw)),
        min(3.0, len(raw) / n / 10),
        sum(map(str.isupper, words)) / n,
    )
    return out


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        z = ((rows - self.mean) / self.scale) @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


UNFITTED = Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), 0.0, 0.5)


def _descend(step, width: int) -> tuple[np.ndarray, float]:
    """Adam on (weight, bias); ``step`` gives the gradient for both."""
    theta, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, STEPS + 1):
        g = step(theta[:-1], theta[-1])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:-1], float(theta[-1])


def _slope(z: np.ndarray) -> np.ndarray:
    """Derivative of log(1 + exp(z))."""
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _gradient(rows: np.ndarray, each: np.ndarray) -> np.ndarray:
    return np.append(rows.T @ each, each.sum())


def fit_nn_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights that minimise the non-negative risk with the logistic loss."""

    def step(w, b):
        zp, zu = positive @ w + b, unlabelled @ w + b
        up = -_gradient(positive, _slope(-zp)) * prior / len(zp)
        rest = _gradient(unlabelled, _slope(zu)) / len(zu) - _gradient(positive, _slope(zp)) * prior / len(zp)
        risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        # Below zero the negative risk is fitted to chance: step back on it alone.
        return (up + rest if risk >= 0 else -rest) + DECAY * np.append(w, 0)

    return _descend(step, positive.shape[1])


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives among the unlabelled, from the best threshold of a separate half."""

    def step(w, b):
        zp, zu = positive[::2] @ w + b, unlabelled[::2] @ w + b
        return _gradient(unlabelled[::2], _slope(zu)) / len(zu) - _gradient(positive[::2], _slope(-zp)) / len(zp) + DECAY * np.append(w, 0)

    w, b = _descend(step, positive.shape[1])
    p, u = np.sort(positive[1::2] @ w + b), np.sort(unlabelled[1::2] @ w + b)
    if not len(p) or not len(u):
        return 0.5
    at = np.unique(p)
    above_p = 1 - np.searchsorted(p, at) / len(p)
    above_u = 1 - np.searchsorted(u, at) / len(u)
    chance = np.sqrt(np.log(4 / delta) / 2) * (len(p) ** -0.5 + len(u) ** -0.5)
    best = np.argmin((above_u + chance) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


def fold(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % FOLDS


def _sample(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, sample: int) -> np.ndarray:
    """Features of at most ``sample`` documents with these ids (at most ``sample`` rows)."""

    def run(batches):
        for batch in batches:
            rows = [features(t.as_py()).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["at", "row"])

    # The ids are bounded by the sample size, so the join needs no shuffle of texts.
    picked = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(ids), "__id", "left_semi")
    rows = picked.select(F.xxhash64("__id", "__text").alias("at"), "__text").mapInArrow(run, "at long, row binary")
    got = rows.orderBy("at", "row").limit(sample).select("row").collect()
    return np.array([np.frombuffer(r[0], np.float32) for r in got], np.float64).reshape(len(got), WIDTH)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """A model from the positives of ``labels`` and unlabelled ``docs``, both outside the held-out fold."""
    small_batches(docs.sparkSession)
    teach = lambda df: df.filter(fold(F.col(id_col)) != 0).select(F.col(id_col).alias("__id"))
    first = lambda df, salt: df.distinct().orderBy(F.xxhash64(F.lit(salt), "__id"), "__id").limit(sample)
    positive = _sample(docs, first(teach(labels.filter(F.col(label_col) == 1)), 1), id_col, text_col, sample)
    unlabelled = _sample(docs, first(teach(docs), 2), id_col, text_col, sample)
    if not len(positive) or not len(unlabelled):
        return UNFITTED
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 0.01
    # In place: the driver holds each sample once.
    for rows in (positive, unlabelled):
        rows -= mean
        rows /= scale
    prior = estimate_prior(positive, unlabelled)
    weight, bias = fit_nn_pu(positive, unlabelled, prior)
    del positive, unlabelled, rows
    give_back()
    return Model(mean, scale, weight, bias, prior)


def score(model: Model, text: Column) -> Column:
    """Scores from 0 to 1 of a text column."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        rows = [features(t) for t in texts]
        return pd.Series(model.score(np.stack(rows)) if rows else [], dtype="float64")

    return run(text)
