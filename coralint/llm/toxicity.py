"""Toxicity scores: subword-bag embeddings averaged into a linear softmax.

A word is the mean of the vectors of its character n-grams and of itself, a text the mean of its words'
vectors, and a linear softmax on it gives the classes. Vectors and softmax are trained jointly, in numpy, by
gradient descent with momentum on all sampled texts. A misspelt or unseen word shares most n-grams with the
words it resembles, and so their vectors. N-grams of fewer than ``MIN_TEXTS`` texts teach nothing, and a vector
moves in steps that shrink with its n-gram's usual share of a text, so that rare n-grams are learnt as well as
common ones.

Scale: the model is fitted on at most ``SAMPLE`` labelled texts, clean and toxic, chosen by hash order; each class
weighs as it does among all labels that may teach. More clean texts are taken, as they are the more varied. What reaches the driver is their
n-grams' shares, packed, at most ``BUCKETS`` of a text. Scoring is one pass over all whole texts, without a shuffle. A linear softmax of a mean is a
mean of what each word adds, so a task looks a word's part up once and keeps it in a table that is cleared at
``TABLE_WORDS`` entries.

Defined results: texts that are null or have no words get the score of the softmax's bias; without labels of both
classes every score is 0.5; null ids and ids without labels are scored like all others and never teach; an id
with both labels teaches the higher one; a repeated document teaches once for each row within the sample;
repeated rows get equal scores; an empty table gives an empty table; only the id and text columns are read,
whatever else there is.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coralint.llm.common import small_batches

SAMPLE = (3000, 2000)  # labelled texts, clean and toxic
BUCKETS = 1 << 17  # hashed n-grams
DIM = 4
GRAMS = (3, 4, 5)
MIN_TEXTS = 12
STEPS, MOMENTUM, EVENING = 100, 0.96, 0.6
TABLE_WORDS = 400_000
FOLDS = 3
WORDS = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def grams_of(word: str) -> list[int]:
    """Buckets of a word's character n-grams and of the word itself."""
    marked = f"<{word}>"
    grams = [marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)]
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) % BUCKETS for g in (*grams, marked)]


@dataclass(frozen=True)
class Model:
    """What each bucket and the bias add to the difference of the two classes' logits."""

    gain: np.ndarray
    bias: float

    def part(self, word: str) -> float:
        return float(self.gain[grams_of(word)].mean())

    def score(self, text: str | None, parts: dict[str, float]) -> float:
        words = words_of(text)
        z = self.bias + (sum(map(parts.__getitem__, words)) / len(words) if words else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


class Parts(dict):
    """The model's part of each word, worked out at its first use."""

    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, word):
        p = self[word] = self.model.part(word)
        return p


UNFITTED = Model(np.zeros(BUCKETS, np.float32), 0.0)


# ------------------------------------------------------------------ training


ENTRIES = 1 << 20  # of a product that are worked on at once


def bag_of(text: str | None) -> tuple[bytes, bytes]:
    """A text's buckets (32-bit integers, ascending) and their shares of it (32-bit floats)."""
    counts = Counter(words_of(text))
    if not counts:
        return b"", b""
    grams = [np.array(grams_of(w), np.int32) for w in counts]
    total = sum(counts.values())
    each = np.repeat([n / total / len(g) for n, g in zip(counts.values(), grams)], [len(g) for g in grams])
    at, back = np.unique(np.concatenate(grams), return_inverse=True)
    return at.astype("<i4").tobytes(), np.bincount(back, each, len(at)).astype("<f4").tobytes()


class Bags:
    """Texts as rows of bucket shares; products with a vector from either side."""

    def __init__(self, bags: list[tuple[bytes, bytes]]):
        sizes = [len(at) // 4 for at, _ in bags]
        self.rows = len(bags)
        self.row = np.repeat(np.arange(self.rows, dtype=np.int32), sizes)
        self.place = np.frombuffer(b"".join(at for at, _ in bags), "<i4")
        self.share = np.frombuffer(b"".join(share for _, share in bags), "<f4")

    def keep(self, wanted: np.ndarray) -> None:
        here = wanted[self.place]
        self.row, self.place, self.share = self.row[here], self.place[here], self.share[here]

    def scale(self, by: np.ndarray) -> None:
        self.share = self.share * by.astype(np.float32)[self.place]

    def _sums(self, out: np.ndarray, target: np.ndarray, source: np.ndarray, x: np.ndarray) -> np.ndarray:
        for a in range(0, len(target), ENTRIES):
            part = slice(a, a + ENTRIES)
            out += np.bincount(target[part], self.share[part] * x[source[part]], len(out))
        return out

    def times(self, x: np.ndarray) -> np.ndarray:
        return self._sums(np.zeros(self.rows), self.row, self.place, x)

    def back(self, x: np.ndarray) -> np.ndarray:
        return self._sums(np.zeros(BUCKETS), self.place, self.row, x)

    def usual(self) -> np.ndarray:
        """Root mean square of each bucket's share."""
        sums = np.zeros(BUCKETS)
        for a in range(0, len(self.place), ENTRIES):
            part = slice(a, a + ENTRIES)
            sums += np.bincount(self.place[part], self.share[part].astype(np.float64) ** 2, BUCKETS)
        return np.sqrt(sums / self.rows)


def train(bags: Bags, labels: np.ndarray, class_weight: np.ndarray, steps: int = STEPS) -> Model:
    """Vectors and softmax that lower the weighted cross-entropy of the labels."""
    bags.keep(np.bincount(bags.place, minlength=BUCKETS) >= MIN_TEXTS)
    if not len(bags.place):
        return UNFITTED
    usual = bags.usual()
    middle = np.median(usual[usual > 0])
    even = np.where(usual > 0, (usual + middle) ** -EVENING * middle ** (EVENING - 1), 0.0)
    bags.scale(even)

    each = class_weight[labels] / class_weight[labels].sum()
    # The steepest curvature of the loss, by power iteration, bounds the step.
    curve = np.ones(BUCKETS)
    for _ in range(8):
        curve = bags.back(each * bags.times(curve / np.linalg.norm(curve)))
    rate = 4 / max(1e-12, float(np.linalg.norm(curve)))

    rng = np.random.default_rng(7)
    direction = rng.normal(size=DIM)
    softmax = np.outer(direction / np.linalg.norm(direction), [-0.5, 0.5])
    share = each @ labels
    bias = np.array([0.0, np.log(share / (1 - share))])
    vectors, hidden = np.zeros((BUCKETS, DIM)), np.zeros((bags.rows, DIM))
    # A step of the vectors is one column of slopes in a direction of the softmax, so the texts'
    # vectors follow from one product.
    run_vectors, run_hidden, run_softmax = np.zeros_like(vectors), np.zeros_like(hidden), np.zeros_like(softmax)
    goal = np.eye(2)[labels]
    for _ in range(steps):
        z = hidden @ softmax + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        error = (p / p.sum(axis=1, keepdims=True) - goal) * each[:, None]
        slope, towards = bags.back(error[:, 1]), softmax[:, 1] - softmax[:, 0]
        run_vectors = MOMENTUM * run_vectors + np.outer(slope, towards)
        run_hidden = MOMENTUM * run_hidden + np.outer(bags.times(slope), towards)
        run_softmax = MOMENTUM * run_softmax + hidden.T @ error
        vectors -= rate * run_vectors
        hidden -= rate * run_hidden
        softmax = softmax - 0.01 * run_softmax
    gain = even * (vectors @ (softmax[:, 1] - softmax[:, 0]))
    return Model(gain.astype(np.float32), float(bias[1] - bias[0]))


def fold(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % FOLDS


def _packed(batches):
    for batch in batches:
        at, share = zip(*map(bag_of, batch.column(2).to_pylist())) if batch.num_rows else ((), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.binary()), pa.array(share, pa.binary())], ["nth", "at", "share"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out: int = 1, sample: int | tuple[int, int] = SAMPLE) -> Model:
    """A model from the labelled texts outside the held-out fold, at most ``sample`` (of each class, or clean and toxic)."""
    most = (sample, sample) if isinstance(sample, int) else sample
    small_batches(docs.sparkSession)
    teach = labels.filter((fold(F.col(id_col)) != held_out) & F.col(label_col).isin(0, 1))
    teach = teach.groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__label"))
    shares = {r["__label"]: r["count"] for r in teach.groupBy("__label").count().collect()}
    bags, marks = [], []
    for label in sorted(shares):
        picked = teach.filter(F.col("__label") == label).orderBy(F.xxhash64(F.lit(3), "__id"), "__id").limit(most[label])
        # The ids are bounded by the sample, so the join needs no shuffle of texts.
        found = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(picked), "__id")
        packed = found.select(F.xxhash64("__id", "__text").alias("nth"), "__label", "__text").mapInArrow(_packed, "nth long, at binary, share binary")
        # Rows that agree in the order are equal.
        for r in packed.orderBy("nth", "at", "share").limit(most[label]).collect():
            bags.append((bytes(r["at"]), bytes(r["share"])))
            marks.append(label)
    marks = np.array(marks, np.int64)
    if set(marks.tolist()) != {0, 1}:
        return UNFITTED
    weight = np.array([shares[c] / (marks == c).sum() for c in (0, 1)])
    return train(Bags(bags), marks, weight)


def score(model: Model, text: Column) -> Column:
    """Scores from 0 to 1 of a text column: how likely the text is toxic."""
    gain, bias = model.gain.tobytes(), model.bias

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        parts = _parts_of(bias, gain)
        out = []
        for t in texts:
            out.append(parts.model.score(t, parts))
            if len(parts) > TABLE_WORDS:
                parts.clear()
        return pd.Series(out, dtype="float64")

    return run(text)


@lru_cache(maxsize=1)
def _parts_of(bias: float, gain: bytes) -> Parts:
    """The words' parts, kept from batch to batch of a worker."""
    return Parts(Model(np.frombuffer(gain, np.float32), bias))
