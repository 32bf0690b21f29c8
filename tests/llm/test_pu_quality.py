import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from coralint.llm import pu_quality as Q


def corpus(n=900):
    r = random.Random(4)
    word = lambda: "".join(r.choice(["tion", "re", "an", "the", "er", "st"]) for _ in range(r.randint(1, 4)))
    rows = []
    for i in range(n):
        words, good = [word() for _ in range(r.randint(5, 120))], r.random() < 0.8
        if not good:
            words = r.choice([[w + "###" for w in words], [words[0]] * len(words), [w.upper() + "!!" for w in words]])
        rows.append((i, " ".join(words), int(good)))
    return rows


def test_held_out_accuracy_from_positives_only(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i % 2], "doc_id long, quality int")
    model = Q.fit(docs, labels)
    assert 0.65 < model.prior < 0.95
    same = Q.fit(docs, labels.filter("quality = 1"))  # negative labels play no part
    assert np.array_equal(model.weight, same.weight)
    got = docs.select("doc_id", Q.fold(F.col("doc_id")).alias("fold"), Q.score(model, F.col("text")).alias("s")).collect()
    truth = {i: q for i, _, q in rows}
    assert all(r.fold == zlib.crc32(str(r.doc_id).encode()) % 5 for r in got)
    held = [(truth[r.doc_id], r.s) for r in got if r.fold == 0]
    assert np.mean([(s >= 0.3) == bool(q) for q, s in held]) > 0.93
    assert np.mean([s >= 0.3 for q, s in held if q]) > 0.98


def test_risk_is_non_negative_and_prior_is_found():
    rng = np.random.default_rng(1)
    p = rng.normal(1.5, 1, (800, 3))
    u = np.concatenate([rng.normal(1.5, 1, (480, 3)), rng.normal(-1.5, 1, (320, 3))])[rng.permutation(800)]
    assert abs(Q.estimate_prior(p, u) - 0.6) < 0.12
    w, b = Q.fit_nn_pu(p, u, 0.6)
    risk = np.logaddexp(0, u @ w + b).mean() - 0.6 * np.logaddexp(0, p @ w + b).mean()
    assert risk > -0.02


@pytest.mark.parametrize("labels", [[], [(1, 0)], [(None, 1), (77, None)]])
def test_nothing_to_learn_from(spark, labels):
    docs = spark.createDataFrame([(1, None, 0.5), (None, "", 0.1), (3, "x" * 100_000, 0.2), (3, "x", 0.2)], "doc_id long, text string, score double")
    model = Q.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = docs.select(Q.score(model, F.col("text")).alias("s")).collect()
    assert len(got) == 4 and all(r.s == 0.5 for r in got)
    assert docs.limit(0).select(Q.score(model, F.col("text"))).count() == 0
