import random

import numpy as np
from pyspark.sql import functions as F

from coralint.llm import toxicity as T


def corpus(n, seed=1, bad=("vermin", "imbecile", "rotten")):
    rng = random.Random(seed)
    syllables = ["ba", "ter", "lo", "min", "sha", "ron", "ti", "ken", "wo", "rel"]
    rows = []
    for i in range(n):
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.choice([8, 60, 200]))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(max(2, len(words) // 25)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_products_equal_a_dense_matrix():
    texts = ["abc abd Abc", "", "xyz " * 5]
    bags = T.Bags([T.bag_of(t) for t in texts])
    dense = np.zeros((3, T.BUCKETS))
    for i, t in enumerate(texts):
        for word in t.lower().split():
            for g in T.grams_of(word):
                dense[i, g] += 1 / len(t.split()) / len(T.grams_of(word))
    x, y = np.random.default_rng(1).normal(size=T.BUCKETS), np.array([1.0, -2.0, 0.5])
    assert np.allclose(bags.times(x), dense @ x, atol=1e-5) and np.allclose(bags.back(y), dense.T @ y, atol=1e-5)
    assert np.allclose(bags.usual(), np.sqrt((dense**2).mean(axis=0)), atol=1e-5)


def test_held_out_accuracy_and_misspellings(spark):
    rows = corpus(900)
    docs = spark.createDataFrame([(i, t, "z") for i, t, _ in rows], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = T.fit(docs, labels)
    scored = docs.select("doc_id", T.fold(F.col("doc_id")).alias("fold"), T.score(model, F.col("text")).alias("score")).collect()
    truth = {i: y for i, _, y in rows}
    held = [(r.score >= 0.5) == truth[r.doc_id] for r in scored if r.fold == 1]
    assert len(held) > 200 and np.mean(held) > 0.97
    parts = T.Parts(model)
    clean = [t for _, t, y in corpus(400, seed=2) if not y and len(t.split()) == 60]
    assert np.mean([model.score(t, parts) < 0.5 for t in clean]) > 0.97
    assert np.mean([model.score(f"{t} imbecille vermiin vermiin", parts) > 0.5 for t in clean]) > 0.8
    assert min(parts["imbecille"], parts["vermiin"], parts["rottenn"]) > 2 * max(parts[w] for t in clean for w in t.split())


def test_order_and_repeats_do_not_change_the_score(spark):
    rows = corpus(200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    a, b = T.fit(docs, labels), T.fit(docs.orderBy(F.desc("doc_id")).repartition(3), labels.union(labels))
    assert np.allclose(a.gain, b.gain) and a.bias == b.bias
    assert len({r[0] for r in docs.limit(1).union(docs.limit(1)).select(T.score(a, F.col("text"))).collect()}) == 1


def test_a_bounded_sample_keeps_the_shares(spark):
    rows = corpus(400)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = T.fit(docs, labels, sample=50)
    assert abs(1 / (1 + np.exp(-model.bias)) - 0.25) < 0.05


def test_odd_inputs(spark):
    rows = corpus(120)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "vermin"), (500, None), (501, ""), (502, "¡!"), (503, "w" * 200_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (600, 1), (500, 0), (501, None)], "doc_id long, toxic int")
    model = T.fit(docs, labels)
    out = {r.doc_id: r.score for r in docs.select("doc_id", T.score(model, F.col("text")).alias("score")).collect()}
    assert len(out) == 125 and all(0 <= s <= 1 for s in out.values())
    assert out[500] == out[501] == out[502]
    nothing = T.fit(docs, labels.filter("toxic = 0"))
    assert {r[0] for r in docs.select(T.score(nothing, F.col("text"))).collect()} == {0.5}
    assert T.fit(docs.limit(0), labels.limit(0)) is T.UNFITTED
    assert docs.limit(0).select(T.score(model, F.col("text"))).count() == 0
