import random
from collections import Counter

import numpy as np
import pytest

from coralint.llm import bag_minhash as B


def shingles(text, size=5):
    w = (text or "").lower().split()
    k = min(size, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def brute(rows):
    bags = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            low, high = sum((bags[i] & bags[j]).values()), sum((bags[i] | bags[j]).values())
            if low >= 0.8 * high - 1e-9:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = d if r not in least or least[r] is None or (d is not None and d < least[r]) else least[r]
    return sorted(((d, least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    fresh = lambda n: [r.choice(words) for _ in range(n)]
    texts = [" ".join(fresh(r.randint(0, 80))) for _ in range(40)]
    base = fresh(200)
    for k in range(60):  # one large group of near copies at many distances
        near = list(base)
        for _ in range(r.randint(0, 14)):
            near[r.randrange(200)] = r.choice(words)
        texts.append(" ".join(near))
    passage = " ".join(fresh(60))
    texts += [f"{' '.join(fresh(r.randint(20, 90)))} {passage}" for _ in range(30)]  # a shared passage
    texts += [("again and " * r.randint(20, 60)).strip() for _ in range(20)]  # few shingles, many times
    texts += texts[:10] + [texts[50]] * 20 + [None, "", "  ", "one", "One", "two words", "x " * 20_000]
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("chunk", [5, 1500])
def test_classes_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(B, "PER_CHUNK", chunk)
    monkeypatch.setattr(B, "PER_HUB", chunk)
    rows = corpus(7)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, c string, bands int")
    got = B.near_duplicates(df).collect()
    assert sorted(((r.doc_id, r.class_id) for r in got), key=str) == brute(rows)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)


def test_repeated_rows_null_ids_and_one_row_per_group(spark):
    t = " ".join(f"w{k}" for k in range(30))
    rows = [(5, t), (5, t), (None, t), (9, t + " more"), (2, "alone in the world of words"), (None, "nobody"), (3, None), (4, " ")]
    df = spark.createDataFrame([(i, x, "k") for i, x in rows], "doc_id long, text string, k1 string")
    got = sorted(((r.doc_id, r.class_id) for r in B.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 5), (5, 5), (None, 5), (9, 5), (2, 2), (None, None), (3, 3), (4, 3)], key=str)
    kept = B.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id) for r in kept.collect())) == ["2", "3", "5", "None"]
    assert B.near_duplicates(df.limit(0)).count() == 0


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    wa, wb = rng.integers(1, 9, len(a)), rng.integers(1, 9, len(a))
    true = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    s = B.signatures([(a, wa), (a, wb), (a[:1], np.array([1])), (a[:0], wa[:0])], slots=4096)
    assert abs((s[0] == s[1]).mean() - true) < 0.03
    assert np.isfinite(s[2]).all() and np.isinf(s[3]).all()


def test_buckets_of_one_large_group_are_dealt_once(spark, monkeypatch):
    monkeypatch.setattr(B, "PER_CHUNK", 5)
    schema = "band int, h long, largest long, in_largest boolean, c long, component long"
    # One group fills a bucket in every band, with one outsider; another has small buckets of few members each.
    hot = [(band, 100 + band, 0, c < 20, c, 0 if c < 20 else c) for band in range(42) for c in range(21)]
    thin = [(0, 1000 + c, 50, c < 90, c, 50 if c < 90 else c) for c in range(50, 90)]
    thin += [(0, 1000 + c, 50, False, 100 + c, 100 + c) for c in range(50, 90)]
    got = B._merged(spark.createDataFrame(hot + thin, schema)).collect()
    merged = [r for r in got if r.band == B.MERGED]
    assert sorted(r.c for r in merged) == list(range(21)) and {r.h for r in merged} == {0}
    assert len(got) == 21 + 80
