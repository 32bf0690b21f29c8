import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from coralint.llm import ann, components, metric_join


def brute_links(rows, cosine=0.95):
    ok = lambda v: v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    unit = [np.array(v) / math.hypot(*v) if ok(v) else None for _, v in rows]
    n = len(rows)
    link = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        for k in todo:
            todo.extend(j for j in link[k] if j not in seen)
            seen.update(link[k])
        least = min(rows[j][0] for j in seen)
        out.append((rows[i][0], len(link[i]), least, least == rows[i][0]))
    return sorted(out)


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dim))
    rows = [(int(i), (centres[i % 6] + 0.12 * rng.standard_normal(dim) * (i % 3)).tolist()) for i in rng.permutation(n)]
    return rows + [(n + k, [x * 3 for x in rows[k][1]]) for k in range(5)] + [(n + 10 + k, rows[0][1]) for k in range(6)]


ODD = [(0, None), (1, [0.0, 0.0]), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [1.0, 0.0]), (6, [2.0, 0.0]), (7, [1.0, 0.0, 0.0]), (8, []), (9, [1e-300, 0.0]), (10, [1.0, 0.0, 0.0])]


@pytest.mark.parametrize("rows", [clustered(150, 8, 1), ODD, []], ids=["clusters", "odd", "empty"])
@pytest.mark.parametrize("chunk", [16, 2048])
def test_range_join_is_exact(spark, rows, chunk, monkeypatch):
    monkeypatch.setattr(metric_join, "CHUNK", chunk)
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, cell string, n int")
    got = metric_join.near_duplicates(df)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect())) == brute_links(rows)


def test_repeated_ids_are_vectors_of_their_own(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, metric_join.near_duplicates(df).collect())) == [(1, 0, 1, True), (1, 1, 1, True), (1, 1, 1, True)]


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (5000, 5000), (1, 0)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}


def test_nearest_recall_order_and_ties(spark):
    rng = np.random.default_rng(5)
    m = rng.standard_normal((1500, 24)) * rng.uniform(0.5, 2, (1500, 1))
    m[100:160] = m[100]  # ties
    df = spark.createDataFrame([(i, v.tolist(), "c") for i, v in enumerate(m)], "vec_id long, embedding array<double>, code string")
    got = ann.nearest(df, F.expr("id % 20 = 0"), k=20).orderBy("query_id", "rank").collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    for q in range(0, 1500, 20):
        exact = (m * m[q]).sum(axis=1)
        best = [i for i in np.lexsort((np.arange(1500), -exact)) if i != q][:20]
        hits += len(set(best) & {v for _, v, _ in found[q]})
        assert [r for r, _, _ in found[q]] == list(range(1, 21))
        assert [(-s, v) for _, v, s in found[q]] == sorted((-s, v) for _, v, s in found[q])
        assert all(s == exact[v] for _, v, s in found[q])
    assert hits / (75 * 20) >= 0.98


def test_few_candidates_and_odd_vectors(spark):
    rows = [*ODD, (20, [0.5, 0.5]), (20, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.expr("id % 20 = 0")).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(20, 1, 6, 1.0), (20, 2, 5, 0.5), (20, 3, 9, 0.5e-300)]
    assert ann.nearest(df.limit(0), F.expr("id % 20 = 0")).count() == 0
