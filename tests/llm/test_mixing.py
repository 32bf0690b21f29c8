import hashlib
import re

import pytest
from pyspark.sql import functions as F

from coralint.llm.mixing import mix, mix_plan


def brute(rows):
    """Words taken by (id, size), service order simulated copy by copy."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    items = []
    for i, text, source in rows:
        name = "null" if i is None else str(i)
        order = int(hashlib.md5(f"mix-{name}".encode()).hexdigest()[:12], 16)
        items.append((source, order, i, len(word.findall(text or ""))))
    sizes = {}
    for s, _, _, n in items:
        sizes[s] = sizes.get(s, 0) + n
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    budget, capped = 1.5 * sum(sizes.values()), set()
    while True:
        left = budget - sum(2 * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        level = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if 2 * sizes[s] <= level * weight[s]}
        if not over:
            break
        capped |= over
    target = {s: 2.0 * sizes[s] if s in capped else level * weight[s] for s in names}
    queue = []
    for s in names:
        for copy in (1, 2):
            at = (copy - 1) * sizes[s]
            for _, order, i, n in sorted((x for x in items if x[0] == s), key=lambda x: (x[1], x[2] is not None, x[2] or 0, x[3])):
                at += n
                queue.append((at / target[s] if target[s] else -1, names.index(s), copy, order, i, n))
    taken, total = {}, 0
    for _, k, _, _, i, n in sorted(queue, key=lambda q: q[:4]):
        total += n
        if total <= round(sum(target.values())):
            taken[i] = taken.get(i, 0) + n
    return target, taken


CASES = {
    "plain": [(i, "w " * (i % 7 + 1), f"s{i % 4}") for i in range(60)],
    "hot": [(i, "w " * (i % 5), "big" if i % 3 else None) for i in range(80)],
    "one": [(1, "a b c", "x")],
    "empties": [(1, None, "x"), (2, "", None), (3, " \t", "y")],
    "none": [],
}


@pytest.mark.parametrize("name", CASES)
def test_against_simulation(spark, name):
    rows = CASES[name]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix_plan(df).groupBy("id", "source", "target").agg(F.sum(F.when(F.col("chosen"), F.col("size")).otherwise(0)).alias("n")).collect()
    target, taken = brute(rows)
    assert {r["id"]: r["n"] for r in got} == {i: taken.get(i, 0) for i, _, _ in rows}
    assert all(r["target"] == pytest.approx(target[r["source"]]) for r in got)


def test_rows_come_with_their_copies_and_reruns_agree(spark):
    rows = [(i % 9, f"w{i} x y", "s", "c") for i in range(9)] + [(1, "w1 x y", "s", "c")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copy string")
    one, two = (sorted((tuple(r) for r in mix(df).collect()), key=str) for _ in range(2))
    assert one == two
    assert sum(len(r[1].split()) for r in one) == pytest.approx(1.5 * 36, abs=3)
    assert sum(r[0] == 1 for r in one) <= 8
