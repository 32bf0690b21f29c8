"""Spelling variants against a plain version that compares all words."""

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from coralint.llm import spelling as S


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def plainly(words, ratio=10):
    near = {w: [v for v in words if abs(len(v) - len(w)) <= 1 and distance(v, w) == 1] for w in words}
    form = {}
    for w, found in near.items():
        if found:
            best = min(found, key=lambda v: (-words[v], v))
            if words[best] >= ratio * words[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w, ""), root(w), n, len(near[w]), words[form[w]] if w in form else -1) for w, n in words.items())


def rows_of(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


@settings(max_examples=300, deadline=None)
@given(st.text("ab", max_size=6), st.lists(st.text("ab", max_size=7), unique=True, max_size=40))
def test_scan_of_a_sorted_list(query, words):
    words = sorted(words)
    shared = [0, *map(S._common, words, words[1:])]
    assert list(S.near_in_list(query, words, shared)) == [i for i, w in enumerate(words) if distance(query, w) == 1]


def some_words(seed, letters, n):
    rng = random.Random(seed)
    out = {}
    for _ in range(n):
        word = "".join(rng.choices(letters, k=rng.randint(7, 9)))
        out[word] = rng.choice([2, 3, 20, 25, 300, 300, 4000])
        cut = rng.randrange(len(word))
        out[word[:cut] + rng.choice(letters) + word[cut + rng.randint(0, 1) :]] = rng.choice([2, 20])
    return {w: n for w, n in out.items() if len(w) >= 7}


@pytest.mark.parametrize("cell_words", [2, 15, 20_000])
def test_equals_all_comparisons(spark, cell_words):
    words = some_words(cell_words, "abé÷", 160) | {"sameendings" + "x" * k: 5 * 10**k for k in range(5)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows_of(S.variants(df, cell_words=cell_words)) == plainly(words)


def test_common_beginnings_are_split_without_loss(spark):
    words = {"commonstart" + a + b + c: 2 + 37 * (a == b) for a in "abcdef" for b in "abcdef" for c in "abcdef"}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows_of(S.variants(df, cell_words=8)) == plainly(words)


def test_words_of_texts(spark):
    rng = random.Random(5)
    pool = ["Spelling", "variants", "grouping", "ÀÉcole×÷word", "short", "x" * 4000]
    rows = [(i, " ".join(rng.choices(pool, k=30))) for i in range(200)] + [(None, "Spelling spelling"), (7, None), (7, ""), (1, "Grouping"), (1, "Grouping")]
    want = Counter()
    for i, text in rows:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), word)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            want[word] += 1
    want = {w: n for w, n in want.items() if len(w) >= 7 and n >= 2}
    df = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id long, text string, word string, n long").repartition(3)
    words = S.vocabulary(df, change=S.damaged)
    assert {r.word: r.n for r in words.collect()} == want
    assert rows_of(S.variants(words)) == plainly(want)
    assert {r.word for r in S.vocabulary(df, min_count=1).collect()} >= {"spelling", "x" * 4000}


def test_nothing_gives_nothing(spark):
    assert S.variants(S.vocabulary(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
