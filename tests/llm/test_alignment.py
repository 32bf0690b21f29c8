"""Alignment against a plain version that walks tokens one by one with the libraries."""

import hashlib
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from coralint.llm.alignment import align

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, block long, links string"


def plainly(rows):
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    stand_in = {v: k for k, v in t.get_vocab().items()}
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(b): b for b in keep} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in keep)}
    sp = sentencepiece.SentencePieceProcessor(model_file=B)

    def piece(i):
        s = sp.id_to_piece(i)
        return bytes([int(s[3:5], 16)]) if len(s) == 6 and s.startswith("<0x") else s.replace("▁", " ").encode()

    found, counts = [], Counter()
    for key, text in rows:
        whole = (" " + (text or "")).encode()
        a = t.encode(" " + (text or ""), add_special_tokens=False).ids
        b = sp.encode(text or "")
        spelled_a, spelled_b = [bytes(of[c] for c in stand_in[i]) for i in a], [piece(i) for i in b]
        if not text or b"".join(spelled_a) != whole or b"".join(spelled_b) != whole:
            found.append((key, [], [], [], ""))
            continue
        ends = []
        for spelled in (spelled_a, spelled_b):
            at, places = 0, {}
            for k, s in enumerate(spelled):
                at += len(s)
                places[at] = k
            ends.append(places)
        links, groups, pa, pb = [], [], 0, 0
        for end in sorted(ends[0].keys() & ends[1].keys()):
            x, y = ends[0][end], ends[1][end]
            links.append((a[x], b[y]))
            groups.append(",".join(map(str, a[pa : x + 1])) + "|" + ",".join(map(str, b[pb : y + 1])))
            pa, pb = x + 1, y + 1
        counts.update(links)
        found.append((key, a, b, links, ";".join(groups)))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return sorted(
        (str(k), len(a), len(b), len(l), len(l), sum(counts[p] == most[p[1]] for p in l), sum(counts[p] for p in l), g) for k, a, b, l, g in found
    )


def rows_of(df):
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in df.collect())


TEXTS = [
    "Plain words, plain words; tokenizers split them differently.", "naïve café — Привет мир 你好 🙂🙂", "", None, " ", "two  blanks\n\nand lines\t",
    "<|endoftext|> </s> <s> <unk> stays text", "ﬁ ligature and ½ and ｆｕｌｌ width", "x" * 3000, "1234567890 " * 200, "▁ the mark itself", "a\u0000b",
]


@pytest.mark.parametrize("block", [40, 2_000_000])
def test_equals_plain_version(spark, block):
    rows = [*enumerate(TEXTS), (3, TEXTS[0]), (None, TEXTS[0]), (0, TEXTS[0])]
    df = spark.createDataFrame([(k, t, 1, "z") for k, t in rows], SCHEMA).repartition(3)
    out = align(df, A, B, block_chars=block)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    assert rows_of(out) == plainly(rows)


def test_digest_is_of_the_groups(spark):
    df = spark.createDataFrame([(1, "some text of words"), (2, None)], "doc_id long, text string")
    whole = {r.doc_id: r.groups for r in align(df, A, B).collect()}
    digest = {r.doc_id: r.groups for r in align(df, A, B, groups=lambda c: F.sha2(c, 256)).collect()}
    assert digest == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in whole.items()}


def test_nothing_gives_nothing(spark):
    assert align(spark.createDataFrame([], SCHEMA), A, B).count() == 0


def test_only_texts_without_tokens(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert rows_of(align(df, A, B)) == [("1", 0, 0, 0, 0, 0, 0, ""), ("2", 0, 0, 0, 0, 0, 0, "")]
