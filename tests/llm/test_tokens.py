import base64
import random

import numpy as np
import public_tokenizers
import pytest

from coralint.llm import byte_bpe, token_files

RANKS, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a   b \n c", "x\n \ny", "x\n\n y", "it's 's '' 12 3", "tab\tx \t y", "é ﬁ 日本語 😀", "a\x1cb \x85 c",
    "x\xa0 y", "<|endoftext|> b", "THE!! the.!", "\n", " \n", "a \n", "İstanbul Σ", "word " * 3000, "z" * 5000, "#" * 3000,
]


def texts(seed, n=150):
    r = random.Random(seed)
    return ["".join(r.choice(["a", "B", " ", "  ", "\n", "é", "1", ".", "'s", "\t", "ß", "#"]) for _ in range(r.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "k") for i, t in enumerate(ODD + texts(1))] + [(3, "twin row", "k")] * 2 + [(None, "no id", "k")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, ids string")


def test_byte_bpe_equals_the_library(docs):
    import tiktoken

    rows, df = docs
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for block_chars in (40, 10_000_000):  # many blocks, one block
        out = byte_bpe.decode(byte_bpe.encode(df, RANKS, public_tokenizers.PATTERN, block_chars=block_chars), RANKS)
        got = sorted(((r.doc_id, bytes(r.ids), r.n_tokens, bytes(r.decoded)) for r in out.collect()), key=str)
        want = [(i, enc.encode_ordinary(t or ""), t or "") for i, t, _ in rows]
        assert got == sorted(((i, np.array(x, "<u4").tobytes(), len(x), t.encode()) for i, x, t in want), key=str)


def test_packed_numbers_round_trip():
    v = np.array([0, 1, 127, 128, 16383, 16384, 2**21, 2**28, 2**35 - 1])
    assert (byte_bpe.unpack_numbers(byte_bpe.pack_numbers(v)[0]) == v).all()
    assert len(byte_bpe.unpack_numbers(b"")) == 0


def test_token_files_equal_the_library(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    rows, df = docs
    folder = str(tmp_path / "tokens")
    token_files.write_files(df, WORDS, folder, end_id=2)
    got = token_files.read_files(spark, folder).orderBy("start").collect()
    t = Tokenizer.from_file(WORDS)
    want = [(i, t.encode(x or "", add_special_tokens=False).ids + [2]) for i, x, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))]
    assert [r.key for r in got] == [i for i, _ in want]
    assert sorted((str(r.key), np.frombuffer(r.ids, "<u4").tolist()) for r in got) == sorted((str(i), x) for i, x in want)
    assert [r.start for r in got] == np.cumsum([0] + [len(x) for _, x in want])[:-1].tolist()


def test_ranked_coding_round_trips():
    rng = np.random.default_rng(3)
    for n in (0, 1, 3, 4, 5, 1000):
        v = rng.integers(0, 2 ** rng.integers(1, 32, n)).astype(np.uint32) if n else np.empty(0, np.uint32)
        control, data = token_files.encode_ranks(v)
        assert len(control) == -(-n // 4)
        assert (token_files.decode_ranks(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n) == v).all()


def test_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.decode(byte_bpe.encode(df, RANKS, public_tokenizers.PATTERN), RANKS).count() == 0
    token_files.write_files(df, WORDS, str(tmp_path / "none"), end_id=2)
    assert token_files.read_files(spark, str(tmp_path / "none")).count() == 0


def test_files_are_ordered_by_number(spark, tmp_path):
    from pyspark.sql import Row

    docs = spark.createDataFrame([Row(doc_id=1, text="one two"), Row(doc_id=2, text="three")])
    folder = str(tmp_path / "t")
    token_files.write_files(docs, public_tokenizers.path("word_bpe_49k.json"), folder, end_id=2)
    parts = sorted((tmp_path / "t" / "ids").glob("part-*"))
    content = b"".join(p.read_bytes() for p in parts)
    for p in parts:
        p.unlink()
    other = str(tmp_path / "u")
    token_files.write_files(docs.withColumn("doc_id", docs.doc_id - 10), public_tokenizers.path("word_bpe_49k.json"), other, end_id=2)
    (tmp_path / "t" / "ids" / "part-100000-x").write_bytes(content)
    first = b"".join(p.read_bytes() for p in sorted((tmp_path / "u" / "ids").glob("part-*")))
    (tmp_path / "t" / "ids" / "part-99999-x").write_bytes(first)
    got = sorted((r.start, r.key) for r in token_files.read_files(spark, folder).collect())
    assert [k for _, k in got] == [-9, -8, 1, 2] and got[0][0] == 0
