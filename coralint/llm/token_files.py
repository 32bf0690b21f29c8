"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

Ids are replaced by their frequency rank in the corpus, so frequent ids take one byte. Each rank
takes 1 to 4 data bytes; their lengths, two bits each, stand apart in control bytes. A table over
the 256 control bytes gives the lengths of four ranks at once, so numpy decodes without a loop over
ids.

A folder holds ``ids/`` (ordered files of blocks), and ``ranks/`` (the id of each rank). Files are
written by Spark's text writer, one block a row, so that its commit protocol keeps out attempts
that failed, on any file system; a block starts with its own lengths and the row ends with one
newline. Files follow each other in the order of document ids.

Scale: texts are tokenised once and the ids stored; counts are summed per task by numpy and once
more by Spark (one row per id: the vocabulary is the bound); documents are range-partitioned by id.
The only thing kept whole is the rank table, whose size is that of the vocabulary.

Defined results: null texts are empty (just the end id); null document ids come first and are kept;
documents with equal ids are ordered by their ids' bytes; an empty table gives no blocks.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coralint.llm.common import shared_folder, small_batches, stored

MAGIC = b"CTI1"
BLOCK_IDS = 2_000_000
FILE_BYTES = 16 << 20
# Words that a worker remembers; beyond it starts afresh, which costs time and changes nothing.
WORDS = 1_000_000
_SAFE_BLANK = re.compile(r"[ \n]")
# The words of the tokenizer's own pattern, once a text is in lower case ..
_LETTERS = re.escape("".join(c for c in map(chr, range(0x2B0)) if re.fullmatch(r"[^\W\d_]", c)))
_WORD = re.compile(rf"[{_LETTERS}]++|[0-9]|'(?:s|t|re|ve|m|ll|d)|(?:[^\w\s]|_)++")
# .. except in texts that hold a special token, letters that may need composing or have no single lower
# case, numbers that Python takes for letters, or blanks that only Python takes for white space.
_SPECIAL = re.compile("<\\||[\x1c-\x1f\u00b2\u00b3\u00b9\u00bc-\u00be\u0130\u02b0-\U0010ffff]")

# Lengths of the four numbers that a control byte describes.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


# ------------------------------------------------------------------ coding


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit numbers."""
    v = ranks.astype(np.uint32)
    size = 1 + (v > 0xFF).astype(np.int64) + (v > 0xFFFF) + (v > 0xFFFFFF)
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    codes[: len(v)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    at = np.cumsum(size) - size
    data = np.empty(int(size.sum()), np.uint8)
    for k in range(4):
        here = size > k
        data[at[here] + k] = (v[here] >> np.uint32(8 * k)).astype(np.uint8)
    return control.tobytes(), data.tobytes()


def decode_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    size = LENGTHS[control].ravel()[:n]
    at = np.cumsum(size) - size
    out = np.zeros(n, np.uint32)
    for k in range(4):
        here = size > k
        if not here.any():
            break
        out[here] |= data[at[here] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def write_block(keys: list[int | None], ids: list[np.ndarray], rank: np.ndarray) -> bytes:
    """magic, documents, ids, data bytes | keys, null flags, lengths | control | data."""
    flat = np.concatenate(ids) if ids else np.empty(0, np.uint32)
    control, data = encode_ranks(rank[flat])
    head = np.array([len(keys), len(flat), len(data)], "<u8").tobytes()
    return b"".join((
        MAGIC, head,
        np.array([k or 0 for k in keys], "<i8").tobytes(),
        np.array([k is None for k in keys], np.uint8).tobytes(),
        np.array([len(x) for x in ids], "<u8").tobytes(),
        control, data,
    ))


def block_sizes(content: bytes):
    """(place, documents, ids, data bytes) of every block of a file, from the heads alone."""
    at = 0
    while at < len(content):
        if content[at : at + 4] != MAGIC:
            raise ValueError(f"no block at byte {at}")
        n, m, size = map(int, np.frombuffer(content, "<u8", 3, at + 4))
        yield at + 28, n, m, size
        at += 28 + 17 * n + -(-m // 4) + size + 1  # the row's newline


def read_blocks(content: bytes, id_of: np.ndarray):
    """(key, ids) of every document of a file, in order."""
    for at, n, m, size in block_sizes(content):
        keys = np.frombuffer(content, "<i8", n, at)
        null = np.frombuffer(content, np.uint8, n, at + 8 * n)
        lengths = np.frombuffer(content, "<u8", n, at + 9 * n).astype(np.int64)
        at += 17 * n
        control = np.frombuffer(content, np.uint8, -(-m // 4), at)
        at += len(control)
        ids = id_of[decode_ranks(control, np.frombuffer(content, np.uint8, size, at), m)]
        ends = np.cumsum(lengths)
        for i in range(n):
            yield (None if null[i] else int(keys[i])), ids[ends[i] - lengths[i] : ends[i]]


# ------------------------------------------------------------------ tokens


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def id_width(path: str) -> str:
    """Two bytes an id where the vocabulary allows, else four."""
    return "<u2" if _tokenizer(path).get_vocab_size() <= 1 << 16 else "<u4"


def _is_plain(text: str) -> bool:
    if text.isascii():
        return "<|" not in text and not any(c in text for c in "\x1c\x1d\x1e\x1f")
    return not _SPECIAL.search(text)


class _Words:
    """Ids of words, as bytes, for a worker process.

    The tokenizer lower-cases, drops white space, and encodes each match of its pattern by itself. So
    plain texts are cut into words here, and unknown words are encoded many in one call by the same
    model without the normaliser, whose work is done. Other texts go through the tokenizer itself,
    blank by blank.
    """

    def __init__(self, path: str):
        from tokenizers import pre_tokenizers

        self.width, self.whole = id_width(path), _tokenizer(path)
        self.plain = type(self.whole).from_str(self.whole.to_str())
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        suffix = getattr(self.whole.model, "end_of_word_suffix", None)
        self.last = np.zeros(self.whole.get_vocab_size(), bool)
        for token, i in self.whole.get_vocab().items():
            self.last[i] = bool(suffix) and token.endswith(suffix)
        self.known: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        ids = np.array(self.plain.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, self.width)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words):
            self.known.update((w, self.alone(w)) for w in words)
            return
        raw, size, a = ids.tobytes(), ids.itemsize, 0
        for w, b in zip(words, (ends * size).tolist()):
            self.known[w] = raw[a:b]
            a = b

    def alone(self, span: str) -> bytes:
        return np.array(self.whole.encode(span, add_special_tokens=False).ids, self.width).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > WORDS:
            self.known.clear()
        cut = [_WORD.findall(t.lower()) if _is_plain(t) else None for t in texts]
        if fresh := set().union(*(c for c in cut if c)) - self.known.keys():
            self.learn(list(fresh))
        get = self.known.__getitem__
        return [
            b"".join(map(self.alone, filter(None, _SAFE_BLANK.split(t)))) if c is None else b"".join(map(get, c))
            for t, c in zip(texts, cut)
        ]


@lru_cache(maxsize=2)
def _words(path: str) -> _Words:
    """One memory per worker process, kept from task to task."""
    return _Words(path)


def tokenize(docs: DataFrame, vocabulary: str, end_id: int | None, id_col: str, text_col: str) -> DataFrame:
    """(key, ids): ids as little-endian integers of ``id_width``, the end id last.

    This gives what the tokenizer gives on the whole text.
    """
    small_batches(docs.sparkSession)
    end = b"" if end_id is None else np.array([end_id], id_width(vocabulary)).tobytes()

    def run(batches):
        words = _words(vocabulary)
        for batch in batches:
            ids = [x + end for x in words.encode([t.as_py() or "" for t in batch.column(1)])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["key", "ids"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "key long, ids binary")


def _count(width: str):
    def run(batches):
        total = np.zeros(1, np.int64)
        for batch in batches:
            for x in batch.column(0):
                one = np.bincount(np.frombuffer(x.as_py(), width))
                if len(one) > len(total):
                    total = np.concatenate((total, np.zeros(len(one) - len(total), np.int64)))
                total[: len(one)] += one
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(total[seen])], ["id", "n"])

    return run


def rank_table(tokens: DataFrame, width: str) -> list[int]:
    """Ids by falling frequency, ties by id. One entry per id of the vocabulary in use."""
    counted = tokens.select("ids").mapInArrow(_count(width), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return [r["id"] for r in counted.orderBy(F.desc("n"), "id").select("id").collect()]


# ------------------------------------------------------------------ files


def write_files(docs: DataFrame, vocabulary: str, folder: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenise ``docs`` and write the folder."""
    spark = docs.sparkSession
    tokens = stored(tokenize(docs, vocabulary, end_id, id_col, text_col), "token-ids")
    width = id_width(vocabulary)
    id_of = rank_table(tokens, width)
    spark.createDataFrame([(r, i) for r, i in enumerate(id_of)], "rank long, id long").coalesce(1).write.parquet(f"{folder}/ranks")
    rank = np.zeros(max(id_of, default=0) + 1, np.uint32)
    rank[np.array(id_of, np.int64)] = np.arange(len(id_of))

    def blocks(batches):
        keys, ids, size = [], [], 0
        for batch in batches:
            for key, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys.append(key)
                ids.append(np.frombuffer(x.as_py(), width))
                size += len(ids[-1])
                if size >= BLOCK_IDS:
                    yield pa.RecordBatch.from_arrays([pa.array([write_block(keys, ids, rank)], pa.binary())], ["block"])
                    keys, ids, size = [], [], 0
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array([write_block(keys, ids, rank)], pa.binary())], ["block"])

    total = tokens.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    n_ids = int(total) // np.dtype(width).itemsize
    files = max(1, -(-n_ids * 8 // 5 // FILE_BYTES))  # some 1.6 bytes an id
    # Range bounds come from a sample of their columns at the driver, so a few bytes stand for the ids there;
    # they order rows of one key as the ids do, and rows that agree in them share a partition.
    key = F.col("key").asc_nulls_first()
    ordered = tokens.repartitionByRange(files, key, F.substring("ids", 1, 16)).sortWithinPartitions(key, "ids")
    # The text writer puts out a string's bytes as they are.
    ordered.mapInArrow(blocks, "block binary").select(F.col("block").cast("string")).write.option("lineSep", "\n").text(f"{folder}/ids")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(key, ids, n_tokens, start) of every document, from the files alone.

    ``start`` counts the ids of all documents before it: per-file totals are summed in file order,
    one row per file.
    """
    table = spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()
    id_of = np.array([r["id"] for r in table], np.uint32)

    def documents(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys, ids, lengths = [], [], []

                def flush():
                    n = len(keys)
                    size = np.array(lengths, np.int64)
                    starts = done + np.cumsum(size) - size
                    return pa.RecordBatch.from_arrays(
                        [pa.array([name] * n), pa.array(keys, pa.int64()), pa.array(ids, pa.binary()), pa.array(size), pa.array(starts)],
                        ["file", "key", "ids", "n_tokens", "at"],
                    )

                done = held = 0
                for key, x in read_blocks(content.as_py(), id_of):
                    keys.append(key)
                    ids.append(x.astype("<u4").tobytes())
                    lengths.append(len(x))
                    held += len(x)
                    if held >= BLOCK_IDS:
                        yield flush()
                        done += held
                        keys, ids, lengths, held = [], [], [], 0
                if keys:
                    yield flush()

    # A file is one value here; batches are bounded in bytes.
    files = spark.read.format("binaryFile").load(f"{folder}/ids/part-*").select("path", "content")
    rows = files.mapInArrow(documents, "file string, key long, ids binary, n_tokens long, at long")

    def heads(batches):
        for batch in batches:
            total = [sum(b[2] for b in block_sizes(c.as_py())) for c in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64())], ["file", "total"])

    totals = files.mapInArrow(heads, "file string, total long")
    # Part numbers rise with the id range, in name order only up to 99,999; one row per file.
    number = F.regexp_extract("file", r"part-(\d+)[^/]*$", 1).cast("long")
    before = F.coalesce(F.sum("total").over(W.orderBy(number, "file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    begins = stored(totals.select(F.col("file").alias("f"), before.alias("begin")), "file-starts")
    return rows.join(begins, F.col("file") == F.col("f")).select("key", "ids", "n_tokens", (F.col("begin") + F.col("at")).alias("start"))


def crc32_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def new_folder(spark: SparkSession) -> str:
    return shared_folder(spark, "token-files")
