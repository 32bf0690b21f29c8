"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Texts are cut into pre-tokens with positions. Neighbouring documents form a block; inside a block a
document is the sequence of its words' numbers, and the block's words are listed once. The word
lists are shuffled by word hash over the whole corpus, each distinct word is encoded once where all
its mentions meet, the ids go back to the blocks, and the sequences are resolved by position.
Decoding looks the ids up in the token-byte table.

Why blocks: one row per pre-token and position would be some twenty times the text. A block sends a
word once however often it occurs, so a very frequent word costs a row entry per block, and no
reducer holds more than the words of its hash slot. Word lists travel packed per (block, slot).

Blocks are written to the shared folder, bucketed, before anything is derived from them. Their numbers depend
on the order in which a task reads its rows, so they must be fixed once; and a lost executor then
costs only its own tasks.

Bounds: a block is about ``block_chars`` of text (one longer document is a block of its own). The
vocabulary is a file of fixed size that each worker loads from ``vocabulary``.

Defined results: null texts are empty and give no ids; repeated rows and null ids are kept row by
row; an empty table gives an empty table; only the id column and the results are returned.
"""

from __future__ import annotations

import base64
import re
import uuid
import zlib
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coralint.llm.common import give_back, shared_folder, small_batches

BLOCK_CHARS = 6_000_000
# Spans whose numbers are remembered, and ids or words that are worked on at once.
SPANS, SLICE = 30_000, 1 << 17
# A single blank between two characters that are no white space always ends a pre-token.
_SAFE_BLANK = re.compile(r"(?<=\S) (?=\S)")
_ODD_BLANK = re.compile(r" \s|\s ")


@lru_cache(maxsize=4)
def vocabulary_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(maxsize=4)
def encoder_of(path: str):
    """Encodes one pre-token: the pattern takes any text as a whole."""
    import tiktoken

    return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=vocabulary_of(path), special_tokens={})


@lru_cache(maxsize=4)
def token_bytes(path: str) -> pa.Array:
    """The token-byte table, in id order; ids that are not in the file are empty."""
    ranks = vocabulary_of(path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return pa.array(table, pa.large_binary())


# ------------------------------------------------------------------ packing


def pack_numbers(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Seven bits a byte, the last byte of a number below 128; and the bytes of each number."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for bits in (7, 14, 21, 28, 35):
        size += v >= (1 << bits)
    out = np.empty(int(size.sum()), np.uint8)
    at = np.cumsum(size) - size
    for k in range(6):
        here = size > k
        if not here.any():
            break
        more = size[here] > k + 1
        out[at[here] + k] = ((v[here] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | np.where(more, 128, 0).astype(np.uint8)
    return out.tobytes(), size


def unpack_numbers(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.empty(0, np.int64)
    ends = np.flatnonzero(b < 128)
    starts = np.concatenate(([0], ends[:-1] + 1))
    out = (b[starts] & 127).astype(np.int64)
    more = np.flatnonzero(ends > starts)
    for k in range(1, 6):
        if not len(more):
            break
        out[more] |= (b[starts[more] + k] & 127).astype(np.int64) << (7 * k)
        more = more[ends[more] > starts[more] + k]
    return out


def pack_in_slices(values, n: int) -> bytes:
    """``pack_numbers`` of n values, ``values(a, b)`` giving a slice of them."""
    return b"".join(pack_numbers(values(a, min(n, a + SLICE)))[0] for a in range(0, n, SLICE))


def _pack(*parts: bytes) -> bytes:
    head = np.array([len(parts), *map(len, parts)], "<u4").tobytes()
    return zlib.compress(head + b"".join(parts), 1)


def _unpack(data: bytes) -> list[bytes]:
    raw = zlib.decompress(data)
    n = int.from_bytes(raw[:4], "little")
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4).astype(np.int64)) + 4 * (n + 1)
    starts = np.concatenate(([4 * (n + 1)], ends[:-1]))
    return [raw[a:b] for a, b in zip(starts, ends)]


# ------------------------------------------------------------------ blocks


class _Numbers(dict):
    """Words in the order of their first use."""

    def __missing__(self, word):
        n = self[word] = len(self)
        return n


class _Spans(dict):
    """Numbers of the pre-tokens of a span between safe blanks, with the blank before it."""

    def __init__(self, numbers, pattern):
        self.numbers, self.findall = numbers, pattern.findall

    def __missing__(self, span):
        n = self[span] = tuple(map(self.numbers.__getitem__, self.findall(" " + span)))
        return n


def text_numbers(text: str, spans: _Spans) -> array:
    """The text as a sequence of word numbers."""
    cut = _SAFE_BLANK.split(text) if _ODD_BLANK.search(text) else text.split(" ")
    first = map(spans.numbers.__getitem__, spans.findall(cut[0]))
    return array("I", chain(first, chain.from_iterable(map(spans.__getitem__, cut[1:]))))


def _block_rows(block: int, sequences: list[array], numbers: _Numbers, slots: int):
    """The packed sequences, with numbers in order of frequency, and packed word lists by slot."""
    lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
    flat = np.frombuffer(b"".join(s.tobytes() for s in sequences), np.uint32)
    order = np.argsort(-np.bincount(flat, minlength=len(numbers)), kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order))
    text = _pack(pack_numbers(lengths)[0], pack_in_slices(lambda a, b: rank[flat[a:b]], len(flat)))

    words = [w.encode() for w in numbers]
    slot = np.fromiter((zlib.crc32(w) % slots for w in words), np.int64, len(words))
    lists = []
    by_slot = np.lexsort((rank, slot))
    bounds = np.searchsorted(slot[by_slot], np.arange(slots + 1))
    for s in range(slots):
        mine = by_slot[bounds[s] : bounds[s + 1]]
        if len(mine):
            own = [words[i] for i in mine]
            steps = np.diff(rank[mine].astype(np.int64), prepend=0)
            sizes = np.fromiter(map(len, own), np.int64, len(own))
            lists.append((block, s, _pack(pack_numbers(steps)[0], pack_numbers(sizes)[0], b"".join(own))))
    return text, lists


def _cut(schema: pa.Schema, pattern: str, slots: int, block_chars: int):
    def run(batches):
        from pyspark import TaskContext

        task, nth = TaskContext.get().partitionId(), 0
        compiled = regex.compile(pattern)
        numbers = _Numbers()
        spans = _Spans(numbers, compiled)
        ids, sequences, chars = [], [], 0

        def flush():
            block = (task << 32) | nth
            text, lists = _block_rows(block, sequences, numbers, slots)
            columns = [block] * (1 + len(lists)), [None] + [r[1] for r in lists], [ids] + [None] * len(lists), [text] + [r[2] for r in lists]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, schema.types)], schema=schema)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                ids.append(key)
                sequences.append(text_numbers(text, spans))
                chars += len(text)
                if len(spans) > SPANS:
                    spans.clear()
                if chars >= block_chars:
                    yield from flush()
                    numbers = _Numbers()
                    spans = _Spans(numbers, compiled)
                    ids, sequences, chars, nth = [], [], 0, nth + 1
        if ids:
            yield from flush()
        del numbers, spans, sequences
        give_back()

    return run


def _encode_words(path: str):
    """Encode each distinct word of a slot once; give every block its ids in its own order."""

    def run(batches):
        encode, slot, known = encoder_of(path).encode_ordinary, None, {}
        for batch in batches:
            out = []
            for s, data in zip(batch.column(1).to_pylist(), batch.column(2)):
                if s != slot:
                    slot, known = s, {}
                steps, sizes, text = _unpack(data.as_py())
                ends = np.cumsum(unpack_numbers(sizes))
                found, a = [], 0
                for b in ends.tolist():
                    word = text[a:b]
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = np.array(encode(word.decode()), "<u4").tobytes()
                    found.append(ids)
                    a = b
                counts = np.fromiter(map(len, found), np.int64, len(found)) // 4
                flat = np.frombuffer(b"".join(found), "<u4")
                out.append(_pack(steps, pack_numbers(counts)[0], pack_numbers(flat)[0]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["block", "data"])
        known.clear()
        give_back()

    return run


def _resolve(id_type: pa.DataType, id_col: str):
    """Sequences of word numbers to token ids, for the documents of one block."""

    def run(texts: pa.Table, lists: pa.Table) -> pa.Table:
        parts = [_unpack(x.as_py()) for x in lists.column("data")]
        ranks = [np.cumsum(unpack_numbers(p[0])) for p in parts]
        n = sum(map(len, ranks))
        start, count, done, flat = np.zeros(n, np.int64), np.zeros(n, np.int32), 0, []
        for rank, (_, counts, words) in zip(ranks, parts):
            counts, words = unpack_numbers(counts), unpack_numbers(words).astype("<u4")
            count[rank] = counts
            start[rank] = done + np.cumsum(counts) - counts
            done += len(words)
            flat.append(words)
        flat = np.concatenate(flat) if flat else np.empty(0, "<u4")
        lengths, number = (unpack_numbers(x) for x in _unpack(texts.column("data")[0].as_py()))
        number = number.astype(np.uint32)
        each = count[number]
        ids = np.empty(int(each.sum(dtype=np.int64)), "<u4")
        at = 0
        for a in range(0, len(number), SLICE):
            size = each[a : a + SLICE].astype(np.int64)
            place = np.repeat(start[number[a : a + SLICE]] - (np.cumsum(size) - size), size)
            place += np.arange(len(place))
            ids[at : at + len(place)] = flat[place]
            at += len(place)
        ends = np.concatenate(([0], np.cumsum(each, dtype=np.int64)))[np.concatenate(([0], np.cumsum(lengths)))]
        keys = texts.column("ids").combine_chunks().flatten()
        return pa.table([keys.cast(id_type), _binary(ids.tobytes(), 4 * ends), pa.array(np.diff(ends))], [id_col, "ids", "n_tokens"])

    return run


def _binary(data: bytes, ends: np.ndarray) -> pa.Array:
    """A binary array over one buffer, from the values' bounds."""
    if len(data) < 1 << 31:
        return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
    return pa.chunked_array([pa.array([data[a:b]], pa.binary()) for a, b in zip(ends, ends[1:])], pa.binary())


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, ids, n_tokens): token ids as little-endian unsigned 32-bit integers.

    ``pattern`` cuts the text; no special tokens are made. A match must never span a single blank
    between two other characters and end beyond it, as is so for patterns whose words take at most
    one blank in front.
    """
    spark = docs.sparkSession
    small_batches(spark)
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_type = docs.schema[id_col].dataType
    spark_schema = f"block long, slot int, ids array<{id_type.simpleString()}>, data binary"
    arrow_id = pa.schema([("x", _arrow_type(id_type))]).field(0).type
    schema = pa.schema([("block", pa.int64()), ("slot", pa.int32()), ("ids", pa.list_(arrow_id)), ("data", pa.binary())])
    # Bucketed by block: the sequences, the bulk of it, then meet their words' ids without a shuffle.
    name = f"bpe_blocks_{uuid.uuid4().hex}"
    (
        docs.select(id_col, text_col)
        .mapInArrow(_cut(schema, pattern, slots, block_chars), spark_schema)
        .write.bucketBy(slots, "block").format("parquet").option("path", shared_folder(spark, "bpe-blocks")).saveAsTable(name)
    )
    blocks = spark.table(name)
    words = (
        blocks.filter("slot IS NOT NULL")
        .select("block", "slot", "data")
        .repartition(slots, "slot")
        .sortWithinPartitions("slot")
        .mapInArrow(_encode_words(vocabulary), "block long, data binary")
    )
    texts = blocks.filter("slot IS NULL").select("block", "ids", "data")
    return texts.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(
        _resolve(arrow_id, id_col), f"{id_col} {id_type.simpleString()}, ids binary, n_tokens long"
    )


def _arrow_type(data_type) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(data_type)


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a column ``decoded``: the bytes of its ids."""
    small_batches(encoded.sparkSession)
    names = [c for c in encoded.columns if c != "decoded"]
    at = names.index(ids_col)
    fields = ", ".join(f"`{n}` {encoded.schema[n].dataType.simpleString()}" for n in names)

    def run(batches):
        table = token_bytes(vocabulary)
        for batch in batches:
            given = batch.column(at)
            ends = np.frombuffer(given.buffers()[1], np.int32)[given.offset : given.offset + len(given) + 1]
            ids = np.frombuffer(given.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view("<u4")
            found = table.take(pa.array(ids))
            bounds = np.frombuffer(found.buffers()[1], np.int64, len(ids) + 1)[(ends - ends[0]) // 4]
            decoded = _binary((found.buffers()[2] or pa.py_buffer(b"")).to_pybytes()[bounds[0] : bounds[-1]], bounds - bounds[0])
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded], [*names, "decoded"])

    return encoded.select(*names).mapInArrow(run, f"{fields}, decoded binary")


