"""Cross-tokenizer alignment: where the tokens of two tokenizers end together.

Tokenizer A is a byte-level BPE that is given a space and the text, tokenizer B a piece model that adds the
space itself, so both spell the same bytes. All work on tokens is done on Arrow columns, a block of documents at a time:
id lists are flattened with their parent indices, token lengths come from a table by id, segmented
cumulative sums give each token's end in its document, and an Acero hash join on (document, end) finds
the ends that both tokenizers have. The ends cut a document into groups; the two tokens that meet at an
end are a link.

Counts of linked id pairs cover the corpus: each block counts its own pairs with ``Table.group_by``, Spark
merges the partial counts, finds the highest of each B id, and sends the merged counts back to the blocks,
where they are looked up by the links' pair numbers. A pair is one row a block however often it occurs, so a very frequent pair is
no hot key, and a document's links travel packed.

Blocks are written to the shared folder before anything is derived from them: texts are tokenized once, and
a lost executor costs only its own tasks.

Bounds: a block is about ``block_chars`` of text (one longer document is a block of its own). The highest
counts by B id are at most as many rows as B has ids.

Defined results: texts that are null, empty, or spelled differently by the two tokenizers (the piece model
may normalise characters) have no tokens: zeros and an empty ``groups``. Repeated rows and null ids are
kept row by row; an empty table gives an empty table; columns other than id and text are ignored, whatever
their names.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coralint.llm.byte_bpe import pack_numbers, unpack_numbers
from coralint.llm.common import small_batches, stored

BLOCK_CHARS = 2_000_000
# Characters that the piece model is given at once; its own records are larger than the ids.
CALL_CHARS = 200_000
# How byte-level vocabularies of this kind cut a text before merging: a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RESULT = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long"


# ------------------------------------------------------------------ the two tokenizers


def _byte_level() -> dict[str, int]:
    """Bytes of the printable stand-ins that byte-level vocabularies are written in."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(rest)}


@lru_cache(maxsize=2)
def byte_tokenizer(path: str):
    """The tokenizer and its token-byte table by id.

    The file's merges must stand in the order of the ids they make, so that ids are ranks; then the
    rank encoder gives the same ids without a Python list per text. Special tokens are left out.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    vocabulary, to_byte = given["model"]["vocab"], _byte_level()
    special = {t["id"] for t in given["added_tokens"]}
    merged = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in given["model"]["merges"]]
    if given["normalizer"] or given["pre_tokenizer"]["type"] != "ByteLevel" or merged != sorted(merged):
        raise ValueError(f"{path}: not a byte-level vocabulary whose ids are ranks")
    ranks = {bytes(to_byte[c] for c in token): i for token, i in vocabulary.items() if i not in special}
    table = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        table[i] = token
    return tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), pa.array(table, pa.large_binary())


@lru_cache(maxsize=2)
def piece_tokenizer(path: str):
    """The tokenizer and its token-byte table by id."""
    import sentencepiece

    tokenizer = sentencepiece.SentencePieceProcessor(model_file=path)

    def spelled(i: int) -> bytes:
        piece = tokenizer.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if tokenizer.is_byte(i) else piece.replace("▁", " ").encode()

    return tokenizer, pa.array([spelled(i) for i in range(tokenizer.get_piece_size())], pa.large_binary())


def _lists(ids: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32)))


def _tokenized(texts: list[str], a_path: str, b_path: str) -> tuple[pa.Array, pa.Array]:
    """Id lists of both tokenizers; the piece model is called on a bounded amount of text."""
    a, b = byte_tokenizer(a_path)[0], piece_tokenizer(b_path)[0]
    found, at = [], 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars + len(texts[end]) <= CALL_CHARS):
            chars += len(texts[end])
            end += 1
        found.extend(np.array(ids, np.int32) for ids in b.encode(texts[at:end], num_threads=1))
        at = end
    return _lists([a.encode_to_numpy(" " + t, disallowed_special=()) for t in texts]), _lists(found)


# ------------------------------------------------------------------ tokens of a block as columns


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def _spelled_alike(lists: pa.Array, table: pa.Array, texts: list[str]) -> np.ndarray:
    """Whether the tokens of each list spell a space and the text."""
    spelled = table.take(lists.flatten())
    ends = np.concatenate(([0], np.cumsum(_lengths(lists))))
    at = np.frombuffer(spelled.buffers()[1], np.int64, len(spelled) + 1)[ends]
    data = (spelled.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
    return np.fromiter((data[a:b] == (" " + t).encode() for a, b, t in zip(at, at[1:], texts)), bool, len(texts))


def _ends(lists: pa.Array, table: pa.Array) -> pa.Table:
    """(doc, end, at): every token with its document, the offset where it ends there, and its place in the block."""
    ids, doc = lists.flatten(), pc.list_parent_indices(lists)
    size = pc.binary_length(table).take(ids)
    run = pc.cumulative_sum(size)
    # Segments: what had been summed up before a document's first token.
    counts = _lengths(lists)
    total = np.concatenate(([0], run.to_numpy()))
    before = total[np.concatenate(([0], np.cumsum(counts)))[:-1]] if len(counts) else total[:0]
    end = pc.subtract(run, pa.array(before, pa.int64()).take(doc))
    return pa.table({"doc": doc.cast(pa.int32()), "end": end, "at": pa.array(np.arange(len(ids), dtype=np.int64))})


@lru_cache(maxsize=2)
def _written_ids(n: int) -> pa.Array:
    """Each id before a comma, a bar and a semicolon, as three runs of n."""
    return pa.array([f"{i}{mark}" for mark in ",|;" for i in range(n)], pa.large_utf8())


def _group_texts(n: int, a_ids: np.ndarray, b_ids: np.ndarray, a_last: np.ndarray, b_last: np.ndarray, doc_groups: np.ndarray) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` for each document, from the places of the groups' last tokens; ids are below n."""
    n_groups = len(a_last)
    if not n_groups:
        return [""] * len(doc_groups)
    size_a, size_b = np.diff(a_last, prepend=-1), np.diff(b_last, prepend=-1)
    group_a, group_b = np.repeat(np.arange(n_groups), size_a), np.repeat(np.arange(n_groups), size_b)
    past_a, past_b = np.cumsum(size_a), np.cumsum(size_b) - size_b
    codes = np.empty(len(a_ids) + len(b_ids), np.int64)
    mark_a, mark_b = np.zeros(len(a_ids), np.int64), np.zeros(len(b_ids), np.int64)
    mark_a[a_last], mark_b[b_last] = 1, 2
    codes[np.arange(len(a_ids)) + past_b[group_a]] = a_ids + n * mark_a
    codes[np.arange(len(b_ids)) + past_a[group_b]] = b_ids + n * mark_b
    written = _written_ids(n).take(pa.array(codes))
    at = np.frombuffer(written.buffers()[1], np.int64, len(written) + 1)
    data = written.buffers()[2].to_pybytes()
    last = np.concatenate(([0], (past_a + np.cumsum(size_b))))[np.concatenate(([0], np.cumsum(doc_groups)))]
    return [data[at[x] : max(at[x], at[y] - 1)].decode() for x, y in zip(last, last[1:])]


def _aligned(texts: list[str], a_path: str, b_path: str):
    """Per document: n_a, n_b, n_groups, groups and packed pair numbers; and the block's pairs with their counts."""
    a_table, b_table = byte_tokenizer(a_path)[1], piece_tokenizer(b_path)[1]
    a, b = _tokenized(texts, a_path, b_path)
    good = _spelled_alike(a, a_table, texts) & _spelled_alike(b, b_table, texts)
    if not good.all():
        nothing = pa.scalar([], pa.list_(pa.int32()))
        a, b = (pc.if_else(pa.array(good), x, nothing) for x in (a, b))
    a_ids, b_ids = a.flatten(), b.flatten()
    both = (
        _ends(a, a_table)
        .join(_ends(b, b_table).rename_columns(["doc", "end", "b_at"]), ["doc", "end"], join_type="inner", use_threads=False)
        .sort_by("at")
    )
    a_last, b_last = both["at"].to_numpy(), both["b_at"].to_numpy()
    doc_groups = np.bincount(both["doc"].to_numpy(), minlength=len(texts)).astype(np.int64)
    pair = pc.bit_wise_or(
        pc.shift_left(a_ids.take(both["at"].combine_chunks()).cast(pa.int64()), 32), b_ids.take(both["b_at"].combine_chunks()).cast(pa.int64())
    )
    counted = pa.table({"pair": pair, "one": pair}).group_by("pair", use_threads=False).aggregate([("one", "count")])
    # Frequent pairs get small numbers, which pack into one byte.
    counted = counted.sort_by([("one_count", "descending"), ("pair", "ascending")])
    number = pc.index_in(pair, counted["pair"].combine_chunks()).to_numpy(zero_copy_only=False)
    packed, size = pack_numbers(number)
    cuts = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(doc_groups)))]
    links = [packed[x:y] for x, y in zip(cuts, cuts[1:])]
    groups = _group_texts(max(len(a_table), len(b_table)), a_ids.to_numpy(), b_ids.to_numpy(), a_last, b_last, doc_groups)
    return _lengths(a), _lengths(b), doc_groups, groups, links, counted["pair"], counted["one_count"]


def _blocks(schema: pa.Schema, a_path: str, b_path: str, block_chars: int):
    def block_of(number: int, ids: list, texts: list[str]):
        n_a, n_b, n_groups, groups, links, pairs, counts = _aligned(texts, a_path, b_path)
        blank = [None]
        columns = [
            [number] * (len(ids) + 1), blank + ids, blank + n_a.tolist(), blank + n_b.tolist(), blank + n_groups.tolist(),
            blank + groups, blank + links, [pairs.to_pylist()] + blank * len(ids), [counts.to_pylist()] + blank * len(ids),
        ]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, schema.types)], schema=schema)

    def run(batches):
        from pyspark import TaskContext

        task, nth, ids, texts, chars = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                if texts and chars + len(text) > block_chars:
                    yield block_of((task << 32) | nth, ids, texts)
                    nth, ids, texts, chars = nth + 1, [], [], 0
                ids.append(key)
                texts.append(text)
                chars += len(text)
        if texts:
            yield block_of((task << 32) | nth, ids, texts)

    return run


def _summed(names: list[str]):
    """Best links and sums of counts of a block's documents, from the merged counts of its pairs."""

    def run(docs: pa.Table, pairs: pa.Table) -> pa.Table:
        n = pairs.num_rows
        count, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
        at = pairs["number"].to_numpy()
        count[at], best[at] = pairs["total"].to_numpy(), pairs["best"].to_numpy()
        lengths = docs["n_groups"].to_numpy()
        parts = [unpack_numbers(x.as_py()) for x in docs["links"]]
        number = np.concatenate(parts) if parts else np.empty(0, np.int64)
        cuts = np.concatenate(([0], np.cumsum(lengths)))
        sums = [np.concatenate(([0], np.cumsum(x[number])))[cuts] for x in (best, count)]
        kept = docs.select(["__id", "n_a", "n_b", "n_groups", "n_groups", "groups"]).columns
        out = [*kept[:5], *(pa.array(np.diff(s)) for s in sums), kept[5]]
        return pa.table(out, names=names)

    return run


def align(
    docs: DataFrame,
    a_path: str,
    b_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    groups: Callable[[Column], Column] = lambda c: c,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every document.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``: the decimal A and B ids of each group, in order. The argument
    of that name is applied to the column before it is written, for callers that need a digest only.
    """
    spark = docs.sparkSession
    small_batches(spark)
    id_type = docs.schema[id_col].dataType
    kind = id_type.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema(
        [
            ("block", pa.int64()), ("__id", to_arrow_type(id_type)), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
            ("groups", pa.string()), ("links", pa.binary()), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())),
        ]
    )
    ddl = f"block long, __id {kind}, n_a long, n_b long, n_groups long, groups string, links binary, pairs array<long>, counts array<long>"
    given = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    cut = given.mapInArrow(_blocks(schema, a_path, b_path, block_chars), ddl)
    blocks = stored(cut.withColumn("groups", groups(F.col("groups"))), "align-blocks")

    pairs = blocks.filter("pairs IS NOT NULL").select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("number", "of"))
    pairs = pairs.select(F.col("block").alias("at"), "number", F.col("of.pairs").alias("pair"), F.col("of.counts").alias("n"))
    totals = pairs.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("b", F.expr("pair & 4294967295"))
    highest = totals.groupBy("b").agg(F.max("total").alias("most"))
    # No more rows than B has ids.
    judged = totals.join(F.broadcast(highest), "b").select("pair", "total", (F.col("total") == F.col("most")).cast("long").alias("best"))
    known = pairs.select("at", "number", "pair").join(judged, "pair").select("at", "number", "total", "best")
    texts = blocks.filter("pairs IS NULL").select("block", "__id", "n_a", "n_b", "n_groups", "groups", "links")
    names = ["__id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    out = texts.groupBy("block").cogroup(known.groupBy("at")).applyInArrow(_summed(names), f"__id {kind}, {RESULT}, groups string")
    return out.withColumnRenamed("__id", id_col)
