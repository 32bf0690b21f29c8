"""Approximate nearest neighbours by randomly rotated one-bit codes.

Vectors are centred and turned by one random rotation; a vector's code is the sign of each
coordinate, one bit each, packed into bytes. Two scalars correct the code: the residual's length and
the inner product of the residual's direction with its code's. From them the inner product of a query
and a vector is estimated without bias, with an error of about ``sqrt((1 - f^2) / f^2 / (d - 1))``
times the query's length. A vector is reranked with its exact inner product if its upper bound
reaches the k-th largest lower bound.

Scale: the query set (ids divisible by a number) grows with the table, so both sides go in blocks:
each task meets one block of queries with one block of codes, finds the block's best k, and a window
merges the k best of each block. Neither side is collected; no pair is emitted but the best k of a
query and block. The index is fitted on nothing but the mean of a bounded sample; the rotation
follows from a seed.

Defined results: vectors that are null, zero or hold null or non-finite components take no part;
vectors of another dimension than the query's are no candidates; ties go to the smaller id; rows
repeated with one id are candidates of their own but never of a query with that id; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coralint.llm.common import small_batches, stored
from coralint.llm.metric_join import matrix, usable

SAMPLE = 2000  # vectors that fit the centre
QUERY_BLOCK = 4096
CODE_BLOCK = 16384
# Standard errors on either side of an estimate; larger means more reranking and higher recall.
CONFIDENCE = 2.5

# Sign values of the eight bits of every byte.
_SIGNS = np.where((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1, 1.0, -1.0)


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(rows: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed bits, residual lengths, inner products of directions and codes)."""
    rest = rows - centre
    length = np.sqrt(np.einsum("ij,ij->i", rest, rest))
    turned = (rest / np.where(length > 0, length, 1)[:, None]) @ turn
    fit = np.abs(turned).sum(axis=1) / np.sqrt(rows.shape[1])
    return np.packbits(turned > 0, axis=1), length, np.where(length > 0, fit, 1.0)


def estimate(query: np.ndarray, codes, length, fit, centre, turn) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of queries with coded vectors, and their standard errors."""
    dim = len(centre)
    signs = _SIGNS[codes].reshape(len(codes), -1)[:, :dim] / np.sqrt(dim)
    shift = query @ centre
    turned = query @ turn
    guess = shift[:, None] + (turned @ signs.T) * (length / fit)
    spread = np.sqrt(np.maximum(0.0, 1 - fit**2) / fit**2 / max(1, dim - 1)) * length
    return guess, np.sqrt(np.einsum("ij,ij->i", query, query))[:, None] * spread


def _exact(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    # The same order of additions for every pair, so equal vectors get equal scores.
    return (rows * query).sum(axis=1)


def _best(k: int, confidence: float, centres: dict[int, np.ndarray], seed: int):
    """The k nearest of one block of vectors for every query of one block."""

    def search(queries: pa.Table, block: pa.Table) -> pa.Table:
        out = []
        q_size = np.array(queries.column("vector").combine_chunks().value_lengths()) if queries.num_rows else np.empty(0)
        b_size = np.array(block.column("vector").combine_chunks().value_lengths()) if block.num_rows else np.empty(0)
        for dim in np.intersect1d(q_size, b_size):
            mine = queries.filter(pa.array(q_size == dim)), block.filter(pa.array(b_size == dim))
            qs, rows = (matrix(t.column("vector").combine_chunks()) for t in mine)
            q_ids, ids = (np.array(t.column("id")) for t in mine)
            centre, turn = centres.get(int(dim), np.zeros(int(dim))), rotation(int(dim), seed)
            codes = np.stack([np.frombuffer(c.as_py(), np.uint8) for c in mine[1].column("code")])
            length, fit = (np.array(mine[1].column(c)) for c in ("length", "fit"))
            for at in range(0, len(qs), 64):
                part = qs[at : at + 64]
                guess, spread = estimate(part, codes, length, fit, centre, turn)
                low, high = guess - confidence * spread, guess + confidence * spread
                other = ids[None, :] != q_ids[at : at + 64, None]
                low[~other] = high[~other] = -np.inf
                if len(ids) > k:
                    limit = np.partition(low, len(ids) - k, axis=1)[:, len(ids) - k]
                else:
                    limit = np.full(len(part), -np.inf)
                for i, query in enumerate(part):
                    near = np.flatnonzero((high[i] >= limit[i]) & other[i])
                    score = _exact(query, rows[near])
                    top = np.lexsort((ids[near], -score))[:k]
                    out.append((np.full(len(top), q_ids[at + i]), ids[near][top], score[top]))
        parts = [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table({"query_id": pa.array(parts[0], pa.int64()), "vec_id": pa.array(parts[1], pa.int64()), "score": pa.array(parts[2], pa.float64())})

    return search


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 7) -> tuple[DataFrame, dict]:
    """(id, vector, code, length, fit) of every usable vector, and the centres by dimension."""
    small_batches(vectors.sparkSession)
    rows = vectors.filter(usable(F.col(vector_col))).select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").collect()
    groups: dict[int, list] = {}
    for r in sample:
        groups.setdefault(len(r[0]), []).append(r[0])
    centres = {n: np.array(x, np.float64).mean(axis=0) for n, x in groups.items()}
    kind = vectors.schema[vector_col].dataType.simpleString()

    def code(batches):
        for batch in batches:
            size = np.array(batch.column(1).value_lengths())
            codes, length, fit = np.empty(len(size), object), np.zeros(len(size)), np.ones(len(size))
            for dim in np.unique(size):
                mine = np.flatnonzero(size == dim)
                data = matrix(batch.column(1).take(pa.array(mine)))
                bits, length[mine], fit[mine] = encode(data, centres.get(int(dim), np.zeros(int(dim))), rotation(int(dim), seed))
                codes[mine] = [b.tobytes() for b in bits]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(codes.tolist(), pa.binary()), pa.array(length), pa.array(fit)],
                ["id", "vector", "code", "length", "fit"],
            )

    return stored(rows.mapInArrow(code, f"id long, vector {kind}, code binary, length double, fit double"), "ann-index"), centres


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
    confidence: float = CONFIDENCE, seed: int = 7,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products found for each query row.

    ``is_query`` is a condition on column ``id``.
    """
    index, centres = build_index(vectors, id_col, vector_col, seed)
    asked = index.filter(is_query).select("id", "vector").distinct()
    n, m = index.count(), asked.count()
    code_blocks, query_blocks = max(1, -(-n // CODE_BLOCK)), max(1, -(-m // QUERY_BLOCK))
    # At least a few blocks per core, so that small tables also use the cluster.
    code_blocks = max(code_blocks, min(index.sparkSession.sparkContext.defaultParallelism * 2, -(-n // 1024)))
    deal = lambda c, blocks: F.pmod(F.xxhash64(F.lit(9), c), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = asked.withColumn("qb", deal("id", query_blocks)).withColumn("cb", every(code_blocks))
    # Rows repeated with one id must not pile up in one block.
    right = index.withColumn("cb", F.pmod(F.xxhash64("id", F.spark_partition_id(), F.monotonically_increasing_id()), F.lit(code_blocks)).cast("int"))
    right = right.withColumn("qb", every(query_blocks))
    found = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(
        _best(k, confidence, centres, seed), "query_id long, vec_id long, score double"
    )
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
