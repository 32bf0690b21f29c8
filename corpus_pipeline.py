"""Corpus pipeline: quality, line dedup, near-dedup, mixing, tokens.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of ``documents``; the last returns one row per document of the mix with its ids.
Repeated rows, null texts, ties and extra columns are treated as the operators' docstrings say; each
stage gives an empty table for an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coralint.llm import bag_minhash, byte_bpe, line_dedup, mixing, pu_quality
from coralint.llm.common import stored, table

KEEP_FROM = 0.3  # quality scores below are rejected
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches ``KEEP_FROM``; without labels every document stays."""
    model = pu_quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs.filter(pu_quality.score(model, F.col("text")) >= KEEP_FROM)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that three or more share; ``n_chars`` follows the text."""
    out = line_dedup.line_dedup(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(kind))
    return out.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return bag_minhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in service order; a document that is taken twice is two rows."""
    taken = mixing.mix(docs)
    return taken.orderBy("finish", "source", "copy", "doc_id").select(*docs.columns)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): ids as little-endian unsigned 32-bit integers."""
    # Written in between, so that a task runs one Python worker at a time.
    encoded = stored(byte_bpe.encode(docs, VOCABULARY, public_tokenizers.PATTERN), "stage-ids")
    return byte_bpe.decode(encoded, VOCABULARY).select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_shared_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("byte_bpe", to_tokens),
]

# The classifier and the sketches have no SQL counterpart; tests/llm holds the brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
