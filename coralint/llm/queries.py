"""The registered queries of this package, thin wrappers around the operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coralint.llm import (
    alignment,
    ann,
    bag_minhash,
    byte_bpe,
    chat_format,
    line_dedup,
    metric_join,
    mixing,
    pu_quality,
    spelling,
    token_files,
    toxicity,
    wrapper,
)
from coralint.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = pu_quality.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    held_out = F.coalesce(pu_quality.fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    scored = docs.select("doc_id", held_out, pu_quality.score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query
def op2_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of the vectors with a cosine of 0.95 or more."""
    return metric_join.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


ORACLE["op2_metric_join"] = metric_join.ORACLE


@query
def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    taken = F.sum(F.when(F.col("chosen"), F.col("size")).otherwise(F.lit(0)))
    return (
        plan.groupBy("id", "k1", "k2", "twin", "source", "size", "source_size", "target")
        .agg(taken.alias("taken"))
        .select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
    )


ORACLE["op3_mix"] = mixing.ORACLE


@query
def op4_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return bag_minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector among all others."""
    return ann.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.expr("id % 20 = 0"))


@query
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids and of the bytes they decode to."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = byte_bpe.decode(byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return both.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query
def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    text = wrapper.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return text.withColumn("n_chars", F.char_length("text").cast("long"))


@query
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, read back from the written files."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = token_files.new_folder(spark)
    token_files.write_files(docs, public_tokenizers.path("word_bpe_49k.json"), folder, end_id=2)
    read = token_files.read_files(spark, folder)
    return read.select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document without its shared lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    return line_dedup.line_dedup(docs).select("doc_id", "n_lines", "n_dropped", kept)


ORACLE["op9_line_dedup"] = line_dedup.ORACLE


@query
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what is read back from the formatted conversations and their loss masks."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    out = chat_format.format_conversations(turns.unionByName(extra))
    read = out.select(
        "conv_id",
        chat_format.read_turns(F.col("formatted")).alias("turns"),
        chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


ORACLE["op10_chat_format"] = chat_format.ORACLE


@query
def op11_cross_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers' tokens in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    digest = lambda c: F.when(c == "", F.lit("")).otherwise(F.sha2(c, 256))
    return alignment.align(docs, a, b, groups=digest).withColumnRenamed("groups", "groups_sha256")


@query
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, form and root of every longer word of the documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling.variants(spelling.vocabulary(docs, change=spelling.damaged))


@query
def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    held_out = F.coalesce(toxicity.fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out")
    scored = docs.select("doc_id", held_out, toxicity.score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
