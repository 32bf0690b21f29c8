r"""Chat formatting: conversations to one marked string with a loss mask, and back.

A turn holds typed content parts (text, image, audio, document) or one plain text. A visitor, one
``transform`` over the parts, flattens them into ordered pieces: escaped text or a placeholder.
Each placeholder records its attachment (kind, address, place, tokens it expands to).

Markers are plain strings. Inside texts and roles every backslash becomes ``\e``, and a marker loses
its first character (``<`` becomes ``\l``, ``[`` becomes ``\b``), so that no marker can come from
a text and the escape can be taken back exactly. Text parts that meet are kept apart by ``\p``, which
reads as nothing, so that no marker can come from the end of one and the beginning of the next.

Scale: one shuffle by conversation; running offsets, gathering and formatting share it. A
conversation must fit one row, as its formatted text is one value.

Defined results: null texts, roles and conversation ids are empty text, empty role and one
conversation; turns with equal numbers are ordered by role, then content; null turns come first;
unknown part types are skipped; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The template's own markers, then control strings of common public chat templates.
TURN, BODY, END = "<|turn|>", "<|text|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
FOREIGN = (
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>",
    "<|startoftext|>", "<|eot_id|>", "<|begin_of_text|>", "<|start_header_id|>", "<|end_header_id|>",
)
CONTROLS = (TURN, BODY, END, *PLACEHOLDERS.values(), *FOREIGN)
LEADS = {"<": "\\l", "[": "\\b"}
BREAK = "\\p"
# Tokens that one attachment expands to: by patches, by seconds, by pages.
PATCH, TOKENS_PER_SECOND, TOKENS_PER_PAGE = 28, 25, 1024

PART = "struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: Column) -> Column:
    """Backslashes and the markers' first characters, coded; no marker is left."""
    text = F.replace(text, F.lit("\\"), F.lit("\\e"))
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(LEADS[c[0]] + c[1:])), CONTROLS, text)


def unescape(text: Column) -> Column:
    """Inverse of ``escape``: every backslash is followed by its code letter, so order is safe."""
    for lead, code in LEADS.items():
        text = F.replace(text, F.lit(code), F.lit(lead))
    text = F.replace(text, F.lit(BREAK), F.lit(""))
    return F.replace(text, F.lit("\\e"), F.lit("\\"))


def expanded_tokens(part: Column) -> Column:
    side = lambda n: F.ceil(F.coalesce(part[n], F.lit(0)) / F.lit(PATCH))
    return (
        F.when(part["type"] == "image", F.greatest(F.lit(1), side("width") * side("height")))
        .when(part["type"] == "audio", F.greatest(F.lit(1), F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * TOKENS_PER_SECOND)))
        .when(part["type"] == "document", F.greatest(F.lit(1), F.coalesce(part["pages"], F.lit(0)) * TOKENS_PER_PAGE))
        .otherwise(F.lit(0))
        .cast("long")
    )


def visit(part: Column, before: Column) -> Column:
    """One content part as the piece that stands for it, given the part before it or null."""
    apart = F.when(before["type"] == "text", F.lit(BREAK)).otherwise(F.lit(""))
    piece = F.when(part["type"] == "text", F.concat(apart, escape(F.coalesce(part["text"], F.lit("")))))
    for kind, mark in PLACEHOLDERS.items():
        piece = piece.when(part["type"] == kind, F.lit(mark))
    return piece.otherwise(F.lit(""))


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans, attachments, attachment_tokens) from (conv_id, turn, role, text | parts).

    ``loss_spans`` holds (start, length) in code points of ``formatted``: the bodies of
    ``loss_role``. ``attachments`` lists the placeholders in order.
    """
    if "parts" in turns.columns:
        parts = F.coalesce(F.col("parts").cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>"))
    else:
        plain = F.struct(
            F.lit("text").alias("type"), F.col("text").cast("string").alias("text"), F.lit(None).cast("string").alias("uri"),
            F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
            F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"),
        )
        parts = F.array(plain)
    known = F.filter(parts, lambda p: p["type"].isin("text", *PLACEHOLDERS))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), known.alias("parts"))
    attached = F.filter("parts", lambda p: p["type"].isin(*PLACEHOLDERS))
    rows = rows.select(
        "conv_id",
        "turn",
        "role",
        F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY)).alias("head"),
        F.array_join(F.transform("parts", lambda p, i: visit(p, F.get("parts", i - 1))), "").alias("body"),
        F.transform(
            attached, lambda p: F.struct(p["type"].alias("kind"), p["uri"].alias("uri"), expanded_tokens(p).alias("tokens"))
        ).alias("attached"),
    )
    rows = rows.withColumn("loss", F.col("role") == loss_role)
    whole = F.char_length("head") + F.char_length("body") + len(END)
    before = W.partitionBy("conv_id").orderBy("turn", "role", "body", "head").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(whole).over(before), F.lit(0)) + F.char_length("head"))
    packed = (
        rows.select("conv_id", F.struct("at", "head", "body", "loss", "attached").alias("t"))
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list("t")).alias("ts"))
    )
    spans = F.transform(
        F.filter("ts", lambda t: t["loss"]),
        lambda t: F.struct((t["at"] + 1).cast("int").alias("start"), F.char_length(t["body"]).alias("length")),
    )
    attachments = F.flatten(F.transform("ts", lambda t: t["attached"]))
    return packed.select(
        "conv_id",
        F.array_join(F.transform("ts", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
        spans.alias("loss_spans"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("attachment_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted string; placeholders stay in the text."""
    pieces = F.split(formatted, r"<\|turn\|>")
    return F.transform(
        F.slice(pieces, 2, F.greatest(F.lit(0), F.size(pieces) - 1)),
        lambda p: F.struct(
            unescape(F.split(p, r"<\|text\|>")[0]).alias("role"),
            unescape(F.split(F.split(p, r"<\|text\|>")[1], r"<\|end\|>")[0]).alias("text"),
        ),
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped, in order."""
    return unescape(F.array_join(F.transform(spans, lambda s: F.substr(formatted, s["start"], s["length"])), ""))


_ESCAPED = "replace(coalesce({}, ''), '\\', '\\e')"
for _c in CONTROLS:
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '{LEADS[_c[0]]}{_c[1:]}')"
ORACLE = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}) + {len(TURN + BODY + END)})::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""
