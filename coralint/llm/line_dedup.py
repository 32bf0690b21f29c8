"""Line dedup: drop lines that many documents share.

Lines are exploded with their positions, reduced to a 128-bit hash of their normalised form, and
the distinct documents of each hash are counted. Only hashes over the threshold come back to the
lines; the positions to drop are gathered per document and the text is reassembled by position.

Scale: the count first removes repeats of a line within a document and then sums partial counts
per task, so a line that a third of all documents hold arrives at its reducer as one row per task.
The join back to the lines is an equi join on the hash; a hot hash is split by adaptive skew join.
Texts move once, for the last join. No stage holds more than one document's positions in a row.

Defined results: a null text counts as one empty line and stays null unless it is asked for as
text; repeated rows of one id are the same document for the count and each gets its own result;
a null id is one document, smaller than all others; an empty table gives an empty table. Columns
of the input stay as they are, except ``text``, ``n_lines`` and ``n_dropped``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coralint.llm.common import hash128

BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """The line without ASCII blanks at both ends, with A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, UPPER.lower())


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3
) -> DataFrame:
    """``docs`` with shared lines removed from ``text_col``, plus ``n_lines`` and ``n_dropped``.

    A line whose key has at least ``min_chars`` code points and occurs in at least ``min_docs``
    documents stays only in the document with the largest id.
    """
    others = [c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    k1, k2 = hash128(F.col(id_col), F.col(text_col))
    base = docs.select(*others, text_col, k1.alias("__k1"), k2.alias("__k2"))
    pieces = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")

    lines = base.select(F.col(id_col).alias("__id"), "__k1", "__k2", F.posexplode(pieces).alias("__pos", "__line"))
    lines = lines.withColumn("__key", line_key(F.col("__line"))).filter(F.char_length("__key") >= min_chars)
    h1, h2 = F.xxhash64(F.lit(3), "__key"), F.xxhash64(F.lit(77), "__key")
    lines = lines.select("__id", "__k1", "__k2", "__pos", h1.alias("__h1"), h2.alias("__h2"))

    shared = (
        lines.select("__h1", "__h2", "__id")
        .distinct()
        .groupBy("__h1", "__h2")
        .agg(F.count(F.lit(1)).alias("__n"), F.max("__id").alias("__keeper"))
        .filter(F.col("__n") >= min_docs)
        .select("__h1", "__h2", "__keeper")
    )
    drops = (
        lines.join(shared, ["__h1", "__h2"])
        .filter(~F.col("__id").eqNullSafe(F.col("__keeper")))
        .groupBy("__k1", "__k2")
        .agg(F.collect_set("__pos").alias("__drop"))
    )
    # array_except is hash based, so the cost of a document is linear in its lines.
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__drop"))
    text = F.array_join(F.transform(kept, lambda i: F.col("__lines")[i]), "\n")
    return (
        base.join(drops, ["__k1", "__k2"], "left")
        .withColumn("__lines", pieces)
        .select(
            *others,
            F.when(F.col("__drop").isNull(), F.col(text_col)).otherwise(text).alias(text_col),
            F.size("__lines").cast("long").alias("n_lines"),
            F.coalesce(F.size("__drop"), F.lit(0)).cast("long").alias("n_dropped"),
        )
    )


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT k.doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE s.key IS NOT NULL AND s.keeper <> k.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos)
              FILTER (WHERE s.key IS NULL OR s.keeper = k.doc_id), '')) AS kept_sha256
FROM keyed k LEFT JOIN shared s ON s.key = k.key
GROUP BY k.doc_id
"""
