"""The common row shape of detector output, and the join back to file text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coralint.operators.lexemes import split_lines


def hits(
    df: DataFrame,
    rule_id: str,
    variant: str | Column = "",
    severity: Column | str | None = None,
    subject: Column | None = None,
    measure: Column | None = None,
    limit: int | None = None,
    row: Column | str = "row",
    col: Column | str = "col",
    off: Column | str = "off",
    snippet: Column | None = None,
    has_snippet: bool = True,
) -> DataFrame:
    """Project a detector's rows to the hit schema. ``row`` and ``col`` are 0-based."""

    def as_col(c):
        return F.col(c) if isinstance(c, str) else c

    return df.select(
        "fid",
        F.lit(rule_id).alias("rule_id"),
        (F.lit(variant) if isinstance(variant, str) else variant).alias("variant"),
        (F.lit(severity) if severity is None or isinstance(severity, str) else severity).cast("string").alias("severity"),
        as_col(row).cast("int").alias("row"),
        as_col(col).cast("int").alias("col"),
        as_col(off).cast("int").alias("off"),
        (F.lit(None) if subject is None else subject).cast("string").alias("subject"),
        (F.lit(None) if measure is None else measure).cast("bigint").alias("measure"),
        F.lit(limit).cast("bigint").alias("limit"),
        (F.lit(None) if snippet is None else snippet).cast("string").alias("snippet"),
        F.lit(has_snippet).alias("has_snippet"),
    )


def with_line(rows: DataFrame, files: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Add ``line``, the text of each row's line, and the listed file columns.

    A file's rows are gathered once and its text is split once, so the cost is one
    pass over the text per file with rows, whatever their number.
    """
    keep = keep or []
    cols = [c for c in rows.columns if c != "fid"]
    gathered = rows.groupBy("fid").agg(F.collect_list(F.struct(*cols)).alias("rows"))
    joined = gathered.join(files.select("fid", "text", *keep), "fid")
    looked_up = F.transform(
        F.array(split_lines(F.col("text"))),
        lambda all_lines: F.transform(
            F.col("rows"),
            lambda r: F.struct(*[r[c].alias(c) for c in cols], F.get(all_lines, r["row"]).alias("line")),
        ),
    )
    return joined.select("fid", *keep, F.inline(F.get(looked_up, 0)))
