"""Reports: JSON, text and Markdown. Large outputs are written by the executors."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coralint.plans.findings import (
    examples,
    group_by_rule,
    group_by_rule_severity,
    rank_findings,
    rank_rows,
    sort_struct,
    split_by_severity,
    summary,
    top_files,
    with_suggestion,
)
from coralint.session import delete_folder, ensure_checkpoint_dir

FORMATS = ["text", "json", "md"]


def _finding_struct() -> Column:
    return F.struct("rule_id", "rule_name", "severity", "location", "message", "snippet")


def write_json_lines(findings: DataFrame, path: str) -> None:
    """One finding per line; readable as a baseline with ``layout='lines'``."""
    findings.select(F.to_json(_finding_struct(), {"ignoreNullFields": "false"}).alias("value")).write.mode(
        "overwrite"
    ).text(path)


def json_lines(findings: DataFrame, status: DataFrame) -> DataFrame:
    """``(part, ord, value)`` lines of the nested report; in order they are one JSON document.

    Findings and parse errors are ranked, so each line knows whether a comma stands before it: a
    report of any size is written by the executors, without one large row.
    """
    kept = {"ignoreNullFields": "false"}

    def items(part: int, rows: DataFrame, item: Column) -> DataFrame:
        comma = F.when(F.col("rank") > 1, F.lit(",")).otherwise(F.lit(""))
        return rows.select(F.lit(part).alias("part"), F.col("rank").cast("long").alias("ord"), F.concat(comma, F.to_json(item, kept)).alias("value"))

    def fixed(part: int, text: Column, rows: DataFrame) -> DataFrame:
        return rows.select(F.lit(part).alias("part"), F.lit(0).cast("long").alias("ord"), text.alias("value"))

    totals = summary(findings, status)
    head = F.concat(F.lit('{"summary":'), F.to_json(F.struct("errors", "warnings", "infos", "files", "skipped"), kept), F.lit(',"findings":['))
    one = totals.select(F.lit(1))
    failed = status.where(F.col("status") == "skipped").select(F.col("path").alias("file"), "error")
    parts = [
        fixed(0, head, totals),
        items(1, rank_findings(findings), _finding_struct()),
        fixed(2, F.lit('],"parse_errors":['), one),
        items(3, rank_rows(failed, F.struct("file", "error")), F.struct("file", "error")),
        fixed(4, F.lit("]}"), one),
    ]
    return reduce(DataFrame.unionByName, parts)


def _keyed(df: DataFrame, part: int, order: Column, line: Column) -> DataFrame:
    return df.select(F.lit(part).alias("part"), order.alias("ord"), line.alias("value"))


def _totals_line() -> Column:
    return F.format_string(
        "%d findings (%d errors, %d warnings, %d infos) in %d files",
        F.col("errors") + F.col("warnings") + F.col("infos"),
        "errors",
        "warnings",
        "infos",
        "files",
    )


def finding_line() -> Column:
    return F.format_string(
        "%s %s %s:%d:%d  %s", "rule_id", "severity", F.col("location.file"), F.col("location.line"), F.col("location.column"), "message"
    )


def text_lines(findings: DataFrame, status: DataFrame) -> DataFrame:
    """``(part, key, value)``: finding lines, the totals, then the skipped files."""
    key = sort_struct(findings)
    rows = findings.select(F.lit(0).alias("part"), key.alias("key"), finding_line().alias("value"))
    none = F.lit(None).cast(rows.schema["key"].dataType)
    totals = F.when(
        F.col("skipped") > 0, F.concat(_totals_line(), F.format_string(", %d skipped", "skipped"))
    ).otherwise(_totals_line())
    end = summary(findings, status).select(F.lit(1).alias("part"), none.alias("key"), totals.alias("value"))
    skipped = status.where(F.col("status") == "skipped").select(
        F.lit(2).alias("part"), none.alias("key"), F.format_string("parse failed %s: %s", "path", "error").alias("value")
    )
    return rows.unionByName(end).unionByName(skipped)


def markdown_lines(findings: DataFrame, status: DataFrame, scan_path: str) -> DataFrame:
    """``(part, ord, value)`` lines of the Markdown report.

    Groups, top files and examples are aggregates; only the list of skipped files
    grows with the corpus, and it stays a distributed table like the rest.
    """
    s = summary(findings, status)
    errors, others = split_by_severity(findings)

    def fixed(part: int, df: DataFrame, *lines: Column) -> DataFrame:
        numbered = F.posexplode(F.array(*lines)).alias("n", "value")
        rows = df.select(numbered)
        return _keyed(rows, part, F.format_string("%06d", "n"), F.col("value"))

    head = fixed(
        0,
        s,
        F.lit("# Review report"),
        F.lit(""),
        F.lit(f"Scanned: {scan_path}"),
        F.lit(""),
        F.format_string("Files: %d (skipped %d), findings: %d", "files", "skipped", F.col("errors") + F.col("warnings") + F.col("infos")),
        F.lit(""),
        F.lit("## Totals"),
        F.lit(""),
        F.lit("| severity | count |"),
        F.lit("|---|---|"),
        F.format_string("| error | %d |", "errors"),
        F.format_string("| warning | %d |", "warnings"),
        F.format_string("| info | %d |", "infos"),
        F.lit(""),
    )
    failed_head = fixed(1, s.where(F.col("skipped") > 0), F.format_string("## Parse failures (%d)", "skipped"), F.lit(""))
    failed = _keyed(
        status.where(F.col("status") == "skipped"), 2, F.col("path"), F.format_string("- %s: %s", "path", "error")
    )
    n_err, n_other = s.where(F.col("errors") == 0), s.where(F.col("warnings") + F.col("infos") == 0)
    error_head = fixed(3, s, F.lit(""), F.lit("## Errors"), F.lit("")).unionByName(
        _keyed(n_err, 3, F.lit("999999"), F.lit("No errors."))
    )
    other_head = fixed(5, s, F.lit(""), F.lit("## Warnings and infos"), F.lit("")).unionByName(
        _keyed(n_other, 5, F.lit("999999"), F.lit("None."))
    )

    def place(*parts) -> Column:
        return F.format_string("%06d" + "/%06d" * (len(parts) - 1), *parts)

    names = findings.groupBy("rule_id").agg(F.first("rule_name").alias("rule_name"))
    by_rule = with_suggestion(group_by_rule(errors).join(names, "rule_id"))
    title = _keyed(by_rule, 4, place("seen", F.lit(0)), F.format_string("### %s %s: %d", "rule_id", "rule_name", "n"))
    advice = _keyed(by_rule.where(F.col("suggestion") != ""), 4, place("seen", F.lit(1)), F.format_string("**Advice**: %s", "suggestion"))
    seen = by_rule.select("rule_id", "seen")
    files = top_files(errors).join(seen, "rule_id")
    file_rows = _keyed(files, 4, place("seen", 10 + F.col("rank")), F.format_string("- %s: %d", "file", "n"))
    shown = examples(errors).join(seen, "rule_id")
    example_rows = _keyed(
        shown, 4, place("seen", 100 + F.col("rank")), F.format_string("- %s:%d: %s", "file", "line", "snippet")
    )
    by_both = group_by_rule_severity(others).join(names, "rule_id")
    other_title = _keyed(
        by_both, 6, place("seen", F.lit(0)), F.format_string("### %s %s (%s): %d", "rule_id", "rule_name", "severity", "n")
    )
    other_files = top_files(others, keys=("rule_id", "severity")).join(
        by_both.select("rule_id", "severity", "seen"), ["rule_id", "severity"]
    )
    other_rows = _keyed(other_files, 6, place("seen", 10 + F.col("rank")), F.format_string("- %s: %d", "file", "n"))
    parts = [head, failed_head, failed, error_head, title, advice, file_rows, example_rows, other_head, other_title, other_rows]
    return reduce(DataFrame.unionByName, parts)


def write_report(findings: DataFrame, status: DataFrame, output: str, fmt: str = "text", scan_path: str = "") -> None:
    """Write a report folder in one of the formats; an unknown format is an error.

    A report counts, ranks and lists the same rows several times, so findings and status are written
    once to the checkpoint folder, read from there, and deleted when the report stands.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown format: {fmt} (use one of {', '.join(FORMATS)})")
    spark = findings.sparkSession
    store = f"{ensure_checkpoint_dir(spark)}/report-rows-{uuid.uuid4().hex}"

    def kept(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{store}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{store}/{name}")

    try:
        findings, status = kept(findings, "findings"), kept(status, "status")
        if fmt == "json":
            lines = json_lines(findings, status).orderBy("part", "ord")
        elif fmt == "text":
            lines = text_lines(findings, status).orderBy("part", "key", "value")
        else:
            lines = markdown_lines(findings, status, scan_path).orderBy("part", "ord", "value")
        lines.select("value").write.mode("overwrite").text(output)
    finally:
        delete_folder(spark, store)
