"""Baseline of known findings, read from earlier reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FINDING = "rule_id string, location struct<file:string, line:int>, snippet string"
_DOCUMENT = "findings array<struct<rule_id:string, location:struct<file:string, line:int>, snippet:string>>"
KEY = ("file", "line", "rule_id")


def load_baseline(spark: SparkSession, path: str, layout: str = "document", key: tuple[str, ...] = KEY) -> DataFrame:
    """The key columns of a report's findings. Unreadable or malformed JSON is an error.

    ``document`` is one nested report in one file, ``report`` the same as written by
    ``write_report`` in any number of files, ``lines`` one finding per line, ``parquet`` a
    findings table. ``key`` may also name ``snippet``, which survives moved lines.
    """
    if layout == "document":
        doc = spark.read.schema(_DOCUMENT).json(path, multiLine=True, mode="FAILFAST")
        rows = doc.select(F.explode("findings").alias("f")).select("f.*")
    elif layout == "report":
        # Findings stand on lines of their own, behind a comma but for the first.
        lines = spark.read.text(path).select(F.regexp_extract("value", r'^,?(\{"rule_id".*\})$', 1).alias("v"))
        rows = lines.where("v <> ''").select(F.from_json("v", _FINDING, {"mode": "FAILFAST"}).alias("f")).select("f.*")
    elif layout == "lines":
        rows = spark.read.schema(_FINDING).json(path, mode="FAILFAST")
    elif layout == "parquet":
        rows = spark.read.parquet(path)
    else:
        raise ValueError(f"unknown layout: {layout}")
    return baseline_of(rows, key)


def baseline_of(findings: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """The baseline keys of findings already in a DataFrame."""
    places = {"file": F.col("location.file"), "line": F.col("location.line")}
    return findings.select(*[places.get(k, F.col(k)).alias(k) for k in key]).distinct()
