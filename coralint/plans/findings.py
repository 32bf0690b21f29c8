"""Relational operators over findings: filter, sort, diff, summary, ranking, gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coralint.functions.paths import file_name
from coralint.model import RULE_ORDER, RULES, SEV_RANK, SEVERITIES, RuleSpec, sev_rank
from coralint.session import ensure_checkpoint_dir


def union_findings(parts: list[DataFrame]) -> DataFrame:
    """All detectors' output, duplicates kept."""
    return reduce(DataFrame.unionByName, parts)


def filter_severity(findings: DataFrame, minimum: str) -> DataFrame:
    """This level and worse. The level's case does not matter; an unknown level is an error."""
    level = minimum.strip().lower()
    if level not in SEV_RANK:
        raise ValueError(f"unknown severity: {minimum} (use one of {', '.join(SEVERITIES)})")
    return findings.where(sev_rank(F.col("severity")) <= SEV_RANK[level])


def rule_ord(rule_id: Column, rules: list[RuleSpec] | None = None) -> Column:
    order = RULE_ORDER if rules is None else {r.rule_id: i for i, r in enumerate(rules)}
    table = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    return F.coalesce(F.try_element_at(table, rule_id), F.lit(len(order)))


def sort_keys(findings: DataFrame, order: str = "reference") -> list[Column]:
    """Severity, then path by component, line, rule and position.

    ``reference`` lists the mildest severity first, ``error_first`` the worst.
    Ties on one line keep the rule order; of one rule the later position comes first.
    """
    rank = sev_rank(F.col("severity"))
    if order not in ("reference", "error_first"):
        raise ValueError(f"unknown order: {order}")
    first = -rank if order == "reference" else rank
    keys = [first, F.split("location.file", "/"), F.col("location.line"), rule_ord(F.col("rule_id"))]
    if "off" in findings.columns:
        keys.append(-F.col("off"))
    keys.append(F.col("location.column"))
    return keys


def sort_struct(findings: DataFrame, order: str = "reference") -> Column:
    return F.struct(*[k.alias(f"k{i}") for i, k in enumerate(sort_keys(findings, order))])


def sort_findings(findings: DataFrame, order: str = "reference") -> DataFrame:
    return findings.orderBy(*sort_keys(findings, order))


def rank_rows(df: DataFrame, key: Column) -> DataFrame:
    """Global position (1-based) of every row by ``key`` without one global window.

    The rows are range-partitioned and sorted once and checkpointed, so the
    second pass sees the same partitions; then each partition numbers its own
    rows and adds the size of the partitions before it.
    """
    ensure_checkpoint_dir(df.sparkSession)
    parts = df.withColumn("_key", key).repartitionByRange("_key").withColumn("_part", F.spark_partition_id()).checkpoint()
    # One row per partition, so both the window and the broadcast are small.
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = F.broadcast(sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before")))
    within = F.row_number().over(W.partitionBy("_part").orderBy("_key"))
    return parts.withColumn("_rn", within).join(offsets, "_part").select(
        *df.columns, (F.col("_rn") + F.col("_before")).alias("rank")
    )


def rank_findings(findings: DataFrame, order: str = "reference") -> DataFrame:
    """Global position (1-based) of every finding."""
    return rank_rows(findings, sort_struct(findings, order))


def key_columns(key: tuple[str, ...]) -> list[Column]:
    """The columns of a finding that a baseline's key names."""
    return [F.col(f"location.{k}") if k in ("file", "line") else F.col(k) for k in key]


def new_findings(current: DataFrame, baseline: DataFrame, key: tuple[str, ...] = ("file", "line", "rule_id")) -> DataFrame:
    """Findings whose key is not in the baseline. Works on a stream with a static baseline."""
    known = baseline.select(*[F.col(k).alias(f"_b_{k}") for k in key]).distinct()
    cond = reduce(lambda a, b: a & b, [c.eqNullSafe(F.col(f"_b_{k}")) for k, c in zip(key, key_columns(key))])
    return current.join(known, cond, "left_anti")


def baseline_stats(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings before and after the diff, in one pass."""
    known = baseline.select(
        F.col("file").alias("_f"), F.col("line").alias("_l"), F.col("rule_id").alias("_r"), F.lit(True).alias("_known")
    ).distinct()
    cond = (
        F.col("location.file").eqNullSafe(F.col("_f"))
        & F.col("location.line").eqNullSafe(F.col("_l"))
        & F.col("rule_id").eqNullSafe(F.col("_r"))
    )
    return current.join(known, cond, "left").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("_known").isNull()).alias("new"),
        F.count_if(F.col("_known").isNotNull()).alias("known"),
    )


def summary(findings: DataFrame, status: DataFrame | None = None) -> DataFrame:
    """One row: errors, warnings, infos, files, skipped."""
    counts = findings.agg(*[F.count_if(F.col("severity") == s).alias(f"{s}s") for s in SEVERITIES])
    if status is None:
        return counts
    files = status.agg(
        F.count_if(F.col("status") == "scanned").alias("files"), F.count_if(F.col("status") == "skipped").alias("skipped")
    )
    return one_row(counts, files)


def one_row(*parts: DataFrame) -> DataFrame:
    """Put one-row DataFrames with different columns side by side."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return both.agg(*[F.first(c, ignorenulls=True).alias(c) for c in both.columns])


def _grouped(findings: DataFrame, keys: list[str]) -> DataFrame:
    groups = findings.groupBy(*keys).agg(F.count("*").alias("n"), F.min(sort_struct(findings)).alias("_first"))
    # A handful of rows: one per rule and severity.
    seen = F.row_number().over(W.orderBy("_first"))
    return groups.withColumn("seen", seen).drop("_first")


def group_by_rule(findings: DataFrame) -> DataFrame:
    """Count per rule; ``seen`` is the order of first appearance."""
    return _grouped(findings, ["rule_id"])


def group_by_rule_severity(findings: DataFrame) -> DataFrame:
    return _grouped(findings, ["rule_id", "severity"])


def top_files(findings: DataFrame, k: int = 5, keys: tuple[str, ...] = ("rule_id",)) -> DataFrame:
    """Per group the files with most findings, by file name; ties by first appearance.

    Counts are aggregated first. The rank filter lets Spark keep only ``k`` rows
    per group before the shuffle, so a group with billions of files stays small.
    """
    named = findings.withColumn("file", file_name(F.col("location.file"))).withColumn("_key", sort_struct(findings))
    counts = named.groupBy(*keys, "file").agg(F.count("*").alias("n"), F.min("_key").alias("_first"))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("n"), "_first"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k).drop("_first")


def examples(findings: DataFrame, k: int = 3) -> DataFrame:
    """The first findings of each rule with their trimmed snippet."""
    rank = F.row_number().over(W.partitionBy("rule_id").orderBy("_key"))
    return (
        findings.withColumn("_key", sort_struct(findings))
        .withColumn("rank", rank)
        .where(F.col("rank") <= k)
        .select(
            "rule_id",
            "rank",
            F.col("location.file").alias("file"),
            F.col("location.line").alias("line"),
            F.coalesce(F.trim("snippet"), F.lit("")).alias("snippet"),
        )
    )


def with_suggestion(findings: DataFrame, rules: list[RuleSpec] | None = None) -> DataFrame:
    """Advice per rule; empty for unknown rules. The table of advice is a constant map."""
    table = F.create_map(*[F.lit(x) for r in (rules or RULES) for x in (r.rule_id, r.advice)])
    return findings.withColumn("suggestion", F.coalesce(F.try_element_at(table, F.col("rule_id")), F.lit("")))


def gate(findings: DataFrame) -> DataFrame:
    """One row: ``failed`` is true when any error finding remains."""
    return findings.agg(
        F.coalesce(F.bool_or(F.col("severity") == "error"), F.lit(False)).alias("failed"),
        F.count_if(F.col("severity") == "error").alias("errors"),
    )


def compare_runs(findings: DataFrame) -> DataFrame:
    """Totals per snapshot and severity with the change against the snapshot before."""
    per = findings.groupBy("snapshot").agg(
        F.count("*").alias("total"), *[F.count_if(F.col("severity") == s).alias(f"{s}s") for s in SEVERITIES]
    )
    # One row per snapshot.
    order = W.orderBy("snapshot")
    return per.select(
        "*",
        (F.col("total") - F.lag("total").over(order)).alias("total_change"),
        (F.col("errors") - F.lag("errors").over(order)).alias("errors_change"),
    )


def split_by_severity(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Error findings, and the rest."""
    is_error = F.col("severity") == "error"
    return findings.where(is_error), findings.where(~is_error)
