"""Rule catalogue, severities, configuration and schemas."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Severity names in rank order.
SEVERITIES = ["error", "warning", "info"]
SEV_RANK = {name: i for i, name in enumerate(SEVERITIES)}

ALL_LANGUAGES = ["rust", "python", "typescript", "tsx", "csharp", "java"]
_SCRIPT = ["python", "typescript", "tsx"]


@dataclass(frozen=True)
class RuleSpec:
    """Identity and applicability of one detector."""

    rule_id: str
    name: str
    severity: str
    languages: tuple[str, ...]
    thresholds: dict[str, int] = field(default_factory=dict, hash=False)
    advice: str = ""


def _rule(rule_id, name, severity, languages, advice, **thresholds) -> RuleSpec:
    return RuleSpec(rule_id, name, severity, tuple(languages), thresholds, advice)


# Rule ids, names, severities, languages and default thresholds. Advice is our wording.
RULES = [
    _rule("R01", "fallback-masks-error", "error", ALL_LANGUAGES, "Log or propagate the failure instead of hiding it behind a default."),
    _rule("R02", "structural-bloat", "warning", ALL_LANGUAGES, "Split the function, flatten its branches or group its parameters.",
          max_function_lines=50, max_parameters=5, max_nesting_depth=4),
    _rule("R03", "missing-doc", "warning", ALL_LANGUAGES, "Describe the public item in a documentation comment, or switch the rule off."),
    _rule("R04", "simple-unit-test", "warning", ALL_LANGUAGES, "Assert on results, edge cases and failures.", min_assertions=1),
    _rule("R05", "shallow-integration-test", "warning", ALL_LANGUAGES, "Check the response content and side effects too.", min_checks=3),
    _rule("R06", "over-engineering", "info", ALL_LANGUAGES, "Use the concrete type until a second implementation appears.", max_generics=3),
    _rule("R07", "dead-code", "warning", ["rust", "python", "typescript", "tsx", "java"], "Remove the import nobody uses."),
    _rule("R08", "todo-fixme-accumulation", "info", ALL_LANGUAGES, "Resolve the note or move it to the issue tracker."),
    _rule("R09", "commented-out-code", "warning", ALL_LANGUAGES, "Delete the dead block; version control keeps it.", min_block_lines=3),
    _rule("R10", "magic-number", "info", ALL_LANGUAGES, "Give the number a name."),
    _rule("R14", "hardcoded-secret", "error", ALL_LANGUAGES, "Move the secret out of the source and rotate it."),
    _rule("R15", "missing-input-validation", "warning", ALL_LANGUAGES, "Check emptiness and bounds before using the input."),
    _rule("R16", "self-validating-test", "warning", ALL_LANGUAGES, "Name the expected behaviour and test through the public surface."),
    _rule("R18", "async-missing-await", "error", _SCRIPT, "Await the call or handle the pending result."),
    _rule("R19", "n-plus-one-query", "warning", _SCRIPT, "Prefetch the related rows before the loop."),
    _rule("R20", "resource-leak", "warning", _SCRIPT, "Release the resource on every path."),
    _rule("R23", "wrong-error-type-propagation", "warning", ["python", "typescript", "tsx", "csharp", "java"], "Keep the error type visible to the caller."),
    _rule("R24", "hardcoded-path-or-url", "warning", ALL_LANGUAGES, "Read paths and addresses from configuration."),
    _rule("R28", "overly-defensive-handling", "info", ["rust", "typescript", "tsx"], "Drop the guard around a value that cannot fail."),
]
RULES_BY_ID = {r.rule_id: r for r in RULES}
RULE_ORDER = {r.rule_id: i for i, r in enumerate(RULES)}

RULES_SCHEMA = T.StructType(
    [
        T.StructField("rule_id", T.StringType()),
        T.StructField("rule_name", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("sev_rank", T.ByteType()),
        T.StructField("rule_ord", T.IntegerType()),
        T.StructField("languages", T.ArrayType(T.StringType())),
        T.StructField("advice", T.StringType()),
    ]
)

HIT_SCHEMA = (
    "fid {fid}, rule_id string, variant string, severity string, row int, col int, off int, "
    "subject string, measure bigint, limit bigint, snippet string, has_snippet boolean"
)


def list_rules(spark: SparkSession, rules: list[RuleSpec] | None = None) -> DataFrame:
    """The rule dimension, one row per rule."""
    rows = [
        (r.rule_id, r.name, r.severity, SEV_RANK[r.severity], i, list(r.languages), r.advice)
        for i, r in enumerate(rules or RULES)
    ]
    return spark.createDataFrame(rows, RULES_SCHEMA)


def sev_rank(severity: Column) -> Column:
    return F.when(severity == "error", 0).when(severity == "warning", 1).when(severity == "info", 2).cast("tinyint")


@dataclass
class RuleConfig:
    """Settings of one rule. A rule that leaves out ``enabled`` is enabled."""

    enabled: bool = True
    severity: str | None = None
    thresholds: dict[str, Any] = field(default_factory=dict)
    exclude_files: list[str] = field(default_factory=list)


@dataclass
class Config:
    """One configuration: extra excluded names and per-rule settings."""

    exclude: list[str] = field(default_factory=list)
    rules: dict[str, RuleConfig] = field(default_factory=dict)
    # Parsed severities change nothing unless this is switched on.
    apply_severity: bool = False

    @classmethod
    def from_dict(cls, raw: dict[str, Any] | None) -> "Config":
        raw = raw or {}
        rules = {
            rid: RuleConfig(
                enabled=r.get("enabled", True),
                severity=r.get("severity"),
                thresholds=dict(r.get("thresholds", {})),
                exclude_files=list(r.get("exclude_files", [])),
            )
            for rid, r in raw.get("rules", {}).items()
        }
        return cls(exclude=list(raw.get("global", {}).get("exclude", [])), rules=rules)

    @classmethod
    def from_toml(cls, path: str) -> "Config":
        import tomllib

        with open(path, "rb") as f:
            return cls.from_dict(tomllib.load(f))

    def enabled(self, rule_id: str) -> bool:
        return self.rules.get(rule_id, RuleConfig()).enabled

    def threshold(self, rule: RuleSpec, key: str) -> int:
        """Configured integer, or the rule's default when absent or not an integer."""
        value = self.rules.get(rule.rule_id, RuleConfig()).thresholds.get(key)
        ok = isinstance(value, int) and not isinstance(value, bool)
        return value if ok else rule.thresholds[key]

    def excluded_names(self, rule_id: str) -> list[str]:
        return [p.lower() for p in self.rules.get(rule_id, RuleConfig()).exclude_files]
