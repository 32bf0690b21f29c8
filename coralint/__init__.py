"""Review of source-code corpora as Spark jobs."""

from coralint.model import RULES, Config, RuleConfig, RuleSpec, list_rules
from coralint.operators.bundle import Facts
from coralint.plans.review import detect, register_detector, review, rule_scope
from coralint.session import build_session
from coralint.sources.corpus import scan, scan_table

__all__ = [
    "RULES",
    "Config",
    "Facts",
    "RuleConfig",
    "RuleSpec",
    "build_session",
    "detect",
    "list_rules",
    "register_detector",
    "review",
    "rule_scope",
    "scan",
    "scan_table",
]
