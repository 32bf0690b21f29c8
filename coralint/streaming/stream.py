"""Review of files as they arrive.

A file arrives whole within one micro-batch, so no state crosses batches: the
detectors run inside ``foreachBatch`` and known findings are dropped against a
static baseline. ``unseen_stream`` keeps state instead: what one batch reports is
known to all later ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from coralint.model import Config
from coralint.operators.bundle import Facts
from coralint.plans.findings import filter_severity, key_columns, new_findings
from coralint.plans.review import detect
from coralint.session import ensure_checkpoint_dir


def review_stream(
    files: DataFrame,
    output: str,
    checkpoint: str,
    rules: list[str] | None = None,
    config: Config | dict | None = None,
    severity: str | None = None,
    baseline: DataFrame | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Review a stream of file rows and write findings as Parquet, one folder per batch.

    A batch that is run again after a failure overwrites its own folder, so every
    finding is written once.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        store = f"{ensure_checkpoint_dir(batch.sparkSession)}/coralint"
        with Facts(batch, store=store) as facts:
            found = detect(facts, rules, config)
            if severity:
                found = filter_severity(found, severity)
            if baseline is not None:
                found = new_findings(found, baseline)
            found.write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    writer = files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def findings_stream(
    findings: DataFrame, output: str, checkpoint: str, severity: str | None = None, baseline: DataFrame | None = None
) -> StreamingQuery:
    """Filter and diff a stream of findings: a stateless plan with a stream-static anti join."""
    out = filter_severity(findings, severity) if severity else findings
    if baseline is not None:
        out = new_findings(out, baseline)
    return (
        out.writeStream.format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _unless_seen(forget_ms: int | None):
    """All findings of a key in the batch that first has it, none later."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = state.exists
        state.update((True,))
        if forget_ms is not None:
            state.setTimeoutDuration(forget_ms)
        for part in parts:
            if not known:
                yield part[["finding"]]

    return run


def unseen_stream(
    findings: DataFrame,
    output: str,
    checkpoint: str,
    severity: str | None = None,
    baseline: DataFrame | None = None,
    key: tuple[str, ...] = ("file", "line", "rule_id"),
    forget_ms: int | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Write each finding of a stream whose key no earlier batch had, and remember its key.

    Keys are kept in the state store under ``checkpoint``, hashed over its partitions, so a batch
    shuffles its own findings alone, whatever is known already, and a restart goes on with what it
    knew. Findings that share a key within the batch that first has it are all written, as in a diff
    of two runs; null parts of a key equal each other. ``forget_ms`` drops a key that was not seen for
    so long, which bounds the state; without it the state grows with the distinct keys. ``baseline``
    holds keys known from the start.
    """
    out = filter_severity(findings, severity) if severity else findings
    if baseline is not None:
        out = new_findings(out, baseline, key)
    names = [f"key_{i}" for i in range(len(key))]
    # As one string a finding passes Python unchanged, whatever its columns are.
    keyed = out.select(*[c.alias(n) for c, n in zip(key_columns(key), names)], F.to_json(F.struct(*out.columns)).alias("finding"))
    timeout = GroupStateTimeout.NoTimeout if forget_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    unseen = keyed.groupBy(*names).applyInPandasWithState(_unless_seen(forget_ms), "finding string", "seen boolean", "append", timeout)
    return (
        unseen.select(F.from_json("finding", out.schema).alias("f"))
        .select("f.*")
        .writeStream.format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
