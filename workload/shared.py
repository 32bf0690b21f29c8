"""Facts of a generated corpus, built once per session and table folder and then shared by the queries."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from coralint.operators.bundle import Facts
from coralint.session import ensure_checkpoint_dir

_SHARED: dict[tuple, Facts] = {}


def shared_facts(spark: SparkSession, sf: str, name: str, files: Callable[[], DataFrame], partitions: int) -> Facts:
    """Stored facts of the corpus ``name`` over the tables of ``sf``; facts of another folder are released first."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _SHARED:
        for old in [k for k in _SHARED if k[:2] != key[:2]]:
            dropped = _SHARED.pop(old)
            if old[0] == key[0]:
                dropped.release()
        store = f"{ensure_checkpoint_dir(spark)}/facts-{uuid.uuid4().hex}"
        _SHARED[key] = Facts(files(), clustered=True, store=store, partitions=partitions)
    return _SHARED[key]
