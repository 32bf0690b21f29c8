"""Bench: builds the facts of the corpus and runs the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from coralint.session import build_session  # noqa: E402
from workload.queries import QUERIES, facts  # noqa: E402

HEADLINE = [
    "facts_tokens_lossless",
    "scan_ignore_inherited",
    "r01_catch_return",
    "r02_nesting",
    "r03_missing_doc",
    "r04_few_assertions",
    "r06_single_impl_repo",
    "r07_unused_import",
    "r09_commented_code",
    "r10_magic_number",
    "r14_secrets_documents",
    "r15_missing_validation",
    "r18_missing_await_ts",
    "r24_path_url_code",
    "baseline_diff",
    "top_files",
    "sort_ranked",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("coralint-bench", f"local[{cpus}]", partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name: str, action) -> None:
        start = time.perf_counter()
        action()
        times[name] = round(time.perf_counter() - start, 3)

    corpus = facts(spark, sf)
    timed("facts_build", lambda: [getattr(corpus, n) for n in (
        "lexemes", "strings", "tokens", "statements", "blocks", "functions", "params", "catches", "calls", "loops", "types", "async_names")])
    timed("review_by_rule", lambda: QUERIES["review_by_rule"](spark, sf).collect())
    for name in HEADLINE:
        timed(name, lambda: QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save())
    size = corpus.files.agg(F.count("*").alias("files"), F.sum(F.size(F.split("text", "\n")) - 1).alias("lines")).first()
    full = times["facts_build"] + times["review_by_rule"]
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(os.path.basename(sf.rstrip("/")).replace("sf", "") or 0),
                "cpus": cpus,
                "files": size["files"],
                "lines": size["lines"],
                "full_review_lines_per_sec": round(size["lines"] / full),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
