"""Every registered query has a SQL counterpart; some are compared on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from workload.oracle import oracle
from workload.queries import QUERIES

SF = "/root/testdata/sf0.001"
SAMPLE = ["scan_ignore_inherited", "facts_lines", "facts_tokens_lossless", "top_files", "sort_ranked", "r14_secrets_documents", "stream_new_findings", "stream_unseen_findings", "review_by_rule", "facts_functions_all_kinds", "facts_calls_in_template", "facts_pattern_literals", "r10_contexts", "r02_braceless", "r18_in_template", "scan_folder", "report_markdown_full", "facts_functions", "facts_calls", "facts_enclosing_function", "facts_tokens_by_kind"]


def test_registry_is_complete():
    assert set(QUERIES) == set(oracle())
    assert len(QUERIES) >= 90
    assert set(QUERIES) <= set(entry.queries()) and set(oracle()) <= set(entry.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in cols) for r in df.collect())
    rel = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = sorted(tuple(str(dict(zip(names, r))[c]) for c in cols) for r in rel.fetchall())
    assert got == want
