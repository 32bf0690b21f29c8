import hashlib

import pytest

import corpus_pipeline as P
from coralint.llm.common import stored

SF = "/root/testdata/sf0.001"


def test_stages_over_a_table(spark):
    docs = first = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), "test-stage")
        assert docs.columns == first.columns
    by_id = {}
    for r in docs.collect():
        by_id.setdefault(r.doc_id, []).append(r.text)
    out = P.run(spark, SF).collect()
    assert sorted(r.doc_id for r in out) == sorted(i for i, t in by_id.items() for _ in t)
    assert all(len(r.ids) == 4 * r.n_tokens for r in out)
    assert all(r.decoded_sha256 == hashlib.sha256((by_id[r.doc_id][0] or "").encode()).hexdigest() for r in out)
    assert max(len(t) for t in by_id.values()) <= 2


@pytest.mark.parametrize("k", range(5))
def test_each_stage_takes_nulls_repeats_extras_and_nothing(spark, k):
    line = "A long line that many documents have in common"
    rows = [(None, None, None, None, None, "z"), (1, "", "en", "s", 0, None), (2, line, "en", None, 5, "z"), (2, line, "en", None, 5, "z"), (3, f"{line}\nb", "de", "s", 9, "z"), (4, f"{line}\nc " + "w " * 60_000, "de", "s", 9, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string")
    stage = P.STAGES[k][1]
    out = stage(spark, df, SF)
    assert out.count() >= 0
    if k < 4:
        assert out.columns == df.columns
    assert stage(spark, df.limit(0), SF).count() == 0
