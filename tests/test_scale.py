"""Work that grows with what a query needs: texts move, not lexemes; files without a match are left out."""

from pyspark.sql import functions as F

from coralint.functions.modes import needs_scan
from coralint.operators import facts as X
from coralint.operators.bundle import Facts
from coralint.operators.detectors import name_rules as NR
from coralint.plans import review as R
from coralint.session import partitions_for

ROWS = [
    (1, "typescript", 'import { a } from "./lib"; // and/or\nconst b = \'x/y\';\n'),
    (2, "typescript", "const c = a / b;\n"),
    (3, "typescript", "const d = '\"' + e / f;\n"),
    (4, "rust", "trait T {\n}\nimpl T for U {}\n"),
    (5, "rust", "trait V {\n}\n"),
    (6, "rust", "fn f() {\n}\n"),
    (7, "python", "trait = 1\n"),
    (7, "python", "trait = 2\n"),
    (None, "rust", None),
]
SCHEMA = "fid long, language string, text string"


def test_only_a_slash_in_code_needs_the_scan(spark):
    files = spark.createDataFrame(ROWS, SCHEMA)
    assert sorted(r.fid for r in files.where(needs_scan(F.col("text"), F.col("language"))).collect()) == [2, 3]


def test_texts_are_shuffled_and_lexemes_are_not(spark, tmp_path):
    with Facts(spark.createDataFrame(ROWS, SCHEMA), store=str(tmp_path), partitions=2) as facts:
        plan = facts._lexed()._jdf.queryExecution().executedPlan().toString()
        assert plan.index("Generate") < plan.index("Exchange")  # a plan begins with its last step


def test_only_files_that_can_match_are_cut(spark, tmp_path):
    files = spark.createDataFrame(ROWS, SCHEMA)
    with Facts(files, store=str(tmp_path), partitions=2) as facts:
        some = facts.among(["rust"], ["trait"])
        assert sorted(r.fid for r in some.files.collect()) == [4, 5]
        found = [(r.fid, r.subject) for r in NR.single_impl_traits(facts).collect()]
        assert sorted(found) == [(4, "T"), (5, "V")]
        assert "statements" not in facts.__dict__ and "statements" in some.__dict__
        assert not {"lexemes", "tokens"} & some.__dict__.keys()
        # With tables at hand there is nothing to save.
        facts.statements
        assert facts.among(["python"]) is facts


def test_partitions_stay_as_large_however_many_files(spark, tmp_path):
    spark.range(200_000).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert partitions_for(table, 1000) == most
    assert partitions_for(table, 1000, capped=False) > most


def test_a_review_in_slices_finds_the_same_and_keeps_no_facts(spark, tmp_path, monkeypatch):
    rows = [*ROWS, (8, "python", "import os\ndef test_a():\n    pass\n"), (9, "java", "class A {\n  // TODO x\n  int n = 4711;\n}\n")]
    files = spark.createDataFrame([(f, None if f is None else f"f{f}.x", *r) for f, *r in rows], "fid long, path string, language string, text string")
    plain, sliced = (Facts(files, store=str(tmp_path / d), partitions=3) for d in ("plain", "sliced"))
    with plain, sliced:
        wanted = sorted(map(str, R.detect(plain).collect()))
        monkeypatch.setattr(R, "PARTITIONS_AT_ONCE", 1)
        assert sorted(map(str, R.detect(sliced).collect())) == wanted and len(wanted) > 4
        # Of the facts of all files only the texts are stored, and nothing of the slices is left.
        assert [t.rsplit("_", 1)[1] for t in sliced._tables] == ["files"]
        assert sorted(p.name.split("-")[0] for p in (tmp_path / "sliced").glob("*/*")) == ["files", "hits"]


def test_only_texts_that_can_interpolate_are_searched_for_literals(spark):
    rows = [
        (1, "typescript", "const a = `${b}`;\n"),
        (2, "typescript", "const c = 'f\"';\n"),
        (3, "python", "d = rF'{e}'\n"),
        (4, "python", "g = '{h}'\n"),
        (5, "java", 'String i = "f`";\n'),
        (None, None, None),
    ]
    files = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.fid for r in files.where(X.may_interpolate(F.col("text"), F.col("language"))).collect()) == [1, 3]
    found = {(r.fid, r.name) for r in X.identifiers(files).collect()}
    assert {(1, "b"), (3, "e")} <= found and not {"h", "f"} & {name for _, name in found}


def test_no_join_sends_a_table_of_facts_to_every_executor(spark, tmp_path):
    files = spark.createDataFrame([(1, "typescript", "const f = (a) => a;\n"), (2, "rust", "fn g() {}\n")], SCHEMA)
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").removesuffix("b")) > 1000
    with Facts(files, store=str(tmp_path), partitions=2) as facts:
        for df in (X.functions(facts._function_rows, facts.files), facts.function_spans, X.loops(facts.statements, facts.blocks, facts.files)):
            assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    plain = Facts(files, partitions=2)
    assert "Broadcast" not in X.import_statements(plain.statements, plain.files)._jdf.queryExecution().executedPlan().toString()
