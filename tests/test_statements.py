"""Statements cut in the task that holds a file, with the files of one key taken together."""

import pytest
from pyspark.sql import functions as F

from coralint.operators import lexemes as L
from coralint.operators import statements as S
from coralint.operators.bundle import Facts
from coralint.operators.detectors import function_rules as FR
from coralint.operators.detectors import literal_rules as LR

SCHEMA = "fid long, language string, text string"
ROWS = [
    (1, "rust", "/// doc\nfn f(a: i64) {\n    g(\"x\");\n}\n"),
    (2, "typescript", "const a = 1\nlet b = `t${c}u`\nd()\n"),
    (3, "python", "x = 1 + \\\n    2\nfor y in x:\n    z(\n1)\n"),
    (4, "java", "int ü = 1; // ;\nchar q = '}';"),
    (5, "cobol", "a;"),
    (None, None, None),
    (6, "rust", ""),
]
HEADS = {
    (1, 0, 'fn f ( ) { }', 8, 36, 1),
    (1, 1, 'a: i64', 13, 19, 1),
    (1, 1, 'g ( ) ;', 27, 34, 2),
    (1, 2, '""', 29, 32, 2),
    (2, 0, 'const a = 1', 0, 11, 0),
    (2, 0, 'let b = "" ${ }` d ( )', 12, 32, 1),
    (2, 1, 'c', 24, 25, 1),
    (3, 0, 'for y in x:', 16, 27, 2),
    (3, 0, 'x = 1 + \\ 2', 0, 15, 0),
    (3, 0, 'z ( )', 32, 37, 3),
    (3, 1, '1', 35, 36, 4),
    (4, 0, 'char q = "" ;', 17, 30, 1),
    (4, 0, 'int ü = 1 ;', 0, 11, 0),
}


def listed(df):
    return {(r.fid, r.level, r.head, r.off, r.end_off, r.row) for r in df.collect()}


@pytest.mark.parametrize("chars", [1, S.CHARS_AT_ONCE])
def test_statements_of_every_language(spark, monkeypatch, chars):
    monkeypatch.setattr(S, "CHARS_AT_ONCE", chars)
    files = spark.createDataFrame(ROWS, SCHEMA)
    # In the driver too, so that the size of a piece takes effect.
    rows = files.select("fid", F.array(F.struct("language", "text", (F.col("fid") == 2).alias("scan"))).alias("files"), F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    found = [r for b in S._statements(rows.toArrow().to_batches()) for r in b.to_pylist()]
    assert {(r["fid"], r["level"], r["head"], r["off"], r["end_off"], r["row"]) for r in found} == HEADS
    assert listed(S.statements(files)) == HEADS


def test_rows_of_a_repeated_key_are_taken_together(spark):
    text = "fn f() {\n}\n"
    files = spark.createDataFrame([(7, "rust", text), (7, "rust", text), (8, "rust", text)], SCHEMA).repartition(3)
    assert listed(S.statements(files).where("fid = 7 AND level = 0")) == {(7, 0, "fn f fn f ( ) { }", 0, 20, 0)}
    assert listed(S.statements(files).where("fid = 8")) == {(8, 0, "fn f ( ) { }", 0, 10, 0)}


def test_no_lexeme_is_a_row_of_spark(spark, tmp_path):
    files = spark.createDataFrame(ROWS, SCHEMA).repartition(2, "fid")
    plan = S.statements(files)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan
    with Facts(files, clustered=True, store=str(tmp_path), partitions=2) as facts:
        assert listed(facts.statements) == HEADS
        # One file per bucket: what a task cuts stays in its bucket.
        assert len(list(tmp_path.glob("*/statements/*.parquet"))) <= 2


def test_only_files_with_a_loop_word_are_cut_for_loops(spark, tmp_path):
    with Facts(spark.createDataFrame(ROWS, SCHEMA), store=str(tmp_path), partitions=2) as facts:
        assert [(r.fid, r["var"], r["source"]) for r in facts.loops.collect()] == [(3, "y", "x")]
        assert "statements" not in facts.__dict__


def test_texts_of_blanks_and_comments_alone_have_no_statements(spark):
    files = spark.createDataFrame([(1, "rust", "// note\n"), (2, "python", "\n\n"), (3, "java", "/* a */")], SCHEMA).repartition(1)
    assert listed(S.statements(files)) == set()


CODE = [
    (1, "typescript", "interface I { f(a: 5): 6 }\nfoo\n  .bar(7).baz?.()\nconst t = `a${run(x)}`\nf(a: 9)\n"),
    (2, "rust", "#[cfg(a)]\nfn f() { match v { P { a: 7 } => 8, 9 if x => y!(12), _ => 3 } }\n"),
    (3, "java", "class A { int hashCode() { return 31; } int g() { return a.b(44).c(); } }\n"),
    (4, "python", "def f(a=5):\n    return f\"{g(6)}\" + h.k(\n 77)\n"),
    (5, "csharp", "/// doc\n[A(3)] int x = $\"v{go(7)}\".Trim();\n}) ;\n"),
    (5, "csharp", "/// doc\n[A(3)] int x = $\"v{go(7)}\".Trim();\n}) ;\n"),
    (6, "rust", "// blanks alone\n"),
    (None, None, None),
]


def test_tokens_cut_in_the_task_are_those_of_the_windows(spark):
    files = spark.createDataFrame([*ROWS, *CODE], SCHEMA).repartition(2)
    lexed = L.lexemes(files)
    pairs = [(L.tokens(lexed), "tokens"), (L.comments(lexed), "comments"), (L.string_literals(lexed), "strings")]
    for wanted, what in pairs:
        found = S.tokens(files, what).select(*wanted.columns)
        assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, found.collect())) == sorted(map(str, wanted.collect())), what


def test_facts_and_rules_read_few_tokens(spark, tmp_path):
    files = spark.createDataFrame([r for r in CODE if r[0] != 5], SCHEMA)
    with Facts(files, store=str(tmp_path), partitions=2) as facts:
        assert facts.openings.where("role = 'open'").count() == S.tokens(files).where("role = 'open'").count()
        assert {(r.fid, r.name) for r in facts.calls.collect()} == {(1, "bar"), (1, "run"), (1, "f"), (2, "cfg"), (3, "b"), (3, "c"), (4, "g"), (4, "k")}
    with Facts(files, store=str(tmp_path), partitions=2) as facts:
        found = {(r.fid, r.subject) for r in LR.detect_r10(facts).collect()}
        assert found == {(1, "7"), (2, "8"), (2, "3"), (3, "44"), (4, "5"), (4, "6"), (4, "77")}
        assert [t.rsplit("_", 1)[1] for t in facts._tables] == ["files", "judged"]
        # Of the functions only those of files that can hold a hash are cut.
        assert not {"statements", "functions", "tokens", "lexemes"} & facts.__dict__.keys()


def test_nesting_and_integration_tests_store_no_bodies(spark, tmp_path):
    rows = [(1, "java", "class A { void test_api() { if (a) { for (;;) { while (b) { request(); } } } } }\n")]
    with Facts(spark.createDataFrame(rows, SCHEMA), store=str(tmp_path), partitions=2) as facts:
        assert [(r.subject, r.measure) for r in FR.deep_nesting(facts, 2).collect()] == [("test_api", 7)]
        assert [(r.subject, r.measure) for r in FR.detect_r05(facts).collect()] == [("test_api", 1)]
        assert not {"blocks", "loops", "functions"} & facts.__dict__.keys()
