"""Functions come from statements: neither lexemes nor tokens nor blocks are stored for them, and texts only where they are read."""

from pyspark.sql import functions as F

from coralint.operators.bundle import Facts
from coralint.operators.detectors import function_rules as FR

SCRIPT = """class A {
  go: (x: number) => void;
  run(a, b) { return a.map(v => v + 1).filter((w) => { return w; }); }
}
type T = { f: (x: string) => string };
const one = async (p, q = 2): Promise<void> => { await p; }, two = r => r * 2;
export function wide0(a, b, c, d, e, f) { if (a) { b(); } }
"""
PYTHON = "def wide1(a, b, c, d, e, f):\n    for x in a:\n        print(x)\n"
RUST = "#[test]\nfn t_one() {\n    let a = 1;\n}\n"
ROWS = [(1, "typescript", SCRIPT), (2, "python", PYTHON), (3, "rust", RUST), (4, "typescript", None), (None, "rust", RUST)]
SCHEMA = "fid long, language string, text string"


def facts(spark, tmp_path, rows=ROWS):
    return Facts(spark.createDataFrame(rows, SCHEMA), store=str(tmp_path), partitions=2)


def test_functions_without_tokens(spark, tmp_path):
    with facts(spark, tmp_path) as f:
        found = sorted((r.fid, r.kind, r.name, r.row) for r in f.function_spans.where("fid IS NOT NULL").collect())
        arrows = [("arrow_function", "", row) for row in (2, 2, 5, 5)]
        assert found == [
            *[(1, *a) for a in arrows],
            (1, "function_declaration", "wide0", 6),
            (1, "method_definition", "run", 2),
            (2, "function_definition", "wide1", 0),
            (3, "function_item", "t_one", 1),
        ]
        assert sorted((r.fid, r.subject, r.measure) for r in FR.many_params(f).collect()) == [(1, "wide0", 6), (2, "wide1", 6)]
        assert not {"lexemes", "tokens", "blocks", "functions"} & f.__dict__.keys()


def test_functions_with_texts_and_params(spark, tmp_path):
    with facts(spark, tmp_path) as f:
        bodies = {r.body for r in f.functions.where(F.col("kind") == "arrow_function").collect()}
        assert bodies == {"v => v + 1", "(w) => { return w; }", "(p, q = 2): Promise<void> => { await p; }", "r => r * 2"}
        names = sorted((r.fid, r.name) for r in f.params.where("fid > 1").collect())
        assert names == [(2, n) for n in "abcdef"]
        assert "tokens" not in f.__dict__


def test_a_repeated_file_gives_its_functions_for_each_row(spark, tmp_path):
    with facts(spark, tmp_path, [ROWS[1], ROWS[1]]) as f:
        cols = ["fid", "kind", "name", "off", "end_off"]
        assert sorted(map(tuple, f.function_spans.select(*cols).collect())) == sorted(map(tuple, f.functions.select(*cols).collect()))


def test_tests_of_scripts_alone_need_tokens(spark, tmp_path):
    script = "test('a', () => { run(); });\nit('b', () => { expect(1); });\n"
    with facts(spark, tmp_path, [*ROWS, (5, "tsx", script)]) as f:
        assert sorted((r.fid, r.subject) for r in FR.detect_r04(f).where("fid IS NOT NULL").collect()) == [(3, "t_one"), (5, "test")]
        assert "tokens" not in f.__dict__
        with_tokens = [p for p in f._parts.values() if "tokens" in p.__dict__]
        assert [sorted(r.fid for r in p.files.collect()) for p in with_tokens] == [[1, 5]]  # "await" holds a fragment
