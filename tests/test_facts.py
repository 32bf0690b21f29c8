"""Properties of the fact tables and of the sweep operators."""

import random

from pyspark.sql import functions as F

from coralint.functions.lexer import lexemes_of
from coralint.functions.text import body_uses_word, contains_word, returns_hardcoded_default, shannon_entropy
from coralint.operators import lexemes as L
from coralint.operators import sweep
from coralint.operators.bundle import Facts
from coralint.operators.detectors import literal_rules as LR

TRICKY = [
    ("a.rs", "fn a<'x>(s: &'x str) -> char { let r = r#\"x \" {\"#; let c = '\\''; let d = '{'; /* } */ b'\"' }\n"),
    ("a.py", "x = r'\\' # '\ny = f\"{a['b']}\" '''not # a comment\n'''\nz = \"\"\"a\n\"b\" \"\"\"\n"),
    ("a.ts", "const a = /[\"'/]\\/x/g.test(b) ? c / d : `x ${e} // y`; // don't\nconst f = 'é' + g\n"),
    ("a.cs", "class A { string a = @\"c:\\\"; string b = $\"{c} \\\"\"; string d = @\"x \"\" y\"; char e = '\"'; }\n"),
    ("A.java", "class A { String a = \"\"\"\n  \"x\" } \\\"\n  \"\"\"; char b = '\\u0041'; }"),
    ("b.py", "unterminated = 'abc\n{[(\r\nx = 1 \\\n  + 2\r\n"),
    ("c.rs", "/* never closed \n fn x() {"),
    ("d.ts", "'" * 5000 + "{" * 5000),
    ("e.java", "\"" + "x\\\"" * 300000 + "\";"),
]


def test_lexemes_lose_nothing(corpus):
    files = corpus(TRICKY)
    back = files.select("text", F.array_join(lexemes_of(F.col("text"), F.col("language")), "").alias("joined"))
    assert back.where("text <> joined").count() == 0


def test_literals_and_comments_hide_brackets(corpus):
    files = corpus(TRICKY[:5])
    change = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    depth = L.lexemes(files).groupBy("fid").agg(F.sum(change).alias("d"))
    assert {r.d for r in depth.collect()} == {0}


def test_lines_follow_line_ends(corpus):
    rows = L.lines(corpus([("a.py", "a\r\nb\n\nc"), ("b.py", "a\n"), ("c.py", "\n")])).orderBy("fid", "row").collect()
    assert [(r.fid, r.row, r.line) for r in rows] == [(0, 0, "a"), (0, 1, "b"), (0, 2, ""), (0, 3, "c"), (1, 0, "a"), (2, 0, "")]


def test_columns_count_bytes(corpus):
    facts = Facts(corpus([("a.py", 'x = "é€" # todo\n')]))
    assert facts.comments.first().col == len('x = "é€" '.encode())
    assert facts.comments.first().off == len('x = "é€" '.encode())


def test_python_blocks_end_before_dedent(corpus):
    src = "def a():\n    if b:\n        c(1,\n2)\n    # note\n\n    d()\n# tail\ndef e(): return 1\nf()\n"
    rows = Facts(corpus([("a.py", src)])).blocks.orderBy("row").collect()
    assert [(r.row, r.row_end) for r in rows] == [(0, 6), (1, 3), (8, 8)]


def test_function_spans_and_names(corpus):
    src = "class A { A(int x) { } int b() { new C() { void d() { } }; return 1; } }"
    rows = Facts(corpus([("A.java", src)])).functions.orderBy("off").collect()
    assert [(r.name, r.kind, r.body[-1]) for r in rows] == [
        ("A", "constructor_declaration", "}"), ("b", "method_declaration", "}"), ("d", "method_declaration", "}"),
    ]


def test_result_does_not_depend_on_partitions_or_other_files(corpus):
    a = ("a.py", "def f():\n    x = 42\n    return x\n")
    alone = Facts(corpus([a]), partitions=1).functions.drop("fid").collect()
    among = Facts(corpus([a, *TRICKY]), partitions=7).functions.where("fid = 0").drop("fid").collect()
    assert alone == among


def _nested_spans(rng, lo, hi, depth):
    out, at = [], lo
    while depth and at + 2 < hi and rng.random() < 0.8:
        start = rng.randint(at, hi - 2)
        end = rng.randint(start + 1, hi)
        out.append((start, end))
        out += _nested_spans(rng, start + 1, end, depth - 1)
        at = end
    return out


def test_sweep_equals_brute_force(spark):
    rng = random.Random(7)
    spans, points = [], []
    for fid in range(20):
        spans += [(fid, a, b) for a, b in set(_nested_spans(rng, 0, 60, 4))]
        points += [(fid, rng.randint(0, 60)) for _ in range(15)]
    points = sorted(set(points))
    s = spark.createDataFrame(spans, "fid int, off int, end_off int")
    p = spark.createDataFrame(points, "fid int, off int")
    around = {(f, x): sorted((a, b) for g, a, b in spans if g == f and a <= x < b) for f, x in points}
    got = {(r.fid, r.off): r.span and (r.span.off, r.span.end_off) for r in sweep.innermost(p, s, ["off", "end_off"]).collect()}
    assert got == {k: (max(v, key=lambda t: (t[0], -t[1])) if v else None) for k, v in around.items()}
    depth = {(r.fid, r.off): r.nesting for r in sweep.nesting_at(p, s).collect()}
    assert depth == {k: len(v) for k, v in around.items()}
    pairs = sorted((r.fid, r.off, r.span.off, r.span.end_off) for r in sweep.enclosing_all(p, s, ["off", "end_off"]).collect())
    assert pairs == sorted((f, x, a, b) for (f, x), v in around.items() for a, b in v)
    counts = {(r.fid, r.off, r.end_off): r.n for r in sweep.count_within(s, p, "n").collect()}
    assert counts == {(f, a, b): sum(g == f and a <= x < b for g, x in points) for f, a, b in spans}


def test_text_predicates(spark):
    df = spark.createDataFrame([("print(e)", "e"), ("return error", "e"), ("a.b(x)", "b"), ("été", "t")], "t string, w string")
    assert [r[0] for r in df.select(contains_word(F.col("t"), F.col("w"))).collect()] == [True, False, True, False]
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(body_uses_word(F.lit("catch (e) { log(e) }"), F.lit("e")))
    assert not one(body_uses_word(F.lit("except X as e:\n pass"), F.lit("e")))
    for text, want in [("return 0;", True), ("return new A();", True), ('return "x"', True), ("return -1", True), ("return x", False), ("return", False), ("return 1.5e3;", True)]:
        assert one(returns_hardcoded_default(F.lit(text))) is want, text
    assert abs(one(shannon_entropy(F.lit("aabb"))) - 1.0) < 1e-9


def facts_of(corpus, path, text):
    return Facts(corpus([(path, text)]))


def names_and_params(facts):
    params = {}
    for r in facts.params.orderBy("fn_off", "pos").collect():
        params.setdefault(r.fn_off, []).append(r.name)
    return [(r.kind, r.name, params.get(r.off, [])) for r in facts.functions.orderBy("off").collect()]


def test_parameters_behind_bounds_and_deep_type_lists(corpus):
    deep = "X<" * 12 + "i32, u8" + ">" * 12
    f = facts_of(corpus, "a.rs", f"fn map<F: Fn(i32) -> i32>(a: i32, b: {deep}, c: (u8, u8)) {{ }}\nfn gen<A: X<Y<Z<W<i32>>>>, B, C, D, E>() {{ }}\n")
    assert names_and_params(f) == [("function_item", "map", ["a", "b", "c"]), ("function_item", "gen", [])]
    assert sorted(r.n for r in f.types.where("kind = 'type_params'").collect()) == [1, 5]


def test_script_forms(corpus):
    f = facts_of(
        corpus,
        "a.ts",
        "function many({a, b}, [c], d = 1 < 2, e) { }\nclass A {\n  x = 1\n  go(a, b) { }\n  y = 'q'\n  end(c) { return /[{]/; }\n}\n"
        "const f = (a, b) => a + b;\nexport const q = async (x: number): Promise<void> => run(x)\n",
    )
    assert names_and_params(f) == [
        ("function_declaration", "many", ["", "", "d", "e"]), ("method_definition", "go", ["a", "b"]), ("method_definition", "end", ["c"]),
        ("arrow_function", "", ["a", "b"]), ("arrow_function", "", ["x"]),
    ]


def test_pattern_literals_do_not_hide_functions(corpus):
    f = facts_of(corpus, "a.ts", 'function g() { return /[{]/; }\nfunction h() {\n  call(\n                  /a"b{/,\n  );\n}\n')
    assert [r.name for r in f.functions.orderBy("off").collect()] == ["g", "h"]
    used = facts_of(corpus, "b.ts", "s.replace(/^https?:\\/\\//, X)\n")
    assert "X" in {r.name for r in used.identifiers.collect()}


def test_csharp_forms(corpus):
    f = facts_of(
        corpus,
        "c.cs",
        "class C {\n (int, string) M(int a) { }\n void IFoo.N(int b) { }\n Dictionary<string, (int, int)> P(int c) { }\n public C(int d) { }\n void Q() { if (a) { b(); } foreach (var x in y) { z(x); } }\n}\n",
    )
    assert [(n, p) for _, n, p in names_and_params(f)] == [("M", ["a"]), ("N", ["b"]), ("P", ["c"]), ("C", ["d"]), ("Q", [])]


def test_magic_numbers_outside_patterns_and_annotations(corpus):
    rust = (
        "fn f() { match a { Some(88) => 31, (55, 77) => 32, P { x: 66 } => 33, 44 | 45 => { g(34) } 46 if b > 47 => 35, 48 => 36, _ => 37 } }\n"
        "fn g() { let t = (38, 39); if x { 51 } else { 52 } }\n"
    )
    script = (
        "let z: 77 | 88 = 31, y: 66 = 32;\nfunction f(a: 55, b?: 56 = 33): 57 { return c ? d : 34; }\nconst g = (a: 58): 59 => 35;\n"
        "const o = { a: 36, b: 37 };\nf(c ? d : 38, { e: 39 });\nswitch (a) { case 51: b(); }\nlet w: { a: 67 } = h(52);\n"
    )
    found = LR.detect_r10(Facts(corpus([("a.rs", rust), ("a.ts", script)]))).collect()
    got = {fid: sorted(int(r.subject) for r in found if r.fid == fid) for fid in (0, 1)}
    assert got == {0: [31, 32, 33, 34, 35, 36, 37, 38, 39, 51, 52], 1: [31, 32, 33, 34, 35, 36, 37, 38, 39, 51, 52]}
