"""The scan with carried state: nothing is lost, and each piece is what its past says."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from coralint.functions.lexer import lexemes_of
from coralint.functions.modes import scan
from coralint.operators.bundle import Facts
from coralint.operators.detectors import function_rules as FR
from coralint.operators.detectors import literal_rules as LR

LANGUAGES = ["rust", "python", "typescript", "tsx", "csharp", "java"]


def pieces(text, language="typescript", kinds="tr"):
    return [p[1:] for p in scan(text, language) if p[0] in kinds]


@settings(max_examples=400, deadline=None)
@given(st.text("ab1/*`'\"${}()[];:=>\\\n f$@#!<é", max_size=60), st.sampled_from(["typescript", "tsx", "rust", "csharp", "python"]))
def test_nothing_is_lost(text, language):
    assert "".join(p[1:] for p in scan(text, language)) == text


@pytest.mark.parametrize("text, literals", [
    ("if (x) /[{]/.test(s)", ["/[{]/"]),
    ("while (a(b)) /}/.exec(s)", ["/}/"]),
    ("f(x) / 2 / y", []),
    ("a[0] / b / c", []),
    ("a / b / c", []),
    ("x++ / 2 / 3", []),
    ("const r =" + " " * 1000 + "/[}]/g", ["/[}]/g"]),
    ("return\t/a/", ["/a/"]),
    ("}\n/re/.test(x)", ["/re/"]),
    ("y = {a: 1} / 2 / 3", []),
    ("`${a} ` / 2 / 3", []),
    ("`${/}/.test(a)}`", ["/}/"]),
    ("typeof /a/ / 2", ["/a/"]),
    ("x = /[/]/", ["/[/]/"]),
])
def test_slash_by_the_previous_token(text, literals):
    assert pieces(text, kinds="r") == literals


def test_slashes_of_markup_divide_nothing():
    assert pieces("<A b={x} /><p>{y}</p>", "tsx", "r") == []


@pytest.mark.parametrize("language, text, calls", [
    ("typescript", "`a ${f(`in ${g({k: 1})} x`)} b${z}`", ["f", "g"]),
    ("csharp", '$"a {f(x)} {{no()}} {y:0.00}" + $@"c:\\{g("q")} ""z"""', ["f", "g"]),
    ("python", "f\"{f(a['b'])} {{no()}} {g(y):>20}\"", ["f", "g"]),
    ("rust", "/* f() /* g() */ h() */ real()", ["real"]),
])
def test_expressions_are_code_and_the_rest_is_not(language, text, calls):
    found = scan(text, language)
    assert [a[1:].strip() for a, b in zip(found, found[1:]) if a[0] == "k" and b == "o("] == calls
    assert sum(p[0] in "oi" for p in found) == sum(p[0] in "xj" for p in found)


def test_unclosed_things_end_with_the_text():
    for text, language in [("`a ${b", "typescript"), ("/* a /* b */", "rust"), ('$"a {b', "csharp"), ("f'{a", "python"), ("`", "tsx")]:
        assert "".join(p[1:] for p in scan(text, language)) == text


def test_scan_agrees_with_the_pattern_where_both_apply(corpus):
    texts = [("a.ts", "const a = 'x'; // b\nf(a, \"c\");\n"), ("a.rs", "fn f<'a>(x: &'a str) { /* a */ g('{', r#\"x\"#); }\n"),
             ("a.cs", "class A { string a = @\"c:\\\"; char b = '{'; }\n"), ("a.py", "x = rb'a' # a\ny = '''b\n'''\n")]
    files = corpus(texts)
    for r in files.select("language", "text", lexemes_of(F.col("text"), F.col("language")).alias("lexemes")).collect():
        assert [p[1:] for p in scan(r.text, r.language)] == r.lexemes


def test_arrows_of_one_statement(corpus):
    src = "const o = {a: (p,q) => p, b: (r) => r * 2};\nf((x) => x, async (y): Map<A, B> => y + 1);\nconst k = a => b => a + b;\n"
    src += "let t: (a: number) => void;\ninterface I { m: (a) => void }\nclass C { h: (e) => void = (e) => run(e); }\nfunction z(cb: (x) => void) {}\n"
    rows = Facts(corpus([("a.ts", src)])).functions.where("kind = 'arrow_function'").orderBy("off").collect()
    assert [r.body for r in rows] == [
        "(p,q) => p", "(r) => r * 2", "(x) => x", "(y): Map<A, B> => y + 1", "a => b => a + b", "b => a + b", "(e) => run(e)",
    ]


def test_annotations_of_members_are_no_numbers(corpus):
    src = "class A { x: 77 = 31; private readonly y?: 78; z = 32; static s: Array<79> = [33]; @D() w!: 80; m(a: 81): 82 { return 34; } }\n"
    src += "interface I { a: 83; b?: 84 | 85; f(x: 86): 87; }\ntype T = { q: 88 };\nconst o = { k: 35, l: c ? 36 : 37 };\n"
    found = LR.detect_r10(Facts(corpus([("a.ts", src)]))).collect()
    assert sorted(r.subject for r in found) == [str(n) for n in range(31, 38)]


BARE = [
    ("A.java", "class A { void f() { if (a) for (int i = 0; i < 1; i++) while (b) if (c) for(;;) run(); } }", 6),
    ("A.cs", "class A { void f() { if (a) foreach (var x in y) while (b) if (c) run(); } }", 4),
    ("a.ts", "function f() {\n if (a)\n  for (let i = 0; i < 1; i++)\n   while (b)\n    if (c) { run(); }\n}\n", 4),
    ("a.ts", "function f() {\n if (a) x();\n else if (b) y();\n else if (c) z();\n else w();\n}\n", 3),
    ("A.java", "class A { void f() { if (a) { while (b) if (c) x(); else if (d) y(); } else z(); } }", 6),
    ("a.ts", "function f() { do x(); while (b); for (const a of b) if (c) d(); if (q) r(); }", 1),
]


def test_bodies_without_braces_nest(corpus):
    found = {r.fid: r.measure for r in FR.deep_nesting(Facts(corpus([b[:2] for b in BARE])), limit=0).collect()}
    assert found == {i: depth for i, (_, _, depth) in enumerate(BARE)}
