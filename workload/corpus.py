"""A source corpus derived from ``part``: one file per row, text from the row's key.

``k`` is the part key and ``j = k div 6``. The language comes from ``k % 6`` and
every other knob from ``j``. A file is a list of sections; each section has the
same number of lines in all languages, given by an SQL expression over ``j`` that
both Spark and another SQL engine can evaluate. Expected findings can therefore
be stated from the knobs alone, without reading any text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coralint.session import partitions_for

LANGS = ["rust", "python", "typescript", "tsx", "csharp", "java"]
EXT = {"rust": "rs", "python": "py", "typescript": "ts", "tsx": "tsx", "csharp": "cs", "java": "java"}
GROUPS = ["rust", "python", "ts", "csharp", "java"]


@dataclass(frozen=True)
class Rep:
    """A line repeated ``count`` times; ``{i}`` is the repetition."""

    count: str
    line: str


@dataclass(frozen=True)
class Pick:
    """One line out of several, by an index expression."""

    index: str
    lines: tuple[str, ...]


def _alt(cond: str, yes: str, no: str) -> Pick:
    return Pick(f"case when {cond} then 0 else 1 end", (yes, no))


def _blank(*items):
    return [Rep(i.count, "") if isinstance(i, Rep) else "" for i in items]


def _same(lines):
    return {g: lines for g in GROUPS}


def _catch_section() -> dict:
    kind = "j % 6"
    jvm_types = {"csharp": "OperationCanceledException", "java": "OperationCanceledException e"}

    def jvm(lang):
        name = lambda p: f"    int {p}all{{k}}() {{"
        heads = ["Exception e", "Exception e", "IOException e", jvm_types[lang], "Exception e"]
        return [
            Pick(kind, (*[name("f")] * 5, name("TryF"))),
            Pick(kind, ("        // none", *["        try {"] * 5)),
            Pick(kind, ("        // none", *["            run();"] * 5)),
            Pick(kind, ("        // none", *[f"        }} catch ({h}) {{" for h in heads])),
            Pick(kind, ("        // none", "            // quiet", "            Logger.Error(e);", *["            // quiet"] * 3)),
            Pick(kind, ("        // none", *["            return 0;"] * 5)),
            Pick(kind, ("        // none", *["        }"] * 5)),
            "    }",
        ]

    ts_heads = ["e", "e", "problem", "OperationCanceledException", "e"]
    return {
        "rust": [
            "fn fall{k}(o: Option<i64>) -> i64 {",
            Pick(kind, ("    0", "    o.unwrap_or(0)", "    o.unwrap_or_default()", "    o.unwrap_or_else(zero)", "    0", "    0")),
            *["    // none"] * 5,
            "}",
        ],
        "python": [
            "def fall{k}():",
            Pick(kind, ("    a = 0", *["    try:"] * 5)),
            Pick(kind, ("    b = 0", *["        run()"] * 5)),
            Pick(kind, ("    c = 0", "    except Exception:", "    except Exception as e:", "    except ValueError:", "    except:", "    except Exception as e:")),
            Pick(kind, ("    d = 0", "        pass", "        log(e)", *["        pass"] * 3)),
            Pick(kind, ("    return a", *["        return None"] * 3, "        pass", "        return 0")),
            *["# end"] * 2,
        ],
        "ts": [
            Pick(kind, (*["function fall{k}() {"] * 5, "function TryFall{k}() {")),
            Pick(kind, ("  // none", *["  try {"] * 5)),
            Pick(kind, ("  // none", *["    run();"] * 5)),
            Pick(kind, ("  // none", *[f"  }} catch ({h}) {{" for h in ts_heads])),
            Pick(kind, ("  // none", "    // quiet", "    logger(e);", *["    // quiet"] * 3)),
            Pick(kind, ("  // none", *["    return 0;"] * 5)),
            Pick(kind, ("  // none", *["  }"] * 5)),
            "}",
        ],
        "csharp": jvm("csharp"),
        "java": jvm("java"),
    }


def _url_section() -> dict:
    env = {"rust": "std::env", "python": "os.getenv", "ts": "process.env", "csharp": "Configuration", "java": "System.getenv"}
    head = {
        "rust": "static U: &str = ",
        "python": "u = ",
        "ts": "const u = ",
        "csharp": "    static string u = ",
        "java": "    static String u = ",
    }
    out = {}
    for g in GROUPS:
        mark, end = ("#", "") if g == "python" else ("//", ";")
        values = ['"https://host{k}.example.org/x"', '"http://localhost:8080/x"', '"/opt/data/f{k}"', '"short"']
        lines = [f"{head[g]}{v}{end}" for v in values]
        lines.append(f'{head[g]}"https://h.example.org/x"{end} {mark} {env[g]}')
        out[g] = [Pick("j % 7", (*lines, f"{mark} nothing here", f"{mark} nothing here"))]
    return out


def _secret_section() -> dict:
    names = {
        "rust": ("static S: &str = ", "static API_KEY: &str = ", "static COMMIT_ID: &str = "),
        "python": ("s = ", "api_key = ", "commit_id = "),
        "ts": ("const s = ", "const apiKey = ", "const commitId = "),
        "csharp": ("    static string s = ", "    static string apiKey = ", "    static string commitId = "),
        "java": ("    static String s = ", "    static String apiKey = ", "    static String commitId = "),
    }
    out = {}
    for g in GROUPS:
        mark, end = ("#", "") if g == "python" else ("//", ";")
        a, b, c = names[g]
        lines = (f'{a}"ghp_{{h36}}"{end}', f'{b}"{{hex}}"{end}', f'{c}"{{hex}}"{end}')
        out[g] = [Pick("j % 7", (*lines, *[f"{mark} no key"] * 4))]
    return out


def _number_section() -> dict:
    fixed = ["0", "10", "1000", "4.5", "0x1F"]
    forms = {
        "rust": ("const N{i}: i64 = {v};", "const A{n}: f64 = {x};"),
        "python": ("n{i} = {v}", "a{n} = {x}"),
        "ts": ("const n{i} = {v};", "const a{n} = {x};"),
        "csharp": ("    static long n{i} = {v};", "    static double a{n} = {x};"),
        "java": ("    static long n{i} = {v};", "    static double a{n} = {x};"),
    }
    return {
        g: [Rep("j % 3", rep), *[one.replace("{n}", str(n)).replace("{x}", x) for n, x in enumerate(fixed)]]
        for g, (rep, one) in forms.items()
    }


def _test_section() -> dict:
    private = "j % 3 = 1"
    return {
        "rust": ["#[test]", "fn {tn}() {", _alt(private, "    let p = self._inner;", "    let p = 1;"), Rep("j % 3", "    assert!(ok);"), "}"],
        "python": ["# test", "def {tn}():", _alt(private, "    p = self._inner", "    p = 1"), Rep("j % 3", "    assert p"), "# end"],
        "ts": [
            _alt(private, "function {tn}() { const p = this._inner; }", "function {tn}() { const p = 1; }"),
            'test("case", () => {',
            "  const x = 1;",
            Rep("j % 3", "  expect(x);"),
            "});",
        ],
        "csharp": ["    [Test]", "    void {tn}() {", _alt(private, "        int p = this._inner;", "        int p = 1;"), Rep("j % 3", "        Assert.That(p);"), "    }"],
        "java": ["    @Test", "    void {tn}() {", _alt(private, "        int p = this._inner;", "        int p = 1;"), Rep("j % 3", "        assertTrue(p);"), "    }"],
    }


def _pick_section() -> dict:
    guarded = "j % 2 = 0"
    return {
        "rust": [
            "/// picks",
            "pub fn pick{k}(items: &[i64], at: usize) -> i64 {",
            _alt(guarded, "    if items.is_empty() { return 0; }", "    // open"),
            "    items[at]",
            "}",
        ],
        "python": ["# picks", "def pick{k}(items, at):", _alt(guarded, "    if not items: return 0", "    # open"), "    return items[at]", "# end"],
        "ts": ["/// picks", "function handler{k}(items: number[], at: number) {", _alt(guarded, "  if (!items) return 0;", "  // open"), "  return items[at];", "}"],
        "csharp": ["    /// picks", "    int handler{k}(int[] items, int at) {", _alt(guarded, "        if (!ok) return 0;", "        // open"), "        return items[at];", "    }"],
        "java": ["    /// picks", "    int handler{k}(int[] items, int at) {", _alt(guarded, "        if (!ok) return 0;", "        // open"), "        return items[at];", "    }"],
    }


def _function(head: dict, body: dict, reps: list | None = None) -> dict:
    """Header, body items and end line per language."""
    end = {"rust": "}", "python": "# end", "ts": "}", "csharp": "    }", "java": "    }"}
    return {g: [head[g], *body[g], end[g]] for g in GROUPS}


_FN = {
    "rust": "fn {n}{k}({p}) {",
    "python": "def {n}{k}({p}):",
    "ts": "function {n}{k}({p}) {",
    "csharp": "    int {n}{k}({p}) {",
    "java": "    int {n}{k}({p}) {",
}


def _head(name: str, params: str = "") -> dict:
    return {g: f.replace("{n}", name).replace("{p}", params and "{ps_" + g + "}") for g, f in _FN.items()}


_WIDE_FILL = {"rust": "    let a = 1;", "python": "    a = 1", "ts": "  a = 1;", "csharp": "        a = 1;", "java": "        a = 1;"}
_IF = {"rust": "if c {", "python": "{pad}if c:", "ts": "if (c) {", "csharp": "if (c) {", "java": "if (c) {"}
_STMT = {"rust": "let d = 1;", "python": "{padn}d = 1", "ts": "d = 1;", "csharp": "d = 1;", "java": "d = 1;"}
_SHUT = {"rust": "}", "python": "# shut", "ts": "}", "csharp": "}", "java": "}"}
_RESPONSE = {"rust": "    let response = 1;", "python": "    response = 1", "ts": "  const response = 1;", "csharp": "        int response = 1;", "java": "        int response = 1;"}
_HEADER = {"rust": "    let h{i} = header;", "python": "    h{i} = header", "ts": "  const h{i} = header;", "csharp": "        int h{i} = header;", "java": "        int h{i} = header;"}

_TRAIT_ITEMS = ["trait Tr{k} {", "}", Rep("j % 4", "impl Tr{k} for T{i} {}"), _alt("j >= 8", "impl Tr{km} for X{k} {}", ""), "fn gen{k}<{gs}>() {}"]
_JOB = {
    "python": ["async def job{k}():", "    return 1", "async def run{k}():", _alt("j % 2 = 0", "    await job{k}()", "    job{k}()"), "# end"],
    "ts": ["async function job{k}() {", "}", "async function run{k}() {", _alt("j % 2 = 0", "  await job{k}();", "  job{k}();"), "}"],
}
_LOOP = {
    "python": [
        Pick("j % 4", ("for x in items:", "for x in Model.objects.all():", 'for x in Model.objects.select_related("a").all():', "for x in items:")),
        "    print(x.name)",
        "# end",
    ],
    "ts": [
        Pick(
            "j % 4",
            (
                "items.map(x => x.name);",
                "prisma.user.findMany().map(x => x.name);",
                'prisma.user.include("a").findMany().map(x => x.name);',
                "for (const el of els) {",
            ),
        ),
        _alt("j % 4 = 3", '  el.addEventListener("c", h);', ""),
        _alt("j % 4 = 3", "}", ""),
    ],
}
_LEAK = [
    "def leak{k}(path):",
    Pick("j % 3", ("    f = open(path)", "    with open(path) as f:", "    f = open(path)")),
    Pick("j % 3", ("    pass", "        pass", "    f.close()")),
]
_SURE = {
    "rust": ["fn sure{k}() {", _alt("j % 5 = 0", "    let d = Some(1).unwrap_or(0);", "    let d = 1;"), "}"],
    "ts": ["function sure{k}() {", _alt("j % 5 = 0", '  const d = "x" ?? y;', "  const d = 1;"), "}"],
}


def _only(parts: dict) -> dict:
    """Sections only some languages have; the others get empty lines."""
    shape = next(iter(parts.values()))
    return {g: parts.get(g, _blank(*shape)) for g in GROUPS}


def _comment(lines: dict | str, py: str) -> dict:
    return {g: py if g == "python" else lines for g in GROUPS}


SECTIONS: dict[str, dict] = {
    "imports": {
        "rust": [Rep("j % 4", "use crate::lib{i}::Imp{k}x{i};")],
        "python": [Rep("j % 4", "from lib{i} import Imp{k}x{i}")],
        "ts": [Rep("j % 4", 'import { Imp{k}x{i} } from "./lib{i}";')],
        "csharp": [Rep("j % 4", "using Lib{i};")],
        "java": [Rep("j % 4", "import lib{i}.Imp{k}x{i};")],
    },
    "open": {**_same(["", ""]), "csharp": ["/// wrapper", "class F{k} {"], "java": ["/** wrapper */", "class F{k} {"]},
    "uses": {
        "rust": [Rep("least(j % 4, j % 3)", "type U{i} = Imp{k}x{i};")],
        "python": [Rep("least(j % 4, j % 3)", "u{i} = Imp{k}x{i}")],
        "ts": [Rep("least(j % 4, j % 3)", "const u{i} = Imp{k}x{i};")],
        "csharp": [Rep("least(j % 4, j % 3)", "    static int w{i} = 0;")],
        "java": [Rep("least(j % 4, j % 3)", "    static Object u{i} = Imp{k}x{i}.make();")],
    },
    "dead": {
        g: ["", Rep("j % 7", "# v = f(1)" if g == "python" else "// v = f(1);"), _alt("j % 2 = 1", "# plain words" if g == "python" else "// plain words", "")]
        for g in GROUPS
    },
    "notes": {g: [Rep("j % 3", "# {m}: later" if g == "python" else "// {m}: later")] for g in GROUPS},
    "numbers": _number_section(),
    "url": _url_section(),
    "secret": _secret_section(),
    "wide": _function(_head("wide"), {g: [Rep("43 + j % 12 - 1", _WIDE_FILL[g]), _WIDE_FILL[g]] for g in GROUPS}),
    "parm": _function(_head("parm", "p"), {g: [_WIDE_FILL[g]] for g in GROUPS}),
    "deep": _function(_head("deep"), {g: [Rep("j % 6", _IF[g]), _STMT[g], Rep("j % 6", _SHUT[g])] for g in GROUPS}),
    "fall": _catch_section(),
    "doc": {
        "rust": [_alt("j % 3 <> 0", "/// documented", ""), "pub struct Doc{k} {", "}"],
        "python": ["# plain", "class Doc{k}:", "    pass"],
        "ts": [_alt("j % 3 <> 0", "/** documented */", ""), "function exportDoc{k}() {", "}"],
        "csharp": [_alt("j % 3 <> 0", "    /// documented", ""), "    public int doc{k}() {", "    }"],
        "java": [_alt("j % 3 <> 0", "    /** documented */", ""), "    public int doc{k}() {", "    }"],
    },
    "test": _test_section(),
    "flow": _function(_head("end_to_end_flow"), {g: [_RESPONSE[g], Rep("j % 4", _HEADER[g])] for g in GROUPS}),
    "trait": _only({"rust": _TRAIT_ITEMS}),
    "job": _only(_JOB),
    "loop": _only(_LOOP),
    "leak": _only({"python": _LEAK}),
    "pick": _pick_section(),
    "sure": _only(_SURE),
    "hash": _only(
        {"csharp": ["    int GetHashCode() {", "        return 31;", "    }"], "java": ["    int hashCode() {", "        return 31;", "    }"]}
    ),
    "close": {**_same([""]), "csharp": ["}"], "java": ["}"]},
}
EXTRA_LINE = {g: "# todo: second snapshot" if g == "python" else "// todo: second snapshot" for g in GROUPS}


def length_sql(section: str) -> str:
    """Number of lines of a section, as SQL over ``j``; the same in every language."""
    lengths = set()
    for items in SECTIONS[section].values():
        reps = sorted(f"({i.count})" for i in items if isinstance(i, Rep))
        lengths.add(" + ".join([*reps, str(sum(not isinstance(i, Rep) for i in items))]))
    assert len(lengths) == 1, (section, lengths)
    return lengths.pop()


def line_sql(section: str, offset: int | str = 0) -> str:
    """1-based line of a section's line, as SQL over ``j``."""
    names = list(SECTIONS)
    before = [f"({length_sql(n)})" for n in names[: names.index(section)]]
    return " + ".join([*before, f"({offset})", "1"])


def total_lines_sql() -> str:
    return " + ".join(f"({length_sql(n)})" for n in SECTIONS)


KNOBS_SQL = (
    "SELECT CAST(p_partkey AS BIGINT) AS k, CAST(floor(p_partkey / 6) AS BIGINT) AS j, "
    "CASE p_partkey % 6 " + " ".join(f"WHEN {i} THEN '{g}'" for i, g in enumerate(LANGS)) + " END AS language FROM part"
)


def path_sql(concat: str = "concat") -> str:
    ext = "CASE language " + " ".join(f"WHEN '{g}' THEN '{e}'" for g, e in EXT.items()) + " END"
    return (
        f"CASE WHEN j % 10 = 0 THEN {concat}('tests/f', k, '.', {ext}) "
        f"WHEN j % 10 = 1 THEN {concat}('node_modules/f', k, '.', {ext}) "
        f"WHEN j % 10 = 2 THEN {concat}('src/combine', k, '.', {ext}) "
        f"ELSE {concat}('src/m', j % 5, '/f', k, '.', {ext}) END"
    )


def _params(form: str) -> str:
    before, after = form.split("@")
    return f"array_join(transform(sequence(0L, 2 + j % 5), i -> concat('{before}', i, '{after}')), ', ')"


_PLACEHOLDERS = {
    "k": "k",
    "km": "k - 48",
    "v": "k + 2000",
    "hex": "sha1(cast(k as string))",
    "h36": "left(sha1(cast(k as string)), 36)",
    "tn": "concat('test_calc', k, if(j % 2 = 0, '', '_when_ok'))",
    "gs": "array_join(transform(sequence(0L, 1 + j % 4), i -> concat('G', i)), ', ')",
    "padn": "repeat('    ', cast(1 + j % 6 as int))",
    "ps_rust": _params("p@: i64"),
    "ps_python": _params("p@"),
    "ps_ts": _params("p@: number"),
    "ps_csharp": _params("int p@"),
    "ps_java": _params("int p@"),
    "i": "i",
    "m": "get(array('todo', 'FIXME', 'xxx'), i)",
    "pad": "repeat('    ', i + 1)",
}


def _line(template: str) -> str:
    """SQL of one line of text, its line end included."""
    pieces = []
    for n, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if n % 2:
            pieces.append(f"cast({_PLACEHOLDERS[piece]} as string)")
        elif piece:
            pieces.append(f"'{piece}'")
    return "concat(" + ", ".join([*pieces, r"'\n'"]) + ")"


def _item(item) -> str:
    if isinstance(item, Rep):
        count = f"cast({item.count} as int)"
        if not re.search(r"\{(?:i|m|pad)\}", item.line):
            return f"repeat({_line(item.line)}, {count})"
        steps = f"if({count} > 0, sequence(0, {count} - 1), cast(array() as array<int>))"
        return f"array_join(transform({steps}, i -> {_line(item.line)}), '')"
    if isinstance(item, Pick):
        branches = " ".join(f"when {n} then {_line(t)}" for n, t in enumerate(item.lines))
        return f"case cast({item.index} as int) {branches} end"
    return _line(item)


def _text(group: str) -> Column:
    return F.expr("concat(" + ", ".join(_item(i) for items in SECTIONS.values() for i in items[group]) + ")")


def corpus_partitions(spark: SparkSession, sf_dir: str) -> int:
    """Partitions of the corpus: about 3,000 files, some five megabytes of text, in each, however many there are."""
    return partitions_for(spark.read.parquet(f"{sf_dir}/part.parquet"), 20_000, capped=False)


def code_files(spark: SparkSession, sf_dir: str, snapshot: int = 1, excluded: bool = False) -> DataFrame:
    """The corpus as ``files``. Already hash-partitioned by ``fid``, before any text exists.

    ``excluded=False`` leaves out the files under an excluded directory.
    """
    from coralint.sources.corpus import exclude_paths

    # The rows are tiny before the text exists; a fixed number keeps them from being coalesced into one task.
    n = corpus_partitions(spark, sf_dir)
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey").repartition(n, "p_partkey")
    base = part.select(
        F.col("p_partkey").cast("bigint").alias("k"),
        F.expr("cast(floor(p_partkey / 6) as bigint)").alias("j"),
        F.get(F.array(*[F.lit(g) for g in LANGS]), (F.col("p_partkey") % 6).cast("int")).alias("language"),
        F.col("p_partkey").alias("fid"),
    )
    base = base.withColumn("path", F.expr(path_sql()))
    if not excluded:
        base = exclude_paths(base)
    text = (
        F.when(F.col("language") == "rust", _text("rust"))
        .when(F.col("language") == "python", _text("python"))
        .when(F.col("language") == "csharp", _text("csharp"))
        .when(F.col("language") == "java", _text("java"))
        .otherwise(_text("ts"))
    )
    if snapshot == 2:
        added = F.when(F.col("language") == "python", EXTRA_LINE["python"]).otherwise(EXTRA_LINE["ts"])
        text = F.concat(text, F.when(F.col("j") % 3 == 0, F.concat(added, F.lit("\n"))).otherwise(""))
    return base.select(
        "fid",
        F.concat(F.lit("repo"), (F.col("j") % 8).cast("string")).alias("repo"),
        F.lit(f"s{snapshot}").alias("snapshot"),
        "path",
        F.substring_index("path", "/", -1).alias("name"),
        "language",
        text.alias("text"),
    )
