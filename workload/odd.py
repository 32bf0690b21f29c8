"""A second corpus from ``part``: code whose lexing and nesting depend on what came before.

One file per row, as in ``workload.corpus``: ``k`` is the part key, ``j = k div 6``, the language comes from
``k % 6``. The expected facts are stated from ``k`` and ``j`` alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coralint.operators.bundle import Facts
from coralint.operators.detectors import function_rules as FR
from coralint.operators.detectors import literal_rules as LR
from coralint.operators.detectors import name_rules as NR
from workload.corpus import EXT, KNOBS_SQL, LANGS, corpus_partitions
from workload.shared import shared_facts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Lines per language; {k} is the key, [n|text] repeats the text n times over j.
_NESTED = "[j % 3|if (a) ][j % 4|for (;;) ]while (b) run();"
_SCRIPT = [
    "async function job{k}() { return 1; }",
    "async function run{k}() { const s = `a ${job{k}()} b ${await job{k}()} c ${fine(33)}`; }",
    "if (x) /[{\"'`]/.test(s);",
    "function after{k}() { return a / b / c; }",
    "const r = [1000| ]/[}]/g;",
    "const o = {a: (p, q) => p, b: (r) => r * 2};",
    "use((x) => x, y => y);",
    "class C{k} { x: 77 = 31; static y?: 78; m(a: 79): 80 { return 32; } }",
    "interface I{k} { a: 83; f(x: 84): 85; g: (h: 86) => 87; }",
    "function deep{k}() {",
    _NESTED,
    "}",
    "[j % 3|each(z => z.v);]",
]
TEXTS = {
    "rust": ["/* [j % 3|/* x */ fn hidden{k}(a: i64) {} ]*/", "fn real{k}() { match v { 7 => 8, _ => 9 } }"],
    "python": ["def text{k}():", '    return f"{go(7)} {x:>20} {{9}}"'],
    "ts": _SCRIPT,
    "csharp": ["class F{k} {", "void deep{k}() {", _NESTED, "}", 'void text{k}() { var s = $"v {go(7)} {{9}} {n:0.00}"; }', "}"],
    "java": ["class F{k} {", "void deep{k}() {", _NESTED, "}", "}"],
}


def _line(template: str) -> str:
    """SQL of one line, its line end included."""
    out, rest = [], template
    while rest:
        head, mark, rest = rest.partition("[")
        count, bar, body = rest.partition("|")
        if mark and bar and count.replace("j % ", "").isdigit():
            text, _, rest = body.partition("]")
            out += [_plain(head), f"repeat({_plain(text)}, cast({count} as int))"]
        else:
            out.append(_plain(head + mark))
    return f"concat({', '.join(out)}, '\\n')"


def _plain(text: str) -> str:
    # The SQL reader would take "${" for a variable.
    quoted = text.replace("'", "\\'").replace("${", "$', '{")
    return "concat(" + ", cast(k as string), ".join(f"'{part}'" for part in quoted.split("{k}")) + ")"


def odd_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = corpus_partitions(spark, sf_dir)
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey").repartition(n, "p_partkey")
    base = part.select(
        F.col("p_partkey").cast("bigint").alias("k"),
        F.expr("cast(floor(p_partkey / 6) as bigint)").alias("j"),
        F.get(F.array(*[F.lit(g) for g in LANGS]), (F.col("p_partkey") % 6).cast("int")).alias("language"),
        F.col("p_partkey").alias("fid"),
    )
    group = F.when(F.col("language").isin("typescript", "tsx"), "ts").otherwise(F.col("language"))
    text = F.lit(None).cast("string")
    for name, lines in TEXTS.items():
        text = F.when(group == name, F.expr(f"concat({', '.join(map(_line, lines))})")).otherwise(text)
    ending = F.create_map(*[F.lit(x) for pair in EXT.items() for x in pair])
    path = F.concat(F.lit("src/odd"), F.col("k").cast("string"), F.lit("."), ending[F.col("language")])
    return base.select("fid", F.lit("odd").alias("repo"), F.lit("s1").alias("snapshot"), path.alias("path"), "language", text.alias("text"))


def odd_facts(spark: SparkSession, sf_dir: str) -> Facts:
    return shared_facts(spark, sf_dir, "odd", lambda: odd_files(spark, sf_dir), corpus_partitions(spark, sf_dir))


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _line_of(row: str = "row"):
    return (F.col(row) + 1).alias("line")


@query
def facts_pattern_literals(spark, sf):
    """Every pattern literal of the scripts; the slashes that divide are none."""
    lex = odd_facts(spark, sf).lexemes
    return lex.where(F.col("kind") == "regex").select("fid", _line_of(), "col", F.col("text").alias("literal"))


@query
def facts_comments_nested(spark, sf):
    """Every comment, with its bytes; block comments nest in Rust."""
    lex = odd_facts(spark, sf).lexemes
    return lex.where(F.col("kind") == "comment").select("fid", _line_of(), "col", F.octet_length("text").alias("bytes"))


@query
def facts_functions_all_kinds(spark, sf):
    """Every function of every kind, arrows included, with its number of listed parameters' characters."""
    fns = odd_facts(spark, sf).functions
    return fns.select("fid", _line_of(), "kind", "name", "n_lines", F.coalesce("params_text", F.lit("")).alias("listed"))


@query
def facts_calls_in_template(spark, sf):
    """Every call of every file, those inside template and interpolated strings included."""
    return odd_facts(spark, sf).calls.select("fid", _line_of(), "name", "is_method")


@query
def facts_brackets_of_scan(spark, sf):
    """Brackets per file, with those of expressions inside strings; all are closed."""
    lex = odd_facts(spark, sf).lexemes
    return lex.groupBy("fid").agg(
        F.count_if(F.col("kind") == "open").alias("opens"),
        F.count_if(F.col("kind") == "close").alias("closes"),
        F.count_if((F.col("kind") == "open") & (F.col("text") == "${")).alias("expressions"),
    )


@query
def r02_braceless(spark, sf):
    """Nesting above four, through controls whose body has no braces."""
    hits = FR.deep_nesting(odd_facts(spark, sf))
    return hits.select("fid", _line_of(), "subject", "measure")


@query
def r10_contexts(spark, sf):
    """Magic numbers outside annotations, patterns, formats and plain text, and inside expressions of strings."""
    return LR.detect_r10(odd_facts(spark, sf)).select("fid", _line_of(), "subject")


@query
def r18_in_template(spark, sf):
    """Calls without await inside template strings."""
    return NR.detect_r18(odd_facts(spark, sf)).select("fid", _line_of(), "subject")


# ------------------------------------------------------------------ expected results

_TS, _JVM = "language IN ('typescript', 'tsx')", "language IN ('csharp', 'java')"


def _f(sql: str) -> str:
    return f"WITH f AS (SELECT *, k AS fid FROM ({KNOBS_SQL})) {sql}"


def _rows(*rows: str) -> str:
    return " UNION ALL ".join(rows)


def _fn(line: str, kind: str, name: str, listed: str, where: str, lines: str = "1") -> str:
    return f"SELECT fid, {line} AS line, '{kind}' AS kind, {name} AS name, {lines} AS n_lines, '{listed}' AS listed FROM f WHERE {where}"


def _call(line: str, name: str, where: str, method: bool = False) -> str:
    return f"SELECT fid, {line} AS line, {name} AS name, {str(method).lower()} AS is_method FROM f WHERE {where}"


_DEPTH = "j % 3 + j % 4 + 1"
ORACLE = {
    "facts_pattern_literals": _f(
        _rows(
            f"SELECT fid, 3 AS line, 7 AS col, concat('/[{{\"', chr(39), '`]/') AS literal FROM f WHERE {_TS}",
            f"SELECT fid, 5, 1010, '/[}}]/g' FROM f WHERE {_TS}",
        )
    ),
    "facts_comments_nested": _f(
        "SELECT fid, 1 AS line, 0 AS col, CAST(5 + (j % 3) * (29 + length(CAST(k AS VARCHAR))) AS INTEGER) AS bytes FROM f WHERE language = 'rust'"
    ),
    "facts_functions_all_kinds": _f(
        _rows(
            _fn("2", "function_item", "concat('real', k)", "", "language = 'rust'"),
            _fn("1", "function_definition", "concat('text', k)", "", "language = 'python'", "2"),
            _fn("2", "method_declaration", "concat('deep', k)", "", _JVM, "3"),
            _fn("5", "method_declaration", "concat('text', k)", "", "language = 'csharp'"),
            _fn("1", "function_declaration", "concat('job', k)", "", _TS),
            _fn("2", "function_declaration", "concat('run', k)", "", _TS),
            _fn("4", "function_declaration", "concat('after', k)", "", _TS),
            _fn("6", "arrow_function", "''", "p, q", _TS),
            _fn("6", "arrow_function", "''", "r", _TS),
            _fn("7", "arrow_function", "''", "x", _TS),
            _fn("7", "arrow_function", "''", "", _TS),
            _fn("8", "method_definition", "'m'", "a: 79", _TS),
            _fn("10", "function_declaration", "concat('deep', k)", "", _TS, "3"),
            _fn("13", "arrow_function", "''", "", f"{_TS} AND j % 3 > 0"),
            _fn("13", "arrow_function", "''", "", f"{_TS} AND j % 3 > 1"),
        )
    ),
    "facts_calls_in_template": _f(
        _rows(
            _call("2", "'go'", "language = 'python'"),
            _call("3", "'run'", _JVM),
            _call("5", "'go'", "language = 'csharp'"),
            _call("2", "concat('job', k)", _TS),
            _call("2", "concat('job', k)", _TS),
            _call("2", "'fine'", _TS),
            _call("3", "'test'", _TS, True),
            _call("7", "'use'", _TS),
            _call("11", "'run'", _TS),
            _call("13", "'each'", f"{_TS} AND j % 3 > 0"),
            _call("13", "'each'", f"{_TS} AND j % 3 > 1"),
        )
    ),
    "facts_brackets_of_scan": _f(
        "SELECT fid, n AS opens, n AS closes, e AS expressions FROM (SELECT fid, CAST(CASE language WHEN 'rust' THEN 3 WHEN 'python' THEN 4 "
        f"WHEN 'java' THEN 4 + {_DEPTH} WHEN 'csharp' THEN 9 + {_DEPTH} ELSE 28 + {_DEPTH} + j % 3 END AS BIGINT) AS n, "
        "CAST(CASE language WHEN 'python' THEN 2 WHEN 'csharp' THEN 2 WHEN 'rust' THEN 0 WHEN 'java' THEN 0 ELSE 3 END AS BIGINT) AS e FROM f)"
    ),
    "r02_braceless": _f(
        f"SELECT fid, CASE WHEN {_TS} THEN 10 ELSE 2 END AS line, concat('deep', k) AS subject, n AS measure FROM "
        f"(SELECT *, CAST({_DEPTH} + CASE WHEN {_TS} THEN 0 ELSE 1 END AS INTEGER) AS n FROM f WHERE language NOT IN ('rust', 'python')) t WHERE n > 4"
    ),
    "r10_contexts": _f(
        _rows(
            "SELECT fid, 2 AS line, unnest(['8', '9']) AS subject FROM f WHERE language = 'rust'",
            "SELECT fid, 2, '7' FROM f WHERE language = 'python'",
            "SELECT fid, 5, '7' FROM f WHERE language = 'csharp'",
            f"SELECT fid, 2, '33' FROM f WHERE {_TS}",
            f"SELECT fid, 8, unnest(['31', '32']) FROM f WHERE {_TS}",
        )
    ),
    "r18_in_template": _f(f"SELECT fid, 2 AS line, concat('job', k) AS subject FROM f WHERE {_TS}"),
}
