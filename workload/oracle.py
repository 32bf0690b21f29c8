"""Expected results as SQL, stated from the corpus knobs or from the tables themselves.

Nothing here reads generated source text or shares logic with the detectors.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from coralint.model import RULES
from workload.corpus import KNOBS_SQL, SECTIONS, Pick, Rep, line_sql, path_sql, total_lines_sql
from workload.odd import ORACLE as ODD

# Path layouts over a key ``k``; the expressions are valid in both SQL dialects.
LAYOUTS = {
    "extensions": "concat('src/f', k, '.', CASE k % 9 WHEN 0 THEN 'rs' WHEN 1 THEN 'py' WHEN 2 THEN 'ts' WHEN 3 THEN 'tsx' "
    "WHEN 4 THEN 'cs' WHEN 5 THEN 'java' WHEN 6 THEN 'txt' WHEN 7 THEN 'RS' ELSE 'tar.py' END)",
    "directories": "concat(CASE k % 12 WHEN 0 THEN 'src' WHEN 1 THEN 'target' WHEN 2 THEN 'bin_utils' WHEN 3 THEN 'a/node_modules/b' "
    "WHEN 4 THEN 'legacy' WHEN 5 THEN 'router' WHEN 6 THEN 'old_legacy' WHEN 7 THEN '.git' WHEN 8 THEN 'x/.cache' WHEN 9 THEN 'out' "
    "WHEN 10 THEN 'outer' ELSE 'lib/coverage' END, '/f', k, CASE k % 5 WHEN 0 THEN '.gen.rs' ELSE '.rs' END)",
    "nested": "concat('n', k % 30, '/m/', CASE WHEN k % 4 = 0 THEN concat('skip', k % 5) ELSE 'plain' END, '/f', k, "
    "CASE WHEN k % 6 = 0 THEN '.tmp.rs' ELSE '.rs' END)",
    "hidden": "concat('d', k % 7, '/', CASE k % 6 WHEN 0 THEN '__tests__/' WHEN 1 THEN 'node_modules/' WHEN 2 THEN '_in/.x/' "
    "WHEN 3 THEN concat('sub', k % 5, '/') ELSE '' END, CASE k % 8 WHEN 0 THEN concat('__init', k, '__.py') WHEN 1 THEN concat('.h', k, '.rs') "
    "WHEN 2 THEN concat('a b', k, '.ts') WHEN 3 THEN concat('f', k, '.tmp.py') WHEN 4 THEN concat('f', k, '.md') ELSE concat('f', k, '.java') END)",
    "tests": "concat(CASE k % 5 WHEN 0 THEN 'src' WHEN 1 THEN 'Tests' WHEN 2 THEN 'test' WHEN 3 THEN 'a/__tests__/b' ELSE 'testing' END, '/', "
    "CASE k % 9 WHEN 0 THEN concat('test_f', k, '.rs') WHEN 1 THEN concat('test.f', k, '.rs') WHEN 2 THEN concat('f', k, '_test.rs') "
    "WHEN 3 THEN concat('f', k, '.Test.ts') WHEN 4 THEN concat('f', k, '.spec.ts') WHEN 5 THEN concat('F', k, 'Tests.cs') "
    "WHEN 6 THEN concat('F', k, 'Test.java') WHEN 7 THEN concat('contest', k, '.cs') ELSE 'latest.cs' END)",
}

_PATHS = {n: f"p AS (SELECT p_partkey AS fid, k, {e} AS path FROM (SELECT *, p_partkey AS k FROM part))" for n, e in LAYOUTS.items()}
_LANG9 = "CASE k % 9 WHEN 0 THEN 'rust' WHEN 1 THEN 'python' WHEN 2 THEN 'typescript' WHEN 3 THEN 'tsx' WHEN 4 THEN 'csharp' WHEN 5 THEN 'java' WHEN 8 THEN 'python' END"
_FILES = f"f AS (SELECT k AS fid, k, j, language, path FROM (SELECT *, {path_sql()} AS path FROM ({KNOBS_SQL}) q) r WHERE j % 10 <> 1)"

RUST, PY, TS = "language = 'rust'", "language = 'python'", "language IN ('typescript', 'tsx')"
JVM = "language IN ('csharp', 'java')"
KIND = "(j % 6)"


def _f(body: str) -> str:
    return f"WITH {_FILES} {body}"


def _p(layout: str, body: str) -> str:
    return f"WITH {_PATHS[layout]} {body}"


def _l(section: str, offset: int | str = 0) -> str:
    return f"({line_sql(section, offset)}) AS line"


def _union(*parts: str) -> str:
    return _f(" UNION ALL ".join(parts))


# ---------------------------------------------------------------- lines of the generator's templates

_GROUP_COND = {"rust": RUST, "python": PY, "ts": TS, "csharp": "language = 'csharp'", "java": "language = 'java'"}
_WIDTHS = {
    "k": "CAST(k AS VARCHAR)", "i": "CAST(i AS VARCHAR)", "v": "CAST(2000 + k AS VARCHAR)",
    "tn": "concat('test_calc', k, CASE WHEN j % 2 = 0 THEN '' ELSE '_when_ok' END)",
    "pad": "repeat('    ', i + 1)", "padn": "repeat('    ', 1 + j % 6)",
}


def _templates() -> Iterator[tuple[str, str, str, str]]:
    """(group, line template, line number as SQL, rows as SQL) of every line that a file may have."""
    for section, groups in SECTIONS.items():
        for group, items in groups.items():
            before: list[str] = []
            for item in items:
                at = " + ".join(["0", *before])
                if isinstance(item, Rep):
                    source = f"f, unnest(range(CAST({item.count} AS BIGINT))) t(i) WHERE {_GROUP_COND[group]}"
                    yield group, item.line, f"{line_sql(section, f'{at} + i')}", source
                    before.append(f"({item.count})")
                    continue
                for n, text in enumerate(item.lines) if isinstance(item, Pick) else [(None, item)]:
                    cond = "" if n is None else f" AND (CASE WHEN true THEN {item.index} END) = {n}".replace("case when", "CASE WHEN")
                    yield group, text, line_sql(section, at), f"f WHERE {_GROUP_COND[group]}{cond}"
                before.append("1")


def _cut(group: str, text: str) -> tuple[str, int]:
    """A line with its strings blanked out, and where its comment begins, or its length."""
    plain = re.sub(r'"[^"]*"', lambda m: '"' + " " * (len(m[0]) - 2) + '"', text)
    at = re.search("#(?!\\[)" if group == "python" else r"//|/\*", plain)
    return plain, at.start() if at else len(text)


def _sql_text(template: str) -> str:
    pieces = [f"'{x}'" if n % 2 == 0 else _WIDTHS[x] for n, x in enumerate(re.split(r"\{(\w+)\}", template)) if n % 2 or x]
    return f"concat({', '.join(pieces)})" if pieces else "''"


def _each(find: Callable[[str, str], Iterator[str]]) -> str:
    """Rows of ``find(group, template)``: SQL lists of columns after ``fid, line``."""
    return _f(" UNION ALL ".join(
        f"SELECT fid, ({at}) AS line, {columns} FROM {source}" for group, text, at, source in _templates() for columns in find(group, text)
    ))


def _comments_in(group: str, text: str) -> Iterator[str]:
    _, at = _cut(group, text)
    if at < len(text):
        yield f"CAST(length({_sql_text(text[:at])}) AS INTEGER) AS col, {str(text[at:].startswith(('///', '/**'))).lower()} AS is_doc"


def _numbers_in(group: str, text: str) -> Iterator[str]:
    plain, end = _cut(group, text)
    for m in re.finditer(r"(?<![\w.}])(?:\d[\w.]*|\{v\})", plain[:end]):
        yield f"CAST(length({_sql_text(text[: m.start()])}) AS INTEGER) AS col, {_sql_text(m[0])} AS text"


_HEAD = re.compile(r"^\s*(?:(?:pub|public|async) )*(?:fn|def|function|int|void|class) [\w{}]+(?:<[^>]*>)?\(")
_NO_CALL = {"if", "for", "while", "catch", "except"}


def _calls_in(group: str, text: str) -> Iterator[str]:
    plain, end = _cut(group, text)
    head = _HEAD.match(plain)
    for m in re.finditer(r"(?:\w|\{\w+\})+(?=\()", plain[: end]):
        if m[0] in _NO_CALL or head and m.end() < head.end():
            continue
        at, depth = m.start(), 0  # back to where the chain begins
        while at and (depth or re.match(r'[\w.)"{}]', plain[at - 1])) and not (depth == 0 and plain[at - 2 : at] == "{ "):
            depth += (plain[at - 1] == ")") - (plain[at - 1] == "(")
            at -= 1
        method = str(m.start() > 0 and plain[m.start() - 1] == ".").lower()
        yield f"CAST(length({_sql_text(text[:at])}) AS INTEGER) AS col, {_sql_text(m[0])} AS name, {method} AS is_method"


def _brackets_in(group: str, text: str) -> Iterator[str]:
    plain, end = _cut(group, text)
    signs = [(c in "([{") - (c in ")]}") for c in re.sub(r"\{\w+\}", "", plain[:end]) if c in "([{)]}"]
    if signs:
        depths = [sum(signs[: n + 1]) for n in range(len(signs))]
        yield f"{signs.count(1)} AS opens, {signs.count(-1)} AS closes, {max(d for d, s in zip([*depths, 0], [*signs, 1]) if s == 1)} AS peak"


def _by_lang(rust, py, ts, jvm) -> str:
    return f"CASE WHEN {RUST} THEN {rust} WHEN {PY} THEN {py} WHEN {TS} THEN {ts} ELSE {jvm} END"


_RULE_LANGS = {
    "all": "R01 R02 R03 R04 R05 R06 R08 R09 R10 R14 R15 R16 R24".split(),
    "no_csharp": ["R07"],
    "script": ["R18", "R19", "R20"],
    "no_rust": ["R23"],
    "r28": ["R28"],
}
_GROUP_SQL = {
    "all": "true",
    "no_csharp": "language <> 'csharp'",
    "script": f"({PY} OR {TS})",
    "no_rust": "language <> 'rust'",
    "r28": f"({RUST} OR {TS})",
}
_SCOPE = " UNION ALL ".join(
    f"SELECT '{r}' AS rule_id, fid, path FROM f WHERE {_GROUP_SQL[g]}" for g, rs in _RULE_LANGS.items() for r in rs
)
_NAMES = {
    "R01": ("fallback-masks-error", "error"), "R02": ("structural-bloat", "warning"), "R03": ("missing-doc", "warning"),
    "R04": ("simple-unit-test", "warning"), "R05": ("shallow-integration-test", "warning"), "R06": ("over-engineering", "info"),
    "R07": ("dead-code", "warning"), "R08": ("todo-fixme-accumulation", "info"), "R09": ("commented-out-code", "warning"),
    "R10": ("magic-number", "info"), "R14": ("hardcoded-secret", "error"), "R15": ("missing-input-validation", "warning"),
    "R16": ("self-validating-test", "warning"), "R18": ("async-missing-await", "error"), "R19": ("n-plus-one-query", "warning"),
    "R20": ("resource-leak", "warning"), "R23": ("wrong-error-type-propagation", "warning"),
    "R24": ("hardcoded-path-or-url", "warning"), "R28": ("overly-defensive-handling", "info"),
}
_CATALOGUE = ", ".join(f"('{r}', '{n}', '{s}')" for r, (n, s) in _NAMES.items())

_STR = "(CASE WHEN j % 7 <= 4 THEN 1 ELSE 0 END + CASE WHEN j % 7 <= 2 THEN 1 ELSE 0 END)"
_N_STR = _by_lang(
    _STR,
    f"{_STR} + CASE WHEN j % 4 = 2 THEN 1 ELSE 0 END",
    f"{_STR} + j % 4 + 1 + CASE WHEN j % 4 >= 2 THEN 1 ELSE 0 END + CASE WHEN j % 5 = 0 THEN 1 ELSE 0 END",
    _STR,
)
_IMP = "CASE WHEN language = 'csharp' THEN concat('Lib', i) ELSE concat('Imp', k, 'x', i) END"
_NUM_COL, _FIX_COL = _by_lang(16, 5, 11, 21), _by_lang(16, 5, 11, 23)
_TEST_LINE = f"({_by_lang(line_sql('test', 1), line_sql('test', 1), line_sql('test', 0), line_sql('test', 0))}) AS line"
_TEST_CALL_LINE = f"({_by_lang(line_sql('test', 1), line_sql('test', 1), line_sql('test', 1), line_sql('test', 0))}) AS line"
_NUM_LINE = _by_lang(
    "concat('const N', i, ': i64 = ', 2000 + k, ';')",
    "concat('n', i, ' = ', 2000 + k)",
    "concat('const n', i, ' = ', 2000 + k, ';')",
    "concat('    static long n', i, ' = ', 2000 + k, ';')",
)
_UNWRAP = "CASE j % 6 WHEN 1 THEN 'unwrap_or' WHEN 2 THEN 'unwrap_or_default' ELSE 'unwrap_or_else' END"

# Severity counts of the whole review: per query the rows it should find, by rule and severity.
_REVIEW = {
    ("R01", "error"): ["r01_rust_fallback", "r01_python_except"],
    ("R02", "warning"): ["r02_long_function", "r02_params", "r02_nesting"],
    ("R03", "warning"): ["r03_missing_doc"],
    ("R04", "warning"): ["r04_few_assertions"],
    ("R05", "warning"): ["r05_shallow_integration"],
    ("R06", "info"): ["r06_single_impl", "r06_generics"],
    ("R07", "warning"): ["r07_unused_import"],
    ("R08", "info"): ["r08_todo"],
    ("R09", "warning"): ["r09_commented_code"],
    ("R10", "info"): ["r10_magic_number"],
    ("R14", "error"): ["r14_secrets_code"],
    ("R15", "warning"): ["r15_missing_validation"],
    ("R16", "warning"): ["r16_vague_name", "r16_private_access"],
    ("R18", "error"): ["r18_missing_await_py", "r18_missing_await_ts"],
    ("R19", "warning"): ["r19_n_plus_one_py", "r19_n_plus_one_ts"],
    ("R20", "warning"): ["r20_python_leak", "r20_listener_leak"],
    ("R23", "warning"): ["r23_wrong_error_type"],
    ("R24", "warning"): ["r24_path_url_code"],
    ("R28", "info"): ["r28_rust", "r28_ts"],
}

_EVENTS = """e AS (SELECT event_id, event_type,
  CASE WHEN event_type = 'error' THEN 'error' WHEN event_type IN ('click', 'purchase') THEN 'warning' ELSE 'info' END AS severity,
  CASE user_id % 5 WHEN 0 THEN 'R01' WHEN 1 THEN 'R07' WHEN 2 THEN 'R08' WHEN 3 THEN 'R24' ELSE 'X99' END AS rule_id,
  concat('s', event_id % 4) AS snapshot,
  concat('d', user_id % 3, '/f', user_id % 11, '.rs') AS file, concat('f', user_id % 11, '.rs') AS name,
  CAST(event_id % 97 + 1 AS INTEGER) AS line FROM events),
r AS (SELECT *, row_number() OVER (ORDER BY CASE severity WHEN 'info' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END,
  string_split(file, '/'), line, CASE rule_id WHEN 'R01' THEN 0 WHEN 'R07' THEN 6 WHEN 'R08' THEN 7 WHEN 'R24' THEN 17 ELSE 19 END,
  event_id) AS pos FROM e)"""
_KNOWN = "known AS (SELECT DISTINCT file, line, rule_id FROM e WHERE snapshot = 's0')"
_FLAT = "event_id, rule_id, severity, file, line"


def _e(body: str, known: bool = False) -> str:
    return f"WITH {_EVENTS}{', ' + _KNOWN if known else ''} {body}"


_COUNTS = (
    "count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings, "
    "count(*) FILTER (WHERE severity = 'info') AS infos"
)
_NOT_KNOWN = "NOT EXISTS (SELECT 1 FROM known b WHERE b.file = e.file AND b.line = e.line AND b.rule_id = e.rule_id)"


_LOCATION = (
    "CASE WHEN strlen({x}) < 8 OR contains({x}, '{{}}') OR contains({x}, '{{0}}') OR contains({x}, '{{1}}') OR {x} IN ('https://', 'http://') THEN NULL "
    "WHEN regexp_matches({x}, '^https?://') AND NOT regexp_matches({x}, '^https?://(localhost|127\\.0\\.0\\.1|0\\.0\\.0\\.0)([/:]|$)') THEN 'url' "
    "WHEN (starts_with({x}, '/') AND NOT starts_with({x}, '//')) OR regexp_matches({x}, '^[A-Za-z]:[\\\\/]') THEN 'path' END"
)
_SKIPS = (
    "s AS (SELECT path, concat('unsupported file extension: ', CASE WHEN k % 9 = 6 THEN 'txt' ELSE 'RS' END) AS error FROM "
    f"(SELECT k, {LAYOUTS['extensions']} AS path FROM (SELECT p_partkey AS k FROM part)) WHERE k % 9 IN (6, 7))"
)
_N = f"n AS (SELECT {_COUNTS}, (SELECT count(*) FROM part WHERE p_partkey % 9 NOT IN (6, 7)) AS files, (SELECT count(*) FROM part WHERE p_partkey % 9 IN (6, 7)) AS skipped FROM e)"
_TEXT_LINES = f"""WITH {_SKIPS}, {_N}
SELECT concat(rule_id, ' ', severity, ' ', file, ':', line, ':', event_id, '  ', event_type) AS value FROM e
UNION ALL SELECT concat(errors + warnings + infos, ' findings (', errors, ' errors, ', warnings, ' warnings, ', infos, ' infos) in ', files, ' files',
  CASE WHEN skipped > 0 THEN concat(', ', skipped, ' skipped') ELSE '' END) FROM n
UNION ALL SELECT concat('parse failed ', path, ': ', error) FROM s"""
_ADVICE = ", ".join("('{}', '{}')".format(r.rule_id, r.advice.replace("'", "''")) for r in RULES if r.advice)
_BEST = "row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, first) AS place FROM (SELECT {keys}, name, count(*) AS n, min(pos) AS first FROM r WHERE {cond} GROUP BY {keys}, name)"
_MARKDOWN = f"""WITH {_SKIPS}, {_N}, a(rule_id, advice) AS (VALUES {_ADVICE})
SELECT unnest(['# Review report', '', 'Scanned: /data/code', '', concat('Files: ', files, ' (skipped ', skipped, '), findings: ', errors + warnings + infos),
  '', '## Totals', '', '| severity | count |', '|---|---|', concat('| error | ', errors, ' |'), concat('| warning | ', warnings, ' |'),
  concat('| info | ', infos, ' |'), '', '', '## Errors', '', '', '## Warnings and infos', '']) AS value FROM n
UNION ALL SELECT unnest([concat('## Parse failures (', skipped, ')'), '']) FROM n WHERE skipped > 0
UNION ALL SELECT concat('- ', path, ': ', error) FROM s
UNION ALL SELECT 'No errors.' FROM n WHERE errors = 0
UNION ALL SELECT 'None.' FROM n WHERE warnings + infos = 0
UNION ALL SELECT concat('### ', rule_id, ' rule-', lower(rule_id), ': ', count(*)) FROM e WHERE severity = 'error' GROUP BY rule_id
UNION ALL SELECT concat('**Advice**: ', advice) FROM a WHERE rule_id IN (SELECT rule_id FROM e WHERE severity = 'error')
UNION ALL SELECT concat('- ', name, ': ', n) FROM (SELECT *, {_BEST.format(keys="rule_id", cond="severity = 'error'")}) WHERE place <= 5
UNION ALL SELECT concat('- ', file, ':', line, ': ', event_type) FROM
  (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY pos) AS place FROM r WHERE severity = 'error') WHERE place <= 3
UNION ALL SELECT concat('### ', rule_id, ' rule-', lower(rule_id), ' (', severity, '): ', count(*)) FROM e WHERE severity <> 'error' GROUP BY rule_id, severity
UNION ALL SELECT concat('- ', name, ': ', n) FROM (SELECT *, {_BEST.format(keys="rule_id, severity", cond="severity <> 'error'")}) WHERE place <= 5"""


def oracle() -> dict[str, str]:
    py_items = [
        ("wide", 0, "function"), ("parm", 0, "function"), ("deep", 0, "function"), ("fall", 0, "function"), ("doc", 1, "class"),
        ("test", 1, "function"), ("flow", 0, "function"), ("job", 0, "function"), ("job", 2, "function"), ("leak", 0, "function"),
        ("pick", 1, "function"),
    ]
    q = {
        # scan
        "scan_language_filter": _p("extensions", f"SELECT fid, path, {_LANG9} AS language FROM p WHERE {_LANG9} IS NOT NULL"),
        "scan_default_excludes": _p("directories", "SELECT fid, path FROM p WHERE k % 12 IN (0, 2, 4, 5, 6, 10)"),
        "scan_config_excludes": _p("directories", "SELECT fid, path FROM p WHERE k % 12 IN (0, 2, 5, 6, 10) AND k % 5 <> 0"),
        "scan_ignore_inherited": _p(
            "nested",
            "SELECT fid, path FROM p WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = k % 30 "
            "AND ((k % 4 = 0 AND k % 5 = n_regionkey) OR k % 6 = 0))",
        ),
        "scan_skipped_files": _p(
            "extensions",
            "SELECT path, CASE WHEN error IS NULL THEN 'scanned' ELSE 'skipped' END AS status, error FROM (SELECT path, "
            "CASE k % 9 WHEN 6 THEN 'unsupported file extension: txt' WHEN 7 THEN 'unsupported file extension: RS' "
            "ELSE CASE WHEN fid % 7 = 0 THEN 'io error: not valid UTF-8' END END AS error FROM p) s",
        ),
        "test_path_long": _p("tests", "SELECT fid, path, (k % 5 IN (1, 2, 3) OR k % 9 <> 7) AS is_test FROM p"),
        "test_path_short": _p("tests", "SELECT fid, path, (k % 5 IN (1, 2, 3) OR k % 9 <= 4) AS is_test FROM p"),
        "rule_scope_counts": _f(
            f"SELECT rule_id, count(*) AS n FROM ({_SCOPE}) s WHERE rule_id <> 'R03' "
            "AND NOT (rule_id = 'R08' AND path LIKE '%/combine%') GROUP BY rule_id"
        ),
        "rule_catalogue": _f(
            f"SELECT c.rule_id, c.rule_name, c.severity, count(s.fid) AS files FROM (VALUES {_CATALOGUE}) c(rule_id, rule_name, severity) "
            f"LEFT JOIN ({_SCOPE}) s ON s.rule_id = c.rule_id GROUP BY 1, 2, 3"
        ),
        # facts
        "facts_lines": "WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents), "
        "t AS (SELECT doc_id, CASE WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END AS p FROM s), "
        "u AS (SELECT doc_id, regexp_replace(unnest(p), chr(13) || '$', '') AS line, len(p) AS n FROM t) "
        "SELECT doc_id, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars, max(n) - 1 AS last_row, "
        "count(*) FILTER (WHERE trim(line) = '') AS blank FROM u GROUP BY doc_id",
        "facts_tokens_lossless": "SELECT doc_id, strlen(text) AS bytes FROM documents WHERE text <> ''",
        "facts_tokens_by_kind": "SELECT fid, CAST(sum(opens) AS BIGINT) AS opens, CAST(sum(closes) AS BIGINT) AS closes, "
        "CAST(max(before + peak) - 1 AS INTEGER) AS deepest FROM (SELECT *, coalesce(sum(opens - closes) OVER (PARTITION BY fid ORDER BY line "
        f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ({_each(_brackets_in)}) b) d GROUP BY fid",
        "facts_comments": _each(_comments_in),
        "facts_string_literals": _f(f"SELECT fid, {_N_STR} AS n FROM f WHERE ({_N_STR}) > 0"),
        "facts_number_literals": _each(_numbers_in),
        "facts_functions": _union(
            f"SELECT fid, concat('wide', k) AS name, {_l('wide')}, 45 + j % 12 - CASE WHEN {PY} THEN 1 ELSE 0 END AS n_lines FROM f",
            f"SELECT fid, concat('parm', k), {_l('parm')}, CASE WHEN {PY} THEN 2 ELSE 3 END FROM f",
            f"SELECT fid, concat('deep', k), {_l('deep')}, CASE WHEN {PY} THEN 2 + j % 6 ELSE 3 + 2 * (j % 6) END FROM f",
            f"SELECT fid, concat(CASE WHEN j % 6 = 5 AND NOT {PY} AND NOT {RUST} THEN 'TryFall' ELSE 'fall' END, k), {_l('fall')}, "
            f"CASE WHEN {PY} THEN 6 ELSE 8 END FROM f",
            f"SELECT fid, concat('exportDoc', k), {_l('doc', 1)}, 2 FROM f WHERE {TS}",
            f"SELECT fid, concat('doc', k), {_l('doc', 1)}, 2 FROM f WHERE {JVM}",
            f"SELECT fid, {_WIDTHS['tn']}, {_TEST_LINE}, {_by_lang('3 + j % 3', '2 + j % 3', '1', '4 + j % 3')} FROM f",
            f"SELECT fid, '', {_l('test', 1)}, 3 + j % 3 FROM f WHERE {TS}",
            f"SELECT fid, concat('end_to_end_flow', k), {_l('flow')}, CASE WHEN {PY} THEN 2 ELSE 3 END + j % 4 FROM f",
            f"SELECT fid, concat('gen', k), {_l('trait', '3 + j % 4')}, 1 FROM f WHERE {RUST}",
            f"SELECT fid, concat('job', k), {_l('job')}, 2 FROM f WHERE {PY} OR {TS}",
            f"SELECT fid, concat('run', k), {_l('job', 2)}, CASE WHEN {PY} THEN 2 ELSE 3 END FROM f WHERE {PY} OR {TS}",
            f"SELECT fid, '', {_l('loop')}, 1 FROM f WHERE {TS} AND j % 4 < 3",
            f"SELECT fid, concat('leak', k), {_l('leak')}, 3 FROM f WHERE {PY}",
            f"SELECT fid, concat(CASE WHEN {RUST} OR {PY} THEN 'pick' ELSE 'handler' END, k), {_l('pick', 1)}, CASE WHEN {PY} THEN 3 ELSE 4 END FROM f",
            f"SELECT fid, concat('sure', k), {_l('sure')}, 3 FROM f WHERE {RUST} OR {TS}",
            f"SELECT fid, CASE language WHEN 'java' THEN 'hashCode' ELSE 'GetHashCode' END, {_l('hash')}, 3 FROM f WHERE {JVM}",
        ),
        "facts_params": _union(
            "SELECT fid, i AS pos, concat('p', i) AS name FROM f, unnest(range(3 + j % 5)) t(i)",
            f"SELECT fid, 0, 'o' FROM f WHERE {RUST}",
            "SELECT fid, i, CASE i WHEN 0 THEN 'items' ELSE 'at' END FROM f, unnest(range(2)) t(i)",
            f"SELECT fid, 0, 'path' FROM f WHERE {PY}",
        ),
        "facts_catches": _union(
            f"SELECT fid, {_l('fall', 3)}, CASE WHEN {KIND} IN (2, 5) THEN 'e' ELSE '' END AS exc_var, {KIND} <> 3 AS is_broad, "
            f"{KIND} <> 4 AS has_return FROM f WHERE {PY} AND {KIND} > 0",
            f"SELECT fid, {_l('fall', 3)}, CASE {KIND} WHEN 3 THEN 'problem' WHEN 4 THEN 'OperationCanceledException' ELSE 'e' END, "
            f"{KIND} IN (1, 2, 5), true FROM f WHERE {TS} AND {KIND} > 0",
            f"SELECT fid, {_l('fall', 3)}, CASE WHEN language = 'csharp' AND {KIND} = 3 THEN 'IOException' "
            f"WHEN language = 'csharp' AND {KIND} = 4 THEN 'OperationCanceledException' ELSE 'e' END, {KIND} IN (1, 2, 5), true "
            f"FROM f WHERE {JVM} AND {KIND} > 0",
        ),
        "facts_calls": _each(_calls_in),
        "facts_imports": _f(f"SELECT fid, i + 1 AS line, {_IMP} AS name FROM f, unnest(range(j % 4)) t(i)"),
        "facts_loops": _union(
            f"SELECT fid, {_l('loop')}, 'for' AS kind, 'x' AS var, CASE j % 4 WHEN 1 THEN 'Model.objects.all()' "
            f"WHEN 2 THEN 'Model.objects.select_related(\"a\").all()' ELSE 'items' END AS source FROM f WHERE {PY}",
            f"SELECT fid, {_l('loop')}, 'for', '', '' FROM f WHERE {TS} AND j % 4 = 3",
        ),
        "facts_types": _union(
            f"SELECT fid, {_l('trait')}, 'trait' AS kind, concat('Tr', k) AS name, 0 AS n FROM f WHERE {RUST}",
            f"SELECT fid, {_l('trait', '2 + i')}, 'impl', concat('Tr', k), 0 FROM f, unnest(range(j % 4)) t(i) WHERE {RUST}",
            f"SELECT fid, {_l('trait', '2 + j % 4')}, 'impl', concat('Tr', k - 48), 0 FROM f WHERE {RUST} AND j >= 8",
            f"SELECT fid, {_l('trait', '3 + j % 4')}, 'type_params', '', 2 + j % 4 FROM f WHERE {RUST}",
        ),
        "facts_identifiers": _f(
            "SELECT fid, concat('Imp', k, 'x', i) AS name FROM f, unnest(range(least(j % 4, j % 3))) t(i) WHERE language <> 'csharp'"
        ),
        # detectors
        "r01_rust_fallback": _union(
            f"SELECT fid, {_l('fall', 1)}, 4 AS col, {_UNWRAP} AS subject FROM f WHERE {RUST} AND {KIND} IN (1, 2, 3)",
            f"SELECT fid, {_l('sure', 1)}, 12, 'unwrap_or' FROM f WHERE {RUST} AND j % 5 = 0",
        ),
        "r01_python_except": _f(f"SELECT fid, {_l('fall', 3)}, 4 AS col FROM f WHERE {PY} AND {KIND} IN (1, 4)"),
        "r01_catch_return": _union(
            f"SELECT fid, {_l('fall', 3)}, 4 AS col, CASE WHEN {KIND} IN (1, 5) THEN 'error' ELSE 'info' END AS severity "
            f"FROM f WHERE {TS} AND {KIND} IN (1, 2, 3, 5)",
            f"SELECT fid, {_l('fall', 3)}, 10, CASE WHEN {KIND} = 1 THEN 'error' ELSE 'info' END FROM f WHERE {JVM} AND {KIND} IN (1, 2, 3)",
        ),
        "r02_long_function": _f(
            f"SELECT fid, {_l('wide')}, concat('wide', k) AS subject, n AS measure FROM "
            f"(SELECT *, 45 + j % 12 - CASE WHEN {PY} THEN 1 ELSE 0 END AS n FROM f) t WHERE n > 50"
        ),
        "r02_params": _f(f"SELECT fid, {_l('parm')}, concat('parm', k) AS subject, 3 + j % 5 AS measure FROM f WHERE 3 + j % 5 > 5"),
        "r02_nesting": _f(
            f"SELECT fid, {_l('deep')}, concat('deep', k) AS subject, n AS measure FROM "
            f"(SELECT *, CASE WHEN {TS} THEN j % 6 ELSE 1 + 2 * (j % 6) END AS n FROM f) t WHERE n > 4"
        ),
        "r03_missing_doc": _union(
            f"SELECT fid, {_l('doc', 1)}, CASE WHEN {RUST} THEN 'struct' ELSE 'function' END AS subject FROM f WHERE NOT {PY} AND j % 3 = 0",
            *[f"SELECT fid, {_l(s, o)}, '{kind}' FROM f WHERE {PY}" for s, o, kind in py_items],
        ),
        "r04_few_assertions": _f(f"SELECT fid, {_TEST_CALL_LINE}, 0 AS measure FROM f WHERE j % 3 = 0"),
        "r05_shallow_integration": _f(
            f"SELECT fid, {_l('flow')}, concat('end_to_end_flow', k) AS subject, j % 4 + 1 AS measure FROM f WHERE j % 4 <= 1"
        ),
        "r06_single_impl": _f(f"SELECT fid, {_l('trait')}, concat('Tr', k) AS subject, j % 4 AS measure FROM f WHERE {RUST} AND j % 4 <= 1"),
        "r06_single_impl_repo": _f(
            f"SELECT fid, line, concat('Tr', k) AS subject, n AS measure FROM (SELECT f.fid, f.k, {_l('trait').replace('j %', 'f.j %')}, "
            "f.j % 4 + CASE WHEN g.k IS NULL THEN 0 ELSE 1 END AS n FROM f LEFT JOIN f g ON g.k = f.k + 48 WHERE f.language = 'rust') t WHERE n <= 1"
        ),
        "r06_generics": _f(f"SELECT fid, {_l('trait', '3 + j % 4')}, 2 + j % 4 AS measure FROM f WHERE {RUST} AND 2 + j % 4 > 3"),
        "r07_unused_import": _f(
            "SELECT fid, i + 1 AS line, concat('Imp', k, 'x', i) AS subject FROM f, unnest(range(least(j % 4, j % 3), j % 4)) t(i) "
            "WHERE language <> 'csharp'"
        ),
        "r08_todo": _f(
            f"SELECT fid, {_l('notes', 'i')}, 0 AS col, concat(CASE WHEN {PY} THEN '# ' ELSE '// ' END, "
            "CASE i WHEN 0 THEN 'todo' WHEN 1 THEN 'FIXME' ELSE 'xxx' END, ': later') AS snippet FROM f, unnest(range(j % 3)) t(i)"
        ),
        "r09_commented_code": _f(f"SELECT fid, {_l('dead', 1)}, j % 7 AS measure FROM f WHERE j % 7 >= 3"),
        "r10_magic_number": _f(
            f'SELECT fid, {_l("numbers", "i")}, {_NUM_COL} + 1 AS "column", CAST(2000 + k AS VARCHAR) AS subject, {_NUM_LINE} AS snippet '
            "FROM f, unnest(range(j % 3)) t(i) WHERE j % 10 <> 0"
        ),
        "r14_secrets_documents": "WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, "
        "'(?i)\\b\\w*(?:secret|token|passw|api_?key|private_?key)\\w*\\s*[=:]\\s*\"[^\"]*\"')) AS m FROM documents), "
        "s AS (SELECT doc_id, lower(regexp_extract(m, '^(\\w+)', 1)) AS name, regexp_extract(m, '\"([^\"]*)\"$', 1) AS secret FROM m), "
        "n AS (SELECT row_number() OVER () AS id, * FROM s), "
        "c AS (SELECT id, ch, count(*) AS x FROM (SELECT id, unnest(string_split(secret, '')) AS ch FROM n) u WHERE ch <> '' GROUP BY id, ch), "
        "h AS (SELECT id, -sum(x / t * log2(x / t)) AS bits FROM (SELECT id, CAST(x AS DOUBLE) AS x, sum(x) OVER (PARTITION BY id) AS t FROM c) v GROUP BY id) "
        "SELECT doc_id, name, secret FROM n LEFT JOIN h USING (id) WHERE regexp_matches(secret, "
        "'sk-[A-Za-z0-9_-]{16,}|ghp_[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{16}|xoxb-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{20,}|BEGIN (?:[A-Z]+ )?PRIVATE KEY') "
        "OR (length(secret) >= 20 AND regexp_matches(secret, '^[A-Za-z0-9+/=_-]+$') AND bits >= 3.0)",
        "r14_secrets_code": _f(
            f"SELECT fid, {_l('secret')}, CASE WHEN j % 7 = 0 THEN 'known_key' ELSE 'named_secret' END AS variant, 40 AS measure FROM f WHERE j % 7 <= 1"
        ),
        "r15_missing_validation": _f(f"SELECT fid, {_l('pick', 1)}, 'index' AS variant, 'items' AS subject FROM f WHERE j % 2 = 1"),
        "r16_vague_name": _f(f"SELECT fid, {_TEST_LINE}, concat('test_calc', k) AS subject FROM f WHERE j % 2 = 0"),
        "r16_private_access": _f(f"SELECT fid, {_TEST_LINE}, 'inner' AS subject FROM f WHERE j % 2 = 1 AND j % 3 = 1"),
        "r18_missing_await_py": _f(f"SELECT fid, {_l('job', 3)}, 4 AS col, concat('job', k) AS subject FROM f WHERE {PY} AND j % 2 = 1"),
        "r18_missing_await_ts": _f(f"SELECT fid, {_l('job', 3)}, 2 AS col, concat('job', k) AS subject FROM f WHERE {TS} AND j % 2 = 1"),
        "r19_n_plus_one_py": _f(f"SELECT fid, {_l('loop')}, 'x' AS subject FROM f WHERE {PY} AND j % 4 = 1"),
        "r19_n_plus_one_ts": _f(f"SELECT fid, {_l('loop')}, 'map' AS subject FROM f WHERE {TS} AND j % 4 = 1"),
        "r20_python_leak": _f(f"SELECT fid, {_l('leak')}, concat('leak', k) AS subject FROM f WHERE {PY} AND j % 3 = 0"),
        "r20_listener_leak": _f(f"SELECT fid, {_l('loop')} FROM f WHERE {TS} AND j % 4 = 3"),
        "r23_wrong_error_type": _f(
            f"SELECT fid, {_l('fall', 3)}, CASE WHEN {JVM} THEN 10 ELSE 4 END AS col FROM f WHERE NOT {RUST} AND {KIND} IN (1, 5)"
        ),
        "r24_path_url_code": _f(
            f"SELECT fid, {_l('url')}, CASE WHEN j % 7 = 0 THEN 'url' ELSE 'path' END AS variant, "
            "CASE WHEN j % 7 = 0 THEN concat('https://host', k, '.example.org/x') ELSE concat('/opt/data/f', k) END AS subject "
            "FROM f WHERE j % 7 IN (0, 2) AND j % 10 <> 0"
        ),
        "r24_url_pages": f"SELECT page_id, {_LOCATION.format(x='url')} AS kind FROM pages",
        "r24_literals_pages": "SELECT page_id, kind, literal, count(*) AS n FROM (SELECT page_id, literal, "
        f"{_LOCATION.format(x='literal')} AS kind FROM (SELECT page_id, unnest(regexp_extract_all(html, '\"([^\"]*)\"', 1)) AS literal "
        "FROM pages)) WHERE kind IS NOT NULL GROUP BY ALL",
        "r28_rust": _f(f"SELECT fid, {_l('sure', 1)}, 12 AS col FROM f WHERE {RUST} AND j % 5 = 0"),
        "r28_ts": _f(f"SELECT fid, {_l('sure', 1)}, 12 AS col, '\"x\"' AS subject FROM f WHERE {TS} AND j % 5 = 0"),
        # findings
        "severity_filter": _e(f"SELECT {_FLAT} FROM e WHERE severity <> 'info'"),
        "baseline_diff": _e(f"SELECT {_FLAT} FROM e WHERE {_NOT_KNOWN}", known=True),
        "baseline_diff_snippet": _e(
            f"SELECT {_FLAT} FROM e WHERE NOT EXISTS (SELECT 1 FROM e b WHERE b.snapshot = 's0' AND b.severity = 'warning' AND b.file = e.file "
            "AND b.rule_id = e.rule_id AND b.event_type = e.event_type)"
        ),
        "report_json_full": _e(f"SELECT {_FLAT} FROM e"),
        "report_text_full": _e(f"SELECT value FROM ({_TEXT_LINES}) x"),
        "report_markdown_full": _e(f"SELECT value FROM ({_MARKDOWN}) x"),
        "baseline_diff_loaded": _e(f"SELECT {_FLAT} FROM e WHERE {_NOT_KNOWN}", known=True),
        "scan_folder": _p(
            "hidden",
            "SELECT path, split_part(path, '/', -1) AS name, CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.rs' THEN 'rust' "
            "WHEN path LIKE '%.ts' THEN 'typescript' ELSE 'java' END AS language, CAST(9 + length(path) AS INTEGER) AS chars FROM p "
            "WHERE path NOT LIKE '%.md' AND k % 6 <> 1 AND NOT EXISTS (SELECT 1 FROM region WHERE r_regionkey = k % 7 "
            "AND (k % 8 = 3 OR (k % 6 = 3 AND k % 5 = r_regionkey)))",
        ),
        "review_selected_rules": _union(
            f"SELECT fid, 'R02' AS rule_id, {_l('wide')}, 'lines' AS variant, concat('wide', k) AS subject, n AS measure, 50 AS \"limit\" FROM "
            f"(SELECT *, 45 + j % 12 - CASE WHEN {PY} THEN 1 ELSE 0 END AS n FROM f) t WHERE n > 50",
            f"SELECT fid, 'R02', {_l('parm')}, 'params', concat('parm', k), 3 + j % 5, 3 FROM f WHERE j % 5 > 0",
            f"SELECT fid, 'R02', {_l('deep')}, 'nesting', concat('deep', k), n, 4 FROM "
            f"(SELECT *, CASE WHEN {TS} THEN j % 6 ELSE 1 + 2 * (j % 6) END AS n FROM f) t WHERE n > 4",
        ),
        "review_own_detector": _f(
            "SELECT fid, 'Z01' AS rule_id, 'wide-name' AS rule_name, 'info' AS severity, line, subject, CAST(n AS BIGINT) AS measure FROM ("
            f"SELECT fid, {_l('wide')}, concat('wide', k) AS subject, 45 + j % 12 - CASE WHEN {PY} THEN 1 ELSE 0 END AS n FROM f WHERE {PY} OR {RUST} "
            f"UNION ALL SELECT fid, {_l('parm')}, concat('parm', k), CASE WHEN {PY} THEN 2 ELSE 3 END FROM f WHERE {PY} OR {RUST}) t"
        ),
        "stream_new_findings": _e(f"SELECT {_FLAT} FROM e WHERE severity <> 'info' AND {_NOT_KNOWN}", known=True),
        "stream_unseen_findings": _e(
            f"SELECT {_FLAT} FROM (SELECT *, min(snapshot) OVER (PARTITION BY file, line, rule_id) AS first FROM e WHERE severity <> 'info') e "
            "WHERE snapshot = first"
        ),
        "baseline_stats": _e(
            "SELECT count(*) AS total, count(*) FILTER (WHERE b.rule_id IS NULL) AS new, count(b.rule_id) AS known FROM e "
            "LEFT JOIN known b ON b.file = e.file AND b.line = e.line AND b.rule_id = e.rule_id",
            known=True,
        ),
        "summary": _e(
            f"SELECT {_COUNTS}, (SELECT count(*) FROM part WHERE p_partkey % 9 NOT IN (6, 7)) AS files, "
            "(SELECT count(*) FROM part WHERE p_partkey % 9 IN (6, 7)) AS skipped FROM e"
        ),
        "group_by_rule": _e(
            "SELECT rule_id, n, row_number() OVER (ORDER BY first) AS seen FROM (SELECT rule_id, count(*) AS n, min(pos) AS first FROM r GROUP BY rule_id) g"
        ),
        "group_by_rule_severity": _e(
            "SELECT rule_id, severity, n, row_number() OVER (ORDER BY first) AS seen FROM "
            "(SELECT rule_id, severity, count(*) AS n, min(pos) AS first FROM r GROUP BY rule_id, severity) g"
        ),
        "top_files": _e(
            "SELECT rule_id, file, n, rank FROM (SELECT rule_id, name AS file, n, row_number() OVER (PARTITION BY rule_id ORDER BY n DESC, first) AS rank "
            "FROM (SELECT rule_id, name, count(*) AS n, min(pos) AS first FROM r GROUP BY rule_id, name) g) h WHERE rank <= 5"
        ),
        "rule_examples": _e(
            "SELECT rule_id, rank, file, line, event_type AS snippet FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY pos) AS rank FROM r) g WHERE rank <= 3"
        ),
        "with_suggestion": _e("SELECT rule_id, rule_id <> 'X99' AS has_advice, count(*) AS n FROM e GROUP BY 1, 2"),
        "gate": _e("SELECT coalesce(bool_or(severity = 'error'), false) AS failed, count(*) FILTER (WHERE severity = 'error') AS errors FROM e"),
        "compare_runs": _e(
            "SELECT *, total - lag(total) OVER (ORDER BY snapshot) AS total_change, errors - lag(errors) OVER (ORDER BY snapshot) AS errors_change "
            f"FROM (SELECT snapshot, count(*) AS total, {_COUNTS} FROM e GROUP BY snapshot) g"
        ),
        "split_errors": _e(
            "SELECT count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity <> 'error') AS others FROM e"
        ),
        "sort_ranked": _e("SELECT event_id, pos AS rank FROM r"),
        "text_lines": _e(
            "SELECT event_id, concat(rule_id, ' ', severity, ' ', file, ':', line, ':', event_id, '  ', event_type) AS value FROM e"
        ),
        "report_json_roundtrip": _e("SELECT DISTINCT file, line, rule_id FROM e"),
        "corpus_compare_snapshots": _f(
            f"SELECT fid, {total_lines_sql()} + 1 AS line, concat(CASE WHEN {PY} THEN '#' ELSE '//' END, ' todo: second snapshot') AS snippet "
            "FROM f WHERE j % 3 = 0"
        ),
    }
    # Nothing is called on the first line of the function around it.
    q["facts_enclosing_function"] = (
        f"SELECT c.fid, c.line, max_by(g.name, g.line) AS name FROM ({q['facts_calls']}) c LEFT JOIN ({q['facts_functions']}) g "
        "ON g.fid = c.fid AND g.line < c.line AND c.line < g.line + g.n_lines GROUP BY c.fid, c.line, c.col, c.name"
    )
    parts = [
        f"SELECT '{rule}' AS rule_id, '{sev}' AS severity FROM ({q[name]}) x"
        for (rule, sev), names in _REVIEW.items()
        for name in names
    ]
    parts.append(f"SELECT 'R01', severity FROM ({q['r01_catch_return']}) x")
    q["review_by_rule"] = f"SELECT rule_id, severity, count(*) AS n FROM ({' UNION ALL '.join(parts)}) u GROUP BY rule_id, severity"
    return {**q, **ODD}
