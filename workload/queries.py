"""The registered queries. Each takes (spark, sf_dir) and returns a DataFrame with flat columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coralint.functions import paths as P
from coralint.functions.lexer import lexemes_of
from coralint.model import Config, RuleSpec, list_rules
from coralint.operators import lexemes as L
from coralint.operators.bundle import Facts
from coralint.operators.detectors import catch_rules as CR
from coralint.operators.detectors import function_rules as FR
from coralint.operators.detectors import literal_rules as LR
from coralint.operators.detectors import name_rules as NR
from coralint.operators.hits import hits
from coralint.operators.sweep import innermost
from coralint.plans import findings as FN
from coralint.plans.review import attach, detect, register_detector, rule_scope, select_rules, unregister_detector
from coralint.session import ensure_checkpoint_dir
from coralint.sinks.reports import finding_line, write_report
from coralint.sources import corpus as S
from coralint.sources.baseline import baseline_of, load_baseline
from coralint.streaming.stream import findings_stream, unseen_stream
from workload import corpus as C
from workload import odd
from workload.oracle import LAYOUTS
from workload.shared import shared_facts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SCRIPTS = ("typescript", "tsx")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def facts(spark: SparkSession, sf: str, snapshot: int = 1) -> Facts:
    """Stored facts of the corpus; the detectors read its tables."""
    return shared_facts(spark, sf, f"s{snapshot}", lambda: C.code_files(spark, sf, snapshot), C.corpus_partitions(spark, sf))


def placed(found: DataFrame, *extra: str) -> DataFrame:
    """Hits as ``(fid, line, ..)``."""
    return found.select("fid", (F.col("row") + 1).alias("line"), *extra)


def line(row: str = "row") -> Column:
    return (F.col(row) + 1).alias("line")


# ---------------------------------------------------------------- scan


def layout(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """Paths derived from ``part``, one per row."""
    return spark.read.parquet(f"{sf}/part.parquet").select(
        F.col("p_partkey").alias("fid"), F.expr("cast(p_partkey as bigint)").alias("k")
    ).select("fid", F.expr(LAYOUTS[name]).alias("path"))


@query
def scan_language_filter(spark, sf):
    return S.with_language(layout(spark, sf, "extensions")).select("fid", "path", "language")


@query
def scan_default_excludes(spark, sf):
    return S.exclude_paths(layout(spark, sf, "directories"))


@query
def scan_config_excludes(spark, sf):
    return S.exclude_paths(layout(spark, sf, "directories"), ["*.gen.rs", "legacy/"])


@query
def scan_ignore_inherited(spark, sf):
    files = layout(spark, sf, "nested").withColumn("repo", F.lit("r"))
    texts = spark.read.parquet(f"{sf}/nation.parquet").select(
        F.lit("r").alias("repo"),
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("dir"),
        F.concat(
            F.lit("# notes\n\n!keep\n/skip"), F.col("n_regionkey").cast("string"), F.lit("/\na/b\n**/x\n*.tmp.rs\n")
        ).alias("text"),
    )
    return S.exclude_by_ignore(files, S.parse_ignore_files(texts)).select("fid", "path")


@query
def scan_skipped_files(spark, sf):
    files = layout(spark, sf, "extensions")
    content = F.when(F.col("fid") % 7 == 0, F.unhex(F.lit("66FF6F"))).otherwise(F.encode(F.lit("ok"), "utf-8"))
    raw = files.select(F.lit("r").alias("repo"), F.lit("s").alias("snapshot"), "path", content.alias("content"))
    _, status = S.split_status(raw)
    return status.select("path", "status", "error")


@query
def test_path_long(spark, sf):
    return layout(spark, sf, "tests").withColumn("is_test", P.is_test_path(F.col("path")))


@query
def test_path_short(spark, sf):
    return layout(spark, sf, "tests").withColumn("is_test", P.is_test_path(F.col("path"), "short"))


_SCOPE_CONFIG = {"rules": {"R03": {"enabled": False}, "R08": {"exclude_files": ["Combine"]}}}


@query
def rule_scope_counts(spark, sf):
    scope = rule_scope(C.code_files(spark, sf), config=Config.from_dict(_SCOPE_CONFIG))
    return scope.groupBy("rule_id").agg(F.count("*").alias("n"))


@query
def rule_catalogue(spark, sf):
    used = rule_scope(C.code_files(spark, sf)).groupBy("rule_id").agg(F.count("*").alias("files"))
    return list_rules(spark).join(used, "rule_id", "left").select(
        "rule_id", "rule_name", "severity", F.coalesce("files", F.lit(0)).alias("files")
    )


# ---------------------------------------------------------------- facts


def documents(spark: SparkSession, sf: str) -> DataFrame:
    langs = F.array(*[F.lit(g) for g in C.LANGS])
    return spark.read.parquet(f"{sf}/documents.parquet").select(
        F.col("doc_id").alias("fid"), F.get(langs, (F.col("doc_id") % 6).cast("int")).alias("language"), "text"
    )


@query
def facts_lines(spark, sf):
    """Line facts of real documents, whole texts."""
    return (
        L.lines(documents(spark, sf))
        .groupBy(F.col("fid").alias("doc_id"))
        .agg(
            F.count("*").alias("lines"),
            F.sum(F.length("line")).alias("chars"),
            F.max("row").alias("last_row"),
            F.count_if(F.trim("line") == "").alias("blank"),
        )
    )


@query
def facts_tokens_lossless(spark, sf):
    """Lexing of real documents loses nothing: the lexemes' bytes are the text's bytes."""
    docs = documents(spark, sf)
    lexed = docs.select("fid", F.explode(lexemes_of(F.col("text"), F.col("language"))).alias("t"))
    return lexed.groupBy(F.col("fid").alias("doc_id")).agg(F.sum(F.octet_length("t")).alias("bytes"))


@query
def facts_tokens_by_kind(spark, sf):
    """Statement ends and brackets per file; the corpus is balanced."""
    return facts(spark, sf).lexemes.groupBy("fid").agg(
        F.count_if(F.col("kind") == "open").alias("opens"),
        F.count_if(F.col("kind") == "close").alias("closes"),
        F.max(F.when(F.col("kind") == "close", F.col("depth"))).alias("deepest"),
    )


@query
def facts_comments(spark, sf):
    return facts(spark, sf).comments.select("fid", line(), "col", "is_doc")


@query
def facts_string_literals(spark, sf):
    return facts(spark, sf).strings.groupBy("fid").agg(F.count("*").alias("n"))


@query
def facts_number_literals(spark, sf):
    return facts(spark, sf).numbers.select("fid", line(), "col", "text")


@query
def facts_functions(spark, sf):
    return facts(spark, sf).function_spans.select("fid", "name", line(), "n_lines")


@query
def facts_params(spark, sf):
    return facts(spark, sf).params.select("fid", "pos", "name")


@query
def facts_enclosing_function(spark, sf):
    f = facts(spark, sf)
    calls = f.calls.select("fid", "off", "row")
    spans = f.function_spans.select("fid", "off", "end_off", "name")
    return innermost(calls, spans, ["name"]).select("fid", line(), F.col("span.name").alias("name"))


@query
def facts_catches(spark, sf):
    return facts(spark, sf).catches.select(
        "fid", line(), "exc_var", "is_broad", "has_return"
    )


@query
def facts_calls(spark, sf):
    return facts(spark, sf).calls.select("fid", line(), "col", "name", "is_method")


@query
def facts_imports(spark, sf):
    return facts(spark, sf).imports.select("fid", line(), "name")


@query
def facts_loops(spark, sf):
    return facts(spark, sf).loops.select("fid", line(), "kind", "var", "source")


@query
def facts_types(spark, sf):
    return facts(spark, sf).types.select("fid", line(), "kind", "name", "n")


@query
def facts_identifiers(spark, sf):
    """Imported names that are used somewhere in their file."""
    f = facts(spark, sf)
    return f.imports.join(f.identifiers, ["fid", "name"], "left_semi").select("fid", "name")


# ---------------------------------------------------------------- detectors


@query
def r01_rust_fallback(spark, sf):
    return placed(CR.rust_fallbacks(facts(spark, sf)), "col", "subject")


@query
def r01_python_except(spark, sf):
    return placed(CR.python_excepts(facts(spark, sf)), "col")


@query
def r01_catch_return(spark, sf):
    return placed(CR.catch_returns(facts(spark, sf)), "col", "severity")


@query
def r02_long_function(spark, sf):
    return placed(FR.long_functions(facts(spark, sf)), "subject", "measure")


@query
def r02_params(spark, sf):
    return placed(FR.many_params(facts(spark, sf)), "subject", "measure")


@query
def r02_nesting(spark, sf):
    return placed(FR.deep_nesting(facts(spark, sf)), "subject", "measure")


@query
def r03_missing_doc(spark, sf):
    return placed(FR.detect_r03(facts(spark, sf)), "subject")


@query
def r04_few_assertions(spark, sf):
    return placed(FR.detect_r04(facts(spark, sf)), "measure")


@query
def r05_shallow_integration(spark, sf):
    return placed(FR.detect_r05(facts(spark, sf)), "subject", "measure")


@query
def r06_single_impl(spark, sf):
    return placed(NR.single_impl_traits(facts(spark, sf)), "subject", "measure")


@query
def r06_single_impl_repo(spark, sf):
    return placed(NR.single_impl_traits(facts(spark, sf), "repo"), "subject", "measure")


@query
def r06_generics(spark, sf):
    return placed(NR.excess_generics(facts(spark, sf)), "measure")


@query
def r07_unused_import(spark, sf):
    return placed(NR.detect_r07(facts(spark, sf)), "subject")


@query
def r08_todo(spark, sf):
    return placed(LR.detect_r08(facts(spark, sf)), "col", "snippet")


@query
def r09_commented_code(spark, sf):
    return placed(LR.detect_r09(facts(spark, sf)), "measure")


def _attached(spark, sf, rule_id: str, found: DataFrame, files: DataFrame) -> DataFrame:
    return attach(found, files, select_rules([rule_id]))


@query
def r10_magic_number(spark, sf):
    f = facts(spark, sf)
    out = _attached(spark, sf, "R10", LR.detect_r10(f), f.files)
    return out.select("fid", F.col("location.line").alias("line"), F.col("location.column").alias("column"), "subject", "snippet")


@query
def r14_secrets_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return LR.secrets_in_text(docs, "doc_id", "text")


@query
def r14_secrets_code(spark, sf):
    return placed(LR.detect_r14(facts(spark, sf)), "variant", "measure")


@query
def r15_missing_validation(spark, sf):
    return placed(FR.detect_r15(facts(spark, sf)), "variant", "subject")


@query
def r16_vague_name(spark, sf):
    return placed(FR.vague_test_names(facts(spark, sf)), "subject")


@query
def r16_private_access(spark, sf):
    return placed(FR.private_access_tests(facts(spark, sf)), "subject")


@query
def r18_missing_await_py(spark, sf):
    return placed(NR.missing_awaits(facts(spark, sf), ["python"]), "col", "subject")


@query
def r18_missing_await_ts(spark, sf):
    return placed(NR.missing_awaits(facts(spark, sf), list(SCRIPTS)), "col", "subject")


@query
def r19_n_plus_one_py(spark, sf):
    return placed(NR.python_query_loops(facts(spark, sf)), "subject")


@query
def r19_n_plus_one_ts(spark, sf):
    return placed(NR.script_query_loops(facts(spark, sf)), "subject")


@query
def r20_python_leak(spark, sf):
    return placed(FR.python_leaks(facts(spark, sf)), "subject")


@query
def r20_listener_leak(spark, sf):
    return placed(FR.listener_leaks(facts(spark, sf)))


@query
def r23_wrong_error_type(spark, sf):
    return placed(CR.detect_r23(facts(spark, sf)), "col")


@query
def r24_path_url_code(spark, sf):
    f = facts(spark, sf)
    out = _attached(spark, sf, "R24", LR.detect_r24(f), f.files)
    return out.select("fid", F.col("location.line").alias("line"), "variant", "subject")


@query
def r24_url_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    return pages.select("page_id", LR.classify_location(F.col("url")).alias("kind"))


@query
def r24_literals_pages(spark, sf):
    """Addresses and paths among all quoted literals of whole pages."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    literals = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('"([^"]*)"'), F.lit(1))).alias("literal"))
    found = literals.select("page_id", "literal", LR.classify_location(F.col("literal")).alias("kind")).where("kind IS NOT NULL")
    return found.groupBy("page_id", "kind", "literal").agg(F.count("*").alias("n"))


@query
def r28_rust(spark, sf):
    return placed(NR.needless_unwraps(facts(spark, sf)), "col")


@query
def r28_ts(spark, sf):
    return placed(LR.needless_nullish(facts(spark, sf)), "col", "subject")


# ---------------------------------------------------------------- findings


def event_findings(events: DataFrame) -> DataFrame:
    """Events as findings: the event type gives the severity, the ids give rule, file and line."""
    severity = (
        F.when(F.col("event_type") == "error", "error")
        .when(F.col("event_type").isin("click", "purchase"), "warning")
        .otherwise("info")
    )
    rules = F.array(F.lit("R01"), F.lit("R07"), F.lit("R08"), F.lit("R24"), F.lit("X99"))
    rule = F.get(rules, (F.col("user_id") % 5).cast("int"))
    file = F.concat(F.lit("d"), (F.col("user_id") % 3).cast("string"), F.lit("/f"), (F.col("user_id") % 11).cast("string"), F.lit(".rs"))
    return events.select(
        F.col("event_id").alias("fid"),
        F.concat(F.lit("s"), (F.col("event_id") % 4).cast("string")).alias("snapshot"),
        rule.alias("rule_id"),
        F.concat(F.lit("rule-"), F.lower(rule)).alias("rule_name"),
        severity.alias("severity"),
        FN.sev_rank(severity).alias("sev_rank"),
        F.struct(
            file.alias("file"),
            (F.col("event_id") % 97 + 1).cast("int").alias("line"),
            F.col("event_id").cast("int").alias("column"),
        ).alias("location"),
        F.col("event_type").alias("message"),
        F.concat(F.lit("  "), F.col("event_type"), F.lit(" ")).alias("snippet"),
    )


def findings(spark: SparkSession, sf: str) -> DataFrame:
    return event_findings(spark.read.parquet(f"{sf}/events.parquet"))


def flat(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(
        F.col("fid").alias("event_id"), "rule_id", "severity", F.col("location.file").alias("file"),
        F.col("location.line").alias("line"), *extra,
    )


@query
def severity_filter(spark, sf):
    return flat(FN.filter_severity(findings(spark, sf), "Warning"))


@query
def baseline_diff(spark, sf):
    known = findings(spark, sf).where(F.col("snapshot") == "s0")
    return flat(FN.new_findings(findings(spark, sf), baseline_of(known)))


@query
def baseline_diff_snippet(spark, sf):
    """The difference on a key that survives moved lines."""
    key = ("file", "rule_id", "snippet")
    known = findings(spark, sf).where((F.col("snapshot") == "s0") & (F.col("severity") == "warning"))
    return flat(FN.new_findings(findings(spark, sf), baseline_of(known, key), key))


@query
def baseline_stats(spark, sf):
    known = findings(spark, sf).where(F.col("snapshot") == "s0")
    return FN.baseline_stats(findings(spark, sf), baseline_of(known))


@query
def summary(spark, sf):
    status = S.split_status(
        layout(spark, sf, "extensions").select(F.lit("r").alias("repo"), F.lit("s").alias("snapshot"), "path", F.encode(F.lit("x"), "utf-8").alias("content"))
    )[1]
    return FN.summary(findings(spark, sf), status)


@query
def group_by_rule(spark, sf):
    return FN.group_by_rule(findings(spark, sf))


@query
def group_by_rule_severity(spark, sf):
    return FN.group_by_rule_severity(findings(spark, sf))


@query
def top_files(spark, sf):
    return FN.top_files(findings(spark, sf))


@query
def rule_examples(spark, sf):
    return FN.examples(findings(spark, sf))


@query
def with_suggestion(spark, sf):
    out = FN.with_suggestion(findings(spark, sf))
    return out.groupBy("rule_id", (F.col("suggestion") != "").alias("has_advice")).agg(F.count("*").alias("n"))


@query
def gate(spark, sf):
    return FN.gate(findings(spark, sf))


@query
def compare_runs(spark, sf):
    return FN.compare_runs(findings(spark, sf))


@query
def split_errors(spark, sf):
    errors, others = FN.split_by_severity(findings(spark, sf))
    return FN.one_row(errors.agg(F.count("*").alias("errors")), others.agg(F.count("*").alias("others")))


@query
def sort_ranked(spark, sf):
    return FN.rank_findings(findings(spark, sf)).select(F.col("fid").alias("event_id"), "rank")


@query
def text_lines(spark, sf):
    return findings(spark, sf).select(F.col("fid").alias("event_id"), finding_line().alias("value"))


@query
def report_json_roundtrip(spark, sf):
    """Findings written as JSON text and read back give the baseline keys."""
    text = findings(spark, sf).select(F.to_json(F.struct("rule_id", "severity", "location", "message")).alias("value"))
    back = text.select(F.from_json("value", "rule_id string, location struct<file:string,line:int>").alias("f")).select("f.*")
    return baseline_of(back)


@query
def report_json_full(spark, sf):
    """All findings, written as the JSON document and read back from its lines."""
    folder = f"{ensure_checkpoint_dir(spark)}/report-{uuid.uuid4().hex}"
    status = spark.createDataFrame([], "fid long, path string, status string, error string")
    write_report(findings(spark, sf), status, folder, "json")
    lines = spark.read.text(folder).select(F.regexp_extract("value", r'^,?(\{"rule_id".*\})$', 1).alias("v")).where("v <> ''")
    shape = "rule_id string, severity string, location struct<file:string,line:int,column:bigint>"
    return lines.select(F.from_json("v", shape).alias("f")).select(
        F.col("f.location.column").alias("event_id"), "f.rule_id", "f.severity", "f.location.file", "f.location.line"
    )


def skips(spark: SparkSession, sf: str) -> DataFrame:
    """Status of files of which some cannot be read."""
    names = layout(spark, sf, "extensions").select(F.lit("r").alias("repo"), F.lit("s").alias("snapshot"), "path")
    return S.split_status(names.withColumn("content", F.encode(F.lit("x"), "utf-8")))[1]


def _written(spark, sf, fmt: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark)}/report-{uuid.uuid4().hex}"
    write_report(findings(spark, sf), skips(spark, sf), folder, fmt, "/data/code")
    return spark.read.text(folder)


@query
def report_text_full(spark, sf):
    """The text report as written: findings, totals, skipped files."""
    return _written(spark, sf, "text")


@query
def report_markdown_full(spark, sf):
    """The Markdown report as written."""
    return _written(spark, sf, "md")


@query
def baseline_diff_loaded(spark, sf):
    """The difference against a baseline that is loaded from an earlier report on disk."""
    folder = f"{ensure_checkpoint_dir(spark)}/report-{uuid.uuid4().hex}"
    write_report(findings(spark, sf).where(F.col("snapshot") == "s0"), skips(spark, sf), folder, "json")
    return flat(FN.new_findings(findings(spark, sf), load_baseline(spark, folder, layout="report")))


def _write_files(batches):
    from pyarrow import fs

    for pdf in batches:
        for folder, name, text in zip(pdf["folder"], pdf["path"], pdf["text"]):
            store, inner = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
            full = f"{inner}/{name}"
            store.create_dir(full.rsplit("/", 1)[0])
            with store.open_output_stream(full) as out:
                out.write(text.encode())
        yield pdf[["path"]]


@query
def scan_folder(spark, sf):
    """A folder of files, hidden names, excluded folders and ignore files among them, listed and read from disk."""
    folder = f"{ensure_checkpoint_dir(spark)}/scan-{uuid.uuid4().hex}".removeprefix("file:")
    named = layout(spark, sf, "hidden").select("path", F.concat(F.lit("text of "), "path", F.lit("\n")).alias("text"))
    rules = spark.read.parquet(f"{sf}/region.parquet").select(
        F.concat(F.lit("d"), F.col("r_regionkey").cast("string"), F.lit("/.gitignore")).alias("path"),
        F.concat(F.lit("sub"), F.col("r_regionkey").cast("string"), F.lit("/\n*.tmp.py\n")).alias("text"),
    )
    rows = named.unionByName(rules).repartition("path").select(F.lit(folder).alias("folder"), "path", "text")
    rows.mapInPandas(_write_files, "path string").write.format("noop").mode("overwrite").save()
    files, _ = S.scan(spark, folder)
    return files.select("path", "name", "language", F.length("text").alias("chars"))


_THRESHOLDS = {"rules": {"R02": {"thresholds": {"max_parameters": 3, "max_function_lines": "many"}}, "R08": {"enabled": False}}}


@query
def review_selected_rules(spark, sf):
    """Two listed rules, one of them off; a configured limit, and one that is no number and falls back."""
    found = detect(facts(spark, sf), ["R02", "R08"], _THRESHOLDS)
    return found.select("fid", "rule_id", F.col("location.line").alias("line"), "variant", "subject", "measure", "limit")


@query
def review_own_detector(spark, sf):
    """A rule of one's own beside the built-in ones: functions of three names, by path and line."""
    spec = RuleSpec("Z01", "wide-name", "info", ("python", "rust"), "Rename it.")

    def wide(f: Facts, config: Config) -> DataFrame:
        named = f.among(spec.languages, ["wide", "parm"]).functions.where(F.col("name").rlike("^(?:wide|parm)[0-9]"))
        return hits(named, "Z01", subject=F.col("name"), measure=F.col("n_lines").cast("bigint"))

    register_detector(spec, wide)
    try:
        out = detect(facts(spark, sf), ["Z01"])
    finally:
        unregister_detector("Z01")
    return out.select("fid", "rule_id", "rule_name", "severity", F.col("location.line").alias("line"), "subject", "measure")


@query
def stream_new_findings(spark, sf):
    """The baseline diff on a stream: every event arrives once, known findings are dropped."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    known = baseline_of(event_findings(events).where(F.col("snapshot") == "s0"))
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    run = findings_stream(event_findings(stream), f"{base}/out", f"{base}/state", "warning", known)
    run.awaitTermination()
    return flat(spark.read.parquet(f"{base}/out"))


@query
def stream_unseen_findings(spark, sf):
    """Snapshots arrive one after the other, the stream is started anew for each: what an earlier one had is dropped."""
    found = event_findings(spark.read.parquet(f"{sf}/events.parquet"))
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    for snapshot in ("s0", "s1", "s2", "s3"):
        found.where(F.col("snapshot") == snapshot).write.mode("append").parquet(f"{base}/in")
        arriving = spark.readStream.schema(found.schema).parquet(f"{base}/in")
        unseen_stream(arriving, f"{base}/out", f"{base}/state", "warning").awaitTermination()
    return flat(spark.read.parquet(f"{base}/out"))


@query
def corpus_compare_snapshots(spark, sf):
    """Notes that are new in the second snapshot of the corpus."""
    first = detect(facts(spark, sf), ["R08"])
    second = detect(facts(spark, sf, snapshot=2), ["R08"])
    new = FN.new_findings(second, baseline_of(first))
    return new.select("fid", F.col("location.line").alias("line"), "snippet")


@query
def review_by_rule(spark, sf):
    """All detectors over the corpus: findings per rule and severity."""
    return detect(facts(spark, sf)).groupBy("rule_id", "severity").agg(F.count("*").alias("n"))


QUERIES.update(odd.QUERIES)
