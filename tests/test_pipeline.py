"""Scan, configuration, findings operators, reports, streaming and the extension point."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from coralint import Config, Facts, RuleSpec, detect, list_rules, register_detector, review, rule_scope, scan, scan_table
from coralint.operators.hits import hits
from coralint.plans import findings as P
from coralint.plans.review import select_rules, unregister_detector
from coralint.sinks import reports
from coralint.sources.baseline import baseline_of, load_baseline
from coralint.sources.corpus import exclude_by_ignore, scan_binary
from coralint.streaming.stream import review_stream, unseen_stream


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("a tree")
    files = {
        "src/__init__.py": b"x = 1  # todo\n",
        "src/combine.rs": b"// todo\n",
        "node_modules/a.ts": b"// todo\n",
        "src/gen/b.py": b"# todo\n",
        "src/c.tmp.py": b"# todo\n",
        "src/sub/keep.py": b"# fine\n",
        "src/bad.java": b"\xff\xfe",
        "readme.md": b"todo",
        ".gitignore": b"# c\n/gen/\n!x\n*.tmp.py\na/b\n",
        "legacy/d.cs": b"// todo\n",
    }
    for name, data in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    return str(root)


def test_scan_directory(spark, tree):
    files, status = scan(spark, tree, exclude=["legacy/"])
    assert sorted(r.path for r in files.collect()) == ["src/__init__.py", "src/combine.rs", "src/sub/keep.py"]
    skipped = {r.path: r.error for r in status.where("status = 'skipped'").collect()}
    assert list(skipped) == ["src/bad.java"] and "UTF-8" in skipped["src/bad.java"]


def test_scan_then_review_with_all_rules(spark, tree):
    files, status = scan(spark, tree, exclude=["legacy/"])
    found = review(files)
    assert sorted((r.rule_id, r.location.file) for r in found.collect()) == [("R08", "src/__init__.py"), ("R08", "src/combine.rs")]
    assert P.summary(found, status).first().asDict() == {"errors": 0, "warnings": 0, "infos": 2, "files": 3, "skipped": 1}


def test_scan_file_bypasses_exclusion(spark, tree):
    files, _ = scan(spark, f"{tree}/node_modules/a.ts")
    assert [r.path for r in files.collect()] == ["a.ts"]
    files, status = scan(spark, f"{tree}/readme.md")
    assert files.count() == 0 and status.first().error == "unsupported file extension: md"


def test_scan_missing_path(spark, tree):
    with pytest.raises(FileNotFoundError, match="path not found"):
        scan(spark, f"{tree}/none")


def test_scan_binary_and_table(spark, tree):
    files, _ = scan_binary(spark, tree, exclude=["legacy"])
    assert sorted(r.path for r in files.collect()) == ["src/c.tmp.py", "src/combine.rs", "src/gen/b.py", "src/sub/keep.py"]
    table = spark.createDataFrame([("a/b.rs", "x"), ("out/b.rs", "x"), ("a/b.txt", "x")], "path string, text string")
    files, status = scan_table(table)
    assert [r.path for r in files.collect()] == ["a/b.rs"] and status.count() == 1


def test_config_defaults():
    c = Config.from_dict({"rules": {"R02": {"thresholds": {"max_parameters": 7, "max_nesting_depth": "x"}}, "R03": {"enabled": False}}})
    assert c.enabled("R02") and c.enabled("R99") and not c.enabled("R03")
    rule = {r.rule_id: r for r in select_rules(None)}["R02"]
    assert (c.threshold(rule, "max_parameters"), c.threshold(rule, "max_nesting_depth")) == (7, 4)


def test_toml_config(tmp_path):
    p = tmp_path / "c.toml"
    p.write_text('[global]\nexclude = ["x"]\n[rules.R08]\nenabled = false\n')
    c = Config.from_toml(str(p))
    assert c.exclude == ["x"] and not c.enabled("R08")


def test_rule_selection(spark, corpus):
    with pytest.raises(ValueError, match="R98, R99"):
        select_rules(["R01", "R98", "R99"])
    assert list_rules(spark).count() == 19
    scope = rule_scope(corpus([("a.cs", "x")]), config=Config.from_dict({"rules": {"R08": {"exclude_files": ["A.C"]}}}))
    ids = {r.rule_id for r in scope.collect()}
    assert "R07" not in ids and "R08" not in ids and "R09" in ids and len(ids) == 13


def test_thresholds_and_file_exclusion(spark, corpus):
    files = corpus([("a.py", "# a = f(1)\n# b = f(2)\n"), ("skip_me.py", "# a = f(1)\n# b = f(2)\n")])
    config = {"rules": {"R09": {"thresholds": {"min_block_lines": 2}, "exclude_files": ["SKIP"]}}}
    assert [r.location.file for r in review(files, ["R09"], config).collect()] == ["a.py"]
    own = Config.from_dict({"rules": {"R08": {"severity": "error"}}})
    todo = corpus([("a.py", "# todo\n")])
    assert review(todo, ["R08"], own).first().severity == "info"
    own.apply_severity = True
    assert review(todo, ["R08"], own).first().severity == "error"


ROWS = [
    ("R01", "error", "b/x.rs", 5), ("R01", "error", "b/x.rs", 2), ("R01", "error", "a/x.rs", 9), ("R07", "warning", "b/y.rs", 1),
    ("R07", "info", "b/y.rs", 1), ("R08", "info", "a.rs", 1), ("R08", "info", "a/b.rs", 1),
]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame(ROWS, "rule_id string, severity string, file string, line int")
    return df.select(
        "rule_id",
        F.concat(F.lit("name-"), "rule_id").alias("rule_name"),
        "severity",
        P.sev_rank(F.col("severity")).alias("sev_rank"),
        F.struct("file", "line", F.lit(1).alias("column")).alias("location"),
        F.lit("m").alias("message"),
        F.lit(" s ").alias("snippet"),
    )


@pytest.fixture(scope="module")
def status(spark):
    return spark.createDataFrame([(1, "a", "scanned", None), (2, "b", "skipped", "why")], "fid int, path string, status string, error string")


def test_sort_and_rank(found):
    order = [(r.severity, r.location.file, r.location.line) for r in P.sort_findings(found).collect()]
    assert order == [
        ("info", "a/b.rs", 1), ("info", "a.rs", 1), ("info", "b/y.rs", 1), ("warning", "b/y.rs", 1),
        ("error", "a/x.rs", 9), ("error", "b/x.rs", 2), ("error", "b/x.rs", 5),
    ]
    ranked = {r.rank: (r.severity, r.location.file, r.location.line) for r in P.rank_findings(found).collect()}
    assert [ranked[i + 1] for i in range(len(order))] == order
    assert P.sort_findings(found, "error_first").first().severity == "error"
    with pytest.raises(ValueError):
        P.sort_findings(found, "other")


def test_severity_filter(found):
    assert P.filter_severity(found, "ERROR").count() == 3
    assert P.filter_severity(found, "info").count() == len(ROWS)
    with pytest.raises(ValueError):
        P.filter_severity(found, "fatal")


def test_diff_against_itself_and_others(found):
    assert P.new_findings(found, baseline_of(found)).count() == 0
    known = baseline_of(found.where("location.line = 1"))
    assert P.new_findings(found, known).count() == 3
    assert P.baseline_stats(found, known).first().asDict() == {"total": 7, "new": 3, "known": 4}
    by_text = found.select(F.col("location.file").alias("file"), "rule_id", "snippet")
    assert P.new_findings(found, by_text, key=("file", "rule_id", "snippet")).count() == 0


def test_summary_gate_and_groups(found, status):
    assert P.summary(found, status).first().asDict() == {"errors": 3, "warnings": 1, "infos": 3, "files": 1, "skipped": 1}
    assert P.gate(found).first().failed and not P.gate(found.where("severity <> 'error'")).first().failed
    assert not P.gate(found.limit(0)).first().failed
    assert [(r.rule_id, r.n) for r in P.group_by_rule(found).orderBy("seen").collect()] == [("R08", 2), ("R07", 2), ("R01", 3)]
    tops = P.top_files(found, 1).orderBy("rule_id").collect()
    assert [(r.rule_id, r.file, r.n) for r in tops] == [("R01", "x.rs", 3), ("R07", "y.rs", 2), ("R08", "b.rs", 1)]
    first = P.examples(found, 1).where("rule_id = 'R01'").first()
    assert (first.file, first.line, first.snippet) == ("a/x.rs", 9, "s")
    errors, others = P.split_by_severity(found)
    assert (errors.count(), others.count()) == (3, 4)


def test_top_files_limits_groups_before_the_shuffle(found):
    plan = P.top_files(found)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_reports(found, status, tmp_path, spark):
    lines = reports.json_lines(found, status).orderBy("part", "ord").collect()
    doc = json.loads("\n".join(r.value for r in lines))
    assert doc["summary"] == {"errors": 3, "warnings": 1, "infos": 3, "files": 1, "skipped": 1}
    assert len(doc["findings"]) == 7 and doc["parse_errors"] == [{"file": "b", "error": "why"}]
    one = str(tmp_path / "one")
    reports.write_report(found, status, one, "json")
    assert P.new_findings(found, load_baseline(spark, one)).count() == 0
    assert P.new_findings(found, load_baseline(spark, one, "report")).count() == 0
    key = ("file", "rule_id", "snippet")
    assert P.new_findings(found, load_baseline(spark, one, "report", key), key).count() == 0
    assert P.new_findings(found, baseline_of(found, key), key).count() == 0
    split = str(tmp_path / "split")  # the same document in several files
    reports.json_lines(found, status).repartitionByRange(4, "part", "ord").sortWithinPartitions("part", "ord").select("value").write.text(split)
    assert load_baseline(spark, split, "report").count() == load_baseline(spark, one).count()
    none = found.limit(0)
    assert json.loads("".join(r.value for r in reports.json_lines(none, status.limit(0)).orderBy("part", "ord").collect()))["findings"] == []
    many = str(tmp_path / "lines")
    reports.write_json_lines(found, many)
    assert P.new_findings(found, load_baseline(spark, many, "lines")).count() == 0
    reports.write_report(found, status, str(tmp_path / "md"), "md", "src")
    md = [r.value for r in spark.read.text(str(tmp_path / "md")).collect()]
    for line in ("# Review report", "| error | 3 |", "### R01 name-R01: 3", "- x.rs: 3", "- a/x.rs:9: s", "### R07 name-R07 (warning): 1", "- b: why"):
        assert line in md, line
    assert any(line.startswith("**Advice**") for line in md)
    reports.write_report(found, status, str(tmp_path / "txt"), "text")
    text = [r.value for r in spark.read.text(str(tmp_path / "txt")).collect()]
    assert "R01 error b/x.rs:5:1  m" in text and "7 findings (3 errors, 1 warnings, 3 infos) in 1 files, 1 skipped" in text
    with pytest.raises(ValueError):
        reports.write_report(found, status, str(tmp_path / "x"), "html")


def test_bad_baseline_is_an_error(spark, tmp_path):
    p = tmp_path / "bad.json"
    p.write_text('{"findings": [')
    with pytest.raises(Exception):
        load_baseline(spark, str(p)).collect()


def test_baseline_round_trip_of_a_review(spark, corpus, tmp_path):
    files = corpus([("a.py", "# todo\n"), ("b.rs", "// todo\n")])
    first = review(files, ["R08"])
    path = str(tmp_path / "base")
    reports.write_json_lines(first, path)
    more = corpus([("a.py", "# todo\n# fixme\n"), ("b.rs", "// todo\n")])
    new = review(more, ["R08"], baseline=load_baseline(spark, path, "lines")).collect()
    assert [(r.location.file, r.location.line) for r in new] == [("a.py", 2)]


def test_compare_runs(found):
    both = found.withColumn("snapshot", F.lit("1")).unionByName(found.where("severity <> 'error'").withColumn("snapshot", F.lit("2")))
    rows = P.compare_runs(both).orderBy("snapshot").collect()
    assert [(r.total, r.errors, r.total_change) for r in rows] == [(7, 3, None), (4, 0, -3)]


def test_own_detector(spark, corpus):
    spec = RuleSpec("X01", "long-line", "warning", ("python",))
    register_detector(spec, lambda facts, config: hits(
        facts.lines.where(F.length("line") > 5), "X01", measure=F.length("line"), col=F.lit(0), off=F.lit(0)))
    try:
        rows = detect(Facts(corpus([("a.py", "short\nmuch longer\n"), ("b.rs", "much longer\n")])), ["X01"]).collect()
        assert [(r.location.file, r.location.line, r.rule_name, r.snippet) for r in rows] == [("a.py", 2, "long-line", "much longer")]
        with pytest.raises(ValueError):
            register_detector(spec, None)
    finally:
        unregister_detector("X01")


def test_review_stream(spark, corpus, tmp_path):
    src = str(tmp_path / "in")
    corpus([("a.py", "# todo\n"), ("b.py", "x = 1\n# fixme\n")]).write.parquet(src)
    known = spark.createDataFrame([("a.py", 1, "R08")], "file string, line int, rule_id string")
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    q = review_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck"), rules=["R08"], baseline=known)
    q.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.location.file, r.location.line) for r in rows] == [("b.py", 2)]


def test_unseen_stream_learns_and_keeps_what_it_knew(spark, tmp_path):
    schema = "fid long, rule_id string, severity string, sev_rank int, location struct<file:string,line:int>, measure double, tags array<string>"
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def arrive(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(source)
        before = spark.read.schema(schema).parquet(out).count() if (tmp_path / "out").exists() else 0
        unseen_stream(spark.readStream.schema(schema).parquet(source), out, state, baseline=known).awaitTermination()
        return sorted(spark.read.schema(schema).parquet(out).collect(), key=lambda r: r.fid)[before:]

    known = spark.createDataFrame([("k.py", 1, "R08")], "file string, line int, rule_id string")
    big = 2**62 + 1
    first = arrive(
        (1, "R08", "info", 0, ("a.py", 1), 0.5, ["x", None]), (2, "R08", "info", 0, ("a.py", 1), None, None),
        (3, "R08", "info", 0, ("k.py", 1), None, None), (4, None, None, None, (None, None), None, None),
    )
    assert [(r.fid, r.location, r.measure, r.tags) for r in first] == [
        (1, ("a.py", 1), 0.5, ["x", None]), (2, ("a.py", 1), None, None), (4, (None, None), None, None)
    ]
    second = arrive(
        (5, "R08", "info", 0, ("a.py", 1), None, None), (6, None, None, None, (None, None), None, None), (big, "R08", "info", 0, ("a.py", 2), None, None)
    )
    assert [r.fid for r in second] == [big]
    assert arrive((7, "R08", "info", 0, ("a.py", 2), None, None)) == []


def test_repo_scope(spark, corpus):
    from coralint.operators.detectors.name_rules import missing_awaits, single_impl_traits

    facts = Facts(corpus([
        ("a.rs", "trait A {}\nimpl A for X {}\n"), ("b.rs", "impl A for Y {}\n"),
        ("c.py", "async def a():\n    pass\n"), ("d.py", "a()\n"),
    ]))
    assert single_impl_traits(facts, "file").count() == 1 and single_impl_traits(facts, "repo").count() == 0
    assert missing_awaits(facts, ["python"], "file").count() == 0
    assert [r.fid for r in missing_awaits(facts, ["python"], "repo").collect()] == [3]


def test_baseline_stats_agree_with_the_diff_on_null_keys(spark, found):
    odd = found.withColumn("rule_id", F.when(F.col("location.line") > 5, F.col("rule_id")))
    known = baseline_of(odd)
    assert P.new_findings(odd, known).count() == P.baseline_stats(odd, known).first().new == 0


def test_release_deletes_the_store(spark, corpus, tmp_path):
    files = corpus([("a.py", "# todo\n")])
    with Facts(files, store=str(tmp_path)) as facts:
        assert detect(facts, ["R08"]).count() == 1
        assert any(tmp_path.iterdir())
    assert not any(tmp_path.iterdir())


def test_scan_reads_every_file_once(spark, tmp_path):
    for name, data in {"a.py": b"x = 1\n", "__init__.py": b"", "sub/b.rs": b"fn f() {}\n", "sub/bad.ts": b"\xff\xfe"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    files, status = scan(spark, str(tmp_path))
    for f in [*tmp_path.rglob("*.*")]:
        f.unlink()
    assert {r.path: r.text for r in files.collect()} == {"a.py": "x = 1\n", "__init__.py": "", "sub/b.rs": "fn f() {}\n"}
    assert {r.path: r.status for r in status.collect()} == {"a.py": "scanned", "__init__.py": "scanned", "sub/b.rs": "scanned", "sub/bad.ts": "skipped"}
    assert "text" not in status._jdf.queryExecution().executedPlan().toString()


def test_reports_compute_their_findings_once(spark, tmp_path):
    log = str(tmp_path / "log")

    def noted(batches):
        for pdf in batches:
            with open(log, "a") as f:
                f.write("x" * len(pdf))
            yield pdf

    shape = "fid int, rule_id string, rule_name string, severity string, sev_rank tinyint, location struct<file:string,line:int,column:int>, message string, snippet string"
    rows = [(i, "R01", "n", ["error", "info"][i % 2], (i % 2) * 2, (f"d/f{i}.py", i, 1), "m", "s") for i in range(10)]
    plain = spark.createDataFrame(rows, shape)
    status = spark.createDataFrame([(1, "b", "skipped", "why")], "fid int, path string, status string, error string")
    for fmt in reports.FORMATS:
        flat = plain.select("fid", "rule_id", "rule_name", "severity", "sev_rank", F.to_json("location").alias("at"), "message", "snippet")
        once = flat.mapInPandas(noted, flat.schema).withColumn("location", F.from_json("at", "file string, line int, column int")).drop("at")
        reports.write_report(once, status, str(tmp_path / fmt), fmt)
    with open(log) as f:
        assert len(f.read()) == 10 * len(reports.FORMATS)
    left = os.listdir(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    assert not [name for name in left if name.startswith("report-rows-")]


@pytest.mark.parametrize("seed", range(4))
def test_ignore_rules_equal_a_walk_over_every_path(spark, seed):
    rng = random.Random(seed)
    names = ["a", "b", "c.x", "d.tmp", "skip"]
    paths = sorted({"/".join(rng.choices(names, k=rng.randrange(1, 6))) for _ in range(150)})
    rules = {("/".join(rng.choices(names, k=rng.randrange(0, 4))), rng.choice(["a", "skip", "*.tmp", "*.x", "b"])) for _ in range(8)}

    def fits(name, pattern):
        return name.endswith(pattern[1:]) if pattern.startswith("*") else name == pattern

    def ignored(path):
        parts = path.split("/")
        return any(
            fits(n, p)
            for d, p in rules
            for above in [d.split("/") if d else []]
            if parts[: len(above)] == above
            for n in parts[len(above) :]
        )

    files = spark.createDataFrame([(r, p) for p in paths for r in ("r", "other")], "repo string, path string")
    table = spark.createDataFrame([("r", d, p) for d, p in rules], "repo string, dir string, pattern string")
    got = {(r.repo, r.path) for r in exclude_by_ignore(files, table).collect()}
    assert got == {("other", p) for p in paths} | {("r", p) for p in paths if not ignored(p)}
    assert exclude_by_ignore(files.limit(0), table).count() == 0 and exclude_by_ignore(files, table.limit(0)).count() == 2 * len(paths)
