"""Rules over functions: R02 R03 R04 R05 R15 R16 R20."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coralint.functions.lexer import LANGUAGES, code_only
from coralint.functions.text import contains_any, count_any, quote_word
from coralint.operators.bundle import Facts
from coralint.operators.facts import JVMISH, TS, bare_controls, with_slices, with_text
from coralint.operators.hits import hits
from coralint.operators.sweep import count_within, enclosing_all, nesting_at


# ---------------------------------------------------------------- R02


def long_functions(facts: Facts, limit: int = 50) -> DataFrame:
    rows = facts.function_spans.where(F.col("n_lines") > limit)
    return hits(rows, "R02", "lines", subject=F.col("name"), measure=F.col("n_lines"), limit=limit)


def many_params(facts: Facts, limit: int = 5) -> DataFrame:
    counted = facts.params.groupBy("fid", "fn_off").agg(F.count("*").alias("n_params")).where(F.col("n_params") > limit)
    rows = facts.function_spans.select("fid", "off", "row", "col", "name").join(
        counted.withColumnRenamed("fn_off", "off"), ["fid", "off"]
    )
    return hits(rows, "R02", "params", subject=F.col("name"), measure=F.col("n_params"), limit=limit)


def _block_weights(facts: Facts) -> DataFrame:
    """Nesting weight of each block statement: its own node kind plus the block inside it.

    Which kinds count differs by language; a run of ``else if`` nests one level
    deeper with each link.
    """
    plain = facts.function_spans.where(F.col("kind") != "arrow_function").select("fid", "level", "sid")
    head, lang = F.col("head"), F.col("language")
    is_else = head.rlike(r"^else\b")
    before_brace = F.get("sibs", F.size("sibs") - 3)["text"]
    type_body = head.rlike(
        r"\b(?:struct|enum|impl|trait|mod|union|use|extern|macro_rules!|class|interface|namespace|record)\b"
    )
    literal = before_brace.rlike(r"(?:^|[\s=(&*,:<])(?:\w+::)*[A-Z]\w*(?:::)?(?:<.*>)?$") & ~head.rlike(
        r"\b(?:if|for|while|match)\b"
    )

    def own(w: int, chained: bool = False, counted: bool = False) -> Column:
        """A weight, and whether the links of a chain or a counted loop add to it."""
        return F.struct(F.lit(w).alias("w"), F.lit(chained).alias("chained"), F.lit(counted).alias("counting"))

    rust = (
        F.when(type_body | before_brace.rlike(r"\w!$"), own(0))
        .when(head.rlike(r"\bmatch\b"), own(1))
        .when(is_else | head.rlike(r"\bif\b"), own(2, chained=True))
        .when(head.rlike(r"\bloop \{"), own(2))
        .when(F.coalesce(literal, F.lit(False)), own(0))
        .otherwise(own(1))
    )
    python = F.when(head.rlike(r"^(?:class|match|case)\b"), own(1)).otherwise(own(2))
    ts = (
        F.when(is_else | head.rlike(r"^if \("), own(1, chained=True))
        .when(head.rlike(r"^for\b"), own(0, counted=True))
        .when(head.rlike(r"^(?:while|switch|with) \("), own(1))
        .when(head.rlike(r"^(?:try|finally) \{"), own(1))
        .when(head.rlike(r"^catch\b"), own(2))
        .otherwise(own(0))
    )
    bare = head.rlike(r"^\{ \}$|^(?:static|get|set|init|add|remove|unsafe|checked|unchecked|fixed \( \)) \{|(?:=>|->) \{ \}$")
    jvm = (
        F.when(is_else | head.rlike(r"^if \("), own(2, chained=True))
        .when(head.rlike(r"^for \("), F.when(lang == "csharp", own(2)).otherwise(own(1, counted=True)))
        .when(head.rlike(r"^while \("), own(2))
        .when(head.rlike(r"^(?:foreach|using|lock|synchronized) \(|^do \{"), own(1))
        .when(head.rlike(r"^try \{|^finally \{"), own(2))
        .when(head.rlike(r"^try \("), own(1))
        .when(head.rlike(r"^catch\b"), own(3))
        .when(head.rlike(r"^switch \("), F.when(lang == "csharp", own(1)).otherwise(own(0)))
        .otherwise(F.when(bare & ~type_body, own(1)).otherwise(own(0)))
    )
    weight = F.when(lang == "rust", rust).when(lang == "python", python).when(lang.isin(TS), ts).otherwise(jvm)
    # Siblings and heads stay where they are stored: only their weight goes through the joins.
    blk = facts.unstored("blocks").select(
        "fid", "level", "sid", "off", "end_off", is_else.alias("is_else"), head.rlike(r"^else if\b").alias("is_link"), weight.alias("own")
    )
    blk = blk.join(plain, ["fid", "level", "sid"], "left_anti")
    order = W.partitionBy("fid", "level").orderBy("sid")
    run = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    blk = blk.withColumn("links", F.sum(F.when(F.col("is_link"), 1).otherwise(0)).over(run))
    blk = blk.withColumn(
        "chain",
        F.col("links") - F.coalesce(F.last(F.when(~F.col("is_else"), F.col("links")), ignorenulls=True).over(run), F.lit(0)),
    )
    # A counted loop has semicolons between its brackets; an iterating one has none.
    counted = facts.unstored("loops").where((F.col("kind") == "for") & F.col("body").rlike(r"^for\s*\([^)]*;")).select(
        "fid", "off", F.lit(1).alias("counted")
    )
    blk = blk.join(counted, ["fid", "off"], "left").withColumn("counted", F.coalesce("counted", F.lit(0)))
    total = F.col("own.w") + F.when(F.col("own.chained"), F.col("chain")).when(F.col("own.counting"), F.col("counted")).otherwise(0)
    braced = blk.select("fid", "off", "end_off", total.cast("int").alias("w"))
    return braced.unionByName(_bare_weights(facts)).where(F.col("w") > 0)


def _bare_weights(facts: Facts) -> DataFrame:
    """Nesting weight of controls without braces: their own kind only, there is no block."""
    rows = with_slices(bare_controls(facts.statements), facts.files, {"between": ("from", "to")})
    counted = F.col("between").contains(";") | (F.col("language") == "csharp")
    weight = F.when(F.col("word").isin("if", "while"), 1).when((F.col("word") == "for") & counted, 1)
    weight = weight.when((F.col("word") == "with") & F.col("language").isin(TS), 1).otherwise(0)
    return rows.select("fid", "off", "end_off", weight.cast("int").alias("w"))


def deep_nesting(facts: Facts, limit: int = 4) -> DataFrame:
    fns = facts.function_spans.select(
        "fid",
        "off",
        "end_off",
        F.when(F.col("language").isin(TS) | (F.col("language").isin("java") & (F.col("kind") == "constructor_declaration")), 0)
        .otherwise(1)
        .alias("w"),
        F.struct("end_off", "row", "col", "name").alias("fn"),
    )
    spans = _block_weights(facts).unionByName(fns, allowMissingColumns=True)
    edges = spans.select(
        "fid",
        F.inline(
            F.array(
                F.struct(F.col("off").alias("at"), F.lit(1).alias("ord"), (-F.col("end_off")).alias("tie"), F.col("w").alias("d")),
                F.struct(F.col("end_off").alias("at"), F.lit(0).alias("ord"), F.lit(0).alias("tie"), (-F.col("w")).alias("d")),
            )
        ),
        "fn",
    )
    run = W.partitionBy("fid").orderBy("at", "ord", "tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    opened = edges.withColumn("v", F.sum("d").over(run)).where(F.col("ord") == 1)
    fn_spans = opened.where("fn IS NOT NULL").select("fid", F.col("at").alias("off"), "fn.*", (F.col("v") - F.col("d")).alias("base"))
    points = opened.select("fid", F.col("at").alias("off"), "v")
    inside = enclosing_all(points, fn_spans, ["off", "row", "col", "name", "base"])
    deepest = (
        inside.groupBy("fid", F.col("span.off").alias("off"))
        .agg(
            F.max(F.col("v") - F.col("span.base")).alias("depth"),
            F.first("span.row").alias("row"),
            F.first("span.col").alias("col"),
            F.first("span.name").alias("name"),
        )
        .where(F.col("depth") > limit)
    )
    return hits(deepest, "R02", "nesting", subject=F.col("name"), measure=F.col("depth"), limit=limit)


def detect_r02(facts: Facts, max_lines: int = 50, max_parameters: int = 5, max_depth: int = 4) -> DataFrame:
    return (
        long_functions(facts, max_lines)
        .unionByName(many_params(facts, max_parameters))
        .unionByName(deep_nesting(facts, max_depth))
    )


# ---------------------------------------------------------------- R03

_RUST_ITEM = r"^(?:#!? \[ \] )*pub\b(?: \( \))?\s*(?:(?:async|unsafe|const|extern(?: \"\")?|default)\s+)*?(fn|struct|enum|trait|const|static|type)\b"
_BODILESS = (
    r"^(?:\[ \] |@[\w.]+ (?:\( \) )?)*+(?:[\w<>,.?&]++ (?!\( )|\[ \] )++\w+(?:<[^()]*>)? \( \)(?: (?:throws|where)[^={}]*)? ;$"
)
_CLASS = r"^(?:\[ \] |@[\w.]+ (?:\( \) )?)*+(?:[a-z]+ )*?(?:export (?:default )?)?class\s+\w+"


def detect_r03(facts: Facts, docstrings: bool = False) -> DataFrame:
    """Public items without documentation comment.

    Python items are always reported, because only comments before the item
    count; ``docstrings=True`` accepts a docstring instead.
    """
    head = F.col("head")
    fns, stm = facts.functions, facts.statements

    def documented(doc_off: Column) -> Column:
        return F.coalesce(doc_off >= F.col("prev_end"), F.lit(False))

    lang = F.col("language")
    item = F.when(lang == "rust", F.regexp_extract(head, _RUST_ITEM, 1)).otherwise(
        F.when(lang.isin(JVMISH) & head.rlike(r"\bpublic\b") & head.rlike(_BODILESS), "method").otherwise("")
    )
    at = F.array_position(F.transform("sibs", lambda s: s["text"].rlike(r"^pub\b")), True).cast("int")
    spot = F.get("sibs", F.when(lang == "rust", at - 1).otherwise(0))
    declared = (
        stm.withColumn("kind", item)
        .where((F.col("kind") != "") & ((F.col("kind") != "fn") | F.col("braced")))
        .withColumn("spot", spot)
        .where(~documented(F.col("spot.doc_off")))
        .select(
            "fid",
            F.when(F.col("kind").isin("fn", "method"), "function").otherwise(F.col("kind")).alias("kind"),
            "spot.row",
            "spot.col",
            "spot.off",
        )
    )
    python_items = facts.blocks.where((F.col("language") == "python") & (F.col("col") == 0)).where(
        head.rlike(r"^(?:async\s+)?def\s|^class\b")
    )
    if docstrings:
        first_in = with_text(python_items.select("fid", "off", "end_off", "head", "row", "col"), facts.files)
        python_items = first_in.where(~F.col("body").rlike(r"^[^\n]*(?:\n[^\n]*)*?:\s*(?:#[^\n]*)?\n\s*[rRuU]?(?:\"\"\"|''')"))
    python = python_items.select("fid", F.when(head.rlike(r"^class"), "class").otherwise("function").alias("kind"), "row", "col", "off")
    # Script functions count as public when their own text mentions export.
    public = F.when(
        lang.isin(TS), F.col("kind").isin("function_declaration", "method_definition") & F.col("body").contains("export")
    ).when(lang.isin(JVMISH), (F.col("kind") == "method_declaration") & F.col("body").contains("public"))
    methods = fns.where(
        F.coalesce(public, F.lit(False)) & ~(documented(F.col("doc_off")) & ~(lang.isin(TS) & F.col("exported")))
    ).select("fid", F.lit("function").alias("kind"), "row", "col", "off")
    lead = F.when(F.col("language").isin(TS), F.octet_length(F.regexp_extract(F.get("sibs", 0)["text"], r"^(export\s+(?:default\s+)?)?", 1))).otherwise(0)
    class_rows = facts.blocks.where(F.col("language").isin(*TS, *JVMISH) & head.rlike(_CLASS) & ~(F.col("language").isin(TS) & head.rlike(r"\babstract\b")))
    class_rows = class_rows.select(
        "fid", "language", (F.col("off") + lead).alias("off"), "end_off", "row", (F.col("col") + lead).alias("col"),
        (documented(F.get("sibs", 0)["doc_off"]) & (lead == 0)).alias("has_doc"),
    )
    word = F.when(F.col("language").isin(TS), "export").otherwise("public")
    classes = with_text(class_rows.where(~F.col("has_doc")), facts.files).where(F.contains("body", word)).select(
        "fid", F.lit("class").alias("kind"), "row", "col", "off"
    )
    rows = declared.unionByName(python).unionByName(methods).unionByName(classes)
    return hits(rows, "R03", subject=F.col("kind"))


# ---------------------------------------------------------------- tests: R04 R05 R16

# Assertion fragments per language.
ASSERTIONS = {
    "rust": ["assert!", "assert_eq!", "assert_ne!", "panic!"],
    "python": ["assert ", "self.assert"],
    "csharp": ["Assert."],
    "java": ["assertEquals", "assertTrue", "assertFalse", "assertThrows"],
}
_TEST_ATTRIBUTES = ["#[test]", "#[tokio::test]"]
_TEST_MARKS = ["@Test", "[Test]", "[TestMethod]"]


def _is_test_function(ts_names: Column | None = None) -> Column:
    lang = F.col("language")
    return (
        F.when(lang == "rust", contains_any(F.col("attributes"), _TEST_ATTRIBUTES))
        .when(lang == "python", F.col("name").startswith("test_"))
        .when(lang.isin(TS), F.lit(False) if ts_names is None else ts_names)
        .otherwise((F.col("kind") == "method_declaration") & contains_any(F.col("body"), _TEST_MARKS))
    )


def detect_r04(facts: Facts, limit: int = 1) -> DataFrame:
    lang, body = F.col("language"), F.col("body")
    n = (
        F.when(lang == "rust", count_any(body, ASSERTIONS["rust"]))
        .when(lang == "python", count_any(body, ASSERTIONS["python"]))
        .when(lang == "csharp", count_any(body, ASSERTIONS["csharp"]))
        .otherwise(count_any(body, ASSERTIONS["java"]))
    )
    plain = (
        facts.among([x for x in LANGUAGES if x not in TS]).functions.where(~lang.isin(TS) & _is_test_function())
        .select("fid", "row", "col", "off", "name", n.alias("n"))
    )
    ts_calls = facts.among(TS, ["test", "it"]).calls.where(lang.isin(TS))
    tests = ts_calls.where(F.regexp_extract("tail", r"^([\w$]+)", 1).isin("test", "it"))
    asserts = ts_calls.where(F.col("plain") & F.col("name").isin("expect", "assert"))
    counted = count_within(tests, asserts, "n")
    ts = tests.select("fid", "off", "end_off", "row", "col", F.regexp_extract("tail", r"^([\w$]+)", 1).alias("name")).join(
        counted, ["fid", "off", "end_off"]
    ).select("fid", "row", "col", "off", "name", "n")
    rows = plain.unionByName(ts).where(F.col("n") < limit)
    return hits(rows, "R04", subject=F.col("name"), measure=F.col("n"), limit=limit)


# Fragments of an integration test's name, of a test that talks to a service, and of a check on content.
NAME_FRAGMENTS = ["integration", "e2e", "end_to_end"]
HTTP_FRAGMENTS = ["request", "response", "client", "get(", "post(", "Client::new", "TestClient", "http", "api"]
DEEP_FRAGMENTS = [
    "json(", "body", "header", "content", "contains", "eq(", "assert_eq!", "assert_ne!", "expect(", "body(",
    "text()", "json_body", "response.body", "data[", "result[",
]


def detect_r05(facts: Facts, limit: int = 3) -> DataFrame:
    name, body = F.col("name"), F.col("body")
    named = contains_any(name, NAME_FRAGMENTS) | name.startswith("test_")
    kinds = ["function_item", "function_definition", "function_declaration", "method_declaration"]
    cols = ["fid", "row", "col", "off", "name", "body"]
    needed = [[*NAME_FRAGMENTS, "test_"], HTTP_FRAGMENTS]
    fns = facts.among(LANGUAGES, *needed).functions_where(F.col("kind").isin(kinds) & named).select(*cols)
    scripts = facts.among(TS, *needed)
    ts_calls = scripts.calls.where(F.col("language").isin(TS) & F.col("plain") & named)
    calls = with_text(ts_calls.select("fid", "off", "end_off", "row", "col", "name"), scripts.files).select(*cols)
    rows = (
        fns.unionByName(calls)
        .where(contains_any(body, HTTP_FRAGMENTS))
        .withColumn("n", count_any(body, DEEP_FRAGMENTS) + 1)
        .where(F.col("n") < limit)
    )
    return hits(rows, "R05", subject=F.col("name"), measure=F.col("n"), limit=limit)


# Name fragments that say what behaviour a test expects.
BEHAVIOUR_FRAGMENTS = [
    "_when", "_if", "_given", "_should", "_with", "_for", "_on_", "_returns", "_throws", "_fails", "_succeeds",
    "_is", "_has", "_finds", "_skips", "_does", "_not_", "_flagged", "_count", "_all", "_multiple", "_errors",
    "when", "should", "given", "if_",
]


def _r16_tests(facts: Facts) -> DataFrame:
    ts_name = F.col("name").startswith("test") | F.col("name").startswith("it_") | (F.col("name") == "it")
    kinds = ["function_item", "function_definition", "function_declaration", "method_definition", "method_declaration"]
    vague = F.lower("name").startswith("test") & ~contains_any(F.lower("name"), BEHAVIOUR_FRAGMENTS)
    return facts.functions.where(F.col("kind").isin(kinds) & _is_test_function(ts_name)).withColumn("vague", vague)


def vague_test_names(facts: Facts) -> DataFrame:
    return hits(_r16_tests(facts).where("vague"), "R16", "vague_name", subject=F.col("name"))


def private_access_tests(facts: Facts) -> DataFrame:
    facts = facts.among(LANGUAGES, ["self", "this"], ["._"])
    touched = F.regexp_extract_all(
        code_only(F.col("body"), F.col("language")), F.lit(r"(?<![\w.])(?:self|this)\._(\w+)"), F.lit(1)
    )
    rows = _r16_tests(facts).where(~F.col("vague")).withColumn("members", touched).where(F.size("members") > 0)
    return hits(rows, "R16", "private_access", subject=F.element_at("members", -1))


def detect_r16(facts: Facts) -> DataFrame:
    return vague_test_names(facts).unionByName(private_access_tests(facts))


# ---------------------------------------------------------------- R15

# Fragments of request handlers and of input guards.
HANDLER_FRAGMENTS = [
    "@app.route", "@app.get", "@app.post", "@app.put", "@app.delete", "@router.", "@Get", "@Post", "@Put", "@Delete",
    "@RequestMapping", "[HttpGet", "[HttpPost", "[Route", "@GetMapping", "@PostMapping", "req.", "request.", "req:",
    "request:", "handler", "Handler",
]
GUARD_FRAGMENTS = [
    "is_empty()", "!is_empty", ".is_empty", "len() == 0", "len() >", "len() <", "is_none()", "is_some()", "is_ok()",
    "is_err()", "is_empty", "len(x) ==", "len(x) >", "if not ", "if len(", ".length ==", ".length >", ".length <",
    ".length === 0", "isNullOr", "isUndefined", "isNil", "if (!", "if (x ==", "isNullOrEmpty", "isNullOrWhiteSpace",
]


def detect_r15(facts: Facts) -> DataFrame:
    lang, body = F.col("language"), F.col("body")
    kinds = ["function_item", "function_definition", "function_declaration", "method_definition", "method_declaration"]
    # `pub fn` is looked up in the function's own text.
    boundary = (
        ((lang == "rust") & body.contains("pub fn"))
        | ((lang == "python") & (F.col("col") == 0))
        | contains_any(body, HANDLER_FRAGMENTS)
    )
    fns = facts.functions.where(F.col("kind").isin(kinds) & boundary & ~contains_any(body, GUARD_FRAGMENTS)).select(
        "fid", "language", "off", "row", "col", "name", "body"
    )
    names = facts.params.groupBy("fid", F.col("fn_off").alias("off")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("params")
    )
    rows = fns.withColumnRenamed("name", "fn_name").join(names, ["fid", "off"])

    def danger(p: Column) -> Column:
        n = p["name"]
        forms = [F.concat(n, F.lit(".len()")), F.concat(n, F.lit(".length")), F.concat(F.lit("len("), n, F.lit(")"))]
        divided = F.lit(False)
        for form in forms:
            divided = divided | F.contains(body, F.concat(F.lit("/ "), form)) | F.contains(body, F.concat(F.lit("/"), form))
        inner = F.regexp_extract_all(body, F.concat(F.lit(r"(?<![\w.])"), quote_word(n), F.lit(r"\[([^\]]*)")), F.lit(1))
        moving = F.exists(inner, lambda i: (F.trim(i) != "") & ~F.trim(i).rlike(r"^[-+]?[0-9]+$"))
        indexed = F.contains(body, F.concat(n, F.lit("["))) & moving
        return F.struct(n.alias("name"), F.when(divided, "division").when(indexed, "index").alias("op"))

    found = F.filter(F.transform("params", danger), lambda d: d["op"].isNotNull())
    rows = rows.withColumn("found", F.get(found, 0)).where(F.col("found").isNotNull())
    return hits(rows, "R15", F.col("found.op"), subject=F.col("found.name"))


# ---------------------------------------------------------------- R20


def python_leaks(facts: Facts) -> DataFrame:
    facts = facts.among(["python"], ["open(", ".connect("])
    body = F.col("body")
    opening = facts.functions.where(
        (F.col("language") == "python") & contains_any(body, ["open(", ".connect("]) & ~body.contains(".close()")
    ).select("fid", "off", "end_off", "row", "col", "name")
    withs = facts.blocks.where((F.col("language") == "python") & F.col("head").rlike(r"^(?:async\s+)?with\b")).select(
        "fid", "off", "end_off"
    )
    inside = count_within(opening, withs, "withs")
    around = nesting_at(opening, withs)
    rows = around.join(inside, ["fid", "off", "end_off"]).where((F.col("nesting") == 0) & (F.col("withs") == 0))
    return hits(rows, "R20", "unclosed", subject=F.col("name"))


def listener_leaks(facts: Facts) -> DataFrame:
    facts = facts.among(TS, ["addEventListener(", ".on("])
    body = F.col("body")
    rows = facts.loops.where(
        F.col("language").isin(TS)
        & contains_any(body, ["addEventListener(", ".on("])
        & ~contains_any(body, ["removeEventListener(", ".off("])
    )
    return hits(rows, "R20", "listener")


def detect_r20(facts: Facts) -> DataFrame:
    return python_leaks(facts).unionByName(listener_leaks(facts))
