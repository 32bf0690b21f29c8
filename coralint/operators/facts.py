"""Fact tables over statements and tokens: blocks, functions, calls, imports and the rest.

Offsets are byte offsets into the file's text. All tables are keyed by ``fid``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coralint.functions.lexer import LITERAL_OR_COMMENT, by_language, code_only
from coralint.functions.text import strip_groups, utf8_slice

BRACES = ["rust", "typescript", "tsx", "csharp", "java"]
TS = ["typescript", "tsx"]
JVMISH = ["csharp", "java"]

_NOT_NAMES = (
    "if for foreach while do switch catch try else return new throw function synchronized using lock fixed "
    "checked unchecked unsafe await yield with match when sizeof typeof case super this base super"
).split()

_PY_COMPOUND = r"^(?:async\s+)?(?:def|class|if|elif|else|for|while|try|except|finally|with|match|case)\b.*:"


def python_blocks(stm: DataFrame) -> DataFrame:
    """Compound statements with the span of their indented block.

    The end of a block is the last statement before the next one indented no
    deeper. A statement after a deeper one closes every indent in between, so
    closing marks are matched with opening marks per ``(fid, indent)``.
    """
    top = stm.where((F.col("language") == "python") & (F.col("level") <= 0)).drop("braced")
    order = W.partitionBy("fid").orderBy("sid")
    top = top.select(
        "*",
        F.lag("col").over(order).alias("up_col"),
        F.lag("end_off").over(order).alias("up_end"),
        F.lag("row_end").over(order).alias("up_row"),
        F.max("end_off").over(W.partitionBy("fid")).alias("last_end"),
        F.max("row_end").over(W.partitionBy("fid")).alias("last_row"),
        F.col("head").rlike(_PY_COMPOUND).alias("compound"),
    )
    closing = F.transform(
        F.sequence("col", F.greatest("col", F.coalesce("up_col", "col"))),
        lambda k: F.struct(k.alias("indent"), F.lit(0).alias("opens")),
    )
    opening = F.when(
        F.col("compound"), F.array(F.struct(F.col("col").alias("indent"), F.lit(1).alias("opens")))
    ).otherwise(F.expr("cast(array() as array<struct<indent:int,opens:int>>)"))
    marks = top.select("*", F.inline(F.concat(closing, opening)))
    match = W.partitionBy("fid", "indent").orderBy("sid", "opens")
    marks = marks.select(
        "*",
        F.lead("up_end").over(match).alias("block_end"),
        F.lead("up_row").over(match).alias("block_row"),
    )
    return marks.where(F.col("opens") == 1).select(
        "fid",
        "language",
        "level",
        "sid",
        "sibs",
        "head",
        "off",
        F.coalesce("block_end", "last_end").alias("end_off"),
        "row",
        F.coalesce("block_row", "last_row").alias("row_end"),
        "col",
        "prev_end",
    )


def blocks(stm: DataFrame) -> DataFrame:
    """Statements that own a block, in every language: ``{ .. }`` or an indented suite."""
    braced = stm.where((F.col("language") != "python") & F.col("braced")).drop("braced")
    return braced.unionByName(python_blocks(stm))


def _index_of(cond) -> Column:
    """1-based index of the first sibling meeting the condition, 0 when none does."""
    return F.array_position(F.transform("sibs", cond), True).cast("int")


def _sib(i) -> Column:
    """Sibling at a 1-based index, NULL outside the array."""
    return F.get("sibs", i - 1)


def _bytes(c: Column) -> Column:
    return F.octet_length(c)


# Type words and array marks before a method name, then the name and its parameter list.
_JVM_HEAD = (
    r"^(?:\[ \] |@[\w.]+ (?:\( \) )?|@[\w.]+(?= ))*+"
    r"((?:[\w<>,.?&@]++ (?!\( )|[\w<>,.?&@]*+(?<=[<,]) \( \)\??+ |\( \)\??+ (?=[\w<>,@?])|\[ \] )*+)"
    r"(?:\w++(?:<[^()]*>)?\.)*+(\w+)(?:<[^()]*>)? \( \)"
    r"(?: (?:throws|where|:)[^={}]*)? (?:\{ \}|=> [^{}]*;)$"
)
_TS_METHOD = (
    r"^(?:, ?)?(?:@[\w.]+ (?:\( \) )?)*+(?:(?:public|private|protected|static|async|override|get|set|abstract)\s+|\* ?)*+"
    r"(#?[\w$]+)(?:<[^()]*>)? \( \)(?: ?:[^{}]*)? \{ \}$"
)
_TS_FUNCTION = r"^(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:async\s+)?function\s+([\w$]+)"
_MODIFIERS = r"^(?:(?:public|private|protected|internal|static|extern|unsafe|async|partial|final)\s*)*$"


def _function_rows(stm: DataFrame, blk: DataFrame) -> DataFrame:
    """Statements that define a named function, with their kind and name."""
    head = F.col("head")
    # Expression-bodied methods end with a semicolon and own no block.
    short = stm.where((F.col("language") == "csharp") & ~F.col("braced") & head.rlike(r"\( \) =>"))
    all_rows = blk.unionByName(short.select(*blk.columns))
    jvm_prefix = F.regexp_extract(head, _JVM_HEAD, 1)
    jvm_name = F.regexp_extract(head, _JVM_HEAD, 2)
    jvm_ok = (
        (jvm_name != "")
        & ~jvm_name.isin(_NOT_NAMES)
        & ~jvm_prefix.rlike(
            r"\b(?:new|return|throw|else|class|record|struct|interface|enum|await|yield|if|for|foreach|while|switch|catch|using"
            r"|lock|fixed|synchronized|when|try|do|case)\b"
        )
        & ~((jvm_prefix == "") & head.rlike(r"^\w+(?:<[^()]*>)?\.\w"))
    )
    ts_method = F.regexp_extract(head, _TS_METHOD, 1)
    ts_fn = F.regexp_extract(head, _TS_FUNCTION, 1)
    lang = F.col("language")
    n = F.size("sibs")
    named = all_rows.select(
        "*",
        F.when(lang == "rust", F.regexp_extract(head, r"\bfn\s+(\w+)", 1))
        .when(lang == "python", F.regexp_extract(head, r"^(?:async\s+)?def\s+(\w+)", 1))
        .when(lang.isin(TS), F.when(ts_fn != "", ts_fn).when(~ts_method.isin(_NOT_NAMES), ts_method).otherwise(""))
        .otherwise(F.when(jvm_ok, jvm_name).otherwise(""))
        .alias("name"),
        F.when(lang == "rust", "function_item")
        .when(lang == "python", "function_definition")
        .when(lang.isin(TS), F.when(ts_fn != "", "function_declaration").otherwise("method_definition"))
        .otherwise(F.when(jvm_prefix.rlike(_MODIFIERS), "constructor_declaration").otherwise("method_declaration"))
        .alias("kind"),
    ).where(F.col("name") != "")

    key = F.when(
        lang == "rust", _index_of(lambda s: (s["role"] == "code") & s["text"].rlike(r"\bfn\s"))
    ).otherwise(F.lit(1))
    rows = named.withColumn("key", key)
    # `pub(crate) fn` starts three siblings before the keyword.
    restricted = (lang == "rust") & (F.col("key") > 3) & (_sib(F.col("key") - 3)["text"] == "pub")
    rows = rows.withColumn("key", F.when(restricted, F.col("key") - 3).otherwise(F.col("key")))
    rows = rows.withColumn("restricted", F.coalesce(restricted, F.lit(False)))

    begin = _sib(F.col("key"))
    export_lead = _bytes(F.regexp_extract(begin["text"], r"^((?:export\s+(?:default\s+)?)?|,\s*)", 1))
    lead = F.when(lang.isin(TS), export_lead).otherwise(0)
    # Parameter list: the first round bracket after the name.
    after = F.when(F.col("restricted"), F.col("key") + 3).otherwise(F.col("key"))
    is_attr_call = lambda i: F.coalesce(_sib(i - 1)["text"].rlike(r"^@[\w.]+$"), F.lit(False))
    count = lambda t, c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))

    def angles(i: Column) -> Column:
        """Type argument lists that a piece of code opens more than it closes."""
        t = F.regexp_replace(_sib(i)["text"], "->|=>|[<>]=", "")
        return F.when(_sib(i)["role"] == "code", count(t, "<") - count(t, ">")).otherwise(0)

    # A C# or Java name stands right before its list; tuples in the return type do not.
    named_here = F.concat(F.lit(r"(?:^|\W)"), F.col("name"), F.lit(r"(?:<[^()]*>)?$"))

    def look(acc: Column, i: Column) -> Column:
        here = (acc["at"] == 0) & (i >= after) & (_sib(i)["text"] == "(") & (acc["open"] <= 0) & ~is_attr_call(i)
        here = here & (~lang.isin(JVMISH) | F.coalesce(F.regexp_like(_sib(i - 1)["text"], named_here), F.lit(False)))
        opened = acc["open"] + F.when(i >= after, angles(i)).otherwise(0)
        return F.struct(F.when(here, i).otherwise(acc["at"]).alias("at"), opened.cast("int").alias("open"))

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("open"))
    paren = F.aggregate(F.sequence(F.lit(1), n), start, look)["at"]
    rows = rows.withColumn("paren", paren)
    has_list = (F.col("paren") > 0) & (F.col("paren") < n)
    return rows.select(
        "fid",
        "language",
        "level",
        "sid",
        "kind",
        "name",
        (begin["off"] + lead).alias("off"),
        "end_off",
        begin["row"].alias("row"),
        "row_end",
        (begin["col"] + lead).alias("col"),
        F.col("off").alias("stmt_off"),
        "prev_end",
        begin["doc_off"].alias("doc_off"),
        (lead > 0).alias("exported"),
        F.when(has_list, _sib(F.col("paren"))["end_off"]).alias("params_from"),
        F.when(has_list, _sib(F.col("paren") + 1)["off"]).alias("params_to"),
        head.rlike(r"(?:^|\s)async\s+(?:def|function)\b|^async def").alias("is_async"),
    )


# What a brace opens, by the code before it and by the beginning of its statement.
_TYPE_BODY = r"\binterface\b|^(?:(?:export|declare)\s+)*type\s+[\w$]+"
_CLASS_BODY = r"\bclass\b"


# Control words with their bracket, from the beginning of a statement; else may lead.
_CONTROL_HEADS = r"^((?:(?:else )?(?:if|for|foreach|while|with|using|lock|synchronized)(?: await)? \( \) ?)+)"


def bare_controls(stm: DataFrame) -> DataFrame:
    """Controls whose body is one statement without braces, with the span that body makes them reach.

    A statement can begin with several heads, each owning the rest. A script statement that is only
    heads owns the next one. An ``else`` belongs to the last ``if``, so up to that ``if`` the heads reach
    to the end of its run: the statements up to the last ``else`` that follows without a break.
    """
    rows = stm.where(F.col("language").isin(*TS, *JVMISH))
    heads = F.regexp_extract("head", _CONTROL_HEADS, 1)
    rows = rows.select(
        "*",
        heads.alias("heads"),
        F.col("head").rlike(r"^else\b").alias("is_else"),
        ((heads != "") & (F.trim(heads) == F.trim("head")) | (F.col("head") == "else")).alias("bodyless"),
    )
    order = W.partitionBy("fid", "level").orderBy("sid")
    goes_on = F.col("is_else") | F.coalesce(F.lag("bodyless").over(order), F.lit(False))
    # The end of one bracket group and the beginning of the next are apart in offsets, not in numbers.
    rows = rows.withColumn("run", F.sum(F.when(goes_on, 0).otherwise(1)).over(order))
    run = W.partitionBy("fid", "level", "run")
    rows = rows.select(
        "*",
        F.max("end_off").over(run).alias("run_end"),
        F.first(F.when(~F.col("bodyless"), F.col("end_off")), ignorenulls=True)
        .over(run.orderBy("sid").rowsBetween(W.currentRow, W.unboundedFollowing))
        .alias("own_end"),
    )
    # A loop with an empty body is the end of a do statement as well as a loop; it holds nothing.
    rows = rows.where((F.col("heads") != "") & ~F.col("head").rlike(r"^while \( \) ;$"))
    rows = rows.withColumn("n", F.size(F.regexp_extract_all("heads", F.lit(r"\( \)"), F.lit(0))))
    rows = rows.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    word = F.regexp_extract(F.get("sibs", 3 * F.col("c"))["text"], r"(\w+)(?: await)?$", 1)
    ifs = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("sibs", 3 * i)["text"].rlike(r"\bif$"))
    last_if = F.col("n") - 1 - (F.array_position(F.reverse(ifs), True) - 1).cast("int")
    last_if = F.when(F.array_contains(ifs, True), last_if).otherwise(-1)
    lead = F.octet_length(F.regexp_extract(F.get("sibs", 3 * F.col("c"))["text"], r"^(else )", 1))
    # The first head of a statement with a block is a block statement of its own.
    return rows.where((F.col("c") > 0) | ~F.col("braced")).select(
        "fid",
        "language",
        word.alias("word"),
        (F.get("sibs", 3 * F.col("c"))["off"] + lead).alias("off"),
        F.when((F.col("c") <= last_if), F.col("run_end")).otherwise(F.coalesce("own_end", "run_end")).alias("end_off"),
        F.get("sibs", 3 * F.col("c") + 1)["end_off"].alias("from"),
        F.get("sibs", 3 * F.col("c") + 2)["off"].alias("to"),
    )


def with_group(rows: DataFrame, openings: DataFrame) -> DataFrame:
    """Rows ``(fid, level, tok, ..)`` of scripts with ``group``, what the bracket around them opens.

    ``group`` is ``class``, ``type``, ``list`` or ``other``. Each opening bracket is a mark on the level
    inside, in front of its content; the last mark seen on a level is the bracket around.
    """
    narrow = openings.where(F.col("language").isin(TS) & (F.col("role") == "open"))
    return _with_marks(rows, narrow.select("fid", "level", "tok", "text", "p_text", "opening"))


def _with_marks(rows: DataFrame, opened: DataFrame) -> DataFrame:
    opening, before, body = F.col("opening"), F.col("p_text"), F.col("text") == "{"
    kind = (
        F.when(body & F.coalesce(before.rlike(_CLASS_BODY) | opening.rlike(rf"^(?:(?:export|default|declare|abstract)\s+)*{_CLASS_BODY}"), F.lit(False)), "class")
        .when(body & F.coalesce(before.rlike(_TYPE_BODY) | opening.rlike(rf"^(?:(?:export|default|declare)\s+)*{_TYPE_BODY}"), F.lit(False)), "type")
        .when(F.col("text") == "(", "list")
        .otherwise("other")
    )
    packed = rows.select("fid", "level", "tok", F.lit(None).cast("string").alias("opens"), F.struct(*rows.columns).alias("r"))
    marks = opened.select("fid", (F.col("level") + 1).alias("level"), "tok", kind.alias("opens"), F.lit(None).cast(packed.schema["r"].dataType).alias("r"))
    upto = W.partitionBy("fid", "level").orderBy("tok").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = packed.unionByName(marks).withColumn("group", F.coalesce(F.last("opens", ignorenulls=True).over(upto), F.lit("other")))
    return found.where(F.col("r").isNotNull()).select("r.*", "group")


_ARROW_PIECE = r"=>|,|[^=,]+|[\s\S]"


def arrow_functions(stm: DataFrame) -> DataFrame:
    """Every arrow function of a script: one row for each ``=>`` that is not part of a type.

    The parameters are the name before the arrow or the round bracket before it and its result type. The
    body is the block behind the arrow, or all up to the next comma of the same level or the end of the
    statement, found by looking ahead to the next separator. All that an arrow needs stands in its own
    statement, but for the kind of the bracket around it.
    """
    stmt = W.partitionBy("fid", "level", "sid")
    seq = stmt.orderBy("tok")
    scripts = stm.where(F.col("language").isin(TS))
    rows = scripts.where(F.exists("sibs", lambda s: (s["role"] == "code") & s["text"].contains("=>")))
    rows = rows.select("fid", "language", "level", "sid", "prev_end", "sibs", F.posexplode("sibs").alias("at", "s"))
    near = lambda step, field: F.get("sibs", F.col("at") + step)[field]
    rows = rows.select(
        "fid",
        "language",
        "level",
        "sid",
        "s.*",
        "prev_end",
        F.when(F.col("s.role") == "open", near(1, "end_off")).alias("close_end"),
        near(-1, "role").alias("p_role"),
        near(-1, "text").alias("p_text"),
        near(1, "role").alias("n_role"),
        near(1, "text").alias("n_text"),
    )
    rows = rows.select(
        "*",
        *[F.lag(c, 2).over(seq).alias(f"o_{c}") for c in ("text", "off", "end_off", "row", "col", "doc_off", "p_text", "p_role")],
        F.lag("off").over(seq).alias("c_off"),
        F.first("off").over(seq).alias("stmt_off"),
        F.first("prev_end").over(seq).alias("first_end"),
        F.first("text").over(seq).alias("opening"),
        F.lead("close_end").over(seq).alias("block_end"),
        F.lead("row_end", 2).over(seq).alias("block_row"),
    )
    cut = F.when(F.col("role") == "code", F.regexp_extract_all("text", F.lit(_ARROW_PIECE), F.lit(0))).otherwise(F.array("text"))
    rows = rows.select("*", F.posexplode(cut).alias("i", "piece"))
    order = stmt.orderBy("tok", "i")
    within = W.partitionBy("fid", "level", "tok").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("past", F.coalesce(F.sum(F.char_length("piece")).over(within), F.lit(0)).cast("int"))
    rows = rows.withColumn("before", F.expr("left(text, past)"))
    at = F.col("off") + F.octet_length("before")
    end = F.when(F.col("role") == "code", at + F.octet_length(F.rtrim("piece"))).otherwise(F.col("end_off"))
    last = F.struct(end.alias("off"), F.col("row_end").alias("row"))
    rows = rows.withColumn("last", last)
    separator = (F.col("role") == "semi") | ((F.col("role") == "code") & (F.col("piece") == ","))
    rows = rows.withColumn("stop", F.when(separator, F.lag("last").over(order)))
    rows = rows.select(
        "*",
        F.first("stop", ignorenulls=True).over(order.rowsBetween(1, W.unboundedFollowing)).alias("until"),
        F.max(F.when(F.col("role") != "semi", F.col("last"))).over(stmt).alias("rest"),
    ).where((F.col("role") == "code") & (F.col("piece") == "=>"))
    # A bracket that begins a statement stands behind nothing that says what it opens.
    opened = scripts.select("fid", "level", F.col("sibs")[0]["text"].alias("opening"), "sibs", F.posexplode("sibs").alias("at", "s"))
    opened = opened.where(F.col("s.role") == "open").select("fid", "level", "s.tok", "s.text", "opening", near(-1, "text").alias("p_text"))
    rows = _with_marks(rows, opened)

    # A bracketed list: the lexeme up to the arrow is empty or a result type.
    listed = (F.col("p_text") == ")") & (F.col("o_text") == "(") & F.col("before").rlike(r"^\s*(?::[^=]*)?$")
    name = F.regexp_extract("before", r"((?:\basync\s+)?[\w$]+)\s*$", 1)
    # In a type the list stands behind the colon of a declared name, in a type alias or in the body of a type.
    ahead = F.when(listed, F.when(F.col("o_p_role") == "code", F.col("o_p_text")).otherwise("")).otherwise(F.expr("left(before, length(before) - length(regexp_extract(before, '((?:async +)?[a-zA-Z0-9_$]+) *$', 1)))"))
    declared = ahead.rlike(r"\b(?:const|let|var)\s+[\w$]+[!]?\s*:[^=]*$")
    member = (F.col("group") == "class") & ahead.rlike(r"^(?:(?:public|private|protected|static|readonly|declare|override|abstract)\s+)*[#\w$]+[?!]?\s*:[^=]*$")
    parameter = (F.col("group") == "list") & ahead.rlike(r"(?:^|,)\s*(?:(?:public|private|protected|readonly|override)\s+)*(?:\.\.\.)?[\w$]+\??\s*:\s*$")
    in_type = (F.col("group") == "type") | F.col("opening").rlike(r"^(?:(?:export|declare)\s+)*type\s+[\w$]+") | declared | member | parameter
    block = (F.rtrim("text") == F.concat("before", "piece")) & (F.col("n_role") == "open") & (F.col("n_text") == "{")
    body_end = F.when(block, F.struct(F.col("block_end").alias("off"), F.col("block_row").alias("row"))).otherwise(F.coalesce("until", "rest"))
    lead = F.octet_length("before") - F.octet_length(F.regexp_extract("before", r"((?:\basync\s+)?[\w$]+\s*)$", 1))
    return rows.where((listed | (name != "")) & ~F.coalesce(in_type, F.lit(False))).select(
        "fid",
        "language",
        "level",
        "sid",
        F.lit("arrow_function").alias("kind"),
        F.lit("").alias("name"),
        F.when(listed, F.col("o_off")).otherwise(F.col("off") + lead).alias("off"),
        body_end["off"].alias("end_off"),
        F.when(listed, F.col("o_row")).otherwise(F.col("row")).alias("row"),
        body_end["row"].alias("row_end"),
        F.when(listed, F.col("o_col")).otherwise(F.col("col") + lead).alias("col"),
        "stmt_off",
        F.col("first_end").alias("prev_end"),
        F.when(listed, F.col("o_doc_off")).otherwise(F.col("doc_off")).alias("doc_off"),
        F.lit(False).alias("exported"),
        F.when(listed, F.col("o_end_off")).alias("params_from"),
        F.when(listed, F.col("c_off")).alias("params_to"),
        F.lit(False).alias("is_async"),
    )


def function_rows(stm: DataFrame, blk: DataFrame) -> DataFrame:
    """Functions without their texts."""
    rows = _function_rows(stm, blk).unionByName(arrow_functions(stm))
    return rows.withColumn("n_lines", F.col("row_end") - F.col("row") + 1)


PARAMS_TEXT = {"params_text": ("params_from", "params_to")}


def functions(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Functions with their text, the text before them and their parameter list."""
    return with_slices(rows, files, {"body": ("off", "end_off"), "attributes": ("stmt_off", "off"), **PARAMS_TEXT})


def params(fns: DataFrame) -> DataFrame:
    """One row per direct parameter that counts as a plain parameter of its language.

    Defaults, ``*args`` and ``**kwargs`` do not count in Python; ``self`` does not count in Rust.
    """
    lang = F.col("language")
    listed = fns.where(F.col("params_text").isNotNull()).select(
        "fid",
        "language",
        F.col("off").alias("fn_off"),
        F.posexplode(F.split(strip_groups(code_only(F.col("params_text"), lang)), ",")).alias("pos", "param"),
    )
    p = F.trim(F.regexp_replace("param", r"\s+", " "))
    counted = (
        F.when(lang == "rust", ~p.rlike(r"^(?:&\s*)?(?:'\w+ )?(?:mut )?self\b") & p.contains(":"))
        .when(lang == "python", ~p.contains("=") & ~p.isin("/", "*") & (~p.startswith("*") | p.contains(":")))
        .when(lang == "java", ~p.contains("...") & ~p.rlike(r"\bthis$"))
        .otherwise(F.lit(True))
    )
    first_part = F.element_at(F.split(p, "[: =]"), 1)
    last_word = F.regexp_extract(p, r"(\w+)\s*(?:\[\s*\]\s*)?(?:=.*)?$", 1)
    # A destructured parameter counts but has no name of its own.
    plain = F.regexp_replace(first_part, r"\?$", "")
    name = F.when(lang.isin(JVMISH), last_word).otherwise(F.when(plain.rlike(r"^[{\[(]"), F.lit("")).otherwise(plain))
    return listed.where((p != "") & counted).select("fid", "language", "fn_off", "pos", name.alias("name"))


def catches(stm: DataFrame, blk: DataFrame, files: DataFrame) -> DataFrame:
    """Catch and except clauses with their text and the facts about their header."""
    clause = blk.where(
        F.when(F.col("language") == "python", F.col("head").rlike(r"^except\b")).otherwise(
            (F.col("language") != "rust") & F.col("head").rlike(r"^catch\b")
        )
    )
    return with_catch_facts(with_text(clause.select("fid", "language", "off", "end_off", "row", "col"), files))


# Base exception names that make a catch broad and never count as its variable.
_BASE_TYPES = ["Exception", "Throwable", "Error", "BaseException"]


def with_catch_facts(rows: DataFrame) -> DataFrame:
    body, lang = F.col("body"), F.col("language")
    type_name = F.trim(F.regexp_extract(body, r"^[^(]*\(([^) \t]*)", 1))
    last_seg = F.substring_index(type_name, ".", -1)
    has_paren = body.contains("(")
    bare = body.rlike(r"^\s*catch\s*\{")
    broad = F.when(
        lang == "python", body.rlike(r"^\s*(?:except:|except Exception|except BaseException)")
    ).otherwise(
        bare
        | (
            has_paren
            & (
                (type_name == "")
                | last_seg.isin([*_BASE_TYPES, "RuntimeException"])
                | type_name.isin("e", "err", "error", "ex")
            )
        )
    )
    py_var = F.regexp_extract(body, r"^\s*except\s[^:]*?\sas\s+([^:\s]+)", 1)
    inside = F.regexp_extract(body, r"^\s*catch\s*\(([^)]*)\)", 1)
    words = F.filter(
        F.regexp_extract_all(F.regexp_replace(inside, r"[\w.]+\.\w+", " "), F.lit(r"[\w$]+"), F.lit(0)),
        lambda w: ~w.isin([*_BASE_TYPES, "final"]),
    )
    ts_word = F.regexp_extract(inside, r"^\s*([\w$]+)", 1)
    first_word = F.coalesce(F.try_element_at(words, F.lit(1)), F.lit(""))
    last_word = F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit(""))
    var = (
        F.when(lang == "python", py_var)
        .when(lang == "csharp", first_word)
        .when(lang == "java", F.when(inside.rlike(r"\s"), last_word).otherwise(F.lit("")))
        .otherwise(F.when(ts_word.isin(_BASE_TYPES), F.lit("")).otherwise(ts_word))
    )
    return rows.select(
        "*",
        F.when(has_paren, type_name).otherwise(F.lit("")).alias("type_name"),
        var.alias("exc_var"),
        broad.alias("is_broad"),
        code_only(body, lang).rlike(r"\breturn\b").alias("has_return"),
    )


# A name after one of these words is a call; after any other word it is being declared.
_VALUE_WORDS = (
    r"\b(?:return|throw|await|else|case|in|of|not|and|or|yield|is|if|elif|while|assert|typeof|void|delete|do|match|"
    r"break|mut|move|unsafe|raise|del|from|with|except|extends|default|=>)\s+$|=>\s+$|->\s+$"
)


def calls(tok: DataFrame) -> DataFrame:
    """Calls: a name directly before a round bracket. ``off`` is where the whole chain starts."""
    tail = F.col("p_tail")
    name = F.regexp_extract(tail, r"([\w$]+)(?:::)?(?:<[^()]*>)?$", 1)
    # A method with a result type, and a signature in the body of a type, are declared, not called.
    typed = F.col("language").isin(TS) & F.col("plain") & F.col("n2_text").startswith(":") & (F.col("n3_text") == "{")
    with_types = tok.where(F.col("language").isin(TS) & (F.col("role") == "code") & F.col("text").rlike(_TYPE_BODY)).select("fid").distinct()
    typed_files = tok.join(with_types, "fid", "left_semi")
    opens = typed_files.where((F.col("role") == "open") & (F.col("text") == "(")).select("fid", "level", "tok")
    signatures = with_group(opens, typed_files).where(F.col("group") == "type")
    tok = tok.join(signatures.select("fid", "tok"), ["fid", "tok"], "left_anti")
    return (
        tok.where((F.col("role") == "open") & (F.col("text") == "(") & (F.col("p_role") == "code") & (tail != ""))
        .withColumn("before", F.expr("left(p_text, length(p_text) - length(p_tail))"))
        .withColumn("name", name)
        .withColumn("plain", tail.rlike(r"^[\w$]+$"))
        .where(
            (F.col("name") != "")
            & ~tail.endswith("!")
            & ~(F.col("plain") & F.col("name").isin(*_NOT_NAMES, "def", "class", "fn", "import", "async", "in", "not", "and", "or", "is", "elif"))
            & ~F.col("before").rlike(r"\b(?:def|function|fn|class|new)\s*\*?\s*$")
            & ~(F.col("plain") & F.col("before").rlike(r"[\w>]\s+$") & ~F.col("before").rlike(_VALUE_WORDS))
            & ~F.coalesce(
                F.col("language").isin(BRACES) & F.col("plain") & (F.col("n2_role") == "open") & (F.col("n2_text") == "{") | typed,
                F.lit(False),
            )
        )
        .select(
            "fid",
            "language",
            "tok",
            "sid",
            "level",
            F.col("chain.off").alias("off"),
            F.col("close_end").alias("end_off"),
            F.col("chain.row").alias("row"),
            F.col("chain.col").alias("col"),
            F.col("off").alias("open_off"),
            "name",
            F.col("p_tail").alias("tail"),
            "plain",
            F.coalesce(tail.rlike(r"\.[\w$]+(?:::<.*>)?$"), F.lit(False)).alias("is_method"),
            (F.col("plain") & F.col("before").rlike(r"\bawait\s*$")).alias("awaited"),
        )
    )


def with_slices(rows: DataFrame, files: DataFrame, slices: dict[str, tuple[str, str]], keep: list[str] | None = None) -> DataFrame:
    """Add pieces of the file text between two byte offset columns, NULL where an offset is.

    A file's rows are gathered once and its text is turned to bytes once, so the cost is one copy of
    the text and of the pieces, whatever the number of rows.
    """
    keep = keep or rows.columns
    cols = [c for c in rows.columns if c != "fid"]
    gathered = rows.groupBy("fid").agg(F.collect_list(F.struct(*cols)).alias("__rows"))
    joined = gathered.join(files.select("fid", "text"), "fid")

    def cut(data: Column, r: Column) -> Column:
        pieces = [utf8_slice(data, r[a], r[b]).alias(name) for name, (a, b) in slices.items()]
        return F.struct(*[r[c].alias(c) for c in cols], *pieces)

    cut_rows = F.transform(
        F.array(F.col("text").cast("binary")), lambda data: F.transform("__rows", lambda r: cut(data, r))
    )
    return joined.select("fid", F.inline(F.get(cut_rows, 0))).select(*keep, *slices)


def with_text(rows: DataFrame, files: DataFrame, name: str = "body") -> DataFrame:
    return with_slices(rows, files, {name: ("off", "end_off")})


def macro_groups(tok: DataFrame) -> DataFrame:
    """Bracket groups of Rust macro calls and macro definitions."""
    return tok.where(
        (F.col("language") == "rust")
        & (F.col("role") == "open")
        & F.col("close_end").isNotNull()
        & (F.col("p_role") == "code")
        & F.col("p_text").rlike(r"(?:[A-Za-z_]\w*!|macro_rules!\s*\w+)$")
    ).select("fid", "off", F.col("close_end").alias("end_off"))


def attribute_groups(tok: DataFrame) -> DataFrame:
    """Bracket groups of attributes, annotations and decorators."""
    lang, text, before = F.col("language"), F.col("text"), F.col("p_text")
    rust = (lang == "rust") & (text == "[") & (F.col("p_role") == "code") & before.rlike(r"#!?$")
    at = (lang.isin("python", "java", "typescript", "tsx")) & (text == "(") & before.rlike(r"@[\w.]+$")
    starts = F.col("p_role").isNull() | F.col("p_role").isin("semi", "end") | before.isin("]", "}")
    sharp = (lang == "csharp") & (text == "[") & starts
    return tok.where(
        (F.col("role") == "open") & F.col("close_end").isNotNull() & F.coalesce(rust | at | sharp, F.lit(False))
    ).select("fid", "off", F.col("close_end").alias("end_off"))


_NUMBER_PIECE = (
    r"[0-9]\w*+(?:\.(?!\.)[0-9]\w*+|\.(?![.\w]))?|[A-Za-z_$][\w$]*+|(?:[^\w$])++|[\s\S]"
)


def number_literals(tok: DataFrame) -> DataFrame:
    """Number literals with their position, cut out of the code lexemes that hold digits.

    Pieces carry offsets only, never their lexeme, so one long line of numbers
    stays linear.
    """
    pieces = tok.where((F.col("role") == "code") & F.col("text").rlike(r"(?<![\w$])[0-9]")).select(
        "fid",
        "language",
        "tok",
        "off",
        "row",
        "col",
        F.posexplode(F.regexp_extract_all("text", F.lit(_NUMBER_PIECE), F.lit(0))).alias("i", "text"),
    )
    run = W.partitionBy("fid", "tok").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    pieces = pieces.withColumn("past", F.sum(F.octet_length("text")).over(run).cast("int"))
    back = F.col("past") - F.octet_length("text")
    return pieces.where(F.col("text").rlike("^[0-9]")).select(
        "fid",
        "language",
        (F.col("off") + back).alias("off"),
        "row",
        (F.col("col") + back).alias("col"),
        "text",
    )


_CONTEXT_PIECE = r"=>|->|::|\?\.|\?\?|[=!<>]=+|[=,:]|[^=,:?!<>-]+|[\s\S]"
_TS_DECLARES = r"^(?:(?:export|declare)\s+)*(?:const|let|var)\b"
_TS_TARGET = r"(?:[\w$]+|\{\}|\[\])"
_TS_FIELD = (
    r"^(?:@[\w$.]+(?:\(\))?\s*)*(?:(?:public|private|protected|static|readonly|declare|override|abstract|accessor)\s+)*"
    r"(?:#?[\w$]+|\[\]|\"\")\s*[?!]?$"
)
_TS_PARAM = rf"^(?:(?:public|private|protected|readonly|override)\s+)*(?:\.\.\.)?{_TS_TARGET}\s*\??$"


def context_spans(tok: DataFrame, openings: DataFrame) -> DataFrame:
    """Spans of Rust match patterns with their guards, and of TypeScript annotations.

    Siblings are cut at what separates arms, declarators and parameters; bracket groups inside a
    span belong to it. A pattern runs up to its arrow. An annotation of a variable or parameter runs
    from its colon up to ``=``, that of a result up to the body.
    """
    role, text, lang = F.col("role"), F.col("text"), F.col("language")
    piece = F.when(role == "code", F.regexp_extract_all("text", F.lit(_CONTEXT_PIECE), F.lit(0))).otherwise(
        F.array(F.when(role == "string", F.lit('""')).otherwise(text))
    )
    rust = tok.where(lang == "rust").withColumn("group", F.lit("other"))
    rows = rust.unionByName(with_group(tok.where(lang.isin(TS)), openings)).select(
        "fid", "language", "group", "level", F.when(lang == "rust", 0).otherwise(F.col("sid")).alias("sid"), "tok", "role",
        "off", "end_off", "n_text", F.posexplode(piece).alias("i", "text"),
    )
    level = W.partitionBy("fid", "level").orderBy("tok", "i")
    # A closing brace ends an arm unless it ends the pattern's own braces.
    arm_end = (lang == "rust") & ((text == "=>") | (role == "close") & (text == "}") & ~F.coalesce(F.col("n_text").rlike(r"^(?:=>|\||if\b)"), F.lit(False)))
    cut = F.when((text == ",") | role.isin("semi", "end") | arm_end, 1).otherwise(0)
    before = W.partitionBy("fid", "level", "tok").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    start = F.col("off") + F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0)).cast("int")
    rows = rows.select(
        "fid", "language", "group", "level", "sid", "tok", "i", "role", "text",
        F.coalesce(F.sum(cut).over(level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("part"),
        F.first(F.when(role == "end", text), ignorenulls=True).over(level.rowsBetween(W.currentRow, W.unboundedFollowing)).alias("closer"),
        F.first("text").over(W.partitionBy("fid", "level", "sid").orderBy("tok", "i")).alias("opening"),
        start.alias("off"),
        F.when(role == "code", start + F.octet_length("text")).otherwise(F.col("end_off")).alias("end_off"),
    )
    key = ["fid", "level", "sid", "part"]
    patterns = (
        rows.where(lang == "rust").groupBy(*key).agg(F.min("off").alias("off"), F.max(F.when(text == "=>", F.col("off"))).alias("end_off"))
    ).select("fid", "off", "end_off")
    parts = (
        rows.where(lang.isin(TS) & (role != "end") & (role != "semi") & (text != ","))
        .groupBy(*key)
        .agg(
            F.array_sort(F.collect_list(F.struct("tok", "i", "role", "text", "off", "end_off"))).alias("pieces"),
            F.first("closer").alias("closer"),
            F.first("opening").alias("opening"),
            F.first("group").alias("group"),
        )
        .withColumn("at", F.array_position(F.transform("pieces", lambda x: x["text"]), ":").cast("int"))
        .where(F.col("at") > 1)
        .withColumn("lead", F.trim(F.array_join(F.transform(F.slice("pieces", 1, F.greatest(F.col("at") - 1, F.lit(0))), lambda x: x["text"]), "")))
        .withColumn("rest", F.slice("pieces", F.col("at") + 1, F.size("pieces")))
    )
    lead = F.col("lead")
    named = (
        lead.rlike(rf"{_TS_DECLARES}\s*{_TS_TARGET}\s*!?$")
        | F.col("opening").rlike(_TS_DECLARES) & lead.rlike(r"^[\w$]+\s*!?$")
        | (F.col("closer") == ")") & lead.rlike(_TS_PARAM)
        | F.col("group").isin("class", "type") & lead.rlike(_TS_FIELD)
    )
    body = F.exists("rest", lambda x: x["text"].isin("=>", "{"))
    signature = F.col("group").isin("class", "type")
    result = lead.rlike(r"\(\)$") & ~lead.contains("?") & ~lead.rlike(r"^case\b") & (body | signature)
    stops = F.filter("rest", lambda x: F.when(F.col("named"), x["text"] == "=").otherwise(x["text"].isin("=>", "{")))
    annotations = (
        parts.withColumn("named", F.coalesce(named, F.lit(False)))
        .where(F.col("named") | result)
        .select(
            "fid",
            F.get("pieces", F.col("at") - 1)["off"].alias("off"),
            F.coalesce(F.get(stops, F.lit(0))["off"], F.element_at("pieces", -1)["end_off"]).alias("end_off"),
        )
    )
    return patterns.unionByName(annotations).where(F.col("off") < F.col("end_off"))


_IMPORT_HEAD = {
    "rust": r"^(?:# \[ \] )*(?:pub (?:\( \) )?)?use\s",
    "python": r"^(?:import|from)\s",
    "typescript": r"^import\b(?!\s*[(.])",
    "csharp": r"^using\s+[\w.]+ ;$",
    "java": r"^import\s",
}


def import_statements(stm: DataFrame, files: DataFrame) -> DataFrame:
    lang = F.col("language")
    rows = stm.where(
        by_language(lang, lambda g: F.col("head").rlike(_IMPORT_HEAD[g])) & ((lang != "python") | (F.col("level") <= 0))
    ).select("fid", "language", "off", "end_off", "row")
    return with_text(rows, files, "stmt")


def bound_names(stmt: Column, lang: Column) -> Column:
    """Names bound by one import statement, as an array."""
    empty = F.array().cast("array<string>")

    def last_part(text: Column, sep: str) -> Column:
        name = F.trim(F.substring_index(text, sep, -1))
        return F.when(name == "*", empty).otherwise(F.array(name))

    def alias_of(s: Column) -> Column:
        return F.trim(F.substring_index(F.trim(s), " as ", -1))

    def non_empty(a: Column) -> Column:
        return F.filter(a, lambda x: x != "")

    def cleaned(words: str) -> Column:
        return F.trim(F.regexp_replace(F.regexp_replace(stmt, words, ""), r";+\s*$", ""))

    t = F.trim(stmt)
    py_from = F.expr("substring({0}, locate(' import ', {0}) + 8)".format("__t"))
    from_names = non_empty(F.transform(F.split(py_from, ","), lambda s: alias_of(F.regexp_replace(F.trim(s), r"^(?:as )+", ""))))
    plain = F.regexp_replace(t, r"^import ", "")
    import_names = non_empty(
        F.transform(F.split(plain, ","), lambda s: F.substring_index(alias_of(s), ".", 1))
    )
    python = (
        F.when(t.startswith("from ") & (F.locate(" import ", t) > 0), from_names)
        .when(t.startswith("import "), import_names)
        .otherwise(empty)
    )
    bindings = F.trim(F.regexp_replace(F.substring_index(F.regexp_replace(t, r"^import\s", ""), " from ", 1), r"\s+", " "))
    default = F.trim(F.regexp_replace(F.trim(F.substring_index(bindings, "{", 1)), r",+$", ""))
    default = F.when(default == "type", "").otherwise(F.regexp_replace(default, r"^type ", ""))
    default = F.regexp_replace(default, r"^\* as ", "")
    default_names = F.when(
        (default == "") | (default == "*") | default.rlike("^[\"';]"), empty
    ).otherwise(F.array(F.trim(F.regexp_replace(default, r"\s*;$", ""))))
    named = F.regexp_extract(bindings, r"\{([^}]*)", 1)
    named_names = non_empty(F.transform(F.split(named, ","), alias_of))
    ts = F.concat(default_names, named_names)
    rust_text = cleaned(r"^(?:use )+")
    jvm_text = cleaned(r"^(?:import )+")
    return (
        F.when(lang == "rust", last_part(rust_text, "::"))
        .when(lang == "python", python)
        .when(lang.isin(TS), ts)
        .when(lang == "java", last_part(jvm_text, "."))
        .otherwise(last_part(cleaned(r"^(?:using )+"), "."))
    )


def imports(stm: DataFrame, files: DataFrame) -> DataFrame:
    """One row per bound name: ``(fid, language, row, pos, name)``."""
    rows = import_statements(stm, files).withColumn("__t", F.trim("stmt"))
    names = bound_names(F.col("stmt"), F.col("language"))
    return rows.select("fid", "language", "off", "row", F.posexplode(names).alias("pos", "name"))


_IMPORT_TEXT = {
    "rust": r"(?m)^[ \t]*(?:pub(?:\([^)\n]*\))?[ \t]+)?use\s[^;]*;",
    "python": r"(?m)^[ \t]*(?:import|from)[ \t](?:[^\n(\\]|\\\n|\([^)]*\))*+",
    "typescript": r"(?m)^[ \t]*import\b(?!\s*[(.])[^;\"'`]*",
    "csharp": r"(?m)^[ \t]*using\s+[\w.]+\s*;",
    "java": r"(?m)^[ \t]*import\s[^;]*;",
}


def may_interpolate(text: Column, lang: Column) -> Column:
    """The text can hold a template or formatted string; a prefix has two letters at most."""
    return (lang.isin(TS) & text.contains("`")) | ((lang == "python") & text.rlike(r"[fF][rRbBuUtTfF]?[\"']"))


def identifiers(files: DataFrame, java_types: bool = False) -> DataFrame:
    """Distinct identifiers per file outside import statements. One narrow pass over the text.

    Expressions inside template and formatted strings count as code. Java names
    used only as a type do not count unless ``java_types`` is set.
    """
    lang, text = F.col("language"), F.col("text")
    literals = by_language(lang, lambda g: F.regexp_extract_all(text, F.lit(LITERAL_OR_COMMENT[g]), F.lit(0)))
    live = F.filter(literals, lambda s: s.rlike(r"^(?:`|[a-zA-Z]*[fF][a-zA-Z]*[\"'])"))
    inner = F.flatten(F.transform(live, lambda s: F.regexp_extract_all(s, F.lit(r"\{([^{}]*)\}"), F.lit(1))))
    # A text that holds no such string is not searched for literals.
    inner = F.when(may_interpolate(text, lang), inner).otherwise(F.array().cast("array<string>"))
    outside = by_language(lang, lambda g: F.regexp_replace(code_only(text, lang), _IMPORT_TEXT[g], " "))
    source = F.concat_ws(" ", outside, F.array_join(inner, " "))
    # In Java a class name counts as used only as a value: a member access, a call, an annotation, a constant.
    java = F.regexp_replace(F.regexp_replace(source, r"\bnew\s+[\w.]+", "new"), r"@\s*([\w.]+)", "$1.a ")
    java_names = F.regexp_extract_all(
        java,
        F.lit(
            r"(?<![\p{L}\p{N}_$])(?:[\p{Ll}_$][\p{L}\p{N}_$]*+|\p{Lu}[\p{Lu}\p{N}_$]++(?![\p{L}])"
            r"|\p{Lu}[\p{L}\p{N}_$]*+(?=\s*(?:\.\s*(?!class\b)\w|::|\()))"
        ),
        F.lit(0),
    )
    names = F.regexp_extract_all(source, F.lit(r"(?<![\p{L}\p{N}_])[\p{L}_$][\p{L}\p{N}_$]*+"), F.lit(0))
    if not java_types:
        names = F.when(lang == "java", java_names).otherwise(names)
    return files.select("fid", F.explode(F.array_distinct(names)).alias("name"))


# One of these is in the text of every file with a loop.
LOOP_WORDS = ["for", "while", "loop"]


def loops(stm: DataFrame, blk: DataFrame, files: DataFrame) -> DataFrame:
    """``for`` / ``while`` statements with their text; loop variable and iterable for Python."""
    cols = ["fid", "language", "head", "off", "end_off", "row", "col"]
    py = blk.where((F.col("language") == "python") & F.col("head").rlike(r"^(?:async\s+)?(?:for|while)\b")).select(*cols)
    ts = stm.where(F.col("language").isin(TS) & F.col("head").rlike(r"^(?:for|while)\b")).select(*cols)
    rest = blk.where(
        F.col("language").isin("rust", *JVMISH) & F.col("head").rlike(r"^(?:for|foreach|while|loop)\b")
    ).select(*cols)
    rows = with_text(py.unionByName(ts).unionByName(rest), files)
    kind = F.regexp_extract("head", r"^(?:async\s+)?(\w+)", 1)
    var = F.when(F.col("language") == "python", F.regexp_extract("body", r"^(?:async\s+)?for\s+([A-Za-z_]\w*)\s+in\s", 1)).otherwise("")
    header = F.substring_index(F.col("body"), "\n", 1)
    source = F.when(F.col("language") == "python", F.regexp_extract(header, r"\bin\s+(.*?)\s*:\s*(?:#.*)?$", 1)).otherwise("")
    return rows.select("*", kind.alias("kind"), var.alias("var"), source.alias("source"))


def _angle_list(text: Column) -> Column:
    """The part of a text that starts with ``<`` up to the bracket that closes it; empty when none does."""
    pieces = F.regexp_extract_all(text, F.lit(r"[<>]|[^<>]+"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("done"), F.lit("").alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        depth = acc["depth"] + F.when(piece == "<", 1).when(piece == ">", -1).otherwise(0)
        taken = F.struct(depth.alias("depth"), (depth == 0).alias("done"), F.concat(acc["out"], piece).alias("out"))
        return F.when(acc["done"], acc).otherwise(taken)

    found = F.aggregate(pieces, start, step)
    return F.when(found["done"], found["out"]).otherwise(F.lit(""))


def type_facts(stm: DataFrame) -> DataFrame:
    """Rust traits, trait implementations and type-parameter lists."""
    rust = stm.where(F.col("language") == "rust")
    head = F.col("head")
    words = r"(?:pub (?:\( \) )?)?(?:unsafe )?(?:auto )?"
    trait = F.regexp_extract(head, rf"^(?:#!? \[ \] )*{words}trait\s+(\w+)", 1)
    impl = F.regexp_extract(head, r"^(?:#!? \[ \] )*(?:unsafe )?impl(?:<(?:[^<>]|<[^<>]*>)*>)?\s+!?(?:[\w]+::)*(\w+) for\s", 1)
    # Generic list right after the item keyword or name: up to the bracket that closes it.
    opened = F.regexp_extract(
        F.regexp_replace(head, "->", "  "), r"\b(?:fn\s+\w+|struct\s+\w+|enum\s+\w+|union\s+\w+|trait\s+\w+|type\s+\w+|impl)(<.*)$", 1
    )
    generic = F.regexp_extract(F.replace(_angle_list(opened), F.lit("\n"), F.lit(" ")), r"^<(.*)>$", 1)
    entries = F.filter(F.split(strip_groups(generic), ","), lambda e: F.trim(e) != "")
    at = _index_of(
        lambda s: (s["role"] == "code") & s["text"].rlike(r"\b(?:fn|struct|enum|union|trait|type)\s+\w+<|\bimpl<")
    )
    chunk = _sib(F.when(at > 0, at).otherwise(F.lit(1)))
    shift = F.octet_length(F.substring_index(chunk["text"], "<", 1))
    item = _sib(F.greatest(F.lit(1), _index_of(lambda s: s["text"].rlike(r"^(?:pub\b|unsafe\b|auto\b|trait\b|impl\b)"))))
    facts = F.array(
        F.when(trait != "", F.struct(F.lit("trait").alias("kind"), trait.alias("name"), F.lit(0).alias("n"), item["off"].alias("off"), item["row"].alias("row"), item["col"].alias("col"))),
        F.when(impl != "", F.struct(F.lit("impl").alias("kind"), impl.alias("name"), F.lit(0).alias("n"), item["off"].alias("off"), item["row"].alias("row"), item["col"].alias("col"))),
        F.when(
            generic != "",
            F.struct(F.lit("type_params").alias("kind"), F.lit("").alias("name"), F.size(entries).alias("n"), (chunk["off"] + shift).alias("off"), chunk["row"].alias("row"), (chunk["col"] + shift).alias("col")),
        ),
    )
    return rust.select("fid", F.inline(F.filter(facts, lambda f: f.isNotNull())))


def async_names(stm: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct names of asynchronous functions per file."""
    lang, head = F.col("language"), F.col("head")
    py = stm.where((lang == "python") & head.rlike(r"^async\s+def\s")).select(
        "fid", F.regexp_extract(head, r"^async\s+def\s+(\w+)", 1).alias("name")
    )
    ts = stm.where(lang.isin(TS) & head.rlike(r"^(?:export\s+)?(?:default\s+)?async\s+function\s+[\w$]")).select(
        "fid", F.regexp_extract(head, r"async\s+function\s+([\w$]+)", 1).alias("name")
    )
    declared = stm.where(lang.isin(TS) & head.rlike(r"^(?:export\s+)?(?:const|let|var)\s"))
    text = with_text(declared.select("fid", "off", "end_off", "head"), files, "stmt").where(F.col("stmt").contains("async"))
    names = F.regexp_extract_all("head", F.lit(r"(?:\b(?:const|let|var)\s+|,\s*)([\w$]+)(?:\s*:[^=,]*)?\s*="), F.lit(1))
    ts_declared = text.select("fid", F.explode(names).alias("name"))
    return py.unionByName(ts).unionByName(ts_declared).where(F.col("name") != "").distinct()
