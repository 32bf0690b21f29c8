"""Lines and lexemes: one file row becomes many positioned fact rows.

Files are hash-partitioned by ``fid`` once; every later window is partitioned by
``fid`` first, so the explosion to lexemes never crosses the network.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coralint.functions.lexer import lexeme_kind, patterned
from coralint.functions.modes import CLOSES_EXPRESSION, OPENS_EXPRESSION, piece_kind, scanned


def split_lines(text: Column) -> Column:
    """Lines without their ends; no empty line after a final newline."""
    parts = F.split(text, "\n")
    kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.transform(kept, lambda line: F.regexp_replace(line, r"\r$", ""))


def lines(files: DataFrame) -> DataFrame:
    """``(fid, language, row, line)`` with 0-based rows."""
    return files.select("fid", "language", F.posexplode(split_lines(F.col("text"))).alias("row", "line"))


def lexemes(files: DataFrame, partitions: int | None = None) -> DataFrame:
    """Positioned lexemes: byte offsets, rows, byte columns and bracket depth.

    ``off``/``end_off`` are byte offsets, ``col`` is a 0-based byte column.
    ``doc_off`` is the offset of the last documentation comment so far.

    The scan hides how its input is partitioned, so ``partitions`` deals the texts out behind it: a shuffle
    of texts is far smaller than the one of lexemes that the windows would ask for.
    """
    cut = files.select("fid", "language", "text", scanned(F.col("text"), F.col("language")).alias("pieces"))
    if partitions:
        cut = cut.repartition(partitions, "fid")
    by_scan = F.col("pieces").isNotNull()
    pieces = F.when(by_scan, F.col("pieces")).otherwise(patterned(F.col("text"), F.col("language")))
    cut = cut.select("fid", "language", by_scan.alias("scanned"), F.posexplode(pieces).alias("tok", "piece"))
    cut = cut.select(
        "fid",
        "language",
        "tok",
        F.when(F.col("scanned"), F.expr("substring(piece, 2)")).otherwise(F.col("piece")).alias("raw"),
        F.when(F.col("scanned"), piece_kind(F.col("piece"))).otherwise(lexeme_kind(F.col("piece"), F.col("language"))).alias("kind"),
        F.when(F.col("scanned") & F.col("piece").startswith("i"), OPENS_EXPRESSION)
        .when(F.col("scanned") & F.col("piece").startswith("j"), CLOSES_EXPRESSION)
        .alias("mark"),
    )
    spans_rows = F.col("kind").isin("space", "comment", "string") | F.col("mark").isNotNull()
    cut = cut.withColumn("bytes", F.octet_length("raw")).withColumn(
        "nl",
        F.when(spans_rows, F.length("raw") - F.length(F.replace(F.col("raw"), F.lit("\n"), F.lit("")))).otherwise(0),
    )
    order = W.partitionBy("fid").orderBy("tok")
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    delta = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    pos = cut.select(
        "fid",
        "language",
        "tok",
        "kind",
        "raw",
        "mark",
        "bytes",
        "nl",
        F.sum("bytes").over(upto).cast("int").alias("stop"),
        F.sum("nl").over(upto).cast("int").alias("row_end"),
        F.sum(delta).over(upto).cast("int").alias("depth_after"),
    )
    line_start = F.when(
        F.col("nl") > 0, F.col("stop") - F.octet_length(F.substring_index(F.col("raw"), "\n", -1))
    )
    off = F.col("stop") - F.col("bytes")
    is_doc = (F.col("kind") == "comment") & F.col("raw").rlike(r"^(///|/\*\*|//!)")
    out = pos.select(
        "*",
        F.coalesce(F.max(line_start).over(before), F.lit(0)).alias("line_off"),
        F.max(F.when(is_doc, off)).over(upto).alias("doc_off"),
    )
    text = F.when(F.col("kind") == "code", F.rtrim("raw")).otherwise(F.coalesce("mark", "raw"))
    end_off = F.when(F.col("kind") == "code", off + F.octet_length(text)).otherwise(F.col("stop"))
    return out.where(F.col("kind") != "space").select(
        "fid",
        "language",
        "tok",
        "kind",
        text.alias("text"),
        off.alias("off"),
        end_off.alias("end_off"),
        (F.col("row_end") - F.col("nl")).alias("row"),
        "row_end",
        (off - F.col("line_off")).alias("col"),
        F.when(F.col("kind") == "open", F.col("depth_after") - 1).otherwise(F.col("depth_after")).alias("depth"),
        "doc_off",
    )


def comments(lex: DataFrame) -> DataFrame:
    return lex.where(F.col("kind") == "comment").select(
        "fid", "language", "off", "row", "col", "text", F.col("text").rlike(r"^(///|/\*\*|//!)").alias("is_doc")
    )


def string_literals(lex: DataFrame) -> DataFrame:
    """String literals with the code lexemes around them (assignment target, call name, operator)."""
    order = W.partitionBy("fid").orderBy("tok")
    strings = lex.where(F.col("kind") != "comment").withColumn(
        "before", F.when(F.lag("kind").over(order) == "code", F.lag("text").over(order))
    ).withColumn("after", F.when(F.lead("kind").over(order) == "code", F.lead("text").over(order)))
    return strings.where(F.col("kind") == "string").select(
        "fid", "language", "off", "row", "col", "text", "before", "after"
    )


# Trailing call target of a code lexeme: name, member chain or macro name.
TAIL = r"(?<![\w$.:?])((?:\?\.|\.|::|[\w$?])[\w$.:?]*!?(?:<[^()]*>)?)$"
# A name or member on a new line, but no infix word.
TS_NEW_NAME = r"^[#@]?(?!(?:in|instanceof|of|as|is|satisfies|extends|implements|from|catch|finally|else|while|keyof)\b)[\w$]"
# Words that a value, a name or a member must follow, on the same line or the next.
TS_OPEN_WORD = (
    r"\b(?:else|const|let|var|new|typeof|await|case|export|default|public|private|protected|static|readonly|abstract|override"
    r"|async|get|set|import|return|extends|implements|in|of|instanceof|as|void|delete|yield|throw|function|class|interface|enum"
    r"|type|declare|namespace|keyof|infer|is|from|do|try|finally)$"
)
TS_STATEMENT_WORDS = (
    r"^(?:for|while|if|function|async|class|const|let|var|return|import|export|try|switch|throw|do|interface|type)\b"
)


def tokens(lex: DataFrame) -> DataFrame:
    """Sibling view: each bracket group is seen from outside as ``open`` then ``close``.

    Rows of one nesting ``level`` follow each other, so ``lag``/``lead`` reach the
    neighbouring sibling however long the bracket group between them is. A closing
    bracket appears twice: as ``close`` on the level of its opening bracket and as
    ``end`` on the level inside, where it separates neighbouring groups.
    """
    by_file = W.partitionBy("fid").orderBy("tok")
    solid = lex.where(F.col("kind") != "comment").withColumn("prev_end", F.coalesce(F.lag("end_off").over(by_file), F.lit(0)))
    role = F.explode(
        F.when(F.col("kind") == "close", F.array(F.lit("close"), F.lit("end"))).otherwise(F.array(F.col("kind")))
    )
    flat = solid.select("*", role.alias("role")).withColumn(
        "level", F.when(F.col("role") == "end", F.col("depth") + 1).otherwise(F.col("depth"))
    )
    is_code = F.col("role") == "code"
    flat = flat.withColumn("tail", F.when(is_code, F.regexp_extract("text", TAIL, 1)).otherwise(F.lit("")))
    seq = W.partitionBy("fid", "level").orderBy("tok")
    upto = seq.rowsBetween(W.unboundedPreceding, W.currentRow)
    flat = flat.select(
        "*",
        *[F.lag(c).over(seq).alias(f"p_{c}") for c in ("role", "text", "tail", "row_end")],
        *[F.lead(c).over(seq).alias(f"n_{c}") for c in ("role", "text")],
        F.lead("role", 2).over(seq).alias("n2_role"),
        F.lead("text", 2).over(seq).alias("n2_text"),
        F.lead("text", 3).over(seq).alias("n3_text"),
        F.when(F.col("role") == "open", F.lead("end_off").over(seq)).alias("close_end"),
    )
    after_value = F.col("p_role").isin("code", "close", "string")
    after_callee = ((F.col("p_role") == "close") & (F.col("p_text") != "}")) | (F.col("p_tail") != "")
    joins_previous = (
        F.when(is_code, after_value & F.col("tail").rlike(r"^(?:\.|\?|::)") & (F.col("tail") == F.col("text")))
        .when((F.col("role") == "open") & (F.col("text") != "{"), after_callee)
        .otherwise(F.col("role") == "close")
    )
    lead_bytes = F.when(is_code & (F.col("tail") != ""), F.octet_length("text") - F.octet_length("tail")).otherwise(0)
    start = F.struct(
        (F.col("off") + lead_bytes).alias("off"),
        F.col("row").alias("row"),
        (F.col("col") + lead_bytes).alias("col"),
    )
    line_break = F.col("row") > F.col("p_row_end")
    python_break = (
        (F.col("level") <= 0) & line_break & ~((F.col("p_role") == "code") & F.col("p_text").endswith("\\"))
    )
    # Where semicolons are left out, a name on a new line behind a complete value starts anew.
    after_whole_value = (F.col("p_role") == "string") | (F.col("p_text") == "]") | (
        (F.col("p_role") == "code") & F.col("p_text").rlike(r"[\w$]$") & ~F.col("p_text").rlike(TS_OPEN_WORD)
    )
    brace_break = (
        (F.col("p_role") == "semi")
        | ((F.col("p_role") == "close") & (F.col("p_text") == "}"))
        | (
            F.col("language").isin("typescript", "tsx")
            & line_break
            & is_code
            & (F.col("text").rlike(TS_STATEMENT_WORDS) | (after_whole_value & F.col("text").rlike(TS_NEW_NAME)))
        )
    )
    new_statement = (F.col("role") != "close") & (
        F.col("p_role").isNull()
        | (F.col("p_role") == "end")
        | F.when(F.col("language") == "python", python_break).otherwise(brace_break)
    )
    joined = F.coalesce(joins_previous, F.lit(False))
    return flat.select(
        "*",
        F.last(F.when(~joined, start), ignorenulls=True).over(upto).alias("chain"),
        F.sum(F.when(new_statement, 1).otherwise(0)).over(upto).cast("int").alias("sid"),
        (joined & is_code).alias("continues"),
    )
