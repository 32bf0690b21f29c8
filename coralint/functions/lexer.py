"""One total lexer pattern per language, for ``regexp_extract_all``.

Every character of a file belongs to exactly one lexeme, so lexemes joined
together give the text back. All repetition is possessive: the JVM matcher then
loops instead of recursing and long literals cannot overflow the stack.

A *code* lexeme is a run of code on one line without brackets, semicolons,
strings or comments. That keeps the row count near four per source line; finer
pieces (identifiers, numbers) are cut out of code lexemes only where needed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from coralint.functions.modes import scanned

LANGUAGES = ["rust", "python", "typescript", "tsx", "csharp", "java"]
BRACE_LANGUAGES = ["rust", "typescript", "tsx", "csharp", "java"]

_C_COMMENT = r"//[^\n]*+|/\*(?:[^*]|\*(?!/))*+(?:\*/|\z)"
_PY_COMMENT = r"#[^\n]*+"
_DQ_LINE = r'"(?:[^"\\\n]|\\[\s\S])*+"'
_SQ_LINE = r"'(?:[^'\\\n]|\\[\s\S])*+'"
_CHAR = r"'(?:\\[^\n][^'\n]{0,10}|[^'\\\n])'"
_TRIPLE_DQ = r'"""(?:[^"\\]|\\[\s\S]|"(?!""))*+"""'
_TRIPLE_SQ = r"'''(?:[^'\\]|\\[\s\S]|'(?!''))*+'''"
_PY_PREFIX = r"(?:[rRbBfFuUtT]{1,2}(?=[\"']))?"

COMMENT = {
    "rust": _C_COMMENT,
    "python": _PY_COMMENT,
    "typescript": _C_COMMENT,
    "csharp": _C_COMMENT,
    "java": _C_COMMENT,
}

STRING = {
    "rust": r'(?:br|cr|r)(#*+)"(?:[^"]|"(?!\1))*+"\1|[bc]?"(?:[^"\\]|\\[\s\S])*+"|b?' + _CHAR,
    "python": _PY_PREFIX + "(?:" + "|".join([_TRIPLE_DQ, _TRIPLE_SQ, _DQ_LINE, _SQ_LINE]) + ")",
    "typescript": "|".join([_DQ_LINE, _SQ_LINE, r"`(?:[^`\\]|\\[\s\S])*+`"]),
    "csharp": r'\$*"""(?:[^"]|"(?!""))*+"""|(?:@\$|\$@|@)"(?:[^"]|"")*+"|\$?' + _DQ_LINE + "|" + _CHAR,
    "java": "|".join([_TRIPLE_DQ, _DQ_LINE, _CHAR]),
}

# In a piece of a file a slash opens a pattern literal behind an operator, a line break, a condition or a word that a
# value follows. What stands before the literal is matched along with it, so blanks may be of any number.
_TS_REGEX = (
    r"((?:[(=,:;!&|?{}\[+\n]|\b(?:return|case|typeof|throw|await|yield|in|of)\b|\b(?:if|while)\s*+\([^()\n]*+\))[ \t]*+)"
    r"/(?![/*])(?:[^/\\\n\[]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*+\])++/[a-z]*+"
)

_SPACE = r"\s++"
_MARK = r"[\[\](){};]"
_PLAIN = r"[^\w\s\[\](){};\"'/"

_CODE_UNITS = {
    "rust": [r"(?!(?:br|cr|r)#*\"|[bc]\"|b')\w++", r"'[A-Za-z_]\w*+(?!')", _PLAIN + "]", r"/(?![/*])"],
    "python": [r"(?![rRbBfFuUtT]{1,2}[\"'])\w++", _PLAIN + "#]", "/"],
    "typescript": [r"\w++", _PLAIN + "`]", r"/(?![/*])"],
    "csharp": [r"\w++", _PLAIN + "$@]", r"[$@](?![$@]*+\")", r"/(?![/*])"],
    "java": [r"\w++", _PLAIN + "]", r"/(?![/*])"],
}


def _total(lang: str) -> str:
    code = "(?:" + "|".join([*_CODE_UNITS[lang], r"[ \t]++"]) + ")++"
    return "|".join([COMMENT[lang], STRING[lang], _SPACE, _MARK, code, r"[\s\S]"])


LEXER = {lang: _total(lang) for lang in COMMENT}
LEXER["tsx"] = LEXER["typescript"]
LITERAL_OR_COMMENT = {lang: f"{COMMENT[lang]}|{STRING[lang]}" for lang in COMMENT}
LITERAL_OR_COMMENT["tsx"] = LITERAL_OR_COMMENT["typescript"]


def by_language(language: Column, make) -> Column:
    """``CASE language`` with a constant pattern per branch, so each is compiled once."""
    branches = {
        "rust": ["rust"],
        "python": ["python"],
        "typescript": ["typescript", "tsx"],
        "csharp": ["csharp"],
        "java": ["java"],
    }
    items = list(branches.items())
    head, *tail = items
    return reduce(
        lambda acc, kv: acc.when(language.isin(kv[1]), make(kv[0])),
        tail,
        F.when(language.isin(head[1]), make(head[0])),
    )


def lexemes_of(text: Column, language: Column) -> Column:
    """The text's lexemes by one pattern, or by a scan where one pattern is not enough."""
    pieces = scanned(text, language)
    return F.when(pieces.isNotNull(), F.transform(pieces, lambda p: F.substring(p, F.lit(2), F.length(p)))).otherwise(patterned(text, language))


def patterned(text: Column, language: Column) -> Column:
    return by_language(language, lambda lang: F.regexp_extract_all(text, F.lit(LEXER[lang]), F.lit(0)))


def code_only(text: Column, language: Column) -> Column:
    """A piece of a file with comments, string literals and pattern literals removed."""
    plain = by_language(language, lambda lang: F.regexp_replace(text, LITERAL_OR_COMMENT[lang], " "))
    # The group is what stands before a pattern literal; it is empty for the rest.
    script = F.regexp_replace(text, f"{COMMENT['typescript']}|(?:{STRING['typescript']})|{_TS_REGEX}", "$1 ")
    return F.when(language.isin("typescript", "tsx") & text.contains("/"), script).otherwise(plain)


def lexeme_kind(t: Column, language: Column) -> Column:
    first = F.substring(t, 1, 1)
    return (
        F.when(first.rlike(r"^\s"), "space")
        .when(t.isin("(", "[", "{"), "open")
        .when(t.isin(")", "]", "}"), "close")
        .when(t == ";", "semi")
        .when((language == "python") & (first == "#"), "comment")
        .when((language != "python") & (t.startswith("//") | t.startswith("/*")), "comment")
        .when((F.length(t) > 1) & t.rlike(r"^[A-Za-z$@]{0,3}#*[\"'`]") & t.rlike(r"[\"'`]#*$"), "string")
        .otherwise("code")
    )
