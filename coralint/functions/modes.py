"""Lexing with carried state, for texts that one pattern cannot cut.

Three things depend on what came before: whether a slash divides or opens a pattern literal (by the
previous significant token, and for a closing bracket by the word before the bracket it closes), which
brace ends an expression inside a string (by the depth of the brackets opened since), and how many
block comments are open. A scan keeps a stack of brackets and interpolated strings; everything else is
cut by the same patterns as in ``lexer``.

A scanned piece is a letter for its kind followed by its text:
``s`` space, ``c`` comment, ``t`` string, ``r`` pattern literal, ``o`` open, ``x`` close, ``;`` semicolon, ``k`` code,
``i`` start and ``j`` end of an expression inside a string. What follows such an expression, up to the next one or
to the end of the string, belongs to the piece ``j``; a format after a colon does too.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Words that a value follows; a slash behind any other word divides.
_BEFORE_VALUE = frozenset("return case typeof throw await yield in of new delete void instanceof do else default extends".split())
_CONTROL = frozenset("if while for with".split())
_LAST_WORD = re.compile(r"[\w$]+\Z", re.ASCII)
_PATTERN_LITERAL = re.compile(r"/(?![/*])(?:[^/\\\n\[]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*+\])++/[a-z]*+")
_NESTED = re.compile(r"/\*|\*/")
_FORMAT = re.compile(r":[^{}\"'\n]*+(?=\})")

# Interpolated strings by language: what opens one, and for each its literal text, the expression's
# opening and the closing quotes.
_BRACES = r"\{\{|\}\}"
_OPENERS = {
    "typescript": re.compile("`"),
    "csharp": re.compile(r'(?:\$@|@\$|\$)"(?!"")'),
    "python": re.compile(r"(?:[fFtT][rR]?|[rR][fFtT])(?:\"\"\"|'''|[\"'])"),
    "rust": None,
}


@lru_cache(maxsize=32)
def _string_mode(language: str, opener: str):
    """(literal text, opening of an expression, closing quotes)."""
    if language == "typescript":
        return re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*+"), "${", "`"
    if language == "csharp":
        inner = rf'(?:[^"{{}}]|""|{_BRACES})*+' if "@" in opener else rf'(?:[^"\\{{}}\n]|\\[^\n]|{_BRACES})*+'
        return re.compile(inner), "{", '"'
    quote = opener.lstrip("fFtTrR")
    if len(quote) == 3:
        return re.compile(rf"(?:[^{quote[0]}\\{{}}]|\\[\s\S]|{quote[0]}(?!{quote[0]}{quote[0]})|{_BRACES})*+"), "{", quote
    return re.compile(rf"(?:[^{quote}\\{{}}\n]|\\[\s\S]|{_BRACES})*+"), "{", quote


@lru_cache(maxsize=8)
def _code(language: str):
    from coralint.functions.lexer import COMMENT, STRING

    comment = r"/\*" if language == "rust" else COMMENT[language].replace(r"\z", r"\Z")
    if language == "rust":
        comment = rf"//[^\n]*+|{comment}"
    groups = {
        "c": comment,
        "t": STRING[language].replace(r"\1", "(?P=hashes)").replace("(#*+)", "(?P<hashes>#*+)"),
        "s": r"\s++",
        "o": r"[\[({]",
        "x": r"[\])}]",
        "q": ";",
        "d": "/",
        "k": r"(?:'[A-Za-z_]\w*+(?!')|\w++|[^\w\s\[\](){};\"'/`#$@]|[#$@])" if language == "rust" else r"\w++|[^\w\s\[\](){};\"'/`]",
        "u": r"[\s\S]",
    }
    return re.compile("|".join(f"(?P<{name}>{p})" for name, p in groups.items()), re.ASCII)


def _comment_end(text: str, at: int) -> int:
    """The end of a block comment in which others nest."""
    depth = 0
    for m in _NESTED.finditer(text, at):
        depth += 1 if m.group() == "/*" else -1
        if depth == 0:
            return m.end()
    return len(text)


def scan(text: str, language: str) -> list[str]:
    """The text as pieces, each with the letter of its kind."""
    group = "typescript" if language == "tsx" else language
    code, opener = _code(group), _OPENERS[group]
    script = group == "typescript"
    out: list[str] = []
    # Brackets: True where a value may stand behind the closing one; strings: their mode and the brackets around.
    brackets: list[bool] = []
    strings: list[tuple] = []
    run, at, size = [], 0, len(text)
    value_before = False  # whether the last significant token ends a value
    wanted = False  # whether it is one that an expression goes on with
    word = ""  # that token, when it is a word

    def flush():
        if run:
            out.append("k" + "".join(run))
            run.clear()

    def string_part(letter: str, start: int, at: int) -> int:
        """From ``at`` inside a string to its next expression or its end; the piece begins at ``start``."""
        literal, opening, closing = strings[-1][0]
        end = literal.match(text, at).end()
        if text.startswith(opening, end):
            if end > start:
                out.append(letter + text[start:end])
            out.append("i" + opening)
            return end + len(opening)
        if text.startswith(closing, end):
            end += len(closing)
        out.append(letter + text[start:end])
        strings.pop()
        return end

    while at < size:
        m = opener.match(text, at) if opener is not None else None
        if m is not None and not (run and group == "python" and text[at - 1 : at].isidentifier()):
            flush()
            depth = len(strings) + 1
            strings.append((_string_mode(group, m.group()), len(brackets)))
            at = string_part("t", at, m.end())
            value_before, wanted, word = len(strings) < depth, len(strings) >= depth, ""
            continue
        inside = bool(strings) and strings[-1][1] == len(brackets)
        if inside and not script and text[at] == ":" and (m := _FORMAT.match(text, at)):
            flush()
            depth = len(strings)
            at = string_part("j", at, m.end() + 1)
            value_before, wanted, word = len(strings) < depth, len(strings) >= depth, ""
            continue
        m = code.match(text, at)
        kind, end = m.lastgroup, m.end()
        if kind == "hashes":
            kind = "t"
        if kind == "s":
            blank = run and text[at] in " \t"
            if blank:
                stop = at
                while stop < end and text[stop] in " \t":
                    stop += 1
                run.append(text[at:stop])
                at = stop
                continue
            flush()
            out.append("s" + m.group())
        elif kind == "u":
            # A quote that closes nothing.
            flush()
            out.append("k" + m.group())
            value_before, wanted, word = False, False, ""
        elif kind == "k":
            piece = m.group()
            if piece[0] == "_" or piece[0].isalnum():
                known = _LAST_WORD.search(piece)
                word = known.group() if known else piece
                value_before, wanted = word not in _BEFORE_VALUE, word in _BEFORE_VALUE - {"do", "else", "default"}
            else:
                value_before, word = piece == "$" or (piece in "+-" and run and run[-1] == piece), ""
                wanted = piece in "=,:?&|+-*%<!~^"
            run.append(piece)
        elif kind == "d":
            literal = None
            if script and not value_before and text[at - 1 : at] != "<" and not text.startswith("/>", at):
                literal = _PATTERN_LITERAL.match(text, at)
            if literal:
                flush()
                out.append("r" + literal.group())
                end = literal.end()
                value_before = True
            else:
                run.append("/")
                value_before = False
            wanted, word = not value_before, ""
        elif kind == "c":
            flush()
            if group == "rust" and text.startswith("/*", at):
                end = _comment_end(text, at)
            out.append("c" + text[at:end])
        elif kind == "t":
            flush()
            out.append("t" + m.group())
            value_before, wanted, word = True, False, ""
        elif kind == "o":
            flush()
            out.append("o" + m.group())
            # Behind the closing bracket of a condition and of a block a slash opens a pattern.
            brackets.append(word not in _CONTROL if m.group() == "(" else m.group() == "[" or wanted)
            value_before, wanted, word = False, m.group() != "{", ""
        elif kind == "x":
            flush()
            if inside and m.group() == "}":
                depth = len(strings)
                at = string_part("j", at, end)
                value_before, wanted, word = len(strings) < depth, len(strings) >= depth, ""
                continue
            out.append("x" + m.group())
            value_before, wanted, word = brackets.pop() if brackets else m.group() != "}", False, ""
        else:
            flush()
            out.append(";;")
            value_before, wanted, word = False, False, ""
        at = end
    flush()
    return out


@F.arrow_udf(ArrayType(StringType()))
def _scanned(texts: pa.Array, languages: pa.Array) -> pa.Array:
    ends, parts = [0], [pa.array([], pa.string())]
    for text, language in zip(texts, languages.to_pylist()):
        text = text.as_py()
        # One file at a time becomes a column, so only one is held as Python objects.
        if text is not None:
            parts.append(pa.array(scan(text, language), pa.string()))
        ends.append(ends[-1] + (len(parts[-1]) if text is not None else 0))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(parts), mask=texts.is_null())


# Texts in which a piece depends on what came before.
_SLASH = r"(?<![/*])/(?![/*])"
_INTERPOLATED = r"`[^`]*\$\{"
_NEEDS = {
    "rust": r"/\*(?:[^*/]|\*(?!/)|/(?!\*))*+/\*",
    "csharp": r'(?:\$@|@\$|\$)"(?!"")[^"]*\{',
    "python": r"(?:\b[fFtT][rR]?|\b[rR][fFtT])[\"']",
}


def needs_scan(text: Column, language: Column) -> Column:
    from coralint.functions.lexer import COMMENT, STRING

    # Up to the first slash outside of comments and strings the pattern cuts what the scan would.
    bare_slash = rf"\A(?:[^/\"'`]++|{COMMENT['typescript']}|{STRING['typescript']}|[\"'`])*+/"
    interpolated, slash = (F.regexp_like(text, F.lit(p)) for p in (_INTERPOLATED, _SLASH))
    scripts = language.isin("typescript", "tsx") & (interpolated | (slash & F.regexp_like(text, F.lit(bare_slash))))
    others = [(language == lang) & F.regexp_like(text, F.lit(p)) for lang, p in _NEEDS.items()]
    return F.coalesce(scripts | others[0] | others[1] | others[2], F.lit(False))


def scanned(text: Column, language: Column) -> Column:
    """Pieces of the texts that need a scan, NULL for the others."""
    return _scanned(F.when(needs_scan(text, language), text), language)


def piece_kind(piece: Column) -> Column:
    letters = {"s": "space", "c": "comment", "t": "string", "r": "regex", "o": "open", "x": "close", ";": "semi", "i": "open", "j": "close"}
    first = F.substring(piece, 1, 1)
    kinds = F.create_map(*[F.lit(x) for pair in letters.items() for x in pair])
    return F.coalesce(F.get(F.array(kinds), F.lit(0))[first], F.lit("code"))


# What an expression inside a string begins and ends with in the lexeme table, whatever the language.
OPENS_EXPRESSION, CLOSES_EXPRESSION = "${", "}`"
