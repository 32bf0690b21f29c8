"""Statements of whole files, cut in the task that holds them.

Spark deals the files out by ``fid`` and gathers the rows of a key; a task then treats the lexemes of some
megabytes of text as columns. Positions are running sums, the sibling view is one sort by file and level. It
gives the rows that ``lexemes`` and ``tokens`` lead to, without a row, a sort and a window per lexeme in Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coralint.functions.lexer import LEXER
from coralint.functions.modes import CLOSES_EXPRESSION, OPENS_EXPRESSION, needs_scan, scan
from coralint.operators.lexemes import TAIL, TS_NEW_NAME, TS_OPEN_WORD, TS_STATEMENT_WORDS

# Characters of text whose lexemes a task holds as columns at once; a longer file is taken alone.
CHARS_AT_ONCE = 2 << 20

ROLES = ["code", "string", "open", "close", "semi", "regex", "comment", "space", "end"]
CODE, STRING, OPEN, CLOSE, SEMI, REGEX, COMMENT, SPACE, END = range(len(ROLES))
# Letters of scanned pieces; none where the piece itself tells its kind.
_KIND_OF_LETTER = np.full(256, CODE, np.int8)
_KIND_OF_LETTER[0] = -1
for _chars, _kind in (("s", SPACE), ("c", COMMENT), ("t", STRING), ("r", REGEX), ("oi", OPEN), ("xj", CLOSE), (";", SEMI)):
    _KIND_OF_LETTER[list(_chars.encode())] = _kind
_KIND_OF_BYTE = np.full(256, CODE, np.int8)
for _chars, _kind in ((" \t\n\x0b\f\r", SPACE), ("([{", OPEN), (")]}", CLOSE), (";", SEMI)):
    _KIND_OF_BYTE[list(_chars.encode())] = _kind
_OPENS_STRING = re.compile(r"[A-Za-z$@]{0,3}#*[\"'`]")
_CLOSES_STRING = re.compile(r"[\"'`]#*\Z")

_LANGUAGES = list(LEXER)
_PYTHON, _SCRIPTS = _LANGUAGES.index("python"), [_LANGUAGES.index(x) for x in ("typescript", "tsx")]

# The end of a text as the JVM's ``$`` sees it.
_END = r"(?=[\n\r\x85  ]?\Z)"
_STATEMENT_WORDS = re.compile(TS_STATEMENT_WORDS, re.ASCII)
_NEW_NAME = re.compile(TS_NEW_NAME, re.ASCII)
_OPEN_WORD = re.compile(TS_OPEN_WORD.removesuffix("$") + _END, re.ASCII)
# A plain number that is not among the common ones needs a name.
UNCOMMON = r"(?<![\w$.])(?!(?:0|1|2|10|100|1000)(?![0-9]))[0-9]++(?![\w])"
_NUMBER = re.compile(UNCOMMON, re.ASCII)
_VALUE = re.compile(r"[\w$]" + _END, re.ASCII)

_SIB = [("tok", "int"), ("role", "string"), ("text", "string"), *[(c, "int") for c in ("off", "end_off", "row", "row_end", "col", "doc_off")]]
_ROW = (
    f"language string, level int, sid int, sibs array<struct<{','.join(f'{n}:{t}' for n, t in _SIB)}>>, head string, "
    "off int, end_off int, row int, row_end int, col int, braced boolean, prev_end int"
)


@lru_cache(maxsize=8)
def _pattern(language: str):
    return re.compile(LEXER[language].replace(r"\z", r"\Z"), re.ASCII)


def _pieces(file: dict) -> tuple[list[str], str | None]:
    """A file's lexemes; of a scanned file also the letters of their kinds."""
    text, language = file["text"], file["language"]
    if text is None or language not in LEXER:
        return [], None
    if file["scan"]:
        cut = scan(text, language)
        return [p[1:] for p in cut], "".join(p[0] for p in cut)
    pattern = _pattern(language)
    return [m.group() for m in pattern.finditer(text)] if pattern.groups else pattern.findall(text), None


class _Lexemes:
    """Lexemes of several files as columns; the rows of a repeated key count as one file, lexeme by lexeme."""

    def __init__(self):
        self.pieces: list[str] = []
        self.columns: list[list[np.ndarray]] = [[], [], []]

    def add(self, files: list[dict]) -> int:
        cut = [(_pieces(file), _LANGUAGES.index(file["language"]) if file["language"] in LEXER else -1) for file in files]
        sizes = [len(pieces) for (pieces, _), _ in cut]
        tok = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
        lang = np.repeat(np.array([lang for _, lang in cut], np.int8), sizes)
        letters = np.concatenate([np.frombuffer((found or "").encode().ljust(n, b"\0"), np.uint8) for ((_, found), _), n in zip(cut, sizes)])
        pieces = cut[0][0][0] if len(cut) == 1 else list(chain.from_iterable(pieces for (pieces, _), _ in cut))
        if len(cut) > 1:
            order = np.argsort(tok, kind="stable")
            pieces, tok, lang, letters = [pieces[i] for i in order], tok[order], lang[order], letters[order]
        self.pieces += pieces
        for column, values in zip(self.columns, (tok, lang, letters)):
            column.append(values)
        return len(pieces)


def _kinds(kind: np.ndarray, lang: np.ndarray, pieces: list[str], data: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Kinds of the lexemes that one pattern cut, by their first and last characters; the others keep theirs."""
    ends = np.cumsum(size)
    first = data[ends - size]
    found = _KIND_OF_BYTE[first]
    hashes = (lang == _PYTHON) & (first == ord("#"))
    second = data[np.minimum(ends - size + 1, ends - 1)]
    slashes = (lang != _PYTHON) & (first == ord("/")) & (size > 1) & ((second == ord("/")) | (second == ord("*")))
    found[hashes | slashes] = COMMENT
    for i in np.flatnonzero((found == CODE) & (size > 1) & np.isin(data[ends - 1], list(b"\"'`#"))):
        if _OPENS_STRING.match(pieces[i]) and _CLOSES_STRING.search(pieces[i]):
            found[i] = STRING
    return np.where(kind < 0, found, kind)


def _lag(values: np.ndarray, starts: np.ndarray, missing) -> np.ndarray:
    """The value before, ``missing`` at the start of a run."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[starts] = missing
    return out


def _changes(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys starts."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _since_start(running: np.ndarray, starts: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Running sums that begin anew with each run."""
    at = np.flatnonzero(starts)
    return running - np.repeat((running - own)[at], np.diff(np.append(at, len(running))))


def _columns(group: np.ndarray, lexemes: _Lexemes) -> SimpleNamespace:
    """Position, kind and shown text of every lexeme, in order of their files' numbers ``group``."""
    tok, lang, letters = (np.concatenate(column) for column in lexemes.columns)
    pieces = lexemes.pieces
    raw = pa.array(pieces, pa.string())
    size = pc.binary_length(raw).to_numpy().astype(np.int64)
    data = np.frombuffer(raw.buffers()[2], np.uint8)
    kind = _kinds(_KIND_OF_LETTER[letters], lang, pieces, data, size)
    opens, closes = letters == ord("i"), letters == ord("j")
    marked = opens | closes

    # Offsets, rows and depth run over each file.
    starts = _changes(group)
    stop = np.cumsum(size)
    base = np.repeat((stop - size)[starts], np.diff(np.append(np.flatnonzero(starts), len(stop))))
    off = stop - size
    spans_rows = np.isin(kind, [SPACE, COMMENT, STRING]) | marked
    nl = np.where(spans_rows, pc.count_substring(raw, "\n").to_numpy(), 0)
    row_end = _since_start(np.cumsum(nl), starts, nl)
    delta = (kind == OPEN).astype(np.int64) - (kind == CLOSE)
    depth = _since_start(np.cumsum(delta), starts, delta) - (kind == OPEN)
    breaks = np.flatnonzero(data == ord("\n"))
    line_start = np.full(len(stop), -1, np.int64)
    line_start[nl > 0] = breaks[np.searchsorted(breaks, stop[nl > 0]) - 1] + 1
    line_off = np.maximum(_lag(np.maximum.accumulate(line_start), starts, -1), base)
    is_doc = np.zeros(len(stop), bool)
    for i in np.flatnonzero(kind == COMMENT):
        is_doc[i] = pieces[i].startswith(("///", "/**", "//!"))
    doc_off = np.maximum.accumulate(np.where(is_doc, off, -1))
    shown = pc.if_else(pa.array(kind == CODE), pc.utf8_rtrim(raw, " "), raw)
    if marked.any():
        shown = pc.if_else(pa.array(opens), OPENS_EXPRESSION, pc.if_else(pa.array(closes), CLOSES_EXPRESSION, shown))
    end_off = np.where(kind == CODE, off + pc.binary_length(shown).to_numpy(), stop)
    solid = np.flatnonzero((kind != SPACE) & (kind != COMMENT))
    # Positions count from the start of each file.
    return SimpleNamespace(
        group=group, tok=tok, lang=lang, kind=kind, size=size, marked=marked, first=data[off], depth=depth, shown=shown, solid=solid, is_doc=is_doc,
        off=off - base, end_off=end_off - base, row=row_end - nl, row_end=row_end, col=off - line_off, doc_off=doc_off - base,
    )


def _siblings(c: SimpleNamespace) -> SimpleNamespace:
    """The sibling view of the lexemes that are neither blanks nor comments, with the statement each belongs to."""
    # A closing bracket is seen from outside and, as an end, from inside.
    solid = c.solid
    prev_end = _lag(c.end_off[solid], _changes(c.group[solid]), 0)
    closing = c.kind[solid] == CLOSE
    at = np.concatenate([solid, solid[closing]])
    role = np.concatenate([c.kind[solid], np.full(closing.sum(), END, np.int8)])
    prev_end = np.concatenate([prev_end, prev_end[closing]])
    level = c.depth[at] + (role == END)
    order = np.lexsort((at, level, c.group[at]))
    at, role, level, prev_end = at[order], role[order], level[order], prev_end[order]

    # Where a statement starts, by the sibling before.
    seq = _changes(c.group[at], level)
    p_role = _lag(role, seq, -1)
    p_at = _lag(at, seq, 0)
    line_break = c.row[at] > c.row_end[p_at]
    code, python, script = role == CODE, c.lang[at] == _PYTHON, np.isin(c.lang[at], _SCRIPTS)
    # Brackets are lexemes of one character; those of an expression inside a string are shown otherwise.
    shape = np.where((c.size == 1) & ~c.marked, c.first, 0)
    bracket = shape[p_at]
    starting = (p_role == SEMI) | ((p_role == CLOSE) & (bracket == ord("}")))
    open_line = np.flatnonzero(script & ~starting & code & line_break & (p_role >= 0))
    for i, text, before in zip(open_line, *(c.shown.take(pa.array(x[open_line])).to_pylist() for x in (at, p_at))):
        whole = p_role[i] == STRING or bracket[i] == ord("]") or (p_role[i] == CODE and _VALUE.search(before) and not _OPEN_WORD.search(before))
        starting[i] = bool(_STATEMENT_WORDS.match(text) or (whole and _NEW_NAME.match(text)))
    broken = python & (level <= 0) & line_break
    broken[broken & (p_role == CODE)] = ~pc.ends_with(c.shown.take(pa.array(p_at[broken & (p_role == CODE)])), "\\").to_numpy(zero_copy_only=False)
    new = (role != CLOSE) & (seq | (p_role == END) | np.where(python, broken, starting))
    sid = _since_start(np.cumsum(new), seq, new.astype(np.int64))
    return SimpleNamespace(at=at, role=role, level=level, prev_end=prev_end, seq=seq, p_role=p_role, p_at=p_at, new=new, sid=sid, shape=shape)


def _ints(values: np.ndarray, mask=None) -> pa.Array:
    return pa.array(values.astype(np.int32), mask=mask)


def _cut(group: np.ndarray, lexemes: _Lexemes) -> pa.Table | None:
    """Statements of the lexemes; column 0 has the numbers of their files. None of blanks and comments."""
    c = _columns(group, lexemes)
    if not len(c.solid):
        return None
    s = _siblings(c)

    # One row per statement; copies of a file interleave, so their siblings go by number first.
    keep = np.flatnonzero(s.role != END)
    at = s.at[keep]
    keep = keep[np.lexsort((at, c.tok[at], c.lang[at], s.sid[keep], s.level[keep], c.group[at]))]
    at, role, level, sid, prev_end = s.at[keep], s.role[keep], s.level[keep], s.sid[keep], s.prev_end[keep]
    group, lang, tok = c.group[at], c.lang[at], c.tok[at]
    first = np.flatnonzero(_changes(group, level, sid, lang))
    last = np.append(first[1:], len(at)) - 1
    ends = pa.array(np.append(first, len(at)).astype(np.int32))
    text = c.shown.take(pa.array(at))
    names = pa.array(ROLES, pa.string())
    sibs = [_ints(tok), names.take(pa.array(role)), text, *(_ints(x[at]) for x in (c.off, c.end_off, c.row, c.row_end, c.col)),
            _ints(c.doc_off[at], c.doc_off[at] < 0)]
    sibs = pa.StructArray.from_arrays(sibs, [n for n, _ in _SIB])
    head = pc.if_else(pa.array(role == STRING), '""', text)
    # Copies of a file begin a statement with the same number; the last of them tells what ends before.
    tied = np.flatnonzero(_changes(np.repeat(first, last - first + 1), tok))
    tied = np.append(tied[1:], len(at)) - 1
    lead = tied[np.searchsorted(tied, first)]
    columns = {
        "group": pa.array(group[first]),
        "language": pa.array(_LANGUAGES, pa.string()).take(pa.array(lang[first])),
        "level": _ints(level[first]),
        "sid": _ints(sid[first]),
        "sibs": pa.ListArray.from_arrays(ends, sibs),
        "head": pc.binary_join(pa.ListArray.from_arrays(ends, head), " "),
        "off": _ints(c.off[at[first]]),
        "end_off": _ints(c.end_off[at[last]]),
        "row": _ints(c.row[at[first]]),
        "row_end": _ints(c.row_end[at[last]]),
        "col": _ints(c.col[at[first]]),
        "braced": pc.equal(text.take(pa.array(last)), "}"),
        "prev_end": _ints(prev_end[lead]),
    }
    return pa.table(columns)


# Columns of lexemes and tokens, as ``operators.lexemes`` names them.
_LEXEME = "tok int, kind string, text string, off int, end_off int, row int, row_end int, col int, depth int, doc_off int"
_TOKEN = (
    f"{_LEXEME}, prev_end int, role string, level int, tail string, p_role string, p_text string, p_tail string, p_row_end int, n_role string, "
    "n_text string, n2_role string, n2_text string, n3_text string, close_end int, chain struct<off:int,row:int,col:int>, sid int, continues boolean"
)
# What a task gives of the tokens and lexemes of its files.
_GIVEN = {
    "tokens": f"language string, {_TOKEN}",
    # Opening brackets with their neighbours and the beginning of their statement; code that may begin the body of a type.
    "openings": "language string, tok int, sid int, level int, role string, text string, off int, end_off int, p_role string, p_text string, p_tail string, "
    "n2_role string, n2_text string, n3_text string, close_end int, chain struct<off:int,row:int,col:int>, opening string",
    # Code that holds a digit.
    "digits": "language string, tok int, role string, text string, off int, row int, col int",
    # Code with an uncommon number, the statements or bracket groups around one that can be its context, the brackets that hold one.
    "judged": "language string, level int, sid int, tok int, role string, text string, off int, end_off int, row int, col int, p_role string, p_text string, "
    "n_text string, close_end int, opening string, number boolean, context boolean",
    "comments": "language string, off int, row int, col int, text string, is_doc boolean",
    "strings": "language string, off int, row int, col int, text string, before string, after string",
    # Code of scripts with two question marks.
    "nullish": "language string, kind string, text string, off int, row int, col int",
}
_TAIL = re.compile(TAIL.removesuffix("$") + _END, re.ASCII)
_TAILED = re.compile(r"\.|\?|::")


def _matching(c: SimpleNamespace, at: np.ndarray, found) -> np.ndarray:
    """Of the lexemes ``at``, those whose shown text Arrow finds something in."""
    return at[found(c.shown.take(pa.array(at))).to_numpy(zero_copy_only=False)] if len(at) else at


def _tokens(c: SimpleNamespace, s: SimpleNamespace, chosen: np.ndarray, columns: list[str]) -> pa.Table:
    """The chosen rows of the sibling view with the columns asked for."""
    n = len(s.at)
    run = np.cumsum(s.seq)
    roles = pa.array(ROLES, pa.string())

    def near(step: int) -> tuple[np.ndarray, np.ndarray]:
        """The sibling so many steps on, and where there is none."""
        i = np.clip(chosen + step, 0, n - 1)
        return i, (i != chosen + step) | (run[i] != run[chosen])

    def shown(i: np.ndarray, none: np.ndarray | None = None) -> pa.Array:
        return c.shown.take(pa.array(s.at[i], mask=none))

    out: dict[str, pa.Array] = {"group": pa.array(c.group[s.at[chosen]]), "language": pa.array(_LANGUAGES, pa.string()).take(pa.array(c.lang[s.at[chosen]]))}
    at = s.at[chosen]
    for name in ("tok", "off", "end_off", "row", "row_end", "col", "depth"):
        out[name] = _ints(getattr(c, name)[at])
    out |= {"kind": roles.take(pa.array(c.kind[at])), "role": roles.take(pa.array(s.role[chosen])), "text": shown(chosen), "level": _ints(s.level[chosen])}
    out |= {"doc_off": _ints(c.doc_off[at], c.doc_off[at] < 0), "sid": _ints(s.sid[chosen]), "prev_end": _ints(s.prev_end[chosen])}
    for name, step in (("p", -1), ("n", 1), ("n2", 2), ("n3", 3)):
        if {f"{name}_role", f"{name}_text"} & set(columns):
            i, none = near(step)
            out |= {f"{name}_role": roles.take(pa.array(s.role[i], mask=none)), f"{name}_text": shown(i, none)}
    i, none = near(-1)
    out["p_row_end"] = _ints(c.row_end[s.at[i]], none)
    i, none = near(1)
    out["close_end"] = _ints(c.end_off[s.at[i]], none | (s.role[chosen] != OPEN))
    if "opening" in columns:
        out["opening"] = shown(np.maximum.accumulate(np.where(s.new | s.seq, np.arange(n), 0))[chosen])
    if {"tail", "p_tail", "chain", "continues"} & set(columns):
        code = s.role == CODE
        # Only before a bracket or a code that goes on with a chain, and in such a code, does a tail change where a chain starts.
        asked = code if "tail" in columns else code & np.append((s.role[1:] == OPEN) | code[1:], False)
        asked |= code & np.isin(s.p_role, [CODE, CLOSE, STRING]) & np.isin(c.first[s.at], list(b".?:"))
        tails = np.full(n, "", object)
        for k, text in zip(np.flatnonzero(asked), shown(np.flatnonzero(asked)).to_pylist()):
            if m := _TAIL.search(text):
                tails[k] = m.group(1)
        tailed = tails != ""
        p_tailed = _lag(tailed, s.seq, False)
        joined = s.role == CLOSE
        whole = tailed & np.isin(s.p_role, [CODE, CLOSE, STRING])
        for k, text in zip(np.flatnonzero(whole), shown(np.flatnonzero(whole)).to_pylist()):
            joined[k] = tails[k] == text and bool(_TAILED.match(text))
        callee = ((s.p_role == CLOSE) & (s.shape[s.p_at] != ord("}"))) | p_tailed
        joined |= (s.role == OPEN) & (s.shape[s.at] != ord("{")) & callee
        lead = np.zeros(n, np.int64)
        for k, text in zip(np.flatnonzero(tailed), shown(np.flatnonzero(tailed)).to_pylist()):
            lead[k] = len(text.encode()) - len(tails[k].encode())
        begun = np.maximum.accumulate(np.where(joined & ~s.seq, 0, np.arange(n)))
        none = joined[begun][chosen]  # a closing bracket that nothing opened begins no chain
        b = begun[chosen]
        parts = [_ints(c.off[s.at[b]] + lead[b]), _ints(c.row[s.at[b]]), _ints(c.col[s.at[b]] + lead[b])]
        out["chain"] = pa.StructArray.from_arrays(parts, ["off", "row", "col"], mask=pa.array(none))
        out["continues"] = pa.array((joined & code)[chosen])
        i, none = near(-1)
        out |= {"tail": pa.array(tails[chosen], pa.string()), "p_tail": pa.array(np.where(none, None, tails[i]), pa.string())}
    return pa.table({name: out[name] for name in ["group", *columns]})


def _lexed(c: SimpleNamespace, at: np.ndarray, columns: list[str]) -> pa.Table:
    """The lexemes ``at`` with the columns asked for."""
    out = {"group": pa.array(c.group[at]), "language": pa.array(_LANGUAGES, pa.string()).take(pa.array(c.lang[at])), "text": c.shown.take(pa.array(at))}
    out |= {name: _ints(getattr(c, name)[at]) for name in ("off", "row", "col")}
    out |= {"kind": pa.array(ROLES, pa.string()).take(pa.array(c.kind[at])), "is_doc": pa.array(c.is_doc[at])}
    if "before" in columns:
        i, run = np.searchsorted(c.solid, at), np.cumsum(_changes(c.group[c.solid]))
        for name, step in (("before", -1), ("after", 1)):
            j = np.clip(i + step, 0, len(c.solid) - 1)
            none = (j != i + step) | (run[j] != run[i]) | (c.kind[c.solid[j]] != CODE)
            out[name] = c.shown.take(pa.array(c.solid[j], mask=none))
    return pa.table({name: out[name] for name in ["group", *columns]})


def _uncommon(c: SimpleNamespace, code: np.ndarray) -> np.ndarray:
    """Of code lexemes, those with a plain number that is not among the common ones."""
    digits = _matching(c, code, lambda text: pc.match_substring_regex(text, "[0-9]"))
    return digits[[bool(_NUMBER.search(text)) for text in c.shown.take(pa.array(digits)).to_pylist()]] if len(digits) else digits


def _judged(c: SimpleNamespace, s: SimpleNamespace, repeated: np.ndarray, columns: list[str]) -> pa.Table:
    """Rows of code with an uncommon number and those in which the context of one can be seen: around it, the statements of scripts
    that have a colon, the bracket groups of Rust that have an arrow, and all opening brackets.

    Files whose key is ``repeated`` interleave, so all of their rows count.
    """
    rust, script = c.lang[s.at] == _LANGUAGES.index("rust"), np.isin(c.lang[s.at], _SCRIPTS)
    number = np.zeros(len(c.tok), bool)
    number[_uncommon(c, np.flatnonzero(c.kind == CODE))] = True
    held = np.append(0, np.cumsum(number))
    # A bracket group ends with its end; a statement of a script besides where the next one starts.
    ended = s.seq | _lag(s.role == END, s.seq, False)
    cut = np.flatnonzero(ended | (script & s.new))
    last = np.append(cut[1:], len(s.at)) - 1
    sign = np.zeros(len(s.at), bool)
    for rows, mark in ((script, ":"), (rust, "=>")):
        code = np.flatnonzero(rows & (s.role == CODE))
        if len(code):
            sign[code] = pc.match_substring(c.shown.take(pa.array(s.at[code])), mark).to_numpy(zero_copy_only=False)
    signs = np.append(0, np.cumsum(sign))
    wanted = (signs[last + 1] > signs[cut]) & (held[s.at[last] + 1] > held[s.at[cut]])
    context = (rust | script) & (np.repeat(wanted, last - cut + 1) | repeated[s.at])
    # The end of a bracket group tells what its parts stand in.
    inside = np.cumsum(ended) - 1
    context |= (s.role == END) & (np.bincount(inside, context) > 0)[inside]
    # The close is the next sibling; what is never closed holds the rest.
    close = np.append(s.at[1:], 0)
    closed = np.append(~s.seq[1:], False)
    holding = (s.role == OPEN) & (~closed | (held[close] > held[s.at]) | repeated[s.at])
    number = number[s.at] & (s.role == CODE)
    chosen = np.flatnonzero(number | context | holding)
    found = _tokens(c, s, chosen, [x for x in columns if x not in ("number", "context")])
    return found.append_column("number", pa.array(number[chosen])).append_column("context", pa.array(context[chosen]))


def _given(what: str, repeated: np.ndarray, c: SimpleNamespace) -> pa.Table:
    columns = [column.split()[0] for column in _GIVEN[what].split(", ")]
    if what == "comments":
        return _lexed(c, np.flatnonzero(c.kind == COMMENT), columns)
    if what == "strings":
        return _lexed(c, np.flatnonzero(c.kind == STRING), columns)
    if what == "nullish":
        code = np.flatnonzero((c.kind == CODE) & np.isin(c.lang, _SCRIPTS))
        return _lexed(c, _matching(c, code, lambda text: pc.match_substring(text, "??")), columns)
    s = _siblings(c)
    if what == "judged":
        return _judged(c, s, repeated, columns)
    code = np.flatnonzero(c.kind == CODE)
    chosen = np.full(len(c.tok), what == "tokens")
    if what == "openings":
        chosen |= c.kind == OPEN
        chosen[_matching(c, code[np.isin(c.lang[code], _SCRIPTS)], lambda text: pc.match_substring_regex(text, "interface|type"))] = True
    elif what == "digits":
        chosen[_matching(c, code, lambda text: pc.match_substring_regex(text, "[0-9]"))] = True
    return _tokens(c, s, np.flatnonzero(chosen[s.at]), columns)


def _statements(batches: Iterator[pa.RecordBatch], what: str = "statements") -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fids, sizes = batch.column(0), batch.column(2).to_numpy(zero_copy_only=False)
        full = np.cumsum(sizes) // CHARS_AT_ONCE
        bounds = np.append(np.flatnonzero(_changes(full)), len(full))
        for a, b in zip(bounds[:-1], bounds[1:]):
            lexemes = _Lexemes()
            counts = [lexemes.add(files.as_py()) for files in batch.column(1).slice(a, b - a)]
            if not any(counts):
                continue
            group = np.repeat(np.arange(a, b), counts)
            if what == "statements":
                found = _cut(group, lexemes)
            else:
                repeated = np.repeat(pc.list_value_length(batch.column(1).slice(a, b - a)).to_numpy() > 1, counts)
                c = _columns(group, lexemes)
                found = _given(what, repeated, c) if len(c.solid) or what == "comments" else None
            if found is not None and found.num_rows:
                found = found.set_column(0, "fid", fids.take(found.column(0)))
                yield from found.to_batches()


def statements(files: DataFrame) -> DataFrame:
    """One row per statement of the sibling view, with its siblings in order.

    ``head`` is the statement as text with bracket groups emptied, for example ``pub fn name ( ) -> i64 { }``.
    """
    fid = files.schema["fid"].dataType.simpleString()
    return _gathered(files).mapInArrow(_statements, f"fid {fid}, {_ROW}")


def tokens(files: DataFrame, what: str = "tokens") -> DataFrame:
    """The sibling view that ``lexemes.tokens`` gives, or the rows and columns of it or of the lexemes that ``what`` names.

    A task gives the rows asked for only: most facts are made of few of the tokens.
    """
    fid = files.schema["fid"].dataType.simpleString()
    return _gathered(files).mapInArrow(partial(_statements, what=what), f"fid {fid}, {_GIVEN[what]}")


def _gathered(files: DataFrame) -> DataFrame:
    """The files of each key, with the characters of their texts."""
    scanned = needs_scan(F.col("text"), F.col("language"))
    file = F.struct("language", "text", scanned.alias("scan"))
    return files.groupBy("fid").agg(
        F.collect_list(file).alias("files"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("bigint").alias("chars")
    )
