"""Spelling variants: words of a corpus within one edit of each other, and the form each stands for.

A cell is a sorted list of words that are known to agree outside a *zone*: all words of a cell have the same
first ``head`` and the same last ``tail`` characters, and the shorter of two compared words has ``size``
characters. A word scans its cell's list with a banded edit matrix: rows of the characters that a candidate
shares with the one before it (their longest common prefix) are kept, and once a row has no value up to
one, all candidates with that prefix are skipped by one search.

Cells come from halving: a single edit lies in one half of the shorter word, so the two words agree in the
other. The place that decides is the first character in which they differ, which lies in exactly one zone,
so that no pair is found twice. Cells above ``cell_words`` words are halved again, until they are small
or their zone is one character; a common beginning or ending therefore never fills one task, and nothing is
left out.

Words are counted in the tasks that read the texts, in tables cleared at ``TABLE_WORDS`` entries, then summed by Spark.
Each cell sends one row per word that has a near one, not one per pair. Forms are followed to their last by pointer jumping;
a form is at least ten times as frequent as its word, so chains are short.

Defined results: null texts have no words; null ids count as empty in ``damaged``; repeated rows are
counted each; ties of frequency go to the smaller word in code-point order; an empty table gives an empty
table; columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coralint.llm.common import small_batches, stored

MIN_CHARS, MIN_COUNT, RATIO = 7, 2, 10
TABLE_WORDS = 300_000
CELL_WORDS = 20_000
RUNS = re.compile("[A-Za-zÀ-ÿ]+")
_AFTER = "\U0010ffff"


def plain(doc_id, word: str) -> str:
    """The word as it stands."""
    return word


def damaged(doc_id, word: str) -> str:
    """The word, or for one of 31 hashes of id and word the word without one character."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    if h % 31:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


# ------------------------------------------------------------------ words


def _counted(change: Callable[[object, str], str], min_chars: int):
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches):
        table: Counter = Counter()

        def flush():
            yield pa.RecordBatch.from_arrays([pa.array(table.keys(), pa.string()), pa.array(table.values(), pa.int64())], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                # bytes.lower() changes A to Z only.
                lowered = (text.as_py() or "").encode().lower().decode()
                for word, n in Counter(RUNS.findall(lowered)).items():
                    word = change(doc_id, word)
                    if len(word) >= min_chars:
                        table[word] += n
                if len(table) >= TABLE_WORDS:
                    yield from flush()
                    table.clear()
        yield from flush()

    return run


def vocabulary(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    change: Callable[[object, str], str] = plain,
    min_chars: int = MIN_CHARS,
    min_count: int = MIN_COUNT,
) -> DataFrame:
    """(word, n) of all words of at least ``min_chars`` characters that occur ``min_count`` times or more."""
    small_batches(docs.sparkSession)
    parts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).mapInArrow(_counted(change, min_chars), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


# ------------------------------------------------------------------ one cell


def _common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            return n
        n += 1
    return n


def near_in_list(query: str, words: list[str], shared: list[int], start: int = 0) -> Iterator[int]:
    """Places of the sorted ``words`` from ``start`` on that are exactly one edit away from ``query``.

    ``shared[i]`` is the length of the longest common prefix of words i - 1 and i. Row d of the matrix
    holds the distances between d characters of a word and d - 1, d, d + 1 of the query; 2 stands for more than one.
    """
    size, at, depth = len(query), start, 0
    rows = [(2, 0, 1 if size else 2)]
    fresh = True
    while at < len(words):
        word = words[at]
        if not fresh:
            depth = min(depth, shared[at])
            del rows[depth + 1 :]
        fresh = False
        alive = True
        low, mid, high = rows[depth]
        for d in range(depth, min(len(word), size + 1)):
            c = word[d]
            # Distances of d + 1 characters to d, d + 1 and d + 2 of the query.
            new_low = min(mid + 1, low + (query[d - 1] != c) if d else 2, 2)
            new_mid = min(high + 1, mid + (query[d] != c), new_low + 1, 2) if d < size else 2
            new_high = min(high + (query[d + 1] != c), new_mid + 1, 2) if d + 1 < size else 2
            low, mid, high = new_low, new_mid, new_high
            rows.append((low, mid, high))
            depth = d + 1
            if low > 1 and mid > 1 and high > 1:
                alive = False
                break
        if alive and len(word) > size + 1:
            # Longer by two characters or more, and so is all that begins alike.
            depth, alive = size + 1, False
        if not alive:
            at = bisect_left(words, word[:depth] + _AFTER, at + 1)
            depth -= 1
            continue
        last = size - len(word)
        if abs(last) <= 1 and (low, mid, high)[last + 1] == 1:
            yield at
        at += 1


def _cell_links(rows: list[tuple[str, str, int]], size: int, head: int, tail: int) -> Iterator[tuple[str, int, int, str]]:
    """(word, n_near, n, word) of the near ones of a cell's words: their number and the most frequent.

    ``rows`` are (zone, word, n) in order of zones. A pair whose first difference lies behind the zone
    belongs to another cell.
    """
    length = size - head - tail
    same, longer = [r for r in rows if len(r[0]) == length], [r for r in rows if len(r[0]) == length + 1]
    if not same or len(rows) < 2:
        return
    found: dict[str, list] = {}

    def link(a, b):
        for (_, word, _), (_, other, n) in ((a, b), (b, a)):
            entry = found.setdefault(word, [0, 0, ""])
            entry[0] += 1
            if (-n, other) < (-entry[1], entry[2]):
                entry[1:] = n, other

    for others, later in ((same, 1), (longer, 0)):
        zones = [r[0] for r in others]
        shared = [0, *map(_common, zones, zones[1:])]
        for i, r in enumerate(same):
            for j in near_in_list(r[0], zones, shared, (i + 1) * later):
                if not (tail and zones[j].startswith(r[0])):
                    link(r, others[j])
    for word, (count, n, other) in found.items():
        yield word, count, n, other


def _links(batches):
    """Best near words from rows (cell, size, head, tail, zone, word, n), a cell's rows in order of zones."""
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("near_n", pa.int64()), ("near", pa.string())])

    def packed(out):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 4, schema.types)], schema=schema)

    key, rows, out = None, [], []
    for batch in batches:
        for cell, size, head, tail, zone, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            if (cell, size, head, tail) != key:
                if len(rows) > 1:
                    out.extend(_cell_links(rows, *key[1:]))
                key, rows = (cell, size, head, tail), []
            rows.append((zone, word, n))
        if len(out) > 10_000:
            yield packed(out)
            out = []
    if len(rows) > 1:
        out.extend(_cell_links(rows, *key[1:]))
    yield packed(out)


# ------------------------------------------------------------------ cells

_KEY = ["size", "head", "tail", "begins", "ends"]


def _in_cells(words: DataFrame, cells) -> DataFrame:
    """A row (size, head, tail, begins, ends, word, n) for each word and each of its cells (size, head, tail)."""
    rows = words.select("word", "n", F.explode(cells).alias("c")).select("word", "n", "c.size", "c.head", "c.tail")
    return rows.select(
        "size", "head", "tail", F.expr("left(word, head)").alias("begins"), F.expr("right(word, tail)").alias("ends"), "word", "n"
    )


def _halves(words: DataFrame, min_chars: int) -> DataFrame:
    """Each word in the cells of its own size, and of the next smaller, as the longer of two words."""
    cells = F.expr(
        f"""flatten(transform(filter(array(char_length(word), char_length(word) - 1), m -> m >= {int(min_chars)}), m -> array(
              named_struct('size', m, 'head', cast(floor(m / 2) as int), 'tail', 0),
              named_struct('size', m, 'head', 0, 'tail', cast(m - floor(m / 2) as int)))))"""
    )
    return _in_cells(words, cells)


def _halved(rows: DataFrame) -> DataFrame:
    """Rows of large cells in the two halves of their zones."""
    middle = "cast(head + floor((size - head - tail) / 2) as int)"
    cells = F.expr(
        f"array(named_struct('size', size, 'head', {middle}, 'tail', tail), named_struct('size', size, 'head', head, 'tail', size - {middle}))"
    )
    return _in_cells(rows, cells)


def near_words(words: DataFrame, min_chars: int = MIN_CHARS, cell_words: int = CELL_WORDS) -> DataFrame:
    """(word, n_near, near_n, near): words with a near one, how many, and the most frequent of them."""
    rows, done = _halves(words, min_chars), None
    while True:
        large = rows.groupBy(*_KEY).count().filter((F.col("count") > cell_words) & F.expr("size - head - tail > 1")).select(*_KEY)
        large = stored(large, "spelling-large")
        more = large.limit(1).count() > 0
        small = rows.join(large, _KEY, "left_anti") if more else rows
        done = small if done is None else done.unionByName(small)
        if not more:
            break
        rows = stored(_halved(rows.join(large, _KEY, "left_semi")), "spelling-cells")
    zone = F.expr("substring(word, head + 1, char_length(word) - head - tail)")
    cell = F.concat_ws("\n", "size", "head", "tail", "begins", "ends").alias("cell")
    listed = done.select(cell, "size", "head", "tail", zone.alias("zone"), "word", "n")
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = listed.repartition(parts, "cell").sortWithinPartitions("cell", "zone", "word").mapInArrow(_links, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    return links.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.near").alias("near")
    )


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every row of ``forms(word, form)``, by pointer jumping."""
    roots = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        roots = step.select("word", "root")
        if step.filter("moved").limit(1).count() == 0:
            return roots


def variants(words: DataFrame, min_chars: int = MIN_CHARS, ratio: int = RATIO, cell_words: int = CELL_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for a vocabulary ``words(word, n)`` of distinct words.

    The form is the most frequent word within one edit if it is at least ``ratio`` times as frequent; the root
    follows forms to the last.
    """
    words = stored(words.filter(F.char_length("word") >= min_chars), "spelling-words")
    near = near_words(words, min_chars, cell_words)
    form = F.when(F.col("near_n") >= ratio * F.col("n"), F.col("near"))
    judged = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form"), "near_n")
    judged = stored(judged, "spelling-forms")
    roots = _roots(judged.filter("form IS NOT NULL"))
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", F.when(F.col("form").isNotNull(), F.col("near_n")).alias("form_n")
    )
