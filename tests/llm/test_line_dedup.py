import pytest

from coralint.llm.line_dedup import line_dedup

SHARED = "This line is shared by documents"


def brute(rows, min_chars=20, min_docs=3):
    blanks = " \t\n\x0b\x0c\r"
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(blanks))
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(i)
    rank = lambda i: (i is not None, i or 0)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        gone = [len(holders.get(key(x), ())) >= min_docs and max(holders[key(x)], key=rank) != i for x in lines]
        kept = "\n".join(x for x, g in zip(lines, gone) if not g)
        out.append((i, text if not any(gone) else kept, len(lines), sum(gone)))
    return sorted(out, key=str)


CASES = {
    "shared": [(1, f"a\n{SHARED}\nb"), (2, f"{SHARED.upper()}\nc"), (3, f"\t{SHARED} \r\nd\n"), (4, "short\nshort")],
    "odd": [(1, None), (2, ""), (None, SHARED), (5, f"{SHARED}\n{SHARED}"), (6, SHARED), (7, f"\n\n{SHARED}\n"), (8, "é" * 19), (9, "É" * 20), (10, "É" * 20), (11, "É" * 20)],
    "repeated": [(1, SHARED), (1, SHARED), (2, SHARED), (2, f"{SHARED}\nother text"), (3, "x" * 50_000 + f"\n{SHARED}")],
    "empty": [],
}


@pytest.mark.parametrize("name", CASES)
def test_against_brute_force(spark, name):
    rows = CASES[name]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in line_dedup(df).select("doc_id", "text", "n_lines", "n_dropped").collect()), key=str)
    assert got == brute(rows)


def test_other_columns_stay_and_result_columns_are_replaced(spark):
    df = spark.createDataFrame([(i, SHARED, "x", 9, "k") for i in range(4)], "doc_id long, text string, pos string, n_lines int, `__h` string")
    out = line_dedup(df)
    assert sorted(out.columns) == sorted(["doc_id", "text", "pos", "__h", "n_lines", "n_dropped"])
    assert {(r.doc_id, r.pos, r.n_lines, r.n_dropped) for r in out.collect()} == {(i, "x", 1, int(i < 3)) for i in range(4)}
