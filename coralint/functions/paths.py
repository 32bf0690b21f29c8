"""Path predicates: language by extension, components, test files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from coralint.functions.text import any_of

# File extension to language name (case-sensitive).
EXTENSIONS = {
    "rs": "rust",
    "py": "python",
    "ts": "typescript",
    "tsx": "tsx",
    "cs": "csharp",
    "java": "java",
}

# Component names that mark a test directory.
TEST_DIRS = ["tests", "test", "__tests__"]


def components(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda c: (c != "") & (c != "."))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def language_of(path: Column) -> Column:
    """Language, or NULL when the extension is not a source extension."""
    ext = F.regexp_extract(file_name(path), r"^.+\.([^.]+)$", 1)
    table = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return F.try_element_at(table, ext)


def is_test_path(path: Column, variant: str = "long") -> Column:
    """Test-file predicate. ``short`` leaves out the four C# / Java name endings."""
    name = F.lower(file_name(path))
    conds = [
        F.exists(components(path), lambda c: F.lower(c).isin(TEST_DIRS)),
        name.startswith("test_"),
        name.startswith("test."),
        name.contains("_test."),
        name.contains(".test."),
        name.contains(".spec."),
    ]
    if variant == "long":
        conds += [name.endswith(e) for e in ("tests.cs", "test.cs", "test.java", "tests.java")]
    elif variant != "short":
        raise ValueError(f"unknown variant: {variant}")
    return any_of(conds)
