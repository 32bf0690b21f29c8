"""Corpus scan and scan filters: files in, files and their status out."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coralint.functions.paths import EXTENSIONS, components, file_name, language_of
from coralint.session import ensure_checkpoint_dir

# Names excluded wherever they occur on a path; configuration only adds to them.
DEFAULT_EXCLUDES = [
    "node_modules", "target", "obj", "bin", "dist", "build", "out", ".git", ".vscode", ".idea", "__pycache__",
    ".pytest_cache", "vendor", ".next", ".nuxt", "coverage", ".cache",
]

IGNORE_FILE = ".gitignore"


def _component_matches(component: Column, pattern: str) -> Column:
    """``*suffix`` matches the end of a name, anything else the whole name."""
    pattern = pattern.rstrip("/")
    if pattern.startswith("*"):
        return component.endswith(pattern[1:])
    return component == pattern


def exclude_paths(files: DataFrame, patterns: list[str] | None = None, path: str = "path") -> DataFrame:
    """Drop files with an excluded path component: the built-in names plus ``patterns``."""
    own = list(patterns or [])

    def excluded(c: Column) -> Column:
        cond = c.isin(DEFAULT_EXCLUDES)
        for p in own:
            cond = cond | _component_matches(c, p)
        return cond

    return files.where(~F.exists(components(F.col(path)), excluded))


def with_language(files: DataFrame) -> DataFrame:
    """Assign the language by extension and drop other files."""
    return files.withColumn("language", language_of(F.col("path"))).where(F.col("language").isNotNull())


def parse_ignore_files(ignore_files: DataFrame) -> DataFrame:
    """``(repo, dir, pattern)`` from ``(repo, dir, text)``.

    Blank lines, comments, negations and patterns with ``**`` or an inner slash are skipped.
    """
    trimmed = F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    rows = ignore_files.select("repo", "dir", F.explode(trimmed).alias("raw")).where(
        (F.col("raw") != "") & ~F.col("raw").startswith("#") & ~F.col("raw").startswith("!")
    )
    pattern = F.regexp_replace(F.regexp_replace("raw", "^/+", ""), "/+$", "")
    return rows.select("repo", "dir", pattern.alias("pattern")).where(
        ~F.col("pattern").contains("**") & ~F.col("pattern").contains("/")
    )


def _matches(component: Column, patterns: Column) -> Column:
    """A name against ignore patterns: ``*suffix`` or the whole name."""
    return F.exists(
        patterns,
        lambda p: F.when(p.startswith("*"), F.endswith(component, F.substring(p, 2, F.length(p)))).otherwise(component == p),
    )


def ignored_directories(dirs: DataFrame, ignore_rules: DataFrame) -> DataFrame:
    """``(repo, dir, patterns, ignored)`` of the directories that ignore rules reach, from distinct ``(repo, dir)``.

    Level by level, each directory joins the one above it: it takes over that one's patterns, adds its
    own, and is ignored if the one above is, or if an inherited pattern matches its name.
    """
    ensure_checkpoint_dir(dirs.sparkSession)
    parts = F.when(F.col("dir") == "", F.array().cast("array<string>")).otherwise(F.split("dir", "/"))
    ups = F.transform(F.sequence(F.lit(0), F.size("parts")), lambda n: F.slice("parts", 1, n))
    known = (
        dirs.select("repo", parts.alias("parts"))
        .select("repo", F.explode(ups).alias("parts"))
        .distinct()
        .select(
            "repo",
            F.array_join("parts", "/").alias("dir"),
            F.size("parts").alias("depth"),
            F.array_join(F.slice("parts", 1, F.greatest(F.size("parts") - 1, F.lit(0))), "/").alias("above"),
            F.try_element_at("parts", F.lit(-1)).alias("own"),
        )
    )
    own = ignore_rules.groupBy("repo", "dir").agg(F.collect_set("pattern").alias("added"))
    known = known.join(own, ["repo", "dir"], "left").checkpoint()
    none = F.array().cast("array<string>")
    deepest = known.agg(F.max("depth")).first()[0]
    levels: list[DataFrame] = []
    for depth in range(0 if deepest is None else deepest + 1):
        level = known.where(F.col("depth") == depth)
        if levels:
            above = levels[-1].select("repo", F.col("dir").alias("above"), "patterns", "ignored")
            level = level.join(above, ["repo", "above"], "left")
        else:
            level = level.withColumns({"patterns": none, "ignored": F.lit(False)})
        inherited = F.coalesce("patterns", none)
        ignored = F.coalesce("ignored", F.lit(False)) | F.coalesce(_matches(F.col("own"), inherited), F.lit(False))
        level = level.select(
            "repo", "dir", F.array_union(inherited, F.coalesce("added", none)).alias("patterns"), ignored.alias("ignored")
        )
        levels.append(level.where(F.col("ignored") | (F.size("patterns") > 0)).checkpoint())
    if not levels:
        return known.select("repo", "dir", none.alias("patterns"), F.lit(False).alias("ignored"))
    return reduce(DataFrame.unionByName, levels)


def exclude_by_ignore(files: DataFrame, ignore_rules: DataFrame) -> DataFrame:
    """Drop files matched by an ignore rule of a directory above them.

    What the rules say is worked out once for each distinct directory; a file joins its own directory
    only. Few directories are broadcast; many are joined by directory, where adaptive skew join splits
    one that holds very many files.
    """
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit(""))
    placed = files.withColumn("__dir", folder)
    state = ignored_directories(placed.select("repo", F.col("__dir").alias("dir")).distinct(), ignore_rules).select(
        F.col("repo").alias("__repo"), F.col("dir").alias("__at"), F.col("patterns").alias("__patterns"), F.col("ignored").alias("__ignored")
    )
    joined = placed.join(state, (F.col("repo") == F.col("__repo")) & (F.col("__dir") == F.col("__at")), "left")
    hit = F.col("__ignored") | _matches(file_name(F.col("path")), F.col("__patterns"))
    return joined.where(~F.coalesce(hit, F.lit(False))).select(*files.columns)


def _status(raw: DataFrame) -> DataFrame:
    """Raw files with ``language``, ``text`` and ``error``; a file with an error is skipped."""
    text = F.col("content").cast("string")
    ext = F.regexp_extract(file_name(F.col("path")), r"\.([^.]*)$", 1)
    lang = language_of(F.col("path"))
    error = (
        F.when(lang.isNull(), F.concat(F.lit("unsupported file extension: "), ext))
        .when(F.col("read_error").isNotNull(), F.concat(F.lit("io error: "), F.col("read_error")))
        .when(F.col("content").isNull(), F.lit("io error: no content"))
        .when(~F.is_valid_utf8(text), F.lit("io error: not valid UTF-8"))
    )
    return raw.withColumn("language", lang).withColumn("error", error)


def split_status(raw: DataFrame, store: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(files, file_status)`` from raw files with binary content.

    The file key is a 128-bit hash of repository, snapshot and path. With ``store`` the rows are written
    there once and both results read them, the status without the texts.
    """
    if "read_error" not in raw.columns:
        raw = raw.withColumn("read_error", F.lit(None).cast("string"))
    checked = _status(raw).withColumn("fid", F.md5(F.concat_ws("\u0001", "repo", "snapshot", "path")))
    text = F.when(F.col("error").isNull(), F.col("content").cast("string")).alias("text")
    checked = checked.select("fid", "repo", "snapshot", "path", "language", text, "error")
    if store:
        checked.write.mode("overwrite").parquet(store)
        checked = raw.sparkSession.read.schema(checked.schema).parquet(store)
    files = checked.where(F.col("error").isNull()).select(
        "fid", "repo", "snapshot", "path", file_name(F.col("path")).alias("name"), "language", "text"
    )
    status = checked.select(
        "fid", "path", F.when(F.col("error").isNull(), "scanned").otherwise("skipped").alias("status"), "error"
    )
    return files, status


# Contents a task gathers before it hands them on.
_READ_BYTES = 16 << 20
_LISTING = "path string, is_dir boolean"


def _open_fs(path: str):
    """File system and inner path; local paths are taken literally, so they may hold spaces."""
    from pyarrow import fs

    if path.startswith("file://"):
        return fs.LocalFileSystem(), path[len("file://") :]
    return fs.FileSystem.from_uri(path)


def _list_dirs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for pdf in batches:
        for path in pdf["path"]:
            store, inner = _open_fs(path)
            entries = store.get_file_info(fs.FileSelector(inner, allow_not_found=True))
            prefix = path.rstrip("/") + "/"
            yield pd.DataFrame(
                {
                    "path": [prefix + e.base_name for e in entries],
                    "is_dir": [e.type == fs.FileType.Directory for e in entries],
                }
            ).astype({"path": "string", "is_dir": "bool"})


def _read_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["path", "content", "read_error"]
    for pdf in batches:
        rows, size = [], 0
        for full, path in zip(pdf["full"], pdf["path"]):
            try:
                store, inner = _open_fs(full)
                with store.open_input_stream(inner) as f:
                    rows.append((path, f.read(), None))
                    size += len(rows[-1][1])
            except OSError as e:
                rows.append((path, None, str(e)))
            if size >= _READ_BYTES:
                yield pd.DataFrame(rows, columns=columns)
                rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns)


def _uri(path: str) -> str:
    import os

    return path if "://" in path else "file://" + os.path.abspath(path)


def _walk(spark: SparkSession, root: str, patterns: list[str]) -> DataFrame:
    """All files below ``root``, one job per directory level; excluded directories are not entered.

    Spark's own file index hides names that start with ``_`` or ``.``, and
    packages keep sources there (``__init__.py``, ``__tests__``), so the listing
    is done by tasks.
    """
    ensure_checkpoint_dir(spark)
    frontier = spark.createDataFrame([(root,)], "path string")
    found: list[DataFrame] = []
    while True:
        level = frontier.mapInPandas(_list_dirs, _LISTING).withColumn("own", F.substring_index("path", "/", -1))
        level = exclude_paths(level, patterns, "own").drop("own").checkpoint()
        found.append(level.where(~F.col("is_dir")).select("path"))
        frontier = level.where("is_dir").select("path").repartition(spark.sparkContext.defaultParallelism, "path")
        if frontier.isEmpty():
            break
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def scan(
    spark: SparkSession,
    path: str,
    repo: str = "",
    snapshot: str = "",
    exclude: list[str] | None = None,
    use_ignore_files: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Source files below a directory, or one file, as ``(files, file_status)``.

    Paths in the result are relative to the scanned directory. A file named
    directly skips the exclusions; with an unknown extension it becomes a skip.
    Every file is read once, by this call: rows are kept below the checkpoint folder, so that
    files and status tell of one state of the directory and no review reads it again.
    """
    from pyarrow import fs

    root = _uri(path).rstrip("/")
    store, inner = _open_fs(root)
    info = store.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(f"path not found: {path}")
    raw_schema = "path string, content binary, read_error string"
    store = f"{ensure_checkpoint_dir(spark)}/scan-{uuid.uuid4().hex}"
    if info.type == fs.FileType.File:
        listed = spark.createDataFrame([(root, root.rsplit("/", 1)[-1])], "full string, path string")
        raw = listed.mapInPandas(_read_files, raw_schema)
        return split_status(raw.withColumn("repo", F.lit(repo)).withColumn("snapshot", F.lit(snapshot)), store)
    listing = _walk(spark, root, exclude or []).select(
        F.col("path").alias("full"), F.substring(F.col("path"), len(root) + 2, 1 << 20).alias("path")
    )
    sources = listing.where(language_of(F.col("path")).isNotNull())
    if use_ignore_files:
        ignore = listing.where(file_name(F.col("path")) == IGNORE_FILE).mapInPandas(_read_files, raw_schema)
        texts = ignore.select(
            F.lit(repo).alias("repo"),
            F.regexp_replace("path", r"/?[^/]*$", "").alias("dir"),
            F.col("content").cast("string").alias("text"),
        )
        keyed = sources.withColumn("repo", F.lit(repo))
        sources = exclude_by_ignore(keyed, parse_ignore_files(texts)).drop("repo")
    spread = sources.repartition("full")
    raw = spread.mapInPandas(_read_files, raw_schema)
    return split_status(raw.withColumn("repo", F.lit(repo)).withColumn("snapshot", F.lit(snapshot)), store)


def scan_table(
    table: DataFrame, exclude: list[str] | None = None, ignore_rules: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """The same from a table with ``path`` and ``text`` or ``content``; the usual form at scale.

    Paths are relative to the repository, so that only names inside it are excluded.
    """
    raw = table
    if "content" not in raw.columns:
        raw = raw.withColumn("content", F.col("text").cast("binary"))
    for c in ("repo", "snapshot"):
        if c not in raw.columns:
            raw = raw.withColumn(c, F.lit(""))
    raw = exclude_paths(raw.where(language_of(F.col("path")).isNotNull()), exclude)
    if ignore_rules is not None:
        raw = exclude_by_ignore(raw, ignore_rules)
    return split_status(raw.select("repo", "snapshot", "path", "content"))


def scan_binary(spark: SparkSession, path: str, repo: str = "", snapshot: str = "", exclude: list[str] | None = None):
    """``binaryFile`` scan: the extension filter is pushed into the listing; hidden names are left out."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", "*.{" + ",".join(EXTENSIONS) + "}")
    root = _uri(path).rstrip("/")
    relative = F.regexp_replace(F.expr("url_decode(path)"), r"^[a-z0-9]+:/+", "/")
    base = "/" + root.split("://", 1)[1].lstrip("/") + "/"
    raw = reader.load(root).select(F.replace(relative, F.lit(base), F.lit("")).alias("path"), "content")
    raw = exclude_paths(raw, exclude)
    return split_status(raw.withColumn("repo", F.lit(repo)).withColumn("snapshot", F.lit(snapshot)))
