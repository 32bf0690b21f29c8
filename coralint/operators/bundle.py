"""``Facts``: the fact tables of one corpus, built on demand and shared by the detectors."""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coralint.functions.lexer import LANGUAGES
from coralint.functions.text import all_of, contains_any
from coralint.operators import facts as X
from coralint.operators import lexemes as L
from coralint.operators import statements as S
from coralint.session import absolute_path, delete_folder, partitions_for

# Estimated table bytes per partition; a byte of text becomes some thirty bytes of facts.
BYTES_PER_PARTITION = 32 << 20


def _merged(df: DataFrame) -> DataFrame:
    """The table, never sent whole to the driver and to every executor by a join.

    Spark judges a stored table by its bytes on disk, where source text takes a small part of what it takes in
    memory, and a text made by an expression by a fixed guess; both let it broadcast the texts of a corpus.
    """
    return df.hint("merge")


class Facts:
    """Lazy fact tables over ``files(fid, language, text, ..)``.

    ``clustered`` promises that ``files`` is already hash-partitioned by ``fid``;
    otherwise the file texts are shuffled once here and nothing derived from them
    is shuffled again.

    With ``store``, a folder all executors reach, the tables several detectors
    share are written there once as Parquet bucketed by ``fid``. Reading them
    back keeps the partitioning (no shuffle before windows and joins on ``fid``),
    prunes columns, gives every detector a short plan and survives lost executors
    without recomputation. Statements, brackets and literals are cut from the texts, so the
    lexemes and tokens that lead to them are not written. Without a store every use is computed from the text.
    """

    def __init__(
        self,
        files: DataFrame,
        clustered: bool = False,
        store: str | None = None,
        partitions: int | None = None,
        holding: Column | None = None,
    ):
        # A fixed number: compressed text is small against the rows it expands to, so
        # coalescing by shuffle size would make partitions far too large.
        conf = files.sparkSession.conf
        wanted = partitions or partitions_for(files, BYTES_PER_PARTITION)
        self.partitions = min(wanted, int(conf.get("spark.sql.sources.bucketing.maxBuckets")))
        if not clustered:
            files = files.repartition(self.partitions, "fid")
        self._id = uuid.uuid4().hex[:12]
        self.store = f"{absolute_path(files.sparkSession, store)}/{self._id}" if store else None
        self._tables: list[str] = []
        self._source = files
        self._holding = holding
        self._parts: dict[tuple, Facts] = {}

    def among(self, languages: list[str], *groups: list[str]) -> "Facts":
        """Facts of the files in ``languages`` whose text holds a fragment of each group.

        For a detector that reports nothing in the others, so that they are neither cut nor stored. The
        facts themselves where their tables are there already or nothing is stored.
        """
        if not self.store or self._holding is not None or {"lexemes", "openings", "statements"} & self.__dict__.keys():
            return self
        key = (tuple(sorted(languages)), tuple(tuple(g) for g in groups))
        if key not in self._parts:
            base = self.files if "files" in self.__dict__ else self._source
            holding = all_of([contains_any(F.col("text"), g) for g in groups]) if groups else F.lit(True)
            chosen = base.where(F.col("language").isin(list(languages)))
            self._parts[key] = Facts(chosen, True, self.store, self.partitions, holding)
        return self._parts[key]

    def dealt(self, n: int, folder: str) -> list[DataFrame]:
        """The files in ``n`` slices; all rows of a ``fid`` are in one of them.

        The texts are written once to ``folder``, dealt out by slice, so reading a slice reads no other.
        """
        spark, each = self._source.sparkSession, -(-self.partitions // n)
        files = self.files.withColumn("__slice", F.pmod(F.xxhash64("fid"), F.lit(n)).cast("int"))
        # Dealt by slice and a number within it, a task writes few slices.
        files = files.repartition(self.partitions, "__slice", F.pmod(F.xxhash64("fid", F.lit(0)), F.lit(each)))
        files.write.partitionBy("__slice").option("compression", "zstd").parquet(folder)
        written = spark.read.schema(files.schema).parquet(folder)
        return [written.where(F.col("__slice") == i).drop("__slice") for i in range(n)]

    def _shared(self, name: str, df: DataFrame) -> DataFrame:
        if not self.store:
            return df
        table = f"coralint_{self._id}_{name}"
        # One bucket per partition: the hash is the same, so every task writes one file.
        df.write.bucketBy(self.partitions, "fid").format("parquet").option("compression", "zstd").option(
            "path", f"{self.store}/{name}"
        ).saveAsTable(table)
        self._tables.append(table)
        return _merged(df.sparkSession.table(table))

    def __enter__(self) -> "Facts":
        return self

    def __exit__(self, *exc) -> None:
        self.release()

    def release(self) -> None:
        """Drop the stored tables and delete their folder; nothing derived from them can be read any more."""
        spark = self._source.sparkSession
        for part in self._parts.values():
            part.release()
        self._parts.clear()
        for table in self._tables:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        self._tables.clear()
        if self.store:
            delete_folder(spark, self.store)

    @cached_property
    def files(self) -> DataFrame:
        files = _merged(self._shared("files", self._source))
        return files if self._holding is None else files.where(self._holding)

    @cached_property
    def lines(self) -> DataFrame:
        return L.lines(self.files)

    def _ready(self, name: str, compute) -> DataFrame:
        """A table if it is there already, else its rows computed on the way, without storing them."""
        return getattr(self, name) if name in self.__dict__ else compute()

    def _lexed(self) -> DataFrame:
        return L.lexemes(self.files, self.partitions)

    def _given(self, what: str) -> DataFrame:
        """Rows of the lexemes or tokens that some facts are made of; the task that cuts a file gives no others."""
        return S.tokens(self.files, what)

    @cached_property
    def lexemes(self) -> DataFrame:
        return self._shared("lexemes", self._lexed())

    @cached_property
    def comments(self) -> DataFrame:
        return L.comments(self.lexemes) if "lexemes" in self.__dict__ else self._given("comments")

    @cached_property
    def strings(self) -> DataFrame:
        return self._shared("strings", L.string_literals(self.lexemes) if "lexemes" in self.__dict__ else self._given("strings"))

    @cached_property
    def tokens(self) -> DataFrame:
        """All tokens, computed by every use; facts and rules read the few that they are made of."""
        return self._given("tokens")

    @cached_property
    def openings(self) -> DataFrame:
        """The opening brackets among the tokens, and the code that may begin the body of a type."""
        found = self._given("openings")
        return self._shared("openings", found.select("fid", *[c for c in self.tokens.columns[1:] if c in found.columns], "opening"))

    @cached_property
    def judged(self) -> DataFrame:
        """Code with uncommon numbers and what can be their context."""
        return self._shared("judged", self._given("judged"))

    @cached_property
    def numbers(self) -> DataFrame:
        return X.number_literals(self._given("digits"))

    @cached_property
    def statements(self) -> DataFrame:
        return self._shared("statements", S.statements(self.files))

    @cached_property
    def blocks(self) -> DataFrame:
        return self._shared("blocks", self._blocked())

    def _blocked(self) -> DataFrame:
        return X.blocks(self.statements)

    @cached_property
    def _function_rows(self) -> DataFrame:
        return self._shared("function_rows", X.function_rows(self.statements, self._ready("blocks", self._blocked)))

    @cached_property
    def function_spans(self) -> DataFrame:
        """Functions without their texts, a row for each file of their key."""
        return self._function_rows.join(self.files.select("fid"), "fid")

    @cached_property
    def functions(self) -> DataFrame:
        return self._shared("functions", X.functions(self._function_rows, self.files))

    def functions_where(self, condition: Column) -> DataFrame:
        """Some of the functions; texts are cut and stored for all of them only where others read them."""
        if "functions" in self.__dict__:
            return self.functions.where(condition)
        return X.functions(self._function_rows.where(condition), self.files)

    def _listed(self) -> DataFrame:
        rows = self._function_rows.where("params_from IS NOT NULL AND params_to IS NOT NULL")
        return X.with_slices(rows.select("fid", "language", "off", "params_from", "params_to"), self.files, X.PARAMS_TEXT)

    @cached_property
    def params(self) -> DataFrame:
        return self._shared("params", X.params(self._ready("functions", self._listed)))

    @cached_property
    def catches(self) -> DataFrame:
        return self._shared("catches", X.catches(self.statements, self._ready("blocks", self._blocked), self.files))

    @cached_property
    def calls(self) -> DataFrame:
        return self._shared("calls", X.calls(self.openings))

    @cached_property
    def imports(self) -> DataFrame:
        return X.imports(self.statements, self.files)

    @cached_property
    def identifiers(self) -> DataFrame:
        return X.identifiers(self.files)

    def _looped(self) -> DataFrame:
        some = self.among(LANGUAGES, X.LOOP_WORDS)
        return X.loops(some.statements, some._ready("blocks", some._blocked), some.files)

    @cached_property
    def loops(self) -> DataFrame:
        return self._shared("loops", self._looped())

    def unstored(self, name: str) -> DataFrame:
        """Blocks or loops for a reader of little of them: the table if it is there already, else computed on the way."""
        return self._ready(name, {"blocks": self._blocked, "loops": self._looped}[name])

    @cached_property
    def types(self) -> DataFrame:
        return self._shared("types", X.type_facts(self.statements))

    @cached_property
    def async_names(self) -> DataFrame:
        return self._shared("async_names", X.async_names(self.statements, self.files))
