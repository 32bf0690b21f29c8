"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, served at most twice. A copy finishes
at the virtual time ``cumulative source words / source target``. All copies are ordered by virtual
finish time and the order is cut where the running total would exceed the total budget.

Scale: the running total of a source is split in two. The shuffle order is a uniform 48-bit number;
its leading bits are the bucket. Bucket totals are summed on the map side and prefix-summed per
source (at most ``BUCKETS`` rows a source), and only the order inside one bucket needs a sort, so a
source with a third of all rows is spread over thousands of groups. The global order is treated
alike: virtual time is cut into fixed ranges, their totals are prefix-summed, and only the range in
which the budget ends is sorted; earlier ranges are taken, later ones left. One row per source
(targets) and ``2 * BUCKETS`` rows (ranges) are all that meets in one task.

Defined results: a null text has size 0; documents of size 0 move no clock and are taken with it
(0 words); a null source is a source of its own, last in order; repeated rows are queued once each;
ties of the shuffle order fall to id, then size, then row hash; an empty table gives an empty
table. Columns ``copy`` and ``finish`` of the input are replaced by those of the mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coralint.llm.common import hash128, stored

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 4096
WEIGHTS = (3, 1, 2)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_order(id_col: Column, seed: str) -> Column:
    """A uniform 48-bit number of the id, the same in every run and engine."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(id_col.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code point order, null last, get the weights in turn. With sources ordered by
    ``size / weight`` those that reach their cap come first, so one pass of running sums finds the
    level at which the rest shares what is left: no iteration is needed.
    """
    # Strings compare by their bytes, which for UTF-8 is code point order.
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("most", F.lit(cap) * F.col("source_size"))
    fill = W.orderBy((F.col("most") / F.col("weight")), F.col("source").asc_nulls_last())
    before, rest = fill.rowsBetween(W.unboundedPreceding, -1), fill.rowsBetween(0, W.unboundedFollowing)
    s = (
        s.withColumn("budget", F.lit(share) * F.sum("source_size").over(W.partitionBy()))
        .withColumn("capped_before", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(rest))
        .withColumn("level", (F.col("budget") - F.col("capped_before")) / F.col("weight_left"))
        .withColumn("full", F.col("most") <= F.col("level") * F.col("weight"))
    )
    # The first source that is not full sets the level of all others.
    level = F.min(F.when(~F.col("full"), F.struct(F.col("most") / F.col("weight"), "level"))).over(W.partitionBy())
    target = F.when(F.col("full"), F.col("most")).otherwise(level["level"] * F.col("weight"))
    return s.select("source", "source_size", target.alias("target"))


def mix_plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    share: float = 1.5,
    cap: float = 2.0,
    weights=WEIGHTS,
    seed: str = "mix-",
) -> DataFrame:
    """Two rows per input row, one for each copy, without the texts.

    Columns: id, source, k1, k2 (hash of the row), twin (1 for the first of equal rows), size,
    source_size, target, copy, finish (virtual time; null where the target is 0), chosen.
    """
    k1, k2 = hash128(F.col(id_col), F.col(source_col), F.col(text_col))
    order = shuffle_order(F.col(id_col), seed)
    sized = stored(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).alias("source"), k1.alias("k1"), k2.alias("k2"),
            word_count(F.col(text_col)).alias("size"), order.alias("nth"),
        ).withColumn("bucket", F.floor(F.col("nth") / F.lit(2**48 // BUCKETS)).cast("int")),
        "mix-sizes",
    )
    totals = sized.groupBy("source", "bucket").agg(F.sum("size").alias("total"))
    targets = stored(
        source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), share, cap, weights), "mix-targets"
    )
    ahead = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.withColumn("start", F.coalesce(F.sum("total").over(ahead), F.lit(0))).alias("t").join(
        targets.alias("g"), F.col("t.source").eqNullSafe(F.col("g.source"))
    ).select(F.col("t.source").alias("s"), F.col("bucket").alias("b"), "start", "source_size", "target")

    inside = W.partitionBy("source", "bucket").orderBy("nth", "id", "size", "k1", "k2")
    queued = stored(
        sized.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
        .withColumn("cum", F.col("start") + F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("twin", F.row_number().over(W.partitionBy("source", "bucket", "nth", "k1", "k2").orderBy("cum")))
        .withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
        .withColumn(
            "finish",
            F.when(F.col("target") > 0, (F.col("cum") + (F.col("copy") - 1) * F.col("source_size")) / F.col("target")),
        )
        # Equal steps of virtual time; all from time 2 on is one last range.
        .withColumn("step", F.least(F.floor(F.coalesce("finish", F.lit(0.0)) * BUCKETS), F.lit(2 * BUCKETS)).cast("int"))
        .drop("bucket", "s", "b", "start", "cum"),
        "mix-queue",
    )
    budget = round(targets.agg(F.sum("target")).first()[0] or 0)
    earlier = W.orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    cut = (
        queued.groupBy("step")
        .agg(F.sum("size").alias("total"))
        .withColumn("room", F.lit(budget) - F.coalesce(F.sum("total").over(earlier), F.lit(0)))
    )
    # At most 2 * BUCKETS + 1 rows whatever the input.
    placed = queued.join(F.broadcast(cut), "step")
    whole = F.col("total") <= F.col("room")
    service = W.partitionBy("step").orderBy("finish", F.col("source").asc_nulls_last(), "copy", "nth", "id", "size", "k1", "k2")
    running = F.sum("size").over(service.rowsBetween(W.unboundedPreceding, 0))
    done = placed.filter(whole | (F.col("room") <= 0)).withColumn("chosen", whole)
    last = placed.filter(~whole & (F.col("room") > 0)).withColumn("chosen", running <= F.col("room"))
    return done.unionByName(last).drop("step", "total", "room")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, once per copy taken, with copy and finish.

    Order by finish to read the mix in service order.
    """
    plan = mix_plan(docs, id_col, text_col, source_col, **options).filter("chosen")
    k1, k2 = hash128(F.col(id_col), F.col(source_col), F.col(text_col))
    rows = docs.drop("copy", "finish").withColumn("__k1", k1).withColumn("__k2", k2)
    rows = rows.withColumn("__twin", F.row_number().over(W.partitionBy("__k1", "__k2").orderBy(F.lit(0))))
    taken = plan.select(
        F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("twin").alias("__twin"), "copy", "finish"
    )
    return rows.join(taken, ["__k1", "__k2", "__twin"]).drop("__k1", "__k2", "__twin")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size,
         ('0x' || substr(md5('mix-' || coalesce(cast(doc_id AS VARCHAR), 'null')), 1, 12))::BIGINT AS nth
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM sized GROUP BY source),
filled AS (
  SELECT *, 2.0::DOUBLE * source_size AS most, 1.5::DOUBLE * sum(source_size) OVER () AS budget,
         coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST
                  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
  FROM sources),
levels AS (SELECT *, (budget - capped) / weight_left AS level FROM filled),
free AS (SELECT level FROM levels WHERE most > level * weight ORDER BY most / weight, source NULLS LAST LIMIT 1),
targets AS (
  SELECT source, source_size,
         CASE WHEN most <= level * weight THEN most ELSE (SELECT level FROM free) * weight END AS target FROM levels),
queued AS (
  SELECT s.doc_id, s.source, s.size, s.nth, t.source_size, t.target, c.copy,
         (sum(s.size) OVER (PARTITION BY s.source, c.copy ORDER BY nth, doc_id ROWS UNBOUNDED PRECEDING)
          + (c.copy - 1) * t.source_size)::DOUBLE / nullif(t.target, 0) AS finish
  FROM sized s JOIN targets t ON t.source IS NOT DISTINCT FROM s.source, (VALUES (1), (2)) c(copy)),
served AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, copy, nth, doc_id ROWS UNBOUNDED PRECEDING) AS served
  FROM queued)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       coalesce(sum(size) FILTER (WHERE served <= (SELECT round(sum(target)) FROM targets)), 0)::BIGINT AS taken
FROM served GROUP BY doc_id, size, source_size, target
"""
