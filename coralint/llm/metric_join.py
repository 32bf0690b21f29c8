"""Embedding near-dedup: an exact range join in metric cells.

Vectors are scaled to length 1, where a cosine of at least c is a distance of at most
``sqrt(2 - 2c)``. Pivots split the space: a vector's home is the cell of its nearest pivot. By the
triangle inequality a neighbour of a home vector lies within the radius of the border between the two
cells, that is ``(d(x, q)^2 - d(x, p)^2) / (2 d(p, q)) <= radius`` for home p and other cell q, so
every vector is copied to exactly the cells whose border is that near. Each cell then finds all
neighbours of its home vectors alone, and every pair is counted once from each side.

Equal vectors are one class with a count, so copies are never compared or expanded.

Scale: a cell's home vectors are dealt into chunks of at most about ``CHUNK``; a task holds one
chunk and streams the cell's members past it in Arrow batches, so a hot cell is many tasks of
bounded memory. A chunk gives one edge per linked member, never all pairs. Pivots come from a
sample of at most ``MAX_PIVOTS`` vectors, which bounds what is broadcast. Copies depend on the data:
for vectors without structure in many dimensions nearly every border is near and the join tends to
all members against all chunks, as any exact method does there; clustered vectors stay local.

Defined results: null vectors, zero vectors, vectors with null or non-finite components link with
nothing and are their own component; vectors of another dimension link only among themselves;
repeated rows are vectors of their own (with the same id); an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coralint.llm.common import hash128, small_batches, stored
from coralint.llm.components import components

CHUNK = 2048
MAX_PIVOTS = 2048
SLACK = 1e-9  # borders are widened by it against rounding; links are decided on cosines alone


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not zero, all components finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 1))


def unit(rows: np.ndarray) -> np.ndarray:
    # Scaled by the largest component first, so that squares cannot overflow or vanish.
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def _deal(pivots: dict[int, np.ndarray], radius: float, home_only: bool):
    """Home cell of each vector, or (cell, at_home) for every cell that must see it."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            sizes = np.array(batch.column(1).value_lengths())
            cells, owners, homes = [], [], []
            for size in np.unique(sizes):
                mine = np.flatnonzero(sizes == size)
                u = unit(matrix(batch.column(1).take(pa.array(mine))))
                p = pivots.get(int(size), u[:1] * 0)  # a dimension beyond the sample is one cell
                near = u @ p.T
                home = near.argmax(axis=1)
                apart = np.sqrt(np.maximum(0.0, 2 - 2 * (p @ p.T)))
                # d^2 = 2 - 2 cos, so the distance to the border is (cos_home - cos_other) / d(p, q).
                gap = near[np.arange(len(mine)), home][:, None] - near
                with np.errstate(divide="ignore", invalid="ignore"):
                    inside = gap <= radius * apart[home] + SLACK
                inside[np.arange(len(mine)), home] = True
                if home_only:
                    inside[:] = False
                    inside[np.arange(len(mine)), home] = True
                row, cell = np.nonzero(inside)
                owners.append(mine[row])
                cells.append(cell + size * (MAX_PIVOTS + 1))
                homes.append(cell == home[row])
            owners = np.concatenate(owners) if owners else np.empty(0, np.int64)
            if not n:
                continue
            if home_only:
                at, seen = np.unique(np.concatenate(cells), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(seen.astype(np.int64))], ["cell", "n"])
                continue
            picked = batch.take(pa.array(owners))
            yield pa.RecordBatch.from_arrays(
                [picked.column(0), picked.column(1), picked.column(2),
                 pa.array(np.concatenate(cells).astype(np.int64)), pa.array(np.concatenate(homes))],
                ["id", "vector", "n", "cell", "home"],
            )

    return run


class _Chunk:
    """The home vectors of one chunk, their link counts, and the group that each is in so far."""

    def __init__(self):
        self.ids, self.rows = [], []

    def add(self, ids, rows):
        self.ids.append(ids)
        self.rows.append(rows)

    def close(self):
        self.ids = np.concatenate(self.ids) if self.ids else np.empty(0, np.int64)
        self.rows = np.concatenate(self.rows) if self.rows else np.empty((0, 1))
        self.links = np.zeros(len(self.ids), np.int64)
        self.group = np.arange(len(self.ids))

    def match(self, ids, rows, weight, least):
        """Count links to the members ``ids``; an edge to one home vector for each linked member."""
        near = rows @ self.rows.T >= least
        linked = np.flatnonzero(near.any(axis=1))
        near = near[linked] & (ids[linked][:, None] != self.ids[None, :])
        self.links += weight[linked] @ near
        out = []
        for i, row in zip(linked, near):
            hit = np.flatnonzero(row)
            if len(hit):
                out.append((ids[i], self.ids[hit[0]]))
                groups = self.group[hit]
                if (groups != groups[0]).any():  # home vectors that share a member are one group
                    self.group[np.isin(self.group, groups)] = groups[0]
        return out


def _link(least: float):
    """Rows arrive by (cell, chunk), home vectors of the chunk first, then all members of the cell."""

    def run(batches):
        key, chunk, complete = None, None, False

        def rows_of(a, b, links):
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, links)], ["a", "b", "links"])

        def finish():
            if not complete:
                chunk.close()
            return rows_of(chunk.ids, chunk.ids[chunk.group], chunk.links)

        for batch in batches:
            groups = np.stack([np.array(batch.column(i)) for i in (3, 4)], axis=1)
            role = np.array(batch.column(5))
            marks = np.flatnonzero(np.any(np.diff(groups, axis=0) != 0, axis=1) | (np.diff(role) != 0)) + 1
            for a, b in zip([0, *marks], [*marks, batch.num_rows]):
                if tuple(groups[a]) != key:
                    if chunk is not None:
                        yield finish()
                    key, chunk, complete = tuple(groups[a]), _Chunk(), False
                part = batch.slice(a, b - a)
                ids, rows = np.array(part.column(0)), unit(matrix(part.column(1)))
                if role[a] == 0:
                    chunk.add(ids, rows)
                    continue
                if not complete:
                    chunk.close()
                    complete = True
                if len(chunk.ids) and (edges := chunk.match(ids, rows, np.array(part.column(2)), least)):
                    yield rows_of([x for x, _ in edges], [y for _, y in edges], [0] * len(edges))
        if chunk is not None:
            yield finish()

    return run


def choose_pivots(classes: DataFrame, n_classes: int) -> dict[int, np.ndarray]:
    """About one pivot per ``CHUNK`` vectors, at most ``MAX_PIVOTS``, for each dimension.

    Candidates are the first few vectors in hash order (a bounded sample); pivots are taken from them
    farthest first, which spreads the cells.
    """
    wanted = max(1, min(MAX_PIVOTS, -(-n_classes // CHUNK)))
    sizes = [r[0] for r in classes.select(F.size("vector")).distinct().limit(64).collect()]
    pivots = {}
    for size in sizes:
        sample = classes.filter(F.size("vector") == size).orderBy(F.xxhash64("id"), "id").limit(min(4 * wanted, MAX_PIVOTS)).select("vector").collect()
        rows = unit(np.array([r[0] for r in sample], np.float64))
        picked, best = [0], rows @ rows[0]
        while len(picked) < min(wanted, len(rows)):
            nxt = int(best.argmin())
            if best[nxt] > 1 - 1e-12:
                break
            picked.append(nxt)
            best = np.maximum(best, rows @ rows[nxt])
        pivots[size] = rows[picked]
    return pivots


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept), one row per input row.

    ``n_links`` counts the other vectors with at least that cosine, ``component_id`` is the
    smallest id reachable over links.
    """
    small_batches(vectors.sparkSession)
    k1, k2 = hash128(F.col(vector_col))
    ok = usable(F.col(vector_col))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), ok.alias("ok"), k1.alias("k1"), k2.alias("k2"))
    classes = stored(
        rows.filter("ok").groupBy("k1", "k2", "vector").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "vector-classes"
    )
    # Classes get numbers of their own, fixed by writing them: an id may be repeated across classes.
    classes = stored(classes.select("k1", "k2", F.col("id").alias("least"), F.monotonically_increasing_id().alias("id"), "vector", "n"), "vector-keys")
    total = classes.count()
    radius = math.sqrt(2 - 2 * cosine) + SLACK
    pivots = choose_pivots(classes, total)
    thin = classes.select("id", "vector", "n")
    kind = classes.schema["vector"].dataType.simpleString()
    cells = stored(
        thin.mapInArrow(_deal(pivots, radius, False), f"id long, vector {kind}, n long, cell long, home boolean"), "metric-cells"
    )
    # One row per cell: at most MAX_PIVOTS a dimension.
    chunks = cells.groupBy("cell").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.col("home").cast("int")) / F.lit(CHUNK)).cast("int")).alias("chunks"))
    placed = cells.join(F.broadcast(chunks), "cell")
    own = placed.filter("home").withColumn("chunk", F.pmod(F.xxhash64(F.lit(5), "id"), F.col("chunks")).cast("int")).withColumn("role", F.lit(0))
    seen = placed.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("role", F.lit(1))
    cols = ["id", "vector", "n", "cell", "chunk", "role"]
    found = stored(
        own.select(*cols)
        .unionByName(seen.select(*cols))
        .repartition("cell", "chunk")
        .sortWithinPartitions("cell", "chunk", "role")
        .mapInArrow(_link(cosine), "a long, b long, links long"),
        "metric-links",
    )
    links = found.groupBy("a").agg(F.sum("links").alias("links"))
    groups = components(found)
    keyed = classes.drop("vector").join(links.withColumnRenamed("a", "id"), "id", "left").join(groups, "id", "left")
    keyed = stored(keyed.withColumn("group", F.coalesce("component", "id")), "vector-groups")
    least = keyed.groupBy("group").agg(F.min("least").alias("component_id"))
    by_class = keyed.join(least, "group").select(
        F.col("k1").alias("c1"), F.col("k2").alias("c2"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("found"), "component_id"
    )
    on = (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")) & F.col("ok")
    return rows.drop("vector").join(by_class, on, "left").select(
        F.col("id").alias(id_col),
        F.coalesce("found", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce("component_id", "id").eqNullSafe(F.col("id")).alias("kept"),
    )


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
    ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, least(e.vec_id, coalesce(m.b, e.vec_id)) AS component_id,
       e.vec_id <= coalesce(m.b, e.vec_id) AS kept
FROM embeddings e LEFT JOIN counted c ON c.a = e.vec_id LEFT JOIN least m ON m.a = e.vec_id
"""
