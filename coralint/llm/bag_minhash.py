"""Near duplicates of texts by BagMinHash over multisets of five-word shingles.

A text is the multiset of its word shingles. Each shingle carries Poisson processes over its weight,
split into the intervals [0,1), [1,2), [2,4), [4,8) ..: an arrival belongs to a signature slot, a time,
and a unit of the interval, and counts only if that unit lies below the shingle's multiplicity. The
earliest arrival of each slot is the signature; two texts agree in a slot with a probability equal to
their weighted Jaccard similarity. Arrivals are made in order of time and stop once every slot is
filled, so long texts cost little more than one arrival per shingle.

Signatures are banded; texts that share a band are candidates; candidates are verified on their
multisets: sum of minima at least ``similarity`` times sum of maxima. Groups are components of links.

Scale: equal texts are one class before any sketch is compared. Candidates of a bucket are first
compared with its smallest class only, which settles groups of copies with one comparison a
member. Only buckets that still hold several components are compared within, in pairs of chunks of
bounded size, and buckets of one largest component are put together where that deals out fewer rows;
a pair that shares a bucket is looked at by signature, and verified only if its signature allows the
similarity and it is not yet connected. No pair becomes a row, and no test is
capped: every pair of a bucket is either connected or tested.
A hub's members are salted, so a large group is many tasks, each streaming past one multiset.

Defined results: words are split at white space and lower-cased; texts of fewer than five words are
one shingle; null and blank texts are equal to each other; repeated rows and null ids are kept row
by row; an empty table gives an empty table; only the id column and the results are returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coralint.llm.common import give_back, hash128, small_batches, stored
from coralint.llm.components import components

SHINGLE = 5
ROWS, BANDS = 6, 42  # a pair at 0.8 is missed with probability 3e-6
SLOTS = ROWS * BANDS
# Pairs whose signatures agree in fewer slots than this below the threshold: six standard errors.
MARGIN = 0.15
SHINGLES_AT_ONCE = 200_000
MEMO = 500_000
PER_HUB = 500  # members of a hub in one task
PER_CHUNK = 500  # classes of a bucket in one chunk
MERGED = -1  # the band of buckets that are treated as one
BROADCAST_KEYS = 1_000_000

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: all output bits depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word):
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def multiset(text: str | None, words: _Words | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingle hashes, multiplicities); nothing for a text without words."""
    found = (text or "").lower().split()
    words = _Words() if words is None else words
    n = len(found)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    w = np.fromiter(map(words.__getitem__, found), np.uint64, n)
    size = min(SHINGLE, n)
    with np.errstate(over="ignore"):
        h = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            h = h * _MULTIPLIERS[4] + w[k : n - size + 1 + k] * _MULTIPLIERS[k]
        return np.unique(_mix(h + np.uint64(size)), return_counts=True)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int, int]:
    """(sum of minima, sum of maxima) of two multisets."""
    total = int(a[1].sum() + b[1].sum())
    if not len(a[0]) or not len(b[0]):
        return 0, total
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    both = a[0][at] == b[0]
    shared = int(np.minimum(a[1][at[both]], b[1][both]).sum())
    return shared, total - shared


def similar(a, b, similarity: float) -> bool:
    shared, union = overlap(a, b)
    return union == 0 or shared >= similarity * union - 1e-9


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], slots: int = SLOTS) -> np.ndarray:
    """Arrival times, one row per multiset; rows without shingles are infinite."""
    out = np.full(len(bags) * slots, np.inf)
    sizes = np.array([len(b[0]) for b in bags])
    if not sizes.sum():
        return out.reshape(-1, slots)
    owner = np.repeat(np.arange(len(bags)), sizes)
    item = np.concatenate([b[0] for b in bags])
    weight = np.concatenate([b[1] for b in bags])
    # One process per shingle and interval that begins below its weight.
    parts = [(np.arange(len(item)), 0, 1)]
    low = 1
    while (more := np.flatnonzero(weight > low)).size:
        parts.append((more, low, low))
        low *= 2
    which = np.concatenate([p[0] for p in parts])
    begin = np.concatenate([np.full(len(p[0]), p[1]) for p in parts])
    width = np.concatenate([np.full(len(p[0]), p[2]) for p in parts])
    owner, weight = owner[which], weight[which]
    with np.errstate(over="ignore"):
        seed = _mix(item[which] + begin.astype(np.uint64) * _MULTIPLIERS[1])
        rate = width * float(slots)
        total = np.bincount(owner, width, len(bags))
        horizon = (np.log(slots) + 3) / np.maximum(total, 1)
        time, step = np.zeros(len(which)), np.zeros(len(which), np.uint64)
        live = np.arange(len(which))

        def draw(rows):
            step[rows] += np.uint64(1)
            z = _mix(seed[rows] + step[rows] * _MULTIPLIERS[0])
            time[rows] += -np.log1p(-(z >> np.uint64(11)).astype(np.float64) * 2.0**-53) / rate[rows]

        draw(live)
        while True:
            while (now := live[time[live] <= horizon[owner[live]]]).size:
                z = _mix(seed[now] ^ _mix(step[now] * _MULTIPLIERS[2]))
                unit = begin[now] + ((z >> np.uint64(40)) % width[now].astype(np.uint64)).astype(np.int64)
                counts = now[unit < weight[now]]
                slot = (z[unit < weight[now]] & np.uint64(0xFFFFFFFF)) % np.uint64(slots)
                np.minimum.at(out, owner[counts] * slots + slot.astype(np.int64), time[counts])
                draw(now)
                live = now
            open_ = np.isinf(out.reshape(-1, slots)).any(axis=1) & (sizes > 0)
            if not open_.any():
                return out.reshape(-1, slots)
            horizon[open_] *= 1.5
            live = np.flatnonzero(open_[owner])


def band_hashes(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, different between bands."""
    bits = signature.view(np.uint64).reshape(len(signature), BANDS, ROWS)
    with np.errstate(over="ignore"):
        h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _MULTIPLIERS[3], bits.shape[:2]).copy()
        for k in range(ROWS):
            h = _mix(h ^ bits[:, :, k]) * _MULTIPLIERS[0]
    return _mix(h).view(np.int64)


def slot_bytes(signature: np.ndarray) -> np.ndarray:
    """One byte per slot, for estimates."""
    return (_mix(signature.view(np.uint64)) >> np.uint64(56)).astype(np.uint8)


# ------------------------------------------------------------------ jobs


def _sketch(batches):
    """A sketch for the first of equal texts of a task, null for its copies."""
    words, seen = _Words(), set()
    for batch in batches:
        keys = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
        fresh, bags, held = [], [], 0
        bands, slots = [None] * len(keys), [None] * len(keys)

        def flush():
            signature = signatures(bags)
            for i, b, s in zip(fresh, band_hashes(signature), slot_bytes(signature)):
                bands[i], slots[i] = b, s.tobytes()

        for i, key in enumerate(keys):
            if key in seen:
                continue
            seen.add(key)
            fresh.append(i)
            bags.append(multiset(batch.column(3)[i].as_py(), words))
            held += len(bags[-1][0])
            if held >= SHINGLES_AT_ONCE:
                flush()
                fresh, bags, held = [], [], 0
        if fresh:
            flush()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(bands, pa.list_(pa.int64())), pa.array(slots, pa.binary())],
            ["id", "k1", "k2", "bands", "slots"],
        )
    del words, seen
    give_back()


def _bags(batches):
    words = _Words()
    for batch in batches:
        bags = [multiset(t.as_py(), words) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([b[0].tobytes() for b in bags], pa.binary()),
             pa.array([b[1].astype("<u4").tobytes() for b in bags], pa.binary())],
            ["c", "items", "counts"],
        )
    del words
    give_back()


def _verify(similarity: float):
    """Rows by (hub, salt), the hub's own multiset first, then the members'."""

    def run(batches):
        key, hub = None, None
        for batch in batches:
            a, b = [], []
            hubs, salts, roles, members = (batch.column(i).to_pylist() for i in range(4))
            for i, at in enumerate(zip(hubs, salts)):
                bag = np.frombuffer(batch.column(4)[i].as_py(), np.uint64), np.frombuffer(batch.column(5)[i].as_py(), "<u4").astype(np.int64)
                if roles[i] == 0:
                    key, hub = at, bag
                elif at == key and similar(hub, bag, similarity):
                    a.append(hubs[i])
                    b.append(members[i])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def verified(edges: DataFrame, bags: DataFrame, similarity: float, name: str) -> DataFrame:
    """The edges (a, b) whose multisets are similar. Hubs are ``a``; each appears once per salt."""
    sizes = edges.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(PER_HUB)).cast("int").alias("salts"))
    # The salt count travels with the edges; a hub with very many members is split by adaptive skew join.
    salted = stored(edges.join(sizes, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int")).select("a", "b", "salt"), f"{name}-edges")
    cols = ["a", "salt", "role", "b", "items", "counts"]
    members = salted.join(bags, F.col("b") == F.col("c")).withColumn("role", F.lit(1)).select(*cols)
    hubs = salted.select("a", "salt").distinct().join(bags, F.col("a") == F.col("c")).withColumn("role", F.lit(0)).withColumn("b", F.col("a")).select(*cols)
    return stored(
        hubs.unionByName(members)
        .repartition("a", "salt")
        .sortWithinPartitions("a", "salt", "role")
        .mapInArrow(_verify(similarity), "a long, b long"),
        f"{name}-links",
    )


def _inside(similarity: float):
    """Links between the components of one chunk pair of a bucket; pairs once connected are not tested.

    A pair is tested only in the first bucket that it shares, or where merged buckets meet if it shares
    any, and only if its signatures allow the similarity, the most alike first.
    """

    def run(table: pa.Table) -> pa.Table:
        c, band = np.array(table.column("c")), table.column("band")[0].as_py()
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        side = np.array(table.column("side"))
        group = np.unique(np.array(table.column("component")), return_inverse=True)[1]
        slots = np.stack([np.frombuffer(v.as_py(), np.uint8) for v in table.column("slots")])
        bands = np.array(table.column("bands").combine_chunks().flatten()).reshape(len(c), -1)
        items, counts = table.column("items"), table.column("counts")
        bag = lambda i: (np.frombuffer(items[i].as_py(), np.uint64), np.frombuffer(counts[i].as_py(), "<u4").astype(np.int64))
        one = x == y
        right = np.flatnonzero(side == y)
        a, b = [], []
        for i in np.flatnonzero(side == x):
            others = right[group[right] != group[i]]
            others = others[c[others] > c[i]] if one else others
            if band == MERGED:
                others = others[(bands[others] == bands[i]).any(axis=1)]
            else:
                others = others[~(bands[others, :band] == bands[i, :band]).any(axis=1)]
            agree = ((slots[others] == slots[i]).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
            order = np.argsort(-agree, kind="stable")
            own = None
            for j in others[order[agree[order] >= similarity - MARGIN]].tolist():
                if group[j] == group[i]:
                    continue
                own = own or bag(i)
                if similar(own, bag(j), similarity):
                    a.append(c[i])
                    b.append(c[j])
                    group[group == group[j]] = group[i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _labelled(frame: DataFrame, groups: DataFrame | None, on: str, name: str) -> DataFrame:
    if groups is None:
        return frame.withColumn(name, F.col(on))
    g = groups.select(F.col("id").alias("__id"), F.col("component").alias("__component"))
    return frame.join(g, F.col(on) == F.col("__id"), "left").withColumn(name, F.coalesce("__component", on)).drop("__id", "__component")


def _chunks(n: str) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.col(n) / F.lit(PER_CHUNK))).cast("int")


def _sizes() -> list[Column]:
    return [F.count_if(F.col("in_largest")).alias("n"), F.count_if(~F.col("in_largest")).alias("o")]


def _merged(open_: DataFrame) -> DataFrame:
    """Open buckets (band, h, largest, in_largest, c, component), those of one largest component as one
    bucket where that deals out fewer rows: a large group fills a bucket in nearly every band."""
    dealt = F.col("n") * _chunks("o") + F.col("o") * (_chunks("n") + _chunks("o"))
    alone = open_.groupBy("band", "h", "largest").agg(*_sizes()).groupBy("largest").agg(F.sum(dealt).alias("alone"))
    union = open_.groupBy("largest", "c").agg(F.first("in_largest").alias("in_largest")).groupBy("largest").agg(*_sizes())
    fewer = union.join(alone, "largest").select("largest", (dealt < F.col("alone")).alias("merge"))
    rows = open_.join(fewer, "largest")
    band, h = F.when(F.col("merge"), MERGED).otherwise(F.col("band")), F.when(F.col("merge"), F.col("largest")).otherwise(F.col("h"))
    return rows.select(band.alias("band"), h.alias("h"), "in_largest", "c", "component").distinct()


def _pairs_of(classes: DataFrame, docs_keyed: DataFrame, similarity: float) -> DataFrame | None:
    """Verified links (a, b) between classes."""
    spread = classes.select("c", F.posexplode("bands").alias("band", "h"))
    buckets = spread.groupBy("band", "h").agg(F.min("c").alias("hub"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    shared = stored(spread.join(buckets, ["band", "h"]).select("band", "h", "hub", "n", "c"), "minhash-buckets")
    wanted = stored(shared.select("c").distinct().join(classes.select("c", "k1", "k2"), "c"), "minhash-candidates")
    n_wanted = wanted.count()
    if not n_wanted:
        return None
    side = F.broadcast(wanted) if n_wanted <= BROADCAST_KEYS else wanted
    texts = docs_keyed.join(side, ["k1", "k2"]).select("c", "text")
    bags = stored(texts.mapInArrow(_bags, "c long, items binary, counts binary").dropDuplicates(["c"]), "minhash-bags")

    stars = stored(shared.filter("c <> hub").select(F.col("hub").alias("a"), F.col("c").alias("b")).distinct(), "minhash-stars")
    first = stars.groupBy("b").agg(F.min("a").alias("a"))
    links = verified(first.select("a", "b"), bags, similarity, "minhash-first")
    groups = components(links)
    # Hubs other than the first, where the first did not connect.
    rest = stars.join(first.withColumnRenamed("a", "first"), "b").filter("a <> first").select("a", "b")
    rest = _labelled(_labelled(rest, groups, "a", "ga"), groups, "b", "gb").filter("ga <> gb").select("a", "b")
    links = links.unionByName(verified(rest, bags, similarity, "minhash-rest"))
    groups = components(links)
    # Buckets in which members are still apart: pairs that do not hold the hub were never tested.
    placed = _labelled(shared.filter("n > 2"), groups, "c", "component")
    parts = placed.filter("c <> hub").groupBy("band", "h", "component").agg(F.count(F.lit(1)).alias("m"), F.sum(F.xxhash64("c").cast("decimal(38,0)")).alias("sum"))
    apart = (
        parts.groupBy("band", "h")
        .agg(F.max(F.struct("m", "component")).alias("largest"), F.sum("m").alias("m"), F.sum("sum").alias("sum"), F.count(F.lit(1)).alias("parts"))
        .filter("parts > 1")
    )
    # Buckets with the same members are treated once, in their first band.
    apart = apart.groupBy("m", "sum").agg(F.min(F.struct("band", "h", "largest")).alias("of")).select("of.band", "of.h", F.col("of.largest.component").alias("largest"))
    open_ = placed.filter("c <> hub").join(apart, ["band", "h"]).withColumn("in_largest", F.col("component") == F.col("largest"))
    open_ = stored(open_.select("band", "h", "largest", "in_largest", "c", "component"), "minhash-open")
    open_ = stored(_merged(open_), "minhash-dealt")
    sizes = open_.groupBy("band", "h").agg(*_sizes()).select("band", "h", _chunks("n").alias("first"), _chunks("o").alias("others"))
    # No two members of the largest component are compared, so each of its chunks meets the others' chunks only.
    open_ = open_.join(sizes, ["band", "h"])
    at = F.xxhash64(F.lit(1), "c")
    open_ = open_.withColumn("side", F.when(F.col("in_largest"), F.pmod(at, F.col("first"))).otherwise(F.col("first") + F.pmod(at, F.col("others"))).cast("int"))
    meets = F.sequence(F.when(F.col("in_largest"), F.col("first")).otherwise(0), F.col("first") + F.col("others") - 1)
    dealt = open_.withColumn("other", F.explode(meets))
    dealt = dealt.withColumn("x", F.least("side", "other")).withColumn("y", F.greatest("side", "other"))
    dealt = dealt.join(classes.select("c", "slots", "bands"), "c").join(bags, "c")
    inside = (
        dealt.select("band", "h", "x", "y", "side", "c", "component", "slots", "bands", "items", "counts")
        .groupBy("band", "h", "x", "y")
        .applyInArrow(_inside(similarity), "a long, b long")
    )
    return links.unionByName(stored(inside, "minhash-inside"))


def _classes(docs: DataFrame, id_col: str, text_col: str, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(rows: id, k1, k2), (classes: k1, k2, least, component: the least id of the group, first of it)."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    k1, k2 = hash128(F.when(F.trim(text) == "", F.lit("")).otherwise(text))
    keyed = docs.select(F.col(id_col).alias("id"), k1.alias("k1"), k2.alias("k2"), text.alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    sketched = stored(keyed.mapInArrow(_sketch, f"id {kind}, k1 long, k2 long, bands array<long>, slots binary"), "minhash-sketches")
    classes = sketched.groupBy("k1", "k2").agg(
        F.min("id").alias("least"), F.first("bands", ignorenulls=True).alias("bands"), F.first("slots", ignorenulls=True).alias("slots")
    )
    # Numbers of classes are fixed by writing them.
    classes = stored(classes.withColumn("c", F.monotonically_increasing_id()), "minhash-classes")
    links = _pairs_of(classes, keyed.select("k1", "k2", "text"), similarity)
    groups = None if links is None else components(links)
    placed = stored(_labelled(classes.select("k1", "k2", "c", "least"), groups, "c", "group"), "minhash-groups")
    keeper = placed.groupBy("group").agg(F.min_by(F.struct("least", "c"), F.struct(F.col("least").isNull(), "least", "c")).alias("keeper"))
    return sketched.select("id", "k1", "k2"), placed.join(keeper, "group").select(
        "k1", "k2", "least", F.col("keeper")["least"].alias("component"), (F.col("keeper")["c"] == F.col("c")).alias("keeps")
    )


def near_duplicates(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, copy_of, kept), one row per input row.

    ``class_id`` is the smallest id of the group that links connect, ``copy_of`` the smallest id
    with the same text, ``kept`` whether the row's id is its class id.
    """
    rows, classes = _classes(docs, id_col, text_col, similarity)
    return rows.join(classes, ["k1", "k2"]).select(
        F.col("id").alias(id_col),
        F.col("component").alias("class_id"),
        F.col("least").alias("copy_of"),
        (F.col("id").eqNullSafe(F.col("component")) & F.col("keeps")).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group: the smallest id; of repeated rows any one."""
    _, classes = _classes(docs, id_col, text_col, similarity)
    keepers = classes.filter("keeps").select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("component").alias("__least"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    k1, k2 = hash128(F.when(F.trim(text) == "", F.lit("")).otherwise(text))
    rows = docs.withColumn("__a", k1).withColumn("__b", k2)
    on = (F.col("__a") == F.col("__k1")) & (F.col("__b") == F.col("__k2")) & F.col(id_col).eqNullSafe(F.col("__least"))
    return rows.join(keepers, on).dropDuplicates(["__a", "__b"]).select(*docs.columns)
