"""Near-duplicate vectors through a pivot-permutation index.

Reference points (pivots) are a bounded sample of the vectors, the first by a hash of the id, without those within twice the linking
angle of an earlier one: a group of near copies has few pivots however large it is. Each vector is described by its nearest pivots in order. It is posted in the inverted list of its nearest one and looked up in the lists of its `probes` nearest.
Within a list, pairs that share at least `shared` of their `prefix` nearest pivots are verified by cosine in double precision.

Exact copies are one class with a weight before the search. A list of more than `block` members is dealt out in blocks by a hash,
and every block of members meets every block of probes, so no task holds a whole hot list; a block yields link counts and a
spanning forest, never all pairs. Each linked pair is counted in one place: if both find each other, where the smaller is posted.

Nulls: vectors that are null, zero or hold null or non-finite components, and vectors with a null label, link with nothing but
get their row. Vectors of different length never link. Rows with equal vec_id are told apart only by their vectors; repeated rows are
of one class. Ties among pivots go to the lower number. An empty table gives an empty result; further columns aren't read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, components, stash

MAX_PIVOTS = 32768
SCORES = 1 << 21  # similarities to pivots held at once
APART = 2  # pivots lie this many times the linking angle apart


def _finite(c):
    return c.isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(c, lambda x: x != 0)


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _thinned(points: np.ndarray, min_cosine: float, most: int, step: int = 1024) -> np.ndarray:
    """The first `most` of the unit vectors that have no earlier one of these within APART times the linking angle."""
    angle = APART * math.acos(max(-1.0, min(1.0, min_cosine)))
    near = math.cos(angle) if angle < math.pi else -2.0
    kept = points[:0]
    for at in range(0, len(points), step):
        part = points[at : at + step]
        part = part[~(part @ kept.T > near).any(axis=1)] if len(kept) else part
        close, own = part @ part.T > near, []
        shut = np.zeros(len(part), bool)
        for i in range(len(part)):
            if not shut[i]:
                own.append(i)
                shut |= close[i]
        kept = np.concatenate((kept, part[own]))
        if len(kept) >= most:
            break
    return kept[:most]


def _by_length(column):
    """(row numbers, matrix) for each length of vector in an Arrow list column."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    start = np.concatenate(([0], np.cumsum(lengths)))
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        yield rows, flat[start[rows][:, None] + np.arange(d)[None, :]]


def _describe(pivots: dict, prefix: int):
    def run(batches):
        points = pivots.value
        for batch in batches:
            near = [None] * batch.num_rows
            for rows, x in _by_length(batch.column("embedding")):
                p = points.get(x.shape[1])
                if p is None:
                    for r in rows:
                        near[r] = [0]
                    continue
                step = max(16, SCORES // len(p))
                for at in range(0, len(rows), step):
                    score = _unit(x[at : at + step]) @ p.T
                    k = min(prefix, score.shape[1])
                    best = np.argpartition(-score, k - 1, axis=1)[:, :k]
                    order = np.take_along_axis(best, np.lexsort((best, -np.take_along_axis(score, best, 1)), axis=1), 1)
                    for r, o in zip(rows[at : at + step], order, strict=True):
                        near[r] = o.tolist()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rep", "label", "weight", "embedding")), pa.array(near, pa.list_(pa.int32()))], ["rep", "label", "weight", "embedding", "near"])

    return run


def _verify(table: pa.Table, min_cosine: float, probes: int, shared: int) -> pa.Table:
    """One block: posted vectors against probing ones of the same list."""
    ids, weight = table["rep"].to_numpy(), table["weight"].to_numpy()
    posted = table["posted"].to_numpy(zero_copy_only=False)
    near = table["near"].to_pylist()
    links, forest, edges = np.zeros(len(ids), np.int64), Forest(len(ids)), []
    of = {}
    same = np.array([of.setdefault(i, n) for n, i in enumerate(ids)], np.int64)  # a vector may be here on both sides
    pivots = {p: n for n, p in enumerate(sorted({p for x in near for p in x}))}
    has = np.zeros((len(ids), len(pivots)), np.float32)
    for n, x in enumerate(near):
        has[n, [pivots[p] for p in x]] = 1
    need = min([shared, *(len(x) for x in near)])
    for rows, x in _by_length(table["embedding"].combine_chunks()):
        a, b = rows[posted[rows]], rows[~posted[rows]]
        unit = dict(zip(rows.tolist(), range(len(rows)), strict=True))
        u = _unit(x)
        ua, ub = u[[unit[i] for i in a.tolist()]] if len(a) else u[:0], u[[unit[i] for i in b.tolist()]] if len(b) else u[:0]
        candidate = has[a] @ has[b].T >= need
        i, j = np.nonzero(candidate & (ua @ ub.T >= min_cosine))
        for i, j in zip(a[i].tolist(), b[j].tolist(), strict=True):
            if ids[i] == ids[j] or near[j][0] in near[i][:probes] and ids[i] > ids[j]:
                continue
            links[i] += weight[j]
            links[j] += weight[i]
            if forest.join(int(same[i]), int(same[j])):
                edges.append((int(ids[i]), int(ids[j])))
    at = np.flatnonzero(links)
    n, m = len(at), len(edges)
    return pa.table({"u": pa.array(ids[at].tolist() + [e[0] for e in edges], pa.int64()), "v": pa.array([None] * n + [e[1] for e in edges], pa.int64()), "links": pa.array(links[at].tolist() + [0] * m, pa.int64())})


def near_vectors(vectors: DataFrame, min_cosine: float = 0.98, prefix: int = 24, probes: int = 12, shared: int = 2, block: int = 192) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    e = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long"), e.cast("array<double>").alias("embedding"), F.col("label"))
    rows = rows.withColumn("ok", F.coalesce(_finite(F.col("embedding")) & F.col("label").isNotNull(), F.lit(False)))
    seed, n, distinct = 0, 1, 0
    while n != distinct:  # classes are of equal vectors and labels; if two have one hash, all are hashed anew
        seed += 1
        hashed = rows.withColumn("class", F.when(F.col("ok"), F.xxhash64(F.col("label").cast("string"), F.col("embedding"), F.lit(seed))))
        each = hashed.filter("ok").groupBy(F.col("class").alias("rep"), F.col("label").cast("string").alias("label"), "embedding")
        classes = stash(each.agg(F.count("*").alias("weight"), F.min("vec_id").alias("min_id")), "pivot-classes")
        n, distinct = classes.agg(F.count("*"), F.count_distinct("rep")).first()
    rows = hashed
    m = min(MAX_PIVOTS, max(64, 1 << (math.isqrt(16 * max(n, 1)) - 1).bit_length()))
    points: dict[int, list] = {}
    sample = classes.orderBy(F.xxhash64("rep", F.lit("pivot")), "rep").limit(min(MAX_PIVOTS, 2 * m)).select("embedding").toArrow()
    for chunk in sample["embedding"].chunks:
        for _, x in _by_length(chunk):
            points.setdefault(x.shape[1], []).append(x)
    sent = spark.sparkContext.broadcast({d: _thinned(_unit(np.concatenate(p)), min_cosine, m) for d, p in points.items()})
    described = stash(classes.select("rep", "label", "weight", "embedding").mapInArrow(_describe(sent, prefix), "rep long, label string, weight long, embedding array<double>, near array<int>"), "pivot-near")

    # lists: (label, pivot) with members posted and members probing; how many blocks each side takes
    size = F.size("near")
    key = [F.col("label"), F.col("pivot")]
    sides = described.select("rep", "label", F.posexplode(F.slice("near", 1, probes)).alias("rank", "pivot"))
    counts = stash(
        sides.groupBy(*key).agg(F.count("*").alias("n_probing"), F.sum(F.when(F.col("rank") == 0, 1).otherwise(0)).alias("n_posted")).filter("n_posted > 0 and n_probing > 1").select(
            *key, F.ceil(F.col("n_probing") / block).cast("int").alias("b_probing"), F.ceil(F.col("n_posted") / block).cast("int").alias("b_posted")
        ),
        "pivot-lists",
    )
    one = described.withColumn("x", F.explode(F.concat(F.array(F.struct(F.lit(True).alias("posted"), F.element_at("near", 1).alias("pivot"))), F.transform(F.slice("near", 1, probes), lambda p: F.struct(F.lit(False).alias("posted"), p.alias("pivot"))))))
    one = one.select("rep", "label", "weight", "embedding", "near", "x.posted", "x.pivot").join(counts, ["label", "pivot"])
    own = F.when(F.col("posted"), F.pmod(F.xxhash64("rep", F.lit("b")), F.col("b_posted"))).otherwise(F.pmod(F.xxhash64("rep", F.lit("b")), F.col("b_probing"))).cast("int")
    others = F.when(F.col("posted"), F.col("b_probing")).otherwise(F.col("b_posted"))
    dealt = one.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    dealt = dealt.select(
        "rep", "weight", "embedding", "near", "posted", F.xxhash64("label", "pivot", F.when(F.col("posted"), F.col("own")).otherwise(F.col("other")), F.when(F.col("posted"), F.col("other")).otherwise(F.col("own"))).alias("tile")
    )

    def verify(table: pa.Table) -> pa.Table:
        return _verify(table, min_cosine, probes, shared)

    found = stash(dealt.groupBy("tile").applyInArrow(verify, "u long, v long, links long"), "pivot-found")
    links = found.filter("v is null").groupBy(F.col("u").alias("class")).agg(F.sum("links").alias("others"))
    roots = components(found.filter("v is not null").select("u", "v"), "pivot-cc").withColumnRenamed("node", "class")
    named = classes.select(F.col("rep").alias("class"), "weight", "min_id").join(links, "class", "left").join(roots, "class", "left")
    named = stash(named.withColumn("root", F.coalesce("root", "class")), "pivot-named")
    least = named.groupBy("root").agg(F.min("min_id").alias("component_id"))
    of_class = stash(named.join(stash(least, "pivot-least"), "root").select("class", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id"), "pivot-result")
    out = rows.select("vec_id", "class").join(of_class, "class", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
