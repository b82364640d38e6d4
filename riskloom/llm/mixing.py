"""Mixing sources to target weights by fixed-length blocks of tokens (words).

The documents of a source lie one after another in an order fixed by hashes; their words are cut into blocks of `block` words.
Each source gets a whole number of slots for its target. A multinomial draw for each source deals its slots out to the output shards,
so that a shard's counts of the sources are a multinomial draw given the sources' totals, which keeps each source at its target.
A shard's slots of a source follow those of the shard before it; a slot's block index is its place under a keyed pseudorandom
permutation of the source's indexes (a Feistel network that walks its cycle until it is back in range), another one in each epoch. So
a block is taken as often as any other or once less. Blocks join slots by index. A target is at most three times its source's size,
so no block is taken more than three times. Any number of blocks that fits 62 bits has its permutation.

Null source: a source of its own, last in order. Null or empty text: size 0, taken 0. Equal rows lie at places of their own. Ties in
the order of documents are only between equal rows. Very long texts are cut as any other. An empty table gives an empty mix; further
columns are carried by mixed_documents and told apart rows there and here, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, row_key, stash
from .textops import mix

CHUNK = 8192  # slots made in one step
MOST = 3
ROUNDS = 6
U = np.uint64


def permuted(x: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The place of each x in a pseudorandom permutation of 0 .. n - 1 fixed by key; n and key for each x."""
    half = np.array([max(1, (int(m) - 1).bit_length() + 1 >> 1) for m in np.unique(n)], np.uint64)[np.unique(n, return_inverse=True)[1].ravel()]
    if (half > U(31)).any():
        raise ValueError("a source has more blocks than 62 bits hold")
    low = (U(1) << half) - U(1)

    def once(v, at):
        left, right = v >> half[at], v & low[at]
        for i in range(ROUNDS):
            left, right = right, left ^ (mix(mix(right + U(i)) ^ key[at]) & low[at])
        return left << half[at] | right

    out = once(x.astype(U), np.arange(len(x)))
    while len(far := np.flatnonzero(out >= n.astype(U))):
        out[far] = once(out[far], far)
    return out.astype(np.int64)


def _draws(shards: int, seed: int):
    """For each source the slots of each shard, in chunks: sid, n, shard, first slot, number of slots."""

    def run(batches):
        for b in batches:
            rows = []
            for sid, n, slots in zip(*(b.column(c).to_pylist() for c in ("sid", "n", "slots")), strict=True):
                counts = np.random.Generator(np.random.PCG64([seed, sid])).multinomial(slots, np.full(shards, 1 / shards)).tolist()
                first = 0
                for shard, count in enumerate(counts):
                    for at in range(0, count, CHUNK):
                        rows.append((sid, n, shard, first + at, min(CHUNK, count - at)))
                        if len(rows) == 10_000:
                            yield _batch(rows, ["sid", "n", "shard", "first", "count"])
                            rows = []
                    first += count
            yield _batch(rows, ["sid", "n", "shard", "first", "count"])

    return run


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))], names)


def _blocks_of_slots(seed: int):
    """sid, slot, index of its block, shard."""

    def run(batches):
        for b in batches:
            for sid, n, shard, first, count in zip(*(b.column(c).to_pylist() for c in ("sid", "n", "shard", "first", "count")), strict=True):
                slot = np.arange(first, first + count)
                key = mix(mix(U(sid) ^ mix(U(seed) + U(1))) + (slot // n).astype(U))
                index = permuted(slot % n, np.full(count, n), key)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(count, sid)), pa.array(slot), pa.array(index), pa.array(np.full(count, shard), pa.int32())], ["sid", "slot", "index", "shard"])

    return run


def targets(sized: DataFrame) -> DataFrame:
    """One row per source: sid, source, source_size, weight, target, n_blocks to be added later. As many rows as sources."""
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = by.withColumn("sid", F.row_number().over(order)).withColumn("weight", ((F.col("sid") - 1) % 3 + 1).cast("double")).withColumn("cap", (MOST * F.col("source_size")).cast("double"))
    everything, lower = Window.partitionBy(), Window.orderBy(F.col("cap") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    total = F.sum("source_size").over(everything).cast("double")
    level = (total - zero(F.sum("cap").over(lower))) / (F.sum("weight").over(everything) - zero(F.sum("weight").over(lower)))
    s = s.withColumn("level", level).withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything))
    return s.select("sid", "source", "source_size", "weight", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def plan(docs: DataFrame, block: int = 128, shards: int = 16, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(documents with sid, off and target; pieces: sid, off, first word, words, times taken for each block of a document)."""
    placed, parts, slots, _ = _plan(docs, block, shards, seed)
    times = slots.groupBy("sid", "index").agg(F.count("*").alias("times"))
    return placed, parts.hint("merge").join(times, ["sid", "index"])


def _plan(docs: DataFrame, block: int, shards: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(documents with their places; their pieces; slots: sid, slot, index, shard; sources)."""
    text = F.col("text").cast("string")
    rows = stash(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), row_key(*docs.columns).alias("k")), "mix-rows")
    buckets = min(1 << 20, max(64, -(-rows.count() // 50_000)))
    sources = stash(targets(rows), "mix-sources")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("k", F.lit(seed)), F.lit(buckets)))
    inner = Window.partitionBy("source", "bucket").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = stash(rows.groupBy("source", "bucket").agg(F.sum("size").alias("n")).select("source", "bucket", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("start")), "mix-starts")
    named = sources.select(F.col("source").alias("s"), "sid", "source_size", "target")
    starts = starts.join(named, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    starts = stash(starts.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "start", "sid", "source_size", "target"), "mix-starts")
    placed = stash(rows.withColumn("before", F.coalesce(F.sum("size").over(inner), F.lit(0))), "mix-before")
    placed = placed.join(starts, (F.col("bucket") == F.col("b")) & F.col("source").eqNullSafe(F.col("s")))
    placed = stash(placed.select("doc_id", "k", "sid", "size", (F.col("start") + F.col("before")).alias("off"), "source_size", "target"), "mix-placed")
    parts = placed.filter("size > 0").select("sid", "off", "size", F.explode(F.sequence(F.floor(F.col("off") / block), F.floor((F.col("off") + F.col("size") - 1) / block))).alias("index"))
    first = F.greatest(F.col("off"), F.col("index") * block)
    parts = parts.select("sid", "off", "index", (first - F.col("off")).alias("first"), (F.least(F.col("off") + F.col("size"), (F.col("index") + 1) * block) - first).alias("words"))

    wanted = sources.filter("source_size > 0").withColumn("n", F.ceil(F.col("source_size") / block)).withColumn("slots", F.least(MOST * F.col("n"), F.round(F.col("target") * F.col("n") / F.col("source_size")).cast("long")))
    drawn = stash(wanted.filter("slots > 0").select("sid", F.col("n").cast("long").alias("n"), F.col("slots").cast("long").alias("slots")).mapInArrow(_draws(shards, seed), "sid long, n long, shard long, first long, count long"), "mix-draws")
    slots = drawn.repartition("sid", "shard", "first").mapInArrow(_blocks_of_slots(seed), "sid long, slot long, index long, shard int")
    return placed, parts, slots, sources


def _pieces(block: int):
    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(5)]
            for sid, off, text in zip(*(b.column(c).to_pylist() for c in ("sid", "off", "text")), strict=True):
                spans = [m.span() for m in re.finditer(WORD, text)]
                first = 0
                while first < len(spans):
                    index = (off + first) // block
                    end = min(len(spans), (index + 1) * block - off)
                    for col, x in zip(cols, (sid, index, off, end - first, text[spans[first][0] : spans[end - 1][1]]), strict=True):
                        col.append(x)
                    first = end
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "text" else pa.int64()) for n, c in zip(("sid", "index", "off", "words", "text"), cols, strict=True)], ["sid", "index", "off", "words", "text"])

    return run


def _shard_blocks(docs: DataFrame, block: int = 128, shards: int = 16, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(placed documents; the rows of shard_blocks with sid and, in order, each document's off and words in the block)."""
    placed, _, slots, sources = _plan(docs, block, shards, seed)
    texts = docs.select(row_key(*docs.columns).alias("k"), F.col("text").cast("string").alias("text")).groupBy("k").agg(F.any_value("text").alias("text"))
    pieces = placed.filter("size > 0").select("k", "sid", "off").hint("merge").join(texts, "k").select("sid", "off", "text").mapInArrow(_pieces(block), "sid long, index long, off long, words long, text string")
    joined = pieces.groupBy("sid", "index").agg(F.sort_array(F.collect_list(F.struct("off", "words", "text"))).alias("x"))
    joined = joined.select("sid", "index", F.array_join("x.text", "\n").alias("text"), F.transform("x", lambda p: F.struct(p["off"].alias("off"), p["words"].alias("words"))).alias("parts"))

    # places in a shard in an order fixed by hashes; a shard is ordered in buckets, never in one task
    slots = slots.withColumn("h", F.xxhash64("sid", "slot", F.lit(seed), F.lit("place")))
    slots = stash(slots.withColumn("bucket", F.shiftright("h", 52)), "mix-slots")
    inner, outer = Window.partitionBy("shard", "bucket").orderBy("h", "sid", "slot"), Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = slots.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("start"))
    at = slots.withColumn("r", F.row_number().over(inner)).hint("merge").join(starts, ["shard", "bucket"]).select("sid", "index", "shard", (F.col("start") + F.col("r") - 1).alias("position"))
    at = at.join(F.broadcast(sources.select("sid", "source")), "sid")  # one row per source
    blocks = at.hint("merge").join(joined, ["sid", "index"]).select("shard", "position", "source", F.col("index").alias("block_index"), "text", "sid", "parts")
    return placed, blocks


def shard_blocks(docs: DataFrame, **how) -> DataFrame:
    """The mix as packed blocks: shard, position (from 0 in a shard), source, block_index, text of the joined block."""
    return _shard_blocks(docs, **how)[1].select("shard", "position", "source", "block_index", "text")


def mixed_counts(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken (words in the rows of shard_blocks)."""
    placed, blocks = _shard_blocks(docs, **how)
    taken = stash(blocks.select("sid", F.explode("parts").alias("p")).groupBy("sid", F.col("p.off").alias("off")).agg(F.sum("p.words").alias("taken")), "mix-taken")
    used = placed.filter("size > 0").hint("merge").join(taken, ["sid", "off"], "left").unionByName(placed.filter("size = 0").withColumn("taken", F.lit(0).cast("long")))
    return used.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def cut(text: str, parts: list[tuple[int, int, int]]) -> list[str]:
    """The texts that a document gives: the c-th has the words of all blocks taken c times or more, and the white space within."""
    spans = [m.span() for m in re.finditer(WORD, text)]
    out = []
    for c in range(1, MOST + 1):
        runs: list[list[int]] = []
        for first, words, times in sorted(parts):
            if times >= c:
                if runs and runs[-1][1] == first:
                    runs[-1][1] += words
                else:
                    runs.append([first, first + words])
        if runs == [[0, len(spans)]]:
            out.append(text)
        elif runs:
            out.append("\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in runs))
    return out


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix as documents: columns of docs; up to three rows for a document, with the words taken in text and n_chars counted anew.

    Each of several equal rows is cut by the parts at its own place. Documents of no words stay as they are.
    """
    placed, parts = plan(docs, **how)
    of = parts.groupBy("sid", "off").agg(F.collect_list(F.struct(F.col("first").cast("long").alias("first"), F.col("words").cast("long").alias("words"), F.col("times").cast("long").alias("times"))).alias("parts"))
    of = placed.filter("size > 0").hint("merge").join(stash(of, "mix-parts"), ["sid", "off"]).select("k", "size", "parts")
    of = stash(of.unionByName(placed.filter("size = 0").select("k", "size", F.array().cast(of.schema["parts"].dataType).alias("parts"))), "mix-of")
    names = docs.columns
    one = docs.select(F.struct(*names).alias("row"), row_key(*names).alias("k")).dropDuplicates(["k"])  # a struct: its names can't clash
    keyed = one.hint("merge").join(of, "k").select("row", "parts", "size")

    def run(batches):
        for b in batches:
            of = dict(zip(names, b.column("row").flatten(), strict=True))
            text, at, size = of["text"].to_pylist(), b.column("parts").to_pylist(), b.column("size").to_pylist()
            rows, texts = [], []
            for i, (t, p, n) in enumerate(zip(text, at, size, strict=True)):
                for x in [t] if not n else cut(t, [(q["first"], q["words"], q["times"]) for q in p]):
                    rows.append(i)
                    texts.append(x)
            at = pa.array(rows, pa.int64())
            own = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([None if x is None else len(x) for x in texts], pa.int64())}
            yield pa.RecordBatch.from_arrays([own[c].cast(of[c].type) if c in own else of[c].take(at) for c in names], names)

    return keyed.mapInArrow(run, docs.schema)
