"""A uniform shuffle into shards of exact size through a communication matrix. DataFrame functions only on the rows' path.

Rows fall into blocks by a hash. The number of rows that a block sends to each shard is drawn from the multivariate
hypergeometric distribution, as a uniform permutation of all rows would give it; the draw sees block sizes only. A block permutes
its rows locally and cuts them by its counts. After the exchange each shard permutes again: rows fall into sub-blocks by a second
hash, sub-blocks lie one after another, and each permutes its own. No task holds a whole shard.

Shard sizes differ by one at most. Null texts have size 1 and the checksum of no bytes; null ids and repeated rows are rows as any
other, as hashes cover all of a row's text and id. Very long texts are measured whole, and only their size and checksum are
moved. An empty table gives no rows. Further columns aren't read, whatever their names.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import row_key, stash

MAX_BLOCKS = 4096
BLOCK_ROWS = 20_000


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Good ones among `draws` taken without putting back; inversion outward from the mode, exact up to floating point."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    lc = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    p = math.exp(lc(good, mode) + lc(bad, draws - mode) - lc(good + bad, draws))
    u = rng.random() - p
    up, down, pu, pd = mode, mode, p, p
    while u > 0 and (up < high or down > low):
        if up < high:
            pu *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= pu
            if u <= 0:
                return up
        if down > low:
            pd *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= pd
            if u <= 0:
                return down
    return mode


def communication_matrix(block_sizes: list[int], shard_sizes: list[int], seed: int) -> list[list[int]]:
    """Rows that each block sends to each shard, with exactly these sums."""
    rng, left, out = random.Random(seed), list(shard_sizes), []
    for n in block_sizes:
        row, pool = [], sum(left)
        for have in left:
            k = hypergeometric(rng, have, pool - have, n)
            pool -= have
            n -= k
            row.append(k)
        left = [a - b for a, b in zip(left, row, strict=True)]
        out.append(row)
    return out


def shuffle_to_shards(docs: DataFrame, shards: int = 8, seed: int = 1) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard) of every row."""
    spark, raw = docs.sparkSession, F.coalesce(F.encode(F.col("text").cast("string"), "UTF-8"), F.lit(b""))
    rows = stash(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), row_key("doc_id", "text").alias("k")), "shard-rows")
    n = rows.count()
    blocks = min(MAX_BLOCKS, max(64, -(-n // BLOCK_ROWS)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("k", F.lit(seed)), F.lit(blocks)).cast("int"))
    have = dict(rows.groupBy("block").count().collect())  # at most MAX_BLOCKS sizes
    sizes = [have.get(b, 0) for b in range(blocks)]
    base, more = divmod(n, shards)
    matrix = communication_matrix(sizes, [base + (s < more) for s in range(shards)], seed)
    sends = spark.createDataFrame([(b, *row) for b, row in enumerate(matrix)], "block int, " + ", ".join(f"c{s} long" for s in range(shards)))
    ends = [sum((F.col(f"c{i}") for i in range(s + 1)), F.lit(0)) for s in range(shards)]
    local = Window.partitionBy("block").orderBy(F.xxhash64("k", F.lit(seed), F.lit("local")), "k")
    dealt = rows.withColumn("r", F.row_number().over(local)).join(F.broadcast(sends), "block")  # at most MAX_BLOCKS rows
    shard = F.coalesce(*[F.when(F.col("r") <= e, s) for s, e in enumerate(ends)])
    subs = max(8, blocks // shards)
    dealt = stash(dealt.select("doc_id", "size", "text_crc32", "k", shard.cast("int").alias("shard"), F.pmod(F.xxhash64("k", F.lit(seed), F.lit("sub")), F.lit(subs)).cast("int").alias("sub")), "shard-dealt")
    counts = dealt.groupBy("shard", "sub").count()
    before = Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "sub", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))  # at most shards * subs rows
    again = Window.partitionBy("shard", "sub").orderBy(F.xxhash64("k", F.lit(seed), F.lit("again")), "k")
    return dealt.withColumn("r", F.row_number().over(again)).join(F.broadcast(starts), ["shard", "sub"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("start") + F.col("r") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
