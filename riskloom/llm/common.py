"""Helpers that several operators share: the shared folder, written tables, membership filters, connected components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local one only where that is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        where = tempfile.mkdtemp(prefix="riskloom-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write df once as a table in the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, tag)
    with setting(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):  # the table replaces its shuffles
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def delete(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(*tables: DataFrame) -> None:
    """Delete stashed tables that nothing will read again."""
    for t in tables:
        delete(t.sparkSession, t._stash_path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def row_key(*cols: str):
    """A 64-bit key of a row that doesn't need its id to be unique or not null."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00null")) for c in cols])


def with_columns(df: DataFrame, source: str, added: dict[str, str], of) -> DataFrame:
    """df with the columns `added` in place of any of these names; of(Arrow column source) gives them. Columns go by place, so that names
    with dots or backticks, or the same name twice, do no harm."""
    keep = [i for i, c in enumerate(df.columns) if c not in added]
    at = df.columns.index(source)
    schema = ", ".join([*(f"c{i} {df.schema[i].dataType.simpleString()}" for i in keep), *(f"a{k} {kind}" for k, kind in enumerate(added.values()))])

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), *of(b.column(at))], [*(f"c{i}" for i in keep), *(f"a{k}" for k in range(len(added)))])

    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(run, schema).toDF(*(df.columns[i] for i in keep), *added)


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value):
    """A setting of the session for jobs that run inside."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small_batches(spark: SparkSession, rows: int):
    """Fewer rows in an Arrow batch for jobs that run inside: bounds a Python worker's memory where rows are long."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def bounded_batches(spark: SparkSession, most: str = "4m") -> None:
    """Arrow batches of at most so many bytes in this session from now on: texts may be long, and the last step of an operator runs when
    its caller writes, so that a setting for a while can't hold there."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


# ---------------------------------------------------------------- membership filter of bounded size

MAX_FILTER_BITS = 1 << 28


class KeyFilter:
    """Bits set for a set of 64-bit keys; at most MAX_FILTER_BITS (32 MB). May let others through, never holds a member back."""

    def __init__(self, words: np.ndarray, log2: int):
        self.words, self.log2 = words, log2

    def mask(self, keys: np.ndarray) -> np.ndarray:
        k = keys.astype(np.int64)
        low = np.int64((1 << self.log2) - 1)
        out = np.ones(len(k), bool)
        for h in (k, k >> np.int64(32)):
            p = h & low
            out &= ((self.words[p >> np.int64(6)].view(np.uint64) >> (p & np.int64(63)).astype(np.uint64)) & np.uint64(1)).astype(bool)
        return out


def key_filter(keys: DataFrame, col: str):
    """A broadcast KeyFilter of column col (64-bit hashes, repeated or not). What reaches the driver is the bits, of bounded size, not
    the keys. The estimate of distinct keys only sizes the filter."""
    spark, n = keys.sparkSession, keys.agg(F.approx_count_distinct(col)).first()[0]
    log2 = min(28, max(16, int(16 * max(n, 1)).bit_length()))
    low = (1 << log2) - 1
    c = F.col(col)
    bits = keys.select(F.explode(F.array(c.bitwiseAND(F.lit(low)), F.shiftright(c, 32).bitwiseAND(F.lit(low)))).alias("p"))
    rows = bits.groupBy(F.shiftright("p", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("b")).toArrow()
    words = np.zeros(1 << (log2 - 6), np.int64)
    words[rows["w"].to_numpy()] = rows["b"].to_numpy()
    return spark.sparkContext.broadcast(KeyFilter(words, log2))


def few_files(df: DataFrame, rows: int, each: int = 50_000) -> DataFrame:
    """df in as many parts as its rows, at most `rows` of a few bytes, need: a small table isn't spread over a file for each shuffle partition."""
    return df.coalesce(max(1, -(-rows // each)))


# ---------------------------------------------------------------- connected components

def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """(node, root) for each node of edges (u, v); root is the smallest node reachable.

    Alternating large-star and small-star rounds. Minima come from map-side combined aggregates; they are written before
    the join back, so that both join sides are plain shuffles and a hub's rows can be split by adaptive execution.
    Ends when the edges are stars: each u has one edge and is no v.
    """
    e = stash(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), tag)
    while True:
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("top")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("child"), F.lit(1).alias("top")))
        most, n = ends.groupBy("x").agg(F.sum("child").alias("child"), F.max("top").alias("top")).agg(F.coalesce(F.max(F.col("child") + F.col("top")), F.lit(0)), F.coalesce(F.sum("child"), F.lit(0))).first()
        if most <= 1:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stash(few_files(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), 2 * n), tag)
        large = stash(few_files(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), n), tag)
        least = stash(few_files(large.groupBy("u").agg(F.min("v").alias("m")), n), tag)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        before, e = e, stash(few_files(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), n), tag)
        release(low, large, least, before)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


class Forest:
    """Union-find over the rows of one block."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True
