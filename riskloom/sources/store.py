"""Append-only tables written by batch number, and tables that reports share.

A log is a folder of batches; a batch that runs again overwrites its own folder and nothing else, so at-least-once delivery gives each row
once. Within a batch rows lie in folders of partition columns, which reads prune by.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..operators import pit

DAY = 86_400_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local one, made once for a session, only where that is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not where:
        where = tempfile.mkdtemp(prefix="riskloom-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def _path(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


class Log:
    """rows of one schema under path/batch=N/column=value/..."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, parts: list[str]):
        self.spark, self.path, self.schema, self.parts = spark, path, schema, parts

    def append(self, number: int, rows: DataFrame) -> None:
        """Written in the order of the partition columns, so that a task has one file open at a time, whatever their number."""
        rows.select(*self.schema.names).sortWithinPartitions(*self.parts).write.mode("overwrite").partitionBy(*self.parts).parquet(f"{self.path}/batch={number}")

    def read(self) -> DataFrame:
        """All rows with their batch; none if nothing is written yet."""
        schema = StructType([*self.schema.fields, StructField("batch", self.schema_of_batch())])
        path, fs = _path(self.spark, self.path)
        if not fs.exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path)

    @staticmethod
    def schema_of_batch():
        from pyspark.sql.types import LongType

        return LongType()


class FeatureLog(Log):
    """Feature values (feature, key, as_of, computed_at, value): inserted, never changed. Partitioned by feature and day of as_of."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, StructType.fromDDL("feature string, key long, as_of long, computed_at long, value double, day long"), ["feature", "day"])

    def append(self, number: int, rows: DataFrame) -> None:
        super().append(number, rows.withColumn("day", F.floor(F.col("as_of") / DAY)))

    def values(self, features: list[str], first: int | None = None, last: int | None = None) -> DataFrame:
        """Values of features with as_of in [first, last]; only their folders are read."""
        x = self.read().filter(F.col("feature").isin(features))
        if first is not None:
            x = x.filter((F.col("day") >= first // DAY) & (F.col("as_of") >= first))
        if last is not None:
            x = x.filter((F.col("day") <= last // DAY) & (F.col("as_of") <= last))
        return x

    def as_of(self, feature: str, probes: DataFrame, last: int, oldest: int | None = None, ceiling: int | None = None) -> DataFrame:
        """The point-in-time read of probes (key, probe_id, bound), none of which is bound later than `last`; `oldest`: no older values."""
        return pit.as_of(self.values([feature], oldest, last), probes, ceiling)


class LedgerLog(Log):
    """Condition rows by decision, once for each (decision_id, condition): what a batch has of keys written before is left out.

    Partitioned by day of the decision, so that only the days a batch touches are looked at for keys."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: list[str]):
        super().__init__(spark, path, StructType([*schema.fields, *StructType.fromDDL("day long").fields]), ["day"])
        self.key = key

    def append(self, number: int, rows: DataFrame) -> None:
        """rows have a column t, the decision's instant. Of rows with one key inside the batch, one stays."""
        rows = rows.withColumn("day", F.floor(F.col("t") / DAY))
        span = rows.agg(F.min("day"), F.max("day")).first()  # repeated rows don't change it, so nothing is moved for it
        if span[0] is None:
            return
        before = self.read().filter((F.col("batch") != number) & F.col("day").between(span[0], span[1]))
        super().append(number, rows.dropDuplicates(self.key).join(before.select(*self.key), self.key, "left_anti"))


# ---------------------------------------------------------------- tables that reports share

_shared: dict[tuple, str] = {}


def _state_of(spark: SparkSession, sf_dir: str, tables: tuple[str, ...]) -> tuple:
    """Length and time of change of input tables: a table derived from others is written anew when these change."""
    out = []
    for t in tables:
        path, fs = _path(spark, f"{sf_dir}/{t}.parquet")
        size = fs.getContentSummary(path).getLength()
        out.append((t, size, fs.getFileStatus(path).getModificationTime()))
    return tuple(out)


def shared(name: str, tables: tuple[str, ...]) -> Callable:
    """A derived table that is written once for a session and an input, and read by all reports that ask for it."""

    def put(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def get(spark: SparkSession, sf_dir: str) -> DataFrame:
            key = (spark.sparkContext.applicationId, sf_dir, name, _state_of(spark, sf_dir, tables))
            path, fs = _path(spark, _shared.get(key, "/none"))
            if key not in _shared or not fs.exists(path):
                where = new_path(spark, f"shared-{name}")
                build(spark, sf_dir).write.parquet(where)
                _shared[key] = where
            return spark.read.parquet(_shared[key])

        get.build = build
        return get

    return put
