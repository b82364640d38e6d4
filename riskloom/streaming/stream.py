"""Streams over folders of Parquet files, each run to the end of what is there (AvailableNow); another run takes what has come since.

Work folders lie in spark.checkpoint.dir, which driver and executors share. Sinks are folders by batch number, overwritten when a batch
runs again, so at-least-once delivery gives each row once.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.windows import micros, trailing
from ..operators import cases
from ..sources.store import DAY, new_path


def work_dir(spark: SparkSession, tag: str) -> str:
    """A new folder that driver and executors share."""
    return new_path(spark, tag)


def spans(rows: DataFrame, at: str, cuts: list) -> list[DataFrame]:
    """Rows between cuts of column `at`, in order: what arrives one after another."""
    return [rows.filter((F.lit(True) if low is None else F.col(at) >= low) & (F.lit(True) if high is None else F.col(at) < high)) for low, high in zip([None, *cuts], [*cuts, None], strict=True)]


def arrive(arrivals: list[dict[str, DataFrame]], read: Callable[[dict[str, DataFrame]], DataFrame], sink: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Each arrival (named relations) is written into the folders that the stream reads, by as many tasks as it has, and then the query
    takes what has come since it ran last; its state and its place in the folders are kept between the runs."""
    spark = next(iter(arrivals[0].values())).sparkSession
    folder = {name: work_dir(spark, f"stream-{name}") for name in arrivals[0]}
    checkpoint = work_dir(spark, "stream-checkpoint")
    for now in arrivals:
        for name, rows in now.items():
            rows.write.mode("append").parquet(folder[name])
        run(read({name: spark.readStream.schema(rows.schema).parquet(folder[name]) for name, rows in now.items()}), sink, checkpoint, mode)


def source(spark: SparkSession, path: str, schema: StructType, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def run(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Everything that is there, in micro-batches; nothing new gives no batch."""
    stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def by_batch(out: str) -> Callable[[DataFrame, int], None]:
    """A sink with a folder for each batch."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return write


def driven_counts(out: str, history: str, frontiers: str, scope: str, window: str) -> Callable[[DataFrame, int], None]:
    """An incremental feature pass: rows above the frontier (the newest instant stored before) drive it, each with its scope's count over
    the trailing window. A row at or below the frontier is stored but drives nothing; later windows include it.

    The frontier is a row of a table by batch. History lies in folders by day, of which a batch reads those that its windows reach into, so
    what it reads grows with the arrival and the window, not with the history."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        day = F.floor(F.col("t") / DAY)
        batch.withColumn("day", day).sortWithinPartitions("day").write.mode("overwrite").partitionBy("day").parquet(f"{history}/batch={number}")
        span = batch.agg(F.min("t"), F.max("t")).first()
        frontier = None
        if number:
            known = spark.read.schema("frontier long, batch long").parquet(frontiers)
            frontier = known.filter(F.col("batch") < number).agg(F.max("frontier")).first()[0]
        newest = max((x for x in (frontier, span[1]) if x is not None), default=None)
        spark.range(1).select(F.lit(newest).cast("long").alias("frontier")).write.mode("overwrite").parquet(f"{frontiers}/batch={number}")
        if span[0] is None:
            return
        stored = spark.read.schema(StructType([*batch.schema.fields, StructField("batch", LongType()), StructField("day", LongType())])).parquet(history)
        low = span[0] if frontier is None else max(span[0], frontier + 1)  # of the rows that drive
        first = low - micros(window)
        mine = stored.filter((F.col("batch") <= number) & (F.col("day") >= first // DAY) & (F.col("t") > first))
        touched = mine.join(batch.select(scope).distinct(), scope, "left_semi")
        counted = touched.withColumn("value", F.count("*").over(trailing(scope, window)))
        counted.filter((F.col("batch") == number) & (F.col("t") >= low)).drop("batch", "day").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return write


def affected(rows: DataFrame, keys: dict[str, str]) -> DataFrame:
    """(subject_type, subject): arriving transactions themselves and their dimensions."""
    each = [F.struct(F.lit(kind).alias("subject_type"), F.col(c).cast("long").alias("subject")) for kind, c in keys.items()]
    return rows.select(F.inline(F.array(*each))).filter("subject is not null").distinct()


ROUTED = "id long, routing string, case_id long"
_EVENT = ["t", "is_verdict", "id", "subject", "key", "score"]


def route_stream(events: DataFrame, open_window: int, buckets: int = 4096) -> DataFrame:
    """Case routing with keyed state over decisions and verdicts of one stream: (subject, id, key, t, score, is_verdict, at). A verdict's id
    is that of its case; from its instant on the case no longer suppresses. `at` is t as a timestamp with a watermark.

    The key of the state is a bucket of subjects, by hash: a call has a fixed cost of milliseconds, which a subject's few rows in a batch
    don't pay for. A task holds a batch's rows of one bucket. State: the cases of the window by subject, with what closed them. Cases go when
    the watermark has passed their window, and a bucket's state with its newest case. As batches come in order of time, and within a batch a
    subject's rows are put in order, a verdict before a decision of its instant, this gives what the batch form gives. A verdict on a case
    that isn't there changes nothing."""

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = sorted((r for p in parts for r in zip(*(p[c].tolist() for c in _EVENT), strict=True)), key=lambda r: (r[0], not r[1], r[2]))
        known = dict(json.loads(state.get[0])) if state.exists else {}
        ids, said, of = [], [], []
        for t, is_verdict, i, subject, case_key, score in rows:
            mine = known.get(subject, [])
            if is_verdict:
                for c in mine:
                    if c[3] == i and c[4] is None:
                        c[4] = t
                continue
            known[subject], routing, case = cases.step(mine, open_window, i, case_key, t, None if score is None or score != score else int(score))
            ids.append(i)
            said.append(routing)
            of.append(case)
        passed = state.getCurrentWatermarkMs()
        known = {s: live for s, live in ((s, [c for c in mine if c[1] + open_window >= passed * 1000]) for s, mine in known.items()) if live}
        if known:
            state.update((json.dumps(list(known.items())),))
            newest = max(c[1] for mine in known.values() for c in mine)
            state.setTimeoutTimestamp(max((newest + open_window) // 1000 + 1, passed + 1))
        elif state.exists:
            state.remove()
        if ids:
            yield pd.DataFrame({"id": ids, "routing": said, "case_id": of})

    parted = events.withColumns({"subject": F.col("subject").cast("string"), "bucket": F.pmod(F.xxhash64("subject"), F.lit(buckets))})
    return parted.groupBy("bucket").applyInPandasWithState(fold, ROUTED, "cases string", "append", GroupStateTimeout.EventTimeTimeout)
