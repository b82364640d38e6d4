from riskloom.operators import ingest, kpis
from riskloom.streaming import stream

DAY = 86_400_000_000


def test_late_rows_are_stored_but_drive_nothing(spark, tmp_path):
    src, out, history, frontiers, cp = (str(tmp_path / x) for x in ("src", "out", "history", "frontiers", "cp"))
    schema = "txn_id long, t long, account_id long"
    arrive = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    tick = lambda: stream.run(stream.source(spark, src, spark.createDataFrame([], schema).schema), stream.driven_counts(out, history, frontiers, "account_id", "7d"), cp)
    read = lambda: {r.txn_id: r.value for r in spark.read.parquet(f"{out}/batch=*").collect()}
    arrive([(1, DAY, 7), (2, 2 * DAY, 7), (3, 2 * DAY, 8)])
    tick()
    assert read() == {1: 1, 2: 2, 3: 1}
    arrive([(4, DAY, 7), (5, 3 * DAY, 7)])  # 4 is late
    tick()
    assert read() == {1: 1, 2: 2, 3: 1, 5: 4}
    batches = len(list((tmp_path / "out").glob("batch=*")))
    tick()  # nothing new: no batch
    assert len(list((tmp_path / "out").glob("batch=*"))) == batches
    sink = stream.driven_counts(out, history, frontiers, "account_id", "7d")
    sink(spark.createDataFrame([(4, DAY, 7), (5, 3 * DAY, 7)], schema), 1)  # the same batch again
    assert read() == {1: 1, 2: 2, 3: 1, 5: 4}


def test_receipt_and_null_safe_keys(spark):
    rows = spark.createDataFrame([(0, None, "x"), (1, None, "x"), (2, 5, "x"), (3, 5, None), (4, 5, None)], "index long, a long, b string")
    first = ingest.first_of(rows, ["a", "b"], "index")
    assert sorted(r["index"] for r in first.collect()) == [0, 2, 3]
    stored = spark.createDataFrame([(None, "x"), (5, None)], "a long, b string")
    assert [r["index"] for r in ingest.unseen(first, stored, ["a", "b"]).collect()] == [2]
    tagged = spark.createDataFrame([(0, ["no a", "no b"], "rejected", 5), (1, [], "written", 3), (2, [], "duplicate", 9)], "index long, reasons array<string>, fate string, occurred_at long")
    counts, rejected = ingest.receipt(tagged, spark.range(2))
    assert tuple(counts.first()) == (3, 1, 1, 1, 3, 2) and [tuple(r) for r in rejected.collect()] == [(0, ["no a", "no b"])]


def test_a_batch_reads_only_the_days_of_its_windows(spark, tmp_path):
    """Files of history that a batch opens don't grow with the history."""
    out, history, frontiers = (str(tmp_path / x) for x in ("out", "history", "frontiers"))
    sink = stream.driven_counts(out, history, frontiers, "account_id", "2d")
    schema = "txn_id long, t long, account_id long"
    for n in range(12):
        sink(spark.createDataFrame([(n, n * DAY + 5, n % 2), (100 + n, n * DAY + 6, 7)], schema).coalesce(1), n)
    rows = spark.read.parquet(f"{out}/batch=*")
    assert {r.txn_id: r.value for r in rows.collect() if r.txn_id >= 100} == {100 + n: min(n, 1) + 1 for n in range(12)}
    stored = spark.read.schema(schema + ", batch long, day long").parquet(history)
    assert len(stored.inputFiles()) == 12
    plan = stored.filter("day >= 9 and t > 9")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "day" in plan.split("PartitionFilters")[1][:80]


def test_dedup_forgets_beyond_its_watermark(spark, tmp_path):
    """An id that comes again within the watermark is dropped; one that comes after its state has expired is let through."""
    from pyspark.sql import functions as F

    day = 86_400
    rows = [(1, 10 * day), (1, 11 * day), (2, 12 * day), (3, 30 * day), (1, 31 * day), (3, 31 * day)]
    df = spark.createDataFrame(rows, "id long, t long")
    out = str(tmp_path / "out")
    read = lambda s: s["rows"].withColumn("at", F.timestamp_seconds("t")).withWatermark("at", "5 days").dropDuplicatesWithinWatermark(["id"]).select("id", "t")
    stream.arrive([{"rows": x} for x in stream.spans(df, "t", [11 * day, 20 * day, 31 * day])], read, stream.by_batch(out))
    assert sorted(tuple(r) for r in spark.read.schema("id long, t long").parquet(f"{out}/batch=*").collect()) == [(1, 10 * day), (1, 31 * day), (2, 12 * day), (3, 30 * day)]


def test_arrivals_need_no_single_task(spark):
    rows = spark.range(0, 1000, 1, 4).selectExpr("id", "id as t")
    parts = stream.spans(rows, "t", [10, 500])
    assert [p.count() for p in parts] == [10, 490, 500] and parts[2].rdd.getNumPartitions() == 4


def test_routing_stream_with_verdicts(spark, tmp_path):
    """Two streams into one keyed state equal the batch form; state of subjects whose window has passed is dropped."""
    import random

    from pyspark.sql import functions as F

    from riskloom.operators import cases

    rng = random.Random(5)
    rows = [(rng.randrange(12), i, rng.choice("abc"), (1000 + i // 3) * 1_000_000_000, rng.choice([None, 10, 20, 30])) for i in range(600)]
    closes = {i: t + rng.randrange(1, 30) * 1_000_000_000 for _, i, _, t, _ in rows if rng.random() < 0.5}
    d = spark.createDataFrame(rows, "subject long, id long, key string, t long, score long")
    v = spark.createDataFrame([(s, i, closes[i]) for s, i, *_ in rows if i in closes], "subject long, id long, t long")
    batch = cases.route(d.join(v.select("id", F.col("t").alias("closes_at")), "id", "left").withColumn("authorised", F.lit(True)), 20_000_000_000)
    want = {tuple(r) for r in batch.collect()}
    assert want != {tuple(r) for r in cases.route(d.withColumn("authorised", F.lit(True)), 20_000_000_000).collect()}  # verdicts matter
    out, cuts = str(tmp_path / "out"), [1_060_000_000_000, 1_120_000_000_000]
    timed = lambda s: s.withColumn("at", F.timestamp_micros("t")).withWatermark("at", "0 seconds")
    both = lambda s: stream.route_stream(timed(s["d"].withColumn("is_verdict", F.lit(False)).unionByName(s["v"].withColumns({"key": F.lit(None).cast("string"), "score": F.lit(None).cast("long"), "is_verdict": F.lit(True)}))), 20_000_000_000)
    states = []

    def sink(b, n):
        stream.by_batch(out)(b, n)
        states.append(n)

    stream.arrive([{"d": a, "v": b} for a, b in zip(stream.spans(d, "t", cuts), stream.spans(v, "t", cuts), strict=True)], both, sink)
    assert {tuple(r) for r in spark.read.schema(stream.ROUTED).parquet(f"{out}/batch=*").collect()} == want


def test_routing_stream_calls_grow_with_buckets_not_with_subjects(spark, tmp_path):
    """Many subjects in few buckets, null subjects and subjects that differ beyond 2^53: a call for each bucket of a batch, rows as in batch."""
    from pyspark.sql import functions as F

    from riskloom.operators import cases

    big = 2**60
    rows = [(None if i % 41 == 0 else big + i % 200, i, "ab"[i % 2], (1000 + i // 4) * 1_000_000_000, i % 7 * 10) for i in range(1600)]
    d = spark.createDataFrame(rows, "subject long, id long, key string, t long, score long")
    v = d.filter("id % 3 = 0").select("subject", "id", (F.col("t") + 30_000_000_000).alias("t"))
    want = {tuple(r) for r in cases.route(d.join(v.select("id", F.col("t").alias("closes_at")), "id", "left").withColumn("authorised", F.lit(True)), 90_000_000_000).collect()}
    assert {r[1] for r in want} == {"raised", "restated", "folded", "suppressed"}
    e = d.withColumn("is_verdict", F.lit(False)).unionByName(v.withColumns({"key": F.lit(None).cast("string"), "score": F.lit(None).cast("long"), "is_verdict": F.lit(True)}))
    out, groups = str(tmp_path / "out"), []
    read = lambda s: stream.route_stream(s["e"].withColumn("at", F.timestamp_micros("t")).withWatermark("at", "0 seconds"), 90_000_000_000, buckets=3)

    def sink(b, n):
        stream.by_batch(out)(b, n)
        groups.append(max((o.numRowsTotal() for q in spark.streams.active for o in (q._jsq.lastProgress().stateOperators() if q._jsq.lastProgress() else [])), default=0))

    stream.arrive([{"e": x} for x in stream.spans(e, "t", [1_120_000_000_000, 1_250_000_000_000])], read, sink)
    got = [tuple(r) for r in spark.read.schema(stream.ROUTED).parquet(f"{out}/batch=*").collect()]
    assert len(got) == 1600 and set(got) == want
    assert max(groups) <= 3  # keys of the state


def test_routing_failures_are_named(spark):
    routed = spark.createDataFrame([(1, "raised", 1), (2, "restated", 1), (3, "folded", 1), (4, "no_authority", None), (5, "no_authority", 1), (6, "raised", None), (7, "raised", 7), (8, "raised", 99), (9, "folded", 7), (10, "suppressed", 10)], "id long, routing string, case_id long").selectExpr("id", "id as t", "routing", "case_id")
    cases = spark.createDataFrame([(1, 2), (7, 3), (10, 10)], "case_id long, decision_id long")
    got = {r.id: r.failure for r in kpis.routing_failures(routed, cases).collect()}
    f = kpis.FAILURES
    assert got == {5: f[0], 6: f[1], 7: f[2], 8: f[4], 10: f[3]}


def test_delta_and_rate_are_null_without_a_base(spark):
    row = spark.range(1).select(kpis.rate(*(x.cast("long") for x in _lits(1, 0))).alias("r"), kpis.delta(*_lits(5.0, 0.0)).alias("d"), kpis.delta(*_lits(3.0, 2.0)).alias("e"), kpis.rate(*_lits(1, 8)).alias("h")).first()
    assert (row.r, row.d, row.e, row.h) == (None, None, 50.0, 12.5)


def _lits(*values):
    from pyspark.sql import functions as F

    return [F.lit(v) for v in values]
