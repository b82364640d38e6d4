"""Append-only logs and shared tables."""

from riskloom.sources import store
from riskloom.sources.store import DAY


def values(spark, rows):
    return spark.createDataFrame(rows, "feature string, key long, as_of long, computed_at long, value double")


def test_feature_log_is_written_twice_and_read_once(spark, tmp_path):
    log = store.FeatureLog(spark, str(tmp_path / "features"))
    assert log.read().count() == 0
    first = values(spark, [("a", 1, DAY, 5, 1.0), ("a", 1, 3 * DAY, 9, 2.0), ("b", 1, DAY, 5, 7.0), ("a", 2, DAY, 5, None)])
    log.append(0, first)
    log.append(1, values(spark, [("a", 1, 3 * DAY, 11, 3.0), ("a", 1, 9 * DAY, 11, 4.0)]))
    log.append(0, first)  # the batch runs again
    assert log.read().count() == 6
    probes = spark.createDataFrame([(1, 100, 2 * DAY), (1, 101, 3 * DAY), (2, 102, 2 * DAY), (3, 103, DAY), (1, 104, DAY - 1)], "key long, probe_id long, bound long")
    got = {r.probe_id: (r.value, r.as_of) for r in log.as_of("a", probes, 3 * DAY).collect()}
    assert got == {100: (1.0, DAY), 101: (3.0, 3 * DAY), 102: (None, DAY), 103: (None, None), 104: (None, None)}
    assert {r.probe_id: r.value for r in log.as_of("a", probes, 3 * DAY, ceiling=10).collect()}[101] == 2.0  # a later correction isn't known


def test_reads_are_pruned(spark, tmp_path):
    log = store.FeatureLog(spark, str(tmp_path / "features"))
    log.append(0, values(spark, [(f, k, d * DAY, 1, 1.0) for f in "abc" for k in range(3) for d in range(10)]))
    x = log.values(["b"], 4 * DAY, 5 * DAY)
    assert x.count() == 6
    plan = x._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "feature" in filters and "day" in filters
    scans = x.select("value")
    scans.collect()
    assert len(log.read().inputFiles()) >= 30 and "PushedFilters" in plan


def test_ledger_log_keeps_a_key_once(spark, tmp_path):
    schema = "decision_id long, condition_id string, t long, fired boolean"
    rows = lambda r: spark.createDataFrame(r, schema)
    log = store.LedgerLog(spark, str(tmp_path / "ledger"), rows([]).schema, ["decision_id", "condition_id"])
    log.append(0, rows([(1, "a", 5, True), (1, "b", 5, False), (1, "a", 5, True)]))
    log.append(1, rows([(1, "a", 5, False), (2, "a", DAY, True), (2, None, DAY, True)]))
    log.append(1, rows([(1, "a", 5, False), (2, "a", DAY, True), (2, None, DAY, True)]))
    log.append(2, rows([]))
    got = sorted((r.decision_id, r.condition_id or "", r.fired, r.batch) for r in log.read().collect())
    assert got == [(1, "a", True, 0), (1, "b", False, 0), (2, "", True, 1), (2, "a", True, 1)]


def test_shared_table_is_written_once_and_anew_when_inputs_change(spark, tmp_path):
    calls = []

    @store.shared("test", ("t",))
    def table(spark, sf_dir):
        calls.append(sf_dir)
        return spark.read.parquet(f"{sf_dir}/t.parquet")

    sf = str(tmp_path)
    spark.range(5).write.parquet(f"{sf}/t.parquet")
    assert table(spark, sf).count() == 5 and table(spark, sf).count() == 5 and len(calls) == 1
    spark.range(50).write.mode("overwrite").parquet(f"{sf}/t.parquet")
    assert table(spark, sf).count() == 50 and len(calls) == 2
