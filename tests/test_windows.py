"""Growing frames, exposures by hours, running balances, scenarios: against plain loops."""

import random
from collections import defaultdict
from decimal import Decimal

from pyspark.sql import functions as F

from riskloom.functions.windows import micros, trailing
from riskloom.operators import exposure, reducers, rules

H = 3_600_000_000


def history(spark, n=400):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        t = rng.choice([rng.randrange(60 * 24) * H // 2, rng.randrange(40) * 24 * H, 7])
        rows.append((i, t, None if rng.random() < 0.05 else Decimal(rng.randrange(1, 9999)) / 100, rng.choice([1, 1, 1, 2, None]), rng.choice(["inbound", "outbound", "debit"]), rng.choice(["approved", "approved", "declined"]), i % 4))
    rows.append((n, -5 * H, Decimal(3), 1, "outbound", "approved", 0))
    return rows, spark.createDataFrame(rows, "txn_id long, t long, amount decimal(18,4), account_id long, direction string, auth_result string, device_id int").repartition(3)


def test_counts_and_sums_over_windows(spark):
    rows, df = history(spark)
    for window, lag in (("1d", None), ("7d", "2h"), (None, None), (None, "1d")):
        w = trailing("account_id", window, lag)
        got = {r.txn_id: (r.n, r.s) for r in df.select("txn_id", reducers.count(F.col("direction") == "inbound", w).alias("n"), reducers.total(F.col("direction") == "inbound", "amount", w).alias("s")).collect()}
        for i, t, _, account, *_ in rows:
            mine = [r for r in rows if r[3] == account and r[4] == "inbound" and r[1] <= t - (micros(lag) if lag else 0) and (window is None or r[1] > t - micros(window))]
            amounts = [r[2] for r in mine if r[2] is not None]
            assert got[i] == (len(mine), sum(amounts) if amounts else None)


def test_windows_without_the_row_itself(spark):
    rows, df = history(spark)
    w, debit = trailing("account_id", "2d"), F.col("direction") == "debit"
    got = {r.txn_id: (r.n, r.s) for r in df.select("txn_id", reducers.count(debit, w, exclude_self=True).alias("n"), reducers.total(debit, "amount", w, exclude_self=True).alias("s")).collect()}
    for i, t, _, account, *_ in rows:
        others = [r for r in rows if r[3] == account and r[4] == "debit" and t - 48 * H < r[1] <= t and r[0] != i]
        amounts = [r[2] for r in others if r[2] is not None]
        assert got[i] == (len(others), sum(amounts) if amounts else None)


def test_exposures_by_hours(spark):
    """Each exposure is the plain sum of its window; hours, negative times, hot and missing keys make no difference."""
    rows, df = history(spark)
    got = {(r.txn_id, r.subject_type): (r.basis, r.exposure) for r in exposure.exposures(df, {"account": "account_id", "device": "device_id"}).collect()}
    assert len(got) == 3 * len(rows)
    for i, t, amount, account, _, _, device in rows:
        total = lambda days, keep: sum((r[2] for r in rows if r[2] is not None and t - days * 24 * H < r[1] <= t and keep(r)), Decimal(0))
        assert got[i, "account"] == ("outbound_90d", 0 if account is None else total(90, lambda r, a=account: r[3] == a and r[4] == "outbound"))
        assert got[i, "device"] == ("volume_30d", total(30, lambda r, d=device: r[6] == d)) and got[i, "transaction"] == ("amount", amount)


def test_running_balance(spark):
    rows, df = history(spark)
    rows = [r for r in rows if r[2] is not None]
    got = {r.txn_id: r.value for r in reducers.pct_of_running_balance(df.filter("amount is not null"), "account_id", "7d").collect()}
    for i, t, _, account, *_ in rows:
        mine = [r for r in rows if r[3] == account and t - 7 * 24 * H < r[1] <= t and r[5] == "approved"]
        last = max(((r[1], r[0], r[2]) for r in mine if r[4] == "outbound"), default=None)
        balance = sum((r[2] if r[4] == "inbound" else -r[2] for r in mine if last and r[1] < last[0]), Decimal(0))
        want = float(100 * last[2]) / float(balance) if last and balance else None
        assert (got[i] is None) == (want is None) and (want is None or abs(got[i] - want) < 1e-9 * max(1, abs(want))), i


def test_scenarios_do_not_see_each_other(spark):
    values = spark.createDataFrame([(s, "f", float(s), "present") for s in range(20)], "subject long, feature string, value double, status string")
    made = {"low": (5.0, 10), "high": (15.0, 30), "never": (99.0, 10)}
    conditions = spark.createDataFrame([(k, "R", "c", "f", ">", x, p, True) for k, (x, p) in made.items()], "scenario string, rule_id string, condition_id string, feature string, op string, operand double, points int, required boolean")
    catalog = spark.createDataFrame([(k, "R", "alert", 2, False, False, 10, 999) for k in made], "scenario string, rule_id string, action string, severity int, preventive boolean, is_veto boolean, review int, prevent int")
    rows = rules.scenarios(values, conditions, catalog)
    d = rules.decide(rules.rule_scores(rows), rules.consolidate(rows), [("high", 20), ("low", 0)]).select("subject.*", "score", "band", "source_rule").collect()
    by = defaultdict(dict)
    for r in d:
        by[r.scenario][r.subject] = (r.score, r.source_rule)
    assert by == {k: {s: (p, "R") if s > x else (0, None) for s in range(20)} for k, (x, p) in made.items()}
