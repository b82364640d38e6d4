"""What would be decided: many candidate rule sets in one pass, hypothetical rows that don't see each other, subjects scored again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import micros, trailing
from ..operators import reducers, rules
from ..sources.tables import transactions
from .queries import _DECIDE, _LEDGER, BANDS, CONDITION_SCHEMA, CONDITIONS, RULE_SCHEMA, RULES, TX, WEEK, _literal, decided, facts, query, sheet, stored
from .wider import _as_ctes, off_ladder

_c = F.col


def _without(rows, rule_id):
    return [r for r in rows if r[0] != rule_id]


SCENARIOS = {
    "base": (RULES, CONDITIONS),
    "R2 at 35": ([*_without(RULES, "R2"), ("R2", "alert", 2, False, False, 35, 999)], CONDITIONS),
    "without R1": (_without(RULES, "R1"), _without(CONDITIONS, "R1")),
    "with R9": ([*RULES, ("R9", "challenge", 4, True, False, 25, 25)], [*CONDITIONS, ("R9", "c1", "amt", ">", 80.0, 30, True), ("R9", "c2", "z", "<", 0.3, -8, False)]),
}


def swapped(sql: str, *pairs: tuple[str, str]) -> str:
    """sql with each first text in place of its second; a text that isn't there is an error."""
    for old, new in pairs:
        if old not in sql:
            raise ValueError(f"not in the SQL: {old[:80]}")
        sql = sql.replace(old, new)
    return sql


def _scenario_sql(last: str) -> str:
    """A CTE for each scenario (x0, x1, ...), of the decisions (d) or the ledger (l)."""
    whole = _DECIDE if last == "d" else _LEDGER
    each = (swapped(whole, (_literal(CONDITIONS), _literal(c)), (_literal(RULES), _literal(r))) for r, c in SCENARIOS.values())
    return "WITH " + ", ".join(_as_ctes(sql, last, f"x{i}") for i, sql in enumerate(each)) + f", {TX}, x AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT '{name}' AS scenario, * FROM x{i}" for i, name in enumerate(SCENARIOS)) + ")"


def _scenarios(spark, sf_dir, rows) -> DataFrame:
    """What `rows` makes of each scenario's rules on the stored facts, side by side; the facts are worked out once."""
    each = (rows(stored(spark, sf_dir, r, c)).withColumn("scenario", F.lit(name)) for name, (r, c) in SCENARIOS.items())
    return reduce(DataFrame.unionByName, each)


@query("backtest_many", _scenario_sql("d") + " SELECT scenario, band, count(*) AS n, count(*) FILTER (rules_fired <> '') AS would_fire, count(*) FILTER (rules_authorised <> '') AS would_alert, count(*) FILTER (source_rule IS NOT NULL) AS would_carry, min(score) FILTER (score > 0) AS least, list_sort(list(score) FILTER (score > 0))[count(*) FILTER (score > 0) // 2 + 1] AS middle, max(score) FILTER (score > 0) AS most, round(count(*) FILTER (rules_authorised <> '' AND label = 'fraud') / nullif(count(*) FILTER (rules_authorised <> ''), 0), 6) AS precision FROM x JOIN tx ON txn_id = subject GROUP BY 1, 2")
def backtest_many(spark, sf_dir):
    """Candidate rule sets side by side on one ledger: how many would fire, alert and carry an action, the spread of scores, precision."""
    d = _scenarios(spark, sf_dir, lambda x: x.decisions(BANDS, "label"))
    alert, by = _c("rules_authorised") != "", ["scenario", "band"]
    ladder = d.groupBy(*by, "score").agg(F.count("*").alias("n"), F.count_if(_c("rules_fired") != "").alias("would_fire"), F.count_if(alert).alias("would_alert"), F.count_if(_c("source_rule").isNotNull()).alias("would_carry"), F.count_if(alert & (_c("label") == "fraud")).alias("right"))
    return off_ladder(ladder, by, ["n", "would_fire", "would_alert", "would_carry"], F.round(F.sum("right") / F.when(F.sum("would_alert") > 0, F.sum("would_alert")), 6).alias("precision"))


@query("backtest_conditions", _scenario_sql("l") + " SELECT scenario, rule_id, condition_id, count(*) AS visited, count(*) FILTER (fired) AS n_fired, sum(contributed)::BIGINT AS points, round(count(*) FILTER (fired AND label = 'fraud') / nullif(count(*) FILTER (fired), 0), 6) AS on_fraud FROM x JOIN tx ON txn_id = subject GROUP BY 1, 2, 3")
def backtest_conditions(spark, sf_dir):
    """The candidates' conditions: how often each fires, what it takes, and how often on fraud."""
    rows = _scenarios(spark, sf_dir, lambda x: x.ledger("label"))
    n = F.count_if("fired")
    return rows.groupBy("scenario", "rule_id", "condition_id").agg(F.count("*").alias("visited"), n.alias("n_fired"), F.sum("contributed").alias("points"), F.round(F.count_if(_c("fired") & (_c("label") == "fraud")) / F.when(n > 0, n), 6).alias("on_fraud"))


AMOUNTS = [12, 75, 400]
_HYPOTHESES = swapped(_DECIDE, (_DECIDE[_DECIDE.index("f AS (SELECT p.txn_id"):_DECIDE.index(" v AS (SELECT subject, 'n7'")], f"""hy AS (SELECT account_id * 10 + k AS subject, account_id, max(t) + {micros('1h')} AS t, amount, CASE k WHEN 1 THEN 3 WHEN 2 THEN 7 END AS mcc FROM (SELECT account_id, t FROM tx), (VALUES {', '.join(f'({k}, {a}::DOUBLE)' for k, a in enumerate(AMOUNTS))}) a(k, amount) GROUP BY account_id, k, amount),
 hs AS (SELECT hy.subject, count(*) FILTER (tx.t > hy.t - {WEEK}) AS n, avg(CAST(tx.amount AS DOUBLE)) AS m, stddev_samp(CAST(tx.amount AS DOUBLE)) AS sd FROM hy JOIN tx ON tx.account_id = hy.account_id AND tx.t <= hy.t GROUP BY 1),
 f AS (SELECT hy.subject, n + 1 AS n7, amount AS amt, CAST(mcc AS DOUBLE) AS mcc, round(CASE WHEN sd > 0.00004 THEN abs(amount - m) / sd END, 6) AS z FROM hy JOIN hs ON hs.subject = hy.subject),
"""))


@query("hypothetical_scores", _HYPOTHESES + " SELECT subject, score, band, action, source_rule, rules_fired FROM d")
def hypothetical_scores(spark, sf_dir):
    """Three made-up charges for each account an hour after its last, each scored against the history and itself alone: none of them sees
    another, and none is stored. Hypotheses stand as rows in the account's windows but are never counted in them."""
    x = transactions(spark, sf_dir).select("account_id", "t", _c("amount").cast("double").alias("amount"), F.lit(None).cast("long").alias("hypothesis"), F.lit(None).cast("int").alias("mcc"))
    last = x.groupBy("account_id").agg((F.max("t") + micros("1h")).alias("t"))
    each = F.array(*(F.struct(F.lit(float(a)).alias("amount"), F.lit(k).cast("long").alias("k"), F.lit({1: 3, 2: 7}.get(k)).cast("int").alias("mcc")) for k, a in enumerate(AMOUNTS)))
    made_up = last.select("account_id", "t", F.inline(each)).select("account_id", "t", "amount", (_c("account_id") * 10 + _c("k")).alias("hypothesis"), "mcc")
    real = _c("hypothesis").isNull()
    seen = F.when(real, _c("amount"))
    everything = trailing("account_id")
    n, s, q = F.count(seen).over(everything), F.sum(seen).over(everything), F.sum(seen * seen).over(everything)
    variance = F.when(n > 1, F.greatest(F.lit(0.0), (q - s * s / n) / (n - 1)))
    z = F.abs(_c("amount") - s / n) / F.sqrt(F.when(variance > 1e-9, variance))
    rows = x.unionByName(made_up).withColumns({"n7": reducers.count(real, trailing("account_id", "7d")) + 1, "z": F.round(z, 6)}).filter(~real)
    named = lambda name, c: F.struct(F.lit(name).alias("feature"), c.cast("double").alias("value"))
    values = rows.select(_c("hypothesis").alias("subject"), F.inline(F.array(named("n7", _c("n7")), named("amt", _c("amount")), named("z", _c("z")), named("mcc", _c("mcc")))))
    values = values.withColumn("status", F.when(_c("value").isNull(), "absent").otherwise("present"))
    ledger = rules.ledger(values, spark.createDataFrame(CONDITIONS, CONDITION_SCHEMA), spark.createDataFrame(RULES, RULE_SCHEMA))
    return rules.decide(rules.rule_scores(ledger), rules.consolidate(ledger), BANDS).select("subject", "score", "band", "action", "source_rule", "rules_fired")


@query("rescore_subjects", _DECIDE + " SELECT subject, score, band, action, source_rule FROM d WHERE source_rule IS NOT NULL")
def rescore_subjects(spark, sf_dir):
    """The subjects whose stored decision has authority, scored again: only their accounts' histories are read into windows."""
    asked = decided(spark, sf_dir).filter("source_rule is not null").select(_c("id").alias("subject"))
    return sheet(spark, sf_dir, of=facts(spark, sf_dir, asked)).decisions(BANDS).select("subject", "score", "band", "action", "source_rule")


@query("rescore_all", _DECIDE + " SELECT subject, score, band, action, (SELECT max(t) FROM tx) AS as_of FROM d")
def rescore_all(spark, sf_dir):
    """A full rescore as of the later of a reference instant and the newest event."""
    reference = 1704067200000000
    d = sheet(spark, sf_dir).decisions(BANDS)
    frontier = transactions(spark, sf_dir).agg(F.greatest(F.lit(reference), F.max("t")).alias("as_of"))  # one row
    return d.select("subject", "score", "band", "action").crossJoin(F.broadcast(frontier))
