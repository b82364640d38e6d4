"""Verdicts of cases, key figures of a window beside the window before it, and audits of routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FALSE_POSITIVE = ("false_positive", "confirmed_legit")


def verdicts(outcomes: DataFrame) -> DataFrame:
    """One row for each alert_id: the latest disposition speaks, the clock runs to the first, any analyst's row counts as worked."""
    latest = F.max(F.struct("decided_at", "outcome_id", "disposition", "source")).alias("latest")
    history = F.sort_array(F.collect_list(F.struct("decided_at", "outcome_id", "disposition")), asc=False).alias("history")
    by = outcomes.groupBy("alert_id").agg(latest, F.min("decided_at").alias("decided_at"), F.count("*").alias("dispositions"), F.bool_or(F.col("source") == "analyst").alias("worked_by_analyst"), history)
    return by.select("alert_id", F.col("latest.disposition").alias("disposition"), F.col("latest.source").alias("disposition_source"), "decided_at", "dispositions", "worked_by_analyst", "history")


def case_base(cases: DataFrame, verdict: DataFrame) -> DataFrame:
    """Cases (alert_id, first_event_at, ...) with verdict, seconds of triage and whether they were true or false positives."""
    out = cases.join(verdict.drop("history"), "alert_id", "left").withColumn("dispositions", F.coalesce("dispositions", F.lit(0)))
    return out.withColumns({"triage_seconds": (F.col("decided_at") - F.col("first_event_at")) / 1e6, "is_true_positive": F.col("disposition") == "confirmed_fraud", "is_false_positive": F.col("disposition").isin(*FALSE_POSITIVE)})


def execution_base(executions: DataFrame, verdict: DataFrame, preventive: list[str]) -> DataFrame:
    """Executions (alert_id, action, outcome, issued_at, resolved_at) with latency and what the verdict says of a prevention."""
    x = executions.join(verdict.select("alert_id", "disposition"), "alert_id", "left")
    hard = F.col("action").isin(preventive)
    return x.withColumns({"is_preventive": hard, "is_settled": F.col("resolved_at").isNotNull(), "latency_seconds": (F.col("resolved_at") - F.col("issued_at")) / 1e6,
                          "is_prevention_false_positive": (F.col("action") == "challenge") & (F.col("outcome") == "passed") & (F.col("disposition") == "confirmed_legit"), "is_prevention_true_positive": hard & (F.col("disposition") == "confirmed_fraud")})


def attribution(signals: DataFrame) -> DataFrame:
    """(alert_id, rule_id), once for each rule that claims a signal of the case; without claimants the signal's own rule."""
    who = F.when(F.size("claimed") > 0, F.col("claimed")).otherwise(F.array("rule_id"))
    return signals.select("alert_id", F.explode(who).alias("rule_id")).filter("rule_id is not null").distinct()


def windowed(rows: DataFrame, at: str, span: DataFrame, window: int) -> DataFrame:
    """Rows of the window (end - w, end] (now) and of the one before it; span: one row with first and last instant of the decisions. The
    one before counts only where the data reach back to its start."""
    age = F.col("last_at") - F.col(at)
    based = F.col("first_at") <= F.col("last_at") - 2 * window
    met = rows.crossJoin(F.broadcast(span)).filter((age >= 0) & (age < 2 * window))  # span is one row
    return met.withColumns({"now": age < window, "before": (age >= window) & based, "based": based}).drop("first_at", "last_at")


def rate(n: Column, d: Column) -> Column:
    """A percentage, half-even to 2 places; null over an empty denominator."""
    return F.when(d != 0, F.bround(n * 100.0 / d, 2))


def delta(value: Column, baseline: Column) -> Column:
    """Change in percent, half-even to 1 place; null without a baseline or over one of 0."""
    return F.when(baseline != 0, F.bround((value - baseline) / F.abs(baseline) * 100, 1))


def figures(rows: DataFrame, parts: dict[str, tuple[Column, Column, bool]], by: str | None = None, of_all: bool = False) -> DataFrame:
    """(part, value, numerator, denominator, baseline_value, delta_pct) from windowed rows, in one pass; parts: (numerator, denominator,
    whether the value is a rate or else the count). by: a column whose values are the parts, where the given one part is counted; of_all: over the
    denominator of all groups together."""
    count = lambda c, when: F.count_if(c & F.col(when))
    cells = [F.struct(F.lit(name).alias("part"), count(n, "now").alias("n"), count(d, "now").alias("d"), count(n, "before").alias("nb"), count(d, "before").alias("db"), F.lit(is_rate).alias("is_rate")) for name, (n, d, is_rate) in parts.items()]
    grouped = rows.groupBy(F.col(by).alias("group")) if by else rows.groupBy()
    x = grouped.agg(F.coalesce(F.bool_and("based"), F.lit(False)).alias("based"), F.array(*cells).alias("cells")).select(*(["group"] if by else []), "based", F.inline("cells"))
    if by and of_all:
        whole = x.agg(F.sum("d").alias("d"), F.sum("db").alias("db"))  # one row
        x = x.drop("d", "db").crossJoin(F.broadcast(whole))
    value = F.when(F.col("is_rate"), rate(F.col("n"), F.col("d"))).otherwise(F.col("n").cast("double"))
    base = F.when(F.col("based"), F.when(F.col("is_rate"), rate(F.col("nb"), F.col("db"))).otherwise(F.col("nb").cast("double")))
    return x.select(F.col("group").alias("part") if by else "part", value.alias("value"), F.col("n").alias("numerator"), F.col("d").alias("denominator"), base.alias("baseline_value"), delta(value, base).alias("delta_pct"))


FAILURES = ("no authority with a case", "routed without a case", "raised or restated but the case says another decision", "folded or suppressed onto its own case", "case that isn't there")


def routing_failures(routed: DataFrame, cases: DataFrame) -> DataFrame:
    """(id, failure) of decisions (id, t, routing, case_id) whose routing and case (case_id, decision_id, restated) disagree. A case that was
    restated says its last restating decision, so only that one is held against it."""
    c = cases.select(F.col("case_id").alias("there"), "decision_id")
    x = routed.join(c, F.col("case_id") == F.col("there"), "left")
    free = F.col("routing") == "no_authority"
    last = routed.filter(F.col("routing").isin("raised", "restated")).groupBy("case_id").agg(F.max_by("id", F.struct("t", "id")).alias("newest")).withColumnRenamed("case_id", "of")
    x = x.join(last, F.col("case_id") == F.col("of"), "left")
    kind = F.when(free & F.col("case_id").isNotNull(), FAILURES[0]).when(~free & F.col("case_id").isNull(), FAILURES[1]).when(F.col("case_id").isNotNull() & F.col("there").isNull(), FAILURES[4])
    kind = kind.when(F.col("routing").isin("raised", "restated") & (F.col("id") == F.col("newest")) & (F.col("decision_id") != F.col("id")), FAILURES[2]).when(F.col("routing").isin("folded", "suppressed") & (F.col("decision_id") == F.col("id")), FAILURES[3])
    return x.select("id", kind.alias("failure")).filter("failure is not null")
