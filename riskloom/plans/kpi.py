"""Cases, their verdicts and executions, and the key figures over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import micros, trailing
from ..operators import cases, kpis, reducers
from ..sources.store import shared
from ..sources.tables import action_outcomes, case_outcomes, transactions
from .queries import _ISSUED, INPUTS, PREVENTIVE, actions_issued, decided, query, signals

W = micros("10d")

BASE = _ISSUED + """, al AS MATERIALIZED (SELECT case_id AS alert_id, min(t) AS first_event_at, max(t) AS last_event_at, count(*) AS triggering_events, arg_max(subject, (t, subject)) FILTER (routing <> 'folded') AS decision_id FROM routed JOIN dt ON id = subject WHERE routing IN ('raised', 'restated', 'folded') GROUP BY 1),
 co AS MATERIALIZED (SELECT o_orderkey AS outcome_id, o_orderkey // 2 AS alert_id, CASE o_orderstatus WHEN 'F' THEN 'confirmed_fraud' WHEN 'O' THEN 'false_positive' ELSE CASE WHEN o_orderpriority = '1-URGENT' THEN 'confirmed_legit' ELSE 'inconclusive' END END AS disposition, CASE WHEN o_orderkey % 3 = 0 THEN 'analyst' ELSE 'synthetic' END AS source, tx.t + (30 + o_custkey % 2880) * 60000000 AS decided_at FROM orders JOIN tx ON txn_id = o_orderkey // 2),
 vd AS MATERIALIZED (SELECT alert_id, arg_max(disposition, (decided_at, outcome_id)) AS disposition, arg_max(source, (decided_at, outcome_id)) AS disposition_source, min(decided_at) AS decided_at, count(*) AS dispositions, bool_or(source = 'analyst') AS worked_by_analyst FROM co GROUP BY 1),
 kc AS MATERIALIZED (SELECT al.*, dt.score, dt.band, dt.action, dt.source_rule, disposition, disposition_source, decided_at, coalesce(dispositions, 0) AS dispositions, (decided_at - first_event_at) / 1e6 AS triage_seconds, disposition = 'confirmed_fraud' AS is_true_positive, disposition IN ('false_positive', 'confirmed_legit') AS is_false_positive FROM al JOIN dt ON dt.subject = al.decision_id LEFT JOIN vd ON vd.alert_id = al.alert_id),
 kd AS MATERIALIZED (SELECT dt.subject AS decision_id, dt.t AS event_at, dt.score, band, action, routing, case_id, routing IN ('raised', 'restated') AS became_case, label = 'fraud' AS is_fraud, channel = 'cnp' AS fail_open FROM dt JOIN routed ON id = dt.subject JOIN tx ON txn_id = dt.subject),
 ao AS (SELECT o_orderkey // 3 AS subject, ['passed', 'failed', 'abandoned'][o_orderkey % 4 + 1] AS outcome, o_custkey % 600 AS seconds FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 4 <> 3),
 ke AS MATERIALIZED (SELECT issued.subject AS decision_id, case_id AS alert_id, issued.action, dt.t AS issued_at, CASE WHEN issued.action = 'challenge' THEN outcome END AS outcome, CASE WHEN issued.action = 'challenge' AND outcome IS NOT NULL THEN dt.t + seconds * 1000000 END AS resolved_at, vd.disposition FROM issued JOIN dt ON dt.subject = issued.subject JOIN routed ON id = issued.subject LEFT JOIN ao ON ao.subject = issued.subject LEFT JOIN vd ON vd.alert_id = case_id),
 asg AS MATERIALIZED (SELECT alert_id, first_event_at, sg.* FROM al JOIN sg ON sg.subject = al.decision_id),
 ra AS (SELECT DISTINCT alert_id, first_event_at, unnest(claimed) AS rule_id FROM asg),
 sp AS (SELECT min(event_at) AS first_at, max(event_at) AS last_at FROM kd)"""


@shared("cases", INPUTS)
def _cases(spark, sf_dir) -> DataFrame:
    d = decided(spark, sf_dir)
    return cases.fold(d.select("id", "routing", "case_id"), d.select("id", "t", "score", "band", "action", "source_rule")).withColumnRenamed("case_id", "alert_id")


def _case_base(spark, sf_dir) -> DataFrame:
    return kpis.case_base(_cases(spark, sf_dir), kpis.verdicts(case_outcomes(spark, sf_dir)))


def _executions(spark, sf_dir) -> DataFrame:
    """Issued actions with the answers to challenges."""
    x = actions_issued(spark, sf_dir).withColumnRenamed("case_id", "alert_id").join(action_outcomes(spark, sf_dir), "subject", "left")
    asked = F.col("action") == "challenge"
    x = x.withColumns({"outcome": F.when(asked, F.col("outcome")), "resolved_at": F.when(asked, F.col("issued_at") + F.col("seconds") * 1_000_000)})
    return kpis.execution_base(x.withColumnRenamed("subject", "decision_id"), kpis.verdicts(case_outcomes(spark, sf_dir)), PREVENTIVE)


def _signals(spark, sf_dir) -> DataFrame:
    """Signals of each case: those of the decision that it says."""
    s = signals(spark, sf_dir).withColumnRenamed("subject", "decision_id")
    return _cases(spark, sf_dir).select("alert_id", "decision_id", "first_event_at").join(s, "decision_id")


def _span(spark, sf_dir) -> DataFrame:
    return decided(spark, sf_dir).agg(F.min("t").alias("first_at"), F.max("t").alias("last_at"))


def _figures(spark, sf_dir, rows: DataFrame, at: str, parts: dict, by: str | None = None, window: int = W) -> DataFrame:
    return kpis.figures(kpis.windowed(rows, at, _span(spark, sf_dir), window), parts, by)


def _sql(base: str, at: str, parts: dict, by: str | None = None, window: int = W, of_all: bool = False) -> str:
    """The figures as SQL: parts as (numerator, denominator, is a rate). of_all: a group's denominator is that of all groups."""
    out = []
    for name, (n, d, is_rate) in parts.items():
        cell = lambda c, when: f"count(*) FILTER (({c}) AND {when})"
        whole = (lambda c: f"sum({c}) OVER ()::BIGINT") if of_all else (lambda c: c)
        now, before = f"last_at - {at} < {window}", f"last_at - {at} >= {window}"
        value = (lambda a, b: f"CASE WHEN {b} <> 0 THEN round_even({a} * 100.0 / {b}, 2) END") if is_rate else (lambda a, b: f"CAST({a} AS DOUBLE)")
        inner = f"SELECT {by if by else repr(name)} AS part, coalesce(bool_and(first_at <= last_at - {2 * window}), FALSE) AS based, {cell(n, now)} AS n, {whole(cell(d, now))} AS d, {cell(n, before)} AS nb, {whole(cell(d, before))} AS db FROM {base}, sp WHERE last_at - {at} BETWEEN 0 AND {2 * window - 1}" + (f" GROUP BY {by}" if by else "")
        out.append(f"SELECT part, {value('n', 'd')} AS value, n AS numerator, d AS denominator, CASE WHEN based THEN {value('nb', 'db')} END AS baseline_value FROM ({inner})")
    return BASE + " SELECT *, CASE WHEN baseline_value <> 0 THEN round_even((value - baseline_value) / abs(baseline_value) * 100, 1) END AS delta_pct FROM (" + " UNION ALL ".join(out) + ")"


def _tile(name: str, rows, base: str, at: str, parts: dict, by: str | None = None, window: int = W, headline: dict | None = None) -> None:
    """A tile whose conditions read the same in Spark's SQL and DuckDB's. headline: figures over all rows beside those of the groups, which
    then have all rows as their denominator."""

    def run(spark, sf_dir):
        of = lambda ps: {k: (F.coalesce(F.expr(n), F.lit(False)), F.coalesce(F.expr(d), F.lit(False)), r) for k, (n, d, r) in ps.items()}
        met = kpis.windowed(rows(spark, sf_dir), at, _span(spark, sf_dir), window)
        out = kpis.figures(met, of(parts), by, of_all=headline is not None)
        return out.unionByName(kpis.figures(met, of(headline))) if headline else out

    sql = _sql(base, at, parts, by, window, headline is not None)
    if headline:
        sql += " UNION ALL " + _sql(base, at, headline, None, window)[len(BASE):]
    query(name, sql)(run)


def _decision_rows(spark, sf_dir):
    return decided(spark, sf_dir).withColumns({"event_at": F.col("t"), "became_case": F.col("routing").isin("raised", "restated"), "is_fraud": F.col("label") == "fraud", "fail_open": F.col("channel") == "cnp"})


def _reason_rows(spark, sf_dir):
    return _signals(spark, sf_dir).select("alert_id", "first_event_at", F.concat(F.lit("reason:"), "feature").alias("reason_code")).distinct()


def _attributed(spark, sf_dir):
    s = _signals(spark, sf_dir)
    base = _case_base(spark, sf_dir).select("alert_id", "first_event_at", "score", "band", "disposition", "is_true_positive", "is_false_positive", "source_rule")
    return kpis.attribution(s).join(base, "alert_id").withColumn("carried_the_action", F.col("source_rule") == F.col("rule_id"))


_CASES, _ATTRIBUTED, _REASONS = "kc", "(SELECT ra.alert_id, ra.rule_id, kc.first_event_at, kc.score, kc.band, disposition, is_true_positive, is_false_positive, source_rule, source_rule = ra.rule_id AS carried_the_action FROM ra JOIN kc ON kc.alert_id = ra.alert_id) x", "(SELECT DISTINCT alert_id, first_event_at, concat('reason:', feature) AS reason_code FROM asg) x"
_EVERY = "true"

_tile("kpi_alert_volume", _decision_rows, "kd", "event_at", {"cases": ("became_case", _EVERY, False), **{r: (f"routing = '{r}'", _EVERY, False) for r in ("raised", "restated", "folded", "suppressed", "no_authority")}})
_tile("kpi_score_distribution", lambda s, d: _decision_rows(s, d).withColumn("part", F.concat_ws(":", F.lit("transaction"), "band")), "(SELECT *, concat('transaction:', band) AS part FROM kd) x", "event_at", {"n": (_EVERY, _EVERY, False)}, "part", headline={"scoring": ("score > 0", _EVERY, False)})
_tile("kpi_false_positive_rate", _case_base, _CASES, "first_event_at", {"rate": ("is_false_positive", "disposition is not null", True), "inconclusive": ("disposition = 'inconclusive'", _EVERY, False)})
_tile("kpi_false_negative_rate", _decision_rows, "kd", "event_at", {"rate": ("is_fraud and not became_case", "is_fraud", True)})
_tile("kpi_no_baseline", _decision_rows, "kd", "event_at", {"cases": ("became_case", _EVERY, False), "missed": ("is_fraud and not became_case", "is_fraud", True)}, window=micros("20d"))
_tile("kpi_validation_outcomes", lambda s, d: _case_base(s, d).withColumn("part", F.coalesce("disposition", F.lit("undispositioned"))), "(SELECT *, coalesce(disposition, 'undispositioned') AS part FROM kc) x", "first_event_at", {"n": (_EVERY, _EVERY, False)}, "part", headline={"settled": ("disposition is not null", _EVERY, False)})
_tile("kpi_provenance", _case_base, _CASES, "first_event_at", {"synthetic": ("disposition_source = 'synthetic'", "disposition is not null", False), "analyst": ("disposition_source = 'analyst'", "disposition is not null", False)})
_tile("kpi_rule_precision", _attributed, _ATTRIBUTED, "first_event_at", {"precision": ("is_true_positive", "disposition is not null", True)}, "rule_id")
_tile("kpi_trends", _reason_rows, _REASONS, "first_event_at", {"n": (_EVERY, _EVERY, False)}, "reason_code")
def _acted(spark, sf_dir):
    """Executions and the decisions evaluated, told apart by `kind`: rates of what was done to customers, over each other or over decisions."""
    x = _executions(spark, sf_dir).select(F.lit("done").alias("kind"), F.col("issued_at").alias("event_at"), "action", "outcome", "is_preventive", "is_prevention_false_positive", "is_prevention_true_positive", F.lit(False).alias("fail_open"))
    d = _decision_rows(spark, sf_dir).select(F.lit("decided").alias("kind"), "event_at", "fail_open")
    return x.unionByName(d, allowMissingColumns=True)


_ACTED = "(SELECT 'done' AS kind, issued_at AS event_at, action, outcome, action = 'challenge' AS is_preventive, coalesce(action = 'challenge' AND outcome = 'passed' AND disposition = 'confirmed_legit', FALSE) AS is_prevention_false_positive, coalesce(action = 'challenge' AND disposition = 'confirmed_fraud', FALSE) AS is_prevention_true_positive, FALSE AS fail_open FROM ke UNION ALL SELECT 'decided', event_at, NULL, NULL, NULL, NULL, NULL, fail_open FROM kd) x"
_EXECUTED = {
    "challenge pass rate": ("action = 'challenge' and outcome = 'passed'", "action = 'challenge'", True), "challenge abandon rate": ("action = 'challenge' and outcome = 'abandoned'", "action = 'challenge'", True),
    "holds issued": ("action = 'hold'", "kind = 'decided'", False), "blocks issued": ("action = 'block'", "kind = 'decided'", False), "notifications": ("action = 'notify'", "kind = 'decided'", False),
    "prevention false positives": ("is_prevention_false_positive", "is_preventive", False), "prevention true positives": ("is_prevention_true_positive", "is_preventive", False),
}
_tile("kpi_executions_rates", _acted, _ACTED, "event_at", _EXECUTED)
_tile("kpi_action_rates", _acted, _ACTED, "event_at", {"preventive": ("is_preventive", "kind = 'decided'", True), **_EXECUTED, "fail-open": ("fail_open", "kind = 'decided'", True)})


def kpi_triage_time(spark, sf_dir):
    rows = kpis.windowed(_case_base(spark, sf_dir), "first_event_at", _span(spark, sf_dir), W)
    at = lambda p, when: F.bround(F.percentile(F.when(F.col(when), F.col("triage_seconds")), p), 2)
    n, d = F.count_if(F.col("now") & F.col("triage_seconds").isNotNull()), F.count_if("now")
    cells = F.array(*[F.struct(F.lit(name).alias("part"), at(p, "now").alias("value"), n.alias("numerator"), d.alias("denominator"), at(p, "before").alias("baseline_value")) for name, p in (("median", 0.5), ("p90", 0.9))])
    x = rows.agg(cells.alias("cells")).select(F.inline("cells"))
    return x.withColumn("delta_pct", kpis.delta(F.col("value"), F.col("baseline_value")))


_Q = ", ".join(f"round_even(quantile_cont(CASE WHEN last_at - first_event_at {op} {W} THEN triage_seconds END, {p}), 2) AS {n}" for n, op, p in (("m", "<", 0.5), ("q", "<", 0.9), ("mb", ">=", 0.5), ("qb", ">=", 0.9)))
query("kpi_triage_time", BASE + f", z AS (SELECT {_Q}, count(triage_seconds) FILTER (last_at - first_event_at < {W}) AS numerator, count(*) FILTER (last_at - first_event_at < {W}) AS denominator FROM kc, sp WHERE last_at - first_event_at BETWEEN 0 AND {2 * W - 1}), y AS (SELECT 'median' AS part, m AS value, numerator, denominator, mb AS baseline_value FROM z UNION ALL SELECT 'p90', q, numerator, denominator, qb FROM z) SELECT *, CASE WHEN baseline_value <> 0 THEN round_even((value - baseline_value) / abs(baseline_value) * 100, 1) END AS delta_pct FROM y")(kpi_triage_time)


@query("kpi_cases", BASE + " SELECT alert_id, decision_id, first_event_at, last_event_at, triggering_events, score, band, action, source_rule, disposition, disposition_source, dispositions, triage_seconds, is_true_positive, is_false_positive FROM kc")
def kpi_cases(spark, sf_dir):
    return _case_base(spark, sf_dir).select("alert_id", "decision_id", "first_event_at", "last_event_at", "triggering_events", "score", "band", "action", "source_rule", "disposition", "disposition_source", "dispositions", "triage_seconds", "is_true_positive", "is_false_positive")


@query("kpi_decisions", BASE + " SELECT decision_id, event_at, score, band, action, routing, case_id, became_case, is_fraud, fail_open FROM kd")
def kpi_decisions(spark, sf_dir):
    return _decision_rows(spark, sf_dir).select(F.col("id").alias("decision_id"), "event_at", "score", "band", "action", "routing", "case_id", "became_case", "is_fraud", "fail_open")


@query("kpi_executions", BASE + " SELECT decision_id, alert_id, action, outcome, action = 'challenge' AS is_preventive, resolved_at IS NOT NULL AS is_settled, (resolved_at - issued_at) / 1e6 AS latency_seconds FROM ke")
def kpi_executions(spark, sf_dir):
    return _executions(spark, sf_dir).select("decision_id", "alert_id", "action", "outcome", "is_preventive", "is_settled", "latency_seconds")


@query("kpi_rule_attribution", BASE + f" SELECT alert_id, rule_id, disposition, is_true_positive, is_false_positive, carried_the_action FROM {_ATTRIBUTED}")
def kpi_rule_attribution(spark, sf_dir):
    return _attributed(spark, sf_dir).select("alert_id", "rule_id", "disposition", "is_true_positive", "is_false_positive", "carried_the_action")


@query("kpi_reason_codes", BASE + f" SELECT alert_id, reason_code FROM {_REASONS}")
def kpi_reason_codes(spark, sf_dir):
    return _reason_rows(spark, sf_dir).select("alert_id", "reason_code")


@query("verdict_read", BASE + ", hist AS (SELECT alert_id, string_agg(outcome_id || '=' || disposition, ',' ORDER BY decided_at DESC, outcome_id DESC) AS history FROM co GROUP BY 1) SELECT vd.alert_id, disposition, disposition_source, decided_at, dispositions, worked_by_analyst, history FROM vd JOIN hist ON hist.alert_id = vd.alert_id")
def verdict_read(spark, sf_dir):
    v = kpis.verdicts(case_outcomes(spark, sf_dir))
    text = F.array_join(F.transform("history", lambda h: F.concat_ws("=", h["outcome_id"].cast("string"), h["disposition"])), ",")
    return v.withColumn("history", text)


@query("signal_rank", BASE + " SELECT alert_id, feature, direction, contribution, row_number() OVER (PARTITION BY alert_id ORDER BY -abs(contribution), feature, direction) AS rank FROM asg")
def signal_rank(spark, sf_dir):
    order = Window.partitionBy("alert_id").orderBy(-F.abs("contribution"), "feature", "direction")
    return _signals(spark, sf_dir).withColumn("rank", F.row_number().over(order)).select("alert_id", "feature", "direction", "contribution", "rank")


@query("alert_list", BASE + ", li AS (SELECT alert_id, string_agg(feature || ':' || CAST(contribution AS INTEGER), ',' ORDER BY -abs(contribution), feature, direction) AS signals FROM asg GROUP BY 1) SELECT kc.alert_id, score, band, action, source_rule, account_id AS subject_id, signals FROM kc JOIN dt ON dt.subject = kc.decision_id LEFT JOIN li ON li.alert_id = kc.alert_id WHERE kc.band <> 'low' ORDER BY kc.score DESC, kc.alert_id LIMIT 50 OFFSET 10".replace("account_id AS subject_id", "dt.account_id AS subject_id").replace("kc.alert_id, score, band, action, source_rule", "kc.alert_id, kc.score, kc.band, kc.action, kc.source_rule"))
def alert_list(spark, sf_dir):
    """The second page of the cases above the lowest band, each with its signals in order and the subject that it covers."""
    line = F.sort_array(F.collect_list(F.struct(-F.abs("contribution"), "feature", "direction", F.concat_ws(":", "feature", F.col("contribution").cast("int").cast("string")).alias("text"))))
    signals = _signals(spark, sf_dir).groupBy("alert_id").agg(line.alias("s")).select("alert_id", F.array_join("s.text", ",").alias("signals"))
    who = transactions(spark, sf_dir).select(F.col("txn_id").alias("decision_id"), F.col("account_id").alias("subject_id"))
    rows = _cases(spark, sf_dir).filter("band <> 'low'").orderBy(F.desc("score"), "alert_id").offset(10).limit(50)
    return rows.join(who, "decision_id").join(signals, "alert_id", "left").select("alert_id", "score", "band", "action", "source_rule", "subject_id", "signals")


def _tampered(d: DataFrame) -> DataFrame:
    """Routed decisions of which some that a rule of their id picks are spoiled, so that the audit has each failure to find."""
    k = F.col("id") % 101
    authorised = F.col("routing") != "no_authority"
    case = F.when(~authorised & (k == 7), F.col("id")).when(authorised & (k == 11), F.lit(None)).when(authorised & (k == 13), -F.col("id") - 1).otherwise(F.col("case_id"))
    routing = F.when((F.col("routing") == "raised") & (k == 17), "folded").when((F.col("routing") == "folded") & (k == 19), "restated").otherwise(F.col("routing"))
    return d.select("id", "t", routing.alias("routing"), case.alias("case_id"))


_AUDIT = """, tam AS (SELECT r.id, dt.t, CASE WHEN routing = 'raised' AND r.id % 101 = 17 THEN 'folded' WHEN routing = 'folded' AND r.id % 101 = 19 THEN 'restated' ELSE routing END AS routing,
  CASE WHEN routing = 'no_authority' AND r.id % 101 = 7 THEN r.id WHEN routing <> 'no_authority' AND r.id % 101 = 11 THEN NULL WHEN routing <> 'no_authority' AND r.id % 101 = 13 THEN -r.id - 1 ELSE case_id END AS case_id FROM routed r JOIN dt ON dt.subject = r.id),
 newest AS (SELECT case_id, arg_max(id, (t, id)) AS id FROM tam WHERE routing IN ('raised', 'restated') AND case_id IS NOT NULL GROUP BY 1),
 fa AS (SELECT CASE WHEN routing = 'no_authority' AND tam.case_id IS NOT NULL THEN 'no authority with a case' WHEN routing <> 'no_authority' AND tam.case_id IS NULL THEN 'routed without a case' WHEN tam.case_id IS NOT NULL AND al.alert_id IS NULL THEN 'case that isn''t there'
  WHEN routing IN ('raised', 'restated') AND newest.id = tam.id AND al.decision_id <> tam.id THEN 'raised or restated but the case says another decision' WHEN routing IN ('folded', 'suppressed') AND al.decision_id = tam.id THEN 'folded or suppressed onto its own case' END AS failure
  FROM tam LEFT JOIN al ON al.alert_id = tam.case_id LEFT JOIN newest ON newest.case_id = tam.case_id)
 SELECT kind AS failure, count(fa.failure) AS n FROM (VALUES ('no authority with a case'), ('routed without a case'), ('raised or restated but the case says another decision'), ('folded or suppressed onto its own case'), ('case that isn''t there')) k(kind) LEFT JOIN fa ON fa.failure = kind GROUP BY 1"""


@query("routing_audit", BASE + _AUDIT)
def routing_audit(spark, sf_dir):
    """Decisions whose routing and case disagree, by kind; each kind has a row. Some rows are spoiled so that there is what to find."""
    d = _tampered(decided(spark, sf_dir))
    folded = _cases(spark, sf_dir).select(F.col("alert_id").alias("case_id"), "decision_id")
    n = kpis.routing_failures(d, folded).groupBy("failure").agg(F.count("*").alias("n"))
    return spark.createDataFrame([(f,) for f in kpis.FAILURES], "failure string").join(n, "failure", "left").select("failure", F.coalesce("n", F.lit(0)).alias("n"))


@query("feedback_events", BASE + ", ev AS (SELECT subject, tx.card_id FROM issued JOIN tx ON txn_id = subject WHERE action = 'challenge'), r AS (SELECT decision_id, outcome, resolved_at FROM ke WHERE action = 'challenge' AND outcome IS NOT NULL) SELECT card_id, 'challenge_issued' AS event_type, dt.t AS at FROM ev JOIN dt USING (subject) UNION ALL SELECT card_id, 'challenge_outcome', resolved_at FROM ev JOIN r ON decision_id = subject UNION ALL SELECT card_id, 'challenge_failed', resolved_at FROM ev JOIN r ON decision_id = subject WHERE outcome IN ('failed', 'abandoned')")
def feedback_events(spark, sf_dir):
    """Events that challenges leave on the trigger's card: issued, answered, failed."""
    x = _executions(spark, sf_dir).filter("action = 'challenge'").join(transactions(spark, sf_dir).select(F.col("txn_id").alias("decision_id"), "card_id"), "decision_id")
    event = lambda kind, at, when: F.when(when, F.struct(F.lit(kind).alias("event_type"), F.col(at).alias("at")))
    settled = F.col("resolved_at").isNotNull()
    events = F.array_compact(F.array(event("challenge_issued", "issued_at", F.lit(True)), event("challenge_outcome", "resolved_at", settled), event("challenge_failed", "resolved_at", settled & F.col("outcome").isin("failed", "abandoned"))))
    return x.select("card_id", F.inline(events))


@query("feat_card_challenge_fails_30d", BASE + f", ff AS (SELECT card_id, resolved_at AS at FROM ke JOIN tx ON txn_id = decision_id WHERE action = 'challenge' AND outcome IN ('failed', 'abandoned')) SELECT p.txn_id, (SELECT count(*) FROM ff WHERE ff.card_id = p.card_id AND ff.at <= p.t AND ff.at > p.t - {30 * 86400000000}) AS value FROM tx p")
def feat_card_challenge_fails_30d(spark, sf_dir):
    """A card's failed challenges of the 30 days to each transaction: events and transactions in one window, no join."""
    fails = feedback_events(spark, sf_dir).filter("event_type = 'challenge_failed'").select("card_id", F.col("at").alias("t"), F.lit(None).cast("long").alias("txn_id"))
    both = transactions(spark, sf_dir).select("card_id", "t", "txn_id").unionByName(fails)
    return both.withColumn("value", reducers.count(F.col("txn_id").isNull(), trailing("card_id", "30d"))).filter("txn_id is not null").select("txn_id", "value")
