"""Graph roles and retirement, routes, planner of all subjects, shadow rules, backtest and diffs, reports on conditions, checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.windows import micros, trailing
from ..operators import reducers, routes
from ..sources.tables import entity_links, transactions
from .kpi import BASE, _case_base
from .queries import _DECIDE, _LEDGER, BANDS, CONDITIONS, DAY, LINKS, RULES, TX, WEEK, _literal, _store, decided, graph_fanout, ledger_rows, query, sheet

_c = F.col


@query("graph_roles", f"WITH {TX}, {LINKS}, q AS (SELECT device_id FROM links GROUP BY 1 HAVING count(DISTINCT account_id) > 3), e AS (SELECT DISTINCT account_id + 1 AS to_id FROM tx WHERE txn_type = 'transfer' AND direction = 'outbound') SELECT concat('device_fanout:', l.device_id) AS cluster, l.account_id AS member, CASE WHEN to_id IS NULL THEN 'member' ELSE 'collector' END AS role FROM links l JOIN q ON q.device_id = l.device_id LEFT JOIN e ON to_id = l.account_id")
def graph_roles(spark, sf_dir):
    """Members of clusters; an account that transfers land on is a collector."""
    links = entity_links(spark, sf_dir)
    lands = transactions(spark, sf_dir).filter("txn_type = 'transfer' and direction = 'outbound'").select((_c("account_id") + 1).alias("account_id"), F.lit(True).alias("lands")).distinct()
    rows = links.join(graph_fanout(spark, sf_dir).select("device_id"), "device_id", "left_semi").join(lands, "account_id", "left")
    return rows.select(F.concat(F.lit("device_fanout:"), _c("device_id").cast("string")).alias("cluster"), _c("account_id").alias("member"), F.when(_c("lands"), "collector").otherwise("member").alias("role"))


@query("graph_retired", f"WITH {LINKS}, q AS (SELECT device_id, count(DISTINCT account_id) AS n FROM links WHERE first_seen < DATE '1995-06-01' GROUP BY 1 HAVING count(DISTINCT account_id) > 3), p AS (SELECT s_suppkey AS device_id FROM supplier WHERE s_suppkey % 2 = 0) SELECT concat('device_fanout:', device_id) AS cluster, coalesce(n, 0) AS member_count, n IS NULL AS retired FROM q FULL JOIN p USING (device_id)")
def graph_retired(spark, sf_dir):
    """Clusters known before (of even devices) and now: those that no longer qualify stay as rows without members."""
    links = entity_links(spark, sf_dir).filter("first_seen < date '1995-06-01'")
    now = links.groupBy("device_id").agg(F.count_distinct("account_id").alias("n")).filter("n > 3")
    before = spark.read.parquet(f"{sf_dir}/supplier.parquet").filter("s_suppkey % 2 = 0").select(_c("s_suppkey").alias("device_id"))
    x = now.join(before, "device_id", "full")
    return x.select(F.concat(F.lit("device_fanout:"), _c("device_id").cast("string")).alias("cluster"), F.coalesce("n", F.lit(0)).alias("member_count"), _c("n").isNull().alias("retired"))


EDGES = [(1, "account", "transaction", "account"), (2, "merchant", "transaction", "merchant"), (3, "opened_on", "account", "device"), (4, "sells", "merchant", "device")]


@query("route_entities", f"WITH {TX}, {LINKS}, r AS (SELECT DISTINCT txn_id AS subject, links.device_id AS entity FROM tx JOIN links ON links.account_id = tx.account_id AND first_seen < DATE '1992-09-01') SELECT txn_id AS subject, count(entity) AS n, CASE WHEN count(entity) = 0 THEN 'no_entities' WHEN count(entity) > 1 THEN 'unresolvable' ELSE 'resolved' END AS state FROM tx LEFT JOIN r ON subject = txn_id GROUP BY 1")
def route_entities(spark, sf_dir):
    """Devices that a transaction's account was opened on (early links only), by the shortest route, for a feature of one device."""
    x = transactions(spark, sf_dir)
    hops = {1: x.select(_c("txn_id").alias("from_id"), _c("account_id").alias("to_id")), 2: x.select(_c("txn_id").alias("from_id"), _c("merchant_id").alias("to_id")), 3: entity_links(spark, sf_dir).filter("first_seen < date '1992-09-01'").select(_c("account_id").alias("from_id"), _c("device_id").alias("to_id"))}
    _, route = routes.plan(EDGES, "auto", "transaction", None, "device")
    subjects = x.select(_c("txn_id").alias("subject"))
    return routes.verdict(subjects, routes.follow(subjects.withColumn("entity", _c("subject")), [hops[i] for i in route]), "one")


@query("plan_all_subjects", f"""WITH {TX}, {LINKS}, q AS (SELECT device_id FROM links GROUP BY 1 HAVING count(DISTINCT account_id) > 3), m AS (SELECT DISTINCT l.device_id, l.account_id FROM links l JOIN q ON q.device_id = l.device_id)
 SELECT 'transaction' AS subject_type, txn_id AS subject, txn_id AS trigger_id FROM tx UNION ALL SELECT 'account', account_id, arg_max(txn_id, (CASE WHEN direction = 'outbound' THEN 1 ELSE 0 END, t, txn_id)) FROM tx GROUP BY 2 UNION ALL SELECT 'card', card_id, arg_max(txn_id, (t, txn_id)) FROM tx GROUP BY 2 UNION ALL SELECT 'merchant', merchant_id, arg_max(txn_id, (t, txn_id)) FROM tx GROUP BY 2 UNION ALL SELECT 'device', device_id, arg_max(txn_id, (t, txn_id)) FROM tx GROUP BY 2
 UNION ALL SELECT 'customer', account_id // 3, arg_max(txn_id, (t, txn_id)) FROM tx GROUP BY 2 UNION ALL SELECT 'network', m.device_id, arg_max(txn_id, (t, txn_id)) FROM m JOIN tx ON tx.account_id = m.account_id WHERE direction = 'inbound' GROUP BY 2""")
def plan_all_subjects(spark, sf_dir):
    """Each subject of the seven kinds with the row that triggers it; a network's is the latest inbound row of any member."""
    x = transactions(spark, sf_dir)
    newest = F.struct("t", "txn_id")
    by = lambda kind, key, rows=x, order=newest: rows.groupBy(key.cast("long").alias("subject")).agg(F.max_by("txn_id", order).alias("trigger_id")).select(F.lit(kind).alias("subject_type"), "subject", "trigger_id")
    members = entity_links(spark, sf_dir).join(graph_fanout(spark, sf_dir).select("device_id"), "device_id", "left_semi").select(_c("device_id").alias("network"), "account_id").distinct()
    out = x.select(F.lit("transaction").alias("subject_type"), _c("txn_id").alias("subject"), _c("txn_id").alias("trigger_id"))
    out = out.unionByName(by("account", _c("account_id"), order=F.struct((_c("direction") == "outbound").cast("int"), "t", "txn_id")))
    for kind, key in (("card", _c("card_id")), ("merchant", _c("merchant_id")), ("device", _c("device_id")), ("customer", F.floor(_c("account_id") / 3))):
        out = out.unionByName(by(kind, key))
    return out.unionByName(by("network", _c("network"), x.filter("direction = 'inbound'").join(members, "account_id")))


SHADOW_RULES = [*RULES, ("S1", "challenge", 3, True, False, 30, 30), ("S2", "alert", 2, False, False, 20, 999)]
SHADOW_CONDITIONS = [*CONDITIONS, ("S1", "c1", "amt", ">", 90.0, 35, True), ("S2", "c1", "mcc", "=", 99.0, 30, True)]  # S2 never fires
_BOTH = _DECIDE.replace(_literal(CONDITIONS), _literal(SHADOW_CONDITIONS)).replace(_literal(RULES), _literal(SHADOW_RULES))


def _as_ctes(sql: str, last: str, name: str) -> str:
    """A chain of CTEs as one CTE of its last table."""
    return f"{name} AS MATERIALIZED ({sql} SELECT * FROM {last})"


@query("shadow_ledger", _BOTH + " SELECT subject, rule_id, condition_id, fired, CASE WHEN rule_id IN ('S1', 'S2') THEN 0 ELSE contributed END AS contributed FROM l WHERE fired")
def shadow_ledger(spark, sf_dir):
    """Fired conditions of live and shadow rules; those of shadow rules contribute nothing."""
    shadow = _c("rule_id").isin("S1", "S2")
    return sheet(spark, sf_dir, SHADOW_RULES, SHADOW_CONDITIONS).ledger().filter("fired").select("subject", "rule_id", "condition_id", "fired", F.when(shadow, 0).otherwise(_c("contributed")).alias("contributed"))


CANDIDATE = [r if r[0] != "R2" else ("R2", "alert", 2, False, False, 35, 999) for r in RULES]
_SWAPPED = _DECIDE.replace(_literal(RULES), _literal(CANDIDATE))


@query("backtest", f"WITH {_as_ctes(_SWAPPED, 'd', 'cand')}, {TX} SELECT band, count(*) AS n, count(*) FILTER (contains(rules_fired, 'R2')) AS fired, count(*) FILTER (contains(rules_authorised, 'R2')) AS authorised, count(*) FILTER (source_rule = 'R2') AS carried, min(score) FILTER (score > 0) AS least, quantile_disc(CASE WHEN score > 0 THEN score END, 0.5) AS middle, max(score) FILTER (score > 0) AS most, round(count(*) FILTER (source_rule = 'R2' AND label = 'fraud') / nullif(count(*) FILTER (source_rule = 'R2'), 0), 6) AS precision FROM cand JOIN tx ON txn_id = subject GROUP BY 1".replace("quantile_disc(CASE WHEN score > 0 THEN score END, 0.5)", "list_sort(list(score) FILTER (score > 0))[count(*) FILTER (score > 0) // 2 + 1]"))
def backtest(spark, sf_dir):
    """A candidate in place of a rule, all subjects scored again, nothing written: counts by band, and the upper median of scores."""
    d = sheet(spark, sf_dir, CANDIDATE).decisions(BANDS, "label")
    mine = _c("source_rule") == "R2"
    ladder = d.groupBy("band", "score").agg(F.count("*").alias("n"), F.count_if(_c("rules_fired").contains("R2")).alias("fired"), F.count_if(_c("rules_authorised").contains("R2")).alias("authorised"), F.count_if(mine).alias("carried"), F.count_if(mine & (_c("label") == "fraud")).alias("right"))
    return off_ladder(ladder, ["band"], ["n", "fired", "authorised", "carried"], F.round(F.sum("right") / F.when(F.sum("carried") > 0, F.sum("carried")), 6).alias("precision"))


def off_ladder(ladder, by: list[str], counts: list[str], *more):
    """Counts by group, and the least, the upper median and the most of its positive scores, from a row for each distinct score with counts:
    the decisions are gone through once."""
    mine, positive = Window.partitionBy(*by), _c("score") > 0
    c = F.when(positive, _c("n")).otherwise(0)
    x = ladder.withColumns({"upto": F.sum(c).over(mine.orderBy("score")), "total": F.sum(c).over(mine)})
    least = lambda when: F.min(F.when(when, _c("score")))
    return x.groupBy(*by).agg(*(F.sum(n).alias(n) for n in counts), least(positive).alias("least"), least(positive & (_c("upto") > F.floor(_c("total") / 2))).alias("middle"), F.max(F.when(positive, _c("score"))).alias("most"), *more)


@query("rule_trace", _DECIDE + " SELECT subject, string_agg(concat(rule_id, ':', CAST(score AS INTEGER), '/', review, CASE WHEN satisfied THEN ' satisfied' ELSE '' END, CASE WHEN authorised THEN ' authorised' ELSE '' END, CASE WHEN is_veto THEN concat(' veto ', CASE WHEN veto IS NULL THEN 'unknown' WHEN veto THEN 'established' ELSE 'no' END) ELSE '' END), '; ' ORDER BY rule_id) AS trace FROM sa GROUP BY 1")
def rule_trace(spark, sf_dir):
    """One line for each decision: its rules with score, threshold and state."""
    said = lambda c, text: F.when(c, F.lit(text)).otherwise("")
    veto = lambda r: F.when(r["is_veto"], F.concat(F.lit(" veto "), F.when(r["veto"].isNull(), "unknown").when(r["veto"], "established").otherwise("no"))).otherwise("")
    line = lambda r: F.concat(r["rule_id"], F.lit(":"), r["score"].cast("int").cast("string"), F.lit("/"), r["review"].cast("string"), said(r["satisfied"], " satisfied"), said(r["authorised"], " authorised"), veto(r))
    return sheet(spark, sf_dir).by_rule().select("subject", F.array_join(F.transform("rules", line), "; ").alias("trace"))


_REPORT = ", ob AS (SELECT l.*, label = 'fraud' AS is_fraud, vd.disposition FROM l JOIN tx ON txn_id = l.subject LEFT JOIN routed ON id = l.subject LEFT JOIN vd ON vd.alert_id = case_id), ag AS (SELECT rule_id, condition_id, any_value(points) AS points, count(*) AS evaluated, count(*) FILTER (fired) AS n_fired, count(*) FILTER (fired AND is_fraud) AS on_fraud, count(*) FILTER (fired AND disposition IS NOT NULL) AS on_cases, count(*) FILTER (fired AND disposition = 'confirmed_fraud') AS confirmed FROM ob GROUP BY 1, 2), sc AS (SELECT *, round(100.0 * n_fired / evaluated, 2) AS fire_rate_pct, CASE WHEN n_fired > 0 THEN round(100.0 * CASE WHEN points >= 0 THEN on_fraud ELSE n_fired - on_fraud END / n_fired, 2) END AS precision_pct, CASE WHEN on_cases > 0 THEN round(100.0 * confirmed / on_cases, 2) END AS case_precision_pct FROM ag)"


def _report(spark, sf_dir):
    x = decided(spark, sf_dir).select(_c("id").alias("subject"), "label", "case_id")
    verdict = _case_base(spark, sf_dir).select(_c("alert_id").alias("case_id"), "disposition")
    ob = ledger_rows(spark, sf_dir).join(x, "subject").join(verdict, "case_id", "left")
    fraud, fired, n = _c("label") == "fraud", _c("fired"), _c("n_fired")
    ag = ob.groupBy("rule_id", "condition_id").agg(F.first("points").alias("points"), F.count("*").alias("evaluated"), F.count_if(fired).alias("n_fired"), F.count_if(fired & fraud).alias("on_fraud"), F.count_if(fired & _c("disposition").isNotNull()).alias("on_cases"), F.count_if(fired & (_c("disposition") == "confirmed_fraud")).alias("confirmed"))
    right = F.when(_c("points") >= 0, _c("on_fraud")).otherwise(n - _c("on_fraud"))
    return ag.withColumns({"fire_rate_pct": F.round(100.0 * n / _c("evaluated"), 2), "precision_pct": F.when(n > 0, F.round(100.0 * right / n, 2)), "case_precision_pct": F.when(_c("on_cases") > 0, F.round(100.0 * _c("confirmed") / _c("on_cases"), 2))})


_COLS = ["rule_id", "condition_id", "points", "evaluated", "n_fired", "fire_rate_pct", "precision_pct", "on_cases", "case_precision_pct"]


@query("condition_report", BASE + _REPORT + f" SELECT {', '.join(_COLS)}, round(abs(points) / nullif(precision_pct, 0), 3) AS points_per_precision_point FROM sc ORDER BY points_per_precision_point DESC NULLS LAST, rule_id, condition_id")
def condition_report(spark, sf_dir):
    """How often conditions fire, how right they are on labels and on worked cases, and what a point of precision costs."""
    cost = F.round(F.abs("points") / F.when(_c("precision_pct") != 0, _c("precision_pct")), 3)
    return _report(spark, sf_dir).select(*_COLS, cost.alias("points_per_precision_point")).orderBy(F.desc_nulls_last("points_per_precision_point"), "rule_id", "condition_id")


@query("reprice", BASE + _REPORT + ", co2 AS (SELECT *, abs(points) / nullif(precision_pct, 0) AS cost FROM sc WHERE n_fired >= 20), an AS (SELECT median(cost) AS anchor FROM co2 WHERE points > 0) SELECT rule_id, condition_id, round(cost / anchor, 3) AS ratio, cost / anchor >= 3 AS material, CAST(round(precision_pct * anchor) AS BIGINT) AS price FROM co2, an WHERE points > 0 AND cost IS NOT NULL")
def reprice(spark, sf_dir):
    """Aggravators that fired 20 times or more, against the median cost: those of three times it or more are priced anew."""
    x = _report(spark, sf_dir).filter("n_fired >= 20 and points > 0").withColumn("cost", F.abs("points") / F.when(_c("precision_pct") != 0, _c("precision_pct")))
    anchor = x.agg(F.median("cost").alias("anchor"))  # one row
    ratio = _c("cost") / _c("anchor")
    return x.filter("cost is not null").crossJoin(F.broadcast(anchor)).select("rule_id", "condition_id", F.round(ratio, 3).alias("ratio"), (ratio >= 3).alias("material"), F.round(_c("precision_pct") * _c("anchor")).cast("long").alias("price"))


@query("cohort_base_rate", f"WITH {TX} SELECT channel, count(*) AS n, round(count(*) FILTER (label = 'fraud') / count(*), 6) AS base_rate FROM tx GROUP BY 1")
def cohort_base_rate(spark, sf_dir):
    return transactions(spark, sf_dir).groupBy("channel").agg(F.count("*").alias("n"), F.round(F.count_if(_c("label") == "fraud") / F.count("*"), 6).alias("base_rate"))


@query("reason_direction", _LEDGER + " SELECT feature, CASE WHEN bool_or(points >= 0) AND bool_or(points < 0) THEN 'both' WHEN bool_or(points >= 0) THEN 'aggravating' ELSE 'mitigating' END AS direction, count(*) FILTER (fired) AS n_fired FROM l GROUP BY 1")
def reason_direction(spark, sf_dir):
    """Which way the conditions price each feature's reason, and how often it fired."""
    up, down = F.bool_or(_c("points") >= 0), F.bool_or(_c("points") < 0)
    return ledger_rows(spark, sf_dir).groupBy("feature").agg(F.when(up & down, "both").when(up, "aggravating").otherwise("mitigating").alias("direction"), F.count_if("fired").alias("n_fired"))


@query("data_quality", f"WITH {TX}, v AS (SELECT account_id AS key, t // {DAY} * {DAY} AS as_of, t AS computed_at FROM tx WHERE txn_type = 'transfer') SELECT 'repeated bitemporal keys' AS what, (SELECT count(*) FROM (SELECT 1 FROM v GROUP BY key, as_of, computed_at HAVING count(*) > 1)) AS n UNION ALL SELECT 'several values on a day', (SELECT count(*) FROM (SELECT 1 FROM v GROUP BY key, as_of HAVING count(*) > 1)) UNION ALL SELECT 'merchants unpriced', (SELECT count(DISTINCT merchant_id) FROM tx WHERE mcc IS NULL)")
def data_quality(spark, sf_dir):
    """Counts of what shouldn't be, or should be known, in the feature store and the transactions."""
    values, _ = _store(transactions(spark, sf_dir))
    again = lambda *keys: values.groupBy(*keys).agg(F.count("*").alias("c")).filter("c > 1").agg(F.count("*").alias("n"))
    parts = [("repeated bitemporal keys", again("key", "as_of", "computed_at")), ("several values on a day", again("key", "as_of")), ("merchants unpriced", transactions(spark, sf_dir).filter("mcc is null").agg(F.count_distinct("merchant_id").alias("n")))]
    out = [df.select(F.lit(what).alias("what"), "n") for what, df in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("hypothetical", f"WITH {TX}, hy AS (SELECT account_id, max(t) + {micros('1h')} AS t FROM tx GROUP BY 1) SELECT hy.account_id, (SELECT count(*) + 1 FROM tx h WHERE h.account_id = hy.account_id AND h.t > hy.t - {WEEK}) AS n7 FROM hy")
def hypothetical(spark, sf_dir):
    """One row made up for each account, an hour after its last: united with the history, driven at its instant, never stored."""
    x = transactions(spark, sf_dir).select("account_id", "t", F.lit(False).alias("made_up"))
    rows = x.unionByName(x.groupBy("account_id").agg((F.max("t") + micros("1h")).alias("t")).withColumn("made_up", F.lit(True)))
    return rows.withColumn("n7", reducers.count(F.lit(True), trailing("account_id", "7d"))).filter("made_up").select("account_id", "n7")


@query("work_list", f"WITH {TX}, w AS (SELECT DISTINCT card_id AS entity, t AS as_of FROM tx WHERE channel = 'cnp' AND auth_result = 'approved' AND t > 1705190400000000) SELECT entity, as_of, coalesce((SELECT max(lat) FROM tx h WHERE h.card_id = entity AND h.t <= as_of AND h.t > as_of - {DAY}), -1.0) AS value FROM w")
def work_list(spark, sf_dir):
    """Distinct (entity, instant) that the driver filter gives after a bound, with the feature or its default."""
    x = transactions(spark, sf_dir)
    drives = (_c("channel") == "cnp") & (_c("auth_result") == "approved") & (_c("t") > 1705190400000000)
    rows = x.withColumn("value", F.coalesce(F.max("lat").over(trailing("card_id", "1d")), F.lit(-1.0)))
    return rows.filter(drives).select(_c("card_id").alias("entity"), _c("t").alias("as_of"), "value").distinct()


@query("recent_subjects", f"WITH {TX} SELECT * FROM (SELECT account_id AS subject, max(t) AS trigger_at FROM tx GROUP BY 1 ORDER BY trigger_at DESC, subject LIMIT 50) ORDER BY trigger_at, subject")
def recent_subjects(spark, sf_dir):
    """The 50 accounts with the newest triggers, in ascending order."""
    by = transactions(spark, sf_dir).groupBy(_c("account_id").alias("subject")).agg(F.max("t").alias("trigger_at"))
    return by.orderBy(F.desc("trigger_at"), "subject").limit(50).orderBy("trigger_at", "subject")


@query("pred_self_ref", f"WITH {TX} SELECT p.txn_id, (SELECT count(*) FROM tx h WHERE h.account_id = p.account_id AND h.t <= p.t AND h.t > p.t - {DAY} AND h.amount <= p.amount AND h.amount > 10 AND h.t BETWEEN p.t - {DAY} AND p.t) AS value FROM tx p")
def pred_self_ref(spark, sf_dir):
    """Rows of the account's last day that a filter with the probing row's own columns lets through; met by day slices, not by history."""
    from ..functions import predicates

    x = transactions(spark, sf_dir).select("txn_id", "account_id", "t", "amount")
    spec = {"op": "and", "args": [{"op": "lte", "col": "amount", "value": {"ref": "self.amount"}}, {"op": "gt", "col": "amount", "value": 10}, {"op": "between", "col": "t", "value": [{"ref": "self.day_ago"}, {"ref": "self.t"}]}]}
    slice_ = F.floor(_c("t") / DAY)
    probe = x.select(_c("txn_id").alias("probe"), "account_id", _c("amount").alias("self_amount"), _c("t").alias("self_t"), (_c("t") - DAY).alias("self_day_ago"), F.explode(F.array(slice_, slice_ - 1)).alias("slice"))
    past = x.select("account_id", "t", "amount", slice_.alias("slice"))
    met = probe.join(past, ["account_id", "slice"]).filter((_c("t") > _c("self_day_ago")) & predicates.build(spec, ["amount", "t", "day_ago"]))
    n = met.groupBy(_c("probe").alias("txn_id")).agg(F.count("*").alias("value"))
    return x.select("txn_id").join(n, "txn_id", "left").select("txn_id", F.coalesce("value", F.lit(0)).alias("value"))
