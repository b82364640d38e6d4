"""The engine's registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import predicates
from ..functions.windows import micros, trailing
from ..operators import cases, exposure, pit, reducers
from ..operators.sheets import Sheet
from ..sources.store import shared
from ..sources.tables import case_outcomes, entity_links, transactions

DAY, WEEK = micros("1d"), micros("7d")
QUERIES: dict = {}
ORACLES: dict[str, str] = {}

TX = """tx AS (SELECT event_id AS txn_id, epoch_us(ts) AS t, CAST(value AS DECIMAL(18,4)) AS amount, user_id AS account_id, k,
 user_id * 2 + k % 2 AS card_id, k AS device_id, k % 20 AS merchant_id, CASE WHEN k % 17 <> 0 THEN k % 10 END AS mcc,
 CASE event_type WHEN 'signup' THEN 'inbound' WHEN 'purchase' THEN 'outbound' ELSE 'debit' END AS direction,
 CASE event_type WHEN 'click' THEN 'cnp' WHEN 'view' THEN 'pos' ELSE 'online' END AS channel,
 CASE WHEN event_type = 'error' THEN 'declined' ELSE 'approved' END AS auth_result,
 CASE WHEN event_type IN ('signup', 'purchase') THEN 'transfer' ELSE 'purchase' END AS txn_type,
 CASE WHEN k % 13 <> 0 THEN CAST(k % 7 * 5 AS DOUBLE) END AS lat, CASE WHEN k % 13 <> 0 THEN CAST(k % 11 * 7 AS DOUBLE) END AS lon,
 CASE WHEN event_type = 'error' AND k < 10 THEN 'fraud' ELSE 'legit' END AS label
 FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""
LINKS = """links AS (SELECT l_suppkey AS device_id, o_custkey AS account_id, CAST(min(l_shipdate) AS DATE) AS first_seen
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""


def query(name: str, sql: str | None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def _feature(name: str, value, sql: str) -> None:
    """A feature of each transaction; sql: an expression over p (the probe) and h (its history), or a whole column of tx."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = value(transactions(spark, sf_dir))
        kind = dict(out.dtypes)["value"]
        return out.select("txn_id", (F.round(F.col("value").cast("double"), 5) if kind not in ("boolean", "bigint", "int") else F.col("value")).alias("value"))

    query("feat_" + name, f"WITH {TX} {sql}")(run)


def _past(agg: str, scope: str, window: int | None, where: str = "TRUE", lag: int = 0, rounded: bool = True) -> str:
    """The literal correlated form of a reducer."""
    bound = f"h.t <= p.t - {lag}" + (f" AND h.t > p.t - {window}" if window else "")
    x = f"(SELECT {agg} FROM tx h WHERE h.{scope} = p.{scope} AND {bound} AND ({where}))"
    return f"SELECT p.txn_id, {f'round({x}, 5)' if rounded else x} AS value FROM tx p"


_c = F.col
_OTHERS = "(SELECT CASE WHEN sd > 0.00004 THEN abs(CAST(p.amount AS DOUBLE) - m) / sd END FROM (SELECT avg(CAST(h.amount AS DOUBLE)) AS m, stddev_samp(CAST(h.amount AS DOUBLE)) AS sd FROM tx h WHERE h.account_id = p.account_id AND h.t <= p.t AND h.txn_id <> p.txn_id))"
CNP = {"op": "and", "args": [{"op": "eq", "col": "channel", "value": "cnp"}, {"op": "eq", "col": "auth_result", "value": "approved"}]}
MID = {"op": "between", "col": "amount", "value": [20, 60]}


def _keep(tx: DataFrame, spec: dict | None):
    return predicates.build(spec, tx.columns)


_feature("count", lambda x: x.withColumn("value", reducers.count(_keep(x, CNP), trailing("card_id", "7d"))), _past("count(*)", "card_id", WEEK, "channel = 'cnp' AND auth_result = 'approved'", rounded=False))
_feature("sum", lambda x: x.withColumn("value", reducers.total(_c("direction") == "inbound", "amount", trailing("account_id", "7d"))), _past("CAST(sum(amount) AS DOUBLE)", "account_id", WEEK, "direction = 'inbound'"))
_feature("count_of_others", lambda x: x.withColumn("value", reducers.count(_c("direction") == "debit", trailing("account_id", "7d"), exclude_self=True)), _past("count(*)", "account_id", WEEK, "h.direction = 'debit' AND h.txn_id <> p.txn_id", rounded=False))
_feature("sum_of_others", lambda x: x.withColumn("value", reducers.total(_c("direction") == "debit", "amount", trailing("account_id", "7d"), exclude_self=True)), _past("CAST(sum(amount) AS DOUBLE)", "account_id", WEEK, "h.direction = 'debit' AND h.txn_id <> p.txn_id"))
_feature("distinct_count", lambda x: x.withColumn("value", reducers.distinct_count(F.lit(True), "merchant_id", trailing("account_id", "7d"))), _past("count(DISTINCT merchant_id)", "account_id", WEEK, rounded=False))
_feature("bool_exists", lambda x: x.withColumn("value", reducers.bool_exists(_keep(x, MID), trailing("account_id", "1d"))), _past("count(*) > 0", "account_id", DAY, "amount BETWEEN 20 AND 60", rounded=False))
_feature("bool_not_exists", lambda x: x.withColumn("value", reducers.bool_not_exists(_c("txn_type") == "transfer", trailing("account_id", "1d"))), _past("count(*) = 0", "account_id", DAY, "txn_type = 'transfer'", rounded=False))
_feature("zscore", lambda x: x.withColumn("value", reducers.zscore(F.lit(True), "amount", trailing("account_id", "7d"))), _past("(max(CAST(amount AS DOUBLE)) - avg(CAST(amount AS DOUBLE))) / nullif(stddev_samp(CAST(amount AS DOUBLE)), 0)", "account_id", WEEK))
_feature("rate_ratio", lambda x: x.withColumn("value", reducers.rate_ratio(F.lit(True), "card_id", "1d", "30d")), f"SELECT p.txn_id, round((SELECT (count(*) FILTER (h.t > p.t - {DAY}) / 86400.0) / nullif(count(*) / 2592000.0, 0) FROM tx h WHERE h.card_id = p.card_id AND h.t <= p.t AND h.t > p.t - {30 * DAY}), 5) AS value FROM tx p")
_feature("out_over_in", lambda x: x.withColumn("value", reducers.out_over_in("amount", trailing("account_id", "7d"))), _past("CASE WHEN sum(amount) FILTER (direction = 'inbound') > 0 THEN coalesce(CAST(sum(amount) FILTER (direction = 'outbound') AS DOUBLE), 0) / CAST(sum(amount) FILTER (direction = 'inbound') AS DOUBLE) END", "account_id", WEEK))
_feature("zscore_of_self", lambda x: x.withColumn("value", reducers.zscore_of_self("amount", trailing("account_id"))), f"SELECT p.txn_id, round({_OTHERS}, 5) AS value FROM tx p")
_feature("in_reference_set", lambda x: x.withColumn("value", reducers.in_reference_set("mcc", [3, 5, 7])), "SELECT txn_id, mcc IN (3, 5, 7) AS value FROM tx")
_feature("eq_const", lambda x: x.withColumn("value", reducers.eq_const("channel", "pos")), "SELECT txn_id, channel = 'pos' AS value FROM tx")
_feature("min_gap", lambda x: reducers.min_gap(x, "account_id"), "SELECT p.txn_id, round((SELECT min((o.t - i.t) / 6e7) FROM tx o JOIN tx i ON i.account_id = o.account_id AND i.t <= o.t WHERE o.account_id = p.account_id AND o.t <= p.t AND o.direction = 'outbound' AND i.direction = 'inbound'), 5) AS value FROM tx p")
_feature("age_minutes_latest", lambda x: reducers.age_minutes_latest(x, "account_id", _c("direction") == "inbound"), "SELECT p.txn_id, round((p.t - (SELECT max(h.t) FROM tx h WHERE h.account_id = p.account_id AND h.t <= p.t AND h.direction = 'inbound')) / 6e7, 5) AS value FROM tx p")
_feature("age_minutes", lambda x: reducers.age_minutes(x, x.groupBy("device_id").agg((F.min("t") + DAY).alias("t0")), "device_id"), f"SELECT txn_id, round(CASE WHEN t0 <= t THEN (t - t0) / 6e7 END, 5) AS value FROM tx JOIN (SELECT device_id AS d, min(t) + {DAY} AS t0 FROM tx GROUP BY 1) ON d = device_id")
_BY_CARD = "(PARTITION BY card_id ORDER BY t NULLS FIRST, lat NULLS FIRST, lon NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND "
_feature("geo_jump_km", lambda x: reducers.geo_jump(x, "card_id"), f""", g AS (SELECT txn_id, card_id, t, lat, lon, CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN {{'a': lat, 'b': lon}} END AS here FROM tx),
 n AS (SELECT *, last_value(here IGNORE NULLS) OVER {_BY_CARD} CURRENT ROW) AS now, last_value(here IGNORE NULLS) OVER {_BY_CARD} 1 PRECEDING) AS was FROM g),
 b AS (SELECT *, last_value(CASE WHEN was <> now THEN was END IGNORE NULLS) OVER {_BY_CARD} CURRENT ROW) AS before FROM n)
 SELECT txn_id, round(2 * 6371 * asin(least(1.0, sqrt(pow(sin(radians(now.a - before.a) / 2), 2) + cos(radians(before.a)) * cos(radians(now.a)) * pow(sin(radians(now.b - before.b) / 2), 2)))), 5) AS value FROM b""")
_feature("pct_running_balance", lambda x: reducers.pct_of_running_balance(x, "account_id", "7d"), f""", m AS (SELECT p.txn_id, h.t, h.txn_id AS id, h.amount AS x, h.direction FROM tx p JOIN tx h ON h.account_id = p.account_id AND h.t <= p.t AND h.t > p.t - {WEEK} AND h.auth_result = 'approved'),
 l AS (SELECT txn_id, t AS lt, x AS lx FROM m WHERE direction = 'outbound' QUALIFY row_number() OVER (PARTITION BY txn_id ORDER BY t DESC, id DESC) = 1),
 b AS (SELECT l.txn_id, any_value(lx) AS lx, coalesce(sum(CASE WHEN t < lt THEN CASE WHEN direction = 'inbound' THEN x ELSE -x END END), 0) AS bal FROM l JOIN m ON m.txn_id = l.txn_id GROUP BY 1)
 SELECT tx.txn_id, round(100 * CAST(lx AS DOUBLE) / CAST(nullif(bal, 0) AS DOUBLE), 5) AS value FROM tx LEFT JOIN b ON b.txn_id = tx.txn_id""")
_feature("self_ref_novelty", lambda x: x.withColumn("value", F.coalesce(F.lag("t").over(Window.partitionBy("account_id", "mcc").orderBy("t")).isNull() | _c("mcc").isNull(), F.lit(True))), _past("count(*) = 0", "account_id", None, "h.mcc = p.mcc AND h.txn_id <> p.txn_id", rounded=False))
_feature("lagged_baseline", lambda x: x.withColumn("value", reducers.count(F.lit(True), trailing("account_id", None, "1d"))), _past("count(*)", "account_id", None, lag=DAY, rounded=False))

ALL_OPS = {"op": "or", "args": [{"op": "and", "args": [{"op": "gte", "col": "amount", "value": 50}, {"op": "not", "args": [{"op": "in", "col": "channel", "value": ["cnp", "pos"]}]}]}, {"op": "and", "args": [{"op": "is_null", "col": "mcc"}, {"op": "lt", "col": "amount", "value": 30}]}, {"op": "and", "args": [{"op": "not_null", "col": "lat"}, {"op": "between", "col": "amount", "value": [5, 6]}, {"op": "ne", "col": "direction", "value": "inbound"}]}]}


@query("pred_all_ops", f"WITH {TX} SELECT txn_id FROM tx WHERE (amount >= 50 AND NOT channel IN ('cnp', 'pos')) OR (mcc IS NULL AND amount < 30) OR (lat IS NOT NULL AND amount BETWEEN 5 AND 6 AND direction <> 'inbound')")
def pred_all_ops(spark, sf_dir):
    x = transactions(spark, sf_dir)
    return x.filter(predicates.build(ALL_OPS, x.columns)).select("txn_id")


@query("graph_fanout", f"WITH {LINKS} SELECT device_id, count(DISTINCT account_id) AS n_accounts, min(first_seen) AS first_seen, max(first_seen) AS last_seen FROM links GROUP BY 1 HAVING count(DISTINCT account_id) > 3")
def graph_fanout(spark, sf_dir):
    return fanout_of(entity_links(spark, sf_dir))


def fanout_of(links: DataFrame) -> DataFrame:
    return links.groupBy("device_id").agg(F.count_distinct("account_id").alias("n_accounts"), F.min("first_seen").alias("first_seen"), F.max("first_seen").alias("last_seen")).filter("n_accounts > 3")


@query("graph_members", f"WITH {LINKS}, q AS (SELECT device_id FROM links GROUP BY 1 HAVING count(DISTINCT account_id) > 3) SELECT concat('device_fanout:', l.device_id) AS cluster, 'account' AS subject_type, l.account_id AS member, l.first_seen AS joined_at FROM links l JOIN q ON q.device_id = l.device_id UNION ALL SELECT concat('device_fanout:', l.device_id), 'device', l.device_id, min(l.first_seen) FROM links l JOIN q ON q.device_id = l.device_id GROUP BY l.device_id")
def graph_members(spark, sf_dir):
    links = entity_links(spark, sf_dir)
    rows = links.join(graph_fanout(spark, sf_dir).select("device_id"), "device_id", "left_semi").withColumn("cluster", F.concat(F.lit("device_fanout:"), F.col("device_id").cast("string")))
    accounts = rows.select("cluster", F.lit("account").alias("subject_type"), F.col("account_id").alias("member"), F.col("first_seen").alias("joined_at"))
    return accounts.unionByName(rows.groupBy("cluster", "device_id").agg(F.min("first_seen").alias("joined_at")).select("cluster", F.lit("device").alias("subject_type"), F.col("device_id").alias("member"), "joined_at"))


@query("feat_cluster_density", f"WITH {TX}, m AS (SELECT DISTINCT merchant_id AS cluster, account_id AS member FROM tx), e AS (SELECT account_id AS from_id, account_id + 1 AS to_id FROM tx WHERE direction = 'outbound'), n AS (SELECT cluster, count(*) AS n FROM m GROUP BY 1), i AS (SELECT a.cluster, count(*) AS e FROM e JOIN m a ON a.member = from_id JOIN m b ON b.member = to_id AND b.cluster = a.cluster GROUP BY 1) SELECT n.cluster, round(CASE WHEN n < 2 THEN 0.0 ELSE coalesce(e, 0) / (n * (n - 1) / 2) END, 6) AS value FROM n LEFT JOIN i ON i.cluster = n.cluster")
def feat_cluster_density(spark, sf_dir):
    x = transactions(spark, sf_dir)
    members = x.select(_c("merchant_id").alias("cluster"), _c("account_id").alias("member")).distinct()
    edges = x.filter("direction = 'outbound'").select(_c("account_id").alias("from_id"), (_c("account_id") + 1).alias("to_id"))
    return reducers.cluster_density(edges, members).select("cluster", F.round("value", 6).alias("value"))


@query("fanout_reduce", f"WITH {TX} SELECT merchant_id, max(amount) AS v_max, min(amount) AS v_min, sum(amount) AS v_sum, round(avg(CAST(amount AS DOUBLE)), 6) AS v_mean, bool_or(amount > 50) AS any_true, bool_and(amount > 50) AS all_true, count(DISTINCT amount) AS n_distinct, CASE WHEN count(*) = 1 THEN max(amount) END AS v_one, count(*) > 1 AS is_error FROM tx GROUP BY 1")
def fanout_reduce(spark, sf_dir):
    return reducers.fan_out(transactions(spark, sf_dir), "merchant_id", "amount")


def _store(x: DataFrame) -> tuple[DataFrame, DataFrame]:
    values = x.filter("txn_type = 'transfer'").select(_c("account_id").alias("key"), (F.floor(_c("t") / DAY) * DAY).alias("as_of"), _c("t").alias("computed_at"), _c("amount").cast("double").alias("value"))
    return values, x.select(_c("account_id").alias("key"), _c("txn_id").alias("probe_id"), _c("t").alias("bound"))


_PIT = f"WITH {TX}, v AS (SELECT account_id AS key, t // {DAY} * {DAY} AS as_of, t AS computed_at, CAST(amount AS DOUBLE) AS value FROM tx WHERE txn_type = 'transfer'), r AS (SELECT p.txn_id AS probe_id, p.t AS bound, v.as_of, v.computed_at, v.value FROM tx p LEFT JOIN v ON v.key = p.account_id AND v.as_of <= p.t {{ceiling}} QUALIFY row_number() OVER (PARTITION BY p.txn_id ORDER BY v.as_of DESC NULLS LAST, v.computed_at DESC) = 1)"
_MAY = 1705276800000000


@query("pit_read", _PIT.format(ceiling="") + " SELECT probe_id, as_of, computed_at, value FROM r")
def pit_read(spark, sf_dir):
    return pit.as_of(*_store(transactions(spark, sf_dir))).select("probe_id", "as_of", "computed_at", "value")


@query("pit_replay", _PIT.format(ceiling=f"AND v.computed_at <= {_MAY}") + " SELECT probe_id, as_of, computed_at, value FROM r")
def pit_replay(spark, sf_dir):
    return pit.as_of(*_store(transactions(spark, sf_dir)), ceiling=_MAY).select("probe_id", "as_of", "computed_at", "value")


@query("pit_status", _PIT.format(ceiling="") + f" SELECT probe_id, CASE WHEN value IS NULL THEN 'absent' WHEN bound - as_of > {DAY} THEN 'stale' ELSE 'present' END AS status FROM r")
def pit_status(spark, sf_dir):
    return pit.status(pit.as_of(*_store(transactions(spark, sf_dir))), DAY).select("probe_id", "status")


RULES = [("R1", "challenge", 3, True, False, 40, 60), ("R2", "alert", 2, False, False, 20, 999), ("R3", "allow", 0, False, False, 0, 999), ("V1", "allow", 0, False, True, 999, 999)]
CONDITIONS = [("R1", "c1", "n7", ">=", 4.0, 34, True), ("R1", "c2", "amt", ">", 60.0, 21, True), ("R1", "c3", "z", ">", 1.0, 18, False), ("R2", "c1", "n7", ">=", 3.0, 30, True), ("R2", "c2", "mcc", "!=", 4.0, 12, False), ("R2", "c3", "z", "<", 0.2, -9, False), ("R1", "c4", "mcc", "=", 7.0, -3, False), ("R3", "c1", "mcc", "=", 5.0, 0, False), ("V1", "c1", "mcc", "=", 3.0, -6, False), ("V1", "c2", "z", ">", 0.5, 2, False)]
RULE_SCHEMA = "rule_id string, action string, severity int, preventive boolean, is_veto boolean, review int, prevent int"
CONDITION_SCHEMA = "rule_id string, condition_id string, feature string, op string, operand double, points int, required boolean"
BANDS = [("high", 75), ("elevated", 40), ("low", 0)]


CARRIED = ["t", "account_id", "card_id", "device_id", "merchant_id", "label", "channel"]  # what reports ask of a decision's transaction


def facts(spark, sf_dir, only: DataFrame | None = None) -> DataFrame:
    """A row for each transaction: subject, the features that the rules ask for (null: absent), CARRIED. only: the subjects asked for; the windows
    then hold the whole history of their accounts, and of no others."""
    x = transactions(spark, sf_dir)
    if only is not None:
        asked = x.select(_c("txn_id").alias("subject"), "account_id").join(only, "subject", "left_semi")
        x = x.join(asked.select("account_id").distinct(), "account_id", "left_semi")
    x = x.select(_c("txn_id").alias("subject"), "amount", "mcc", *CARRIED)
    x = x.withColumn("n7", reducers.count(F.lit(True), trailing("account_id", "7d"))).withColumn("z", reducers.zscore_of_self("amount", trailing("account_id")))
    out = x.select("subject", _c("n7").cast("double").alias("n7"), _c("amount").cast("double").alias("amt"), F.round("z", 6).alias("z"), _c("mcc").cast("double").alias("mcc"), *CARRIED)
    return out if only is None else out.join(only, "subject", "left_semi")


INPUTS = ("events", "orders")  # that the shared tables derive from
stored_facts = shared("facts", ("events",))(facts)  # written once for the reports


def sheet(spark, sf_dir, rule_rows=None, condition_rows=None, of: DataFrame | None = None) -> Sheet:
    """The registered rules, or others, on facts that are worked out anew, or on those given."""
    return Sheet(facts(spark, sf_dir) if of is None else of, condition_rows or CONDITIONS, rule_rows or RULES)


def stored(spark, sf_dir, rule_rows=None, condition_rows=None) -> Sheet:
    return sheet(spark, sf_dir, rule_rows, condition_rows, stored_facts(spark, sf_dir))


def _literal(rows) -> str:
    return ", ".join("(" + ", ".join(str(v).upper() if isinstance(v, bool) else repr(v) for v in r) + ")" for r in rows)


_LEDGER = f"""WITH {TX}, f AS (SELECT p.txn_id AS subject, (SELECT count(*) FROM tx h WHERE h.account_id = p.account_id AND h.t <= p.t AND h.t > p.t - {WEEK}) AS n7, CAST(amount AS DOUBLE) AS amt, CAST(mcc AS DOUBLE) AS mcc,
 round({_OTHERS}, 6) AS z FROM tx p),
 v AS (SELECT subject, 'n7' AS feature, CAST(n7 AS DOUBLE) AS value FROM f UNION ALL SELECT subject, 'amt', amt FROM f UNION ALL SELECT subject, 'z', z FROM f UNION ALL SELECT subject, 'mcc', mcc FROM f),
 c(rule_id, condition_id, feature, op, operand, points, required) AS (VALUES {_literal(CONDITIONS)}), ru(rule_id, action, severity, preventive, is_veto, review, prevent) AS (VALUES {_literal(RULES)}),
 l0 AS (SELECT v.subject, c.*, ru.* EXCLUDE (rule_id), v.value IS NULL AS missing, coalesce(CASE op WHEN '>' THEN value > operand WHEN '>=' THEN value >= operand WHEN '<' THEN value < operand WHEN '=' THEN value = operand WHEN '!=' THEN value <> operand END, FALSE) AS fired FROM v JOIN c ON c.feature = v.feature JOIN ru ON ru.rule_id = c.rule_id),
 l AS (SELECT *, CASE WHEN fired AND satisfied THEN points ELSE 0 END AS contributed FROM (SELECT *, coalesce(bool_and(CASE WHEN required THEN fired END) OVER w, bool_or(fired) OVER w) AS satisfied FROM l0 WINDOW w AS (PARTITION BY subject, rule_id)))"""
_SCORES = """, s AS (SELECT subject, rule_id, sum(contributed) AS score, any_value(satisfied) AS satisfied, any_value(action) AS action, any_value(severity) AS severity, any_value(preventive) AS preventive, any_value(is_veto) AS is_veto, any_value(review) AS review, any_value(prevent) AS prevent, NOT coalesce(bool_or(missing) FILTER (points < 0), FALSE) AS sound, CASE WHEN count(*) FILTER (points < 0) = 0 THEN FALSE WHEN bool_or(missing) FILTER (points < 0) THEN NULL ELSE bool_and(fired) FILTER (points < 0) END AS veto FROM l GROUP BY 1, 2),
 sa AS (SELECT *, NOT is_veto AND satisfied AND score >= review AS authorised FROM s)"""
_SIGNALS = """, g AS (SELECT subject, feature, direction, arg_min(points, (-abs(points), rule_id, condition_id)) AS contribution, list_sort(list(DISTINCT rule_id)) AS claimed, arg_min(rule_id, (-abs(points), rule_id, condition_id)) AS rule_id FROM (SELECT *, CASE WHEN points >= 0 THEN 'aggravating' ELSE 'mitigating' END AS direction FROM l WHERE fired AND satisfied) GROUP BY 1, 2, 3),
 sg AS (SELECT * FROM (SELECT *, sum(contribution) OVER (PARTITION BY subject) AS score FROM g) WHERE score > 0)"""


@query("condition_ledger", _LEDGER + " SELECT subject, rule_id, condition_id, fired, satisfied, contributed FROM l")
def condition_ledger(spark, sf_dir):
    return sheet(spark, sf_dir).ledger().select("subject", "rule_id", "condition_id", "fired", "satisfied", "contributed")


@query("rule_score", _LEDGER + _SCORES + " SELECT subject, rule_id, score, satisfied, authorised, sound FROM sa")
def rule_score(spark, sf_dir):
    return sheet(spark, sf_dir).scores().select("subject", "rule_id", "score", "satisfied", "authorised", "sound")


@query("veto_state", _LEDGER + _SCORES + " SELECT subject, veto FROM sa WHERE is_veto")
def veto_state(spark, sf_dir):
    return sheet(spark, sf_dir).scores().filter("is_veto").select("subject", "veto")


@query("consolidate", _LEDGER + _SIGNALS + " SELECT subject, feature, direction, contribution, rule_id, array_to_string(claimed, ',') AS claimed, score FROM sg")
def consolidate(spark, sf_dir):
    return sheet(spark, sf_dir).signals().withColumn("claimed", F.array_join("claimed", ","))


_DECIDE = _LEDGER + _SCORES + _SIGNALS + """, pt AS (SELECT subject, max(score) AS score, array_to_string(list_sort(list_distinct(flatten(list(claimed)))), ',') AS rules_fired FROM sg GROUP BY 1),
 top AS (SELECT subject, rule_id, action, severity, preventive, score >= prevent AND sound AS may FROM sa WHERE authorised QUALIFY row_number() OVER (PARTITION BY subject ORDER BY severity DESC, rule_id) = 1),
 soft AS (SELECT subject, action, severity FROM sa WHERE authorised AND NOT preventive QUALIFY row_number() OVER (PARTITION BY subject ORDER BY severity DESC, rule_id) = 1),
 vt AS (SELECT subject, coalesce(bool_or(CASE WHEN is_veto THEN veto END), FALSE) OR bool_or(is_veto AND veto IS NULL) AS capped, coalesce(array_to_string(list_sort(list(rule_id) FILTER (authorised)), '+'), '') AS rules_authorised FROM sa GROUP BY 1),
 d AS (SELECT vt.subject, CAST(coalesce(pt.score, 0) AS BIGINT) AS score, CASE WHEN coalesce(pt.score, 0) >= 75 THEN 'high' WHEN coalesce(pt.score, 0) >= 40 THEN 'elevated' ELSE 'low' END AS band,
 CASE WHEN top.subject IS NULL THEN 'allow' WHEN capped AND CASE WHEN NOT top.preventive OR may THEN top.severity ELSE coalesce(soft.severity, 2) END > 1 THEN 'monitor' WHEN NOT top.preventive OR may THEN top.action ELSE coalesce(soft.action, 'alert') END AS action, top.rule_id AS source_rule, coalesce(rules_fired, '') AS rules_fired, rules_authorised
 FROM vt LEFT JOIN pt ON pt.subject = vt.subject LEFT JOIN top ON top.subject = vt.subject LEFT JOIN soft ON soft.subject = vt.subject)"""


@query("decisions", _DECIDE + " SELECT * FROM d")
def decisions(spark, sf_dir, rule_rows=None, condition_rows=None):
    return sheet(spark, sf_dir, rule_rows, condition_rows).decisions(BANDS)


@query("invariant_audit", _DECIDE + ", b AS (SELECT d.subject FROM d LEFT JOIN (SELECT subject, sum(contribution) AS c FROM sg GROUP BY 1) x ON x.subject = d.subject WHERE coalesce(c, 0) <> d.score OR (action <> 'allow' AND source_rule IS NULL)) SELECT count(*) AS n_bad FROM b")
def invariant_audit(spark, sf_dir):
    """Decisions whose score isn't the sum of their signals, or that act without a rule; both are worked out from the facts on their own."""
    of = sheet(spark, sf_dir)
    d = sheet(spark, sf_dir, of=of.by_signal(*(c for c in of.facts if c != "subject")).drop("score")).decisions(BANDS, "signals")
    total = F.aggregate("signals", F.lit(0).cast("long"), lambda n, s: n + s["contribution"])
    bad = (total != _c("score")) | ((_c("action") != "allow") & _c("source_rule").isNull())
    return d.agg(F.count_if(bad).alias("n_bad"))  # a filter would be pushed down, and repeat all that its columns are made of


@query("condition_performance", _LEDGER + " SELECT l.rule_id, condition_id, count(*) AS visited, count(*) FILTER (fired) AS n_fired, round(count(*) FILTER (fired) / count(*), 6) AS fire_rate, count(*) FILTER (missing) AS degraded, round(count(*) FILTER (fired AND label = CASE WHEN points >= 0 THEN 'fraud' ELSE 'legit' END) / nullif(count(*) FILTER (fired), 0), 6) AS hit_rate FROM l JOIN tx ON txn_id = subject GROUP BY 1, 2")
def condition_performance(spark, sf_dir):
    rows = sheet(spark, sf_dir).ledger("label")
    hit = _c("fired") & (_c("label") == F.when(_c("points") >= 0, "fraud").otherwise("legit"))
    n = F.count_if("fired")
    return rows.groupBy("rule_id", "condition_id").agg(F.count("*").alias("visited"), n.alias("n_fired"), F.round(n / F.count("*"), 6).alias("fire_rate"), F.count_if(_c("status") != "present").alias("degraded"), F.round(F.count_if(hit) / F.when(n > 0, n), 6).alias("hit_rate"))


@query("exposure_account", f"WITH {TX} SELECT p.txn_id, coalesce((SELECT sum(h.amount) FROM tx h WHERE h.account_id = p.account_id AND h.direction = 'outbound' AND h.t <= p.t AND h.t > p.t - {90 * DAY}), 0) AS exposure FROM tx p")
def exposure_account(spark, sf_dir):
    x = transactions(spark, sf_dir)
    return x.select("txn_id", F.coalesce(reducers.total(_c("direction") == "outbound", "amount", trailing("account_id", "90d")), F.lit(0)).alias("exposure"))


def _exposure_sql(kind: str, key: str, days: int, where: str) -> str:
    name = "outbound" if kind == "account" else "volume"
    return f"SELECT p.txn_id, '{kind}' AS subject_type, '{name}_{days}d' AS basis, coalesce((SELECT sum(h.amount) FROM tx h WHERE h.{key} = p.{key} AND {where} AND h.t <= p.t AND h.t > p.t - {days * DAY}), 0)::DECIMAL(28,4) AS exposure FROM tx p"


@query("exposure_all", f"WITH {TX} SELECT txn_id, 'transaction' AS subject_type, 'amount' AS basis, amount::DECIMAL(28,4) AS exposure FROM tx UNION ALL " + " UNION ALL ".join(_exposure_sql(kind, f"{kind}_id", 90 if kind == "account" else 30, "h.direction = 'outbound'" if kind == "account" else "TRUE") for kind in ("account", "card", "device", "merchant")))
def exposure_all(spark, sf_dir):
    return exposure.exposures(transactions(spark, sf_dir), {k: f"{k}_id" for k in ("account", "card", "device", "merchant")})


PREVENTIVE = ["challenge"]
CHANNELS = [("challenge", "high", "push"), ("challenge", "elevated", "sms"), ("challenge", "low", "sms"), ("notify", "high", "queue"), ("notify", "elevated", "inbox"), ("notify", "low", "inbox")]


@query("rule_catalog", _LEDGER + " SELECT rule_id, condition_id, points, CASE WHEN n_fired = 0 THEN 'never fired' WHEN points >= 0 THEN 'aggravating' ELSE 'mitigating' END AS standing, n_fired FROM (SELECT rule_id, condition_id, any_value(points) AS points, count(*) FILTER (fired) AS n_fired FROM l GROUP BY 1, 2)")
def rule_catalog(spark, sf_dir):
    """Each condition with its direction, or that it never fired."""
    by = sheet(spark, sf_dir).ledger().groupBy("rule_id", "condition_id").agg(F.first("points").alias("points"), F.count_if("fired").alias("n_fired"))
    return by.select("rule_id", "condition_id", "points", F.when(_c("n_fired") == 0, "never fired").when(_c("points") >= 0, "aggravating").otherwise("mitigating").alias("standing"), "n_fired")


_ROUTED = _DECIDE + f""", dt AS MATERIALIZED (SELECT d.*, tx.t, tx.account_id FROM d JOIN tx ON txn_id = subject),
 closed AS MATERIALIZED (SELECT o_orderkey // 2 AS id, min(tx.t + (30 + o_custkey % 2880) * 60000000) AS closes_at FROM orders JOIN tx ON txn_id = o_orderkey // 2 GROUP BY 1),
 o AS MATERIALIZED (SELECT account_id, subject AS id, concat('account:', account_id, ':', rules_authorised) AS key, t, score, closes_at, row_number() OVER (PARTITION BY account_id ORDER BY t, subject) AS n FROM dt LEFT JOIN closed ON closed.id = subject WHERE source_rule IS NOT NULL),
 fold AS (SELECT account_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, '' AS routing, CAST(NULL AS BIGINT) AS case_id, []::STRUCT(k VARCHAR, f BIGINT, s BIGINT, i BIGINT, c BIGINT)[] AS cs FROM o WHERE n = 1 UNION ALL
 SELECT account_id, n, id, CASE WHEN mine IS NOT NULL AND score > mine.s THEN 'restated' WHEN mine IS NOT NULL THEN 'folded' WHEN blocks IS NOT NULL THEN 'suppressed' ELSE 'raised' END, coalesce(mine.i, blocks.i, id),
 CASE WHEN mine IS NOT NULL THEN [CASE WHEN x.i = mine.i THEN {{'k': x.k, 'f': x.f, 's': greatest(x.s, score), 'i': x.i, 'c': x.c}} ELSE x END FOR x IN live] WHEN blocks IS NOT NULL THEN live ELSE list_append(live, {{'k': key, 'f': t, 's': score, 'i': id, 'c': closes_at}}) END
 FROM (SELECT *, [x FOR x IN live IF x.k = key][-1] AS mine, [x FOR x IN live IF x.c IS NULL OR x.c > t][-1] AS blocks FROM (SELECT o.*, [x FOR x IN cs IF o.t - x.f <= {WEEK}] AS live FROM fold JOIN o ON o.account_id = fold.account_id AND o.n = fold.n + 1))),
 routed AS MATERIALIZED (SELECT id, routing, case_id FROM fold WHERE n > 0 UNION ALL SELECT subject, 'no_authority', NULL FROM dt WHERE source_rule IS NULL)"""
_ROUTED = _ROUTED.replace("WITH ", "WITH RECURSIVE ", 1)


def _route(spark, sf_dir, decided_rows: DataFrame) -> DataFrame:
    """decided_rows: subject, t, account_id, score, source_rule, rules_authorised."""
    closed = case_outcomes(spark, sf_dir).groupBy(_c("alert_id").alias("subject")).agg(F.min("decided_at").alias("closes_at"))
    key = F.concat_ws(":", F.lit("account"), _c("account_id").cast("string"), "rules_authorised")
    d = decided_rows.join(closed, "subject", "left")
    return cases.route(d.select(_c("account_id").alias("subject"), _c("subject").alias("id"), key.alias("key"), "t", "score", _c("source_rule").isNotNull().alias("authorised"), "closes_at"), WEEK)


@query("case_routing", _ROUTED + " SELECT id, routing, case_id FROM routed")
def case_routing(spark, sf_dir):
    """A case with a verdict no longer suppresses."""
    return _route(spark, sf_dir, sheet(spark, sf_dir).decisions(BANDS, "t", "account_id"))


def ledger_rows(spark, sf_dir, *more: str):
    """The condition ledger of the registered rules, from the stored facts."""
    return stored(spark, sf_dir).ledger(*more)


def signals(spark, sf_dir):
    return stored(spark, sf_dir).signals()


def decided_subjects(spark, sf_dir):
    """Decisions with what reports ask of their transaction."""
    return stored(spark, sf_dir).decisions(BANDS, *CARRIED)


@shared("decided", INPUTS)
def decided(spark, sf_dir):
    """Decisions with routing and case: id, t, score, band, action, ..."""
    d = decided_subjects(spark, sf_dir)
    return d.withColumnRenamed("subject", "id").join(_route(spark, sf_dir, d), "id")


_CHANNELS_SQL = "c(action, band, channel) AS (VALUES ('challenge', 'high', 'push'), ('challenge', 'elevated', 'sms'), ('challenge', 'low', 'sms'), ('notify', 'high', 'queue'), ('notify', 'elevated', 'inbox'), ('notify', 'low', 'inbox'))"
_ISSUED = _ROUTED + f", {_CHANNELS_SQL.replace('c(', 'chan(', 1)}, issued AS (SELECT subject, action, band FROM dt JOIN routed ON id = subject WHERE routing = 'raised' AND action = 'challenge' UNION ALL SELECT subject, 'notify', band FROM dt JOIN routed ON id = subject WHERE routing IN ('raised', 'restated'))"


@query("actions_routed", _ISSUED + " SELECT subject, action, channel FROM issued LEFT JOIN chan USING (action, band)")
def actions_routed(spark, sf_dir):
    """What is issued: a preventive action for raised decisions, a notice for raised and restated ones. A missing channel is an error."""
    d = decided(spark, sf_dir).withColumnRenamed("id", "subject")
    channels = spark.createDataFrame(CHANNELS, "action string, band string, channel string")
    return cases.issue(d.select("subject", "action", "band", "routing"), channels, PREVENTIVE)


@query("actions_issued", _ISSUED + " SELECT subject, action, channel, t AS issued_at, case_id FROM issued JOIN (SELECT subject, t FROM dt) USING (subject) LEFT JOIN chan USING (action, band) LEFT JOIN routed ON id = subject")
def actions_issued(spark, sf_dir):
    """The actions issued, with their instant (that of the decision) and their case."""
    d = decided(spark, sf_dir).withColumnRenamed("id", "subject")
    channels = spark.createDataFrame(CHANNELS, "action string, band string, channel string")
    issued = cases.issue(d.select("subject", "action", "band", "routing"), channels, PREVENTIVE)
    return issued.join(d.select("subject", _c("t").alias("issued_at"), "case_id"), "subject")


@query("ingest_reject", f"WITH {TX} SELECT txn_id, concat_ws(',', CASE WHEN mcc IS NULL THEN 'missing mcc' END, CASE WHEN s_suppkey IS NULL THEN 'unknown device' END, CASE WHEN amount < 1 THEN 'amount too small' END) AS reasons FROM tx LEFT JOIN (SELECT DISTINCT s_suppkey FROM supplier) ON s_suppkey = device_id WHERE mcc IS NULL OR s_suppkey IS NULL OR amount < 1")
def ingest_reject(spark, sf_dir):
    known = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(_c("s_suppkey").alias("device_id"), F.lit(True).alias("known")).distinct()
    x = transactions(spark, sf_dir).join(known, "device_id", "left")
    reasons = F.array_compact(F.array(F.when(_c("mcc").isNull(), "missing mcc"), F.when(_c("known").isNull(), "unknown device"), F.when(_c("amount") < 1, "amount too small")))
    return x.withColumn("r", reasons).filter(F.size("r") > 0).select("txn_id", F.array_join("r", ",").alias("reasons"))


@query("ingest_dedup", f"WITH {TX} SELECT account_id, merchant_id, mcc, min(txn_id) AS txn_id FROM tx GROUP BY 1, 2, 3")
def ingest_dedup(spark, sf_dir):
    w = Window.partitionBy("account_id", "merchant_id", "mcc").orderBy("txn_id")
    return transactions(spark, sf_dir).withColumn("r", F.row_number().over(w)).filter("r = 1").select("account_id", "merchant_id", "mcc", "txn_id")


@query("device_registration", f"WITH {TX} SELECT device_id, arg_min(t, txn_id) AS first_seen FROM tx WHERE auth_result = 'approved' GROUP BY 1")
def device_registration(spark, sf_dir):
    return transactions(spark, sf_dir).filter("auth_result = 'approved'").groupBy("device_id").agg(F.min_by("t", "txn_id").alias("first_seen"))


@query("frontier", f"WITH {TX} SELECT max(t) AS frontier FROM tx")
def frontier(spark, sf_dir):
    return transactions(spark, sf_dir).agg(F.max("t").alias("frontier"))


@query("plan_subjects", f"WITH {TX} SELECT 'account' AS subject_type, account_id AS subject, arg_max(txn_id, (CASE WHEN direction = 'outbound' THEN 1 ELSE 0 END, t)) AS trigger_id FROM tx GROUP BY 2 UNION ALL SELECT 'card', card_id, arg_max(txn_id, t) FROM tx GROUP BY 2 UNION ALL SELECT 'merchant', merchant_id, arg_max(txn_id, t) FROM tx GROUP BY 2")
def plan_subjects(spark, sf_dir):
    x = transactions(spark, sf_dir)
    by = lambda kind, key, order: x.groupBy(_c(key).cast("long").alias("subject")).agg(F.max_by("txn_id", order).alias("trigger_id")).select(F.lit(kind).alias("subject_type"), "subject", "trigger_id")
    return by("account", "account_id", F.struct((_c("direction") == "outbound").cast("int"), "t")).unionByName(by("card", "card_id", _c("t"))).unionByName(by("merchant", "merchant_id", _c("t")))


@query("kpi_bands", _DECIDE + " SELECT band, action, count(*) AS n, count(*) FILTER (label = 'fraud') AS n_fraud, round(avg(d.score), 6) AS mean_score FROM d JOIN tx ON txn_id = subject GROUP BY 1, 2")
def kpi_bands(spark, sf_dir):
    d = sheet(spark, sf_dir).decisions(BANDS, "label")
    return d.groupBy("band", "action").agg(F.count("*").alias("n"), F.count_if(_c("label") == "fraud").alias("n_fraud"), F.round(F.avg("score"), 6).alias("mean_score"))


@query("kpi_percentiles", f"WITH {TX} SELECT direction, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY CAST(amount AS DOUBLE)), 6) AS p50, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY CAST(amount AS DOUBLE)), 6) AS p90 FROM tx GROUP BY 1")
def kpi_percentiles(spark, sf_dir):
    return transactions(spark, sf_dir).groupBy("direction").agg(*[F.round(F.percentile(_c("amount").cast("double"), p), 6).alias(n) for p, n in ((0.5, "p50"), (0.9, "p90"))])
