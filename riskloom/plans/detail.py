"""Decision rows in full, alerts in detail, frontiers and watermarks of stages, subjects that an arrival touches, catalogs and checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import micros, trailing
from ..operators import reducers, rules
from ..sources.tables import arrivals, entity_links, transactions
from .doors import BATCH
from .evidence import _RANKED, _VERSIONS, _ranked, _version_sets
from .kpi import BASE, _case_base
from .queries import _DECIDE, _LEDGER, _SCORES, CONDITIONS, DAY, LINKS, RULES, TX, WEEK, _literal, decided, decided_subjects, exposure_account, graph_fanout, ledger_rows, query, stored
from .simulate import swapped

_c = F.col
LAG = micros("15m")
BANDS_BY_TYPE = [("transaction", "high", 75), ("transaction", "elevated", 40), ("transaction", "low", 0), ("account", "severe", 60), ("account", "watch", 20)]
_KIND = "CASE WHEN channel = 'cnp' THEN 'account' WHEN channel = 'pos' THEN 'device' ELSE 'transaction' END"
LIVE = [r[0] for r in RULES]


@query("decision_rows", swapped(_VERSIONS, (_LEDGER, _DECIDE)) + f""", bd(subject_type, band, min_score) AS (VALUES {_literal(BANDS_BY_TYPE)}),
 ty AS (SELECT d.*, tx.t, channel, {_KIND} AS subject_type FROM (SELECT * EXCLUDE (band) FROM d) d JOIN tx ON txn_id = subject), tb AS (SELECT *, CASE WHEN subject_type IN (SELECT subject_type FROM bd) THEN subject_type ELSE 'transaction' END AS ladder FROM ty),
 dg AS (SELECT subject, string_agg(DISTINCT feature, ',' ORDER BY feature) AS degraded FROM l WHERE missing GROUP BY 1)
 SELECT tb.subject, subject_type, CASE WHEN channel = 'online' THEN 'async' ELSE 'inline_sync' END AS lane, CASE WHEN channel = 'online' THEN 'closed' ELSE 'open' END AS fail_mode, score, coalesce((SELECT arg_max(band, min_score) FROM bd WHERE bd.subject_type = ladder AND score >= min_score), 'low') AS band, action, source_rule, rules_fired,
 (SELECT string_agg(concat(name, '=', version), ',' ORDER BY name) FROM rv WHERE rv.subject = tb.subject) AS rule_version_set, coalesce(degraded, '') AS degraded, t + CASE WHEN channel = 'online' THEN {LAG} ELSE 0 END AS pit_bound_at FROM tb LEFT JOIN dg ON dg.subject = tb.subject""")
def decision_rows(spark, sf_dir):
    """Decisions as they are stored: kind of subject and its band, lane and how it fails, versions, evidence that lacked, the bound of reads."""
    kind = F.when(_c("channel") == "cnp", "account").when(_c("channel") == "pos", "device").otherwise("transaction")
    inline = _c("channel") != "online"
    d = rules.banded(decided_subjects(spark, sf_dir).drop("band").withColumn("subject_type", kind), spark.createDataFrame(BANDS_BY_TYPE, "subject_type string, band string, min_score int"))
    line = F.array_join(F.array_sort(F.transform(F.map_entries("rule_version_set"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))), ",")
    d = d.join(_version_sets(spark, sf_dir).select("subject", line.alias("rule_version_set")), "subject", "left").join(rules.degraded_features(ledger_rows(spark, sf_dir), LIVE), "subject", "left")
    return d.select("subject", "subject_type", F.when(inline, "inline_sync").otherwise("async").alias("lane"), F.when(inline, "open").otherwise("closed").alias("fail_mode"), "score", "band", "action", "source_rule", "rules_fired", "rule_version_set", F.coalesce(F.array_join("degraded", ","), F.lit("")).alias("degraded"), (_c("t") + F.when(inline, 0).otherwise(LAG)).alias("pit_bound_at"))


_STATUS = "CASE WHEN disposition IS NULL THEN 'open' WHEN disposition = 'false_positive' THEN 'false_positive' WHEN disposition = 'inconclusive' THEN 'escalated' ELSE 'resolved' END"


@query("alert_detail", BASE + _RANKED + f""", ex AS (SELECT p.txn_id, coalesce((SELECT sum(h.amount) FROM tx h WHERE h.account_id = p.account_id AND h.direction = 'outbound' AND h.t <= p.t AND h.t > p.t - {90 * DAY}), 0)::DECIMAL(28,4) AS exposure FROM tx p WHERE p.txn_id IN (SELECT decision_id FROM kc)),
 bar AS (SELECT subject, string_agg(concat(rank, '.', reason_code, '=', contribution), ' ' ORDER BY rank) AS signals FROM rk GROUP BY 1),
 cov AS (SELECT case_id AS alert_id, string_agg(concat('transaction:', subject), ',' ORDER BY subject) AS subjects FROM routed JOIN dt ON dt.subject = routed.id WHERE routing IN ('raised', 'restated') GROUP BY 1)
 SELECT kc.alert_id, {_STATUS} AS status, kc.score, kc.band, kc.action, source_rule, rr.severity, 'outbound_90d' AS exposure_basis, exposure, signals, subjects FROM kc JOIN ex ON txn_id = decision_id LEFT JOIN bar ON bar.subject = decision_id LEFT JOIN cov ON cov.alert_id = kc.alert_id LEFT JOIN ru rr ON rr.rule_id = source_rule WHERE {_STATUS} IN ('open', 'escalated') AND kc.band <> 'low'""")
def alert_detail(spark, sf_dir):
    """Cases open or escalated above the lowest band, in detail: the rule behind the action, exposure with its basis, the bar in order, the
    subjects covered. All is that of the last restating decision."""
    disposition = _c("disposition")
    status = F.when(disposition.isNull(), "open").when(disposition == "false_positive", "false_positive").when(disposition == "inconclusive", "escalated").otherwise("resolved")
    x = _case_base(spark, sf_dir).withColumn("status", status).filter("status in ('open', 'escalated') and band <> 'low'")
    item = F.concat(_c("rank").cast("string"), F.lit("."), _c("reason_code"), F.lit("="), _c("contribution").cast("string"))
    bar = _ranked(spark, sf_dir).groupBy(_c("subject").alias("decision_id")).agg(F.array_sort(F.collect_list(F.struct("rank", item.alias("item")))).alias("s")).select("decision_id", F.array_join("s.item", " ").alias("signals"))
    covered = decided(spark, sf_dir).filter("routing in ('raised', 'restated')").groupBy(_c("case_id").alias("alert_id")).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    covered = covered.select("alert_id", F.array_join(F.transform("ids", lambda i: F.concat(F.lit("transaction:"), i.cast("string"))), ",").alias("subjects"))
    rule = spark.createDataFrame([(r[0], r[2]) for r in RULES], "source_rule string, severity int")
    money = exposure_account(spark, sf_dir).select(_c("txn_id").alias("decision_id"), _c("exposure").cast("decimal(28,4)").alias("exposure"))
    x = x.join(money, "decision_id").join(bar, "decision_id", "left").join(covered, "alert_id", "left").join(F.broadcast(rule), "source_rule", "left")
    return x.select("alert_id", "status", "score", "band", "action", "source_rule", "severity", F.lit("outbound_90d").alias("exposure_basis"), "exposure", "signals", "subjects")


def frontier_of(*relations: tuple[DataFrame, str]) -> DataFrame:
    """One row with the newest instant of several relations, each with its column of event time."""
    each = [df.agg(F.max(c).alias("newest")) for df, c in relations]
    return reduce(DataFrame.unionByName, each).agg(F.max("newest").alias("frontier"))


STAGES = ["graph", "features", "inline_sync", "async"]


@query("stage_watermarks", BATCH + f""", {TX}, {LINKS}, fr AS (SELECT max(x) AS frontier FROM (SELECT max(t) AS x FROM tx UNION ALL SELECT max(occurred_at) FROM ar UNION ALL SELECT max(epoch_us(first_seen::TIMESTAMP)) FROM links)), st(stage, place, done) AS (VALUES ('graph', 0, TRUE), ('features', 1, TRUE), ('inline_sync', 2, TRUE), ('async', 3, FALSE)),
 old AS (SELECT stage, CASE stage WHEN 'graph' THEN frontier + 5 ELSE frontier - place * {DAY} END AS watermark FROM st, fr) SELECT st.stage, CASE WHEN done THEN greatest(watermark, frontier) ELSE watermark END AS watermark, frontier FROM st JOIN old ON old.stage = st.stage, fr""")
def stage_watermarks(spark, sf_dir):
    """Marks of the stages after a pass to the frontier of transactions, arrivals and links: a stage's mark moves once its work is done and
    never back; one stage is ahead here and one didn't finish."""
    links = entity_links(spark, sf_dir).withColumn("at", F.unix_micros(_c("first_seen").cast("timestamp")))
    frontier = frontier_of((transactions(spark, sf_dir), "t"), (arrivals(spark, sf_dir), "occurred_at"), (links, "at"))
    stages = spark.createDataFrame([(s, i, s != "async") for i, s in enumerate(STAGES)], "stage string, place int, done boolean")
    old = F.when(_c("stage") == "graph", _c("frontier") + 5).otherwise(_c("frontier") - _c("place") * DAY)
    x = stages.crossJoin(F.broadcast(frontier)).withColumn("watermark", old)  # one row
    return x.select("stage", F.when(_c("done"), F.greatest("watermark", "frontier")).otherwise(_c("watermark")).alias("watermark"), "frontier")


_SINCE = 1705795200000000


@query("affected_subjects", f"""WITH {TX}, {LINKS}, n AS (SELECT * FROM tx WHERE t > {_SINCE}), q AS (SELECT device_id FROM links GROUP BY 1 HAVING count(DISTINCT account_id) > 3)
 SELECT DISTINCT subject_type, subject FROM (SELECT 'transaction' AS subject_type, txn_id::VARCHAR AS subject FROM n UNION ALL SELECT 'account', account_id::VARCHAR FROM n UNION ALL SELECT 'card', card_id::VARCHAR FROM n UNION ALL SELECT 'device', device_id::VARCHAR FROM n UNION ALL SELECT 'merchant', merchant_id::VARCHAR FROM n UNION ALL SELECT 'customer', (account_id // 3)::VARCHAR FROM n
 UNION ALL SELECT 'network', concat('device_fanout:', links.device_id) FROM links JOIN q ON q.device_id = links.device_id WHERE account_id IN (SELECT account_id FROM n) UNION ALL SELECT 'network', concat('device_fanout:', device_id) FROM links WHERE device_id IN (SELECT device_id FROM q) GROUP BY device_id HAVING max(epoch_us(first_seen::TIMESTAMP)) > {_SINCE}) WHERE subject IS NOT NULL""")
def affected_subjects(spark, sf_dir):
    """What the rows above a mark touch: themselves, their five dimensions, the clusters of their accounts, and clusters with a new link."""
    new = transactions(spark, sf_dir).filter(_c("t") > _SINCE)
    keys = {"transaction": _c("txn_id"), "account": _c("account_id"), "card": _c("card_id"), "device": _c("device_id"), "merchant": _c("merchant_id"), "customer": F.floor(_c("account_id") / 3)}
    own = new.select(F.inline(F.array(*(F.struct(F.lit(k).alias("subject_type"), c.cast("string").alias("subject")) for k, c in keys.items()))))
    ring = entity_links(spark, sf_dir).join(graph_fanout(spark, sf_dir).select("device_id"), "device_id", "left_semi")
    of_accounts = ring.join(new.select("account_id").distinct(), "account_id", "left_semi").select("device_id")
    fresh = ring.filter(F.unix_micros(_c("first_seen").cast("timestamp")) > _SINCE).select("device_id")
    named = of_accounts.unionByName(fresh).select(F.lit("network").alias("subject_type"), F.concat(F.lit("device_fanout:"), _c("device_id").cast("string")).alias("subject"))
    return own.unionByName(named).filter("subject is not null").distinct()


@query("scoped_pass", f"WITH {TX}, w AS (SELECT DISTINCT account_id, t FROM tx WHERE t > (SELECT max(t) FROM tx) - {micros('6h')}) SELECT account_id, t AS as_of, (SELECT count(*) FROM tx h WHERE h.account_id = w.account_id AND h.t <= w.t AND h.t > w.t - {WEEK}) AS n7, (SELECT sum(amount) FROM tx h WHERE h.account_id = w.account_id AND h.t <= w.t AND h.t > w.t - {WEEK} AND direction = 'inbound')::DECIMAL(28,4) AS s7 FROM w")
def scoped_pass(spark, sf_dir):
    """A pass over the arrivals of the last six hours: their accounts' rows of one window before are read, and only their instants are driven."""
    x = transactions(spark, sf_dir)
    newest = x.agg(F.max("t")).first()[0]
    since = newest - micros("6h")
    driven = x.filter(_c("t") > since).select("account_id").distinct()
    near = x.filter(_c("t") > since - WEEK).join(driven, "account_id", "left_semi")
    w = trailing("account_id", "7d")
    out = near.select("account_id", _c("t").alias("as_of"), reducers.count(F.lit(True), w).alias("n7"), reducers.total(_c("direction") == "inbound", "amount", w).alias("s7"))
    return out.filter(_c("as_of") > since).distinct()


REASONS = [("reason:n7", "velocity"), ("reason:amt", "size"), ("reason:z", "unusual size"), ("reason:mcc", "kind of merchant"), ("reason:geo", "place"), ("VETO_APPLIED", "veto"), ("DEGRADED_EVIDENCE", "evidence missing")]


@query("reason_catalog", f"WITH {TX}, c(rule_id, condition_id, feature, op, operand, points, required) AS (VALUES {_literal(CONDITIONS)}), rs(reason_code, said) AS (VALUES {_literal(REASONS)}), p AS (SELECT concat('reason:', feature) AS reason_code, count(*) FILTER (points < 0) AS down, count(*) FILTER (points >= 0) AS up FROM c GROUP BY 1), n AS (SELECT merchant_id, count(*) FROM tx GROUP BY 1) SELECT rs.reason_code, said, coalesce(up, 0) AS up, coalesce(down, 0) AS down, CASE WHEN rs.reason_code IN ('VETO_APPLIED', 'DEGRADED_EVIDENCE') THEN 'veto' WHEN coalesce(up, 0) + coalesce(down, 0) = 0 THEN NULL WHEN down = 0 THEN 'aggravating' WHEN up = 0 THEN 'mitigating' ELSE 'both' END AS direction, (SELECT count(*) FROM tx WHERE rs.reason_code = 'reason:geo' AND lat IS NOT NULL) AS n_places FROM rs LEFT JOIN p ON p.reason_code = rs.reason_code")
def reason_catalog(spark, sf_dir):
    """Reason codes with the way that conditions price them: aggravating, mitigating, both, veto, or none where nothing cites a code."""
    from .queries import CONDITION_SCHEMA

    priced = spark.createDataFrame(CONDITIONS, CONDITION_SCHEMA).groupBy(F.concat(F.lit("reason:"), "feature").alias("reason_code")).agg(F.count_if(_c("points") < 0).alias("down"), F.count_if(_c("points") >= 0).alias("up"))
    x = spark.createDataFrame(REASONS, "reason_code string, said string").join(priced, "reason_code", "left").fillna(0, ["up", "down"])
    places = transactions(spark, sf_dir).filter("lat is not null").agg(F.count("*").alias("places"))  # one row
    up, down = _c("up"), _c("down")
    direction = F.when(_c("reason_code").isin(rules.VETO_APPLIED, rules.DEGRADED_EVIDENCE), "veto").when(up + down == 0, None).when(down == 0, "aggravating").when(up == 0, "mitigating").otherwise("both")
    return x.crossJoin(F.broadcast(places)).select("reason_code", "said", "up", "down", direction.alias("direction"), F.when(_c("reason_code") == "reason:geo", _c("places")).otherwise(0).alias("n_places"))


@query("rule_catalog_view", _LEDGER + _SCORES + ", vs AS (SELECT l.rule_id, max(CASE WHEN tx.t >= 1705276800000000 AND l.rule_id IN ('R1', 'R2') THEN 2 ELSE 1 END) AS version FROM l JOIN tx ON txn_id = subject GROUP BY 1), pf AS (SELECT rule_id, string_agg(concat(condition_id, ':', visited, '/', n_fired, '/', degraded), ' ' ORDER BY condition_id) AS performance, count(*) AS n_conditions FROM (SELECT rule_id, condition_id, count(*) AS visited, count(*) FILTER (fired) AS n_fired, count(*) FILTER (missing) AS degraded FROM l GROUP BY 1, 2) GROUP BY 1) SELECT ru.rule_id, action, severity, is_veto, version, n_conditions, performance, (SELECT count(*) FROM sa WHERE sa.rule_id = ru.rule_id AND authorised) AS authorised FROM ru JOIN pf ON pf.rule_id = ru.rule_id JOIN vs ON vs.rule_id = ru.rule_id")
def rule_catalog_view(spark, sf_dir):
    """Rules with their newest version in use, conditions with their measured performance (visited, fired, degraded), and authority given."""
    rows = ledger_rows(spark, sf_dir, "t")
    by = rows.groupBy("rule_id", "condition_id").agg(F.count("*").alias("visited"), F.count_if("fired").alias("fired"), F.count_if(_c("status") != "present").alias("degraded"))
    line = F.concat_ws("/", F.concat_ws(":", "condition_id", _c("visited").cast("string")), _c("fired").cast("string"), _c("degraded").cast("string"))
    conditions = by.groupBy("rule_id").agg(F.array_sort(F.collect_list(F.struct("condition_id", line.alias("line")))).alias("c"), F.count("*").alias("n_conditions"))
    version = rows.groupBy("rule_id").agg(F.max(F.when((_c("t") >= 1705276800000000) & _c("rule_id").isin("R1", "R2"), 2).otherwise(1)).alias("version"))
    given = stored(spark, sf_dir).scores().groupBy("rule_id").agg(F.count_if("authorised").alias("authorised"), F.first("action").alias("action"), F.first("severity").alias("severity"), F.first("is_veto").alias("is_veto"))
    return given.join(conditions, "rule_id").join(version, "rule_id").select("rule_id", "action", "severity", "is_veto", "version", "n_conditions", F.array_join("c.line", " ").alias("performance"), "authorised")


KNOWN_REDUCERS = ["count", "sum", "zscore_of_self"]
CATALOG = [("n7", "count", "account"), ("s7", "sum", "account"), ("odd", "medoid", "account"), ("none", None, "card"), ("far", "count", "planet")]
POLICIES = ["account", "card", "network"]


@query("catalog_checks", f"WITH {TX}, ca(feature, reducer, subject_type) AS (VALUES ('n7', 'count', 'account'), ('s7', 'sum', 'account'), ('odd', 'medoid', 'account'), ('none', NULL, 'card'), ('far', 'count', 'planet')), v AS (SELECT account_id AS key, t // {DAY} * {DAY} AS as_of, t // 3600000000 AS computed_at FROM tx WHERE txn_type = 'transfer') SELECT 'no computable definition' AS failure, feature AS what, 1::BIGINT AS n FROM ca WHERE reducer IS NULL OR reducer NOT IN ('count', 'sum', 'zscore_of_self') UNION ALL SELECT DISTINCT 'no policy', subject_type, 1::BIGINT FROM ca WHERE subject_type NOT IN ('account', 'card', 'network') UNION ALL SELECT 'repeated bitemporal key', concat(key, '@', as_of, '@', computed_at), count(*) FROM v GROUP BY key, as_of, computed_at HAVING count(*) > 1")
def catalog_checks(spark, sf_dir):
    """What shouldn't be: features that nothing can compute, kinds of subject without an alert policy, values stored twice under one key."""
    catalog = spark.createDataFrame(CATALOG, "feature string, reducer string, subject_type string")
    said = lambda what, name, n=None: (F.lit(what).alias("failure"), name.alias("what"), (F.lit(1) if n is None else n).cast("long").alias("n"))
    spec = catalog.filter(_c("reducer").isNull() | ~_c("reducer").isin(KNOWN_REDUCERS)).select(*said("no computable definition", _c("feature")))
    policy = catalog.join(spark.createDataFrame([(p,) for p in POLICIES], "subject_type string"), "subject_type", "left_anti").select("subject_type").distinct().select(*said("no policy", _c("subject_type")))
    values = transactions(spark, sf_dir).filter("txn_type = 'transfer'").select(_c("account_id").alias("key"), (F.floor(_c("t") / DAY) * DAY).alias("as_of"), F.floor(_c("t") / 3_600_000_000).alias("computed_at"))
    again = values.groupBy("key", "as_of", "computed_at").agg(F.count("*").alias("c")).filter("c > 1").select(*said("repeated bitemporal key", F.concat_ws("@", _c("key").cast("string"), _c("as_of").cast("string"), _c("computed_at").cast("string")), _c("c")))
    return spec.unionByName(policy).unionByName(again)


@query("ingest_fields", BATCH + """ SELECT index, 'event' AS relation, concat_ws(';', CASE WHEN occurred_at IS NULL THEN 'missing occurred_at' END, CASE WHEN txn_type IS NULL THEN 'missing event_type' END, CASE WHEN device_id IS NULL THEN 'missing subject_id' END) AS reasons FROM ar WHERE occurred_at IS NULL OR txn_type IS NULL OR device_id IS NULL
 UNION ALL SELECT index, 'link', concat_ws(';', CASE WHEN device_id IS NULL THEN 'missing from_id' END, CASE WHEN direction IS NULL THEN 'missing link_type' END, CASE WHEN as_of IS NULL THEN 'missing as_of' END) FROM ar WHERE device_id IS NULL OR direction IS NULL OR as_of IS NULL""")
def ingest_fields(spark, sf_dir):
    """Rows submitted as events and as links that lack a field that their relation asks for, with all that is missing."""
    from ..operators import ingest

    x = arrivals(spark, sf_dir)
    out = []
    for relation, fields in (("event", {"occurred_at": "occurred_at", "event_type": "txn_type", "subject_type": "subject_type", "subject_id": "device_id"}), ("link", {"from_type": "subject_type", "from_id": "device_id", "to_id": "customer_id", "link_type": "direction", "as_of": "as_of"})):
        named = x.select("index", *(_c(c).alias(f) for f, c in fields.items()))
        out.append(named.withColumn("r", ingest.reasons(list(fields), [], {}, {})).filter(F.size("r") > 0).select("index", F.lit(relation).alias("relation"), F.array_join("r", ";").alias("reasons")))
    return out[0].unionByName(out[1])
