"""Streaming forms of the engine's work, each with the SQL of its batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.windows import micros
from ..operators import authorize, pit
from ..sources.tables import arrivals, case_outcomes, transactions
from ..streaming import stream
from .doors import BATCH
from .queries import _PIT, _ROUTED, DAY, TX, WEEK, _store, decided, query

CUTS = [1704585600000000, 1705190400000000, 1705795200000000]  # three instants of the month


_BATCH_OF = "CASE " + " ".join(f"WHEN t < {c} THEN {i}" for i, c in enumerate(CUTS)) + f" ELSE {len(CUTS)} END"


def _arrive(rows, at: str, read, sink, mode: str = "append") -> None:
    """rows arrive in the order of column `at`, in four runs."""
    stream.arrive([{"rows": span} for span in stream.spans(rows, at, CUTS)], lambda x: read(x["rows"]), sink, mode)


@query("stream_dedup", BATCH + " SELECT DISTINCT txn_id FROM ar WHERE occurred_at IS NOT NULL")
def stream_dedup(spark, sf_dir):
    """Ids that arrive, each once, within a watermark of a month: state is dropped beyond it."""
    rows = arrivals(spark, sf_dir).filter("occurred_at is not null").select("txn_id", F.timestamp_micros("occurred_at").alias("at"), "occurred_at")
    out = stream.work_dir(spark, "stream-out")
    _arrive(rows, "occurred_at", lambda s: s.withWatermark("at", "31 days").dropDuplicatesWithinWatermark(["txn_id"]).select("txn_id"), stream.by_batch(out))
    return spark.read.schema("txn_id long").parquet(f"{out}/batch=*")


@query("stream_windows", f"WITH {TX} SELECT t // {DAY} * {DAY} AS day, direction, count(*) AS n, sum(amount)::DECIMAL(28,4) AS total FROM tx GROUP BY 1, 2")
def stream_windows(spark, sf_dir):
    """Counts and sums by day and direction, kept up to date over arrivals: a batch writes what it changes, the newest row of a day speaks.
    State of days goes when the watermark has passed them."""
    x = transactions(spark, sf_dir).select("t", "direction", "amount")
    out = stream.work_dir(spark, "stream-out")

    def days(s):
        by = s.withColumn("at", F.timestamp_micros("t")).withWatermark("at", "1 day").groupBy(F.window("at", "1 day"), "direction")
        return by.agg(F.count("*").alias("n"), F.sum("amount").cast("decimal(28,4)").alias("total")).select(F.unix_micros("window.start").alias("day"), "direction", "n", "total")

    _arrive(x, "t", days, stream.by_batch(out), "update")
    newest = spark.read.schema("day long, direction string, n long, total decimal(28,4), batch long").parquet(out).groupBy("day", "direction").agg(F.max_by(F.struct("n", "total"), "batch").alias("x"))
    return newest.select("day", "direction", "x.n", "x.total")


@query("stream_feature", f"WITH {TX} SELECT txn_id, (SELECT count(*) FROM tx h WHERE h.account_id = p.account_id AND h.t <= p.t AND h.t > p.t - {WEEK}) AS value FROM tx p")
def stream_feature(spark, sf_dir):
    """The incremental feature pass: each arrival's new rows drive it, of history the days of their windows are read."""
    x = transactions(spark, sf_dir).select("txn_id", "t", "account_id")
    out, history, frontiers = (stream.work_dir(spark, f"stream-{k}") for k in ("out", "history", "frontiers"))
    _arrive(x, "t", lambda s: s, stream.driven_counts(out, history, frontiers, "account_id", "7d"))
    return spark.read.parquet(f"{out}/batch=*").select("txn_id", "value")


_TOUCHED = {"transaction": "txn_id", "account": "account_id", "card": "card_id", "device": "device_id", "merchant": "merchant_id"}


@query("stream_affected", f"WITH {TX}, b AS (SELECT *, {_BATCH_OF} AS batch FROM tx) " + " UNION ALL ".join(f"SELECT DISTINCT batch::BIGINT AS batch, '{kind}' AS subject_type, {c}::BIGINT AS subject FROM b WHERE {c} IS NOT NULL" for kind, c in _TOUCHED.items()))
def stream_affected(spark, sf_dir):
    """The subjects that each arrival touches."""
    x = transactions(spark, sf_dir).select("txn_id", "t", "account_id", "card_id", "device_id", "merchant_id")
    out = stream.work_dir(spark, "stream-out")
    _arrive(x, "t", lambda s: s, lambda batch, n: stream.by_batch(out)(stream.affected(batch, _TOUCHED), n))
    return spark.read.schema("subject_type string, subject long, batch long").parquet(out).select("batch", "subject_type", "subject")


@query("stream_routing", _ROUTED + " SELECT id, routing, case_id FROM routed WHERE routing <> 'no_authority'")
def stream_routing(spark, sf_dir):
    """Case routing of decisions and verdicts as they arrive, two streams into one keyed state."""
    x = transactions(spark, sf_dir).select(F.col("txn_id").alias("id"), "t", F.col("account_id").alias("subject"))
    d = decided(spark, sf_dir).filter("source_rule is not null").select("id", "t", F.col("account_id").alias("subject"), F.concat_ws(":", F.lit("account"), F.col("account_id").cast("string"), "rules_authorised").alias("key"), "score")
    v = case_outcomes(spark, sf_dir).select(F.col("alert_id").alias("id"), F.col("decided_at").alias("t")).join(x.select("id", "subject"), "id")
    out = stream.work_dir(spark, "stream-out")
    timed = lambda s: s.withColumn("at", F.timestamp_micros("t")).withWatermark("at", "0 seconds")

    def both(s):
        return stream.route_stream(timed(s["decisions"].withColumn("is_verdict", F.lit(False)).unionByName(s["verdicts"].withColumns({"key": F.lit(None).cast("string"), "score": F.lit(None).cast("long"), "is_verdict": F.lit(True)}))), WEEK)

    stream.arrive([{"decisions": a, "verdicts": b} for a, b in zip(stream.spans(d, "t", CUTS), stream.spans(v, "t", CUTS), strict=True)], both, stream.by_batch(out))
    return spark.read.schema(stream.ROUTED).parquet(f"{out}/batch=*")


def _charges(spark, sf_dir):
    x = transactions(spark, sf_dir)
    return x.select(F.col("txn_id").alias("id"), F.col("account_id").alias("account"), "t", F.floor(F.col("amount") * 100).cast("long").alias("amount"))


INLINE_FEATURES = [("n3", "count", "approved", 3 * DAY), ("s3", "sum", "approved", 3 * DAY), ("d7", "count", "declined", WEEK)]
INLINE_RULES = [("A1", "challenge", 3, True, 40), ("A2", "block", 5, True, 50), ("A3", "alert", 2, False, 20)]
INLINE_CONDITIONS = [("A1", "n3", ">=", 4, 40, True), ("A2", "s3", ">", 12_000, 30, True), ("A2", "d7", ">=", 2, 25, True), ("A3", "amount", ">", 8_000, 20, False), ("A3", "n3", "=", 1, 5, False)]
_HELD = f"[x FOR x IN held IF x.t > o.t - {WEEK}]"
_N3 = "len([x FOR x IN {h} IF x.ok AND x.t > t - %d])" % (3 * DAY)
_S3 = "coalesce(list_sum([x.a FOR x IN {h} IF x.ok AND x.t > t - %d]), 0)::BIGINT" % (3 * DAY)
_D7 = "len([x FOR x IN {h} IF NOT x.ok])"
_AUTHORIZED = f"""WITH RECURSIVE {TX}, o AS MATERIALIZED (SELECT txn_id AS id, account_id AS account, t, floor(amount * 100)::BIGINT AS a, row_number() OVER (PARTITION BY account_id ORDER BY t, txn_id) AS n FROM tx),
 au AS (SELECT account, 0::BIGINT AS n, NULL::BIGINT AS id, NULL::BIGINT AS t, []::STRUCT(t BIGINT, a BIGINT, ok BOOLEAN)[] AS held, 0::BIGINT AS n3, 0::BIGINT AS s3, 0::BIGINT AS d7, '' AS action, NULL::VARCHAR AS source_rule FROM o WHERE n = 1 UNION ALL
 SELECT account, n, id, t, CASE WHEN action IN ('block', 'challenge') THEN list_append(live, {{'t': t, 'a': a, 'ok': FALSE}}) ELSE list_append(live, {{'t': t, 'a': a, 'ok': TRUE}}) END, n3, s3, d7, action, source_rule
 FROM (SELECT *, CASE source_rule WHEN 'A2' THEN 'block' WHEN 'A1' THEN 'challenge' WHEN 'A3' THEN 'alert' ELSE 'allow' END AS action
 FROM (SELECT *, CASE WHEN s3 > 12000 AND d7 >= 2 THEN 'A2' WHEN n3 >= 4 THEN 'A1' WHEN CASE WHEN a > 8000 THEN 20 ELSE 0 END + CASE WHEN n3 = 1 THEN 5 ELSE 0 END >= 20 THEN 'A3' END AS source_rule
 FROM (SELECT account, n, id, t, a, live, ({_N3.format(h='live')} + 1)::BIGINT AS n3, {_S3.format(h='live')} + a AS s3, {_D7.format(h='live')}::BIGINT AS d7 FROM (SELECT o.*, {_HELD} AS live FROM au JOIN o ON o.account = au.account AND o.n = au.n + 1)))))
 SELECT id, account, t, concat('n3=', n3, ';s3=', s3, ';d7=', d7) AS seen, action, source_rule, CASE WHEN action IN ('block', 'challenge') THEN 'declined' ELSE 'approved' END AS authorized, CASE action WHEN 'block' THEN 'risk_block' WHEN 'challenge' THEN 'step_up_required' END AS decline_reason,
 CASE WHEN action IN ('block', 'challenge') THEN concat('n3=', {_N3.format(h='held')}, ';s3=', {_S3.format(h='held')}, ';d7=', {_D7.format(h='held')}) ELSE concat('n3=', n3, ';s3=', s3, ';d7=', d7) END AS after FROM au WHERE n > 0"""


@query("authorize_inline", _AUTHORIZED)
def authorize_inline(spark, sf_dir):
    """Every charge decided as it would be on arrival, with the features it was decided on and those that a decline leaves."""
    return authorize.authorize(_charges(spark, sf_dir), INLINE_FEATURES, INLINE_CONDITIONS, INLINE_RULES)


@query("stream_authorize", _AUTHORIZED)
def stream_authorize(spark, sf_dir):
    """The same over arrivals: an account's charges of the longest window are the state."""
    out = stream.work_dir(spark, "stream-out")
    read = lambda s: authorize.authorize_stream(s.withColumn("at", F.timestamp_micros("t")).withWatermark("at", "0 seconds"), INLINE_FEATURES, INLINE_CONDITIONS, INLINE_RULES)
    _arrive(_charges(spark, sf_dir), "t", read, stream.by_batch(out))
    return spark.read.schema(authorize.DECIDED).parquet(f"{out}/batch=*")


@query("pit_lagged", _PIT.replace("v.as_of <= p.t {ceiling}", f"v.as_of <= p.t + {micros('15m')}").replace("p.t AS bound", f"p.t + {micros('15m')} AS bound").replace("{{", "{").replace("}}", "}") + " SELECT probe_id, as_of, value FROM r")
def pit_lagged(spark, sf_dir):
    """Reads of rules that are evaluated 15 minutes behind the event."""
    values, probes = _store(transactions(spark, sf_dir))
    return pit.as_of(values, probes.withColumn("bound", F.col("bound") + micros("15m"))).select("probe_id", "as_of", "value")
