"""Ingest at the door: checks, duplicates, device registration, receipt."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ingest
from ..sources.tables import arrivals
from .queries import query

CHANNELS = ["cnp", "pos", "online"]
TYPES = {"customer": ("customer", "c_custkey"), "supplier": ("supplier", "s_suppkey"), "part": ("part", "p_partkey")}

BATCH = """WITH ar AS (SELECT event_id AS index, event_id - CASE WHEN event_id % 50 = 49 THEN 1 ELSE 0 END AS txn_id, CASE WHEN k % 23 <> 0 THEN CAST(value AS DECIMAL(18,4)) END AS amount, CASE WHEN k % 29 <> 0 THEN epoch_us(ts) END AS occurred_at, CASE WHEN k % 7 = 0 THEN epoch_us(ts) - 1 END AS as_of, CASE WHEN k % 6 = 0 THEN CAST(value AS DECIMAL(18,4)) * 2 END AS amount_base, CASE WHEN k % 3 = 0 THEN 'EUR' END AS currency,
 CASE event_type WHEN 'signup' THEN 'inbound' WHEN 'purchase' THEN 'outbound' END AS direction, CASE WHEN event_type = 'purchase' THEN 'transfer' END AS txn_type, CASE WHEN event_type = 'error' THEN 'declined' END AS auth_result, user_id + CASE WHEN k % 19 = 0 THEN 1000000 ELSE 0 END AS customer_id, CASE WHEN k % 11 <> 0 THEN CAST(k AS BIGINT) END AS device_id,
 CASE event_type WHEN 'click' THEN 'cnp' WHEN 'view' THEN 'pos' WHEN 'error' THEN 'carrier pigeon' ELSE 'online' END AS channel, ['customer', 'supplier', 'part'][k % 3 + 1] AS subject_type, event_id % 150 AS subject_id, CASE WHEN k % 31 = 0 THEN 'fraud' END AS synthetic_label
 FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)),
 ck AS MATERIALIZED (SELECT ar.*, concat_ws(';', CASE WHEN amount IS NULL THEN 'missing amount' END, CASE WHEN occurred_at IS NULL THEN 'missing occurred_at' END, CASE WHEN synthetic_label IS NOT NULL THEN 'forbidden synthetic_label' END, CASE WHEN channel NOT IN ('cnp', 'pos', 'online') THEN concat('unknown channel ', channel) END,
 CASE WHEN customer_id IS NOT NULL AND customer_id NOT IN (SELECT c_custkey FROM customer) THEN 'unknown customer' END,
 CASE WHEN CASE subject_type WHEN 'customer' THEN subject_id NOT IN (SELECT c_custkey FROM customer) WHEN 'supplier' THEN subject_id NOT IN (SELECT s_suppkey FROM supplier) WHEN 'part' THEN subject_id NOT IN (SELECT p_partkey FROM part) END THEN 'unknown subject' END) AS reasons FROM ar),
 fa AS MATERIALIZED (SELECT *, CASE WHEN reasons <> '' THEN 'rejected' WHEN txn_id IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 97 = 0) OR index > min(index) FILTER (reasons = '') OVER (PARTITION BY txn_id) THEN 'duplicate' ELSE 'written' END AS fate FROM ck)"""


def _checked(spark, sf_dir) -> DataFrame:
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    subjects = reduce(DataFrame.unionByName, [table(t).select(F.lit(kind).alias("type"), F.col(key).cast("long").alias("id")) for kind, (t, key) in TYPES.items()])
    x = ingest.known(arrivals(spark, sf_dir), table("customer"), {"customer_id": "c_custkey"}, "customer_known")
    x = ingest.known(x, subjects, {"subject_type": "type", "subject_id": "id"}, "subject_known")
    why = ingest.reasons(["amount", "occurred_at"], ["synthetic_label"], {"channel": CHANNELS}, {"customer_known": "customer", "subject_known": "subject"})
    return x.withColumn("reasons", why).drop("customer_known", "subject_known")


def _stored(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderkey % 97 = 0").select(F.col("o_orderkey").alias("txn_id"))


def _tagged(spark, sf_dir) -> DataFrame:
    x = _checked(spark, sf_dir)
    fine = x.filter(F.size("reasons") == 0)
    written = ingest.unseen(ingest.first_of(fine, ["txn_id"], "index"), _stored(spark, sf_dir), ["txn_id"]).select("index", F.lit("written").alias("fate"))
    fate = F.when(F.size("reasons") > 0, "rejected").otherwise(F.coalesce("fate", F.lit("duplicate")))
    return x.join(written, "index", "left").withColumn("fate", fate)


@query("ingest_defaults", BATCH + " SELECT index, coalesce(currency, 'USD') AS currency, coalesce(direction, 'debit') AS direction, coalesce(txn_type, 'purchase') AS txn_type, coalesce(auth_result, 'approved') AS auth_result, coalesce(as_of, occurred_at) AS as_of, CAST(coalesce(amount_base, amount) AS DOUBLE) AS amount_base FROM ar")
def ingest_defaults(spark, sf_dir):
    return ingest.with_defaults(arrivals(spark, sf_dir)).select("index", "currency", "direction", "txn_type", "auth_result", "as_of", F.col("amount_base").cast("double").alias("amount_base"))


@query("ingest_checked", BATCH + " SELECT index, reasons FROM ck WHERE reasons <> ''")
def ingest_checked(spark, sf_dir):
    """All reasons against each rejected row; the rest of the batch goes on."""
    return _checked(spark, sf_dir).filter(F.size("reasons") > 0).select("index", F.array_join("reasons", ";").alias("reasons"))


@query("ingest_accepted", BATCH + " SELECT index, txn_id, CAST(coalesce(amount_base, amount) AS DOUBLE) AS amount_base, 'ingested' AS source FROM fa WHERE fate = 'written'")
def ingest_accepted(spark, sf_dir):
    """What is written: accepted rows, the earliest of each id, none that is stored already, with their provenance."""
    fine = _checked(spark, sf_dir).filter(F.size("reasons") == 0)
    x = ingest.with_defaults(ingest.unseen(ingest.first_of(fine, ["txn_id"], "index"), _stored(spark, sf_dir), ["txn_id"]))
    return x.select("index", "txn_id", F.col("amount_base").cast("double").alias("amount_base"), F.lit("ingested").alias("source"))


@query("ingest_links", BATCH + " SELECT min(index) AS index, customer_id, device_id, currency, direction, channel FROM ar GROUP BY customer_id, device_id, currency, direction, channel HAVING NOT (coalesce(device_id, 5) = 5 AND customer_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0))")
def ingest_links(spark, sf_dir):
    """Links by a natural key of five columns in which nulls are equal, without those of even customers and device 5 or none, stored before."""
    keys = ["customer_id", "device_id", "currency", "direction", "channel"]
    x = ingest.first_of(arrivals(spark, sf_dir).select("index", *keys), keys, "index")
    pairs = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("customer_id"), F.explode(F.array(F.lit(5).cast("long"), F.lit(None).cast("long"))).alias("device_id"))
    return ingest.unseen(x, pairs, ["customer_id", "device_id"]).select("index", *keys)


@query("ingest_devices", BATCH + " SELECT device_id, arg_min(occurred_at, index) AS first_seen FROM fa WHERE fate = 'written' AND device_id IS NOT NULL AND device_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 1) GROUP BY 1")
def ingest_devices(spark, sf_dir):
    """Devices that the batch shows first: seen first at the event time of the first written row in batch order."""
    stored = spark.read.parquet(f"{sf_dir}/supplier.parquet").filter("s_suppkey % 2 = 1").select(F.col("s_suppkey").cast("long").alias("device_id"))
    x = _tagged(spark, sf_dir).filter("fate = 'written' and device_id is not null").groupBy("device_id").agg(F.min_by("occurred_at", "index").alias("first_seen"))
    return ingest.unseen(x, stored, ["device_id"])


_REGISTERED = "SELECT DISTINCT device_id FROM fa WHERE fate = 'written' AND device_id IS NOT NULL AND device_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 1)"


@query("ingest_receipt", BATCH + f" SELECT count(*) AS submitted, count(*) FILTER (fate = 'written') AS written, count(*) FILTER (fate = 'duplicate') AS duplicates, count(*) FILTER (fate = 'rejected') AS rejected, max(occurred_at) FILTER (fate = 'written') AS newest, (SELECT count(*) FROM ({_REGISTERED})) AS devices_registered FROM fa")
def ingest_receipt(spark, sf_dir):
    """The counts of the batch's receipt."""
    return ingest.receipt(_tagged(spark, sf_dir), ingest_devices(spark, sf_dir))[0]


@query("ingest_rejected", BATCH + " SELECT index, reasons FROM fa WHERE fate = 'rejected'")
def ingest_rejected(spark, sf_dir):
    """The receipt's second part: every rejected row with all that speaks against it."""
    return ingest.receipt(_tagged(spark, sf_dir), ingest_devices(spark, sf_dir))[1].select("index", F.array_join("reasons", ";").alias("reasons"))
