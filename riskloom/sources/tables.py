"""The engine's relations over the given tables: transactions, devices, entity links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as transactions; t is event time in microseconds."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    place = k % 13 != 0
    return e.select(
        F.col("event_id").alias("txn_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("t"),
        F.col("value").cast("decimal(18,4)").alias("amount"),
        F.col("user_id").alias("account_id"),
        (F.col("user_id") * 2 + k % 2).alias("card_id"),
        k.alias("device_id"),
        (k % 20).alias("merchant_id"),
        F.when(k % 17 != 0, k % 10).alias("mcc"),
        F.when(kind == "signup", "inbound").when(kind == "purchase", "outbound").otherwise("debit").alias("direction"),
        F.when(kind == "click", "cnp").when(kind == "view", "pos").otherwise("online").alias("channel"),
        F.when(kind == "error", "declined").otherwise("approved").alias("auth_result"),
        F.when(kind.isin("signup", "purchase"), "transfer").otherwise("purchase").alias("txn_type"),
        F.when(place, (k % 7 * 5).cast("double")).alias("lat"),
        F.when(place, (k % 11 * 7).cast("double")).alias("lon"),
        F.when((kind == "error") & (k < 10), "fraud").otherwise("legit").alias("label"),
    )


def entity_links(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """Devices (suppliers) that opened accounts (customers), with the first time seen, once for each pair. of: the devices (device_id) asked
    for, whose links are then whole."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_suppkey", "l_shipdate")
    if of is not None:
        line = line.join(of, line.l_suppkey == of.device_id, "left_semi")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    return line.join(orders, line.l_orderkey == orders.o_orderkey).groupBy(F.col("l_suppkey").alias("device_id"), F.col("o_custkey").alias("account_id")).agg(F.min("l_shipdate").cast("date").alias("first_seen"))


def case_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as dispositions of cases: outcome_id, alert_id, disposition, source, decided_at; up to two for a case."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    t = transactions(spark, sf_dir).select(F.col("txn_id").alias("alert_id"), "t")
    status = F.col("o_orderstatus")
    kind = F.when(status == "F", "confirmed_fraud").when(status == "O", "false_positive").when(F.col("o_orderpriority") == "1-URGENT", "confirmed_legit").otherwise("inconclusive")
    o = o.select(F.col("o_orderkey").alias("outcome_id"), F.floor(F.col("o_orderkey") / 2).alias("alert_id"), kind.alias("disposition"), F.when(F.col("o_orderkey") % 3 == 0, "analyst").otherwise("synthetic").alias("source"), (30 + F.col("o_custkey") % 2880).alias("minutes"))
    return o.join(t, "alert_id").select("outcome_id", "alert_id", "disposition", "source", (F.col("t") + F.col("minutes") * 60_000_000).alias("decided_at"))


def action_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third order as the customer's answer to a challenge: subject, outcome, seconds."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderkey % 3 = 0 and o_orderkey % 4 <> 3")
    outcome = F.element_at(F.array(F.lit("passed"), F.lit("failed"), F.lit("abandoned")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return o.select(F.floor(F.col("o_orderkey") / 3).alias("subject"), outcome.alias("outcome"), (F.col("o_custkey") % 600).alias("seconds"))


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rows submitted at the ingest door, with gaps, unknown references, forbidden columns and repeated ids."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k, i, kind = F.get_json_object("props", "$.k").cast("int"), F.col("event_id"), F.col("event_type")
    x = e.select(
        i.alias("index"), (i - F.when(i % 50 == 49, 1).otherwise(0)).alias("txn_id"), F.when(k % 23 != 0, F.col("value").cast("decimal(18,4)")).alias("amount"), F.when(k % 29 != 0, F.unix_micros(F.col("ts").cast("timestamp"))).alias("occurred_at"),
        F.when(k % 7 == 0, F.unix_micros(F.col("ts").cast("timestamp")) - 1).alias("as_of"), F.when(k % 6 == 0, F.col("value").cast("decimal(18,4)") * 2).alias("amount_base"), F.when(k % 3 == 0, "EUR").alias("currency"),
        F.when(kind == "signup", "inbound").when(kind == "purchase", "outbound").alias("direction"), F.when(kind == "purchase", "transfer").alias("txn_type"), F.when(kind == "error", "declined").alias("auth_result"),
        (F.col("user_id") + F.when(k % 19 == 0, 1_000_000).otherwise(0)).alias("customer_id"), F.when(k % 11 != 0, k.cast("long")).alias("device_id"), F.when(kind == "click", "cnp").when(kind == "view", "pos").when(kind == "error", "carrier pigeon").otherwise("online").alias("channel"),
        F.element_at(F.array(F.lit("customer"), F.lit("supplier"), F.lit("part")), (k % 3 + 1).cast("int")).alias("subject_type"), (i % 150).alias("subject_id"), F.when(k % 31 == 0, "fraud").alias("synthetic_label"),
    )
    return x
