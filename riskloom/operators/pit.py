"""Point-in-time reads of an append-only bitemporal store (key, as_of, computed_at, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(values: DataFrame, probes: DataFrame, ceiling: int | None = None) -> DataFrame:
    """For each probe (key, probe_id, bound) the value of the newest as_of <= bound, then the newest computed_at; a uniform
    knowledge ceiling drops later computed_at first. One union and one window, no join of a key's values with its probes."""
    if ceiling is not None:
        values = values.filter(F.col("computed_at") <= ceiling)
    newest = values.groupBy("key", "as_of").agg(F.max_by("value", "computed_at").alias("value"), F.max("computed_at").alias("computed_at"))
    v = newest.select("key", F.col("as_of").alias("at"), F.lit(0).alias("side"), F.struct("as_of", "computed_at", "value").alias("x"), F.lit(None).cast("long").alias("probe_id"))
    p = probes.select("key", F.col("bound").alias("at"), F.lit(1).alias("side"), F.lit(None).cast(v.schema["x"].dataType).alias("x"), F.col("probe_id").cast("long"))
    w = Window.partitionBy("key").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    return v.unionByName(p).withColumn("x", F.last("x", True).over(w)).filter("side = 1").select("key", "probe_id", F.col("at").alias("bound"), "x.as_of", "x.computed_at", "x.value")


def status(read: DataFrame, max_staleness: int) -> DataFrame:
    stale = F.col("bound") - F.col("as_of") > max_staleness
    return read.withColumn("status", F.when(F.col("value").isNull(), "absent").when(stale, "stale").otherwise("present"))


def read_entities(values: DataFrame, requests: DataFrame, specs: DataFrame) -> DataFrame:
    """Reads of features over the entities that a subject reaches, each reduced to one value with its evidence.

    values: feature, key, as_of, computed_at, value. requests: request_id (one for a subject and feature), feature, bound, resolution ('ok'
    or not), reason, entity_ids. specs: feature, policy, max_staleness (configuration of a few rows). Result: request_id, feature, status,
    value, value_as_of (the oldest that went in), value_computed_at (the newest), entity_ids (in order), reason.

    Status, in this order: not resolved: `fanout_error` where the reason says so, else `unresolvable`; no entity has a value by the bound:
    `absent`; bound less the oldest as_of over max_staleness: `stale`, since a reduction mustn't hide an old member; a null among the values:
    `absent`; no reduction (`one` or `error` over several, or an unknown policy): `fanout_error`; else `present`.

    An entity named twice counts once; a null entity has no value; a request without entities that is resolved is absent. Every entity is
    read on its own and only then reduced, by aggregates that combine on the map side, so a subject with many entities isn't gathered."""
    resolved = F.col("resolution") == "ok"
    asked = requests.filter(resolved).select("request_id", "feature", "bound", F.explode(F.array_distinct("entity_ids")).alias("entity"))
    probes = asked.select(F.struct("feature", F.col("entity").alias("key")).alias("key"), F.col("request_id").alias("probe_id"), "bound")
    read = as_of(values.select(F.struct("feature", "key").alias("key"), "as_of", "computed_at", "value"), probes)
    found = F.col("as_of").isNotNull()
    v, many = F.col("value"), F.count_if(found)
    by = read.groupBy(F.col("probe_id").alias("request_id")).agg(
        many.alias("n"), F.min("as_of").alias("oldest"), F.max("computed_at").alias("newest"), F.count_if(found & v.isNull()).alias("nulls"), F.max(v).alias("v_max"), F.min(v).alias("v_min"),
        F.sum(v).alias("v_sum"), F.avg(v).alias("v_mean"), F.bool_or(v != 0).alias("v_any"), F.bool_and(v != 0).alias("v_all"), F.count_distinct(v).alias("v_distinct"),
    )
    x = requests.join(F.broadcast(specs), "feature").join(by, "request_id", "left")
    p = F.col("policy")
    single = F.when(p.isin("one", "error") & (F.col("n") == 1), F.col("v_max"))
    reduced = F.coalesce(single, *(F.when(p == name, F.col(c).cast("double")) for name, c in (("max", "v_max"), ("min", "v_min"), ("sum", "v_sum"), ("mean", "v_mean"), ("any_true", "v_any"), ("all_true", "v_all"), ("count_distinct", "v_distinct"))))
    late = F.col("bound") - F.col("oldest") - F.col("max_staleness")
    none = F.coalesce("n", F.lit(0)) == 0
    states = [
        (~resolved & F.col("reason").startswith("fanout"), "fanout_error", F.col("reason")), (~resolved, "unresolvable", F.coalesce("reason", F.lit("unresolvable"))), (none, "absent", F.lit("no_value_at_bound")),
        (late > 0, "stale", F.concat(F.lit("stale_by:"), late.cast("string"))), (F.col("nulls") > 0, "absent", F.lit("null_value")), (reduced.isNull(), "fanout_error", F.concat(F.lit("no_reduction:"), p)),
    ]
    said = F.coalesce(*(F.when(when, F.struct(F.lit(name).alias("status"), why.alias("reason"))) for when, name, why in states), F.struct(F.lit("present").alias("status"), F.lit(None).cast("string").alias("reason")))
    x = x.withColumn("said", said)
    present = F.col("said.status") == "present"
    return x.select("request_id", "feature", F.col("said.status").alias("status"), F.when(present, reduced).alias("value"), F.when(resolved, F.col("oldest")).alias("value_as_of"), F.when(present, F.col("newest")).alias("value_computed_at"), F.array_sort(F.array_distinct("entity_ids")).alias("entity_ids"), F.col("said.reason").alias("reason"))
