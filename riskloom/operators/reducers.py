"""The named reducers, as window expressions over rows (scope, t, ...). Features of one scope share its shuffle and sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import micros, trailing

TRUE = F.lit
EARTH_KM = 6371.0


def _when(keep: Column, value) -> Column:
    return F.when(keep, value if isinstance(value, Column) else F.lit(value))


def _ratio(a: Column, b: Column) -> Column:
    return a / F.when(b != 0, b)


def count(keep, w, exclude_self: bool = False):
    """exclude_self: without the row itself; of rows at its instant the others count."""
    n = F.count(_when(keep, 1))
    upto, gone = getattr(w, "grown", (w, None))
    out = n.over(upto) if gone is None else n.over(upto) - n.over(gone)
    return out - F.when(F.coalesce(keep, F.lit(False)), 1).otherwise(0) if exclude_self else out


def total(keep, value, w, exclude_self: bool = False):
    """The sum of a decimal column; null over no rows. Decimals add up exactly, so a difference of running sums is the window's sum, and that
    less the row's own part the sum of the others."""
    x = _when(keep, F.col(value))
    upto, gone = getattr(w, "grown", (w, None))
    if exclude_self:
        others = F.count(x).over(upto) - (F.lit(0) if gone is None else F.count(x).over(gone)) - x.isNotNull().cast("int")
        return F.when(others > 0, (total(keep, value, w) - F.coalesce(x, F.lit(0))).cast("decimal(28,4)"))
    if gone is None:
        return F.sum(x).over(upto)
    return F.when(F.count(x).over(upto) > F.count(x).over(gone), (F.sum(x).over(upto) - F.coalesce(F.sum(x).over(gone), F.lit(0))).cast("decimal(28,4)"))


def distinct_count(keep, value, w):
    return F.size(F.collect_set(_when(keep, F.col(value))).over(w)).cast("long")


def bool_exists(keep, w):
    return count(keep, w) > 0


def bool_not_exists(keep, w):
    return count(keep, w) == 0


def zscore(keep, value, w):
    x = _when(keep, F.col(value).cast("double"))
    return _ratio(F.max(x).over(w) - F.avg(x).over(w), F.stddev_samp(x).over(w))


def rate_ratio(keep, scope, window, baseline):
    a, b = micros(window) / 1e6, micros(baseline) / 1e6
    return _ratio(count(keep, trailing(scope, window)) / a, count(keep, trailing(scope, baseline)) / b)


def out_over_in(value, w):
    """Sums are of decimals, so their order doesn't matter; the two totals are divided as doubles."""
    side = lambda d: F.sum(F.when(F.col("direction") == d, F.col(value))).over(w).cast("double")
    return _ratio(F.coalesce(side("outbound"), F.when(side("inbound").isNotNull(), 0.0)), side("inbound"))


def zscore_of_self(value, w):
    """|x - mean| / sd of the scope's other rows: sums minus the row's own part."""
    x = F.col(value).cast("double")
    n, s, q = F.count(x).over(w) - F.when(x.isNull(), 0).otherwise(1), F.sum(x).over(w) - x, F.sum(x * x).over(w) - x * x
    variance = F.when(n > 1, F.greatest(F.lit(0.0), (q - s * s / n) / (n - 1)))
    return _ratio(F.abs(x - s / n), F.sqrt(F.when(variance > 1e-9, variance)))


def in_reference_set(value: str, members: list) -> Column:
    return F.col(value).isin(members)


def eq_const(value: str, constant) -> Column:
    return F.col(value) == constant


def min_gap(rows: DataFrame, scope: str) -> DataFrame:
    """Least minutes from an inbound row to the first outbound one at or after it, up to each row."""
    w = trailing(scope)
    last_in = F.max(F.when(F.col("direction") == "inbound", F.col("t"))).over(w)
    gap = rows.withColumn("gap", F.when(F.col("direction") == "outbound", (F.col("t") - last_in) / 6e7))
    return gap.withColumn("value", F.min("gap").over(w)).drop("gap")


def age_minutes_latest(rows: DataFrame, scope: str, keep: Column) -> DataFrame:
    w = trailing(scope)
    return rows.withColumn("value", (F.col("t") - F.max(F.when(keep, F.col("t"))).over(w)) / 6e7)


def age_minutes(rows: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Minutes since the dimension row's t0, where that is not later."""
    return rows.join(dim, key, "left").withColumn("value", F.when(F.col("t0") <= F.col("t"), (F.col("t") - F.col("t0")) / 6e7))


def haversine(lat1, lon1, lat2, lon2):
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def geo_jump(rows: DataFrame, scope: str) -> DataFrame:
    """Distance from the newest place to the latest different one; islands of equal places."""
    o = Window.partitionBy(scope).orderBy("t", "lat", "lon")
    here = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.struct("lat", "lon"))
    r = rows.withColumn("here", here)
    r = r.withColumn("now", F.last("here", True).over(o.rowsBetween(Window.unboundedPreceding, 0))).withColumn("was", F.last("here", True).over(o.rowsBetween(Window.unboundedPreceding, -1)))
    changed = F.col("was").isNotNull() & ~F.col("was").eqNullSafe(F.col("now"))
    r = r.withColumn("before", F.last(F.when(changed, F.col("was")), True).over(o.rowsBetween(Window.unboundedPreceding, 0)))
    return r.withColumn("value", haversine(F.col("before.lat"), F.col("before.lon"), F.col("now.lat"), F.col("now.lon"))).drop("here", "now", "was", "before")


def pct_of_running_balance(rows: DataFrame, scope: str, window: str) -> DataFrame:
    """The latest outbound amount against the balance standing strictly before it, inside the window; approved rows only.

    Running balances of decimals are exact, so the balance is the one before the latest outbound row less the one at the window's start; the
    latest outbound row of all history is that of the window, if it lies inside. All frames only grow, one sort serves them."""
    w = micros(window)
    mine = Window.partitionBy(scope).orderBy("t")
    upto = lambda last: mine.rangeBetween(Window.unboundedPreceding, last)
    fine, out = F.col("auth_result") == "approved", F.col("direction") == "outbound"
    signed = F.when(fine, F.when(F.col("direction") == "inbound", F.col("amount")).otherwise(-F.col("amount")))
    stood = lambda last: F.coalesce(F.sum(signed).over(upto(last)), F.lit(0))
    r = rows.withColumns({"__before": stood(-1), "__gone": stood(-w)})
    r = r.withColumn("__last", F.max(F.when(fine & out, F.struct("t", "txn_id", F.col("amount").cast("double").alias("x"), "__before"))).over(upto(0)))
    value = F.when(F.col("__last.t") > F.col("t") - w, _ratio(100 * F.col("__last.x"), (F.col("__last.__before") - F.col("__gone")).cast("double")))
    return r.withColumn("value", value).drop("__before", "__gone", "__last")


def cluster_density(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges among a cluster's members over n(n-1)/2; 0 below two members."""
    n = members.groupBy("cluster").agg(F.count("*").alias("n"))
    a, b = members.select("cluster", F.col("member").alias("from_id")), members.select("cluster", F.col("member").alias("to_id"))
    inside = edges.join(a, "from_id").join(b, ["cluster", "to_id"]).groupBy("cluster").agg(F.count("*").alias("e"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return n.join(inside, "cluster", "left").select("cluster", F.when(F.col("n") < 2, 0.0).otherwise(F.coalesce("e", F.lit(0)) / pairs).alias("value"))


def fan_out(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The reductions of a feature over the entities that a subject reaches."""
    v = F.col(value)
    yes = v > 50
    return rows.groupBy(key).agg(
        F.max(v).alias("v_max"), F.min(v).alias("v_min"), F.sum(v).alias("v_sum"), F.round(F.avg(v.cast("double")), 6).alias("v_mean"), F.bool_or(yes).alias("any_true"), F.bool_and(yes).alias("all_true"),
        F.count_distinct(v).alias("n_distinct"), F.when(F.count("*") == 1, F.max(v)).alias("v_one"), (F.count("*") > 1).alias("is_error"),
    )


def part_of(text, separator: str, n: int):
    """The n-th part of a text cut at a separator, from 1; empty where there are fewer, null for a null text. The network part of an address
    with a prefix length is part_of(ip, "/", 1)."""
    return F.split_part(text, F.lit(separator), F.lit(n))
