"""The ingest door: defaults, all reasons against a row, duplicates within a batch and with stored rows, receipt."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULTS = {"currency": "USD", "direction": "debit", "txn_type": "purchase", "auth_result": "approved"}


def with_defaults(rows: DataFrame) -> DataFrame:
    """Absent values of a transaction: fixed ones, the instant of the event as its as_of, the amount as its base amount."""
    out = rows.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in DEFAULTS.items()})
    return out.withColumns({"as_of": F.coalesce("as_of", "occurred_at"), "amount_base": F.coalesce("amount_base", "amount")})


def known(rows: DataFrame, dimension: DataFrame, on: dict[str, str], name: str) -> DataFrame:
    """rows with a column `name`: whether the dimension has the row's key; on: row's column to dimension's column. A null key passes."""
    d = dimension.select(*[F.col(b).alias(f"__{b}") for b in on.values()]).distinct().withColumn("__known", F.lit(True))
    match = reduce(lambda a, b: a & b, [F.col(a) == F.col(f"__{b}") for a, b in on.items()])
    null = reduce(lambda a, b: a | b, [F.col(a).isNull() for a in on])
    return rows.join(d, match, "left").withColumn(name, null | F.coalesce("__known", F.lit(False))).drop("__known", *[f"__{b}" for b in on.values()])


def reasons(required: list[str], forbidden: list[str], vocabularies: dict[str, list], references: dict[str, str]) -> Column:
    """All that speaks against a row, in this order; references: a flag of `known` to what it is called."""
    said = [F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in required] + [F.when(F.col(c).isNotNull(), F.lit(f"forbidden {c}")) for c in forbidden]
    said += [F.when(~F.col(c).isin(words), F.concat(F.lit(f"unknown {c} "), F.col(c))) for c, words in vocabularies.items()]
    return F.array_compact(F.array(*said, *[F.when(~F.col(flag), F.lit(f"unknown {what}")) for flag, what in references.items()]))


def first_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The earliest row of each key; nulls in a key are equal. A map-side combined minimum, not a window: a hot key isn't gathered."""
    names = rows.columns
    x = rows.groupBy(*keys).agg(F.min_by(F.struct(*names), order).alias("x"))
    return x.select("x.*")


def unseen(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key no stored row has; nulls in a key are equal."""
    s = stored.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    return rows.join(s, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]), "left_anti")


def receipt(tagged: DataFrame, registered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (index, reasons, fate, occurred_at), fate written, duplicate or rejected, and the devices registered: one row of counts, and
    a row (index, reasons) for every rejected one. The second is a table of its own: it grows with the batch."""
    n = lambda fate: F.count_if(F.col("fate") == fate)
    x = tagged.agg(F.count("*").alias("submitted"), n("written").alias("written"), n("duplicate").alias("duplicates"), n("rejected").alias("rejected"), F.max(F.when(F.col("fate") == "written", F.col("occurred_at"))).alias("newest"))
    x = x.crossJoin(registered.agg(F.count("*").alias("devices_registered")))  # one row each
    return x, tagged.filter("fate = 'rejected'").select("index", "reasons")
