"""Case routing, issued actions and priority."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def step(cases: list[list], open_window: int, i, key, t, score, closes_at=None) -> tuple[list[list], str, object]:
    """One decision against a subject's cases [key, first, score, id, closes_at], the newest last: the cases after it, routing, case_id."""
    if key is None or t is None:
        return cases, "raised", i
    cases = [c for c in cases if t - c[1] <= open_window]
    hit = next((c for c in reversed(cases) if c[0] == key), None)
    if hit is not None:
        routing = "restated" if score is not None and hit[2] is not None and score > hit[2] else "folded"
        hit[2] = max((x for x in (hit[2], score) if x is not None), default=None)
        return cases, routing, hit[3]
    blocks = next((c for c in reversed(cases) if c[4] is None or c[4] > t), None)
    if blocks is not None:
        return cases, "suppressed", blocks[3]
    return [*cases, [key, t, score, i, closes_at]], "raised", i


def route(decisions: DataFrame, open_window: int) -> DataFrame:
    """(subject, id, key, t, score, authorised) to (id, routing, case_id): raised, restated, folded, suppressed or no_authority. case_id is
    the decision that raised the case: the own one, the one restated or folded into, or the one that suppresses. A column closes_at, if
    there is one, says when the case that a decision raises gets its first verdict, if it raises one.

    Decisions of a subject are folded in order (t, id): an open case of the same key with |t - first| <= window is restated if the score is
    higher and else folded; another case of the subject in the window suppresses unless it has a verdict by then; the newest match wins.

    A gap longer than the window parts a subject's decisions into sessions: a case is at least as old as the decision before the gap. The
    decisions of a session are read in order as a stream; only the cases of the window are held. Null subjects are one subject; a decision with a null key or time meets no case.
    """
    none = decisions.filter("not authorised").select("id", F.lit("no_authority").alias("routing"), F.lit(None).cast(decisions.schema["id"].dataType).alias("case_id"))
    mine = Window.partitionBy("subject").orderBy("t", "id")
    cut = F.coalesce((F.col("t") - F.lag("t").over(mine) > open_window).cast("int"), F.lit(0))
    closes = F.col("closes_at").cast("long") if "closes_at" in decisions.columns else F.lit(None).cast("long")
    parted = decisions.filter("authorised").select("subject", "id", "key", F.col("t").cast("long").alias("t"), F.col("score").cast("long").alias("score"), closes.alias("closes_at")).withColumn("cut", cut)
    parted = parted.withColumn("session", F.sum("cut").over(mine))
    rows = parted.repartition("subject", "session").sortWithinPartitions("subject", "session", "t", "id")
    kind = decisions.schema["id"].dataType

    def run(batches):
        at, cases = None, []
        for b in batches:
            out, of = [], []
            for subject, session, i, key, t, score, closes_at in zip(*(b.column(c).to_pylist() for c in ("subject", "session", "id", "key", "t", "score", "closes_at")), strict=True):
                if at != (subject, session):
                    at, cases = (subject, session), []
                cases, routing, case = step(cases, open_window, i, key, t, score, closes_at)
                out.append(routing)
                of.append(case)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.string()), pa.array(of, b.column("id").type)], ["id", "routing", "case_id"])

    routed = rows.select("subject", "session", "id", "key", "t", "score", "closes_at").mapInArrow(run, StructType([StructField("id", kind), StructField("routing", StringType()), StructField("case_id", kind)]))
    return routed.unionByName(none)


def fold(routed: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row for each case: (case_id, decision_id, first_event_at, last_event_at, triggering_events, score, ...).

    decisions: id, t, score and further columns. First, last and number count the decisions raised, restated or folded into the case;
    what the case says (decision_id, score, further columns) is that of its last restating decision, or else of the raising one."""
    more = [c for c in decisions.columns if c not in ("id", "t")]
    mine = routed.filter(F.col("routing").isin("raised", "restated", "folded")).join(decisions, "id")
    says = F.max(F.when(F.col("routing") != "folded", F.struct("t", "id", *more))).alias("says")
    out = mine.groupBy("case_id").agg(F.min("t").alias("first_event_at"), F.max("t").alias("last_event_at"), F.count("*").alias("triggering_events"), says)
    return out.select("case_id", F.col("says.id").alias("decision_id"), "first_event_at", "last_event_at", "triggering_events", *[f"says.{c}" for c in more])


def issue(routed: DataFrame, channels: DataFrame, preventive: list[str]) -> DataFrame:
    """(subject, action, band, routing) to (subject, action, channel): a preventive action is issued when a case is raised, a notice when
    it is raised or restated. An action and band without a channel is an error, never a default."""
    act = F.when((F.col("routing") == "raised") & F.col("action").isin(preventive), F.col("action"))
    issued = routed.filter(F.col("routing").isin("raised", "restated")).select("subject", "band", F.explode(F.array_compact(F.array(act, F.lit("notify")))).alias("action"))
    met = issued.join(F.broadcast(channels), ["action", "band"], "left")
    lost = F.raise_error(F.format_string("no channel for action %s, band %s", "action", "band")).cast("string")
    return met.select("subject", "action", F.when(F.col("channel").isNull(), lost).otherwise(F.col("channel")).alias("channel"))


def priority(score, exposure, age_hours, weight: float = 0.5, floor: float = 10.0, half_life: float = 48.0):
    """score x exposure factor x recency factor; the factors are rounded half-even, to 3, 3 and 6 places, before they are multiplied."""
    size = F.bround(1 + weight * F.log10(1 + F.greatest(exposure, F.lit(floor))), 3)
    recent = F.bround(F.pow(F.lit(0.5), F.greatest(age_hours, F.lit(0.0)) / half_life), 6)
    return F.bround(F.bround(score, 3) * size * recent, 3)
