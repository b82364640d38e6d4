"""Inline authorization: each charge is decided on features that it takes part in itself, and a decline changes those of later charges.

A charge is presumed approved while it is scored. Rules over counts and sums of the account's charges give an action; a preventive one
declines the charge with a reason, and from then on it counts as declined. So an account's charges are decided in order of (t, id), and a
charge's result depends on all results of the longest window before it.

features: (name, 'count' or 'sum', 'approved' or 'declined', window in microseconds), over (t - window, t].
conditions: (rule_id, feature, op, operand, points, required); `amount` is a feature as well. rules: (rule_id, action, severity,
preventive, review). A rule is satisfied if all its required conditions fire, or any if none is required; it is authorised if satisfied
with at least `review` points; the highest severity wins, ties go to the smallest rule_id.

Edges: a null amount counts as a charge of nothing; a null account is one account; a charge with a null time is approved without a look
and changes nothing; charges with equal ids and times are each decided. An empty table gives none.
"""

from __future__ import annotations

import operator
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Why a charge is declined, by the action that declines it.
DECLINE_REASONS = {"challenge": "step_up_required", "hold": "risk_hold_pending_review", "block": "risk_block"}
OPS = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "=": operator.eq}
DECIDED = "id long, account long, t long, seen string, action string, source_rule string, authorized string, decline_reason string, after string"


class Desk:
    """The rules, and the charges of one account that are still inside the longest window."""

    def __init__(self, features, conditions, rules):
        self.features, self.conditions, self.rules = features, conditions, {r[0]: r for r in rules}
        self.longest = max((f[3] for f in features), default=0)
        self.held: list[list] = []  # [t, amount, approved], in order

    def values(self, t: int) -> dict[str, float]:
        out = {}
        for name, kind, standing, window in self.features:
            mine = [a for u, a, ok in self.held if u > t - window and ok == (standing == "approved")]
            out[name] = len(mine) if kind == "count" else sum(mine)
        return out

    def action(self, values: dict[str, float]) -> tuple[str, str | None, bool]:
        best = None
        for rule_id, action, severity, preventive, review in self.rules.values():
            hits = [(OPS[op](values[f], x), points, required) for r, f, op, x, points, required in self.conditions if r == rule_id]
            needed = [hit for hit, _, required in hits if required]
            fine = all(needed) if needed else any(hit for hit, *_ in hits)
            if fine and sum(p for hit, p, _ in hits if hit) >= review and (best is None or (-severity, rule_id) < best[:2]):
                best = (-severity, rule_id, action, preventive)
        return (best[2], best[1], best[3]) if best else ("allow", None, False)

    def decide(self, t: int | None, amount: int | None) -> tuple:
        """(seen, action, source_rule, authorized, decline_reason, after): features as they were when it was decided, and as they are then."""
        if t is None:
            return ("", "allow", None, "approved", None, "")
        self.held = [x for x in self.held if x[0] > t - self.longest]
        self.held.append([t, amount or 0, True])
        seen = self.values(t)
        action, rule, preventive = self.action(seen | {"amount": amount or 0})
        if not preventive:
            return (_said(seen), action, rule, "approved", None, _said(seen))
        self.held[-1][2] = False  # it is declined: what comes later sees it so
        return (_said(seen), action, rule, "declined", DECLINE_REASONS.get(action, f"risk_{action}"), _said(self.values(t)))


def _said(values: dict[str, float]) -> str:
    return ";".join(f"{k}={v}" for k, v in values.items())


def authorize(charges: DataFrame, features, conditions, rules) -> DataFrame:
    """(id, account, t, amount) to DECIDED; amount in whole units (as of cents). An account's charges are parted where none came for the
    longest window, and each such stretch is read in order as a stream that holds the window alone."""
    longest = max((f[3] for f in features), default=0)
    mine = Window.partitionBy("account").orderBy(F.asc_nulls_first("t"), "id")
    cut = F.coalesce((F.col("t") - F.lag("t").over(mine) >= longest).cast("int"), F.lit(0))
    parted = charges.select("id", "account", "t", "amount").withColumn("cut", cut).withColumn("stretch", F.sum("cut").over(mine))
    rows = parted.repartition("account", "stretch").sortWithinPartitions("account", "stretch", F.asc_nulls_first("t"), "id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, desk = None, None
        for b in batches:
            out = []
            for i, account, t, amount, stretch in zip(*(b.column(c).to_pylist() for c in ("id", "account", "t", "amount", "stretch")), strict=True):
                if desk is None or at != (account, stretch):
                    at, desk = (account, stretch), Desk(features, conditions, rules)
                out.append((i, account, t, *desk.decide(t, amount)))
            names = [x.split()[0] for x in DECIDED.split(", ")]
            kinds = [pa.int64() if x.endswith("long") else pa.string() for x in DECIDED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)

    return rows.mapInArrow(run, DECIDED)


def authorize_stream(charges: DataFrame, features, conditions, rules) -> DataFrame:
    """The same over a stream of (id, account, t, amount, at), at: t as a timestamp with a watermark, that comes in order of time. The state
    of an account is the charges of the longest window, and goes when the watermark has passed it."""
    longest = max((f[3] for f in features), default=0)
    names = [x.split()[0] for x in DECIDED.split(", ")]

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        desk = Desk(features, conditions, rules)
        if state.exists:
            times, amounts, approved = state.get
            desk.held = [list(x) for x in zip(times, amounts, approved, strict=True)]
        rows = pd.concat(list(parts)).sort_values(["t", "id"])
        out = [(int(i), key[0], int(t), *desk.decide(int(t), int(a))) for i, t, a in zip(rows["id"], rows["t"], rows["amount"], strict=True)]
        last = desk.held[-1][0]
        state.update(([x[0] for x in desk.held], [x[1] for x in desk.held], [x[2] for x in desk.held]))
        state.setTimeoutTimestamp(max((last + longest) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=names)

    return charges.groupBy("account").applyInPandasWithState(fold, DECIDED, "times array<long>, amounts array<long>, approved array<boolean>", "append", GroupStateTimeout.EventTimeTimeout)
