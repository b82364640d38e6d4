"""Typed conditions in groups, reads over entities, evidence, versions, explanations, stable ids: against plain Python."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators import explain, pit, rules

DAY = 86_400_000_000


def plain_fires(op, value, operand, operand_text):
    def number():
        if isinstance(value, bool) or value is None:
            return None
        try:
            return float(value)
        except ValueError:
            return None

    text = None if value is None else str(value) if isinstance(value, str | bool) else str(int(value)) if value == int(value) else str(value)
    if op in (">", ">=", "<", "<="):
        n = number()
        return n is not None and operand is not None and {">": n > operand, ">=": n >= operand, "<": n < operand, "<=": n <= operand}[op]
    if op in ("=", "!=", "<>"):
        if operand_text in ("true", "false"):
            hit = value is not None and bool(value) == (operand_text == "true")
        elif operand is not None:
            hit = number() == operand
        else:
            hit = text is not None and text == operand_text
        return hit if op == "=" else not hit
    return op == "in" and value is not None and text in [x.strip() for x in (operand_text or "").split(",") if x.strip()]


def test_typed_operators(spark):
    values = [5.0, 0.0, 2.5, -1.0, "5", "abc", "", "true", "2.50", True, False]
    asks = list(itertools.product([">", ">=", "<", "<=", "=", "!=", "<>", "in", "like"], [(5.0, None), (0.0, None), (None, "true"), (None, "false"), (None, "abc"), (None, "5, abc ,,True"), (None, "2.5"), (None, None), (2.5, "abc")]))
    rows = [(i, float(v) if isinstance(v, float) else None, v if isinstance(v, str) else None, v if isinstance(v, bool) else None, j, op, a, b) for i, v in enumerate(values) for j, (op, (a, b)) in enumerate(asks)]
    df = spark.createDataFrame(rows, "i int, value double, text string, flag boolean, j int, op string, operand double, operand_text string")
    got = {(r.i, r.j): r.hit for r in df.select("i", "j", rules.fires(*(F.col(c) for c in ("op", "value", "text", "flag", "operand", "operand_text"))).alias("hit")).collect()}
    for (i, v), (j, (op, (a, b))) in itertools.product(enumerate(values), enumerate(asks)):
        assert got[i, j] == plain_fires(op, v, a, b), (v, op, a, b)


@pytest.mark.parametrize("combine,required,fired,want", [("AND", [1, 1, 1], [1, 0, 1], True), ("AND", [1, 1, 1], [1, 1, 0], False), ("OR", [1, 1, 1], [0, 0, 1], True), ("or", [1, 1, 1], [0, 0, 0], False), ("AND", [1, 1, 0], [0, 1, 0], True), ("AND", [0, 0, 0], [0, 0, 1], True), ("OR", [1, 0, 0], [0, 1, 1], False)])
def test_groups(spark, combine, required, fired, want):
    """Conditions 1 and 2 are one group, 3 another: any of a group, then the groups as the rule combines them."""
    values = spark.createDataFrame([(1, f"f{k}", float(x), None, None, "present") for k, x in enumerate(fired)], "subject long, feature string, value double, text string, flag boolean, status string")
    conditions = spark.createDataFrame([("R", f"c{k}", f"f{k}", "=", 1.0, None, [1, 1, 2][k], 5, bool(r)) for k, r in enumerate(required)], "rule_id string, condition_id string, feature string, op string, operand double, operand_text string, condition_group int, points int, required boolean")
    out = rules.ledger(values, conditions, spark.createDataFrame([("R", combine)], "rule_id string, combine string")).collect()
    assert {r.satisfied for r in out} == {want} and sum(r.contributed for r in out) == (5 * sum(fired) if want else 0)


def test_one_group_each(spark):
    conditions = spark.createDataFrame([("B", "y", 7), ("A", "z", 1), ("A", "x", 1)], "rule_id string, condition_id string, condition_group int")
    assert sorted((r.rule_id, r.condition_id, r.condition_group) for r in rules.one_group_each(conditions).collect()) == [("A", "x", 1), ("A", "z", 2), ("B", "y", 1)]


def test_rules_that_apply(spark):
    catalog = spark.createDataFrame([("a", "account", "inline", "active"), ("b", "account", "inline", "shadow"), ("c", "account", "inline", "retired"), ("d", "card", "inline", "active"), ("e", "account", "async", "active"), ("f", None, None, None)], "rule_id string, subject_type string, mode string, status string")
    assert sorted(r.rule_id for r in rules.applicable(catalog, "account", "inline").collect()) == ["a", "b"]


def test_reads_over_entities(spark):
    values = spark.createDataFrame([("f", 1, DAY, 5, 3.0), ("f", 1, 2 * DAY, 6, 4.0), ("f", 1, 2 * DAY, 9, 5.0), ("f", 2, 9 * DAY, 7, 8.0), ("f", 3, 9 * DAY, 7, None), ("g", 2, 9 * DAY, 8, 1.0), ("g", 4, 9 * DAY, 4, 0.0)], "feature string, key long, as_of long, computed_at long, value double")
    specs = spark.createDataFrame([("f", "max", 8 * DAY), ("g", "one", None), ("h", "max", None)], "feature string, policy string, max_staleness long")
    asked = [(1, "f", 9 * DAY, "ok", None, [2, 1, 2]), (2, "f", 11 * DAY, "ok", None, [1, 2]), (3, "f", 10 * DAY, "ok", None, [2, 3]), (4, "f", 10 * DAY, "ok", None, [77]), (5, "f", 10 * DAY, "no", "no_entities", []), (6, "f", 10 * DAY, "no", "fanout:3", [1, 2, 3]), (7, "g", 10 * DAY, "ok", None, [2, 4]), (8, "g", 10 * DAY, "ok", None, [4]), (9, "h", 10 * DAY, "ok", None, [1]), (10, "f", 2 * DAY, "ok", None, [1]), (11, "f", 0, "ok", None, [1]), (12, "f", 9, "ok", None, [])]
    requests = spark.createDataFrame(asked, "request_id long, feature string, bound long, resolution string, reason string, entity_ids array<long>")
    got = {r.request_id: (r.status, r.value, r.value_as_of, r.value_computed_at, r.reason) for r in pit.read_entities(values, requests, specs).collect()}
    assert got == {
        1: ("present", 8.0, 2 * DAY, 9, None),  # the oldest member's as_of, the newest computation; an entity named twice counts once
        2: ("stale", None, 2 * DAY, None, f"stale_by:{DAY}"),  # a fresh member doesn't hide a stale one
        3: ("absent", None, 9 * DAY, None, "null_value"), 4: ("absent", None, None, None, "no_value_at_bound"), 5: ("unresolvable", None, None, None, "no_entities"), 6: ("fanout_error", None, None, None, "fanout:3"),
        7: ("fanout_error", None, 9 * DAY, None, "no_reduction:one"), 8: ("present", 0.0, 9 * DAY, 4, None), 9: ("absent", None, None, None, "no_value_at_bound"), 10: ("present", 5.0, 2 * DAY, 9, None), 11: ("absent", None, None, None, "no_value_at_bound"), 12: ("absent", None, None, None, "no_value_at_bound"),
    }


def test_versions(spark):
    rows = spark.createDataFrame([(1, "R1", 1, "f", 2), (1, "R1", 2, "g", None), (2, "R2", 1, "f", 3), (3, "R3", None, "f", None)], "subject long, rule_id string, rule_version int, feature string, feature_version int")
    sets = explain.version_sets(rows)
    got = {r.subject: (r.rule_version_set, r.feature_version_set) for r in sets.collect()}
    assert got == {1: ({"R1": 2}, {"f": 2}), 2: ({"R2": 1}, {"f": 3}), 3: (None, None)}
    published = spark.createDataFrame([("rule", "R1", 2), ("feature", "f", 2), ("feature", "R2", 1)], "kind string, name string, version int")
    assert sorted(map(tuple, explain.unresolved_versions(sets, published).collect())) == [(2, "feature", "f", 3), (2, "rule", "R2", 1)]


def test_case_text(spark):
    cases = spark.createDataFrame([(1, 10, 40, "elevated", "challenge", "R1", "confirmed_fraud"), (2, 20, 0, "low", "allow", None, None)], "alert_id long, decision_id long, score long, band string, action string, source_rule string, disposition string")
    signals = spark.createDataFrame([(10, 2, "reason:z", "mitigating", -5, "R2", None), (10, 1, "reason:n", "aggravating", 45, "R1", "6 in a week"), (10, 3, "DEGRADED_EVIDENCE", "veto", 0, "V1", None)], "decision_id long, rank int, reason_code string, direction string, contribution long, rule_id string, line string")
    done = spark.createDataFrame([(1, "notify", None), (1, "challenge", "failed")], "alert_id long, action string, outcome string")
    got = {r.alert_id: r for r in explain.explain_cases(cases, signals, done).collect()}
    assert got[1].explanation == "case 1: score 40 (elevated), challenge by R1\n+45 6 in a week [R1]\n-5 reason:z [R2]\n! DEGRADED_EVIDENCE by V1\naggravating +45, mitigating -5; evidence is degraded\nexecutions: challenge failed, notify open; verdict: confirmed_fraud"
    assert got[2].explanation == "case 2: score 0 (low), allow\nno signals\naggravating +0, mitigating 0\nexecutions: none; verdict: none" and got[1].cites == "R1,R2,V1"


def test_templates(spark):
    rows = [(1, "{n} of {v}", 5.0, None), (2, "{v}", 2.345, None), (3, None, 2.5, None), (4, "is {v}", None, True), (5, "x{v}x", None, None), (6, "{v}", -3.0, None)]
    df = spark.createDataFrame(rows, "i int, t string, v double, b boolean")
    got = {r.i: r.s for r in df.select("i", explain.filled(F.col("t"), F.lit("feat"), explain.shown(F.col("v"), F.col("b"))).alias("s")).collect()}
    assert got == {1: "5 of 5", 2: "2.34", 3: "feat fired", 4: "is yes", 5: "xx", 6: "-3"}


def test_ranked_signals(spark):
    signals = spark.createDataFrame([(1, "b", "aggravating", 5, "R1"), (1, "a", "aggravating", 5, "R1"), (1, "c", "mitigating", -9, "R2")], "subject long, feature string, direction string, contribution int, rule_id string")
    scores = spark.createDataFrame([(1, "V2", True, True), (1, "V1", True, None), (1, "V3", True, False), (1, "R1", False, False), (2, "V1", True, True)], "subject long, rule_id string, is_veto boolean, veto boolean")
    got = sorted((r.subject, r["rank"], r.reason_code, r.rule_id) for r in rules.ranked_signals(signals, scores).collect())
    assert got == [(1, 1, "reason:c", "R2"), (1, 2, "reason:a", "R1"), (1, 3, "reason:b", "R1"), (1, 4, "DEGRADED_EVIDENCE", "V1"), (1, 5, "VETO_APPLIED", "V2"), (2, 1, "VETO_APPLIED", "V1")]


def test_stable_ids(spark):
    rng = random.Random(3)
    keys = [f"k{i}" for i in rng.sample(range(1000), 200)]
    existing = {k: f"RING-{1187 + rng.randrange(300)}" for k in keys[:60]}
    existing = {k: v for i, (k, v) in enumerate(existing.items()) if v not in list(existing.values())[:i]} | {"gone": "RING-1188", "odd": "other"}
    pinned = {keys[70]: "RING-1190", keys[71]: next(iter(existing.values())), "nobody": "RING-1191"}
    place = {k: rng.randrange(50) for k in keys}
    taken, want = set(existing.values()), {k: existing[k] for k in keys if k in existing}
    for k in keys:
        if k in pinned and k not in existing and pinned[k] not in taken:
            want[k] = pinned[k]
    taken |= set(want.values())
    n = 1187
    for k in sorted((k for k in keys if k not in want), key=lambda k: (place[k], k)):
        while f"RING-{n}" in taken:
            n += 1
        want[k] = f"RING-{n}"
        taken.add(want[k])
    frame = lambda d: spark.createDataFrame(list(d.items()), "natural_key string, id string")
    candidates = spark.createDataFrame([(k, place[k]) for k in keys + keys[:5]], "natural_key string, place int").repartition(5)
    got = explain.stable_ids(candidates, frame(existing), frame(pinned), 1187, "RING-").collect()
    assert len(got) == 200 and {r.natural_key: r.id for r in got} == want
    assert explain.stable_ids(candidates.limit(0), frame(existing), frame(pinned), 1187, "RING-").count() == 0
