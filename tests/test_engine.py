import pytest

from riskloom.functions import predicates, windows
from riskloom.operators import cases, pit


def test_windows():
    assert windows.micros("90s") == 90_000_000 and windows.micros("2w") == 1_209_600_000_000
    with pytest.raises(ValueError):
        windows.micros("3x")


def test_predicates_refuse_the_unknown(spark):
    for bad in ({"op": "like", "col": "a", "value": 1}, {"op": "eq", "col": "z", "value": 1}, {"op": "not", "args": []}, {"op": "eq", "col": "a", "value": {"ref": "self.z"}}):
        with pytest.raises(ValueError):
            predicates.build(bad, ["a"])
    for bad in ({"op": "eq", "col": "a"}, {"op": "between", "col": "a", "value": [1]}, {"op": "between", "col": "a", "value": [1, {"ref": "a"}]}):
        with pytest.raises(ValueError):
            predicates.build(bad, ["a"])
    deep = {"op": "eq", "col": "a", "value": 1}
    for _ in range(6):
        deep = {"op": "not", "args": [deep]}
    predicates.build(deep, ["a"])  # the root is at depth 0, so its comparison is at depth 6
    with pytest.raises(ValueError):
        predicates.build({"op": "not", "args": [deep]}, ["a"])
    df = spark.createDataFrame([(1,), (None,), (3,)], "a int")
    assert df.filter(predicates.build(None, ["a"])).count() == 3
    assert df.filter(predicates.build({"op": "ne", "col": "a", "value": 1}, ["a"])).count() == 1


def test_window_edge_is_left_out(spark):
    from pyspark.sql import functions as F

    day = windows.micros("1d")
    df = spark.createDataFrame([("s", 0), ("s", day - 1), ("s", day), ("s", day)], "s string, t long")
    got = df.withColumn("n", F.count("*").over(windows.trailing("s", "1d"))).collect()
    assert sorted((r.t, r.n) for r in got) == [(0, 1), (day - 1, 2), (day, 3), (day, 3)]


def test_point_in_time(spark):
    values = spark.createDataFrame([("k", 10, 11, 1.0), ("k", 10, 15, 2.0), ("k", 20, 21, 3.0)], "key string, as_of long, computed_at long, value double")
    probes = spark.createDataFrame([("k", 1, 9), ("k", 2, 10), ("k", 3, 25), ("x", 4, 25)], "key string, probe_id long, bound long")
    read = {r.probe_id: r for r in pit.status(pit.as_of(values, probes), 5).collect()}
    assert (read[1].status, read[2].value, read[3].value, read[3].status, read[4].status) == ("absent", 2.0, 3.0, "present", "absent")
    replay = {r.probe_id: r.value for r in pit.as_of(values, probes, ceiling=12).collect()}
    assert replay == {1: None, 2: 1.0, 3: 1.0, 4: None}


def _routed(rows, window):
    """A plain loop over one subject's decisions."""
    open_cases, out = [], {}
    for t, i, key, score, authorised in sorted(rows):
        if not authorised:
            out[i] = "no_authority"
            continue
        mine = [c for c in open_cases if c["key"] == key and abs(t - c["first"]) <= window]
        if mine:
            out[i] = "restated" if score > mine[-1]["score"] else "folded"
            mine[-1].update(first=min(mine[-1]["first"], t), score=max(mine[-1]["score"], score))
        elif any(c["key"] != key and abs(t - c["first"]) <= window for c in open_cases):
            out[i] = "suppressed"
        else:
            out[i] = "raised"
            open_cases.append({"key": key, "first": t, "score": score})
    return out


def test_routing_equals_a_loop(spark):
    import random

    rng = random.Random(1)
    rows = [(s, i, rng.choice("ab"), rng.randrange(60), rng.randrange(10), rng.random() < 0.8) for i, s in enumerate(rng.choices("xyz", k=120))]
    got = {r.id: r.routing for r in cases.route(spark.createDataFrame(rows, "subject string, id long, key string, t long, score long, authorised boolean"), 10).collect()}
    want = {}
    for s in "xyz":
        want |= _routed([(t, i, k, sc, a) for subject, i, k, t, sc, a in rows if subject == s], 10)
    assert got == want


def test_routing_of_a_hot_subject(spark):
    n = 6000
    rows = [("hot", i, "ab"[i % 2], i * 3, i % 10, True) for i in range(n)] + [("cold", n, "a", 0, 1, True)]
    out = cases.route(spark.createDataFrame(rows, "subject string, id long, key string, t long, score long, authorised boolean"), 10)
    got = {r.id: r.routing for r in out.collect()}
    want = _routed([(t, i, k, sc, a) for s, i, k, t, sc, a in rows if s == "hot"], 10) | {n: "raised"}
    assert got == want
    assert "collect_list" not in out._jdf.queryExecution().toString()  # no row holds a whole subject


def test_actions_are_issued_by_routing(spark):
    kinds = ["raised", "restated", "folded", "suppressed", "no_authority"]
    rows = [(f"{a}-{r}", a, "high", r) for a in ("challenge", "alert") for r in kinds]
    channels = spark.createDataFrame([("challenge", "high", "push"), ("notify", "high", "queue")], "action string, band string, channel string")
    routed = spark.createDataFrame(rows, "subject string, action string, band string, routing string")
    got = sorted(map(tuple, cases.issue(routed, channels, ["challenge"]).collect()))
    want = [("challenge-raised", "challenge", "push")] + [(f"{a}-{r}", "notify", "queue") for a in ("challenge", "alert") for r in ("raised", "restated")]
    assert got == sorted(want)
    with pytest.raises(Exception, match="no channel for action notify"):
        cases.issue(routed, channels.filter("action <> 'notify'"), ["challenge"]).collect()


def test_routes():
    from riskloom.operators import routes

    edges = [(5, "b", "a", "x"), (2, "b", "a", "y"), (3, "c", "x", "z"), (4, "c", "y", "z"), (6, "d", "z", "w"), (7, "e", "w", "v")]
    assert routes.shortest(edges, "a", "z") == [2, 4] and routes.shortest(edges, "a", "a") == []
    assert routes.shortest(edges, "a", "w") == [2, 4, 6] and routes.shortest(edges, "a", "v") is None  # at most three hops
    assert routes.plan(edges, "auto", "v", "a", "z") == ("trigger", [2, 4])
    assert routes.plan(edges, "subject.b.c", "a", None, "z") == ("subject", [2, 4])
    for path, subject in (("self", "a"), ("subject.q", "a"), ("auto", "v")):
        with pytest.raises(ValueError):
            routes.plan(edges, path, subject, None, "z")


def test_veto_and_authority_of_mitigators(spark):
    """Literal rows that tell mitigators from aggravators."""
    from riskloom.operators import rules

    conditions = spark.createDataFrame([("V", "c1", "m1", "=", 1.0, -5, False), ("V", "c2", "m2", "=", 1.0, -5, False), ("V", "c3", "a1", "=", 1.0, 5, False), ("W", "c1", "a1", "=", 1.0, 5, False)], "rule_id string, condition_id string, feature string, op string, operand double, points int, required boolean")
    config = spark.createDataFrame([("V", "allow", 0, False, True, 0, 0), ("W", "allow", 0, False, True, 0, 0)], "rule_id string, action string, severity int, preventive boolean, is_veto boolean, review int, prevent int")
    cases_ = {"all": (("present", 1.0), ("present", 1.0), ("absent", None)), "one": (("present", 1.0), ("present", 0.0), ("present", 1.0)), "stale": (("present", 1.0), ("stale", 1.0), ("present", 1.0)), "none": (("unresolvable", None), ("unresolvable", None), ("present", 1.0)), "part": (("unresolvable", None), ("present", 1.0), ("present", 1.0)), "fan": (("fanout_error", None), ("present", 1.0), ("present", 1.0))}
    values = spark.createDataFrame([(s, f, v, st) for s, x in cases_.items() for f, (st, v) in zip(("m1", "m2", "a1"), x)], "subject string, feature string, value double, status string")
    got = {(r.subject, r.rule_id): (r.veto, r.sound) for r in rules.rule_scores(rules.ledger(values, conditions, config)).collect()}
    assert {s: got[s, "V"] for s in cases_} == {"all": (True, True), "one": (False, True), "stale": (None, False), "none": (False, False), "part": (False, False), "fan": (None, False)}
    assert all(got[s, "W"] == (False, True) for s in cases_)  # no mitigator: nothing to establish, nothing taken away
