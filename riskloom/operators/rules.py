"""From feature values to decisions: conditions, rule scores, consolidated signals, band, action precedence.

rules: rule_id, action, severity, preventive, is_veto, review, prevent. conditions: rule_id, condition_id, feature, op, operand, points,
required. values: subject, feature, value, status. Rule tables are configuration of a few rows, so they are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def holds(op: Column, value: Column, operand: Column) -> Column:
    """One chain for all operators on numbers; an unknown one never holds."""
    return F.coalesce(
        F.when(op == ">", value > operand).when(op == ">=", value >= operand).when(op == "<", value < operand).when(op == "<=", value <= operand).when(op == "=", value == operand).when(op.isin("!=", "<>"), value != operand),
        F.lit(False),
    )


def said(value: Column, text: Column, flag: Column) -> Column:
    """A typed value as text: whole numbers bare, booleans as True or False."""
    number = F.when(value == F.floor(value), F.format_string("%d", F.floor(value).cast("long"))).otherwise(value.cast("string"))
    return F.coalesce(text, F.when(flag, "True").when(~flag, "False"), number)


def fires(op: Column, value: Column, text: Column, flag: Column, operand: Column, operand_text: Column) -> Column:
    """A condition on a value that is a number, a text or a boolean (the other two null).

    Order is asked of numbers and of texts that read as one, never of booleans. Equality: an operand text `true` or `false` asks for truth (a
    number other than 0, a text that isn't empty), else a number operand for the number, else the text of the value. `in`: the text of the
    value is in the operand's list. `!=` and `<>` hold wherever `=` doesn't. An unknown operator never holds."""
    number = F.coalesce(value, text.try_cast("double"))
    number = F.when(flag.isNull(), number)
    truth = F.coalesce(flag, value != 0, text != "")
    text_of = said(value, text, flag)
    equal = F.when(operand_text.isin("true", "false"), truth == (operand_text == "true")).when(operand.isNotNull(), number == operand).otherwise(text_of == operand_text)
    equal = F.coalesce(equal, F.lit(False))
    options = F.transform(F.split(operand_text, ","), lambda x: F.trim(x))
    listed = F.array_contains(F.filter(options, lambda x: x != ""), text_of)
    out = F.when(op == ">", number > operand).when(op == ">=", number >= operand).when(op == "<", number < operand).when(op == "<=", number <= operand)
    return F.coalesce(out.when(op == "=", equal).when(op.isin("!=", "<>"), ~equal).when(op == "in", listed), F.lit(False))


def applicable(rules: DataFrame, subject_type: str, mode: str) -> DataFrame:
    """Rules of a kind of subject and an execution mode that are live or in shadow."""
    return rules.filter((F.col("subject_type") == subject_type) & (F.col("mode") == mode) & F.col("status").isin("active", "shadow"))


def ledger(values: DataFrame, conditions: DataFrame, rules: DataFrame) -> DataFrame:
    """A row for each condition visited; contributed is points if fired in a satisfied rule.

    A rule is satisfied by its required conditions: those of one condition_group by any of them, the groups together as the rule's `combine`
    says (AND, OR); without required conditions by any that fires. Without a column condition_group each condition is a group, without
    combine it is AND. values may have text and flag beside value, conditions operand_text."""
    values = values.repartition("subject")  # all that follows is by subject, and needs no further exchange
    return with_verdict(values.join(F.broadcast(conditions), "feature").join(F.broadcast(rules), "rule_id"), conditions.columns, rules.columns)


def with_verdict(rows: DataFrame, of_conditions: list[str], of_rules: list[str]) -> DataFrame:
    """rows (values met with conditions and rules of these columns) with fired, satisfied and contributed."""
    if "operand_text" in of_conditions:
        hit = fires(F.col("op"), F.col("value"), F.col("text"), F.col("flag"), F.col("operand"), F.col("operand_text"))
    else:
        hit = holds(F.col("op"), F.col("value"), F.col("operand"))
    rows = rows.withColumn("fired", (F.col("status") == "present") & hit)
    w = Window.partitionBy("subject", "rule_id")
    if "condition_group" in of_conditions:
        groups, met = (F.size(F.collect_set(F.when(when, F.col("condition_group"))).over(w)) for when in (F.col("required"), F.col("required") & F.col("fired")))
        any_of = F.upper("combine") == "OR" if "combine" in of_rules else F.lit(False)
        needed = F.when(groups > 0, F.when(any_of, met > 0).otherwise(met == groups))
    else:
        needed = F.bool_and(F.when(F.col("required"), F.col("fired"))).over(w)
    rows = rows.withColumn("satisfied", F.coalesce(needed, F.bool_or("fired").over(w)))
    return rows.withColumn("contributed", F.when(F.col("fired") & F.col("satisfied"), F.col("points")).otherwise(0))


def rule_scores(rows: DataFrame) -> DataFrame:
    """Score, authority and veto state of each rule for each subject.

    A mitigator (negative points) without a present value takes away preventive authority (`sound`). A veto is established by its
    mitigators: all fired; unknown (null) where one is absent, stale or of a failed fan-out; not where there are none or all are unresolvable."""
    eases = F.col("points") < 0
    mine = lambda c: F.bool_or(F.when(eases, c))
    veto = F.when(F.count_if(eases) == 0, False).when(~mine(F.col("status") != "unresolvable"), False)
    veto = veto.when(mine(F.col("status").isin("absent", "stale", "fanout_error")), F.lit(None).cast("boolean")).otherwise(F.bool_and(F.when(eases, F.col("fired"))))
    sound = ~F.coalesce(mine(F.col("status") != "present"), F.lit(False))
    out = rows.groupBy("subject", "rule_id").agg(
        F.sum("contributed").alias("score"), F.first("satisfied").alias("satisfied"), F.first("action").alias("action"), F.first("severity").alias("severity"), F.first("preventive").alias("preventive"), F.first("is_veto").alias("is_veto"),
        F.first("review").alias("review"), F.first("prevent").alias("prevent"), sound.alias("sound"), veto.alias("veto"),
    )
    return out.withColumn("authorised", ~F.col("is_veto") & F.col("satisfied") & (F.col("score") >= F.col("review")))


def consolidate(rows: DataFrame) -> DataFrame:
    """One signal for each (feature, direction) of a subject: the largest in size, ties to the lowest rule then condition; all
    dropped where their sum isn't positive. A fired condition of 0 points is a signal too, with its claimants. A column `evidence` of
    rows, whatever it holds, goes with the signal that it speaks for."""
    more = ["evidence"] if "evidence" in rows.columns else []
    fired = rows.filter("fired and satisfied").withColumn("direction", F.when(F.col("points") >= 0, "aggravating").otherwise("mitigating"))
    best = F.min(F.struct(-F.abs("points"), F.col("rule_id"), F.col("condition_id"), F.col("points").alias("points"), *more)).alias("best")
    s = fired.groupBy("subject", "feature", "direction").agg(best, F.array_sort(F.collect_set("rule_id")).alias("claimed"))
    s = s.select("subject", "feature", "direction", F.col("best.points").alias("contribution"), F.col("best.rule_id").alias("rule_id"), "claimed", *(F.col(f"best.{c}").alias(c) for c in more))
    return s.withColumn("score", F.sum("contribution").over(Window.partitionBy("subject"))).filter("score > 0")


VETO_APPLIED, DEGRADED_EVIDENCE = "VETO_APPLIED", "DEGRADED_EVIDENCE"  # fixed values: reason codes of veto signals


def ranked_signals(signals: DataFrame, scores: DataFrame) -> DataFrame:
    """(subject, rank, reason_code, feature, direction, contribution, rule_id): a decision's signals by size, feature and direction, and after
    them, by rule, a signal of 0 points for each veto that is established or that can't be told for want of evidence."""
    pool = signals.select("subject", F.lit(0).alias("part"), F.concat(F.lit("reason:"), "feature").alias("reason_code"), "feature", "direction", F.col("contribution").cast("long").alias("contribution"), "rule_id")
    why = F.when(F.col("veto").isNull(), DEGRADED_EVIDENCE).otherwise(VETO_APPLIED)
    vetoes = scores.filter("is_veto and coalesce(veto, true)").select("subject", F.lit(1).alias("part"), why.alias("reason_code"), F.lit(None).cast("string").alias("feature"), F.lit("veto").alias("direction"), F.lit(0).cast("long").alias("contribution"), "rule_id")
    order = Window.partitionBy("subject").orderBy("part", -F.abs("contribution"), "feature", "direction", "rule_id")
    return pool.unionByName(vetoes).withColumn("rank", F.row_number().over(order)).drop("part")


ALERT, MONITOR = 2, 1  # severities of these actions


def decide(scores: DataFrame, signals: DataFrame, bands: list[tuple[str, int]]) -> DataFrame:
    """One decision for each subject: score, band, action, source rule, the rules that fired and those authorised.

    A veto that is established or unknown lowers an action above `monitor` to it, and raises none."""
    points = signals.groupBy("subject").agg(F.max("score").alias("score"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("claimed")))), ",").alias("rules_fired"))
    order = lambda keep: F.min(F.when(keep, F.struct(-F.col("severity"), F.col("rule_id"), F.col("action"), F.col("preventive"), F.col("severity").alias("level"), ((F.col("score") >= F.col("prevent")) & F.col("sound")).alias("may"))))
    allowed = F.col("authorised")
    per = scores.groupBy("subject").agg(
        order(allowed).alias("top"), order(allowed & ~F.col("preventive")).alias("soft"), F.bool_or(F.when(F.col("is_veto"), F.col("veto"))).alias("vetoed"), F.bool_or(F.col("is_veto") & F.col("veto").isNull()).alias("unknown"), F.array_join(F.array_sort(F.collect_set(F.when(allowed, F.col("rule_id")))), "+").alias("rules_authorised")
    )
    d = per.join(points, "subject", "left")
    score = F.coalesce("score", F.lit(0))
    band = F.coalesce(*[F.when(score >= low, name) for name, low in bands])
    kept = ~F.col("top.preventive") | F.col("top.may")
    action = F.when(F.col("top").isNull(), "allow").when(kept, F.col("top.action")).otherwise(F.coalesce("soft.action", F.lit("alert")))
    level = F.when(kept, F.col("top.level")).otherwise(F.coalesce("soft.level", F.lit(ALERT)))
    capped = F.coalesce("vetoed", F.lit(False)) | F.col("unknown")
    action = F.when(capped & F.col("top").isNotNull() & (level > MONITOR), "monitor").otherwise(action)
    return d.select("subject", score.cast("long").alias("score"), band.alias("band"), action.alias("action"), F.col("top.rule_id").alias("source_rule"), F.coalesce("rules_fired", F.lit("")).alias("rules_fired"), "rules_authorised")


def with_shadow(live: DataFrame, rows: DataFrame, shadow_rules: list[str], bands: list[tuple[str, int]]) -> DataFrame:
    """live (subject, ...) with shadow_score, shadow_action, shadow_rules. rows: the ledger of live and shadow rules together, for the subjects
    that shadow rules apply to; the decision is made as if the shadow rules were live. shadow_rules are those scored for the subject, in order,
    fired or not. All three are null where no shadow rule was scored."""
    both = decide(rule_scores(rows), consolidate(rows), bands)
    scored = rows.filter(F.col("rule_id").isin(shadow_rules)).groupBy("subject").agg(F.array_join(F.array_sort(F.collect_set("rule_id")), ",").alias("shadow_rules"))
    return live.join(both.select("subject", F.col("score").alias("shadow_score"), F.col("action").alias("shadow_action")).join(scored, "subject"), "subject", "left")


def scenarios(values: DataFrame, conditions: DataFrame, rules: DataFrame) -> DataFrame:
    """One ledger for many candidate rule sets. conditions and rules have a column `scenario`; each value is worked out once and meets the
    conditions of all scenarios, and the ledger's subject is (scenario, subject), so that no scenario sees another in whatever is made of
    the ledger: scores, signals, decisions. A subject's scenarios are rows, so none is gathered with the others."""
    rows = values.join(F.broadcast(conditions), "feature").join(F.broadcast(rules), ["scenario", "rule_id"])
    return with_verdict(rows.withColumn("subject", F.struct("scenario", "subject")).drop("scenario").repartition("subject"), conditions.columns, rules.columns)


def banded(decisions: DataFrame, bands: DataFrame) -> DataFrame:
    """decisions (subject_type, score, ...) with `band`: the one of the highest min_score that the score reaches, among those of the kind of
    subject, or of `transaction` for a kind without any; `low` where none is reached. bands (subject_type, band, min_score) is configuration of
    a few rows and becomes one map, so no row is multiplied."""
    ladder = bands.groupBy(F.col("subject_type").alias("kind")).agg(F.sort_array(F.collect_list(F.struct("min_score", "band")), asc=False).alias("steps"))
    ladders = ladder.agg(F.map_from_entries(F.collect_list(F.struct("kind", "steps"))).alias("ladders"))  # one row
    x = decisions.crossJoin(F.broadcast(ladders))
    steps = F.coalesce(F.try_element_at("ladders", F.col("subject_type")), F.try_element_at("ladders", F.lit("transaction")))
    reached = F.filter(steps, lambda s: F.col("score") >= s["min_score"])
    return x.withColumn("band", F.coalesce(F.try_element_at(reached, F.lit(1))["band"], F.lit("low"))).drop("ladders")


def degraded_features(rows: DataFrame, live: list[str]) -> DataFrame:
    """(subject, degraded): features that conditions of live rules asked for and couldn't read, though they apply; in order."""
    bad = F.col("status").isin("absent", "stale", "fanout_error") & F.col("rule_id").isin(live)
    return rows.groupBy("subject").agg(F.array_sort(F.collect_set(F.when(bad, F.col("feature")))).alias("degraded"))


def one_group_each(conditions: DataFrame) -> DataFrame:
    """conditions with condition_group 1, 2, ... in order of condition_id within each rule, so that under AND all required ones must fire."""
    return conditions.drop("condition_group").withColumn("condition_group", F.row_number().over(Window.partitionBy("rule_id").orderBy("condition_id")))
