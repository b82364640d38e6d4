"""Quality rules whose cutoffs carry a guarantee: at most `max_false_rejection` of a stratum's good documents are rejected.

Each text gets fixed counts and six rule values (higher is worse). Labelled documents that pass the base rules are split by a
hash of their id into a design half and a holdout half. The design half proposes, per stratum, a sequence of cutoff vectors from
loose to tight. The holdout half tests them in that order with the exact binomial (Clopper-Pearson) bound and stops at the first
that fails, which needs no correction along the sequence; the error level is divided by the number of strata (Bonferroni).
A stratum without enough labels has no cutoff, so the rules reject nothing there.

Nulls: a null text has no words and fails the base rules; a null language is the stratum "none"; labels with a null id or quality
count nowhere; several labels of one id count as the worst. Rows with equal ids each get their own result; repeated rows, and ties of
rule values with a cutoff, are rejected alike. Very long texts are measured whole. Empty tables give no rows, and without labels no
cutoffs. Further columns aren't read. There may be any number of strata, each with its own cutoffs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

RULES = ("symbols", "capitals", "marks", "dup_lines", "repeats", "wordless")
GRID = tuple(0.004 * 1.15**i for i in range(40))  # cutoffs that can be chosen; a value's level is the number of them it reaches
# design rates of false rejection, all rules together, and by how many levels the cutoffs then stay on the safe side
STEPS = ((0.0, 8), (0.0, 4), (0.0, 0), (0.0025, 0), (0.005, 0), (0.01, 0), (0.015, 0), (0.02, 0), (0.03, 0), (0.04, 0))
SCHEMA = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " + ", ".join(f"v_{r} double" for r in RULES)

_BLANK = b" \t\n\x0b\x0c\r"
_NOT_START = bytes(range(0x80, 0xC0))
_CAPITAL = bytes(range(65, 91))
_LETTER = _CAPITAL + bytes(range(97, 123))
_PLAIN = _LETTER + bytes(range(48, 58)) + bytes(range(128, 256)) + b".,;:'-\"" + _BLANK


def repeated_words(ids: np.ndarray, window: int = 3) -> int:
    """Words inside a window of words that is found twice or more; ids: equal for equal words."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    rows = np.stack([ids[i : i + n] for i in range(window)], axis=1)
    if ids.max() < 1 << 21 and window == 3:
        code = (rows[:, 0] << 42) | (rows[:, 1] << 21) | rows[:, 2]
        _, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
    else:
        _, inverse, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    hit = counts[inverse.ravel()] > 1
    covered = np.zeros(len(ids), bool)
    for i in range(window):
        covered[i : i + n] |= hit
    return int(covered.sum())


def measure(text: str | None) -> tuple:
    b = (text or "").encode("utf-8", "surrogatepass")
    words = b.split()
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    chars = len(b.translate(None, _BLANK + _NOT_START))
    without = lambda s: len(b) - len(b.translate(None, s))
    symbols = without(b"#*$%&|<>")
    lines = [x for x in b.split(b"\n") if x.split()]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeated_words(ids)
    n, share = len(words), lambda a, b: a / b if b else 0.0
    marks = len(b.translate(None, _PLAIN))
    wordless = sum(1 for w in seen if not w.translate(None, _PLAIN.translate(None, _LETTER + bytes(range(128, 256))) + b"#*$%&|<>!?()[]{}/\\_+=~^@")) if n else 0
    values = (share(symbols, chars), share(without(_CAPITAL), without(_LETTER)), share(marks, chars), share(dup_lines, len(lines)), share(repeats, n), share(wordless, max(len(seen), 1)))
    return n, chars, symbols, dup_lines, repeats, *values


def _measure_batches(batches):
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    for batch in batches:
        rows = [measure(x.as_py()) for x in batch.column("text")]
        cols = list(zip(*rows, strict=True)) or [()] * (len(names) - 2)
        types = [pa.int64()] * 5 + [pa.float64()] * len(RULES)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("lang").cast(pa.string()), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)


def measures(docs: DataFrame) -> DataFrame:
    """Counts and rule values of every whole text."""
    return docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(_measure_batches, SCHEMA)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of the binomial distribution, exact up to floating point."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1)
    lg = np.array([math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1) for x in i])
    return float(min(1.0, np.exp(lg + i * math.log(p) + (n - i) * math.log1p(-p)).sum()))


def _level(c):
    return sum((F.when(c >= g, 1).otherwise(0) for g in GRID), F.lit(0))


def _paths(batches):
    """For each stratum's histograms the cutoff levels of each step and rule, one after another."""
    for b in batches:
        out = []
        for hist in b.column("hist").to_pylist():
            of = {r: np.zeros(len(GRID) + 2, np.int64) for r in RULES}
            for x in hist:
                of[x["rule"]][x["level"]] += x["n"]
            path = []
            for a, margin in STEPS:
                for r in RULES:
                    above = of[r][::-1].cumsum()[::-1]  # rejected if the cutoff is this level
                    ok = np.flatnonzero(above <= math.floor(a / len(RULES) * of[r].sum()))
                    path.append(int(max(ok[0], 1)) + margin)
            out.append(path)
        yield pa.RecordBatch.from_arrays([b.column("stratum"), pa.array(out, pa.list_(pa.int32()))], ["stratum", "path"])


def _chosen(level: float, max_false_rejection: float):
    """For each tested stratum the last step before the first whose bound fails, with the cutoff of each rule (null: none)."""

    def run(batches):
        for b in batches:
            rows = []
            for stratum, path, n, k in zip(*(b.column(c).to_pylist() for c in ("stratum", "path", "n", "k")), strict=True):
                step = next((i for i in range(len(STEPS)) if binomial_tail(k[i], n, max_false_rejection) > level), len(STEPS)) - 1
                if step >= 0:
                    levels = path[step * len(RULES) : (step + 1) * len(RULES)]
                    rows.append((stratum, step, n, k[step], *(GRID[x - 1] if x <= len(GRID) else None for x in levels)))
            cols = list(zip(*rows, strict=True)) or [()] * (4 + len(RULES))
            types = [pa.string(), pa.int32(), pa.int64(), pa.int64()] + [pa.float64()] * len(RULES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["stratum", "step", "n", "rejected", *(f"c_{r}" for r in RULES)])

    return run


def cutoffs(measured: DataFrame, labels: DataFrame, max_false_rejection: float = 0.05, error: float = 0.05) -> DataFrame:
    """One row for each stratum with cutoffs: stratum, step, n, rejected (of the holdout's n) and c_<rule>. Uses all labels; strata are rows
    of a table, and only their number reaches the driver."""
    quality = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    good = stash(
        measured.filter(~F.col("base_failed")).join(quality.filter("quality = 1"), "doc_id").select(
            F.coalesce("lang", F.lit("none")).alias("stratum"), (F.abs(F.xxhash64(F.col("doc_id"), F.lit("half"))) % 2).alias("half"), *[_level(F.col(f"v_{r}")).alias(r) for r in RULES]
        ),
        "rules-good",
    )
    design = good.filter("half = 0").select("stratum", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("level")) for r in RULES])).alias("x"))
    hist = design.groupBy("stratum", "x.rule", "x.level").agg(F.count("*").alias("n")).groupBy("stratum").agg(F.collect_list(F.struct("rule", "level", "n")).alias("hist"))
    paths = stash(hist.mapInArrow(_paths, "stratum string, path array<int>"), "rules-paths")
    at = lambda i, j: F.element_at("path", i * len(RULES) + j + 1)
    hit = lambda i: F.greatest(*[(F.col(r) >= at(i, j)).cast("int") for j, r in enumerate(RULES)])
    tested = good.filter("half = 1").join(paths, "stratum").groupBy("stratum").agg(F.count("*").alias("n"), F.array(*[F.sum(hit(i)) for i in range(len(STEPS))]).alias("k"))
    schema = "stratum string, step int, n long, rejected long, " + ", ".join(f"c_{r} double" for r in RULES)
    return stash(paths.join(tested, "stratum").select("stratum", "path", "n", "k").mapInArrow(_chosen(error / max(1, paths.count()), max_false_rejection), schema), "rules-cutoffs")


def quality_rules(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """One row per document: counts, base_failed, the first rule at its cutoff (null: none) and kept."""
    measured = stash(measures(docs), "rules").withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    chosen = cutoffs(measured, labels, **how).select("stratum", *[f"c_{r}" for r in RULES])
    failed = F.coalesce(*[F.when(F.col(f"v_{r}") >= F.col(f"c_{r}"), F.lit(r)) for r in RULES])
    judged = measured.withColumn("stratum", F.coalesce("lang", F.lit("none"))).join(chosen, "stratum", "left").withColumn("failed_rule", failed)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("failed_rule").isNull()).alias("kept"), "failed_rule")
