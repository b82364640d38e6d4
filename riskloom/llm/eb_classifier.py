"""A quality classifier with hierarchical empirical Bayes.

Two heads, toxic and low quality, give each document evidence: a log likelihood ratio from the
features present in its whole text. Features are hashed words in lower case and levels of shares (symbols, capitals, marks, repeated lines and words, length). A word
counts only where it speaks for the bad class by a factor of 4 and beyond chance (z of 6 or more); a ridge logistic regression then
weighs the words' sum and the levels. They are fitted on at most `max_labelled` labelled rows, the
first by a hash of their id. Then all documents count: a host's rate of bad documents is the mean of their posteriors, shrunk
towards the global rate; a path's rate is shrunk towards its host's. The strength of shrinking is the spread between hosts beyond
sampling noise, by the method of moments. A document's posterior joins its evidence and its path's rate.

For documents the host is `source` and the path is source and `lang`. Null host or path: a group of their own. Null text: no words,
judged by its levels and path. Labels with null id or values are left out; several labels of one id count as the worst. Without
labels nothing is rejected. Very long texts are read whole. Repeated rows are rows of their own, each counted in its path and judged alike; a
posterior of just 0.5 is kept. An empty table gives no rows. Further columns aren't read, and
`keep_good` returns them as they were, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import stash
from .textops import LOWER, text_bytes, word_hashes

WORD_BITS = 17
LEVELS = tuple(0.01 * 1.5**i for i in range(11))
SHARES = 7
N_FEATURES = (1 << WORD_BITS) + SHARES * (len(LEVELS) + 1)
HEADS = ("toxic", "low")
BROADCAST_PATHS = 100_000

_SYMBOL, _CAPITAL, _LETTER, _MARK, _SPACE = (np.zeros(256, bool) for _ in range(5))
_SYMBOL[list(b"#*$%&|<>")] = True
_CAPITAL[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True
_SPACE[list(b" \t\n\x0b\x0c\r")] = True


def features(text: np.ndarray) -> np.ndarray:
    """Distinct feature numbers of one whole text."""
    said = (word_hashes(LOWER[text]) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    words = np.unique(said)
    counts = np.bincount(text, minlength=256)
    share = lambda a, b: a / b if b else 0.0
    letters, solid = counts[_LETTER].sum(), counts[~_SPACE].sum()
    lines = bytes(text).split(b"\n")
    shares = (share(counts[_SYMBOL].sum(), solid), share(counts[_CAPITAL].sum(), letters), share(counts[_MARK].sum(), solid), share(len(lines) - len(set(lines)), len(lines)), share(counts[ord("!")], solid), 1 - share(len(words), len(said)), len(said) / 2000)
    at = 1 << WORD_BITS
    return np.concatenate((words, [at + i * (len(LEVELS) + 1) + int(np.searchsorted(LEVELS, s, "right")) for i, s in enumerate(shares)]))


def _texts(batch):
    data, offsets, _ = text_bytes(batch.column("text"))
    return (data[offsets[i] : offsets[i + 1]] for i in range(batch.num_rows))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> dict:
    """Weights of both heads (arrays over the features), their rates and bases; what reaches the driver has one row per feature at most."""
    worst = labels.filter("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"), F.max(1 - F.col("quality")).cast("int").alias("low"))
    some = worst.orderBy(F.xxhash64("doc_id", F.lit("fit")), "doc_id").limit(max_labelled)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id")  # at most max_labelled rows

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("toxic"), b.column("low"), pa.array([features(t) for t in _texts(b)], pa.list_(pa.int64()))], ["toxic", "low", "f"])

    seen = stash(rows.select("toxic", "low", "text").mapInArrow(run, "toxic int, low int, f array<long>"), "eb-fit")
    n, n_toxic, n_low = seen.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum("low"), F.lit(0))).first()
    counts = seen.select("toxic", "low", F.explode("f").alias("f")).groupBy("f").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"), F.sum("low").alias("low")).toArrow()
    of = counts["f"].to_numpy()
    total = np.zeros(N_FEATURES)
    total[of] = counts["n"].to_numpy()
    n_words = 1 << WORD_BITS
    words = {}
    for head, bad in (("toxic", n_toxic), ("low", n_low)):
        a = np.zeros(N_FEATURES)
        a[of] = counts[head].to_numpy()
        b, good = total - a, n - bad
        p, q, mid = (a + 0.5) / (bad + 1), (b + 0.5) / (good + 1), (total + 1) / (n + 2)
        z = (p - q) / np.sqrt(mid * (1 - mid) * (1 / (bad + 1) + 1 / (good + 1)))
        w = np.where((z >= 6) & (total >= 5) & (p > 4 * q), np.log(p / q), 0.0)
        w[n_words:] = 0
        words[head] = w

    def reduce(batches):
        for b in batches:
            f = [x.values.to_numpy() for x in b.column("f")]
            levels = [np.flatnonzero(np.bincount(x[x >= n_words] - n_words, minlength=N_FEATURES - n_words)).tolist() for x in f]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), b.column("low"), *(pa.array([float(words[h][x].sum()) for x in f]) for h in HEADS), pa.array(levels, pa.list_(pa.int64()))], ["toxic", "low", "w_toxic", "w_low", "levels"])

    rows = seen.mapInArrow(reduce, "toxic int, low int, w_toxic double, w_low double, levels array<long>").toArrow()  # at most max_labelled rows
    hot = np.zeros((rows.num_rows, N_FEATURES - n_words))
    for i, x in enumerate(rows["levels"].to_pylist()):
        hot[i, x] = 1
    out = {"n": n}
    for head, bad in (("toxic", n_toxic), ("low", n_low)):
        weights, base, rate = np.zeros(N_FEATURES, np.float32), 0.0, bad / n if n else 0.0
        if 0 < bad < n:
            c = _logistic(np.column_stack([np.minimum(rows[f"w_{head}"].to_numpy(), 12), hot, np.ones(n)]), rows[head].to_numpy())
            weights = (words[head] * c[0]).astype(np.float32)
            weights[n_words:] = c[1:-1]
            base = float(c[-1]) - math.log(rate / (1 - rate))
        out[head] = {"weights": weights, "base": base, "rate": float(rate)}
    return out


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0) -> np.ndarray:
    """Coefficients of a ridge logistic regression, by Newton steps; the last column, the base, isn't held down."""
    c, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], l2)
    ridge[-1] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9), x.T @ (y - p) - ridge * c)
        c += step
        if np.abs(step).max() < 1e-6:
            break
    return c


def evidence(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """The columns in keep, and the evidence of each head."""
    sent = docs.sparkSession.sparkContext.broadcast({h: (model[h]["weights"], model[h]["base"]) for h in HEADS})
    source = docs.withColumn("__text", F.coalesce(F.col("text").cast("string"), F.lit(""))).select(*keep, "__text")
    schema = StructType([f for f in source.schema if f.name != "__text"] + [StructField(f"__e_{h}", DoubleType()) for h in HEADS])

    def run(batches):
        for b in batches:
            data, offsets, _ = text_bytes(b.column("__text"))
            e = {h: [] for h in HEADS}
            for i in range(b.num_rows):
                f = features(data[offsets[i] : offsets[i + 1]])
                for h in HEADS:
                    w, base = sent.value[h]
                    e[h].append(float(w[f].sum()) + base)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(e[h], pa.float64()) for h in HEADS)], [*keep, *(f"__e_{h}" for h in HEADS)])

    return source.mapInArrow(run, schema)


def _sigmoid(c):
    return 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), c))))


def _logit(c):
    c = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), c))
    return F.log(c / (1 - c))


def path_rates(scored: DataFrame, model: dict) -> DataFrame:
    """host, path and each head's shrunk rate; grouped sums over all documents."""
    rows = scored
    for h in HEADS:
        rate = min(1 - 1e-6, max(1e-6, model[h]["rate"]))
        rows = rows.withColumn(f"p_{h}", _sigmoid(F.col(f"__e_{h}") + math.log(rate / (1 - rate))))
    paths = stash(rows.groupBy("host", "path").agg(F.count("*").alias("n"), *[F.sum(f"p_{h}").alias(f"s_{h}") for h in HEADS]), "eb-paths")
    hosts = stash(paths.groupBy("host").agg(F.sum("n").alias("hn"), *[F.sum(f"s_{h}").alias(f"hs_{h}") for h in HEADS]), "eb-hosts")
    total = hosts.agg(F.count("*").alias("k"), F.coalesce(F.sum("hn"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("hn") * F.col("hn")), F.lit(0)).alias("n2"), *[F.coalesce(F.sum(f"hs_{h}"), F.lit(0.0)).alias(h) for h in HEADS]).first()
    strength, mean = {}, {}
    for h in HEADS:
        m = mean[h] = total[h] / total["n"] if total["n"] else 0.0
        ss = hosts.agg(F.coalesce(F.sum(F.col("hn") * F.pow(F.col(f"hs_{h}") / F.col("hn") - m, 2)), F.lit(0.0))).first()[0]
        k, n = total["k"], total["n"]
        spread = (ss - (k - 1) * m * (1 - m)) / max(1e-9, n - total["n2"] / max(n, 1)) if k > 1 else 0.0
        strength[h] = min(1e4, max(5.0, m * (1 - m) / spread - 1 if spread > 0 else 1e4))
    out = paths.join(hosts, paths["host"].eqNullSafe(hosts["host"])).select(
        paths["host"].alias("__host"), paths["path"].alias("__path"),
        *[((F.col(f"s_{h}") + strength[h] * (F.col(f"hs_{h}") + strength[h] * mean[h]) / (F.col("hn") + strength[h])) / (F.col("n") + strength[h])).alias(f"__r_{h}") for h in HEADS],
    )
    return stash(out, "eb-rates")


def score(docs: DataFrame, labels: DataFrame, host, path, keep: list[str], max_labelled: int = 20_000) -> DataFrame:
    """The columns in keep, each head's evidence, path rate and posterior, and kept."""
    model = fit(docs, labels, max_labelled)
    named = docs.withColumn("__h", host).withColumn("__p", path)
    light = stash(evidence(named, model, ["__h", "__p"]).withColumnsRenamed({"__h": "host", "__p": "path"}), "eb-evidence")
    rates = path_rates(light, model)
    if rates.count() <= BROADCAST_PATHS:
        rates = F.broadcast(rates)
    out = evidence(named, model, [*keep, "__h", "__p"]).join(rates, F.col("__h").eqNullSafe(F.col("__host")) & F.col("__p").eqNullSafe(F.col("__path")), "left")
    for h in HEADS:
        out = out.withColumn(f"p_{h}", _sigmoid(F.col(f"__e_{h}") + _logit(F.col(f"__r_{h}"))) if model[h]["rate"] else F.lit(0.0))
    return out.withColumn("kept", F.greatest(*[F.col(f"p_{h}") for h in HEADS]) <= 0.5)


def classify(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, evidence, path rate and posterior of each head, kept."""
    out = score(docs, labels, F.col("source").cast("string"), F.col("lang").cast("string"), ["doc_id"], **how)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.round(F.col(f"{p}{h}"), 6).alias(f"{q}_{h}") for h in HEADS for p, q in (("__e_", "evidence"), ("__r_", "path_rate"), ("p_", "posterior"))], "kept")


def keep_good(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The documents that the classifier keeps, with their columns."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "source", "lang")  # a struct: its names can't clash
    return score(rows, labels, F.col("source").cast("string"), F.col("lang").cast("string"), ["row"], **how).filter("kept").select("row.*")

