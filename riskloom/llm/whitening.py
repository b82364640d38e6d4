"""Whitening of embeddings by mixed-precision refinement of eigenvectors.

Sums and products are gathered by Spark: each Arrow batch gives partial sums for each entry of the mean and of the covariance, and
group-bys add them up. What reaches the driver is bounded by the dimension alone (its square, for at most MAX_DIMENSION dimensions), never
by the number of vectors. There the symmetric covariance is decomposed in float32, and its eigenvectors are corrected in float64 by
Ogita-Aishima iterations: products of matrices only, each of which about doubles the number of right digits. Eigenvalues that lie too close
for that (closer than the error bound) form a cluster, for which the iteration only restores orthogonality; the small problem that the
cluster's vectors span, shifted by its mean eigenvalue, is solved in float64 and turns the vectors within their span.

x = floor(64 c) + 1000000 is exact in a long. Means are split into whole part and rest, so that x is centred without loss before anything
is multiplied. `deviation` is exact; where it exceeds a long, it is null. Components are numbered by falling eigenvalue; an eigenvector's
sign makes its largest entry (the first of equal ones) positive, so all rows agree.

Rows: null vectors and such with null or non-finite entries are dropped. All others must be of one length to be compared: the most common
one, the greatest of equally common; other lengths, empty vectors and vectors with an entry whose x doesn't fit a long are dropped too.
Rows with equal or null ids, and repeated rows, each count and are each returned. A component whose eigenvalue is zero to rounding (fewer
vectors than dimensions, constant entries) has null `whitened`, explained 0, and no part in identity_error, which is 0 if all are such.
An empty table gives an empty result. Very long vectors (over MAX_DIMENSION entries) are an error. Further columns are never read,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 32
MAX_DIMENSION = 4096  # its covariance takes 128 MB on the driver
SCALE, SHIFT = 64, 1_000_000
SWEEPS = 12
_LARGEST = float(1 << 62)


# ---------------------------------------------------------------- eigenvectors


def refine(a: np.ndarray, x: np.ndarray, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and eigenvectors of symmetric a in its precision, from approximate eigenvectors x."""
    a = np.asarray(a)
    d, kind = len(a), a.dtype
    x = x.astype(kind)
    norm = max(np.abs(a).sum(1).max(), np.finfo(kind).tiny)
    one = np.eye(d, dtype=kind)
    e, before = np.diag(x.T @ a @ x).copy(), np.inf
    for _ in range(sweeps):
        rest = one - x.T @ x
        s = x.T @ a @ x
        e = np.diag(s) / (1 - np.diag(rest))
        off = s - np.diag(e)
        bound = 2 * (np.linalg.norm(off, 2) + norm * np.linalg.norm(rest, 2))
        bound = max(bound, 4 * np.finfo(kind).eps * norm)
        gap = e[None, :] - e[:, None]
        far = np.abs(gap) > bound
        step = np.where(far, (s + e[None, :] * rest) / np.where(far, gap, 1), rest / 2)
        x = x + x @ step
        turned = _sub_solves(a, x, e, bound)
        size = max(np.abs(step).max(), turned)
        if size < 8 * np.finfo(kind).eps or size >= before / 2 and size < 1e-9:
            break
        before = size
    for _ in range(2):  # steps between close eigenvalues are large, their squares are left in x^T x
        x = x + x @ ((one - x.T @ x) / 2)
    e = np.einsum("ij,ij->j", x, a @ x) / np.einsum("ij,ij->j", x, x)
    order = np.argsort(-e, kind="stable")
    return e[order], x[:, order]


def _sub_solves(a: np.ndarray, x: np.ndarray, e: np.ndarray, bound: float) -> float:
    """Turns the vectors of each cluster within their span, in place; how far it turned them at most."""
    order, turned = np.argsort(e), 0.0
    cuts = np.flatnonzero(np.diff(e[order]) > bound) + 1
    for group in np.split(order, cuts):
        if len(group) < 2:
            continue
        own = x[:, group]
        inner = own.T @ (a @ own - own * e[group].mean())
        inner = (inner + inner.T) / 2
        scale = np.abs(np.diag(inner)).max()
        if np.abs(inner - np.diag(np.diag(inner))).max() <= np.finfo(a.dtype).eps * max(scale, bound):
            continue  # they stand already
        _, turn = np.linalg.eigh(inner)
        x[:, group] = own @ turn
        turned = max(turned, np.abs(np.abs(turn) - np.eye(len(group))[np.abs(turn).argmax(0)].T).max())
    return float(turned)


def eigenvectors(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors (columns) of a covariance: float32 first, then refined in float64."""
    scale = np.abs(cov).max()
    if not scale > 0:
        return np.zeros(len(cov)), np.eye(len(cov))
    _, rough = np.linalg.eigh((cov / scale).astype(np.float32))
    e, x = refine(cov / scale, rough)
    top = np.abs(x).argmax(0)
    return e * scale, x * np.sign(x[top, np.arange(len(x))])


# ---------------------------------------------------------------- sums over all vectors


def _vectors(table: DataFrame) -> DataFrame:
    """(vec_id, x): the rows that remain of one length or another, entries as double."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    fits = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < _LARGEST / SCALE)
    return rows.filter("x is not null and size(x) > 0").filter(F.forall("x", fits))


def _matrix(column, d: int) -> np.ndarray:
    """Whole numbers x of an Arrow column of vectors of d entries."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)).astype(np.int64) + SHIFT


class Fit:
    """n, S, and after the second pass the eigenvectors and eigenvalues; small, of the dimension's square at most."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums, self.d = n, sums, len(sums)
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([(s % n) / n for s in sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact sum of (n x - S)^2 over each row."""
        y = x - self.whole
        rest = np.array([s % self.n for s in self.sums], np.int64)
        most = int(np.abs(y).max(initial=0)) + 1
        if (most * self.n) ** 2 * self.d < 1 << 62:
            return ((y * self.n - rest) ** 2).sum(1).tolist()
        out = [sum((self.n * v - r) ** 2 for v, r in zip(row, rest.tolist(), strict=True)) for row in y.tolist()]
        return [v if v < 1 << 63 else None for v in out]

    def solve(self, cov: np.ndarray, components: int) -> None:
        e, u = eigenvectors(cov)
        trace = float(np.trace(cov))
        self.explained = [max(float(v), 0.0) / trace if trace > 0 else 0.0 for v in e[:components]]
        self.used = e[:components] > 1e-12 * max(float(e[0]), 0.0) * self.d  # the others are zero to rounding
        self.turn = u[:, :components] / np.sqrt(np.where(self.used, e[:components], 1))

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.turn


def _triangle(rows: DataFrame, d: int, of) -> np.ndarray:
    """Sum over all rows of z z^T, z = of(x), as a full matrix; partial sums of each Arrow batch are added up by Spark."""

    def run(batches):
        total = None
        for b in batches:
            z = of(_matrix(b.column("x"), d))
            total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            i, j = np.tril_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "v"])

    got = rows.select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    i, j, v = (got[c].to_numpy() for c in ("i", "j", "v"))
    size = int(i.max()) + 1
    out = np.zeros((size, size))
    out[i, j] = out[j, i] = v
    return out


def fit(rows: DataFrame, components: int = COMPONENTS) -> tuple[Fit | None, float]:
    """The fit over all rows of the most common length, and the measured identity_error; none for an empty table."""
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return None, 0.0
    d = common["d"]
    if d > MAX_DIMENSION:
        raise ValueError(f"vectors of {d} entries; at most {MAX_DIMENSION}")
    rows = rows.filter(F.size("x") == d)

    def sums(batches):
        total, n = [0] * d, 0
        for b in batches:
            x = _matrix(b.column("x"), d)
            if not len(x):
                continue
            exact = x if int(np.abs(x).max()) < (1 << 62) // len(x) else x.astype(object)
            total = [t + int(v) for t, v in zip(total, exact.sum(0).tolist(), strict=True)]
            n += len(x)
        if n:
            digits = pa.decimal128(38, 0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(total).cast(digits) if max(map(abs, total)) < 1 << 63 else pa.array([_decimal(t) for t in total], digits), pa.array([n] * d, pa.int64())], ["i", "s", "n"])

    got = rows.select("x").mapInArrow(sums, "i int, s decimal(38,0), n long").groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("i").collect()  # one row for each dimension
    model = Fit(got[0]["n"], [int(r["s"]) for r in got])
    model.solve(_triangle(rows, d, model.centred) / model.n, components)
    z = _triangle(rows, d, lambda x: model.whitened(x)[:, model.used]) / model.n if model.used.any() else np.zeros((0, 0))
    return model, float(np.abs(z - np.eye(len(z))).max(initial=0.0))


def _decimal(v: int):
    from decimal import Decimal

    return Decimal(v)


def whitened(table: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = _vectors(table)
    model, error = fit(rows, components)
    if model is None:
        return table.sparkSession.createDataFrame([], schema)
    k = min(components, model.d)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                x = _matrix(part.column("x"), model.d)
                n, z = len(x), model.whitened(x)
                ids = part.column("vec_id").take(pa.array(np.repeat(np.arange(n), k)))
                deviation = pa.array(model.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(n), k)))
                used = np.tile(model.used, n)
                columns = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, model.n)), deviation, pa.array(z.ravel(), mask=~used), pa.array(np.tile(model.explained, n)), pa.array(np.full(n * k, error))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.filter(F.size("x") == model.d).mapInArrow(run, schema)
