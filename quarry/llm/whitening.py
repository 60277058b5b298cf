"""Embedding whitening by spectrum slicing.

The covariance is gathered in Spark over the distinct vectors, as exact integers: a first pass
adds up the vectors, a second one centres them at the rounded mean and multiplies, each task
sends its sums once. What remains is a matrix of dimensions x dimensions, all that the driver
ever sees.

There the number of positive pivots of an LDL^T factorisation of V - s*I counts the eigenvalues
above s (the law of inertia). Bisection by such counts isolates each leading eigenvalue;
Rayleigh quotient iteration then finds it with cubic convergence, and two more counts, just
above and just below it, certify its number. Eigenvalues too close to be told apart in double
precision share one subspace, found by inverse iteration of a block.

The rows are projected in Spark, and the covariance of what came out is measured against the
identity in one more pass over the distinct vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import load, materialize, shared_dir

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Components whose eigenvalue is at most this share of the trace are rounding and are left out.
LEAST = 1e-11
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
EXACT = pa.decimal128(38, 0)
BUNCH = (1 + 17**0.5) / 8


def quantized(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): floor(64 * c) + 1,000,000 of each entry, for vectors that are not null and hold no
    null or non-finite entry. Shorter vectors are filled up with the x of zero."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    x = vectors.where(F.col("embedding").isNotNull() & finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE).cast("long") + OFFSET).alias("x"))
    size = x.agg(F.max(F.size("x")).alias("most"), F.min(F.size("x")).alias("least")).first()
    if size["most"] == size["least"]:
        return x
    return x.withColumn("x", F.concat("x", F.array_repeat(F.lit(OFFSET).cast("long"), F.lit(size["most"]) - F.size("x"))))


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(rows, -1)


def _exact(values: list[int]) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], EXACT)


def sums(fit: DataFrame) -> list[int]:
    """Exact sums of the dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0), batch.num_rows)
                high, low = x >> 32, x & 0xFFFFFFFF  # halves, so that no sum of a batch overflows
                part = high.sum(axis=0).astype(object) * (1 << 32) + low.sum(axis=0).astype(object)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(total)), pa.int32()), "v": _exact(list(total))})

    rows = fit.select("x").mapInArrow(run, "i int, v decimal(38,0)").groupBy("i").agg(F.sum("v").alias("v")).collect()
    return [int(r["v"]) for r in sorted(rows)]


def products(fit: DataFrame, centre: list[int]) -> np.ndarray:
    """Exact sums of products of the vectors less ``centre``, as a matrix of Python integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, middle = None, np.array(centre, np.int64)
        for batch in batches:
            if batch.num_rows:
                z = _matrix(batch.column(0), batch.num_rows) - middle
                if float(np.abs(z.astype(float)).max()) ** 2 * len(z) < 2**53:
                    f = z.astype(float)  # sums of products are exact in doubles
                    part = (f.T @ f).astype(np.int64).astype(object)
                else:
                    part = z.astype(object).T @ z.astype(object)
                total = part if total is None else total + part
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "v": _exact(list(total[i, j]))})

    rows = fit.select("x").mapInArrow(run, "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((len(centre), len(centre)), object)
    for r in rows:
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = int(r["v"])
    return out


def covariance(fit: DataFrame, n: int, total: list[int]) -> np.ndarray:
    """Covariance with divisor n, each entry the double nearest to the exact value: products around the
    rounded mean, less what the rounding shifted, in whole numbers up to the last division."""
    centre = [(2 * s + n) // (2 * n) for s in total]
    rest = np.array([s - n * c for s, c in zip(total, centre, strict=True)], object)
    exact = products(fit, centre) * n - np.outer(rest, rest)
    return np.array([[v / (n * n) for v in row] for row in exact], float)


def positives(matrix: np.ndarray, shift: float) -> int:
    """Number of eigenvalues above ``shift``: positive pivots of LDL^T with Bunch-Kaufman pivoting."""
    a = matrix - shift * np.eye(len(matrix))
    count, k, d = 0, 0, len(a)
    while k < d:
        column = np.abs(a[k + 1 :, k])
        least, most = abs(a[k, k]), column.max(initial=0.0)
        width, take = 1, k
        if max(least, most) == 0:
            k += 1
            continue
        if least < BUNCH * most:
            r = k + 1 + int(column.argmax())
            row = np.abs(a[r, k:])
            row[r - k] = 0
            if least * row.max() < BUNCH * most * most:
                take = r
                width = 1 if abs(a[r, r]) >= BUNCH * row.max() else 2
        at = k + width - 1
        if take != at:
            a[[at, take]] = a[[take, at]]
            a[:, [at, take]] = a[:, [take, at]]
        rest = k + width
        if width == 1:
            count += a[k, k] > 0
            a[rest:, rest:] -= np.outer(a[rest:, k], a[rest:, k] / a[k, k])
        else:
            count += 1  # a block that had to be taken whole has one pivot of either sign
            a[rest:, rest:] -= a[rest:, k:rest] @ np.linalg.solve(a[k:rest, k:rest], a[k:rest, rest:])
        k = rest
    return int(count)


class Slices:
    """Counts of eigenvalues above shifts, each taken once, and brackets made of them."""

    def __init__(self, matrix: np.ndarray):
        radius = np.abs(matrix).sum(axis=1)
        self.matrix, self.norm = matrix, float(radius.max())
        reach = self.norm * (1 + 1e-9) + np.finfo(float).tiny
        self.counts = {-reach: len(matrix), reach: 0}

    def above(self, shift: float) -> int:
        if shift not in self.counts:
            self.counts[shift] = positives(self.matrix, shift)
        return self.counts[shift]

    def bracket(self, i: int, tight: bool = False) -> tuple[float, float]:
        """The narrowest known (low, high) with the i-th eigenvalue between; halved until no other one
        is inside, or until doubles end. ``tight`` halves once more at least."""
        smallest = 64 * np.finfo(float).eps * self.norm
        while True:
            low = max(s for s, c in self.counts.items() if c >= i)
            high = min(s for s, c in self.counts.items() if c < i)
            alone = self.counts[low] == i and self.counts[high] == i - 1
            if (alone and not tight) or high - low <= smallest:
                return low, high
            self.above((low + high) / 2)
            tight = False


def _toward(shifted: np.ndarray, v: np.ndarray, aside: float) -> np.ndarray:
    """A step of inverse iteration, of unit length; where the shift is an eigenvalue to the last digit
    it is taken a little beside it."""
    try:
        w = np.linalg.solve(shifted, v)
    except np.linalg.LinAlgError:
        w = np.full(len(v), np.inf)
    if not np.abs(w).max() < 1e100:
        w = np.linalg.solve(shifted - aside * np.eye(len(v)), v)
    return w / np.linalg.norm(w)


def rayleigh(matrix: np.ndarray, shift: float, start: np.ndarray, norm: float) -> tuple[float, np.ndarray]:
    """Rayleigh quotient iteration, after two steps at a fixed shift that turn the start towards the
    eigenvalue next to it."""
    v, eye = start, np.eye(len(matrix))
    best = (np.inf, shift, v)
    for step in range(40):
        v = _toward(matrix - shift * eye, v, 4 * np.finfo(float).eps * norm)
        value = float(v @ matrix @ v)
        residual = float(np.linalg.norm(matrix @ v - value * v))
        if residual < best[0]:
            best = (residual, value, v)
        elif step > 3:
            break
        if step >= 2:
            shift = value
    return best[1], best[2]


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest eigenvalues, falling, and their unit eigenvectors as columns. Raises ArithmeticError
    where the counts do not certify a number."""
    d = len(matrix)
    k = min(k, d)
    if not matrix.any():
        return np.zeros(k), np.eye(d)[:, :k]
    slices = Slices(matrix)
    margin = 32 * np.finfo(float).eps * slices.norm
    values, vectors = [], []
    start = np.cos(np.arange(1, d + 1) ** 2.0)  # no symmetry that an eigenvector could be at right angles to
    while len(values) < k:
        i = len(values) + 1
        low, high = slices.bracket(i)
        alone = slices.above(low) == i and slices.above(high) == i - 1
        if alone:
            value, v = rayleigh(matrix, (low + high) / 2, start / np.linalg.norm(start), slices.norm)
            while not low < value < high and high - low > 2 * margin:  # ended at another eigenvalue
                low, high = slices.bracket(i, tight=True)
                value, v = rayleigh(matrix, (low + high) / 2, start / np.linalg.norm(start), slices.norm)
            found = [(value, v)]
        else:  # eigenvalues i to m cannot be told apart
            m = slices.above(low)
            middle = (low + high) / 2
            block = np.cos(np.outer(np.arange(1, d + 1) ** 2.0, np.arange(1, m - i + 2)))
            for _ in range(4):
                if vectors:
                    block = block - np.array(vectors).T @ (np.array(vectors) @ block)
                block = np.linalg.qr(np.linalg.solve(matrix - (middle + margin / 16) * np.eye(d), block))[0]
            found = [(middle, block[:, j]) for j in range(m - i + 1)]
        for value, v in found[: k - len(values)]:
            if vectors:
                before = np.array(vectors)
                v = v - before.T @ (before @ v)
                v = v / np.linalg.norm(v)
            values.append(value)
            vectors.append(v)
        last = i + len(found) - 1
        width = margin if alone else high - low + margin
        if slices.above(found[0][0] + width) > i - 1 or slices.above(found[-1][0] - width) < last:
            raise ArithmeticError(f"the counts do not certify eigenvalue {i}")
    return np.array(values), np.array(vectors).T


def _deviations(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n*x - S, exact."""
    if n * float(np.abs(x.astype(float)).max(initial=0)) + max(map(abs, total), default=0) < 2**62:
        return n * x - np.array(total, np.int64)
    return n * x.astype(object) - np.array(total, object)


def _squares(z: np.ndarray) -> pa.Array:
    """Sums of squares of the rows, exact."""
    if float(np.abs(z.astype(float)).max(initial=0)) ** 2 * z.shape[1] < 2**62:
        return pa.array((z.astype(np.int64) ** 2).sum(axis=1))
    sums_ = [int(s) for s in (z.astype(object) ** 2).sum(axis=1)]
    if max(sums_) >= 2**63:
        raise ArithmeticError("a deviation does not fit into 64 bits")
    return pa.array(sums_, pa.int64())


def identity_error(fit: DataFrame, n: int, total: list[int], weights: np.ndarray) -> float:
    """Largest absolute entry of the covariance of the whitened fit list less the identity. Whitened
    values are centred already, so products and sums come in one pass."""
    k = weights.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total_ = np.zeros((k + 1, k))
        for batch in batches:
            if batch.num_rows:
                w = (_deviations(_matrix(batch.column(0), batch.num_rows), n, total).astype(float) / n) @ weights
                total_ += np.vstack([w.T @ w, w.sum(axis=0)])
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(total_.size), pa.int32()), "v": pa.array(total_.reshape(-1))})

    rows = fit.select("x").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    got = np.array([r["v"] for r in sorted(rows)]).reshape(k + 1, k) / n
    return float(np.abs(got[:k] - np.outer(got[k], got[k]) - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS, where: str | None = None) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): one row for each row of
    ``vectors`` (vec_id, embedding) and component, as many as there are dimensions and components.

    Vectors that are null or hold a null or non-finite entry take no part; rows without an id and
    rows that share one do, each by itself. A vector that is shorter than the longest is filled
    up with zeros. A component whose eigenvalue is not above LEAST of the trace (all of them for
    fewer than two different vectors) is left out, so an empty table gives no rows. Eigenvalues
    equal to the last digits come in any order. Entries beyond the 64-bit range of x and
    deviations beyond 64 bits raise an arithmetic error. Other columns are not read."""
    spark = vectors.sparkSession
    where = where or shared_dir(spark)
    rows = quantized(vectors)
    fit = materialize(rows.select("x").distinct(), where, "fit")
    n = fit.count()
    total = sums(fit) if n else []
    if n < 2 or not total:
        return spark.createDataFrame([], RESULT)
    matrix = covariance(fit, n, total)
    trace = float(np.trace(matrix))
    values, axes = leading(matrix, components)
    kept = values > LEAST * trace
    values, axes = values[kept], axes[:, kept]
    if not len(values):
        return spark.createDataFrame([], RESULT)
    weights, explained = axes / np.sqrt(values), values / trace
    k, error = len(values), identity_error(fit, n, total, weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                z = _deviations(_matrix(part.column(1), part.num_rows), n, total)
                each = np.repeat(np.arange(part.num_rows), k)
                yield pa.RecordBatch.from_pydict(
                    {
                        "vec_id": part.column(0).take(pa.array(each)),
                        "component": pa.array(np.tile(np.arange(1, k + 1), part.num_rows), pa.int32()),
                        "n": pa.array(np.full(len(each), n), pa.int64()),
                        "deviation": _squares(z).take(pa.array(each)),
                        "whitened": pa.array(((z.astype(float) / n) @ weights).reshape(-1)),
                        "explained": pa.array(np.tile(explained, part.num_rows)),
                        "identity_error": pa.array(np.full(len(each), error)),
                    }
                )

    return rows.select("vec_id", "x").mapInArrow(run, RESULT)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(load(spark, sf_dir, "embeddings"))
