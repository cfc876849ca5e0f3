"""Embedding whitening by contour integration: projections onto eigenvalue intervals of the covariance.

Every vector is put on an integer grid, so counts, sums and deviations are exact. The covariance is taken over the distinct
grid vectors. Its leading eigenpairs come from FEAST (Polizzi 2009): the range of the largest eigenvalues is cut into
intervals by inertia counts, each interval gets a circle in the complex plane, a quadrature of shifted solves along it
projects a random block onto the eigenvectors inside, and Rayleigh-Ritz takes them out. The pairs found must be as many
as the inertia counts say, or the block grows and the interval is done again.

Spark does what grows with the data: grid, distinct vectors, sums, covariance and projection. Only matrices of the
dimension's size reach the driver.

Edge cases: rows whose vector is null, or holds a null, a non-finite entry or one of 2**40 or more, are dropped, and so
are vectors of another length than most distinct vectors have (ties: the longer). Repeated rows stay in the result and
count once in the fit. Components without variance (eigenvalue within rounding of zero) are left out, as nothing can scale
them; so a single distinct vector or an empty table gives no rows. A deviation beyond a long is null. A null id is kept.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hotgrid.llm.links import stage
from hotgrid.session import discard

COMPONENTS = 16
GRID, OFFSET = 64, 1_000_000
MAX_ENTRY = float(1 << 40)
PER_INTERVAL = 6  # eigenvalues of an interval, unless they cannot be told apart
NODES = 16  # quadrature nodes on the upper half of a circle; the lower half is their mirror image
MAX_SWEEPS = 60


@dataclass(frozen=True)
class Whitener:
    """What the fit found: ``vectors`` has one unit eigenvector per row, by falling eigenvalue."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float


def on_grid(vector: Column) -> Column:
    """The vector's entries as longs on the grid."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * GRID) + F.lit(OFFSET).cast("bigint"))


def usable(vector: Column) -> Column:
    """Whether the vector has only finite entries of less than ``MAX_ENTRY``."""
    return F.coalesce(F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < MAX_ENTRY, F.lit(False)) & ~F.isnan(c)), F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column whose lists all have ``dim`` entries."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dim, n, sums) of each batch and vector length."""
    for batch in batches:
        dims = np.diff(batch.column(0).offsets.to_numpy())
        for dim in np.unique(dims):
            rows = _matrix(batch.column(0).filter(pa.array(dims == dim)), int(dim))
            out = [pa.array([int(dim)]), pa.array([len(rows)]), pa.array([rows.sum(axis=0).tolist()], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(out, ["dim", "n", "sums"])


def _summed(rows: DataFrame, work: Callable[[np.ndarray], np.ndarray], dim: int, size: int) -> np.ndarray:
    """Sum over all batches of ``work``, a function from a batch's grid vectors to a flat array of ``size`` doubles."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += work(_matrix(batch.column(0), dim))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["i", "v"])

    table = rows.mapInArrow(part, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size)
    out[table["i"].to_numpy()] = table["v"].to_numpy()
    return out


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitener:
    """Fits on the distinct grid vectors of the column ``x``; without any, there are no components."""
    distinct = stage(vectors.select("x").distinct(), "distinct_vectors")
    per = distinct.mapInArrow(_sums, "dim bigint, n bigint, sums array<bigint>").where("dim > 0")
    per = per.select("dim", "n", F.posexplode("sums").alias("i", "s")).groupBy("dim", "i")
    per = per.agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    lists = per.groupBy("dim").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "s"))).alias("sums"))
    found = lists.orderBy(F.desc("n"), F.desc("dim")).first()
    if found is None:
        discard(distinct)
        return Whitener(0, (), np.zeros(0), np.zeros((0, 0)), 0.0, 0.0)
    dim, n, sums = found["dim"], found["n"], tuple(int(r["s"]) for r in found["sums"])
    distinct_of_dim = distinct.where(F.size("x") == dim)
    mean, whole = _mean(n, sums)

    def covariance(rows: np.ndarray) -> np.ndarray:
        centred = (rows - whole) - mean
        return (centred.T @ centred).ravel()

    matrix = _summed(distinct_of_dim, covariance, dim, dim * dim).reshape(dim, dim) / n
    matrix = (matrix + matrix.T) / 2
    values, basis = leading_eigenpairs(matrix, min(components, dim))
    model = Whitener(n, sums, values, basis, float(np.trace(matrix)), 0.0)
    k = len(values)

    def moments(rows: np.ndarray) -> np.ndarray:
        w = project(model, rows)
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    flat = _summed(distinct_of_dim, moments, dim, k + k * k) / n
    discard(distinct)
    left = flat[k:].reshape(k, k) - np.outer(flat[:k], flat[:k]) - np.eye(k)
    return Whitener(n, sums, values, basis, model.trace, float(np.abs(left).max(initial=0.0)))


def _mean(n: int, sums: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The mean as a fraction below one and a whole part, so that centring loses no digits."""
    whole = np.array([s // n for s in sums], np.int64)
    return np.array([(s % n) / n for s in sums]), whole


def project(model: Whitener, rows: np.ndarray) -> np.ndarray:
    mean, whole = _mean(model.n, model.sums)
    return ((rows - whole) - mean) @ (model.vectors / np.sqrt(model.values)[:, None]).T


def _deviations(model: Whitener, rows: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n * x - S) ** 2 for each row, in whole numbers."""
    sums, top = np.array(model.sums, object), max(int(np.abs(rows).max(initial=0)), 1)
    if model.n * top < 1 << 61 and max(abs(s) for s in model.sums) < 1 << 61:
        off = model.n * rows - np.array(model.sums, np.int64)
        if len(model.sums) * int(np.abs(off).max(initial=0)) ** 2 < 1 << 62:
            return (off * off).sum(axis=1).tolist()
    exact = ((model.n * rows.astype(object) - sums) ** 2).sum(axis=1).tolist()
    return [v if v < 1 << 63 else None for v in exact]


def whiten(df: DataFrame, model: Whitener, vector: str = "x") -> DataFrame:
    """Adds ``deviation`` and ``whitened`` (one entry per component) for the grid vectors of a column."""
    dim = len(model.sums)

    @F.arrow_udf("struct<deviation:bigint,whitened:array<double>>")
    def places(column: pa.Array) -> pa.Array:
        rows = _matrix(column, dim)
        k = len(model.values)
        offsets = pa.array(np.arange(len(rows) + 1) * k, pa.int32())
        white = pa.ListArray.from_arrays(offsets, pa.array(project(model, rows).ravel()))
        return pa.StructArray.from_arrays([pa.array(_deviations(model, rows), pa.int64()), white], ["deviation", "whitened"])

    kept = df.where((F.size(vector) == dim) & F.lit(dim > 0)).withColumn("_w", places(F.col(vector)))
    return kept.withColumn("deviation", F.col("_w.deviation")).withColumn("whitened", F.col("_w.whitened")).drop("_w")


def components_of(df: DataFrame, model: Whitener) -> DataFrame:
    """One row per vector and component of ``whiten``'s output, with what the fit says about the component."""
    share = F.array(*[F.lit(float(v / model.trace)) for v in model.values]).cast("array<double>")
    long = df.select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    return long.select(
        "vec_id",
        (F.col("i") + 1).alias("component"),
        F.lit(model.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.get(share, F.col("i")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )


# --- eigenpairs of a small symmetric matrix ---


class Inertia:
    """Counts of eigenvalues above a shift: signs of the pivots of the shifted matrix, tridiagonal by reflections."""

    def __init__(self, matrix: np.ndarray):
        a = matrix.copy()
        for k in range(len(a) - 2):
            x = a[k + 1 :, k].copy()
            x[0] += np.copysign(np.linalg.norm(x), x[0])
            size = np.linalg.norm(x)
            if size:
                x /= size
                a[k + 1 :, :] -= 2 * np.outer(x, x @ a[k + 1 :, :])
                a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ x, x)
        self.diagonal, self.beside = np.diag(a).copy(), np.diag(a, -1) ** 2
        self.tiny = np.finfo(float).eps * max(np.abs(matrix).max(), np.finfo(float).tiny)

    def above(self, shift: float) -> int:
        count, pivot = 0, 1.0
        for i, d in enumerate(self.diagonal):
            pivot = d - shift - (self.beside[i - 1] / pivot if i else 0.0)
            if abs(pivot) < self.tiny:
                pivot = -self.tiny
            count += pivot > 0
        return count


def _edge(inertia: Inertia, low: float, high: float, wanted: int, step: float) -> float:
    """A shift with at least ``wanted`` eigenvalues above it, as high as halving finds it, and none within ``step`` of it."""
    while high - low > 4 * step:
        middle = (low + high) / 2
        clear = inertia.above(middle - step) == inertia.above(middle + step)
        n = inertia.above(middle)
        if clear and n == wanted:
            return middle
        if n >= wanted:
            low = middle
        else:
            high = middle
    while inertia.above(low - step) != inertia.above(low + step):
        low -= 2 * step
    return low


def _intervals(inertia: Inertia, low: float, high: float, step: float) -> list[tuple[float, float, int]]:
    """(low, high, count) of intervals of few eigenvalues each, from above; only a cluster makes a larger one."""
    out, top, done = [], high, 0
    total = inertia.above(low)
    while done < total:
        edge = max(low, _edge(inertia, low, top, min(total, done + PER_INTERVAL), step))
        n = inertia.above(edge)
        out.append((edge, top, n - done))
        top, done = edge, n
    return out


def _feast(matrix: np.ndarray, low: float, high: float, count: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in (low, high) and their vectors as columns: exactly ``count`` of them, or it raises."""
    dim = len(matrix)
    centre, radius = (low + high) / 2, (high - low) / 2
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    angles = np.pi / 2 * (nodes + 1)
    rng = np.random.default_rng(dim * 1009 + count)
    width = min(dim, count + max(4, count // 2))
    while True:
        block = rng.standard_normal((dim, width))
        for _ in range(MAX_SWEEPS):
            filtered = np.zeros_like(block)
            for angle, weight in zip(angles, weights, strict=True):
                turn = radius * np.exp(1j * angle)
                solved = np.linalg.solve((centre + turn) * np.eye(dim) - matrix, block.astype(complex))
                filtered += weight / 2 * (turn * solved).real
            basis, _ = np.linalg.qr(filtered)
            values, turned = np.linalg.eigh(basis.T @ matrix @ basis)  # Rayleigh-Ritz on the block's width
            block = basis @ turned
            inside = (values > low) & (values < high)
            residual = np.linalg.norm(matrix @ block[:, inside] - block[:, inside] * values[inside], axis=0)
            if inside.sum() == count and residual.max(initial=0.0) <= 4 * dim * np.finfo(float).eps * scale:
                return values[inside], block[:, inside]
        if width == dim:
            raise ArithmeticError(f"{inside.sum()} eigenpairs in ({low}, {high}), inertia counts {count}")
        width = min(dim, 2 * width)


def leading_eigenpairs(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues that are not zero within rounding, falling, and their unit eigenvectors as rows."""
    scale = float(np.abs(matrix).sum(axis=1).max(initial=0.0))
    if not scale:
        return np.zeros(0), np.zeros((0, len(matrix)))
    inertia = Inertia(matrix)
    least = len(matrix) * 4 * np.finfo(float).eps * scale
    k = min(k, inertia.above(least))
    step = 1e-10 * scale
    low = _edge(inertia, -step, scale * 1.01, k, step) if inertia.above(least) > k else least / 2
    values, vectors = [], []
    for a, b, count in _intervals(inertia, low, scale * 1.01, min(step, least / 8)):
        found, basis = _feast(matrix, a, b, count, scale)
        values.append(found)
        vectors.append(basis)
    basis, _ = np.linalg.qr(np.concatenate(vectors, axis=1))
    values, turned = np.linalg.eigh(basis.T @ matrix @ basis)
    order = np.argsort(-values)[:k]
    rows = (basis @ turned[:, order]).T
    signs = np.sign(rows[np.arange(len(rows)), np.abs(rows).argmax(axis=1)])
    return values[order], rows * signs[:, None]
