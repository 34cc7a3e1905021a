"""Whitening of embeddings by shifted CholeskyQR.

Vectors become whole numbers x = floor(256 c). The mean and the covariance are
those of the fit list, which has each distinct x vector once. Its centred rows
Y are factored as Y = Q R without ever forming the covariance's eigenvectors
from the Gram matrix itself, which would square its condition number: a pass
over the rows sums the Gram matrix of Q (d x d in each task), the driver takes
its Cholesky factor, and the next pass solves the rows against all triangular
factors so far. The first Gram matrix is shifted so that its factor exists
whatever the condition; the passes go on until Q is orthonormal. The singular
values and right singular vectors of the product of the factors give the
components; directions in which the rows have no spread have none.

Only d x d matrices reach the driver, added up in two steps. Sums and
deviations are exact integers. Rows are read from tables in the shared folder,
so a lost executor repeats a task, not a pass.

Edge cases: rows whose vector is null, empty, or holds a null or a value that
isn't finite are left out; so are rows whose vector is not of the commonest
length (of equally common ones the longer). Values beyond 64 bits become the
largest or smallest long. Repeated rows are returned each; rows without an id
too. There are at most as many components as the covariance has rank, so one
distinct vector, or an empty table, gives no rows. A deviation beyond 64 bits
is null. The sign of a component is that which makes its largest entry
positive (of equals the first). Other columns don't matter, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.session import write_scratch

from . import common as C

#: Passes of the factorisation at most; three are enough unless some directions have no spread.
PASSES = 6
#: Q counts as orthonormal when no entry of its Gram matrix is further off.
ORTHONORMAL = 1e-13
#: Rows that are factored at once.
BLOCK_ROWS = 4096


@dataclass(frozen=True)
class WhitenParams:
    components: int = 4
    scale: int = 256


@dataclass(frozen=True)
class Fit:
    """n and the exact sums S and squares of the fit list, the components (rows
    of unit length) by falling eigenvalue, and the share of each."""
    n: int
    sums: tuple[int, ...]
    squares: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray

    def explained(self) -> np.ndarray:
        trace = sum(self.n * q - s * s for s, q in zip(self.sums, self.squares, strict=True))
        return self.values / (trace / self.n**2)


def as_rows(col: pa.Array, d: int) -> np.ndarray:
    """A list column without nulls, of length d each, as a matrix."""
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), d)


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """x - S / n, from the exact n x - S."""
    return (numerators(x, n, sums).astype(float)) / n


def numerators(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n x - S, in 64 bits where they fit, else in Python's integers."""
    top = int(np.abs(x.astype(float)).max(initial=0)) + 1
    if n * top + max(map(abs, sums), default=0) < 2**62:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    y = numerators(x, n, sums)
    if y.dtype != object and y.shape[1] * float(np.abs(y).max(initial=0)) ** 2 >= 2**62:
        y = y.astype(object)
    total = (y * y).sum(axis=1)
    return [v if v < 2**63 else None for v in map(int, total)]


def solve_rows(y: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """Y R1^-1 R2^-1 ..., column by column (forward substitution on the rows)."""
    for r in factors:
        q = np.empty_like(y, order="F")
        for j in range(y.shape[1]):
            q[:, j] = (y[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
        y = q
    return y


def sum_over(df: DataFrame, fn: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray | None:
    """The sum of fn over all batches: one array for each task, added up in
    two steps so that the driver gets few. Object arrays stay exact."""
    import pickle

    def add(items: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        total = None
        for a in items:
            total = a if total is None else total + a
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], names=["part"])

    def part(batches):
        return add(fn(b.slice(i, BLOCK_ROWS)) for b in batches for i in range(0, b.num_rows, BLOCK_ROWS))

    def merge(batches):
        return add(pickle.loads(x.as_py()) for b in batches for x in b.column(0))

    parts = C.map_batches(df, part, "part binary")
    few = max(1, int(C.input_partitions(df.sparkSession) ** 0.5))
    rows = C.map_batches(parts.repartition(few), merge, "part binary").collect()  # sqrt(partitions) matrices of d x d
    total = None
    for r in rows:
        a = pickle.loads(r["part"])
        total = a if total is None else total + a
    return total


def fit(rows: DataFrame, d: int, params: WhitenParams) -> Fit:
    """The fit of a table of distinct vectors ``x`` (array of long, length d)."""
    def moments(b: pa.RecordBatch) -> np.ndarray:
        x = as_rows(b.column(0), d)
        if float(np.abs(x.astype(float)).max(initial=0)) >= 2**24:  # squares of a block beyond 64 bits
            x = x.astype(object)
        return np.array([[len(x)] * d, x.sum(axis=0).tolist(), (x * x).sum(axis=0).tolist()], object)

    total = sum_over(rows, moments)
    if total is None:
        return Fit(0, (0,) * d, (0,) * d, np.zeros((0, d)), np.zeros(0))
    n, sums, squares = int(total[0][0]), tuple(map(int, total[1])), tuple(map(int, total[2]))
    factors: list[np.ndarray] = []

    def gram(b: pa.RecordBatch) -> np.ndarray:
        q = solve_rows(centred(as_rows(b.column(0), d), n, sums), factors)
        return q.T @ q

    unit = np.finfo(float).eps / 2
    for k in range(PASSES):
        g = sum_over(rows, gram)
        g = (g + g.T) / 2
        w, u = np.linalg.eigh(g)
        spread = w > 0.5
        if k and np.abs(g - (u[:, spread] @ u[:, spread].T)).max() <= ORTHONORMAL * d:
            break
        if w[-1] <= 0:
            break
        # the shift of the published analysis; none once the factor exists without it
        shift = 11 * (n * d + d * (d + 1)) * unit * w[-1] if k == 0 else max(0.0, 2 * d * unit * w[-1] - w[0])
        if k + 1 < PASSES:
            factors.append(np.linalg.cholesky(g + shift * np.eye(d)).T)
    if not factors or w[-1] <= 0:
        return Fit(n, sums, squares, np.zeros((0, d)), np.zeros(0))
    r = factors[0]
    for f in factors[1:]:
        r = f @ r
    # Y^T Y = R^T G R, where the last Gram matrix G is the identity on the directions with spread
    root = np.sqrt(w[spread])[:, None] * u[:, spread].T
    _, s, vt = np.linalg.svd(root @ r, full_matrices=False)
    # below this a singular value is rounding, not spread
    k = min(params.components, int((s > s[0] * max(n, d) * 2 * unit).sum()))
    sign = np.sign(vt[np.arange(k), np.abs(vt[:k]).argmax(axis=1)])
    return Fit(n, sums, squares, vt[:k] * sign[:, None], s[:k] ** 2 / n)


def project(x: np.ndarray, f: Fit) -> np.ndarray:
    return centred(x, f.n, f.sums) @ f.components.T / np.sqrt(f.values)


def identity_error(rows: DataFrame, d: int, f: Fit) -> float:
    """Largest entry of the fit list's whitened covariance minus the identity."""
    k = len(f.values)
    mean = sum_over(rows, lambda b: project(as_rows(b.column(0), d), f).sum(axis=0)) / f.n

    def spread(b: pa.RecordBatch) -> np.ndarray:
        y = project(as_rows(b.column(0), d), f) - mean
        return y.T @ y

    return float(np.abs(sum_over(rows, spread) / f.n - np.eye(k)).max())


def whole_vectors(vectors: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """vec_id and x of the rows that remain, and its length."""
    v = F.col("v")
    numbers = vectors.select(vectors[vec_id].cast("long").alias("vec_id"), vectors[vector].cast("array<double>").alias("v"))
    numbers = numbers.where(F.size(v) > 0).where(~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    x = F.transform(v, lambda c: F.floor(c * float(scale)).cast("long"))
    return numbers.select("vec_id", x.alias("x"), F.size(v).alias("d"))


def whiten(vectors: DataFrame, params: WhitenParams | None = None, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error
    of every remaining row and component."""
    p = params or WhitenParams()
    spark = vectors.sparkSession
    rows = write_scratch(whole_vectors(vectors, vec_id, vector, p.scale), "vectors")
    lengths = rows.groupBy("d").count().orderBy(F.col("count").desc(), F.col("d").desc()).first()
    d = lengths["d"] if lengths else 0
    rows = rows.where(F.col("d") == d)
    once = write_scratch(rows.select("x").distinct(), "fit-list")
    f = fit(once, d, p)
    k = len(f.values)
    error = identity_error(once, d, f) if k else 0.0
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    explained = f.explained() if k else np.zeros(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows if k else 0, BLOCK_ROWS):
                c = b.slice(i, BLOCK_ROWS)
                m = c.num_rows
                x = as_rows(c.column(1), d)
                yield pa.RecordBatch.from_arrays(
                    [c.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                     pa.array(np.full(m * k, f.n)), pa.array([v for v in deviations(x, f.n, f.sums) for _ in range(k)], pa.int64()),
                     pa.array(project(x, f).reshape(-1)), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return C.map_batches(rows.select("vec_id", "x"), run, schema)
