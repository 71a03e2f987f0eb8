"""PCA whitening of embeddings by contour integration (FEAST).

Entries become integers on a grid, so sums are exact.  The covariance of the
distinct vectors is centred in every task, multiplied there and added up by
rows.  Its largest eigenpairs come from a contour integral: a circle around an
interval of eigenvalues is cut into quadrature nodes, each a solve with a
complex shift of the covariance; their weighted sum projects a block of
vectors onto the eigenvectors of the interval, and a Rayleigh-Ritz step takes
the pairs out of that block.  The signs of a tridiagonal form (Sylvester's law
of inertia) tell how many eigenvalues an interval holds; intervals are cut
by these counts and no result is accepted that has fewer.

The driver holds the covariance (dimensions squared, whatever the number of
rows) and the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import added_rows, rows_from, stage

GRID, OFFSET = 64, 1_000_000
LIMIT = 1 << 62              # grid values beyond are held there
COMPONENTS = 16
PER_INTERVAL = 8             # eigenvalues of one contour, more only where they cannot be told apart
NODES = 12                   # quadrature nodes of the upper half circle
ROUNDS = 40
TOLERANCE = 1e-13            # of residuals, relative to the largest eigenvalue bound
CLOSE = 1e-9                 # eigenvalues closer than this share of the largest are not separated
NO_VARIANCE = 1e-12          # share of the trace below which a component has no variance to whiten


# --------------------------------------------------------------- eigenpairs
def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of an orthogonally similar tridiagonal matrix (Householder)."""
    a = v.copy()
    d = len(a)
    for k in range(d - 2):
        x = a[k + 1:, k].copy()
        x[0] += np.copysign(np.linalg.norm(x), x[0])
        size = np.linalg.norm(x)
        if size == 0:
            continue
        x /= size
        p = a[k + 1:, k + 1:] @ x
        p -= (x @ p) * x
        a[k + 1:, k + 1:] -= 2 * (np.outer(x, p) + np.outer(p, x))
        rest = a[k + 1:, k] - 2 * x * (x @ a[k + 1:, k])
        a[k + 1:, k] = a[k, k + 1:] = rest
    return np.diag(a).copy(), np.diag(a, 1).copy()


class Inertia:
    """Counts of eigenvalues above a shift, from the signs of the pivots of the shifted tridiagonal form."""

    def __init__(self, v: np.ndarray):
        self.diagonal, off = tridiagonal(v)
        self.squares = np.concatenate([[0.0], off ** 2])
        reach = np.abs(np.concatenate([[0.0], off])) + np.abs(np.concatenate([off, [0.0]]))
        self.low, self.high = float((self.diagonal - reach).min()), float((self.diagonal + reach).max())
        self.tiny = max(abs(self.low), abs(self.high), 1e-300) * 1e-18
        margin = 1e-3 * max(self.high - self.low, abs(self.high), abs(self.low))
        self.low, self.high = self.low - margin, self.high + margin

    def above(self, shift: float) -> int:
        count, pivot = 0, 1.0
        for value, square in zip(self.diagonal.tolist(), self.squares.tolist()):
            pivot = value - shift - square / pivot
            if abs(pivot) < self.tiny:
                pivot = -self.tiny
            count += pivot > 0
        return count

    def separator(self, count: int) -> float | None:
        """A shift with exactly ``count`` eigenvalues above it, in the middle of the gap; None if there is no gap."""
        if count >= len(self.diagonal):
            return self.low
        ends, width = [], CLOSE * (self.high - self.low) / 4
        for least in (count, count + 1):  # the largest shifts with so many above
            a, b = self.low, self.high
            while b - a > width:
                mid = (a + b) / 2
                if mid in (a, b):
                    break
                a, b = (mid, b) if self.above(mid) >= least else (a, mid)
            ends.append((a, b))
        upper, lower = ends[0][0], ends[1][1]
        return (upper + lower) / 2 if upper - lower > width * 2 else None


def intervals(inertia: Inertia, wanted: int) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside) that hold at least the ``wanted`` largest eigenvalues, falling."""
    out, high, done = [], inertia.high, 0
    while done < wanted:
        count = min(done + PER_INTERVAL, wanted)
        while (low := inertia.separator(count)) is None:
            count += 1
        out.append((low, high, count - done))
        high, done = low, count
    return out


def contour_pairs(v: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs of ``v`` between ``low`` and ``high``."""
    d = len(v)
    t, weight = np.polynomial.legendre.leggauss(NODES)
    centre, radius, scale = (low + high) / 2, (high - low) / 2, np.linalg.norm(v)
    turn = np.exp(1j * np.pi / 2 * (1 - t))
    eye = np.eye(d)
    width = min(d, max(2 * count, count + 8))
    while True:
        block = np.random.default_rng(11).standard_normal((d, width))
        for _ in range(ROUNDS):
            projected = np.zeros((d, width))
            for z, w in zip(turn, weight):
                solved = np.linalg.solve((centre + radius * z) * eye - v, block.astype(complex))
                projected += w / 4 * (2 * radius * z * solved).real
            basis, _ = np.linalg.qr(projected)
            values, vectors = np.linalg.eigh(basis.T @ v @ basis)
            block = basis @ vectors
            inside = (values > low) & (values < high)
            found = block[:, inside]
            residual = np.linalg.norm(v @ found - found * values[inside], axis=0).max(initial=0.0)
            if inside.sum() == count and residual <= TOLERANCE * scale:
                return values[inside], found
        if width == d:
            raise ArithmeticError(f"{int(inside.sum())} of {count} eigenpairs found between {low} and {high}")
        width = min(d, 2 * width)


def largest_pairs(v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a covariance, falling, and unit eigenvectors in columns.

    Directions without variance are left out.  The entry of a vector that is
    largest in size is positive.
    """
    d, trace = len(v), float(np.trace(v))
    if not d or trace <= 0:
        return np.empty(0), np.empty((d, 0))
    v = v / trace
    parts = [contour_pairs(v, *part) for part in intervals(Inertia(v), min(wanted, d))]
    basis, _ = np.linalg.qr(np.hstack([vectors for _, vectors in parts]))
    values, inner = np.linalg.eigh(basis.T @ v @ basis)
    order = np.argsort(-values, kind="stable")[:wanted]
    order = order[values[order] > NO_VARIANCE]
    vectors = basis @ inner[:, order]
    if len(order):
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    return values[order] * trace, vectors


# ------------------------------------------------------------------- passes
def on_grid(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id and x of the rows whose vector has only finite entries."""
    whole = F.forall(embedding, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    cell = lambda c: F.least(F.greatest(F.floor(c.cast("double") * GRID), F.lit(-LIMIT)), F.lit(LIMIT)) + OFFSET
    kept = vectors.filter(F.col(embedding).isNotNull() & whole)
    return kept.select(F.col(vec_id).alias("vec_id"), F.transform(embedding, cell).cast("array<bigint>").alias("x"))


def _matrix(x: list) -> np.ndarray:
    return np.array(x, dtype=np.int64)


def _sums(batches: Iterator[dict]) -> Iterator[dict]:
    """(dimension, exact sum) of a task; dimension -1 counts the rows."""
    total, rows = None, 0
    for b in batches:
        if b["x"]:
            x = _matrix(b["x"])
            if np.abs(x).max(initial=0) > 1 << 40:
                x = x.astype(object)
            part = [int(s) for s in x.sum(axis=0)]
            total = part if total is None else [a + s for a, s in zip(total, part)]
            rows += len(x)
    if rows:
        from decimal import Decimal
        yield {"dim": [-1, *range(len(total))], "total": [Decimal(rows), *map(Decimal, total)]}


def _gram(centred, project=None):
    """Rows of the sum of outer products of a task."""
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        total = None
        for b in batches:
            if b["x"]:
                z = centred(_matrix(b["x"]))
                z = z if project is None else z @ project
                total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            yield {"row": range(len(total)), "part": [r.tobytes() for r in total]}
    return run


def gram(x: DataFrame, centred, project=None) -> np.ndarray:
    """Sum of outer products of the centred (and projected) rows; one matrix a task, added row by row."""
    parts = rows_from(x, _gram(centred, project), "row int, part binary", at_once=4096)
    return np.array(list(added_rows(parts, np.float64).values()))


@dataclass
class Centre:
    """x - S/n, from the exact integer n*x - S."""
    n: int
    sums: list[int]

    def exact(self, x: np.ndarray) -> np.ndarray:
        reach = max(self.n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))), max(map(abs, self.sums), default=0))
        if reach < 1 << 62:
            return x * self.n - np.array(self.sums, dtype=np.int64)
        return x.astype(object) * self.n - np.array(self.sums, dtype=object)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.exact(x).astype(np.float64) / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of squares of n*x - S; None where a long cannot hold one."""
        off = self.exact(x)
        if off.dtype != object and np.square(off.astype(np.float64)).sum(axis=1).max(initial=0.0) < 9e18:
            return np.square(off).sum(axis=1).tolist()
        return [s if s < 1 << 63 else None for s in (sum(int(v) ** 2 for v in row) for row in off)]


@dataclass
class Whitening:
    centre: Centre
    values: np.ndarray      # eigenvalues, falling
    vectors: np.ndarray     # unit eigenvectors in columns
    trace: float
    identity_error: float   # largest entry of the whitened fit rows' covariance minus the identity


def fit(x: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Whitening of the distinct vectors ``x``; None without any."""
    sums = rows_from(x, _sums, "dim int, total decimal(38,0)").groupBy("dim").agg(F.sum("total").alias("total")).collect()
    if not sums:
        return None
    ordered = [int(r["total"]) for r in sorted(sums)]
    centre = Centre(ordered[0], ordered[1:])
    d = len(centre.sums)
    if not d:
        return Whitening(centre, np.empty(0), np.empty((0, 0)), 0.0, 0.0)
    v = gram(x, centre) / centre.n
    v = (v + v.T) / 2
    values, vectors = largest_pairs(v, components)
    error = 0.0
    if len(values):
        error = float(np.abs(gram(x, centre, vectors / np.sqrt(values)) / centre.n - np.eye(len(values))).max())
    return Whitening(centre, values, vectors, float(np.trace(v)), error)


def _whiten(model: Whitening):
    scaled, centre = model.vectors / np.sqrt(model.values), model.centre

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            if b["x"]:
                x = _matrix(b["x"])
                white = np.ascontiguousarray(centre(x) @ scaled)
                ends = np.arange(0, white.size + 1, white.shape[1], dtype=np.int32)
                yield {"vec_id": b["vec_id"], "deviation": centre.deviation(x),
                       "white": pa.ListArray.from_arrays(pa.array(ends), pa.array(white.ravel()))}
    return run


def whiten(vectors: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each vector and component.

    Vectors that are null or hold a null or non-finite entry are left out.  All
    others are whitened by the covariance of their distinct grid vectors, copies
    and rows without an id too.  Vectors shorter than the longest are filled up
    with zeros.  There are at most as many components as dimensions, and none
    without variance: a table whose vectors are all equal, or empty, gives no
    rows.  A deviation that a long cannot hold is null.  Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = on_grid(vectors, vec_id, embedding)
    ends = rows.agg(F.min(F.size("x")).alias("a"), F.max(F.size("x")).alias("b")).first()
    if ends["a"] != ends["b"]:
        filled = F.concat("x", F.array_repeat(F.lit(OFFSET).cast("long"), F.lit(ends["b"]) - F.size("x")))
        rows = rows.withColumn("x", filled)
    rows = stage(rows, "grid")
    model = fit(stage(rows.select("x").distinct(), "fit"), components)
    id_type = rows.schema["vec_id"].dataType.simpleString()
    if model is None or not len(model.values):
        return spark.createDataFrame([], f"vec_id {id_type}, component int, n long, deviation long, whitened double, "
                                         "explained double, identity_error double")
    white = rows_from(rows, _whiten(model), f"vec_id {id_type}, deviation long, white array<double>", at_once=4096)
    shares = F.lit((model.values / model.trace).tolist())
    each = white.select("vec_id", "deviation", F.posexplode("white").alias("k", "whitened"))
    return each.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(model.centre.n).cast("long").alias("n"), "deviation",
                       "whitened", F.element_at(shares, F.col("k") + 1).alias("explained"),
                       F.lit(model.identity_error).alias("identity_error"))
