"""Embedding whitening with eigenvectors by contour integration (FEAST).

1. Each entry ``c`` of a vector becomes the whole number ``floor(64 c) + 1000000``.
   Sums per dimension are exact; the covariance is gathered in a second pass, from
   entries centred before they are multiplied.  What reaches the driver are matrices
   of the vectors' dimension, whatever the number of rows.
2. The covariance ``V`` is sliced: inertia counts (negative pivots of ``T - s``, where ``T``
   is V in tridiagonal form) tell how many eigenvalues lie below any ``s``, so the
   wanted range is halved until each interval holds at most ``MOST`` of them.
3. For each interval, a random block is filtered by the quadrature of
   ``(1 / 2 pi i) * contour integral of (z - V)^-1 dz`` around it, which is a sum of solves with complex
   shifts.  Rayleigh-Ritz on the filtered block extracts the components, and both are
   repeated until residuals are at rounding level.
4. An interval is done when as many components have converged in it as the inertia
   counts tell, so none is missed.  If not, its block grows, at last to the
   whole space.  A last Rayleigh-Ritz over all intervals' components sharpens them.
5. The rows are projected in parallel; a further pass measures how far the covariance
   of the whitened rows is from the identity.

Rows whose vector is null, empty, or holds null or non-finite entries take no part,
nor do vectors of another dimension than the most frequent one (ties: the
smaller).  Rows with null or repeated ids are rows like others.  Directions without variance (eigenvalues at
rounding level) have no component, so equal rows alone give no output.  Deviations
are exact; those beyond 64 bits are null.  An empty table gives no rows.  Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procmon.llm.common import written

SCALE, SHIFT = 64, 1_000_000
MOST = 16  # eigenvalues of an interval, unless they lie too close to be told apart
NODES = 12  # of the quadrature on the upper half of a contour
ROUNDS = 12
SMALL = 4096  # rows handled at a time inside a task
LONG = 1 << 62


# -- eigenvectors of a symmetric matrix ---------------------------------------


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a tridiagonal matrix with the eigenvalues of ``v`` (Householder reflections)."""
    a = np.array(v, float)
    for k in range(len(a) - 2):
        x = a[k + 1 :, k].copy()
        x[0] += np.copysign(np.linalg.norm(x), x[0])
        if length := np.linalg.norm(x):
            x /= length
            p = a[k + 1 :, k + 1 :] @ x
            w = p - (x @ p) * x
            a[k + 1 :, k + 1 :] -= 2 * (np.outer(x, w) + np.outer(w, x))
            a[k + 1, k] = a[k, k + 1] = a[k + 1, k] - 2 * x[0] * (x @ a[k + 1 :, k])
    return np.diag(a).copy(), np.diag(a, 1).copy()


def below(tri: tuple[np.ndarray, np.ndarray], s: float) -> int:
    """Inertia: how many eigenvalues are less than ``s``, from the signs of the pivots of the shifted matrix."""
    diagonal, off = tri
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    count, pivot = 0, 1.0
    squares = [0.0, *(off * off).tolist()]
    for d, e in zip(diagonal.tolist(), squares, strict=True):
        pivot = d - s - e / pivot
        if abs(pivot) < tiny:
            pivot = -tiny
        count += pivot < 0
    return count


def intervals(tri: tuple[np.ndarray, np.ndarray], wanted: int, floor: float) -> list[tuple[float, float, int]]:
    """(from, to, eigenvalues) that hold at least the ``wanted`` largest eigenvalues above ``floor``, largest first."""
    n = len(tri[0])
    off = np.abs(np.concatenate([[0], tri[1], [0]]))
    top = float((tri[0] + off[:-1] + off[1:]).max())
    top += 1e-3 * abs(top) + np.finfo(float).tiny
    near = 64 * n * np.finfo(float).eps * abs(top)

    def clear(s: float) -> float:
        """The next edge without an eigenvalue within rounding of it."""
        while below(tri, s - near) != below(tri, s + near):
            s += 3 * near
        return s

    out, found = [], 0
    stack = [(clear(floor), top)]
    while stack and found < wanted:
        a, b = stack.pop()
        inside = below(tri, b) - below(tri, a)
        if not inside:
            continue
        if inside > MOST and b - a > 16 * near:
            mid = clear(a + 0.4871 * (b - a))
            if a < mid < b:
                stack += [(a, mid), (mid, b)]
                continue
        out.append((a, b, inside))
        found += inside
    return out


def ritz(v: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rayleigh-Ritz: approximate eigenvalues and vectors of ``v`` in the span of a block."""
    q, _ = np.linalg.qr(block)
    values, turn = np.linalg.eigh(q.T @ v @ q)
    return values, q @ turn


def feast(v: np.ndarray, a: float, b: float, inside: int, scale: float) -> np.ndarray:
    """The eigenvectors of ``v`` whose eigenvalues, ``inside`` of them, lie between ``a`` and ``b``."""
    n = len(v)
    t, weight = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(1j * np.pi * (1 + t) / 2)
    centre, radius = (a + b) / 2, (b - a) / 2
    rng = np.random.default_rng(20240229)
    width = min(n, inside + max(4, inside // 2))
    while True:
        x, complete = rng.standard_normal((n, width)), False
        for _ in range(ROUNDS):
            filtered = np.zeros((n, width))
            for u, w in zip(turn, weight, strict=True):
                solved = np.linalg.solve((centre + radius * u) * np.eye(n) - v, x.astype(complex))
                filtered += w / 2 * (radius * u * solved).real
            values, x = ritz(v, filtered if width < n else x)
            residual = np.linalg.norm(v @ x - x * values, axis=0)
            good = (values > a) & (values < b) & (residual <= 64 * n * np.finfo(float).eps * scale)
            if complete and good.sum() == inside:
                return x[:, good]
            complete = good.sum() == inside  # as many as the inertia counts tell: one more round sharpens them
        if width == n:
            raise ValueError(f"{inside} eigenvalues between {a} and {b}, {int(good.sum())} found")
        width = min(n, 2 * width)


def components(v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues (falling) and unit eigenvectors (columns) of a covariance, ``wanted`` at most."""
    scale = float(np.abs(v).sum(1).max(initial=0))
    if not scale:
        return np.zeros(0), np.zeros((len(v), 0))
    w = v / scale
    tri = tridiagonal(w)
    floor = 4 * len(v) * np.finfo(float).eps  # rounding level: no variance
    parts = [feast(w, *interval, 1.0) for interval in intervals(tri, wanted, floor)]
    if not parts:
        return np.zeros(0), np.zeros((len(v), 0))
    values, x = ritz(w, np.column_stack(parts))
    order = np.argsort(-values, kind="stable")[:wanted]
    return values[order] * scale, x[:, order]


# -- passes over the rows --------------------------------------------------------


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x array<long>) of the rows that take part."""
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("e")).where("size(e) > 0")
    rows = rows.where("forall(e, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))")
    wide = rows.groupBy(F.size("e").alias("w")).count().orderBy(F.col("count").desc(), "w").first()
    rows = rows.where(F.size("e") == (wide["w"] if wide else 0))
    return rows.select("id", F.expr(f"transform(e, c -> floor({SCALE} * c) + {SHIFT}L)").alias("x"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of Arrow batches with their vectors as a matrix of whole numbers."""
    for whole in batches:
        for at in range(0, whole.num_rows, SMALL):
            b = whole.slice(at, SMALL)
            yield b, b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)


def _exact(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: 64-bit numbers where they suffice, else Python's."""
    most = int(np.abs(x).max(initial=0))
    if n * most < LONG and max(map(abs, sums)) < LONG:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _squares(d: np.ndarray) -> list:
    """Exact sums of squares of the rows; None beyond 64 bits."""
    if d.dtype != object and (not d.size or int(np.abs(d).max()) ** 2 * d.shape[1] < LONG):
        return (d * d).sum(1).tolist()
    out = [sum(int(c) ** 2 for c in row) for row in d.tolist()]
    return [s if s < 1 << 63 else None for s in out]


def _summed(parts: DataFrame) -> dict:
    """Partial sums (cell, v) added up; as many rows as cells reach the driver."""
    return dict(map(tuple, parts.groupBy("cell").agg(F.sum("v").alias("v")).collect()))


def _moments(rows: DataFrame, centred) -> np.ndarray:
    """Sum over all rows of the products of the entries of ``centred(x)``, a matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _blocks(batches):
            y = centred(x)
            total = y.T @ y + (0 if total is None else total)
        if total is not None:
            cells = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(cells[0] * len(total) + cells[1], pa.int64()), pa.array(total[cells])], ["cell", "v"])

    cells = _summed(rows.mapInArrow(run, "cell long, v double"))
    size = int(np.sqrt(max(cells) + 1))
    out = np.zeros((size, size))
    for cell, v in cells.items():
        out[cell // size, cell % size] = out[cell % size, cell // size] = v
    return out


@dataclass
class Whitening:
    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # components as columns
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return _exact(x, self.n, self.sums).astype(float) / self.n

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))


def fit(rows: DataFrame, most: int = 32) -> Whitening | None:
    """The whitening of (id, x) rows with at most so many components; None without rows."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for _, x in _blocks(batches):
            small = int(np.abs(x).max(initial=0)) * len(x) < LONG
            part = (x if small else x.astype(object)).sum(0).astype(object)
            total = part if total is None else total + part
            n += len(x)
        if n:
            numbers = pa.array([Decimal(int(v)) for v in [n, *total.tolist()]], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(numbers)), pa.int64()), numbers], ["cell", "v"])

    added = _summed(rows.mapInArrow(sums, "cell long, v decimal(38,0)"))
    if not added:
        return None
    n, *total = (int(added[i]) for i in range(len(added)))
    model = Whitening(n, total, np.zeros(0), np.zeros((len(total), 0)), 0.0)
    v = _moments(rows, model.centred) / n
    model.values, model.vectors = components(v, most)
    model.trace = float(np.trace(v))
    if len(model.values):
        model.identity_error = float(np.abs(_moments(rows, model.whiten) / n - np.eye(len(model.values))).max())
    return model


def transform(rows: DataFrame, model: Whitening, id_col: str = "vec_id") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every row and component."""
    kind = rows.schema["id"].dataType.simpleString()
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _blocks(batches):
            m = b.num_rows
            take = pa.array(np.repeat(np.arange(m), k))
            deviation = pa.array(_squares(_exact(x, model.n, model.sums)), pa.int64())
            columns = [
                b.column("id").take(take),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, model.n)),
                deviation.take(take),
                pa.array(model.whiten(x).ravel()),
                pa.array(np.tile(model.values / model.trace, m)),
                pa.array(np.full(m * k, model.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    out = rows if k else rows.limit(0)
    return out.mapInArrow(run, f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double").withColumnRenamed("id", id_col)


def whiten(vectors: DataFrame, most: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Fit on all usable rows and whiten them; the whole-number vectors are written once and read by each pass."""
    rows = written(whole_vectors(vectors, id_col, vector_col), "whole-vectors")
    model = fit(rows, most)
    return transform(rows, model or Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0), id_col)
