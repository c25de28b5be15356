"""Whitening directions of embeddings from the singular values of their centred rows.

Blocks of centred rows are reduced by QR inside each task, and the triangles that remain are reduced
again, a few at a time, until one is left; so no sum of squares loses digits and nothing but one
triangle of dims x dims reaches the driver. There it is brought to bidiagonal form by Householder
reflections. The differential quotient-difference algorithm with shifts (dqds) finds the squared
singular values, and twisted factorisations of the tridiagonal product give its eigenvectors, which
the reflections turn into directions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from incidentia.llm.common import Work, id_type

#: Directions that rows are projected on, at most.
COMPONENTS = 32
#: Entries are compared as floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64.0, 1_000_000
#: Dimensions a vector may have: one triangle of dims x dims is held by the driver and each task.
MAX_DIMS = 4_096
#: Triangles that one task reduces to one.
FAN_IN = 16
#: Rows that are held as numbers at a time.
BLOCK_ROWS = 4_096
#: Eigenvalues closer than this share of their size are made orthogonal to each other.
CLUSTER = 1e-4

_EPS = np.finfo(np.float64).eps


# --- Points ---------------------------------------------------------------------------------------


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and values of a list column; a length of -1 marks a row that is left out.

    Left out are null vectors and those that hold null or non-finite entries.
    """
    starts = column.offsets.to_numpy()[:-1].astype(np.int64)
    lengths = np.diff(column.offsets.to_numpy()).astype(np.int64)
    values = column.values
    entries = values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(entries))))
    lengths[bad[starts + lengths] > bad[starts]] = -1
    if column.null_count:
        lengths[column.is_null().to_numpy(zero_copy_only=False)] = -1
    return starts, lengths, entries


def points_of(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a list column that have a point, and the points as whole numbers."""
    starts, lengths, entries = _lists(column)
    rows = np.flatnonzero(lengths == dims)
    scaled = np.floor(SCALE * entries[starts[rows][:, None] + np.arange(dims)])
    if scaled.size and np.abs(scaled).max() >= 2.0**53:
        raise ValueError("an entry is too large to be told from its neighbours")
    return rows, scaled.astype(np.int64) + OFFSET


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            yield batch.slice(at, BLOCK_ROWS)


@dataclass
class Whitening:
    """What rows are whitened by: counts and sums of the fit list, eigenvalues and directions."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    directions: np.ndarray
    total: float

    @property
    def dims(self) -> int:
        return len(self.sums)

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.total

    def centred(self, points: np.ndarray) -> np.ndarray:
        """n * x - S, exactly."""
        return self.n * points - self.sums

    def whiten(self, points: np.ndarray) -> np.ndarray:
        return self.centred(points) / self.n @ (self.directions / np.sqrt(self.values))


def fit_whitening(
    vectors: DataFrame, work: Work, vector_col: str = "embedding", components: int = COMPONENTS
) -> Whitening | None:
    """The whitening of all vectors of the most common length; ``None`` if there are none.

    Directions of no variance are left out, so there may be fewer than ``components``.
    """
    data = vectors.select(F.col(vector_col).cast("array<double>").alias("v"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            lengths = _lists(block.column(0))[1]
            for dims in np.unique(lengths[lengths > 0]).tolist():
                if dims > MAX_DIMS:
                    raise ValueError(f"a vector has more than {MAX_DIMS} entries")
                points = points_of(block.column(0), dims)[1]
                columns = [pa.array([dims], pa.int32()), pa.array([len(points)], pa.int64())]
                columns.append(pa.array([points.sum(axis=0)], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, ["dims", "n", "sums"])

    parts = work.table(data.mapInArrow(add, "dims int, n long, sums array<long>"), "sums")
    most = parts.groupBy("dims").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if most is None:
        return None
    dims, n = most["dims"], most["n"]
    entries = parts.filter(F.col("dims") == dims).select(F.posexplode("sums").alias("at", "s"))
    found = entries.groupBy("at").agg(F.sum("s").alias("s")).collect()
    sums = np.zeros(dims, dtype=np.int64)
    sums[[r["at"] for r in found]] = [r["s"] for r in found]
    triangle = _triangle(data, work, n, sums)
    squares, directions = singular_directions(triangle, components)
    return Whitening(
        n, sums, squares[: directions.shape[1]] / n, directions, float(squares.sum()) / n
    )


def _triangle(data: DataFrame, work: Work, n: int, sums: np.ndarray) -> np.ndarray:
    """The triangle R of a QR factorisation of all centred rows."""
    dims = len(sums)

    def reduce(matrices: Iterator[np.ndarray]) -> np.ndarray:
        held = np.zeros((0, dims))
        for matrix in matrices:
            held = np.linalg.qr(np.vstack((held, matrix)), mode="r")
        return held

    def packed(part: int, held: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array([part], pa.int64())]
        columns.append(pa.array([held.ravel()], pa.list_(pa.float64())))
        return pa.RecordBatch.from_arrays(columns, ["part", "r"])

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        points = (points_of(block.column(0), dims)[1] for block in _blocks(batches))
        held = reduce((n * x - sums) / n for x in points)
        if len(held):
            yield packed(TaskContext.get().partitionId(), held)

    def join(key: tuple, table: pa.Table) -> pa.Table:
        held = reduce(np.array(r).reshape(-1, dims) for r in table.column("r").to_pylist())
        return pa.Table.from_batches([packed(key[0].as_py(), held)])

    schema = "part long, r array<double>"
    level, seen = work.counted(data.mapInArrow(factor, schema), "triangles")
    while seen["rows"] > 1:
        level, seen = work.counted(
            level.select(F.floor(F.col("part") / FAN_IN).alias("part"), "r")
            .groupBy("part")
            .applyInArrow(join, schema),
            "triangles",
        )
    held = np.array(level.first()["r"]).reshape(-1, dims)
    return np.vstack((held, np.zeros((dims - len(held), dims))))


# --- The solver -----------------------------------------------------------------------------------


def bidiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, upper diagonal and V of ``matrix`` = U B V' for a square matrix."""
    a = matrix.astype(np.float64).copy()
    size = len(a)
    v = np.eye(size)

    def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
        """w and alpha with (I - 2 w w') x = alpha e1."""
        w = x.copy()
        length = np.linalg.norm(w)
        if length == 0:
            return w, 0.0
        alpha = -length if w[0] >= 0 else length
        w[0] -= alpha
        return w / np.linalg.norm(w), alpha

    for k in range(size):
        w, _ = reflector(a[k:, k])
        a[k:, k:] -= 2 * np.outer(w, w @ a[k:, k:])
        if k < size - 2:
            w, _ = reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ w, w)
            v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ w, w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list, list, float, list]:
    """One dqds step: the arrays of L L' - shift, the least pivot, and all pivots."""
    d = q[0] - shift
    pivots, new_q, new_e = [d], [], []
    for k in range(len(e)):
        total = d + e[k]
        ratio = q[k + 1] / total if total else 0.0
        new_q.append(total)
        new_e.append(e[k] * ratio)
        d = d * ratio - shift
        pivots.append(d)
    new_q.append(d)
    return new_q, new_e, min(pivots), pivots


def dqds(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """The squared singular values of an upper bidiagonal matrix, falling.

    Shifts stay below the least value that is left, so every number stays positive and small values
    keep their digits. The bound 1 / trace of the inverse is always safe; a bolder guess from the last
    two rows is tried first and taken back if a pivot turns negative.
    """
    found: list[float] = []
    parts = [(list(np.square(diagonal)), list(np.square(upper)), 0.0, 0.0)]
    while parts:
        q, e, sigma, lost = parts.pop()
        while q:
            if len(q) == 1:
                found.append(sigma + (q.pop() + lost))
                break
            if q[-1] > 1.5 * q[0]:
                q.reverse()
                e.reverse()
            tiny = [k for k in range(len(e)) if e[k] <= _EPS**2 * (sigma + q[k + 1])]
            if tiny:
                cut = tiny[-1] + 1
                parts.append((q[:cut], e[: cut - 1], sigma, lost))
                q, e = q[cut:], e[cut:]
                continue
            _, _, least, pivots = _sweep(q, e, 0.0)
            safe = 0.0
            if least > 0:
                safe = (1 - 1e-10) / sum(1 / p for p in pivots)
            a, b, c = q[-2], e[-1], q[-1]
            half = (a + b + c) / 2
            bold = c * a / (half + np.sqrt(max(half * half - a * c, 0.0))) if half else 0.0
            for shift in (min(bold, least) * (1 - 1e-3), safe, 0.0):
                new_q, new_e, least, _ = _sweep(q, e, shift)
                if shift >= safe and least >= 0:
                    break
            q, e = new_q, new_e
            # Sum of shifts with the digits that the addition loses.
            total = sigma + shift
            lost += shift - (total - sigma)
            sigma = total
    return np.array(sorted(found, reverse=True))


def twisted_vector(q: np.ndarray, steps: np.ndarray, value: float) -> np.ndarray:
    """A unit eigenvector of L D L' for an eigenvalue, from the best of its twisted factorisations.

    ``q`` is D's diagonal and ``steps`` L's lower diagonal. The factorisation from the top and the one
    from the bottom meet in the row where their remainder is least; there the vector is 1.
    """
    size = len(q)
    floor = _EPS**2 * max(float(np.abs(q).max()), 1e-300)
    down, up = np.zeros(size), np.zeros(size)
    lower, higher = np.zeros(size - 1), np.zeros(size - 1)
    s = -value
    for k in range(size - 1):
        down[k] = s
        pivot = q[k] + s
        pivot = pivot if abs(pivot) > floor else floor
        lower[k] = q[k] * steps[k] / pivot
        s = lower[k] * steps[k] * s - value
    down[-1] = s
    p = q[-1] - value
    for k in range(size - 2, -1, -1):
        up[k + 1] = p
        pivot = q[k] * steps[k] ** 2 + p
        pivot = pivot if abs(pivot) > floor else floor
        higher[k] = steps[k] * q[k] / pivot
        p = p * (q[k] / pivot) - value
    up[0] = p
    twist = int(np.argmin(np.abs(down + up + value)))
    z = np.zeros(size)
    z[twist] = 1.0
    for k in range(twist - 1, -1, -1):
        z[k] = -lower[k] * z[k + 1]
    for k in range(twist, size - 1):
        z[k + 1] = -higher[k] * z[k]
    return z / np.linalg.norm(z)


def _apart(vector: np.ndarray, others: list[np.ndarray], value: float, t: np.ndarray) -> np.ndarray:
    """An eigenvector for ``value`` at right angles to ``others`` of its cluster.

    If the twisted vector lies among the others, inverse iteration from mixed vectors takes its place.
    """

    def cleared(x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            for other in others:
                x = x - other * (other @ x)
        return x

    best = cleared(vector)
    size = len(vector)
    near = t - value * (1 + 3 * _EPS) * np.eye(size)
    start = 0
    while np.linalg.norm(best) < 0.1:
        start += 1
        best = cleared(np.cos(start * np.arange(1.0, size + 1) ** 2))
        for _ in range(3):
            best = cleared(np.linalg.solve(near, best / np.linalg.norm(best)))
        best = cleared(best / np.linalg.norm(best))
    return best / np.linalg.norm(best)


def singular_directions(matrix: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All squared singular values of a square matrix, falling, and right singular vectors as columns.

    There is a vector for each of the first ``most`` values that rise above rounding. Its first entry
    that is not tiny is positive.
    """
    size = len(matrix)
    scale = float(np.abs(matrix).max(initial=0.0))
    if not scale:
        return np.zeros(size), np.zeros((size, 0))
    diagonal, upper, v = bidiagonal(matrix / scale)
    # Pivots below the rounding of the reflections are lifted to it.
    diagonal = np.copysign(np.maximum(np.abs(diagonal), _EPS / 8), diagonal)
    values = dqds(diagonal, upper)
    q, steps = diagonal**2, upper / diagonal[:-1]
    t = np.diag(q + np.concatenate(([0.0], upper**2)))
    t += np.diag(upper * diagonal[:-1], 1) + np.diag(upper * diagonal[:-1], -1)
    columns: list[np.ndarray] = []
    first = 0
    for k, value in enumerate(values[values > values[0] * (8 * size * _EPS) ** 2][:most]):
        if k and values[k - 1] - value > CLUSTER * values[k - 1]:
            first = k
        z = twisted_vector(q, steps, value)
        columns.append(_apart(z, columns[first:], value, t) if k > first else z)
    vectors = v @ np.array(columns).T
    leads = vectors[np.argmax(np.abs(vectors) > 1e-8, axis=0), np.arange(len(columns))]
    return values * scale**2, vectors * np.where(leads < 0, -1.0, 1.0)


# --- Rows -----------------------------------------------------------------------------------------


def identity_error(
    vectors: DataFrame, fitted: Whitening, vector_col: str = "embedding"
) -> float:
    """The largest entry of the whitened rows' covariance less the identity, in absolute value."""
    held = vectors.sparkSession.sparkContext.broadcast(fitted)
    size = len(fitted.values)
    data = vectors.select(F.col(vector_col).cast("array<double>").alias("v"))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        total = np.zeros((size + 1, size))
        for block in _blocks(batches):
            rows = model.whiten(points_of(block.column(0), model.dims)[1])
            total += np.vstack((rows.T @ rows, rows.sum(axis=0)))
        columns = [pa.array(np.arange(total.size)), pa.array(total.ravel())]
        yield pa.RecordBatch.from_arrays(columns, ["at", "s"])

    found = data.mapInArrow(multiply, "at long, s double").groupBy("at").agg(F.sum("s").alias("s"))
    total = np.zeros((size + 1) * size)
    for row in found.collect():
        total[row["at"]] = row["s"]
    total = total.reshape(size + 1, size) / fitted.n
    means = total[-1]
    return float(np.abs(total[:-1] - np.outer(means, means) - np.eye(size)).max())


def whiten(
    vectors: DataFrame, fitted: Whitening, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """A row per vector: vec_id, n, deviation, whitened (an array, the first component first).

    ``deviation`` is the sum over dimensions of (n * x - S)^2, exactly; a sum beyond 64 bits is an
    error.
    """
    held = vectors.sparkSession.sparkContext.broadcast(fitted)
    schema = T.StructType(
        [
            T.StructField("vec_id", id_type(vectors, id_col)),
            T.StructField("deviation", T.LongType()),
            T.StructField("whitened", T.ArrayType(T.DoubleType())),
        ]
    )

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for block in _blocks(batches):
            rows, points = points_of(block.column(1), model.dims)
            apart = model.centred(points)
            if (np.square(apart.astype(np.float64)).sum(axis=1) > 2.0**62).any():
                raise OverflowError("a deviation does not fit 64 bits")
            found = model.whiten(points)
            edges = np.arange(len(rows) + 1, dtype=np.int32) * found.shape[1]
            columns = [
                block.column(0).take(pa.array(rows)),
                pa.array((apart * apart).sum(axis=1)),
                pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(found.ravel())),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    rows = vectors.select(
        F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")
    )
    n = F.lit(fitted.n).cast("long").alias("n")
    return rows.mapInArrow(project, schema).select("vec_id", n, "deviation", "whitened")


def whitened_components(
    vectors: DataFrame,
    work: Work,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    components: int = COMPONENTS,
) -> DataFrame:
    """A row per vector and component: vec_id, component from 1, n, deviation, whitened, explained,
    identity_error.

    Vectors that are null or hold null or non-finite entries are left out, and so are those of
    another length than the most common one. Repeated rows and null ids count each; further columns
    are ignored. Components without variance have no rows, so a table of equal vectors, or an empty
    one, gives none.
    """
    fitted = fit_whitening(vectors, work, vector_col, components)
    if fitted is None or not len(fitted.values):
        shares, error = [0.0], 0.0
        kind = id_type(vectors, id_col).simpleString()
        rows = vectors.sparkSession.createDataFrame(
            [], f"vec_id {kind}, n long, deviation long, whitened array<double>"
        )
    else:
        shares, error = fitted.explained.tolist(), identity_error(vectors, fitted, vector_col)
        rows = whiten(vectors, fitted, id_col, vector_col)
    each = rows.select("vec_id", "n", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        "n",
        "deviation",
        "whitened",
        F.get(F.array(*map(F.lit, shares)), F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
