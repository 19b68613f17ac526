"""Embedding whitening.

Vectors become integers first, so that counts, sums and each row's distance from
the mean are exact.  The covariance of the distinct integer vectors is summed from
centred products, partition by partition.  Its pivoted Cholesky factor L goes
straight into one-sided Jacobi rotations: once the columns of L are orthogonal,
their squared lengths are the eigenvalues and the columns at length 1 the
eigenvectors, without ever working on L L' itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import checkpoint_dir

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Integers stay within plus or minus this, which no sum with ``SHIFT`` leaves.
BOUND = 1 << 60


@dataclass
class Whitening:
    """A fit over ``n`` distinct vectors with the sums ``sums``: ``axes`` has one
    unit eigenvector a column, ``values`` their eigenvalues, falling, and
    ``trace`` is the sum of all."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    trace: float

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean as whole part and rest, so that x - whole is exact."""
        whole = [s // self.n for s in self.sums]
        rest = [float(Fraction(s - w * self.n, self.n)) for s, w in zip(self.sums, whole)]
        return np.array(whole, np.int64), np.array(rest)


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L with L L' = ``a`` (symmetric, positive semidefinite), one column for each
    pivot; the largest remaining diagonal entry is the next pivot, and columns
    end where it is no more than rounding error.  Rows stay in ``a``'s order."""
    d = len(a)
    rest = np.array(np.diag(a), float)
    floor = d * np.finfo(float).eps * (rest.max() if d else 0)
    columns = np.zeros((d, d))
    for k in range(d):
        p = int(rest.argmax())
        if rest[p] <= floor:
            return columns[:, :k]
        col = a[:, p] - columns[:, :k] @ columns[p, :k]
        # earlier pivots are done: L is triangular in pivot order
        col[rest == 0] = 0
        col /= np.sqrt(rest[p])
        columns[:, k] = col
        rest = np.maximum(rest - col * col, 0)
        rest[p] = 0
    return columns


def jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvectors and eigenvalues of ``factor @ factor.T``: plane rotations make
    its columns orthogonal.  In each round of a sweep every column is in one pair,
    and all pairs turn at once."""
    u = np.array(factor, float)
    d, r = u.shape
    if r > 1:
        ring = list(range(r + r % 2))  # an odd count: one column rests in each round
        tiny = d * np.finfo(float).eps
        for _ in range(sweeps):
            worst = 0.0
            for _ in range(len(ring) - 1):
                pairs = [(min(a, b), max(a, b)) for a, b in zip(ring[:len(ring) // 2], ring[:len(ring) // 2 - 1:-1]) if max(a, b) < r]
                p, q = np.array(pairs).T
                x, y = u[:, p], u[:, q]
                aa, bb, ab = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
                off = np.abs(ab) / np.sqrt(aa * bb)
                worst = max(worst, float(off.max()))
                turn = off > tiny
                zeta = np.where(turn, (bb - aa) / (2 * np.where(turn, ab, 1)), 0)
                t = np.where(zeta >= 0, 1, -1) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
                t = np.where(turn, t, 0)
                c = 1 / np.sqrt(1 + t * t)
                u[:, p], u[:, q] = c * x - c * t * y, c * t * x + c * y
                ring = [ring[0], ring[-1], *ring[1:-1]]
            if worst <= tiny:
                break
        else:
            raise ArithmeticError("Jacobi rotations did not converge")
    values = (u * u).sum(0)
    order = np.argsort(-values, kind="stable")
    axes = u[:, order] / np.sqrt(values[order])
    big = np.abs(axes).argmax(0)
    return axes * np.where(axes[big, np.arange(r)] < 0, -1, 1), values[order]


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, x`` of rows with a vector that is neither null nor empty and has only
    finite components: x = floor(64 c) + 1000000, held within 2^60 on both sides."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    fine = (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where(F.col("v").isNotNull() & F.coalesce(fine, F.lit(False))).select(
        "id", F.transform("v", lambda c: F.greatest(F.least(F.floor(c * SCALE), F.lit(BOUND)), F.lit(-BOUND)) + F.lit(SHIFT)).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), -1)


def _moments(fit_list: DataFrame) -> tuple[int, list[int]]:
    """How many vectors, and their exact sums."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"))
                n += len(x)
                # 32 low bits and the rest apart: neither sum can overflow
                part = [(int(h) << 32) + int(low) for h, low in zip((x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0))]
                sums = part if sums is None else [a + b for a, b in zip(sums, part)]
        if n:
            yield pa.RecordBatch.from_pydict({"j": pa.array([-1, *range(len(sums))], pa.int32()), "s": pa.array([str(s) for s in (n, *sums)])})

    rows = (fit_list.select("x").mapInArrow(partial, "j int, s string").groupBy("j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
            .collect())
    found = {r["j"]: int(r["s"]) for r in rows}
    return found.get(-1, 0), [found[j] for j in range(len(found) - 1)]


def _gram(fit_list: DataFrame, width: int, rows_of) -> np.ndarray:
    """Sum of y y' over all rows y of ``rows_of(x)``.  Each partition sends its
    sum a row at a time, so rows of the matrix meet, not matrices."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                y = rows_of(_matrix(batch.column("x").slice(lo, 4096)))
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield pa.RecordBatch.from_pydict({"j": pa.array(np.arange(len(total)), pa.int32()),
                                              "row": pa.array([r.astype("<f8").tobytes() for r in total], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, None
        for batch in batches:
            done = []
            for j, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                row = np.frombuffer(row, "<f8")
                if j == last:
                    total = total + row
                else:
                    if last is not None:
                        done.append((last, total.tobytes()))
                    last, total = j, row
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int32()), pa.array([d[1] for d in done], pa.binary())],
                                                 names=["j", "row"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["j", "row"])

    sums = (fit_list.select("x").mapInArrow(partial, "j int, row binary").repartition("j").sortWithinPartitions("j")
            .mapInArrow(add, "j int, row binary").collect())
    out = np.zeros((width, width))
    for r in sums:
        out[r["j"]] = np.frombuffer(r["row"], "<f8")
    return out


def _centred(n: int, sums: list[int]):
    whole, rest = Whitening(n, sums, None, None, 0.0).centre()
    return lambda x: (x - whole).astype(float) - rest


def fit(fit_list: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Of the distinct integer vectors ``x`` (all of one length); None if there are
    none.  Components with no variance are left out."""
    n, sums = _moments(fit_list)
    if not n:
        return None
    cov = _gram(fit_list, len(sums), _centred(n, sums)) / n
    axes, values = jacobi(pivoted_cholesky((cov + cov.T) / 2))
    return Whitening(n, sums, axes[:, :components], values[:components], float(np.trace(cov)))


def identity_error(fit_list: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance, less the
    identity.  Rows are centred before they are projected."""
    k = len(model.values)
    if not k:
        return 0.0
    centred, turn = _centred(model.n, model.sums), model.axes / np.sqrt(model.values)
    return float(np.abs(_gram(fit_list, k, lambda x: centred(x) @ turn) / model.n - np.eye(k)).max())


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sum over the dimensions of (n x - S)^2; None beyond a long."""
    whole = [s // n for s in sums]
    rest = [s - w * n for s, w in zip(sums, whole)]
    near = x - np.array(whole, np.int64)
    if near.size and len(sums) * (n * (int(np.abs(near).max()) + 1)) ** 2 < 1 << 63:
        off = near * n - np.array(rest, np.int64)
        return (off * off).sum(1).tolist()
    exact = [sum((int(v) * n - r) ** 2 for v, r in zip(row, rest)) for row in near.tolist()]
    return [e if e < 1 << 63 else None for e in exact]


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row for each usable row of ``df`` and component, from 1 by falling
    eigenvalue: ``id, component, n, deviation, whitened, explained,
    identity_error``.

    Rows whose vector is null, empty or holds null or non-finite entries take no
    part, nor do vectors of another length than the most common (of several, the
    shortest).  The fit list has each distinct integer vector once, so repeated
    rows, however many, weigh as one; they all get their rows.  Null ids stay.
    Components without variance have no scale and are left out, so a table with
    fewer than two distinct vectors gives no rows, as does an empty one.  A
    deviation that does not fit in a long is null; entries beyond 2^60 count as
    2^60.  Other columns are not read.
    """
    spark = df.sparkSession
    rows = integer_vectors(df, id_col, vector_col)
    usual = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    rows = rows.where(F.size("x") == (usual[0]["d"] if usual else 0))
    folder = f"{checkpoint_dir(spark).rstrip('/')}/whitening-{uuid.uuid4().hex}"
    rows.select("x").distinct().write.option("compression", "zstd").parquet(folder)
    fit_list = spark.read.parquet(folder)
    model = fit(fit_list, components)
    schema = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return spark.createDataFrame([], schema)
    error = identity_error(fit_list, model)
    centred, turn, k = _centred(model.n, model.sums), model.axes / np.sqrt(model.values), len(model.values)
    n, sums, explained = model.n, model.sums, model.values / model.trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                x, m = _matrix(part.column("x")), part.num_rows
                which = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(which), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n), pa.int64()),
                     pa.array(_deviations(x, n, sums), pa.int64()).take(which), pa.array((centred(x) @ turn).ravel()),
                     pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema)
