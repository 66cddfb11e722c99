"""Embedding whitening: leading principal components by a matrix-free block Jacobi-Davidson.

The covariance is never formed. Its product with a few vectors is one pass over the table: every
task centres its rows and adds up z (z . u); Spark adds the tasks' sums. The components come from a
search space on the driver, which holds a few dozen vectors of the embedding's length:

* Rayleigh-Ritz in the search space gives approximate pairs; pairs whose residual has reached
  double precision are locked, from the largest eigenvalue down.
* For each open pair (e, u) the correction equation (I - QQ')(A - e)(I - QQ') t = -r, Q being the
  locked vectors and u, is solved roughly by a few steps of MINRES. All open pairs take a step
  together, so a step is one pass, whatever their number.
* The corrections widen the search space; when it is full it restarts from its best Ritz vectors.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from aislewise.llm.common import map_batches
from aislewise.llm.vectors import floored, matrix, summed, usable, usual_length
from aislewise.session import stored

COMPONENTS = 8
SCALE, OFFSET = 1024, 100_000
INNER = 6            # MINRES steps of a correction
PRECISION = 32       # times machine epsilon and the largest eigenvalue: the residual to reach
OUTER = 200          # rounds, at most
BLOCK = 4096         # rows of a block
_EPSILON = np.finfo(float).eps
Product = Callable[[np.ndarray], np.ndarray]


def _minres(product: Product, shift: np.ndarray, project: Product, right: np.ndarray,
            steps: int) -> np.ndarray:
    """Rough solutions of P (A - shift_j) P t_j = right_j, one per column, in lockstep."""
    count = right.shape[1]
    x, w, w_old = np.zeros_like(right), np.zeros_like(right), np.zeros_like(right)
    beta = np.linalg.norm(right, axis=0)
    safe = lambda v: np.where(v > 0, v, 1.0)
    v, v_old = right / safe(beta), np.zeros_like(right)
    eta, old_beta = beta.copy(), np.zeros(count)
    c, s, c_old, s_old = np.ones(count), np.zeros(count), np.ones(count), np.zeros(count)
    for _ in range(steps):
        y = project(product(v) - v * shift)
        alpha = (v * y).sum(0)
        y = project(y - alpha * v - old_beta * v_old)
        beta = np.linalg.norm(y, axis=0)
        # Givens rotations on the new column of the tridiagonal matrix.
        delta = c * alpha - c_old * s * old_beta
        high, middle = s_old * old_beta, s * alpha + c_old * c * old_beta
        low = np.hypot(delta, beta)
        c_old, s_old = c, s
        c, s = np.where(low > 0, delta / safe(low), 1.0), np.where(low > 0, beta / safe(low), 0.0)
        new = np.where(low > 0, (v - middle * w - high * w_old) / safe(low), 0.0)
        w_old, w = w, new
        x = x + c * eta * w
        eta = -s * eta
        live = beta > _EPSILON * np.abs(shift)
        v_old, v = v, np.where(live, y / safe(beta), 0.0)
        old_beta = np.where(live, beta, 0.0)
    return x


def _against(basis: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span ``block`` without ``basis``; dependent ones are left out."""
    out = np.zeros((len(block), 0))
    for column in block.T:
        size = np.linalg.norm(column)
        if not size > 0:
            continue
        column, held = column / size, np.hstack([basis, out])
        for _ in range(2):
            column = column - held @ (held.T @ column)
            rest = np.linalg.norm(column)
            if rest < 1e-8:
                break
            column = column / rest
        else:
            out = np.hstack([out, column[:, None]])
    return out


def jacobi_davidson(product: Product, size: int, count: int, seed: int = 7, inner: int = INNER,
                    precision: float = PRECISION, outer: int = OUTER
                    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues of a symmetric operator, unit eigenvectors as columns,
    and the residuals' norms; fewer when the operator is smaller."""
    count = min(count, size)
    keep, widest = min(size, 2 * count), min(size, 5 * count)
    start = np.random.default_rng(seed).normal(size=(size, keep))
    locked, basis = np.zeros((size, 0)), np.linalg.qr(start)[0]
    image = product(basis)
    best = np.inf
    for turn in range(outer + 1):
        small = basis.T @ image
        value, turned = np.linalg.eigh((small + small.T) / 2)
        value, turned = value[::-1], turned[:, ::-1]
        basis, image = basis @ turned, image @ turned
        wanted = count - locked.shape[1]
        residual = image[:, :wanted] - basis[:, :wanted] * value[:wanted]
        residual -= locked @ (locked.T @ residual)
        norm = np.linalg.norm(residual, axis=0)
        top = max(abs(value[0]), best if np.isfinite(best) else 0.0)
        best = top
        done = 0
        while done < wanted and norm[done] <= precision * _EPSILON * top:
            done += 1
        if basis.shape[1] + locked.shape[1] >= size:  # the space is whole: nothing to add
            done = wanted
        locked = np.hstack([locked, basis[:, :done]])
        basis, image = basis[:, done:], image[:, done:]
        if locked.shape[1] == count:
            break
        if turn == outer:
            raise RuntimeError(f"{count - locked.shape[1]} components did not converge")
        open_pairs = basis[:, :wanted - done]
        shift, residual = value[done:wanted], residual[:, done:]

        def project(y: np.ndarray, u=open_pairs, q=locked) -> np.ndarray:
            y = y - u * (u * y).sum(0)
            return y - q @ (q.T @ y)

        correction = _minres(product, shift, project, -project(residual), inner)
        if basis.shape[1] + correction.shape[1] > widest - locked.shape[1]:
            basis = basis[:, :max(keep - locked.shape[1], wanted - done)]
            basis = np.linalg.qr(basis - locked @ (locked.T @ basis))[0]
            image = product(basis)
        added = _against(np.hstack([locked, basis]), correction)
        if not added.shape[1]:  # every correction is in the space already
            added = _against(np.hstack([locked, basis]),
                             np.random.default_rng(turn).normal(size=(size, 1)))
        basis, image = np.hstack([basis, added]), np.hstack([image, product(added)])
    # A last Rayleigh-Ritz step over the locked vectors, from one fresh product.
    locked = np.linalg.qr(locked)[0]
    image = product(locked)
    small = locked.T @ image
    value, turned = np.linalg.eigh((small + small.T) / 2)
    value, turned = value[::-1], turned[:, ::-1]
    vectors, image = locked @ turned, image @ turned
    norm = np.linalg.norm(image - vectors * value, axis=0)
    return value, vectors, norm


@dataclass
class Whitening:
    """What the projection needs: a few vectors of the embedding's length."""

    n: int
    sums: np.ndarray          # exact, per dimension
    values: np.ndarray        # eigenvalues, falling
    vectors: np.ndarray       # unit eigenvectors as columns
    residuals: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n in doubles; whole parts are subtracted as integers."""
        return (x - self.sums // self.n) - (self.sums % self.n) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)


def _blocks(rows: DataFrame, model: Whitening, size: int) -> DataFrame:
    """(x) to blocks of centred rows, each one binary value of at most ``BLOCK`` rows."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        z = model.centred(matrix(batch.column(0), size))
        return pa.RecordBatch.from_arrays([pa.array([z.tobytes()], pa.binary())], names=["block"])

    return map_batches(rows.select("x"), run, "block binary", BLOCK)


def fit(rows: DataFrame, size: int, components: int = COMPONENTS, inner: int = INNER,
        precision: float = PRECISION) -> Whitening | None:
    """(x array of long, all of length ``size``) to the whitening; None for an empty table."""

    def totals(batch: pa.RecordBatch) -> np.ndarray:
        x = matrix(batch.column(0), size)
        return np.r_[len(x), x.sum(0)]

    found = summed(rows.select("x"), totals, "long")
    if found is None:
        return None
    model = Whitening(int(found[0, 0]), found[0, 1:], np.zeros(0), np.zeros((size, 0)),
                      np.zeros(0), 0.0)
    blocks = stored(_blocks(rows, model, size))
    held = lambda batch: [np.frombuffer(b.as_buffer(), np.float64).reshape(-1, size)
                          for b in batch.column(0)]

    def product(u: np.ndarray) -> np.ndarray:
        return summed(blocks, lambda batch: sum(z.T @ (z @ u) for z in held(batch))) / model.n

    model.trace = float(summed(blocks, lambda batch: np.array(
        [sum((z * z).sum() for z in held(batch))]))[0, 0]) / model.n
    if model.trace > 0:
        value, vectors, residual = jacobi_davidson(product, size, components, inner=inner,
                                                   precision=precision)
        real = value > size * _EPSILON * model.trace
        vectors = vectors * np.where(
            vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
        model.values, model.vectors = value[real], vectors[:, real]
        model.residuals = residual[real]
    return model


def identity_error(rows: DataFrame, model: Whitening, size: int) -> float | None:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    if not len(model.values):
        return None
    part = lambda batch: model.whitened(matrix(batch.column(0), size))
    mean = summed(rows.select("x"), lambda batch: part(batch).sum(0))[0] / model.n

    def square(batch: pa.RecordBatch) -> np.ndarray:
        w = part(batch) - mean
        return w.T @ w

    covariance = summed(rows.select("x"), square) / model.n
    return float(np.abs(covariance - np.eye(len(covariance))).max())


def deviation(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum over the dimensions of (n x - sums)**2, exact; None where a long can't hold it."""
    far = x * n - sums
    if not far.size:
        return [0] * len(x)
    if int(np.abs(far).max()) ** 2 * far.shape[1] < 1 << 63:
        return (far * far).sum(1).tolist()
    exact = [sum(v * v for v in row) for row in far.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def project(rows: DataFrame, model: Whitening, size: int, error: float | None) -> DataFrame:
    """(id, x) to one row per row and component."""
    count = len(model.values)
    explained = model.values / model.trace if count else np.zeros(0)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = matrix(batch.column(1), size)
        ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), count)))
        rows_of = lambda values: np.tile(values, len(x))
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(rows_of(np.arange(1, count + 1)).astype(np.int32)),
             pa.array(np.full(len(x) * count, model.n)),
             pa.array([v for v in deviation(x, model.n, model.sums) for _ in range(count)],
                      pa.int64()),
             pa.array(model.whitened(x).ravel()), pa.array(rows_of(explained)),
             pa.array(np.full(len(x) * count, error if error is not None else np.nan))],
            names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = rows.schema["id"].dataType.simpleString()
    return map_batches(rows.select("id", "x"), run,
                       f"id {kind}, component int, n long, deviation long, whitened double, "
                       "explained double, identity_error double", BLOCK)


def whiten(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding",
           components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET,
           inner: int = INNER, precision: float = PRECISION) -> DataFrame:
    """One row per usable vector and component: id, component (from 1, by falling eigenvalue), n,
    deviation, whitened, explained, identity_error.

    Vectors that are null or hold a null or non-finite entry are left out, and so are vectors whose
    length is not the usual one. The rest count as integers floor(scale * c) + offset, cut to 2**40.
    Repeated rows and rows without an id all count and stay. Directions without variance have no
    component, so there may be fewer than ``components``, and none where all vectors are equal or
    the table is empty. A deviation that a long can't hold is null. Other columns are ignored.
    """
    rows = stored(vectors.where(usable(F.col(vector_column))).select(
        F.col(id_column).alias("id"),
        floored(F.col(vector_column), scale, offset, 1 << 40).alias("x")))
    size = usual_length(rows)
    rows = rows.where(F.size("x") == size)
    model = fit(rows, size, components, inner, precision) if size else None
    if model is None:
        model = Whitening(1, np.zeros(size, np.int64), np.zeros(0), np.zeros((size, 0)),
                          np.zeros(0), 0.0)
        rows = rows.limit(0)
    return project(rows, model, size, identity_error(rows, model, size))
