"""Whitening of embeddings by principal components, found matrix-free.

Entries become whole numbers, floor(256 c). Each distinct vector counts once (a distinct aggregation combined before its shuffle, so copies
cost nothing). Sums per dimension are exact decimals; means are taken off before anything is multiplied. The covariance is never formed: a
Spark job gives its product with a few vectors at a time, C'(CQ)/n, of which only dimensions x vectors numbers reach the driver.

`leading` is a block Jacobi-Davidson method on these products. Each round it finds the Ritz pairs of its subspace, locks those whose residual has
come down to double precision, and solves for the others the correction equation, projected against all locked and wanted vectors, by some steps
of MINRES. The MINRES runs of a round go in step, so that each of their steps is one job for all. The subspace has a bounded size and is cut down
to its best Ritz vectors when it is full.

Dropped are rows whose vector is null or holds null, NaN or infinite entries; null ids and repeated rows stay, each a row. Vectors of different
lengths: shorter ones are filled up with zeros. Entries beyond the range of a long stop at its ends. With less than 4 dimensions there are
as many components; a component without variance (as with a single distinct vector) has null for `whitened`, and `explained` is null where
the trace is 0. `deviation` is exact; null if it is beyond a long. Equal eigenvalues: any orthonormal basis of their space. No remaining row: no
result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslens.session import staged

COMPONENTS = 4
LONG = 2**63 - 1
#: Residual, in units of the largest eigenvalue, from which a pair is locked: some rounding errors of a product.
RESIDUAL = 1e-14
#: Steps of an inner solution at most, and its accuracy.
INNER, INNER_FALL = 4, 0.1
ROUNDS = 200

Product = Callable[[np.ndarray], np.ndarray]


# --- eigenpairs ------------------------------------------------------------------------------------------------------------


def minres(theta: float, project: Callable[[np.ndarray], np.ndarray], right: np.ndarray) -> Generator[np.ndarray, np.ndarray, np.ndarray]:
    """Approximate solution of P(A - theta)P t = right; yields vectors and is sent A times them.

    Lanczos vectors with the QR factors of their tridiagonal matrix by Givens rotations, three terms at a time.
    """
    t = np.zeros_like(right)
    beta = np.linalg.norm(right)
    if beta == 0:
        return t
    goal = INNER_FALL * beta
    v_old, v = np.zeros_like(right), right / beta
    d_old, d_older = np.zeros_like(right), np.zeros_like(right)
    c_old, s_old, c_older, s_older, rest, off = 1.0, 0.0, 1.0, 0.0, beta, 0.0
    for _ in range(INNER):
        w = project((yield v) - theta * v) - off * v_old
        alpha = v @ w
        w = project(w - alpha * v)
        after = np.linalg.norm(w)
        upper, middle = s_older * off, c_older * off
        diagonal = c_old * alpha - s_old * middle
        middle = s_old * alpha + c_old * middle
        size = np.hypot(diagonal, after)
        if size <= 1e-300:
            break
        c, s = diagonal / size, after / size
        d = (v - middle * d_old - upper * d_older) / size
        t = t + c * rest * d
        rest = -s * rest
        if abs(rest) <= goal or after <= 1e-14 * beta:
            break
        d_older, d_old, v_old, v, off = d_old, d, v, w / after, after
        c_older, s_older, c_old, s_old = c_old, s_old, c, s
    return t


def in_step(runs: list[Generator[np.ndarray, np.ndarray, np.ndarray]], product: Product) -> list[np.ndarray]:
    """Results of several runs whose wishes for products are met together."""
    results: dict[int, np.ndarray] = {}
    wishes: dict[int, np.ndarray] = {}

    def go(i: int, value: np.ndarray | None) -> None:
        try:
            wishes[i] = runs[i].send(value)
        except StopIteration as end:
            results[i] = end.value
            wishes.pop(i, None)

    for i in range(len(runs)):
        go(i, None)
    while wishes:
        order = sorted(wishes)
        made = product(np.stack([wishes[i] for i in order], axis=1))
        for k, i in enumerate(order):
            go(i, made[:, k])
    return [results[i] for i in range(len(runs))]


def orthogonal(block: np.ndarray, *to: np.ndarray) -> np.ndarray:
    """Orthonormal columns of `block` apart from the spaces `to`; columns that lie in them, up to rounding, go."""
    out: list[np.ndarray] = []
    for x in block.T:
        size = np.linalg.norm(x)
        if size == 0:
            continue
        x = x / size
        for _ in range(3):
            for q in [*to, *([np.stack(out, axis=1)] if out else [])]:
                x = x - q @ (q.T @ x)
            size = np.linalg.norm(x)
            if size < 1e-10:
                break
            x = x / size
        else:
            out.append(x)
    return np.stack(out, axis=1) if out else np.zeros((len(block), 0))


def leading(product: Product, size: int, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest `wanted` eigenvalues, falling, and unit eigenvectors of a positive symmetric matrix given by its products."""
    wanted = min(wanted, size)
    guard = min(size, wanted + 2)
    largest, kept = min(size, max(24, 6 * guard)), min(size, 2 * guard)
    basis = orthogonal(np.random.default_rng(1).standard_normal((size, kept)))
    made = product(basis)
    values, locked, images = np.zeros(0), np.zeros((size, 0)), np.zeros((size, 0))
    best, idle = np.inf, 0
    for _ in range(ROUNDS):
        inner = basis.T @ made
        theta, y = np.linalg.eigh((inner + inner.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        ritz, image = basis @ y, made @ y
        scale = max(theta[0] if len(theta) else 0.0, values[0] if len(values) else 0.0, 0.0)
        missing = wanted - len(values)
        residuals = image[:, :missing] - ritz[:, :missing] * theta[:missing]
        residuals -= locked @ (locked.T @ residuals)
        norms = np.linalg.norm(residuals, axis=0)
        whole = basis.shape[1] + locked.shape[1] >= size
        worst = norms.max(initial=0.0)
        best, idle = (worst, 0) if worst < 0.5 * best else (best, idle + 1)
        # The whole space has no corrections, and noise of the products cannot be corrected either.
        final = whole or scale == 0 or (idle >= 4 and worst <= 100 * RESIDUAL * scale)
        done = 0
        while done < missing and (final or norms[done] <= RESIDUAL * scale):
            done += 1
        if done:
            values, locked, images = np.append(values, theta[:done]), np.hstack([locked, ritz[:, :done]]), np.hstack([images, image[:, :done]])
            basis, made, theta, ritz, image = ritz[:, done:], image[:, done:], theta[done:], ritz[:, done:], image[:, done:]
            residuals, missing, best, idle = residuals[:, done:], missing - done, np.inf, 0
        if not missing:
            break
        if basis.shape[1] + missing > largest:
            basis, made = orthogonal(ritz[:, :kept], locked), None
        taken = np.hstack([locked, ritz[:, :missing]])

        def project(x: np.ndarray, q: np.ndarray = taken) -> np.ndarray:
            return x - q @ (q.T @ x)

        steps = in_step([minres(theta[i], project, -project(residuals[:, i])) for i in range(missing)], product)
        new = orthogonal(np.hstack([np.stack(steps, axis=1), residuals]), locked, basis)[:, :missing]
        if not new.shape[1]:
            new = orthogonal(np.random.default_rng(len(values) + idle).standard_normal((size, 1)), locked, basis)
        # After a cut all images are made anew, so that rounding errors don't add up.
        made = np.hstack([made, product(new)]) if made is not None else product(np.hstack([basis, new]))
        basis = np.hstack([basis, new])
    else:
        raise ArithmeticError(f"no convergence in {ROUNDS} rounds: residual {worst / scale}")
    inner = locked.T @ images
    values, y = np.linalg.eigh((inner + inner.T) / 2)  # locked one after the other, ordered together
    return np.maximum(values[::-1], 0.0), orthogonal(locked @ y[:, ::-1])


# --- Spark -----------------------------------------------------------------------------------------------------------------


def whole_numbers(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, x): vectors of whole numbers, without rows whose vector is null or holds entries that are no finite numbers."""
    entries = F.transform(vector, lambda c: c.cast("double"))
    bad = F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = embeddings.where(F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(False)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(entries, _whole).alias("x"))


def _whole(c: Column) -> Column:
    scaled = F.floor(c * 256.0)
    edge = float(2**63)
    return F.when(c * 256.0 >= edge, F.lit(LONG)).when(c * 256.0 <= -edge, F.lit(-LONG - 1)).otherwise(scaled).cast("long")


def filled(rows: DataFrame) -> tuple[DataFrame, int]:
    """Rows with vectors of one length, and that length."""
    low, high = rows.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if low != high:
        rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(high) - F.size("x"))))
    return rows, high or 0


@dataclass(frozen=True)
class Fit:
    """Distinct vectors (a written table), their number and exact sums per dimension."""

    rows: DataFrame
    n: int
    sums: list[int]

    def shifts(self) -> tuple[np.ndarray, np.ndarray]:
        """Whole part and remainder (over n) of each mean, so that x - S/n is rounded once."""
        return np.array([s // self.n for s in self.sums], np.int64), np.array([s % self.n for s in self.sums], np.int64)


def matrix(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def centred(x: np.ndarray, whole: np.ndarray, rest: np.ndarray, n: int) -> np.ndarray:
    safe = len(x) == 0 or max(abs(int(x.max())), abs(int(x.min()))) < 2**62
    return (x - whole if safe else x.astype(float) - whole) - rest / n


def fit_list(rows: DataFrame, size: int) -> Fit:
    distinct = staged(rows.select("x").distinct())

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high = low = np.zeros(size, np.int64)
        count = 0
        total = [0] * size
        for batch in batches:
            for a in range(0, batch.num_rows, 1 << 16):  # 2^16 halves of numbers stay within a long
                x = matrix(batch.slice(a, 1 << 16), size)
                high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
                total = [t + (int(h) << 32) + int(o) for t, h, o in zip(total, high, low, strict=True)]
                count += len(x)
        if count:
            from decimal import Decimal

            yield pa.RecordBatch.from_arrays(
                [pa.array(range(-1, size), pa.int32()), pa.array([Decimal(t) for t in [count, *total]], pa.decimal128(38, 0))], names=["dim", "s"]
            )

    found = {r["dim"]: int(r["s"]) for r in distinct.mapInArrow(sums, "dim int, s decimal(38,0)").groupBy("dim").agg(F.sum("s").alias("s")).collect()}
    return Fit(distinct, found.get(-1, 0), [found.get(d, 0) for d in range(size)])


def covariance_product(fit: Fit, size: int) -> Product:
    """Products of the covariance with the columns of a matrix, each a job: partial sums by task, added up by dimension."""
    (whole, rest), n = fit.shifts(), fit.n

    def product(q: np.ndarray) -> np.ndarray:
        names = [f"p{i}" for i in range(q.shape[1])]

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros_like(q)
            for batch in batches:
                c = centred(matrix(batch, size), whole, rest, n)
                out += c.T @ (c @ q)
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), *[pa.array(np.ascontiguousarray(x)) for x in out.T]], names=["dim", *names])

        parts = fit.rows.mapInArrow(partial, ", ".join(["dim int"] + [f"{c} double" for c in names]))
        made = parts.groupBy("dim").agg(*[F.sum(c).alias(c) for c in names]).collect()
        out = np.zeros_like(q)
        for r in made:
            out[r["dim"]] = r[1:]
        return out / n

    return product


def moments(fit: Fit, size: int, project: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Trace of the covariance; mean and second moment of the centred vectors projected on the columns."""
    (whole, rest), n, k = fit.shifts(), fit.n, project.shape[1]
    places = [(0, 0)] + [(1, i) for i in range(k)] + [(2 + i, j) for i in range(k) for j in range(k)]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(len(places))
        for batch in batches:
            c = centred(matrix(batch, size), whole, rest, n)
            z = c @ project
            out += np.concatenate([[np.sum(c * c)], z.sum(axis=0), (z.T @ z).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(places)), pa.int32()), pa.array(out)], names=["place", "s"])

    found = {r["place"]: r["s"] / n for r in fit.rows.mapInArrow(partial, "place int, s double").groupBy("place").agg(F.sum("s").alias("s")).collect()}
    all_sums = np.array([found[i] for i in range(len(places))])
    return all_sums[0], all_sums[1 : 1 + k], all_sums[1 + k :].reshape(k, k)


def deviations(x: np.ndarray, whole: np.ndarray, rest: np.ndarray, n: int) -> list[int | None]:
    """Sum of (n x - S)^2 over the dimensions, exactly."""
    most = n * (max((abs(int(v)) for v in (x.max(initial=0), x.min(initial=0))), default=0) + int(np.abs(whole).max(initial=0)) + 1)
    if most * most * max(1, x.shape[1]) <= LONG:
        d = n * (x - whole) - rest
        return (d * d).sum(axis=1).tolist()
    return [s if (s := reduce(lambda t, d: t + d * d, [n * (int(a) - int(w)) - int(r) for a, w, r in zip(row, whole, rest, strict=True)], 0)) <= LONG else None for row in x]


WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> DataFrame:
    """One row per remaining row and component: its whitened coordinate, and the figures of the fit."""
    spark = embeddings.sparkSession
    rows, size = filled(whole_numbers(embeddings, vector))
    if size == 0:
        return spark.createDataFrame([], WHITENED)
    fit = fit_list(rows, size)
    (whole, rest), n = fit.shifts(), fit.n
    values, vectors = leading(covariance_product(fit, size), size, components)
    trace, _, _ = moments(fit, size, vectors[:, :0])
    real = values > 1e-13 * trace
    scaled = vectors[:, real] / np.sqrt(values[real])
    _, mean, second = moments(fit, size, scaled)
    error = float(np.abs(second - np.outer(mean, mean) - np.eye(len(mean))).max(initial=0.0))
    explained = [float(e / trace) if trace > 0 else None for e in values]

    def coordinates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(values)
        for batch in batches:
            x = matrix(batch, size)
            z = np.full((len(x), k), np.nan)
            z[:, real] = centred(x, whole, rest, n) @ scaled
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(np.repeat(np.arange(len(x)), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(x) * k, n, np.int64)),
                    pa.array([d for d in deviations(x, whole, rest, n) for _ in range(k)], pa.int64()),
                    pa.array(z.ravel(), from_pandas=True),
                    pa.array(explained * len(x), pa.float64()),
                    pa.array(np.full(len(x) * k, error)),
                ],
                names=[c.split()[0] for c in WHITENED.split(", ")],
            )

    return rows.mapInArrow(coordinates, WHITENED)
