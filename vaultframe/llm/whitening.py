"""Whitened embeddings: leading covariance eigenvectors by LOBPCG over distributed block products.

Vectors become integers x, floor(scale * c). The covariance V is that of the distinct x vectors,
each once, divided by their number n; it is never formed. A block product V @ B is one pass over
the distinct vectors: each task centres its rows, multiplies them by the block, multiplies the
result by the centred rows transposed, and adds up; the parts are added by dimension.

Each round of LOBPCG takes the current block of vectors, their residuals and the previous search
directions, orthonormalises them into one basis, gets the basis' block product by one pass, and
does Rayleigh-Ritz there. The block is wider than the number of components asked for, so that
close eigenvalues just behind them don't slow it down. Rounds go on until the residuals
|V v - e v| of all components asked for are at most TOLERANCE times the largest eigenvalue, and
then until they stop getting smaller. A residual bounds the distance from e to an eigenvalue. If
the rounds end before that, it is an error, never a silent result. Where the block spans the whole
space, the first Rayleigh-Ritz step is the answer and the residuals certify it.

What the driver holds is blocks of (dimensions x columns) numbers, whatever the number of rows.

Cases: rows with null vectors, or null or non-finite components, are left out; null ids are rows
like others. Vectors may be of different lengths; components that are lacking are zero. Rows with
equal vectors count once in the fit and each get a result. Components are at most as many as there
are dimensions; a component whose eigenvalue is zero (up to rounding) has no whitened value: null,
with explained 0. With one distinct vector all are such. Vectors without components, and an empty table, give an empty
result. A deviation beyond 64 bits is held at their bound. Other columns are not carried.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultframe.llm.common import discard, materialise, tune
from vaultframe.llm.neighbours import finite

#: Columns of the block beyond the components asked for.
GUARD = 12
#: Certified residual as a share of the largest eigenvalue; rounds go on below it while it falls.
TOLERANCE = 1e-10
MOST_ROUNDS = 300
#: Rows that a task multiplies at once.
ROWS_AT_ONCE = 4096
MOST_LONG = 2**63 - 1


def quantised(embeddings: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(id, x): integer vectors of the rows that are used, id of the type it has."""
    whole = F.transform(F.col(vector), lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    return embeddings.where(finite(vector)).select(F.col(key).alias("id"), whole.alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column whose lists have one length."""
    return column.flatten().to_numpy().reshape(len(column), -1)


def moments(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """(n, S): the number of vectors and the exact sums of each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dims
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(0))
                n += len(x)
                safe = np.abs(x.astype(np.float64)).max(initial=0) * len(x) < 2**62
                sums = [s + int(v) for s, v in zip(sums, x.sum(axis=0) if safe else x.astype(object).sum(axis=0), strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, dims), pa.int32()), pa.array([decimal.Decimal(v) for v in (n, *sums)], pa.decimal128(38, 0))], ["dim", "total"])

    rows = fit.select("x").mapInArrow(add, "dim int, total decimal(38,0)").groupBy("dim").agg(F.sum("total").cast("decimal(38,0)").alias("total")).collect()
    found = {r["dim"]: int(r["total"]) for r in rows}
    return found.get(-1, 0), [found.get(d, 0) for d in range(dims)]


def means(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """S / n as whole numbers and remainders, so that centring loses nothing to large means."""
    whole = [s // n for s in sums]
    return np.array(whole, np.int64), np.array([(s - w * n) / n for s, w in zip(sums, whole, strict=True)])


def centred(x: np.ndarray, whole: np.ndarray, part: np.ndarray) -> np.ndarray:
    if np.abs(x.astype(np.float64)).max(initial=0) + np.abs(whole.astype(np.float64)).max(initial=0) < 2**62:
        return (x - whole).astype(np.float64) - part
    return (x.astype(object) - whole.astype(object)).astype(np.float64) - part


class Covariance:
    """V of the distinct vectors ``fit(x)`` as something to multiply blocks by; a pass for each product."""

    def __init__(self, fit: DataFrame, n: int, sums: list[int]):
        self.fit, self.n, self.dims = fit, n, len(sums)
        self.whole, self.part = means(n, sums)
        self.passes = 0

    def times(self, block: np.ndarray, with_trace: bool = False) -> np.ndarray:
        """V @ block; with_trace: a last column holds V's diagonal."""
        whole, part, dims, width = self.whole, self.part, self.dims, block.shape[1] + with_trace

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((dims, width))
            for b in batches:
                for s in range(0, b.num_rows, ROWS_AT_ONCE):
                    y = centred(matrix(b.column(0).slice(s, ROWS_AT_ONCE)), whole, part)
                    total[:, : block.shape[1]] += y.T @ (y @ block)
                    if with_trace:
                        total[:, -1] += (y * y).sum(axis=0)
            columns = [pa.array(range(dims), pa.int32()), *(pa.array(np.ascontiguousarray(c)) for c in total.T)]
            yield pa.RecordBatch.from_arrays(columns, ["dim", *(f"c{i}" for i in range(width))])

        parts = self.fit.select("x").mapInArrow(multiply, ", ".join(["dim int", *(f"c{i} double" for i in range(width))]))
        rows = parts.groupBy("dim").agg(*(F.sum(f"c{i}").alias(f"c{i}") for i in range(width))).toArrow()
        self.passes += 1
        out = np.zeros((dims, width))
        out[rows.column(0).to_numpy()] = np.stack([rows.column(i + 1).to_numpy() for i in range(width)], axis=1)
        return out / self.n


def basis(*blocks: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span those of all blocks; earlier blocks come first, dependent ones go."""
    dims = blocks[0].shape[0]
    out = np.zeros((dims, 0))
    for b in blocks:
        for _ in range(2):  # twice is enough
            b = b - out @ (out.T @ b)
            size = np.sqrt((b * b).sum(axis=0))
            b = b[:, size > 0] / size[size > 0]
        if b.shape[1]:
            u, s, _ = np.linalg.svd(b, full_matrices=False)
            u = u[:, s > 1e-12 * s.max(initial=0)]
            u = u - out @ (out.T @ u)
            out = np.linalg.qr(np.concatenate([out, u], axis=1)[:, :dims])[0]
    return out


def lobpcg(v: Covariance, components: int, tolerance: float = TOLERANCE, guard: int = GUARD) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """(eigenvalues, eigenvectors as columns, trace, residuals): the leading ones, falling."""
    wide = min(v.dims, components + guard)
    block = basis(np.random.default_rng(20260101).standard_normal((v.dims, wide)))
    search: list[np.ndarray] = []
    best: tuple[float, tuple] | None = None
    trace, stale = 0.0, 0
    for turn in range(MOST_ROUNDS):
        # basis vectors and their products; the block itself comes first and stays as it is
        space = basis(block, *search)
        product = v.times(space, with_trace=turn == 0)
        if turn == 0:
            trace, product = float(product[:, -1].sum()), product[:, :-1]
        small = space.T @ product
        values, turned = np.linalg.eigh((small + small.T) / 2)
        values, turned = values[::-1][:wide], turned[:, ::-1][:, :wide]
        new, image = space @ turned, product @ turned
        residual = image - new * values
        size = np.sqrt((residual[:, :components] ** 2).sum(axis=0))
        top = max(float(values[0]), 0.0)
        worst = float(size.max(initial=0))
        if best is None or worst < best[0]:
            stale = 0 if best is None or worst < best[0] / 2 else stale + 1
            best = worst, (values[:components].clip(0), new[:, :components], trace, size)
        else:
            stale += 1
        if worst <= tolerance * top and (stale >= 2 or worst <= 4 * np.finfo(float).eps * top):
            return best[1]
        if top == 0:
            return best[1]
        own = space[:, : block.shape[1]]
        search = [residual, new - own @ (own.T @ new)]  # the directions are what Rayleigh-Ritz took from outside the block
        block = new
    raise RuntimeError(f"residual {best[0] if best else None} after {MOST_ROUNDS} rounds: components are not certified")


def whiten(embeddings: DataFrame, key: str, vector: str, components: int = 4, scale: int = 256) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error, residual) for each usable row and component."""
    spark = embeddings.sparkSession
    tune(spark)
    schema = f"id {embeddings.schema[key].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double"
    ends = [F.lit(None).cast("double").alias("identity_error"), F.lit(None).cast("double").alias("residual")]
    rows = materialise(quantised(embeddings, key, vector, scale), "whitening-rows")
    dims, least = rows.agg(F.max(F.size("x")), F.min(F.size("x"))).first()
    if not dims:
        discard(rows)
        return spark.createDataFrame([], schema).select("*", *ends)
    level = lambda df: df if least == dims else df.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("x"))))
    fit = materialise(level(rows).select("x").distinct(), "whitening-fit")
    n, sums = moments(fit, dims)
    v = Covariance(fit, n, sums)
    values, vectors, trace, residuals = lobpcg(v, min(components, dims))
    # an eigenvalue that rounding can't tell from zero has no direction to whiten
    there = values > 1e-12 * max(trace, 0)
    scaled = np.where(there, vectors / np.sqrt(np.where(there, values, 1)), 0)
    explained = np.where(there, values / (trace or 1), 0)

    whole, part, few = v.whole, v.part, len(values)
    exact = np.array([s - int(w) * n for s, w in zip(sums, v.whole, strict=True)], object)  # n * x - S = n * (x - whole) - exact

    def deviations(x: np.ndarray) -> list[int]:
        most = (np.abs(x.astype(np.float64)).max(initial=0) + np.abs(whole.astype(np.float64)).max(initial=0) + 1) * n
        if most**2 * dims < 2**62:
            y = n * (x - whole) - exact.astype(np.int64)
            return (y * y).sum(axis=1).tolist()
        y = n * (x.astype(object) - whole.astype(object)) - exact
        return [min(int(d), MOST_LONG) for d in (y * y).sum(axis=1)]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, ROWS_AT_ONCE):
                b = batch.slice(s, ROWS_AT_ONCE)
                x = matrix(b.column(1))
                w = centred(x, whole, part) @ scaled
                take = pa.array(np.repeat(np.arange(len(x)), few))
                columns = [
                    b.column(0).take(take),
                    pa.array(np.tile(np.arange(1, few + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(x) * few, n, np.int64)),
                    pa.array(deviations(x), pa.int64()).take(take),
                    pa.array(w.reshape(-1), mask=np.tile(~there, len(x))),
                    pa.array(np.tile(explained, len(x))),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "component", "n", "deviation", "whitened", "explained"])

    # the covariance of what is whitened, from one more product over the fit list
    used = scaled[:, there]
    error = float(np.abs(used.T @ v.times(used) - np.eye(used.shape[1])).max(initial=0)) if used.shape[1] else None
    out = level(rows).select("id", "x").mapInArrow(project, schema)
    found = materialise(out.withColumn("identity_error", F.lit(error).cast("double")).withColumn("residual", F.element_at(F.array(*map(F.lit, residuals.tolist())), F.col("component"))), "whitening")
    for written in (rows, fit):
        discard(written)
    return found
