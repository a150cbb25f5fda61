"""Whitening of embeddings: exact moments in Spark, components by contour integration, projection row by row.

Entries become whole numbers, x = floor(64 c) + 1000000.  A first pass sums them per dimension.  A second pass sums the
products of their distances from the rounded means, so that numbers are small before they are multiplied, and the
remaining fractions of the means are taken off exactly.  Both sums are whole numbers: whatever order tasks
end in, and however often they are repeated, the covariance is the same to the last bit.  Each task sends one row per
entry of its matrix, which Spark adds up; the driver gets one matrix of dimensions squared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .contour import largest_eigenpairs

COMPONENTS = 32
#: Fixed by the contract of the query: entries in 64ths, lifted above zero.
SCALE, LIFT = 64, 1_000_000
_EXACT, _LONG = 1 << 53, 1 << 63


@dataclass(frozen=True)
class Whitening:
    """What a fit found: rows, sums, and the components with their variances."""

    dimensions: int
    n: int
    sums: tuple[int, ...]
    variances: np.ndarray
    axes: np.ndarray
    trace: float
    identity_error: float

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) for e in self.variances]


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there, not empty, and free of nulls and of entries that are not finite."""
    c = F.col(vector)
    bad = F.exists(c, lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) == float("inf")))
    return vectors.filter(c.isNotNull() & (F.size(c) > 0) & ~bad)


def _whole(batch: pa.RecordBatch, at: int, dimensions: int) -> np.ndarray:
    """The rows' vectors as whole numbers; entries beyond 2**61 are held there."""
    values = batch.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.clip(np.floor(values * SCALE), -(2.0**61), 2.0**61).astype(np.int64) + LIFT
    return x.reshape(-1, dimensions)


def _centre(sums: tuple[int, ...], n: int) -> tuple[np.ndarray, list[int]]:
    """Rounded means, and n times what is left of the means."""
    rounded = [(2 * s + n) // (2 * n) for s in sums]
    return np.array(rounded, dtype=np.int64), [s - n * r for s, r in zip(sums, rounded)]


def _products(z: np.ndarray) -> np.ndarray:
    """Exact sums of products of whole numbers, as Python's own numbers."""
    most = int(np.abs(z).max(initial=0))
    if most * most >= _EXACT:
        z = z.astype(object)
        return z.T @ z
    step = max(1, _EXACT // max(1, most * most) - 1)
    out = np.zeros((z.shape[1], z.shape[1]), dtype=object)
    for i in range(0, len(z), step):
        part = z[i : i + step].astype(np.float64)  # every partial sum is below 2**53: doubles hold it exactly
        out = out + (part.T @ part).astype(np.int64).astype(object)
    return out


def _added(rows: DataFrame, keys: list[str]) -> dict[tuple, int]:
    return {tuple(r[k] for k in keys): int(r["v"]) for r in rows.groupBy(*keys).agg(F.sum("v").alias("v")).collect()}


def _sums(rows: DataFrame, d: int) -> tuple[int, tuple[int, ...]]:
    """Rows and sums per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, dtype=object)
        for batch in batches:
            x = _whole(batch, 0, d)
            n += len(x)
            small = int(np.abs(x).max(initial=0)) * max(1, len(x)) < _LONG
            total = total + x.astype(np.int64 if small else object).sum(axis=0).astype(object)
        values = [Decimal(v) for v in (n, *total.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), pa.array(values, pa.decimal128(38, 0))], ["i", "v"])

    found = _added(rows.mapInArrow(run, "i int, v decimal(38,0)"), ["i"])
    return found.get((-1,), 0), tuple(found.get((i,), 0) for i in range(d))


def _covariance(rows: DataFrame, d: int, n: int, sums: tuple[int, ...]) -> np.ndarray:
    rounded, rest = _centre(sums, n)
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d), dtype=object)
        for batch in batches:
            total = total + _products(_whole(batch, 0, d) - rounded)
        values = [Decimal(v) for v in total[upper].tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), pa.array(values, pa.decimal128(38, 0))], ["i", "j", "v"])

    found = _added(rows.mapInArrow(run, "i int, j int, v decimal(38,0)"), ["i", "j"])
    v = np.zeros((d, d))
    for (i, j), total in found.items():
        v[i, j] = v[j, i] = (n * total - rest[i] * rest[j]) / (n * n)  # division of whole numbers, rounded once
    return v


def _distances(x: np.ndarray, n: int, rounded: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """n * x - S, exactly; as Python's own numbers where 64 bits don't hold them."""
    z = x - rounded
    if (int(np.abs(z).max(initial=0)) + 1) * n < _LONG:
        return z * np.int64(n) - rest.astype(np.int64)
    return z.astype(object) * n - rest


def _whitened(far: np.ndarray, n: int, axes: np.ndarray, variances: np.ndarray) -> np.ndarray:
    return (far.astype(np.float64) / n) @ (axes / np.sqrt(variances))


def _identity_error(rows: DataFrame, d: int, n: int, sums: tuple[int, ...], axes: np.ndarray, variances: np.ndarray) -> float:
    """Largest entry of the whitened rows' covariance less the identity."""
    rounded, rest = _centre(sums, n)
    rest, k = np.array(rest, dtype=object), len(variances)
    if not k:
        return 0.0
    first, second = (a.ravel() for a in np.indices((k, k)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, total = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            w = _whitened(_distances(_whole(batch, 0, d), n, rounded, rest), n, axes, variances)
            if len(w):
                mean = w.mean(axis=0)
                products += (w - mean).T @ (w - mean) + len(w) * np.outer(mean, mean)
                total += w.sum(axis=0)
        i, j = np.concatenate([first, np.arange(k)]), np.concatenate([second, np.full(k, -1)])
        values = np.concatenate([products.ravel(), total])
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(values)], ["i", "j", "v"])

    found = rows.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    products, total = np.zeros((k, k)), np.zeros(k)
    for r in found:
        if r["j"] < 0:
            total[r["i"]] = r["v"]
        else:
            products[r["i"], r["j"]] = r["v"]
    return float(np.abs(products / n - np.outer(total / n, total / n) - np.eye(k)).max())


def fit_whitening(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Fits on every usable row; None if there is none.

    The dimension is the most frequent length of the usable vectors (the smaller of equally frequent ones); rows
    of another length are left out.  Components whose variance is zero up to rounding are left out as well, so
    rows that are all equal give none.
    """
    rows = usable(vectors, vector)
    lengths = rows.groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n"))
    best = lengths.agg(F.max_by("d", F.struct("n", -F.col("d"))).alias("d")).first()["d"]
    if best is None:
        return None
    rows = rows.filter(F.size(vector) == best).select(vector)
    n, sums = _sums(rows, best)
    v = _covariance(rows, best, n, sums)
    variances, axes = largest_eigenpairs(v, components)
    return Whitening(best, n, sums, variances, axes, float(np.trace(v)), _identity_error(rows, best, n, sums, axes, variances))


def whiten(vectors: DataFrame, model: Whitening, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, deviation, whitened) of every usable row: n**2 times the squared distance from the mean, and its components.

    deviation is exact, and null where 64 bits don't hold it.  Ids may be null or repeat; other columns are not read.
    """
    rows = usable(vectors, vector).filter(F.size(vector) == model.dimensions).select(F.col(id_col).alias("id"), vector)
    id_type = rows.schema["id"].dataType.simpleString()
    n, d, axes, variances = model.n, model.dimensions, model.axes, model.variances
    rounded, rest = _centre(model.sums, n)
    rest, k = np.array(rest, dtype=object), len(variances)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = _distances(_whole(batch, 1, d), n, rounded, rest)
            most = int(np.abs(far).max(initial=0))
            if most * most * d < _LONG:
                deviation = (far * far).sum(axis=1).tolist()
            else:
                exact = (far.astype(object) ** 2).sum(axis=1).tolist()
                deviation = [v if v < _LONG else None for v in exact]
            w = _whitened(far, n, axes, variances)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(w) * k + 1, k) if k else np.zeros(len(w) + 1), pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation, pa.int64()), lists], ["id", "deviation", "whitened"])

    out = rows.mapInArrow(run, f"id {id_type}, deviation long, whitened array<double>")
    return out.withColumnRenamed("id", id_col)


def whitened_components(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per usable vector and component, with the fit's own figures beside them; no rows without a usable vector."""
    model = fit_whitening(vectors, vector)
    if model is None:
        kind = vectors.schema[id_col].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"{id_col} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    each = whiten(vectors, model, id_col, vector).select(id_col, "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.get(F.array(*[F.lit(e) for e in model.explained]).cast("array<double>"), F.col("at"))
    return each.select(
        id_col, (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        explained.alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
