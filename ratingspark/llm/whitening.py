"""Embedding whitening from a polarised covariance: variances of dimensions and of sums of two dimensions, nothing else.

Every entry c becomes the integer x = floor(scale * c) + offset. For integers the squared deviations of a dimension, and of
the sum of two dimensions, add up exactly, whatever the order; and cov(a, b) = (var(a + b) - var(a) - var(b)) / 2 recovers
every covariance. Tasks add up squares of y = x - floor(mean), small whole numbers; Spark adds the tasks' totals,
d (d + 1) / 2 decimals each; the driver removes what the floor left over by exact integer arithmetic, divides
once, and hands the d x d matrix to ``eigh``. So the matrix is right to the last bit of a double, for any number and order of rows.

All work on rows stays in the partition they lie in: passes over the vectors for their length, their sums, their squares, the covariance of
the result, and the result. They are read anew each time, nothing is cached; only totals, whose number depends on
the dimensions alone, meet in the driver.

Defined results: rows whose vector is null or empty, or holds a null, a non-finite entry or one whose x is beyond a long, are
dropped; of vectors of different lengths those of the commonest length stay (ties: the longer). An empty table, or one
without such rows, gives no rows. Null and repeated keys are kept row by row, and repeated rows count each time. A component without
variance (one row, a constant or dependent dimension) has a null ``whitened`` and is no part of ``identity_error``, which is
null if no component has variance; ``explained`` is null if nothing varies. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows squared at a time, so that a pass over all pairs of dimensions stays in a core's cache.
ROWS = 1024
LARGEST = 2.0**62
NUMBER = pa.decimal128(38, 0)


class Fit(NamedTuple):
    """Of the fit list: rows, floor of each mean, what the sums hold beyond it, components (columns), their variances, all variance."""

    n: int
    floors: list[int]
    rests: list[int]
    axes: np.ndarray
    variances: np.ndarray
    total: float

    @property
    def scaled(self) -> np.ndarray:
        """The axes over the root of their variance; those without variance are zero."""
        varied = self.varied
        return np.where(varied, self.axes / np.sqrt(np.where(varied, self.variances, 1.0)), 0.0)

    @property
    def varied(self) -> np.ndarray:
        return self.variances > 1e-12 * self.total


def integers(vectors: DataFrame, key: str, vector: str, scale: float, offset: int) -> tuple[DataFrame, int]:
    """(key, x) of the rows that take part, x their vector as an array of longs, and the number of dimensions."""
    scaled = F.transform(F.col(vector).cast("array<double>"), lambda c: scale * c)
    fine = F.forall("s", lambda c: c.isNotNull() & (F.abs(c) < LARGEST)) & (F.size("s") > 0)  # NaN is above all numbers
    rows = vectors.select(F.col(key).alias("key"), scaled.alias("s")).filter(fine)
    lengths = rows.groupBy(F.size("s").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = lengths[0]["d"] if lengths else 0
    return rows.filter(F.size("s") == d).select("key", F.transform("s", lambda c: F.floor(c) + offset).alias("x")), d


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _exact(values: np.ndarray, factor: int = 1) -> np.ndarray:
    """``values``, as Python integers if sums of ``ROWS`` x d squares of them (times ``factor``) might leave 64 bits."""
    most = max(abs(int(values.max(initial=0))), abs(int(values.min(initial=0))))
    return values.astype(object) if most * most * factor * values.size >= 1 << 61 else values


def _centred(x: np.ndarray, floors: list[int]) -> np.ndarray:
    if max(map(abs, floors)) < 1 << 61 and abs(int(x.max(initial=0))) < 1 << 61 and abs(int(x.min(initial=0))) < 1 << 61:
        return x - np.array(floors, np.int64)
    return x.astype(object) - np.array(floors, object)


def _added(rows: DataFrame, d: int, totals: Callable[[np.ndarray], list], kind: str) -> list:
    """``totals`` (of a block of x, one list of numbers) added over all rows; ``kind`` is the type of the sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = None
        for b in batches:
            x = _matrix(b.column(0), d)
            for lo in range(0, len(x), ROWS):
                block = totals(x[lo:lo + ROWS])
                mine = block if mine is None else [a + c for a, c in zip(mine, block, strict=True)]
        if mine is not None:
            values = pa.array([Decimal(v) for v in mine], NUMBER) if kind != "double" else pa.array(mine, pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(range(len(mine)), pa.int32()), values], ["i", "total"])

    parts = rows.select("x").mapInArrow(run, f"i int, total {kind}")
    return [r["total"] for r in parts.groupBy("i").agg(F.sum("total").alias("total")).orderBy("i").collect()]


def squares(y: np.ndarray) -> list[int]:
    """Sums over the rows of y_a^2 for every dimension, then of (y_a + y_b)^2 for every pair a < b."""
    y = _exact(y, 4)
    out = [int(v) for v in (y * y).sum(axis=0)]
    columns = np.ascontiguousarray(y.T)
    for a in range(len(columns) - 1):
        both = columns[a + 1:] + columns[a]
        out += [int(v) for v in (both * both).sum(axis=1)]
    return out


def covariance(n: int, rests: list[int], added: list[int]) -> np.ndarray:
    """The covariance matrix (divisor n) from the sums of squares, each entry the double next to the exact value.

    n^2 var = n * sum(y^2) - rest^2 for whole numbers y whose sum is ``rest``.
    """
    d = len(rests)
    single = [n * added[a] - rests[a] ** 2 for a in range(d)]
    out = np.empty((d, d))
    at = d
    for a in range(d):
        out[a, a] = single[a] / n**2
        for b in range(a + 1, d):
            pair = n * added[at] - (rests[a] + rests[b]) ** 2
            out[a, b] = out[b, a] = (pair - single[a] - single[b]) / (2 * n**2)
            at += 1
    return out


def fit(rows: DataFrame, d: int, components: int) -> Fit | None:
    """Means, covariance and leading components of the integer vectors ``rows``; None if there are none."""
    sums = _added(rows, d, lambda x: [len(x), *(int(v) for v in _exact(x).sum(axis=0))], "decimal(38,0)") if d else []
    if not sums:
        return None
    n, sums = int(sums[0]), [int(s) for s in sums[1:]]
    floors = [s // n for s in sums]
    rests = [s - n * m for s, m in zip(sums, floors, strict=True)]
    added = [int(v) for v in _added(rows, d, lambda x: squares(_centred(x, floors)), "decimal(38,0)")]
    matrix = covariance(n, rests, added)
    values, axes = np.linalg.eigh(matrix)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), range(axes.shape[1])] < 0, -1.0, 1.0)  # one sign for all runs
    return Fit(n, floors, rests, axes, values, float(np.trace(matrix)))


def _projected(x: np.ndarray, model: Fit) -> np.ndarray:
    return (_centred(x, model.floors).astype(float) - np.array([r / model.n for r in model.rests])) @ model.scaled


def _products(z: np.ndarray) -> list[float]:
    return [*z.sum(axis=0), *(z.T @ z).ravel()]


def identity_error(rows: DataFrame, d: int, model: Fit) -> float | None:
    """The largest entry of |covariance of the whitened rows - identity|, over the components that vary; measured on the rows."""
    k = len(model.variances)
    added = np.array(_added(rows, d, lambda x: _products(_projected(x, model)), "double"))
    means, products = added[:k] / model.n, added[k:].reshape(k, k) / model.n
    gap = np.abs(products - np.outer(means, means) - np.eye(k))[np.ix_(model.varied, model.varied)]
    return float(gap.max()) if gap.size else None


def _deviations(y: np.ndarray, model: Fit) -> list[Decimal]:
    """Sums over the dimensions of (n x - S)^2, where n x - S = n y - rest."""
    n, y = model.n, _exact(y, len(model.rests))
    rests = np.array(model.rests, np.int64)
    if y.dtype == object or len(rests) * n * int(np.abs(y).max(initial=0)) >= 1 << 62:
        y, rests = y.astype(object), rests.astype(object)
    own, cross, rest = (y * y).sum(axis=1).tolist(), (y * rests).sum(axis=1).tolist(), sum(r * r for r in model.rests)
    return [Decimal(n * n * a - 2 * n * b + rest) for a, b in zip(own, cross, strict=True)]


def whiten(vectors: DataFrame, components: int = 8, scale: float = 1.0, offset: int = 0, key: str = "vec_id",
           vector: str = "embedding") -> DataFrame:
    """One row per row that takes part and component (from 1, by falling variance; at most the dimensions): the key, ``n``,
    ``deviation`` (decimal, exact sum over the dimensions of (n x - S)^2), ``whitened``, ``explained`` (the component's
    share of all variance) and ``identity_error``."""
    rows, d = integers(vectors, key, vector, scale, offset)
    model = fit(rows, d, components)
    kind = rows.schema["key"].dataType.simpleString()
    schema = (f"key {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    error, k = identity_error(rows, d, model), len(model.variances)
    explained = [float(e) / model.total if model.total > 0 else None for e in model.variances]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), d)
            turns = np.repeat(np.arange(len(x)), k)
            each = lambda values, t: pa.array(values * len(x), t)  # noqa: B023, E731
            z = _projected(x, model)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(turns)), each(list(range(1, k + 1)), pa.int32()), each([model.n] * k, pa.int64()),
                 pa.array(_deviations(_centred(x, model.floors), model), NUMBER).take(pa.array(turns)),
                 pa.array(z.ravel(), mask=np.tile(~model.varied, len(x))), each(explained, pa.float64()), each([error] * k, pa.float64())],
                ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
