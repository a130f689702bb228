"""Whitening of embeddings by the leading components of their covariance.

Entries become whole numbers, ``floor(64 * c) + 1000000``.  One pass sums them, a second sums products of their
distances from the whole number nearest to the mean; both sums are exact whatever the order, so the covariance
is the exact one rounded once and a lost task changes nothing.  What comes to the driver has the size of the
covariance.  Its leading eigenpairs come from ``spectrum``; two more passes measure the covariance of the whitened vectors and
give the rows.  Tasks work on batches of rows in arrays.

Defined results: a row is dropped if its vector is null or holds a null or non-finite entry, one of 2**40 or more
(its products could not be summed exactly), or has not the commonest number of entries (of equally common ones the
largest); repeated rows and ids count each; components without variance are left out, as nothing can be whitened by
them, so a table with one vector or only equal ones gives no rows, nor does an empty one; a deviation of 2**63 or more is null.  Other
columns are not read and may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireloom.llm import spectrum
from wireloom.llm.common import stage

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
LARGEST = float(1 << 40)
_EXACT, _LONG = 1 << 53, 1 << 62
_DECIMAL = pa.decimal128(38, 0)


class Fit(NamedTuple):
    n: int
    #: Whole number nearest to each dimension's mean, and what n times it leaves of the sum.
    centre: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    #: Eigenvectors as columns.
    vectors: np.ndarray
    trace: float

    def projection(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre) - self.rest / self.n


def usable(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have ``size`` finite entries, and those rows' whole numbers."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    keep = lengths == size
    entries = column.filter(pa.array(keep)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
    with np.errstate(invalid="ignore"):
        fine = (np.abs(entries) < LARGEST).all(axis=1)
    keep[keep] = fine
    return keep, np.floor(SCALE * entries[fine]).astype(np.int64) + OFFSET


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        column = batch.column(0)
        for size in pc.unique(pc.list_value_length(column)).to_pylist():
            if not size:
                continue
            x = usable(column, size)[1]
            if len(x):
                n, total = totals.get(size, (0, 0))
                totals[size] = n + len(x), total + x.sum(axis=0).astype(object)  # 1,000 rows of 2**46 fit
    for size, (n, total) in totals.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([size] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array([n] * size),
             pa.array([Decimal(int(t)) for t in total], _DECIMAL)],
            ["size", "pos", "n", "total"],
        )


def _products(centre: np.ndarray) -> Callable:
    size = len(centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros((size, size), object)
        part, bound = np.zeros((size, size), np.int64), 0
        for batch in batches:
            y = usable(batch.column(0), size)[1] - centre
            if not len(y):
                continue
            most = int(np.abs(y).max()) ** 2 * len(y)
            if most < _EXACT:  # doubles are exact this far
                if bound + most >= _LONG:
                    whole, part, bound = whole + part, np.zeros((size, size), np.int64), 0
                f = y.astype(float)
                part, bound = part + (f.T @ f).astype(np.int64), bound + most
            else:
                o = y.astype(object)
                whole = whole + o.T @ o
        whole = whole + part
        for i in range(size):
            yield pa.RecordBatch.from_arrays(
                [pa.array([i] * (size - i), pa.int32()), pa.array(range(i, size), pa.int32()),
                 pa.array([Decimal(int(t)) for t in whole[i, i:]], _DECIMAL)],
                ["i", "j", "total"],
            )

    return run


def covariance(n: int, rest: list[int], products: dict[tuple[int, int], int]) -> np.ndarray:
    """Covariance with divisor n from whole sums, each entry rounded once."""
    v = np.zeros((len(rest), len(rest)))
    for (i, j), total in products.items():
        v[i, j] = v[j, i] = (n * total - rest[i] * rest[j]) / (n * n)
    return v


def fit(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Fit | None:
    """Sums, leading components and trace over all usable vectors; None without any."""
    only = vectors.select(F.col(f"`{column}`").cast("array<double>").alias("v"))
    shape = "size int, pos int, n bigint, total decimal(38,0)"
    each = only.mapInArrow(_sums, shape).groupBy("size", "pos")
    sums = stage(each.agg(F.sum("n").alias("n"), F.sum("total").alias("total")), "vector-sums")
    common = sums.where("pos = 0").orderBy(F.desc("n"), F.desc("size")).first()
    if common is None:
        return None
    n = common.n
    totals = [int(r.total) for r in sums.where(F.col("size") == common.size).orderBy("pos").collect()]
    centre = [(2 * t + n) // (2 * n) for t in totals]
    rest = [t - n * c for t, c in zip(totals, centre, strict=True)]
    products = only.mapInArrow(_products(np.array(centre)), "i int, j int, total decimal(38,0)")
    found = products.groupBy("i", "j").agg(F.sum("total").alias("total")).collect()
    v = covariance(n, rest, {(r.i, r.j): int(r.total) for r in found})
    values, vectors_ = spectrum.leading(v, components)
    real = values > 16 * len(v) * spectrum.EPS * np.abs(v).sum(axis=1).max()
    return Fit(n, np.array(centre), np.array(rest), values[real], vectors_[:, real], float(np.trace(v)))


def identity_error(vectors: DataFrame, fitted: Fit, column: str = "embedding") -> float:
    """Largest entry of the covariance of whitened vectors minus the identity, measured on all of them."""
    size, k, projection = len(fitted.centre), len(fitted.values), fitted.projection()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            x = usable(batch.column(0), size)[1]
            # A column of ones makes the sums part of the products.
            w = np.column_stack((fitted.centred(x) @ projection, np.ones(len(x))))
            total += w.T @ w
        for i in range(k + 1):
            yield pa.RecordBatch.from_arrays(
                [pa.array([i] * (k + 1), pa.int32()), pa.array(range(k + 1), pa.int32()), pa.array(total[i])], ["i", "j", "total"]
            )

    only = vectors.select(F.col(f"`{column}`").cast("array<double>").alias("v"))
    sums = np.zeros((k + 1, k + 1))
    for r in only.mapInArrow(run, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect():
        sums[r.i, r.j] = r.total
    mean = sums[:k, k] / fitted.n
    return float(np.abs(sums[:k, :k] / fitted.n - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def deviations(x: np.ndarray, fitted: Fit) -> list[int | None]:
    """Exact sum of (n * x - S) ** 2 of each row; null if it is no long."""
    y = x - fitted.centre
    most = fitted.n * int(np.abs(y).max(initial=0)) + int(np.abs(fitted.rest).max(initial=0))
    if most**2 * x.shape[1] < _LONG:
        return ((fitted.n * y - fitted.rest) ** 2).sum(axis=1).tolist()
    q = fitted.n * y.astype(object) - fitted.rest.astype(object)
    return [s if s < 1 << 63 else None for s in (q * q).sum(axis=1).tolist()]


def whitened(vectors: DataFrame, fitted: Fit, id: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, component, deviation, whitened): a row for each usable row and component."""
    kind = vectors.schema[id].dataType.simpleString()
    size, k, projection = len(fitted.centre), len(fitted.values), fitted.projection()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, x = usable(batch.column(1), size)
            rows = np.repeat(np.flatnonzero(keep), k)
            w = fitted.centred(x) @ projection
            deviation = pa.array(deviations(x, fitted), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k)))
            component = np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array(component), deviation, pa.array(w.ravel())],
                ["id", "component", "deviation", "whitened"],
            )

    rows = vectors.select(F.col(f"`{id}`").alias("id"), F.col(f"`{column}`").cast("array<double>").alias("v"))
    shape = f"id {kind}, component int, deviation bigint, whitened double"
    return rows.mapInArrow(run, shape).withColumnRenamed("id", id)
