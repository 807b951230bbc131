"""Whitening of embeddings: rotated to their principal components, each scaled to variance 1.

1. Entries become whole numbers, floor(scale * c) + shift, so that sums, means and squares are exact. The fit list is each distinct
   vector once (a shuffle by the vector with partial aggregation: a vector that a third of all rows have counts once).
2. The number of fit vectors n and the sums S of each dimension are added up in whole numbers. Every vector is centred exactly, n * x - S, and
   only then divided by n: nothing is lost to the size of the mean.
3. MLlib's RowMatrix of the centred rows gives their Gramian, n times the covariance. It is as large as the square of the vectors' length
   and the only thing that comes to the driver, where ``eigh`` finds the components.
4. The whitening matrix is broadcast (vector length times components) and all rows go through it in ``mapInPandas``. Over the whitened
   fit list a second Gramian measures how far its covariance is from the identity.

Vectors of different lengths are spaces of their own, each with its own fit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaero.llm.common import batch_of, in_batches, materialise
from quaero.llm.vectors import matrix

SCALE, SHIFT = 64, 1_000_000
#: Entries of this size and more, scaled, can't be kept exactly as whole numbers.
LARGEST = 2**52


@dataclass(frozen=True)
class Fit:
    """``sums`` of n vectors by dimension; ``axes`` has a component in each column, ``values`` their eigenvalues, both by falling eigenvalue."""

    n: int
    sums: np.ndarray
    axes: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def matrix(self) -> np.ndarray:
        return self.axes / np.sqrt(self.values)


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, x``: the vectors that take part, as whole numbers."""
    v = F.col("v")
    held = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * SCALE) < LARGEST))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter(held)
    return rows.select("vec_id", F.transform(v, lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x"))


def column_sums(fit_list: DataFrame) -> tuple[int, np.ndarray]:
    """Number of vectors and exact sum of each dimension: added up by batches in the tasks, then one row for each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
                yield batch_of(n=pa.array([len(x)]), s=pa.array([x.sum(axis=0)], pa.list_(pa.int64())))

    partial = fit_list.select("x").transform(in_batches, run, "n long, s array<long>")
    rows = partial.select("n", F.posexplode("s").alias("i", "s")).groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect()
    return rows[0]["n"], np.array([r["s"] for r in rows], np.int64)


def gramian(rows: DataFrame, column: str, d: int) -> np.ndarray:
    """Sum of the outer products of an array column's rows, by MLlib."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("v")), "v")
    return RowMatrix(vectors, 0, d).computeGramianMatrix().toArray()


def fitted(fit_list: DataFrame, most: int) -> Fit | None:
    """The ``most`` first components of a fit list ``x`` of one vector length; None if its vectors do not vary."""
    n, sums = column_sums(fit_list)
    d = len(sums)
    s = F.array(*(F.lit(int(v)) for v in sums))
    centred = fit_list.select(F.transform(F.arrays_zip(F.col("x"), s.alias("s")), lambda z: (z["x"] * n - z["s"]) / F.lit(float(n))).alias("c"))
    v = gramian(centred, "c", d) / n
    values, axes = np.linalg.eigh((v + v.T) / 2)
    values, axes = values[::-1], axes[:, ::-1]
    # below this a value is nothing but rounding: the vectors do not vary in that direction
    own = int(np.count_nonzero(values > max(values[0], 0.0) * d * np.finfo(np.float64).eps * 16))
    k = min(most, own)
    return Fit(n, sums, axes[:, :k], values[:k], float(np.trace(v))) if k else None


def squared_deviation(y: np.ndarray) -> list[int]:
    """Sum of squares of each row of whole numbers, exact at any size."""
    top = int(np.abs(y).max(initial=0))
    if top**2 * y.shape[1] < 2**63:
        return np.einsum("ij,ij->i", y, y).tolist()
    return [sum(v * v for v in row) for row in y.tolist()]


def project(rows: DataFrame, fit: Fit) -> DataFrame:
    """``vec_id, deviation, w`` for rows ``vec_id, x``: the exact squared deviation as a decimal, and the whitened vector."""
    shared = rows.sparkSession.sparkContext.broadcast((fit.n, fit.sums, fit.matrix))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums, to = shared.value
        for frame in frames:
            if len(frame):
                y = np.stack(frame["x"].to_numpy()) * n - sums
                yield pd.DataFrame({"vec_id": frame["vec_id"], "deviation": [str(v) for v in squared_deviation(y)], "w": list(y / n @ to)})

    return rows.select("vec_id", "x").mapInPandas(run, "vec_id long, deviation string, w array<double>").withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def identity_error(fit_list: DataFrame, fit: Fit) -> float:
    """Largest difference of the whitened fit list's covariance from the identity."""
    k = len(fit.values)
    covariance = gramian(project(fit_list.withColumn("vec_id", F.lit(0).cast("long")), fit), "w", k) / fit.n
    return float(np.abs(covariance - np.eye(k)).max())


def whitened(vectors: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact`` for each vector and component.

    Vectors that are null or empty or hold null or non-finite entries (or such that are too large for whole numbers) are left out. Entries are
    x = floor(64 * c) + 1000000; n, the means and covariances are over the distinct x-vectors of one length. Components are numbered from 1 by falling eigenvalue,
    at most ``components`` and only such in which the vectors vary: a table of equal vectors has none and gives no rows, nor does an empty table.
    ``deviation`` is the sum of (n * x - S)^2 over the dimensions, and null where it is beyond a long (``deviation_exact`` is a decimal); ``whitened`` the projection of
    x - S / n over the root of the eigenvalue; ``explained`` the eigenvalue's share of the trace; ``identity_error`` is measured on the whitened fit list.
    Null ids stay null. Rows that repeat an id or a vector each get their rows. Other columns play no part.
    """
    rows = materialise(whole_numbers(vectors, id_col, vector_col), "vectors")
    lists = materialise(rows.select("x").distinct(), "fit-list")
    out = None
    for d in sorted(r[0] for r in lists.select(F.size("x").alias("d")).distinct().collect()):
        own = F.size("x") == d
        fit = fitted(lists.filter(own), components)
        if fit is None:
            continue
        error = identity_error(lists.filter(own), fit)
        part = project(rows.filter(own), fit).select("vec_id", "deviation", F.posexplode("w").alias("i", "whitened"))
        share = F.element_at(F.array(*(F.lit(float(v)) for v in fit.values / fit.trace)), F.col("i") + 1)
        part = part.select("vec_id", (F.col("i") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"), _long("deviation").alias("deviation"), "whitened", share.alias("explained"), F.lit(error).alias("identity_error"), F.col("deviation").alias("deviation_exact"))
        out = part if out is None else out.unionByName(part)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
    return vectors.sparkSession.createDataFrame([], schema) if out is None else out


def _long(c: str) -> Column:
    return F.when(F.col(c) <= F.lit(str(2**63 - 1)).cast("decimal(38,0)"), F.col(c).cast("long"))
