"""Leading principal components by subspace iteration.

Every pass is one map-only scan: a task multiplies its vectors with the current basis and hands on
sums of fixed size (dimensions x basis), which are added up. The covariance matrix is never formed
and the driver sees one such sum. The basis is wider than what is wanted, so that a pass shrinks the
error by the ratio of a much smaller eigenvalue, and passes go on until the residual of the wanted
components is within the tolerance.
"""

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wosearch.functions.vectors import checked_dim

EXTRA = 62
TOLERANCE = 1e-12
MOST_PASSES = 200


@dataclass
class Components:
    """``loadings``: one column per component, unit length, the largest entry positive."""

    mean: np.ndarray
    loadings: np.ndarray
    variances: np.ndarray
    total_variance: float
    n_rows: int
    passes: int

    @property
    def shares(self) -> list[float]:
        """Share of the variance per component; without any variance nothing is explained."""
        return [float(v / self.total_variance) if self.total_variance > 0 else 0.0 for v in self.variances]


def _added_up(rows: DataFrame, size: int, partial) -> np.ndarray:
    """Sum of the tasks' arrays of ``size`` numbers; ``partial`` makes one of a block of vectors."""

    def task(batches):
        total = np.zeros(size)
        for batch in batches:
            column = batch.column(0)
            if len(column):
                block = column.flatten().to_numpy(zero_copy_only=False)
                total += partial(block.reshape(len(column), -1).astype(np.float64))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["pos", "part"])

    sums = rows.mapInArrow(task, "pos bigint, part double").groupBy("pos").agg(F.sum("part").alias("s"))
    out = np.zeros(size)
    for pos, value in sums.collect():  # ``size`` rows
        out[pos] = value
    return out


def principal_components(
    vectors: DataFrame, vector: str, k: int = 2, extra: int = EXTRA, tolerance: float = TOLERANCE,
    most_passes: int = MOST_PASSES,
) -> Components:
    """The ``k`` components with the largest variance. Null vectors take no part, vectors of
    different lengths fail the job. Without rows all figures are zero.
    """
    known = vectors.filter(F.col(vector).isNotNull())
    dim = known.agg(F.max(F.size(vector))).first()[0] or 1
    rows = known.select(checked_dim(F.col(vector), dim).alias(vector))
    k, width = min(k, dim), min(dim, k + extra)

    first = _added_up(rows, dim + 2, lambda x: np.concatenate([x.sum(axis=0), [(x * x).sum(), len(x)]]))
    n = int(first[-1])
    mean = first[:dim] / max(n, 1)
    scale = max(n - 1, 1)
    total = max(first[dim] - n * float(mean @ mean), 0.0) / scale

    basis, _ = np.linalg.qr(np.random.default_rng(1).normal(size=(dim, width)))
    for passes in range(1, most_passes + 1):
        def step(x, basis=basis):
            centred = x - mean
            return (centred.T @ (centred @ basis)).ravel()

        image = _added_up(rows, dim * width, step).reshape(dim, width) / scale
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values)[:k]
        values, turn = np.maximum(values[order], 0.0), turn[:, order]
        loadings = basis @ turn
        residual = np.linalg.norm(image @ turn - loadings * values, axis=0).max()
        if residual <= tolerance * max(values[0], np.finfo(float).tiny):
            break
        basis, _ = np.linalg.qr(image)
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(k)])
    return Components(mean, loadings * signs, values, total, n, passes)


def coordinates(vectors: DataFrame, vector: str, found: Components, names) -> DataFrame:
    """The vectors' coordinates along the components, as columns of these names."""
    double = F.transform(vector, lambda x: x.cast("double"))
    out = {}
    for i, name in enumerate(names):
        weights = [float(w) for w in found.loadings[:, i]] if i < found.loadings.shape[1] else [0.0]
        shift = float(found.mean @ found.loadings[:, i]) if i < found.loadings.shape[1] else 0.0
        products = F.zip_with(double, F.array(*[F.lit(w) for w in weights]), lambda x, w: x * F.coalesce(w, F.lit(0.0)))
        out[name] = F.aggregate(products, F.lit(0.0), lambda s, x: s + x) - F.lit(shift)
    return vectors.withColumns(out)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
