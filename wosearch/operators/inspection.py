"""Looking at stored rows and vectors."""

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wosearch.config import EVAL_SEED
from wosearch.functions.text import seeded_md5, strip
from wosearch.functions.vectors import norm
from wosearch.operators.principal import coordinates, principal_components
from wosearch.schema import SEQ

BROWSE_COLUMNS = ("WOID", "BuildingID", "BuildingName", "Type", "equipment", "WODescription")


def browse(
    df: DataFrame, kind: str = "All", equipment: str = "All", pattern: str = "", limit: int = 200
) -> DataFrame:
    """First rows that match type, equipment and a case-insensitive regular expression."""
    if kind != "All":
        df = df.filter(F.col("Type") == kind)
    if equipment != "All":
        df = df.filter(F.col("equipment") == equipment)
    if pattern:
        df = df.filter(F.col("WODescription").rlike("(?iu)" + pattern))
    return df.orderBy(SEQ).limit(limit).select(*BROWSE_COLUMNS)


def lookup(df: DataFrame, woid: str) -> DataFrame:
    """The first stored row of a WOID, vectors included when the table has them."""
    # The first test is implied by the second and reaches the scan.
    wanted = woid.strip()
    same = F.col("WOID").contains(wanted) & (strip(F.col("WOID")) == wanted)
    return df.filter(same).orderBy(SEQ).limit(1)


def sanity(vectors: DataFrame, vector: str) -> DataFrame:
    """Shape, element type, mean and deviation of the norms, any NaN, any infinite value."""
    length = norm(F.col(vector))
    kind = vectors.schema[vector].dataType.elementType.simpleString()
    return vectors.agg(
        F.count(vector).alias("n_rows"),
        F.max(F.size(vector)).alias("dim"),
        F.lit(kind).alias("element_type"),
        F.avg(length).alias("mean_norm"),
        F.stddev_pop(length).alias("std_norm"),
        F.coalesce(F.bool_or(F.exists(vector, F.isnan)), F.lit(False)).alias("has_nan"),
        F.coalesce(
            F.bool_or(F.exists(vector, lambda x: F.abs(x) == float("inf"))), F.lit(False)
        ).alias("has_inf"),
    )


def average_similarity(
    vectors: DataFrame, key: str, vector: str, dim: int, n: int | None = 1000
) -> DataFrame:
    """Mean cosine over all ordered pairs of the first ``n`` rows (None: of all rows).

    The mean over all pairs is the squared length of the summed unit vectors over n², so
    each task adds up its vectors and no pair is ever formed.
    """
    rows = vectors.filter(F.size(vector) == dim)
    rows = rows.orderBy(key).limit(n) if n is not None else rows

    def partial(batches):
        total, count = np.zeros(dim), 0
        for batch in batches:
            block = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            block = block.reshape(-1, dim).astype(np.float64)
            length = np.linalg.norm(block, axis=1, keepdims=True)
            total += (block / np.where(length > 0, length, 1.0)).sum(axis=0)
            count += len(block)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(dim + 1)), pa.array(np.append(total, float(count)))],
            names=["pos", "part"],
        )

    sums = rows.select(vector).mapInArrow(partial, "pos bigint, part double")
    totals = sums.groupBy("pos").agg(F.sum("part").alias("s"))
    squared = F.sum(F.when(F.col("pos") < dim, F.col("s") * F.col("s")))
    count = F.max(F.when(F.col("pos") == dim, F.col("s")))
    return totals.agg(squared.alias("q"), count.alias("n")).select(
        F.col("n").cast("bigint").alias("n_rows"),
        F.try_divide("q", F.col("n") * F.col("n")).alias("average_similarity"),
    )


def sample(table: DataFrame, n: int, seed: int = EVAL_SEED) -> DataFrame:
    """n rows without replacement, the same ones on every run."""
    return table.orderBy(seeded_md5(seed, F.col("WOID")), "WOID").limit(n)


def project_2d(
    vectors: DataFrame, key: str, vector: str, label: str
) -> tuple[DataFrame, DataFrame]:
    """Two principal components per row with a label, and the share of variance of each.

    The largest loading of a component is made positive, so that signs repeat.
    """
    named = F.coalesce(F.nullif(F.col(label).cast("string"), F.lit("")), F.lit("unknown"))
    found = principal_components(vectors, vector)
    placed = coordinates(vectors.filter(F.col(vector).isNotNull()), vector, found, ("x", "y"))
    ratio = [(i + 1, share) for i, share in enumerate(found.shares)]
    return (
        placed.select(key, named.alias("label"), "x", "y"),
        vectors.sparkSession.createDataFrame(ratio, "component int, variance_share double"),
    )


def heat_map(vectors: DataFrame, key: str, vector: str, dims: int | None = 20) -> DataFrame:
    """(key, dimension, value) of the leading dimensions; None keeps all of them."""
    v = F.col(vector) if dims is None else F.slice(vector, 1, dims)
    return vectors.select(key, F.posexplode(v).alias("dimension", "value"))


def vector_grid(vectors: DataFrame, key: str, vector: str, columns: int = 32) -> DataFrame:
    """The vector as full grid rows of ``columns`` values."""
    full = F.floor(F.size(vector) / columns).cast("int") * columns
    cells = vectors.select(
        key, F.posexplode(F.slice(vector, F.lit(1), full)).alias("dimension", "value")
    )
    return cells.select(
        key, F.floor(F.col("dimension") / columns).cast("int").alias("grid_row"),
        (F.col("dimension") % columns).alias("grid_column"), "dimension", "value",
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])
