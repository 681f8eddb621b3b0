"""Distinct counts and quantiles of a log that grows batch by batch.

Each batch is summarised once, as sketches of bounded size: HyperLogLog for distinct values, KLL for
quantiles. The sketches of all batches are merged when a figure is wanted, so old rows are not read
again. They are kept in a commit log, where a batch that is played again counts once.

Both are estimates with bounds that hold at any size of the log, with probability 99 % and more:
``distinct_bound`` for the relative error of a distinct count, ``rank_bound`` for how far the rank
of a quantile can be off. The exact ways (``quality.cardinality``, ``metrics.latency_stats``) stay.
"""

from math import sqrt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wosearch.sources.commit_log import CommitLog

# 2 ** LG_K registers; the size of a sketch and the error depend on them alone.
LG_K = 14
KLL_K = 800

DISTINCT = T.StructType([
    T.StructField("column", T.StringType()), T.StructField("n_values", T.LongType()),
    T.StructField("sketch", T.BinaryType()),
])
QUANTILES = T.StructType([
    T.StructField("strategy", T.StringType()), T.StructField("n_values", T.LongType()),
    T.StructField("total", T.DoubleType()), T.StructField("squares", T.DoubleType()),
    T.StructField("sketch", T.BinaryType()),
])


def distinct_bound(lg_k: int = LG_K) -> float:
    """Three standard errors of merged sketches, as a share of the count."""
    return 3 * 1.04 / sqrt(2 ** lg_k)


def rank_bound(k: int = KLL_K) -> float:
    """Error of a quantile's rank as a share of all values, at 99 %."""
    return 2.296 / k ** 0.9021


def distinct_log(spark: SparkSession, path: str) -> CommitLog:
    return CommitLog(spark, path, DISTINCT)


def add_distinct(log: CommitLog, rows: DataFrame, columns, batch: str, lg_k: int = LG_K) -> bool:
    """Sketch the batch's values of each column; null values don't count. One pass, no shuffle of values."""
    wide = rows.agg(*[
        F.struct(
            F.lit(c).alias("column"), F.count(c).alias("n_values"),
            F.hll_sketch_agg(F.col(c).cast("string"), lg_k).alias("sketch"),
        ).alias(f"s{i}")
        for i, c in enumerate(columns)
    ])
    return log.append(wide.select(F.inline(F.array(*wide.columns))), batch)


def distinct_counts(log: CommitLog, version: int | None = None) -> DataFrame:
    """column, n_values, n_distinct (estimate) over all batches, or those up to a version."""
    return log.read(version).groupBy("column").agg(
        F.sum("n_values").alias("n_values"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"),
    )


def quantile_log(spark: SparkSession, path: str) -> CommitLog:
    return CommitLog(spark, path, QUANTILES)


def add_latencies(log: CommitLog, rows: DataFrame, batch: str, k: int = KLL_K) -> bool:
    """Sketch the batch's latencies per strategy, with the sums that mean and deviation need."""
    x = F.col("latency_ms")
    return log.append(rows.filter(x.isNotNull()).groupBy("strategy").agg(
        F.count(x).alias("n_values"), F.sum(x).alias("total"), F.sum(x * x).alias("squares"),
        F.kll_sketch_agg_double(x, k).alias("sketch"),
    ), batch)


def latency_figures(log: CommitLog, version: int | None = None, share: float = 0.95) -> DataFrame:
    """strategy, n_values, mean_ms, std_ms (exact) and p95_ms (an estimate within ``rank_bound``)."""
    n, mean = F.sum("n_values"), F.sum("total") / F.sum("n_values")
    spread = F.greatest(F.sum("squares") / n - mean * mean, F.lit(0.0))
    return log.read(version).groupBy("strategy").agg(
        n.alias("n_values"), mean.alias("mean_ms"), F.sqrt(spread).alias("std_ms"),
        F.kll_merge_agg_double("sketch").alias("sketch"),
    ).select(
        "strategy", "n_values", "mean_ms", "std_ms",
        F.kll_sketch_get_quantile_double("sketch", F.lit(share)).alias("p95_ms"),
    )
