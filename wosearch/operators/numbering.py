"""Exact row numbers over a whole table without sorting it in one task."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wosearch.config import NUMBERING_BUCKET


def with_row_index(
    df: DataFrame, order: str, out: str = "row_index", bucket: int = NUMBERING_BUCKET
) -> DataFrame:
    """Add the 0-based position of every row in ascending ``order``, a unique bigint.

    Rows are numbered inside buckets of ``bucket`` consecutive order values, then shifted
    by the rows of all earlier buckets. A bucket holds at most ``bucket`` rows whatever the
    data looks like, and so does a stretch of buckets in the prefix sum over them. ``df`` is
    read twice: pass a table or a narrow plan.
    """
    keyed = df.withColumn("_bucket", F.expr(f"`{order}` div {bucket}"))
    shifts = _shifts(keyed.groupBy("_bucket").count(), bucket)
    inside = Window.partitionBy("_bucket").orderBy(order)
    return (
        keyed.join(shifts, "_bucket")
        .withColumn(out, F.row_number().over(inside) - 1 + F.col("_shift"))
        .drop("_bucket", "_shift")
    )


def _shifts(counts: DataFrame, stretch: int) -> DataFrame:
    """Rows before each bucket, summed up in two levels: inside stretches of ``stretch``
    consecutive buckets, and over one row per stretch.
    """
    before = (Window.unboundedPreceding, -1)
    placed = counts.withColumn("_stretch", F.expr(f"_bucket div {stretch}"))
    inner = Window.partitionBy("_stretch").orderBy("_bucket").rowsBetween(*before)
    outer = Window.orderBy("_stretch").rowsBetween(*before)
    stretches = placed.groupBy("_stretch").agg(F.sum("count").alias("n")).select(
        "_stretch", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("_start")
    )
    return placed.withColumn("_inside", F.coalesce(F.sum("count").over(inner), F.lit(0))).join(
        stretches, "_stretch"
    ).select("_bucket", (F.col("_start") + F.col("_inside")).alias("_shift"))


def chunk_sizes(df: DataFrame, order: str, rows: int) -> DataFrame:
    """Rows per consecutive chunk of ``rows`` rows in ``order``."""
    indexed = with_row_index(df.select(order), order)
    chunk = F.floor(F.col("row_index") / rows).alias("chunk")
    return indexed.groupBy(chunk).agg(F.count("*").alias("n_rows"))
