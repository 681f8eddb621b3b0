"""The vector table: metadata and both vector tracks of a work order in one Parquet row."""

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wosearch.schema import BATCH, VECTOR_TABLE_SCHEMA
from wosearch.sources.commit_log import CommitLog
from wosearch.session import exists

_COLUMNS = VECTOR_TABLE_SCHEMA.names


def append_vectors(df: DataFrame, path: str, batch: str | None = None) -> None:
    """Append rows with their vectors. Both tracks arrive together or not at all.

    Positions repeat between scans, so every append carries a batch id of its own.
    """
    marked = df.withColumn(BATCH, F.lit(batch or uuid.uuid4().hex))
    marked.select(*_COLUMNS).write.mode("append").parquet(path)


def vector_log(spark: SparkSession, path: str) -> CommitLog:
    """The vector table as a log of batches: safe to repeat, read by version."""
    return CommitLog(spark, path, VECTOR_TABLE_SCHEMA)


def append_batch(df: DataFrame, path: str, batch: str) -> bool:
    """Append rows under a batch id; False if the table has the batch, however often it is tried."""
    marked = df.withColumn(BATCH, F.lit(batch))
    return vector_log(df.sparkSession, path).append(marked, batch)


def open_vectors(spark: SparkSession, path: str, required: bool = False) -> DataFrame:
    """The stored table, or an empty one when nothing was stored yet."""
    try:
        return spark.read.schema(VECTOR_TABLE_SCHEMA).parquet(path)
    except AnalysisException as error:
        if required or error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], VECTOR_TABLE_SCHEMA)


def write_stage(df: DataFrame, path: str) -> DataFrame:
    """Write a stage once; a later run finds the complete output and leaves it as it is.

    An output without its success mark was interrupted and is written anew.
    """
    if not exists(df.sparkSession, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table_stats(table: DataFrame) -> DataFrame:
    """Rows per track and vector size, in one pass."""
    return table.agg(
        F.count("text_vec").alias("text_total"),
        F.count("mice_vec").alias("mice_total"),
        F.coalesce(F.max(F.size("text_vec")), F.lit(0)).alias("dim"),
    )
