"""Resumable ingestion of cleaned work orders into the vector table.

A chunk is a file of the source folder. The checkpoint remembers finished chunks and the
file sink shows a chunk to readers only once it is committed, so a job that dies can start
again without losing or doubling a row. Starting over means a new checkpoint and table.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wosearch.functions.representation import with_representations
from wosearch.operators.encoding import Encoder, embed_documents
from wosearch.schema import BATCH, CLEAN_SCHEMA, SEQ, VECTOR_TABLE_SCHEMA


def start_ingest(
    spark: SparkSession, source: str, table: str, checkpoint: str, encoder: Encoder,
    chunks_per_batch: int | None = None,
) -> StreamingQuery:
    """Ingest every chunk that is not in the table yet, then stop.

    All waiting chunks are one micro-batch unless ``chunks_per_batch`` bounds it. A chunk is
    named by its path and is the batch of its rows. A micro-batch may be few files of few splits,
    so its rows are dealt over the cores before they are encoded.
    """
    reader = spark.readStream.schema(CLEAN_SCHEMA)
    if chunks_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", chunks_per_batch)
    chunks = (
        reader.parquet(source)
        .withColumn("chunk", F.col("_metadata.file_path")).withColumn(BATCH, F.col("chunk"))
        .repartition(spark.sparkContext.defaultParallelism, SEQ)
    )
    vectors = embed_documents(with_representations(chunks), encoder)
    return (
        vectors.select(*VECTOR_TABLE_SCHEMA.names, "chunk").writeStream.format("parquet")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(table)
    )


def ingest_progress(source: DataFrame, table: DataFrame) -> DataFrame:
    """Rows per chunk in source and table, and whether the chunk is complete."""
    offered = source.groupBy(F.col("_metadata.file_path").alias("chunk")).agg(
        F.count("*").alias("rows_offered")
    )
    stored = table.groupBy("chunk").agg(F.count("*").alias("rows_stored"))
    joined = offered.join(stored, "chunk", "left")
    stored_rows = F.coalesce("rows_stored", F.lit(0))
    return joined.select(
        "chunk", "rows_offered", stored_rows.alias("rows_stored"),
        (F.col("rows_offered") == stored_rows).alias("completed"),
    )


def ingest_totals(progress: DataFrame) -> DataFrame:
    return progress.agg(
        F.count(F.when(F.col("completed"), 1)).alias("completed_chunks"),
        F.coalesce(F.sum("rows_stored"), F.lit(0)).alias("total_rows_processed"),
        F.coalesce(F.bool_and("completed"), F.lit(True)).alias("completed"),
    )
