"""Routing a stream of query texts."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from wosearch.operators.router import classify, query_class

QUERY_SCHEMA = "query_id string, query_text string"


def routed_stream(spark: SparkSession, source: str) -> DataFrame:
    """Queries from a folder of Parquet files with their routing decision; stateless."""
    return query_class(classify(spark.readStream.schema(QUERY_SCHEMA).parquet(source)))


def start_routing(spark: SparkSession, source: str, table: str, checkpoint: str) -> StreamingQuery:
    return (
        routed_stream(spark, source).writeStream.format("parquet")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(table)
    )
