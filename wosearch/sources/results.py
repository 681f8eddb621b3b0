"""Metric and comparison files."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wosearch.config import STRATEGIES
from wosearch.schema import COMPARISON_SCHEMA, METRICS_SCHEMA

# Nested values, or the flat names other tools write; every field is optional.
_FLAT_NAMES = (
    "recall_at_1", "recall_at_5", "recall_at_10", "ndcg_at_10", "avg_latency_ms",
)
_RECORD = T.StructType(
    METRICS_SCHEMA.fields + [T.StructField(n, T.DoubleType()) for n in _FLAT_NAMES]
)
_BY_NAME = T.StructType([T.StructField(s, _RECORD) for s in STRATEGIES])
_FILE = T.StructType(
    _RECORD.fields + _BY_NAME.fields
    + [T.StructField(group, _BY_NAME) for group in ("metrics", "results")]
)


def write_metrics(documents: DataFrame, path: str) -> None:
    """One JSON record per strategy."""
    documents.write.json(path)


def _flat(d) -> list:
    """Flat metrics of a record; what is absent counts as zero."""

    def first(*values):
        return F.coalesce(*values, F.lit(0.0))

    recalls = [
        first(d[f"recall_at_{k}"], d["recall"][str(k)]).alias(f"recall_{k}") for k in (1, 5, 10)
    ]
    return recalls + [
        first(d["mrr"]).alias("mrr"),
        first(d["ndcg_at_10"], d["ndcg"]["10"]).alias("ndcg_10"),
        first(d["avg_latency_ms"], d["latency"]["mean_ms"]).alias("avg_latency_ms"),
    ]


def read_metrics(spark: SparkSession, path: str, one_value_per_file: bool = False) -> DataFrame:
    """Flat metrics per strategy.

    Records come one per line or, with ``one_value_per_file``, as one array or one object
    per file. An object may be keyed by strategy at the top or under metrics / results.
    """
    rows = spark.read.schema(_FILE).option("multiLine", one_value_per_file).json(path)
    listed = rows.filter("strategy IS NOT NULL").select(
        F.struct(*_RECORD.names).alias("d")
    )
    named = [
        F.coalesce(s, F.col("metrics")[s], F.col("results")[s]).withField("strategy", F.lit(s))
        for s in STRATEGIES
    ]
    keyed = rows.filter("strategy IS NULL").select(F.explode(F.array(*named)).alias("d"))
    documents = listed.unionByName(keyed.filter("d IS NOT NULL"))
    return documents.filter(F.col("d.strategy").isin(*STRATEGIES)).select(
        "d.strategy", *_flat(F.col("d"))
    )


def write_comparisons(rows: DataFrame, path: str) -> None:
    rows.write.options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)


def read_comparisons(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COMPARISON_SCHEMA).options(header=True, escape='"').csv(path)
