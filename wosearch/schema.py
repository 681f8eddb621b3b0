"""Column names and types of the tables the engine reads and writes."""

from pyspark.sql import types as T

# The names of columns and fields in files.

RAW_COLUMNS = (
    "BuildingID", "BuildingName", "Type", "WOID", "WODescription",
    "WOStartDate", "WOEndDate", "SystemDescription",
)
CLEAN_COLUMNS = (
    "BuildingID", "BuildingName", "Type", "WOID", "WODescription",
    "WOStartDate", "WOEndDate", "equipment",
)
SEQ = "ingest_seq"
# Which append a stored row came with; with ``SEQ`` it is unique in a vector table.
BATCH = "batch_id"
TRACKS = {"text": "text_vec", "mice": "mice_vec"}


def string_schema(columns) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


CLEAN_SCHEMA = T.StructType(
    [T.StructField(SEQ, T.LongType())] + string_schema(CLEAN_COLUMNS).fields
)
VECTOR_TYPE = T.ArrayType(T.FloatType(), False)
VECTOR_TABLE_SCHEMA = T.StructType(
    CLEAN_SCHEMA.fields
    + [T.StructField("text_repr", T.StringType()), T.StructField("mice_repr", T.StringType())]
    + [T.StructField(c, VECTOR_TYPE) for c in TRACKS.values()]
    + [T.StructField(BATCH, T.StringType())]
)
METRICS_SCHEMA = T.StructType([
    T.StructField("strategy", T.StringType()),
    T.StructField("n_queries", T.LongType()),
    T.StructField("mrr", T.DoubleType()),
    *[
        T.StructField(name, T.MapType(T.StringType(), T.DoubleType()))
        for name in (
            "recall", "ndcg", "recall_semantic", "recall_constrained",
            "ndcg_semantic", "ndcg_constrained",
        )
    ],
    T.StructField("latency", T.StructType([
        T.StructField(n, T.DoubleType()) for n in ("mean_ms", "std_ms", "p95_ms")
    ])),
])
COMPARISON_SCHEMA = T.StructType([
    T.StructField("description", T.StringType()),
    T.StructField("query_type", T.StringType()),
    T.StructField("equipment", T.StringType()),
    T.StructField("facility_type", T.StringType()),
    T.StructField("n_relevant", T.LongType()),
    T.StructField("query_text", T.StringType()),
    T.StructField("strategy", T.StringType()),
    T.StructField("recall", T.DoubleType()),
    T.StructField("mrr", T.DoubleType()),
    T.StructField("ndcg", T.DoubleType()),
    T.StructField("first_hit_rank", T.IntegerType()),
    T.StructField("metadata_gain", T.DoubleType()),
])
