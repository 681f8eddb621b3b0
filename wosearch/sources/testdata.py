"""Work orders, queries and latencies derived from the driver's tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wosearch.config import STRATEGIES
from wosearch.schema import SEQ
from wosearch.session import spread

# Plants what cleaning must handle: blank and 'nan' buildings, blank names, types, dates
# and ids, and repeated ids. Valid in Spark and DuckDB alike.
WORK_ORDERS = """
SELECT
  d.doc_id AS ingest_seq,
  CASE WHEN d.doc_id % 9 = 0 THEN '' WHEN d.doc_id % 9 = 1 THEN 'nan'
       ELSE concat('B', lpad(CAST(d.doc_id % 50 AS VARCHAR(10)), 3, '0')) END AS BuildingID,
  CASE WHEN d.doc_id % 11 = 0 THEN '' ELSE concat('Hall ', d.source) END AS BuildingName,
  CASE WHEN d.doc_id % 13 = 0 THEN ''
       WHEN d.lang = 'en' THEN 'research' WHEN d.lang = 'de' THEN 'teaching'
       WHEN d.lang = 'es' THEN 'student experience' ELSE 'other' END AS Type,
  CASE WHEN d.doc_id % 37 = 0 THEN ''
       ELSE concat('W', CAST(CASE WHEN d.doc_id % 10 = 9 THEN d.doc_id - 1 ELSE d.doc_id END
                             AS VARCHAR(20))) END AS WOID,
  d.text AS WODescription,
  concat('2024-01-', lpad(CAST(1 + d.doc_id % 28 AS VARCHAR(10)), 2, '0')) AS WOStartDate,
  CASE WHEN d.doc_id % 4 = 0 THEN ''
       ELSE concat('2024-02-', lpad(CAST(1 + d.doc_id % 28 AS VARCHAR(10)), 2, '0'))
       END AS WOEndDate,
  CASE coalesce(e.label, CAST(d.doc_id % 10 AS INT))
       WHEN 0 THEN 'HVAC' WHEN 1 THEN 'Plumbing' WHEN 2 THEN 'Electrical'
       WHEN 3 THEN 'Elevator' WHEN 4 THEN 'Fire Protection' WHEN 5 THEN 'Roofing'
       WHEN 6 THEN 'Site' WHEN 7 THEN 'Structural' WHEN 8 THEN 'Exterior'
       ELSE 'Furnishings' END AS SystemDescription,
  e.embedding AS stored_vec
FROM {documents} d LEFT JOIN {embeddings} e ON e.vec_id = d.doc_id
"""

# A query text per work order that names all, some or none of its metadata.
ROUTER_QUERIES = """
SELECT
  ingest_seq AS query_id,
  CASE ingest_seq % 5
    WHEN 0 THEN concat(lower(SystemDescription), ' failure in ', Type, ' building ', BuildingID)
    WHEN 1 THEN concat(lower(SystemDescription), ' failure')
    WHEN 2 THEN concat('failure in ', Type, ' building')
    WHEN 3 THEN concat('failure in building ', BuildingID)
    ELSE concat('failure reported: ', WOStartDate) END AS query_text
FROM {raw}
"""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))


def work_orders(spark: SparkSession, folder: str) -> DataFrame:
    """The join spreads the rows over the cores. The hint spares it sorting (and spilling) whole
    texts; the other side is hashed in the same small shares.
    """
    return spark.sql(
        WORK_ORDERS,
        documents=spark.read.parquet(f"{folder}/documents.parquet"),
        embeddings=table(spark, folder, "embeddings").hint("shuffle_hash"),
    )


def router_queries(raw: DataFrame) -> DataFrame:
    return raw.sparkSession.sql(ROUTER_QUERIES, raw=raw)


def latency_log(raw: DataFrame) -> DataFrame:
    """A latency per work order and strategy; a fixed formula stands in for a clock."""
    base = (F.col(SEQ) * 37 % 101).cast("double") / 10.0
    offsets = [
        F.struct(F.lit(s).alias("strategy"), (base + 1.5 * i).alias("latency_ms"))
        for i, s in enumerate(STRATEGIES)
    ]
    return raw.select(
        F.col(SEQ).alias("query_id"), F.inline(F.array(*offsets)).alias("strategy", "latency_ms")
    )
