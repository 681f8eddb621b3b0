"""Retrieval for queries that arrive over time.

Every micro-batch of queries is searched against the stored vectors by the same code as a batch
of queries. Its hits are one batch of a commit log, named by stream and micro-batch: one that is
played again after a failure finds its batch in the log and adds nothing, and hits of a batch that
died half-way are never seen.
"""

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from wosearch.config import TOP_K
from wosearch.operators.encoding import Encoder
from wosearch.operators.router import classify
from wosearch.operators.strategies import HIT_COLUMNS, retrieve, retrieve_named, with_strategies
from wosearch.session import materialise, scratch
from wosearch.sources.commit_log import CommitLog
from wosearch.streaming.routing import QUERY_SCHEMA

_TYPES = {"rank": T.IntegerType(), "score": T.FloatType()}
HITS = T.StructType([T.StructField(c, _TYPES.get(c, T.StringType())) for c in HIT_COLUMNS])


def hits_log(spark: SparkSession, path: str) -> CommitLog:
    return CommitLog(spark, path, HITS)


def start_retrieval(
    spark: SparkSession, source: str, corpus: Callable[[], DataFrame], hits: str, checkpoint: str,
    encoder: Encoder, strategies: Iterable[str] | None = None, k: int = TOP_K,
    files_per_batch: int | None = None, name: str = "retrieval",
) -> StreamingQuery:
    """Search every query file of ``source`` that was not searched yet, then stop.

    ``corpus`` opens the vector table; it is called for each micro-batch, so a batch sees one
    snapshot and the next batch what was appended since. It may build the table when first called;
    what it writes is not the batch's and stays. ``strategies`` are applied to every query;
    without them each query takes the one its text is routed to. Intermediate tables of a
    micro-batch are removed when its hits are written.
    """
    reader = spark.readStream.schema(QUERY_SCHEMA)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    log, named = hits_log(spark, hits), list(strategies or ())

    def answer(queries: DataFrame, batch: int) -> None:
        stored = corpus()
        with scratch(spark):
            routed = materialise(classify(queries), "routed")
            if named:
                found = retrieve(stored, with_strategies(routed, *named), encoder, k, tuple(named))
            else:
                found = retrieve_named(stored, routed, encoder, k)
            log.append(found, f"{name}-{batch}")

    return (
        reader.parquet(source).writeStream.foreachBatch(answer)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
