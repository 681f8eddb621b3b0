"""Exact top-k by inner product for a batch of queries.

Every task scores its share of the corpus against the whole query block with one matrix
product per Arrow batch and hands on only rows that can still be among the best k of a
query. Spark then merges: best k per task, best k per salt, best k per query. No (query,
row) pair outside a top-k ever becomes a Spark row, and the corpus itself is not shuffled.
"""

import sys
from functools import reduce
from itertools import chain
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wosearch.config import PROBE_BLOCK_BYTES, PROBE_BLOCK_ROWS, SCORE_CELLS, SCORE_ROWS
from wosearch.functions.vectors import is_valid
from wosearch.schema import SEQ
from wosearch.session import materialise, new_path, remove

TIE_BREAK = ("WOID", SEQ)


class _BestRows:
    """Running selection of one task. ``floor`` is the k-th best score seen per query."""

    def __init__(self, queries: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.queries = np.asarray(queries, dtype=np.float64)
        self.k = k
        self.best = np.full((len(queries), k), -np.inf, dtype=np.float32)
        if floor is not None:
            self.best[:] = floor[:, None]
        self.rows_at_once = max(1, min(SCORE_ROWS, SCORE_CELLS // max(1, len(queries))))

    def select(self, vectors: np.ndarray, which=slice(None)):
        """(query, row, score) of the rows to hand on. Rows must come in tie-break order;
        single precision makes scores comparable whatever the summation order was.
        ``which`` names the queries that take part; query numbers count among them.
        """
        scores = (self.queries[which] @ vectors.astype(np.float64).T).astype(np.float32)
        scores[~np.isfinite(scores)] = -np.inf
        n, k = scores.shape[1], self.k
        top = scores if n <= k else np.partition(scores, n - k, axis=1)[:, n - k:]
        merged = np.concatenate([self.best[which], top], axis=1)
        width = merged.shape[1]
        best = np.partition(merged, width - k, axis=1)[:, width - k:]
        self.best[which] = best
        floor = best.min(axis=1, keepdims=True)
        query, row = np.nonzero((scores >= floor) & (scores > -np.inf))
        score = scores[query, row]
        # Equal scores at the floor may exceed k: keep the first ones in tie-break order.
        order = np.lexsort((row, -score, query))
        query, row, score = query[order], row[order], score[order]
        first = np.searchsorted(query, query, side="left")
        keep = np.arange(len(query)) - first < k
        return query[keep], row[keep], score[keep]


def _ordered(batch, tie_break):
    return batch.take(pc.sort_indices(batch, sort_keys=[(c, "ascending") for c in tie_break]))


def _vectors(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _score_batches(batches, ids, queries, vector, k, tie_break, kept, dim, strict):
    state = _BestRows(queries, k)
    for whole in batches:
        for start in range(0, whole.num_rows, state.rows_at_once):
            batch = _ordered(whole.slice(start, state.rows_at_once), tie_break)
            vectors = _vectors(batch.column(vector), dim)
            if strict and not np.isfinite(vectors).all():
                raise ValueError("a stored vector is not finite")
            query, row, score = state.select(vectors)
            rows = batch.select(kept).take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(query)), pa.array(score), *rows.columns],
                names=["query_id", "score", *kept],
            )


def _merge(candidates: DataFrame, k: int, tie_break, salts: int) -> DataFrame:
    """Best k per query. Salting keeps the first merge of one query off a single task."""
    order = [F.desc("score"), *tie_break]
    if salts > 1:
        salted = candidates.withColumn("_salt", F.spark_partition_id() % salts)
        per_salt = Window.partitionBy("query_id", "_salt").orderBy(*order)
        candidates = (
            salted.withColumn("pool_rank", F.row_number().over(per_salt))
            .filter(F.col("pool_rank") <= k)
            .drop("_salt", "pool_rank")
        )
    per_query = Window.partitionBy("query_id").orderBy(*order)
    ranked = candidates.withColumn("pool_rank", F.row_number().over(per_query))
    return ranked.filter(F.col("pool_rank") <= k)


def _query_blocks(probes: DataFrame, limit: int):
    """Query vectors in blocks of at most ``limit`` rows, one at a time on the driver.

    A set that fits into one block is fetched as it is. A larger one is written first, so every
    query text is encoded once.
    """
    head = probes.limit(limit + 1).toArrow()
    if head.num_rows <= limit:
        if head.num_rows:
            yield head
        return
    del head
    spark, path = probes.sparkSession, new_path(probes.sparkSession, "query-vectors")
    probes.write.parquet(path)
    written = spark.read.schema(probes.schema).parquet(path)
    parts = max(1, ceil(2 * written.count() / limit))
    placed = written.withColumn("_part", F.pmod(F.xxhash64("query_id"), F.lit(parts)))
    for part in range(parts):
        rows = placed.filter(F.col("_part") == part).drop("_part").toArrow()
        for start in range(0, rows.num_rows, limit):
            yield rows.slice(start, limit)
    remove(spark, path)


def search(
    corpus: DataFrame,
    probes: DataFrame,
    k: int,
    vector: str,
    dim: int,
    tie_break=TIE_BREAK,
    salts: int | None = None,
    probe_block: int = PROBE_BLOCK_ROWS,
    invalid: str = "error",
) -> DataFrame:
    """Exact top-k rows of ``corpus`` for every row of ``probes`` (query_id, vector).

    Returns query_id, score, the corpus columns without vectors and ``pool_rank``. Equal
    scores rank by ``tie_break``. A null vector matches nothing. A vector of another size, or
    with a NaN or infinite element, fails the job; with ``invalid="skip"`` it matches nothing
    (split_by_validity lists such rows). A table with fewer than k rows gives fewer hits.

    The corpus is scanned once per block of queries. Of several blocks each is searched and its
    hits are written before the next one is fetched, so the driver's memory doesn't grow with them.
    """
    spark = corpus.sparkSession
    kept = [f.name for f in corpus.schema if not isinstance(f.dataType, T.ArrayType)]
    wrong = F.lit(False) if invalid == "skip" else F.raise_error(
        F.concat(F.lit(f"vector size is not {dim}: "), F.size(vector).cast("string"))
    ).cast("boolean")

    def sized(df: DataFrame) -> DataFrame:
        return df.filter(
            F.when(F.col(vector).isNull(), False).when(F.size(vector) == dim, True).otherwise(wrong)
        )

    usable = sized(corpus).select(*kept, vector)
    finite = F.when(is_valid(F.col(vector), dim), True).otherwise(
        F.lit(False) if invalid == "skip"
        else F.raise_error(F.lit("query vector is not finite")).cast("boolean")
    )
    probes = sized(probes).select("query_id", vector).filter(finite)
    schema = T.StructType(
        [probes.schema["query_id"], T.StructField("score", T.FloatType())]
        + [corpus.schema[c] for c in kept]
    )
    tie_break = list(tie_break)
    limit = min(probe_block, max(1, PROBE_BLOCK_BYTES // (8 * dim)))
    strict = invalid != "skip"

    def candidates_of(shared) -> DataFrame:
        def scan(batches):
            queries = shared.value
            ids = queries.column("query_id").combine_chunks()
            vectors = _vectors(queries.column(vector).combine_chunks(), dim)
            return _score_batches(batches, ids, vectors, vector, k, tie_break, kept, dim, strict)

        return usable.mapInArrow(scan, schema)

    if salts is None:
        slots = spark.sparkContext.defaultParallelism
        salts = 1 if slots <= 64 else isqrt(slots)
    blocks = _query_blocks(probes, limit)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return _merge(spark.createDataFrame([], schema), k, tie_break, salts)
    if second is None:
        return _merge(candidates_of(spark.sparkContext.broadcast(first)), k, tie_break, salts)
    found = []
    for block in chain((first, second), blocks):
        shared = spark.sparkContext.broadcast(block)  # ``limit`` rows at most
        found.append(materialise(_merge(candidates_of(shared), k, tie_break, salts), "block-hits"))
        shared.unpersist()
    # A query is in one block only.
    return reduce(DataFrame.union, found)


def neighbours(vectors: DataFrame, key: str, vector: str, query_key, k: int, dim: int) -> DataFrame:
    """Rows closest by cosine to one stored row, itself included: k + 1 of them."""
    from wosearch.functions.vectors import normalised

    unit = vectors.select(key, normalised(F.col(vector)).cast("array<float>").alias(vector))
    probe = unit.filter(F.col(key) == query_key).select(F.col(key).alias("query_id"), vector)
    return search(unit, probe, k + 1, vector, dim, tie_break=(key,))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
