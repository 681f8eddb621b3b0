"""A vector table laid out in clusters, and exact top-k that leaves most of them unread.

Every row lies in the cluster of its nearest centre, one Parquet partition each. A small table
holds each cluster's centre, radius, largest angle to the centre and range of norms. They bound the
inner product of a query with any row of the cluster, so a cluster whose bound is below the k-th
best score already found can't hold a hit.

A search takes two scans per block of queries. The first reads, for every query, the clusters with
the highest bounds that hold k rows; its k-th best score is the query's floor. The second reads the
remaining clusters whose bound reaches some query's floor, and scores only the pairs of query and
cluster that do. Equal scores reach the floor, so ties are decided as in a full scan.

Centres are fitted on a bounded sample of rows, every row is stored; badly chosen centres cost
time, not hits. Rows with a null vector are kept in a partition no search reads. Appended rows go to
the same centres, and each append adds its own bounds.
"""

import json
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wosearch.config import PROBE_BLOCK_BYTES, PROBE_BLOCK_ROWS, SCORE_ROWS
from wosearch.functions.vectors import is_valid
from wosearch.operators.search import _BestRows, _merge, _ordered, _query_blocks, _vectors
from wosearch.session import exists, materialise

CLUSTERS = 64
# A block's bounds and masks are arrays of clusters x queries on the driver and in each task.
MOST_CLUSTERS = 4096
# Rows and bytes of the sample the centres are fitted on.
SAMPLE_ROWS = 20_000
SAMPLE_BYTES = 64 << 20
ROUNDS = 8
# What rounding can add to a bound, in units of the two norms.
SLACK = 1e-6
# The partition of rows without a vector.
UNPLACED = -1

_PLACED = [
    T.StructField("cluster", T.IntegerType()),
    *(T.StructField(c, T.DoubleType()) for c in ("distance", "angle", "length")),
]
BOUNDS = (
    "cluster int, n_rows long, radius double, angle double, least_length double, "
    "most_length double"
)


def fit_centres(sample: np.ndarray, n: int, rounds: int = ROUNDS) -> np.ndarray:
    """At most ``n`` centres of the sampled vectors by Lloyd's rounds from spread-out rows."""
    points = np.unique(sample.astype(np.float64), axis=0)
    centres = points[np.linspace(0, len(points) - 1, min(n, len(points))).astype(int)]
    for _ in range(rounds):
        nearest = _nearest(points, centres)
        counts = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)


def _angles(products: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Angles from inner products and products of lengths; pi where a length is zero."""
    cosine = np.divide(products, lengths, out=np.full_like(products, -1.0), where=lengths > 0)
    return np.arccos(np.clip(cosine, -1, 1))


def _place(batches: Iterable[pa.RecordBatch], vector: str, dim: int, centres) -> Iterator:
    middle = centres.value
    size = np.linalg.norm(middle, axis=1)
    parts = (b.slice(i, SCORE_ROWS) for b in batches for i in range(0, b.num_rows, SCORE_ROWS))
    for batch in parts:
        column = batch.column(vector)
        cluster = np.full(batch.num_rows, UNPLACED, np.int32)
        distance, angle, length = (np.zeros(batch.num_rows) for _ in range(3))
        known = np.flatnonzero(~column.is_null().to_numpy(zero_copy_only=False))
        if len(known):
            points = _vectors(column.take(pa.array(known)), dim).astype(np.float64)
            own = _nearest(points, middle)
            norms = np.linalg.norm(points, axis=1)
            cluster[known], length[known] = own, norms
            distance[known] = np.linalg.norm(points - middle[own], axis=1)
            products = (points * middle[own]).sum(axis=1)
            # A zero vector has no direction; its score of zero is bounded apart.
            angle[known] = np.where(norms > 0, _angles(products, norms * size[own]), 0.0)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, *(pa.array(c) for c in (cluster, distance, angle, length))],
            names=[*batch.schema.names, "cluster", "distance", "angle", "length"],
        )


@dataclass
class Reads:
    """How many of a table's clusters the two scans of a block of queries read."""

    clusters: int
    first: int
    second: int


class ClusteredTable:
    """The table in a folder. ``reads`` tells what the last search read."""

    def __init__(self, spark: SparkSession, path: str, vector: str, dim: int):
        self.spark, self.path, self.vector, self.dim = spark, path, vector, dim
        self.reads: list[Reads] = []

    @property
    def rows(self) -> DataFrame:
        described = self.spark.read.schema("described string").json(f"{self.path}/schema").first()[0]
        schema = T.StructType.fromJson(json.loads(described))
        return self.spark.read.schema(schema).parquet(f"{self.path}/rows")

    @property
    def bounds(self) -> DataFrame:
        """One row per cluster; the widest of all appends."""
        return self.spark.read.schema(BOUNDS).parquet(f"{self.path}/bounds").groupBy("cluster").agg(
            F.sum("n_rows").alias("n_rows"), F.max("radius").alias("radius"),
            F.max("angle").alias("angle"), F.min("least_length").alias("least_length"),
            F.max("most_length").alias("most_length"),
        )

    def centres(self) -> np.ndarray:
        found = self.spark.read.schema("cluster int, centre array<double>").parquet(
            f"{self.path}/centres"
        ).toArrow().sort_by("cluster")
        return _vectors(found["centre"].combine_chunks(), self.dim)

    def create(self, df: DataFrame, clusters: int = CLUSTERS) -> "ClusteredTable":
        """Fit the centres and store the rows. The sample is the rows with the smallest hashes."""
        if exists(self.spark, f"{self.path}/centres"):
            raise FileExistsError(self.path)
        n = min(SAMPLE_ROWS, max(clusters, SAMPLE_BYTES // (4 * self.dim)))
        usable = df.filter(is_valid(F.col(self.vector), self.dim)).select(self.vector)
        sample = usable.orderBy(F.xxhash64(self.vector)).limit(n).toArrow()
        points = _vectors(sample[self.vector].combine_chunks(), self.dim)
        centres = fit_centres(points, min(clusters, MOST_CLUSTERS)) if len(points) else np.zeros((1, self.dim))
        self.spark.createDataFrame(
            [(T.StructType(df.schema.fields + _PLACED).json(),)], "described string"
        ).write.mode("overwrite").json(f"{self.path}/schema")
        self.append(df, centres)
        # The centres come last: with them the table is there.
        self.spark.createDataFrame(
            [(i, c) for i, c in enumerate(centres.tolist())], "cluster int, centre array<double>"
        ).coalesce(1).write.parquet(f"{self.path}/centres")
        return self

    def append(self, df: DataFrame, centres: np.ndarray | None = None) -> None:
        """Store more rows. Vectors of another size or with non-finite elements fail the job."""
        vector, dim = self.vector, self.dim
        sound = F.when(F.col(vector).isNull() | is_valid(F.col(vector), dim), F.col(vector)).otherwise(
            F.raise_error(F.lit(f"a vector is not finite or its size is not {dim}"))
        )
        shared = self.spark.sparkContext.broadcast(self.centres() if centres is None else centres)
        checked = df.withColumn(vector, sound)
        schema = T.StructType(checked.schema.fields + _PLACED)
        placed = checked.mapInArrow(lambda b: _place(b, vector, dim, shared), schema)
        # Whole partitions per cluster; AQE splits large ones and joins small ones.
        placed = materialise(placed, "placed")
        placed.hint("rebalance", "cluster").write.mode("append").partitionBy("cluster").parquet(
            f"{self.path}/rows"
        )
        has_vector = placed.filter(F.col("cluster") != UNPLACED)
        has_vector.groupBy("cluster").agg(
            F.count(F.lit(1)).alias("n_rows"), F.max("distance").alias("radius"),
            F.max("angle").alias("angle"), F.min("length").alias("least_length"),
            F.max("length").alias("most_length"),
        ).coalesce(1).write.mode("append").parquet(f"{self.path}/bounds")

    def search(
        self, probes: DataFrame, k: int, tie_break: Iterable[str],
        probe_block: int = PROBE_BLOCK_ROWS, salts: int = 1,
    ) -> DataFrame:
        """Exact top-k like ``operators.search.search``, with the stored columns of the hits.

        Blocks of queries are worked off one after another; the driver holds one of them.
        """
        vector, dim, tie_break = self.vector, self.dim, list(tie_break)
        bounds = self.bounds.toArrow().sort_by("cluster")  # MOST_CLUSTERS rows
        middle, ids = self.centres(), bounds["cluster"].to_numpy()
        facts = {c: bounds[c].to_numpy() for c in bounds.column_names}
        usable = self.rows.drop("distance", "angle", "length")
        kept = [f.name for f in usable.schema if not isinstance(f.dataType, T.ArrayType) and f.name != "cluster"]
        schema = T.StructType(
            [probes.schema["query_id"], T.StructField("score", T.FloatType())]
            + [usable.schema[c] for c in kept]
        )
        finite = F.when(is_valid(F.col(vector), dim), True).otherwise(
            F.raise_error(F.lit(f"a query vector is not finite or its size is not {dim}")).cast("boolean")
        )
        probes = probes.select("query_id", vector).filter(F.col(vector).isNotNull()).filter(finite)
        limit = min(probe_block, max(1, PROBE_BLOCK_BYTES // (8 * dim)))

        def scan(block: pa.Table, mask: np.ndarray, floor: np.ndarray | None) -> DataFrame:
            """Candidates of the pairs (cluster, query) in ``mask``, written."""
            read = ids[mask.any(axis=1)].tolist()
            shared = self.spark.sparkContext.broadcast((block, dict(zip(ids.tolist(), np.packbits(mask, axis=1))), floor))
            found = usable.filter(F.col("cluster").isin(read)).select(*kept, vector, "cluster").mapInArrow(
                lambda batches: _score_clusters(batches, shared, vector, dim, k, tie_break, kept), schema
            )
            out = materialise(_merge(found, k, tie_break, salts).drop("pool_rank"), "clustered-candidates")
            shared.unpersist()
            return out

        self.reads, parts = [], []
        for block in _query_blocks(probes, limit):
            queries = _vectors(block.column(vector).combine_chunks(), dim).astype(np.float64)
            reach = upper_bounds(queries, middle[ids], facts)
            first = _enough_rows(reach, facts["n_rows"], k)
            best = scan(block, first, None)
            floor = self._floors(best, block, k)
            second = (reach.astype(np.float32) >= floor) & ~first
            parts.append(best)
            if second.any():
                parts.append(scan(block, second, floor))
            self.reads.append(Reads(len(ids), int(first.any(axis=1).sum()), int(second.any(axis=1).sum())))
        found = reduce(DataFrame.union, parts) if parts else self.spark.createDataFrame([], schema)
        return _merge(found, k, tie_break, salts)

    @staticmethod
    def _floors(best: DataFrame, block: pa.Table, k: int) -> np.ndarray:
        """The k-th best score of each query of the block, minus infinity where fewer were found."""
        ranked = best.select("query_id", "score", F.row_number().over(
            Window.partitionBy("query_id").orderBy(F.desc("score"))
        ).alias("n"))
        known = {r["query_id"]: r["score"] for r in ranked.filter(F.col("n") == k).collect()}
        return np.array([known.get(q, -np.inf) for q in block.column("query_id").to_pylist()], np.float32)


def upper_bounds(queries: np.ndarray, centres: np.ndarray, facts: dict) -> np.ndarray:
    """No row of a cluster (row) has a larger inner product with a query (column).

    By the triangle inequality: for distances from the centre, and for angles to it.
    """
    length, size = np.linalg.norm(queries, axis=1), np.linalg.norm(centres, axis=1)
    products = centres @ queries.T
    by_distance = products + facts["radius"][:, None] * length
    between = _angles(products, size[:, None] * length)
    nearest = np.maximum(between - facts["angle"][:, None], 0.0)
    # Without a direction of its own a centre or a query says nothing about angles.
    nearest[(size[:, None] * length) == 0] = 0.0
    cosine = np.cos(nearest)
    scale = np.where(cosine > 0, facts["most_length"][:, None], facts["least_length"][:, None])
    by_angle = cosine * scale * length
    # A zero vector scores zero.
    by_angle = np.where(facts["least_length"][:, None] == 0, np.maximum(by_angle, 0.0), by_angle)
    return np.minimum(by_distance, by_angle) + SLACK * facts["most_length"][:, None] * length


def _enough_rows(reach: np.ndarray, n_rows: np.ndarray, k: int) -> np.ndarray:
    """For every query the clusters with the highest bounds that hold ``k`` rows together."""
    order = np.argsort(-reach, axis=0, kind="stable")
    before = np.cumsum(n_rows[order], axis=0) - n_rows[order]
    mask = np.zeros(reach.shape, dtype=bool)
    np.put_along_axis(mask, order, before < k, axis=0)
    return mask


def _score_clusters(batches, shared, vector, dim, k, tie_break, kept) -> Iterator[pa.RecordBatch]:
    block, masks, floor = shared.value
    ids = block.column("query_id").combine_chunks()
    state = _BestRows(_vectors(block.column(vector).combine_chunks(), dim), k, floor)
    for whole in batches:
        for start in range(0, whole.num_rows, state.rows_at_once):
            part = whole.slice(start, state.rows_at_once)
            cluster = part.column("cluster").to_numpy()
            for one in np.unique(cluster).tolist():
                which = np.flatnonzero(np.unpackbits(masks[one], count=len(ids)))
                batch = _ordered(part.filter(pa.array(cluster == one)), tie_break)
                query, row, score = state.select(_vectors(batch.column(vector), dim), which)
                rows = batch.select(kept).take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(which[query])), pa.array(score), *rows.columns],
                    names=["query_id", "score", *kept],
                )


cloudpickle.register_pickle_by_value(sys.modules[__name__])
