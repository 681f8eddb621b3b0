"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the n-grams of the lower-cased text, present or not, hashed into buckets. In the
training texts each bucket's documents are counted by class; the logarithm of the ratio of the
two smoothed shares is the bucket's scale. Buckets seen in fewer than ``MIN_DOCS`` documents,
or whose scale is within ``MIN_ERRORS`` standard errors of zero, are left out. A logistic regression on the scaled features gives
the weights. Where the two classes' training texts stand apart, the bias is moved so that a score
of one half lies midway between their edges. The chosen buckets and weights, no more than there
are buckets, are sent to the tasks.

Fitting reads a bounded sample: of the labelled documents that may be learned from, the
``TRAIN_ROWS`` whose ids have the smallest hashes. Scoring reads every text whole.

Defined results
* null labels, and labels of null ids, are not learned from; of repeated labels the highest
  counts; repeated documents of a labelled id are all learned from;
* a null or empty text has only boundary n-grams and gets the score these lead to;
* without documents of both classes there is nothing to tell apart: the score is the share of
  toxic documents learned from, 0 without any;
* a score of exactly one half counts as toxic; repeated rows get repeated results;
* only the id and the text of documents are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wosearch.llm.common import is_held_out, parts
from wosearch.session import materialise

ORDERS = (4, 6, 8)
BUCKET_BITS = 21
TRAIN_ROWS = 8_000
MIN_DOCS = 4
MIN_ERRORS = 3.0
REGULARISATION = 0.001
ITERATIONS = 25
# Shares of clean and of toxic training texts on their side of the class's edge.
CLEAN_EDGE, TOXIC_EDGE = 0.999, 0.01
FOLDS = 5
BATCH_BYTES = 1 << 19
SENT_ROWS = 1 << 16


@dataclass(frozen=True)
class Model:
    """Bias, the buckets that matter, and their weights times scales."""

    bias: float
    buckets: np.ndarray
    weights: np.ndarray

    def table(self) -> np.ndarray:
        """Weight of every bucket."""
        out = np.zeros(1 << BUCKET_BITS, dtype=np.float32)
        out[self.buckets] = self.weights
        return out


def ngrams(texts: Iterable[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Document index of each position, and for each order the bucket of the n-gram there."""
    pad = "\0" * (max(ORDERS) - 1)
    lowered = [pad + t.lower() + pad for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    docs = np.repeat(np.arange(len(lowered)), list(map(len, lowered)))
    out = []
    h = np.zeros(len(codes), dtype=np.uint32)
    for i in range(max(ORDERS)):  # h: hash of the first i + 1 characters from each position
        h = h[:max(len(codes) - i, 0)] * np.uint32(0x01000193)
        h ^= codes[i:]
        h ^= h >> np.uint32(15)
        if i + 1 in ORDERS:
            out.append(((h ^ np.uint32(i)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS))
    return docs, out


def present(texts: list[str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, bucket) pairs; ``wanted`` marks the buckets that matter."""
    docs, orders = ngrams(texts)
    keys = []
    for buckets in orders:
        own = docs[:len(buckets)]
        if wanted is not None:
            hit = wanted[buckets]
            own, buckets = own[hit], buckets[hit]
        keys.append(own << BUCKET_BITS | buckets)
    distinct = np.unique(np.concatenate(keys))
    return distinct >> BUCKET_BITS, distinct & (1 << BUCKET_BITS) - 1


def training_texts(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """toxic, text of the sample to learn from."""
    known = (
        labels.filter("doc_id is not null and toxic in (0, 1)")
        .filter(~is_held_out(F.col("doc_id"), FOLDS))
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    )
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select(
        F.col("doc_id").alias("labelled_id"), "toxic"
    )
    texts = docs.select("doc_id", "text")
    # At most ``rows`` ids.
    return texts.join(F.broadcast(sample), F.col("doc_id") == F.col("labelled_id")).select(
        "toxic", "text"
    )


def _count_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << BUCKET_BITS), dtype=np.int32)
    n = np.zeros(2, dtype=np.int64)
    for toxic, texts in parts(batches, BATCH_BYTES):
        label = toxic.to_numpy()
        docs, buckets = present(texts.to_pylist())
        for y in (0, 1):
            np.add.at(counts[y], buckets[label[docs] == y], 1)
            n[y] += (label == y).sum()
    seen = np.flatnonzero(counts.sum(axis=0))
    names = ["bucket", "clean", "toxic"]
    for at in range(0, len(seen), SENT_ROWS):
        some = seen[at:at + SENT_ROWS]
        columns = (some, counts[0, some], counts[1, some])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)
    yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()) for c in (-1, *n.tolist())], names=names)


def scales(texts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chosen buckets, their log-count ratios, and the documents of each class."""
    # A task has each bucket once, so rows are dealt as they are and no task holds a table of them.
    summed = texts.mapInArrow(_count_task, "bucket long, clean long, toxic long").repartition(
        "bucket"
    ).groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    n = np.array(next(
        ((r["clean"], r["toxic"]) for r in summed.filter("bucket = -1").collect()), (0, 0)
    ))
    ratio = F.log((F.col("toxic") + 1) / (int(n[1]) + 2)) - F.log(
        (F.col("clean") + 1) / (int(n[0]) + 2)
    )
    # One row per bucket at most.
    chosen = summed.filter(f"bucket >= 0 and clean + toxic >= {MIN_DOCS}").select(
        "bucket", ratio.alias("ratio"),
        F.sqrt(1 / (F.col("toxic") + 1) + 1 / (F.col("clean") + 1)).alias("error"),
    ).filter(F.abs("ratio") >= MIN_ERRORS * F.col("error")).orderBy("bucket").toArrow()
    return chosen["bucket"].to_numpy(), chosen["ratio"].to_numpy(), n


def fit(texts: DataFrame) -> Model:
    """Fits toxic, text rows."""
    # Imported here, so that the tasks that score don't load it.
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.linalg import SparseVector, VectorUDT

    spark = texts.sparkSession
    buckets, ratios, n = scales(texts)
    if not n.all() or not len(buckets):
        share = n[1] / n.sum() if n.sum() else 0.0
        with np.errstate(divide="ignore"):
            bias = float(np.log(share) - np.log1p(-share))
        return Model(bias, np.zeros(0, np.int64), np.zeros(0))
    shared = spark.sparkContext.broadcast((buckets, ratios))

    @F.udf(VectorUDT())
    def vector(text):
        chosen, ratio = shared.value
        _, found = present([text or ""])
        at = np.flatnonzero(np.isin(chosen, found, assume_unique=True))
        return SparseVector(len(ratio), at, ratio[at])

    # The rarer class counts more, half way to balance on a logarithmic scale.
    rows = texts.select(
        "toxic", F.col("toxic").cast("double").alias("label"), vector("text").alias("features"),
        F.when(F.col("toxic") == 1, float(np.sqrt(n[0] / n[1]))).otherwise(1.0).alias("weight"),
    )
    model = LogisticRegression(
        maxIter=ITERATIONS, regParam=REGULARISATION, standardization=False, weightCol="weight"
    ).fit(features := materialise(rows, "toxicity-features"))
    shared.unpersist()
    # Where the classes stand apart, one half lies in the middle between them.
    margin = vector_to_array("rawPrediction")[1]
    edges = model.transform(features).agg(
        F.percentile_approx(F.when(F.col("toxic") == 0, margin), CLEAN_EDGE).alias("clean"),
        F.percentile_approx(F.when(F.col("toxic") == 1, margin), TOXIC_EDGE).alias("toxic"),
    ).first()
    shift = (edges["clean"] + edges["toxic"]) / 2 if edges["clean"] < edges["toxic"] else 0.0
    return Model(model.intercept - shift, buckets, model.coefficients.toArray() * ratios)


def _score_task(batches: Iterable[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    model = shared.value
    weights = model.table()
    wanted = weights != 0
    for doc_ids, texts in parts(batches, BATCH_BYTES):
        docs, buckets = present(texts.to_pylist(), wanted)
        with np.errstate(over="ignore"):
            margin = model.bias + np.bincount(docs, weights[buckets], minlength=len(texts))
            score = 1 / (1 + np.exp(-margin))
        yield pa.RecordBatch.from_arrays([doc_ids, pa.array(score)], names=["doc_id", "score"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    return narrow.mapInArrow(lambda b: _score_task(b, shared), "doc_id long, score double")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(materialise(training_texts(docs, labels), "toxicity-texts"))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that score below one half, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.RecordBatch.from_arrays(
                [pa.nulls(len(batch), pa.int64()), batch.column("text")], names=["doc_id", "text"]
            )
            scores = [b.column(1) for b in _score_task([text], shared)]
            if scores:
                values = np.concatenate([s.to_numpy() for s in scores])
                yield batch.filter(pa.array(values < 0.5))

    return docs.mapInArrow(task, docs.schema)
