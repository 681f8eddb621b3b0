"""Batch embedding of text columns."""

import hashlib
import re
import sys
from typing import Protocol, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wosearch.config import CONTEXT_QUERY_PREFIX, EMBEDDING_DIM, ENCODE_BATCH, KNOWN_TOKENS, QUERY_PREFIX
from wosearch.functions.vectors import is_valid
from wosearch.schema import VECTOR_TYPE


class Encoder(Protocol):
    """What a model has to offer. It is pickled to the tasks, so load weights lazily."""

    dim: int

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        """Matrix of len(texts) x dim, rows of length one."""


class _Slots(dict):
    """Slots of the tokens met last. Most tokens of a corpus are rare, so they are not all kept."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, token: str) -> int:
        if len(self) >= KNOWN_TOKENS:
            self.clear()
        h = int.from_bytes(hashlib.md5(token.encode()).digest()[:4], "big")
        # Positive signs use slots 0..dim-1, negative ones dim..2*dim-1.
        slot = self[token] = h % self.dim + self.dim * (h // self.dim % 2)
        return slot


class HashEncoder:
    """Model-free encoder: every token adds +1 or -1 to one of ``dim`` buckets.

    Bucket and sign come from the first 32 bits of the token's md5, so any engine can
    repeat the vectors. The whole text counts.
    """

    _token = re.compile(r"[^\W_]+")

    def __init__(self, dim: int = EMBEDDING_DIM):
        self.dim = dim
        self._slots = _Slots(dim)

    def __getstate__(self):
        return {"dim": self.dim, "_slots": _Slots(self.dim)}

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        slot = self._slots.__getitem__
        counts = np.zeros((len(texts), 2 * self.dim))
        for i, text in enumerate(texts):
            tokens = self._token.findall((text or "").lower())
            if tokens:
                slots = np.fromiter(map(slot, tokens), np.int64, len(tokens))
                counts[i] = np.bincount(slots, minlength=2 * self.dim)
        vectors = counts[:, : self.dim] - counts[:, self.dim:]
        length = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
        return (vectors / np.where(length > 0, length, 1.0)).astype(np.float32)


def encode(c, encoder: Encoder, batch: int = ENCODE_BATCH) -> Column:
    """Vector of a text column; texts travel in Arrow batches, vectors come back the same way.

    To Spark the model is not deterministic: a text is encoded once, whatever filters follow.
    """

    @F.arrow_udf(VECTOR_TYPE)
    def run(texts: pa.Array) -> pa.Array:
        vectors = np.empty((len(texts), encoder.dim), np.float32)
        for i in range(0, len(texts), batch):
            vectors[i:i + batch] = encoder.encode(texts[i:i + batch].to_pylist())
        ends = np.arange(0, vectors.size + 1, encoder.dim, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(vectors.ravel()))

    return run.asNondeterministic()(c)


def embed_documents(df: DataFrame, encoder: Encoder) -> DataFrame:
    """Add both vector tracks in one pass, no prefix."""
    return df.withColumns({
        "text_vec": encode(F.col("text_repr"), encoder),
        "mice_vec": encode(F.col("mice_repr"), encoder),
    })


def embed_queries(queries: DataFrame, encoder: Encoder, text: str = "query_text") -> DataFrame:
    """Query vectors: the instruction prefix goes before the text, and the second track
    states the field the text stands for.
    """
    return queries.withColumns({
        "text_vec": encode(F.concat(F.lit(QUERY_PREFIX), text), encoder),
        "mice_vec": encode(
            F.concat(F.lit(QUERY_PREFIX), F.lit(CONTEXT_QUERY_PREFIX), text), encoder
        ),
    })


def split_by_validity(df: DataFrame, vector: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """Rows with a usable vector, and the rejects (wrong size, null, NaN, infinite)."""
    good = is_valid(F.col(vector), dim)
    return df.filter(good), df.filter(~good)


# Tasks get this module's code with the job and need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
