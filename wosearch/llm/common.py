"""Helpers shared by the operators: input tables and digest strings."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_held_out(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, mod ``folds``, is 0; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def text_volume(df: DataFrame, text_col: str) -> tuple[int, int]:
    """Rows and bytes of text, to lay out the work; one narrow scan."""
    row = df.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col(text_col))).alias("bytes")
    ).first()
    return row["n"], row["bytes"] or 0


def parts(
    batches: Iterable[pa.RecordBatch], most_bytes: int, text: int = 1
) -> Iterator[list[pa.Array]]:
    """Columns of consecutive rows with a bounded number of bytes of text, nulls made empty.

    A text longer than the bound makes a part of its own.
    """
    for batch in batches:
        columns = list(batch.columns)
        columns[text] = pc.fill_null(columns[text], "").cast(pa.large_string())
        size = pc.binary_length(columns[text]).to_numpy().astype(np.int64)
        part = np.cumsum(size + 64) // most_bytes  # so rows are bounded, too
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
        for start, end in zip(cuts, cuts[1:]):
            if end > start:
                yield [column.slice(start, end - start) for column in columns]
        del columns, batch
    # A Python worker serves many tasks; what this one used goes back.
    pa.default_memory_pool().release_unused()
