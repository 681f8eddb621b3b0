"""Vectors in NumPy ``.npy`` files, and text files whose rows belong to them by position.

A Python data source: the driver reads only the headers of the files, each task reads byte ranges
of whole rows and hands on Arrow batches. Files count in the order of their names, so a folder of
shards is one long matrix; ``position`` is the row's place in it.

Files are reached through pyarrow's file systems: a path without a scheme is local (or mounted),
``s3://``, ``hdfs://`` and ``gs://`` go to the store. Written shards appear under their final names
only when all tasks are done.
"""

import ast
import posixpath
import struct
import sys
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage,
)

from wosearch.operators.numbering import with_row_index
from wosearch.schema import SEQ
from wosearch.sources.work_orders import read_columns, write_csv

NAME = "npy"
SCHEMA = "position bigint, embedding array<float>"
# Bytes of a task's range, of an Arrow batch, and of a written shard.
SPLIT_BYTES = 128 << 20
BATCH_BYTES = 4 << 20
SHARD_BYTES = 64 << 20
# Fixed value of the format.
_MAGIC = b"\x93NUMPY"


class NpyError(ValueError):
    """A file that is no two-dimensional, row by row matrix of numbers, or is cut short."""


@dataclass
class Matrix:
    """A file's header: where its rows start and what they look like."""

    path: str
    offset: int
    rows: int
    dim: int
    dtype: str

    @property
    def row_bytes(self) -> int:
        return self.dim * np.dtype(self.dtype).itemsize


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def read_header(store: fs.FileSystem, path: str) -> Matrix:
    with store.open_input_file(path) as f:
        start = f.read(12)
        if start[:6] != _MAGIC or len(start) < 12:
            raise NpyError(f"no .npy file: {path}")
        wide = start[6] >= 2  # from version 2 on, the header's length takes four bytes
        length = struct.unpack("<I", start[8:12])[0] if wide else struct.unpack("<H", start[8:10])[0]
        offset = (12 if wide else 10) + length
        f.seek(12 if wide else 10)
        header = ast.literal_eval(f.read(length).decode("utf-8" if start[6] >= 3 else "latin-1"))
        shape, dtype = header["shape"], np.dtype(header["descr"])
        if len(shape) != 2 or header["fortran_order"] or dtype.kind not in "fiu":
            raise NpyError(f"not a matrix of numbers in rows: {path} has {header}")
        found = Matrix(path, offset, shape[0], shape[1], dtype.str)
        if f.size() < offset + found.rows * found.row_bytes:
            raise NpyError(f"cut short: {path}")
    return found


def headers(path: str) -> list[Matrix]:
    """Headers of a file, or of all .npy files below a folder in the order of their names."""
    store, root = open_store(path)
    info = store.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    files = [root]
    if info.type == fs.FileType.Directory:
        below = store.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted(
            i.path for i in below if i.is_file and i.path.endswith(".npy")
            and not any(p.startswith(("_", ".")) for p in posixpath.relpath(i.path, root).split("/"))
        )
    with ThreadPoolExecutor(32) as pool:
        found = list(pool.map(lambda f: read_header(store, f), files))
    if len({m.dim for m in found}) > 1:
        raise NpyError(f"files of different widths: {path}")
    return found


@dataclass
class Rows(InputPartition):
    """A range of rows of one file and the position of its first row."""

    matrix: Matrix
    first: int
    n: int
    position: int

    def __init__(self, matrix: Matrix, first: int, n: int, position: int):
        self.matrix, self.first, self.n, self.position = matrix, first, n, position


class _Reader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes = path, split_bytes

    def partitions(self) -> list[Rows]:
        out, position = [], 0
        for m in headers(self.path):
            step = max(1, self.split_bytes // max(1, m.row_bytes))
            for first in range(0, m.rows, step):
                out.append(Rows(m, first, min(step, m.rows - first), position + first))
            position += m.rows
        # Spark wants a partition even where there are no rows.
        return out or [Rows(Matrix("", 0, 0, 0, "<f4"), 0, 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        m = partition.matrix
        if not partition.n:
            return
        store, _ = open_store(self.path)
        step = max(1, BATCH_BYTES // max(1, m.row_bytes))
        with store.open_input_file(m.path) as f:
            for first in range(0, partition.n, step):
                n = min(step, partition.n - first)
                data = f.read_at(n * m.row_bytes, m.offset + (partition.first + first) * m.row_bytes)
                values = np.frombuffer(data, m.dtype, n * m.dim).astype(np.float32)
                position = partition.position + first
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(position, position + n)),
                        pa.ListArray.from_arrays(
                            pa.array(np.arange(0, (n + 1) * m.dim, m.dim or 1, dtype=np.int32)[:n + 1]
                                     if m.dim else np.zeros(n + 1, np.int32)),
                            pa.array(values),
                        ),
                    ],
                    names=["position", "embedding"],
                )


@dataclass
class _Written(WriterCommitMessage):
    files: list


def _header_bytes(rows: int, dim: int) -> bytes:
    """Version 1.0, padded so that the rows start at a multiple of 64 bytes."""
    text = repr({"descr": "<f4", "fortran_order": False, "shape": (rows, dim)})
    length = -(-(10 + len(text) + 1) // 64) * 64 - 10
    return _MAGIC + b"\x01\x00" + struct.pack("<H", length) + text.ljust(length - 1).encode() + b"\n"


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, shard_bytes: int):
        self.path, self.shard_bytes = path, shard_bytes
        store, root = open_store(path)
        if store.get_file_info(root).type != fs.FileType.NotFound:
            raise FileExistsError(path)
        self.root, self.waiting = root, f"{root}/_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, _ = open_store(self.path)
        context = TaskContext.get()
        folder = f"{self.waiting}/{context.taskAttemptId()}"
        store.create_dir(folder)
        files: list[str] = []
        held = np.zeros((0, 0), "<f4")

        def put(block: np.ndarray) -> None:
            name = f"part-{context.partitionId():06d}-{len(files):06d}.npy"
            with store.open_output_stream(f"{folder}/{name}") as out:
                out.write(_header_bytes(*block.shape))
                out.write(block.tobytes())
            files.append(f"{folder}/{name}")

        for batch in iterator:
            if not batch.num_rows:
                continue
            vectors = batch.column(0)
            lengths = set(np.diff(vectors.offsets.to_numpy()).tolist())
            if vectors.null_count or len(lengths) > 1 or len(held) and lengths != {held.shape[1]}:
                raise NpyError("vectors to be written are null or of different lengths")
            block = vectors.flatten().to_numpy(zero_copy_only=False).astype("<f4")
            block = block.reshape(batch.num_rows, -1)
            held = np.concatenate([held, block]) if len(held) else block
            step = max(1, self.shard_bytes // max(1, 4 * held.shape[1]))
            whole = len(held) // step * step
            for start in range(0, whole, step):
                put(held[start:start + step])
            held = held[whole:]
        if len(held):
            put(held)
        return _Written(files)

    def commit(self, messages: list) -> None:
        store, _ = open_store(self.path)
        store.create_dir(self.root)
        for message in messages:
            for file in message.files if message else []:
                store.move(file, f"{self.root}/{posixpath.basename(file)}")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        store, _ = open_store(self.path)
        if store.get_file_info(self.waiting).type == fs.FileType.Directory:
            store.delete_dir(self.waiting)


class NpyDataSource(DataSource):
    """``spark.read.format("npy").load(path)``; option ``splitBytes``; written with ``shardBytes``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], int(self.options.get("shardBytes", SHARD_BYTES)))


def read_vectors(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """position, embedding of every row of the file or of the folder's files."""
    spark.dataSource.register(NpyDataSource)
    return spark.read.format(NAME).option("splitBytes", split_bytes).load(path)


def write_vectors(
    df: DataFrame, vector: str, path: str, order: str, shard_bytes: int = SHARD_BYTES
) -> None:
    """Rows in ascending ``order`` as shards; every task writes its own range of the order."""
    df.sparkSession.dataSource.register(NpyDataSource)
    (
        df.select(F.col(order).alias("_order"), F.col(vector).cast("array<float>").alias("embedding"))
        .repartitionByRange("_order").sortWithinPartitions("_order").select("embedding")
        .write.format(NAME).mode("append").option("shardBytes", shard_bytes).save(path)
    )


def write_texts(df: DataFrame, text: str, path: str, order: str) -> None:
    """The text column as CSV files, rows in ascending ``order``."""
    ordered = df.repartitionByRange(order).sortWithinPartitions(order)
    write_csv(ordered.select(F.col(text).alias("text")), path, quote_all=True)


def read_texts(spark: SparkSession, path: str, column: str = "text") -> DataFrame:
    """position, text: the rows of the CSV files in file order."""
    texts = read_columns(spark, path, [column]).withColumnRenamed(column, "text")
    return with_row_index(texts, SEQ, "position").select("position", "text")


def read_pairs(spark: SparkSession, vectors: str, texts: str, column: str = "text") -> DataFrame:
    """position, text, embedding: row by row, a vector file and a text file.

    One shuffle join on the position. Files with different numbers of rows fail the job.
    """
    left, right = read_vectors(spark, vectors), read_texts(spark, texts, column)
    lacking = F.raise_error(F.concat(
        F.lit("vectors and texts differ in number, first at row "), F.col("position").cast("string")
    )).cast("bigint")
    joined = left.withColumn("_v", F.lit(True)).join(right.withColumn("_t", F.lit(True)), "position", "full")
    return joined.select(
        F.when(F.col("_v") & F.col("_t"), F.col("position")).otherwise(lacking).alias("position"),
        "text", "embedding",
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])
