"""Shared working folder of a session and tables written to it."""

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FOLDERS: dict[str, str] = {}


class _Scratch(threading.local):
    """Lists of the tables written inside each open ``scratch`` of a thread."""

    def __init__(self):
        self.open: list[list[str]] = []


_SCRATCH = _Scratch()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, named by the cluster in spark.checkpoint.dir.

    Only a local session may fall back to a temporary folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="wosearch-")
    return _LOCAL_FOLDERS[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, **options) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder, with the writer's ``options``, and read
    it back.

    Cuts lineage so that a lost executor costs one task, and gives the optimizer the real
    size of the table when it later chooses between a broadcast and a shuffle join.
    """
    path = new_path(df.sparkSession, label)
    if _SCRATCH.open:
        _SCRATCH.open[-1].append(path)
    df.write.options(compression="zstd", **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _hadoop_path(spark: SparkSession, path: str):
    """The path and its file system, whatever store it is in."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(sc._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, store = _hadoop_path(spark, path)
    return store.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table once its rows were used."""
    where, store = _hadoop_path(spark, path)
    store.delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables this thread writes inside are removed at the end; use up the results
    before. What other threads write meanwhile, such as the one that started a stream, stays.
    """
    made: list[str] = []
    _SCRATCH.open.append(made)
    try:
        yield
    finally:
        _SCRATCH.open.pop()
        for path in made:
            remove(spark, path)


def spread(df: DataFrame) -> DataFrame:
    """Spread a table that was read from fewer splits than there are cores over the cores.

    A table with more splits than that is left alone: no shuffle.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df
