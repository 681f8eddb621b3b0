"""An append-only table of batches with snapshot reads.

A table is a folder with two parts. ``data`` holds one folder of Parquet files per attempt to
append a batch. ``log`` holds one small JSON manifest per commit, ``00000000000000000000.json``
being version 0, which names the batch, its folder and its number of rows.

* A batch is in the table if a manifest names it. Files of an append that died are in no manifest,
  so no reader sees them.
* A manifest appears under its name by one rename that fails if the name is taken. Of two writers
  that want the same version one wins, the other looks at the log again and takes the next one.
* A batch that is in the log already is not appended again, so an append can be repeated after any
  failure, as foreachBatch needs it.
* A reader takes the manifests up to a version; later appends don't change what it sees.

The rename goes through Hadoop's FileContext, so a table lies in any store Spark can write that has
an exclusive rename (HDFS, a mounted folder).
"""

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wosearch.session import exists, remove

MANIFEST = "version bigint, batch string, folder string, n_rows bigint"
DIGITS = 20


def write_once(spark: SparkSession, path: str, text: str) -> bool:
    """Let ``path`` appear with its whole content, unless it is there; tells whether it did."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    hadoop = jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    target = store.makeQualified(target)
    store.mkdirs(target.getParent())
    draft = hadoop.Path(target.getParent(), f".{uuid.uuid4().hex}")
    out = store.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    files = hadoop.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        # Without the option to overwrite, an existing target fails the rename.
        files.rename(draft, target, gateway.new_array(getattr(hadoop, "Options$Rename"), 0))
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" not in error.java_exception.getClass().getName():
            raise
        store.delete(draft, False)
        return False
    return True


@dataclass
class CommitLog:
    """The table in ``path``; ``schema`` is that of its rows."""

    spark: SparkSession
    path: str
    schema: T.StructType

    def history(self, version: int | None = None) -> DataFrame:
        """version, batch, folder, n_rows of every commit, or of those up to ``version``."""
        if not exists(self.spark, f"{self.path}/log"):
            return self.spark.createDataFrame([], MANIFEST)
        commits = self.spark.read.schema(MANIFEST).option("pathGlobFilter", "*.json").json(f"{self.path}/log")
        return commits if version is None else commits.filter(F.col("version") <= version)

    def _find(self, batch: str) -> tuple[bool, int]:
        """Whether the batch is committed, and the next version."""
        row = self.history().agg(
            F.coalesce(F.bool_or(F.col("batch") == batch), F.lit(False)).alias("known"),
            F.coalesce(F.max("version") + 1, F.lit(0)).alias("next"),
        ).first()
        return row["known"], row["next"]

    def append(self, df: DataFrame, batch: str) -> bool:
        """Add the rows as one batch; False, and nothing done, if the log has the batch."""
        known, version = self._find(batch)
        if known:
            return False
        folder = uuid.uuid4().hex
        wanted = df.select(*[
            # Equal types that differ in nullability inside can't be cast.
            F.col(f.name) if df.schema[f.name].dataType.simpleString() == f.dataType.simpleString()
            else F.col(f.name).cast(f.dataType).alias(f.name)
            for f in self.schema
        ])
        wanted.write.parquet(f"{self.path}/data/{folder}")
        n_rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{folder}").count()
        while True:
            manifest = {"version": version, "batch": batch, "folder": folder, "n_rows": n_rows}
            if write_once(self.spark, f"{self.path}/log/{version:0{DIGITS}d}.json", json.dumps(manifest)):
                return True
            # Another writer took this version; it may even have written this batch.
            known, version = self._find(batch)
            if known:
                remove(self.spark, f"{self.path}/data/{folder}")
                return False

    def read(self, version: int | None = None) -> DataFrame:
        """All rows, or those of a version; an empty table before the first commit.

        The driver sees one folder name per batch.
        """
        folders = [r["folder"] for r in self.history(version).select("folder").collect()]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{f}" for f in sorted(folders)])

    def leftovers(self) -> list[str]:
        """Folders of appends that were not committed. One of them may still be at work."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        data = jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        store = data.getFileSystem(conf)
        if not store.exists(data):
            return []
        committed = {r["folder"] for r in self.history().select("folder").collect()}
        return sorted({s.getPath().getName() for s in store.listStatus(data)} - committed)

    def clear_leftovers(self) -> int:
        """Delete them. Only while nobody appends."""
        found = self.leftovers()
        for folder in found:
            remove(self.spark, f"{self.path}/data/{folder}")
        return len(found)
