"""Appends that are repeated, die half-way or race, and readers in between."""

import glob
import os
import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wosearch.schema import BATCH, SEQ, VECTOR_TABLE_SCHEMA
from wosearch.sources import commit_log, vector_table
from wosearch.sources.commit_log import CommitLog, write_once

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("t", T.StringType())])


@pytest.fixture
def log(spark, tmp_path):
    return CommitLog(spark, str(tmp_path / "table"), SCHEMA)


def rows(spark, start, stop):
    return spark.range(start, stop).withColumn("t", F.concat(F.lit("t"), "id"))


def ids(df):
    return sorted(r.id for r in df.collect())


def test_snapshots(spark, log):
    assert log.read().schema == SCHEMA and log.read().count() == 0 and log.history().count() == 0
    for n in range(3):
        assert log.append(rows(spark, 10 * n, 10 * n + 5), f"b{n}")
    before = log.read()
    assert ids(log.read(0)) == list(range(5))
    assert ids(log.read(1)) == [*range(5), *range(10, 15)]
    assert log.append(rows(spark, 90, 91), "b3")
    # What was opened before doesn't change.
    assert len(ids(before)) == 15 and len(ids(log.read())) == 16
    history = log.history().orderBy("version").collect()
    assert [(r.version, r.batch, r.n_rows) for r in history] == [
        (0, "b0", 5), (1, "b1", 5), (2, "b2", 5), (3, "b3", 1)]


def test_replayed_batch_adds_nothing(spark, log):
    assert log.append(rows(spark, 0, 5), "a")
    assert not log.append(rows(spark, 0, 5), "a")
    assert not log.append(rows(spark, 50, 60), "a")
    assert ids(log.read()) == list(range(5))
    assert log.append(rows(spark, 0, 0), "empty") and not log.append(rows(spark, 1, 2), "empty")
    assert len(glob.glob(f"{log.path}/log/*.json")) == 2


def test_append_that_dies_in_a_task(spark, log):
    """One task writes its file, another one dies; nothing of it is seen, a repeat adds all."""
    assert log.append(rows(spark, 0, 3), "a")
    poison = rows(spark, 10, 20).repartition(4).withColumn("t", F.when(
        F.col("id") == 13, F.raise_error(F.lit("task died")).cast("string")).otherwise(F.col("t")))
    with pytest.raises(Exception, match="task died"):
        log.append(poison, "b")
    assert ids(log.read()) == [0, 1, 2]
    assert log.append(rows(spark, 10, 20), "b")
    assert ids(log.read()) == [0, 1, 2, *range(10, 20)]


def test_append_killed_before_its_commit(spark, log, monkeypatch):
    """All files are there, the manifest is not."""
    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(commit_log, "write_once", die)
        with pytest.raises(KeyboardInterrupt):
            log.append(rows(spark, 0, 5), "a")
    assert log.read().count() == 0 and len(log.leftovers()) == 1
    assert log.append(rows(spark, 0, 5), "a")
    assert ids(log.read()) == list(range(5))
    assert log.clear_leftovers() == 1 and log.leftovers() == []
    assert ids(log.read()) == list(range(5))


def test_half_written_manifest_is_no_commit(spark, log):
    """A writer that dies while it writes its manifest leaves a hidden draft."""
    log.append(rows(spark, 0, 2), "a")
    with open(f"{log.path}/log/.draft", "w") as f:
        f.write('{"version": 1, "batch": "b", "fol')
    assert ids(log.read()) == [0, 1] and log.history().count() == 1
    assert log.append(rows(spark, 5, 6), "b") and ids(log.read()) == [0, 1, 5]


def test_a_name_is_given_once(spark, tmp_path):
    path = str(tmp_path / "log" / "0.json")
    assert write_once(spark, path, "first")
    assert not write_once(spark, path, "second")
    assert open(path).read() == "first"
    assert [f for f in os.listdir(tmp_path / "log") if not f.endswith(".crc")] == ["0.json"]


def test_lost_race_takes_the_next_version(spark, log, monkeypatch):
    """Another writer commits between the look at the log and the rename."""
    real, others = commit_log.write_once, iter([("other", 100), ("b", 200)])

    def raced(session, path, text):
        monkeypatch.setattr(commit_log, "write_once", real)
        batch, start = next(others)
        assert CommitLog(session, log.path, SCHEMA).append(rows(session, start, start + 1), batch)
        return real(session, path, text)

    monkeypatch.setattr(commit_log, "write_once", raced)
    assert log.append(rows(spark, 0, 2), "a")
    assert ids(log.read()) == [0, 1, 100]
    # This time the other writer appends the same batch; only one of the two counts.
    monkeypatch.setattr(commit_log, "write_once", raced)
    assert not log.append(rows(spark, 5, 8), "b")
    assert ids(log.read()) == [0, 1, 100, 200] and log.leftovers() == []
    assert sorted(r.version for r in log.history().collect()) == [0, 1, 2]


def test_concurrent_writers(spark, log):
    errors = []

    def write(n):
        try:
            log.append(rows(spark, n, n + 1), f"b{n}")
        except Exception as error:  # seen by the assertion below
            errors.append(error)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and ids(log.read()) == [0, 1, 2, 3]
    assert sorted(r.version for r in log.history().collect()) == [0, 1, 2, 3]


def test_vector_table(spark, tmp_path):
    path = str(tmp_path / "vectors")
    filled = [F.lit(None).cast(f.dataType).alias(f.name) for f in VECTOR_TABLE_SCHEMA if f.name != SEQ]
    df = spark.range(4).select(F.col("id").alias(SEQ), *filled)
    assert vector_table.append_batch(df, path, "x") and not vector_table.append_batch(df, path, "x")
    stored = vector_table.vector_log(spark, path).read()
    assert stored.columns == VECTOR_TABLE_SCHEMA.names and stored.count() == 4
    assert {r[BATCH] for r in stored.collect()} == {"x"}
