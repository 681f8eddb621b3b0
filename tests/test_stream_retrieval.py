"""Retrieval for a stream of queries: restarts, replays and snapshots."""

from threading import Thread

import pytest
from pyspark.sql import functions as F

from wosearch.config import STRATEGIES
from wosearch.operators import strategies
from wosearch.operators.encoding import HashEncoder
from wosearch.operators.router import classify, route_and_retrieve
from wosearch.plans.build import build_vectors
from wosearch.session import exists, materialise, scratch
from wosearch.sources import testdata, vector_table
from wosearch.streaming import retrieval

FOLDER = "/root/testdata/sf0.001"
ENCODER = HashEncoder(32)


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    raw = testdata.work_orders(spark, FOLDER)
    path = str(tmp_path_factory.mktemp("vectors") / "table")
    vector_table.append_batch(build_vectors(raw.drop("stored_vec"), ENCODER), path, "all")
    return vector_table.vector_log(spark, path)


@pytest.fixture(scope="module")
def queries(spark):
    asked = testdata.router_queries(testdata.work_orders(spark, FOLDER)).filter("query_id < 12")
    return asked.withColumn("query_id", F.col("query_id").cast("string")).cache()


def rows_of(df):
    return sorted((r.query_id, r.strategy, r["rank"], r.woid, round(r.score, 5)) for r in df.collect())


class Run:
    def __init__(self, spark, tmp_path, vectors):
        self.spark, self.vectors = spark, vectors
        self.source, self.hits, self.checkpoint = (str(tmp_path / n) for n in ("source", "hits", "checkpoint"))

    def offer(self, queries):
        queries.coalesce(1).write.mode("append").parquet(self.source)

    def __call__(self, **how):
        retrieval.start_retrieval(
            self.spark, self.source, self.vectors.read, self.hits, self.checkpoint, ENCODER, **how
        ).awaitTermination()
        return retrieval.hits_log(self.spark, self.hits)


def test_stream_equals_batch(spark, tmp_path, vectors, queries):
    run = Run(spark, tmp_path, vectors)
    for n in range(3):
        run.offer(queries.filter(f"query_id % 3 = {n}"))
    log = run(files_per_batch=1)
    want = route_and_retrieve(vectors.read(), queries, ENCODER)[0]
    assert rows_of(log.read()) == rows_of(want)
    assert log.history().count() == 3
    # A second run has nothing to do; later queries are answered alone.
    assert run().history().count() == 3
    later = queries.limit(2).withColumn("query_id", F.concat(F.lit("x"), "query_id"))
    run.offer(later)
    assert run().history().count() == 4
    assert rows_of(log.read().filter("query_id LIKE 'x%'")) == rows_of(route_and_retrieve(vectors.read(), later, ENCODER)[0])


def test_all_strategies(spark, tmp_path, vectors, queries):
    run = Run(spark, tmp_path, vectors)
    run.offer(queries)
    got = run(strategies=STRATEGIES).read()
    assert rows_of(got) == rows_of(strategies.retrieve_all(vectors.read(), classify(queries), ENCODER))
    assert {r.strategy for r in got.select("strategy").distinct().collect()} >= {"A", "C"}


@pytest.mark.parametrize("dies", ["before", "after"])
def test_restart_doubles_no_hit(spark, tmp_path, vectors, queries, monkeypatch, dies):
    """A batch dies before its hits are committed, or after that but before the stream knows."""
    run = Run(spark, tmp_path, vectors)
    for n in range(2):
        run.offer(queries.filter(f"query_id % 2 = {n}"))
    real, calls = retrieval.CommitLog.append, []

    def fail_once(log, df, batch):
        calls.append(batch)
        if len(calls) == 2:
            if dies == "after":
                assert real(log, df, batch)
            raise RuntimeError("driver died")
        return real(log, df, batch)

    monkeypatch.setattr(retrieval.CommitLog, "append", fail_once)
    with pytest.raises(Exception, match="driver died"):
        run(files_per_batch=1)
    log = run(files_per_batch=1)
    # The same micro-batch came again.
    assert calls[1] == calls[2] and len(set(calls)) == 2
    want = route_and_retrieve(vectors.read(), queries, ENCODER)[0]
    assert rows_of(log.read()) == rows_of(want) and log.history().count() == 2


def test_a_batch_sees_one_snapshot(spark, tmp_path, queries):
    """Rows appended between two micro-batches are found by the second one."""
    vectors = build_vectors(testdata.work_orders(spark, FOLDER).drop("stored_vec"), ENCODER)
    path = str(tmp_path / "vectors")
    log = vector_table.vector_log(spark, path)
    vector_table.append_batch(vectors.filter("Type = 'research'"), path, "first")
    run = Run(spark, tmp_path, log)
    run.offer(queries)
    before = rows_of(run(strategies=["A"]).read())
    vector_table.append_batch(vectors.filter("Type <> 'research'"), path, "second")
    later = queries.withColumn("query_id", F.concat(F.lit("x"), "query_id"))
    run.offer(later)
    hits = run(strategies=["A"])
    assert rows_of(hits.read(0)) == before
    assert rows_of(hits.read().filter("query_id LIKE 'x%'")) == rows_of(
        strategies.strategy_a(log.read(), later, ENCODER))


def test_table_built_by_the_first_batch_stays(spark, tmp_path, vectors, queries):
    """The table may be written when a batch first opens it; later batches read it, too."""
    made = []

    def opened():
        if not made:
            made.append(materialise(vectors.read(), "late-vectors"))
        return made[0]

    run = Run(spark, tmp_path, vectors)
    for n in range(2):
        run.offer(queries.filter(f"query_id % 2 = {n}"))
    retrieval.start_retrieval(
        spark, run.source, opened, run.hits, run.checkpoint, ENCODER, files_per_batch=1
    ).awaitTermination()
    log = retrieval.hits_log(spark, run.hits)
    assert rows_of(log.read()) == rows_of(route_and_retrieve(vectors.read(), queries, ENCODER)[0])
    assert log.history().count() == 2 and made[0].count() == vectors.read().count()


def test_scratch_leaves_tables_of_other_threads(spark):
    tables = {}
    with scratch(spark):
        tables["own"] = materialise(spark.range(5), "own")
        other = Thread(target=lambda: tables.update(other=materialise(spark.range(7), "other")))
        other.start()
        other.join()
    assert tables["other"].count() == 7
    assert not exists(spark, tables["own"].inputFiles()[0])
