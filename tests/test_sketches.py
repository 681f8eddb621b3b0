"""Sketches of batches against exact figures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wosearch.operators import metrics, quality, sketches


def test_distinct_counts_as_batches_arrive(spark, tmp_path):
    log = sketches.distinct_log(spark, str(tmp_path / "d"))
    rows = spark.range(60_000).select(
        F.col("id"), (F.col("id") % 25_000).cast("string").alias("a"), (F.col("id") % 7).alias("b"),
        F.when(F.col("id") % 2 == 0, F.lit("x")).alias("c"), F.lit(None).cast("string").alias("d"))
    columns = ["id", "a", "b", "c", "d"]
    for n in range(3):
        batch = rows.filter(F.col("id").between(n * 20_000, n * 20_000 + 19_999))
        assert sketches.add_distinct(log, batch, columns, f"b{n}")
        assert not sketches.add_distinct(log, batch, columns, f"b{n}")
        so_far = rows.filter(F.col("id") < (n + 1) * 20_000)
        exact = {r.column: r.n_distinct for r in quality.cardinality(so_far, columns).collect()}
        got = {r.column: r for r in sketches.distinct_counts(log).collect()}
        assert set(got) == set(columns)
        for c in columns:
            assert abs(got[c].n_distinct - exact[c]) <= sketches.distinct_bound() * exact[c]
        assert got["id"].n_values == so_far.count() and got["d"].n_values == 0
    first = {r.column: r.n_distinct for r in sketches.distinct_counts(log, 0).collect()}
    assert first["b"] == 7 and abs(first["a"] - 20_000) <= sketches.distinct_bound() * 20_000
    assert log.read().count() == 15


def test_quantiles_as_batches_arrive(spark, tmp_path):
    log = sketches.quantile_log(spark, str(tmp_path / "q"))
    rng = np.random.default_rng(2)
    values = {"A": rng.lognormal(3, 1, 9000), "B": np.repeat([5.0, 9.0], 4500), "C": np.sort(rng.normal(0, 1, 9000))}
    rows = spark.createDataFrame(
        [(s, i, float(x)) for s, xs in values.items() for i, x in enumerate(xs)] + [("A", 1, None)],
        "strategy string, i int, latency_ms double")
    for n in range(4):
        assert sketches.add_latencies(log, rows.filter(f"i % 4 = {n}"), f"b{n}")
    assert not sketches.add_latencies(log, rows.filter("i % 4 = 0"), "b0")
    got = {r.strategy: r for r in sketches.latency_figures(log).collect()}
    exact = {r.strategy: r for r in metrics.latency_stats(rows.filter("latency_ms IS NOT NULL")).collect()}
    bound = sketches.rank_bound()
    assert bound < 0.01
    for s, xs in values.items():
        assert got[s].n_values == len(xs)
        assert got[s].mean_ms == pytest.approx(exact[s].mean_ms) and got[s].std_ms == pytest.approx(exact[s].std_ms)
        below, upto = (xs < got[s].p95_ms).mean(), (xs <= got[s].p95_ms).mean()
        assert below <= 0.95 + bound and upto >= 0.95 - bound


def test_empty_log(spark, tmp_path):
    assert sketches.distinct_counts(sketches.distinct_log(spark, str(tmp_path / "a"))).count() == 0
    log = sketches.quantile_log(spark, str(tmp_path / "b"))
    empty = spark.createDataFrame([], "strategy string, latency_ms double")
    assert sketches.add_latencies(log, empty, "none") and sketches.latency_figures(log).count() == 0
