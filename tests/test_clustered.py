"""The clustered vector table against full scans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wosearch.operators import clustered
from wosearch.operators.clustered import ClusteredTable
from wosearch.operators.search import search

SCHEMA = "id long, name string, v array<float>"


def table(spark, vectors):
    rows = [(i, f"n{i}", None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA)


def probes(spark, vectors):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)],
                                 "query_id long, v array<float>")


def rows_of(df):
    return sorted((r.query_id, r.pool_rank, r.id, r.name, r.score) for r in df.collect())


def both(spark, tmp_path, rows, asked, k, dim, clusters=16, **how):
    stored = ClusteredTable(spark, str(tmp_path / "t"), "v", dim).create(rows, clusters)
    got = rows_of(stored.search(asked, k, ["id"], **how))
    assert got == rows_of(search(rows, asked, k, "v", dim, ("id",)))
    return stored


def grouped(rng, n_groups, each, dim, spread=0.05):
    middle = rng.normal(size=(n_groups, dim))
    points = np.repeat(middle, each, axis=0) + spread * rng.normal(size=(n_groups * each, dim))
    return points / np.linalg.norm(points, axis=1, keepdims=True)


def test_few_clusters_are_read(spark, tmp_path):
    rng = np.random.default_rng(3)
    points = grouped(rng, 20, 60, 16)
    rows = table(spark, rng.permutation(points))
    asked = probes(spark, points[::400] + 0.01 * rng.normal(size=(3, 16)))
    stored = both(spark, tmp_path, rows, asked, 10, 16, clusters=20)
    (reads,) = stored.reads
    assert reads.clusters >= 15 and reads.first + reads.second <= reads.clusters / 2
    # Partitions that aren't wanted are no part of the scan's files.
    wanted = stored.rows.filter(F.col("cluster").isin([0, 1]))
    plan = wanted._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cluster" in plan
    assert stored.rows.count() == 1200


def test_random_directions(spark, tmp_path):
    """Nothing to prune: still the rows of a full scan, over several blocks of queries."""
    rng = np.random.default_rng(4)
    points = rng.normal(size=(700, 8)) * rng.lognormal(size=(700, 1))
    stored = both(spark, tmp_path, table(spark, points), probes(spark, rng.normal(size=(25, 8))), 7, 8, probe_block=9)
    assert len(stored.reads) > 1


def test_ties_copies_and_zeros(spark, tmp_path):
    rng = np.random.default_rng(5)
    points = [*grouped(rng, 6, 30, 4), *[np.zeros(4)] * 20, *[np.array([1.0, 0, 0, 0])] * 150, None, None]
    order = rng.permutation(len(points))
    asked = probes(spark, [[1, 0, 0, 0], [-1, 0, 0, 0], [0, 0, 0, 0], [0, 1, 0, 0], [0, -3, 0.1, 0]])
    stored = both(spark, tmp_path, table(spark, [points[i] for i in order]), asked, 12, 4, clusters=9)
    assert stored.rows.filter(f"cluster = {clustered.UNPLACED}").count() == 2


def test_more_hits_wanted_than_rows(spark, tmp_path):
    both(spark, tmp_path, table(spark, np.eye(5)), probes(spark, np.eye(5)), 9, 5)


def test_append_widens_the_bounds(spark, tmp_path):
    rng = np.random.default_rng(6)
    first, far = grouped(rng, 5, 40, 6), 4 * rng.normal(size=(50, 6))
    stored = ClusteredTable(spark, str(tmp_path / "t"), "v", 6).create(table(spark, first), 8)
    more = table(spark, far).withColumn("id", F.col("id") + 1000)
    stored.append(more)
    whole = table(spark, first).unionByName(more)
    asked = probes(spark, rng.normal(size=(6, 6)))
    assert rows_of(stored.search(asked, 8, ["id"])) == rows_of(search(whole, asked, 8, "v", 6, ("id",)))
    with pytest.raises(FileExistsError):
        stored.create(more)


def test_empty_table_and_no_queries(spark, tmp_path):
    rows = table(spark, np.eye(3))
    stored = ClusteredTable(spark, str(tmp_path / "t"), "v", 3).create(rows)
    assert stored.search(probes(spark, np.eye(3)).limit(0), 2, ["id"]).count() == 0
    empty = ClusteredTable(spark, str(tmp_path / "e"), "v", 3).create(rows.limit(0))
    assert empty.search(probes(spark, np.eye(3)), 2, ["id"]).count() == 0


@pytest.mark.parametrize("bad", [[1.0, 2.0], [1.0, float("nan"), 0.0], [1.0, float("inf"), 0.0]])
def test_unusable_vectors_fail(spark, tmp_path, bad):
    rows = table(spark, [*np.eye(3)]).unionByName(spark.createDataFrame([(9, "x", bad)], SCHEMA))
    with pytest.raises(Exception, match="not finite or its size"):
        ClusteredTable(spark, str(tmp_path / "t"), "v", 3).create(rows)


@pytest.mark.parametrize("seed", range(5))
def test_bounds_hold(seed):
    """No row scores above its cluster's bound, whatever the centres are."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 3)) * rng.integers(0, 2, size=(6, 1))
    points = rng.normal(size=(200, 3)) * rng.integers(0, 3, size=(200, 1))
    own = rng.integers(0, 6, 200)
    length, size = np.linalg.norm(points, axis=1), np.linalg.norm(centres, axis=1)
    angle = np.where(length > 0, clustered._angles((points * centres[own]).sum(axis=1), length * size[own]), 0.0)
    distance = np.linalg.norm(points - centres[own], axis=1)

    def of(f, x):
        return np.array([f(x[own == c]) for c in range(6)])

    facts = {"radius": of(np.max, distance), "angle": of(np.max, angle),
             "least_length": of(np.min, length), "most_length": of(np.max, length)}
    queries = np.concatenate([rng.normal(size=(40, 3)), np.zeros((1, 3)), points[:5]])
    reach = clustered.upper_bounds(queries, centres, facts)
    assert (points @ queries.T <= reach[own]).all()
