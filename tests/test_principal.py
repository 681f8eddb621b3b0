"""Principal components against NumPy's eigenvectors."""

import numpy as np
import pytest

from wosearch.operators import inspection
from wosearch.operators.principal import coordinates, principal_components


def table(spark, points, parts=5):
    rows = [(i, [float(x) for x in p], "" if i % 3 else "a") for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "id long, v array<float>, label string").repartition(parts)


def exact(points):
    x = np.asarray(points, np.float32).astype(float)
    values, axes = np.linalg.eigh(np.cov(x.T))
    values, axes = values[::-1], axes[:, ::-1]
    return x - x.mean(axis=0), values, axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(len(values))])


@pytest.mark.parametrize("extra", [0, 3, 62])
def test_against_eigenvectors(spark, extra):
    rng = np.random.default_rng(1)
    points = rng.normal(size=(400, 12)) @ np.diag(0.8 ** np.arange(12)) @ rng.normal(size=(12, 12)) + 5
    centred, values, axes = exact(points)
    rows = table(spark, points)
    found = principal_components(rows, "v", 3, extra)
    assert found.n_rows == 400 and (found.passes > 3) == (extra < 12)
    assert np.allclose(found.variances, values[:3], rtol=1e-9) and np.isclose(found.total_variance, values.sum())
    assert np.allclose(found.loadings, axes[:, :3], atol=1e-7)
    got = {r.id: (r.x, r.y) for r in coordinates(rows, "v", found, ("x", "y")).collect()}
    assert np.allclose([got[i] for i in range(400)], centred @ axes[:, :2], atol=1e-6)


def test_labels_and_nulls(spark):
    rng = np.random.default_rng(2)
    points = rng.normal(size=(60, 4)) * [9, 3, 1, 1]
    rows = table(spark, points).unionByName(spark.createDataFrame([(99, None, "b")], "id long, v array<float>, label string"))
    placed, shares = inspection.project_2d(rows, "id", "v", "label")
    centred, values, axes = exact(points)
    got = {r.id: r for r in placed.collect()}
    assert set(got) == set(range(60)) and {r.label for r in got.values()} == {"unknown", "a"}
    assert np.allclose([(got[i].x, got[i].y) for i in range(60)], centred @ axes[:, :2], atol=1e-6)
    assert np.allclose([r.variance_share for r in shares.orderBy("component").collect()], values[:2] / values.sum())


def test_little_data(spark):
    none = principal_components(table(spark, np.eye(3)).limit(0), "v")
    assert none.n_rows == 0 and none.shares == [0.0]
    one = principal_components(table(spark, [[1, 2, 3]]), "v")
    assert one.shares == [0.0, 0.0] and one.mean.tolist() == [1, 2, 3]
    line = principal_components(table(spark, [[i, 2 * i] for i in range(5)]), "v")
    assert line.shares == pytest.approx([1.0, 0.0])
    flat = inspection.project_2d(table(spark, [[i] for i in range(4)]), "id", "v", "label")
    assert sorted(r.x for r in flat[0].collect()) == [-1.5, -0.5, 0.5, 1.5] and {r.y for r in flat[0].collect()} == {0.0}


def test_different_lengths_fail(spark):
    with pytest.raises(Exception, match="vector size"):
        principal_components(table(spark, [[1, 2], [3, 4, 5]]), "v")
