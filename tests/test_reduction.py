"""Leading components against a full decomposition."""

import numpy as np
import pytest

from parlance.operators import reduction


def exact(x):
    units = x / np.linalg.norm(x, axis=1, keepdims=True)
    centred = units - units.mean(0)
    variances, vectors = np.linalg.eigh(centred.T @ centred / len(x))
    return units, variances[::-1], vectors[:, ::-1]


@pytest.mark.parametrize("decay", [0.6, 0.95])
def test_components_explain_what_the_best_ones_explain(spark, decay):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 30)) * decay ** np.arange(30) @ np.linalg.qr(rng.normal(size=(30, 30)))[0] + 0.3
    units, variances, vectors = exact(x)
    rows = spark.createDataFrame([(r.tolist(),) for r in units], "v array<double>").repartition(3)
    found, spread = reduction.leading_components(rows, 30, 4)
    assert np.allclose(found.T @ found, np.eye(4), atol=1e-9)
    assert spread.sum() >= 0.99 * variances[:4].sum() and (spread <= variances[0] * (1 + 1e-9)).all()
    captured = np.var(units @ found, axis=0)
    assert np.allclose(captured, spread, rtol=1e-6)
    if decay < 0.9:
        assert np.allclose(np.abs((found * vectors[:, :4]).sum(0)), 1, atol=1e-3)


def test_coordinates_nulls_and_an_empty_table(spark):
    schema = "id int, e array<double>, v string, reduced string"
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=5).tolist(), "x", "y") for i in range(40)]
    odd = [(100, None, None, None), (101, [0.0] * 5, None, None), (102, [1.0, None, 0.0, 0.0, 0.0], None, None)]
    frame = spark.createDataFrame(rows + odd, schema)
    found = {r["id"]: r["reduced"] for r in reduction.reduce_randomised(frame, "e", 2).collect()}
    assert [found[i] for i in (100, 101, 102)] == [None, None, None]
    units, _, vectors = exact(np.array([r[1] for r in rows]))
    assert np.allclose(np.abs([found[i] for i in range(40)]), np.abs(units @ vectors[:, :2]), atol=1e-6)
    assert reduction.reduce_randomised(frame.limit(0), "e", 2).collect() == []
