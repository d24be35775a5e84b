"""Bounded searches against fine grids, and the sign bound of the pursuit."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from pertgrid.operators import bounded, signatures


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    n = 240
    fold, x, z = rng.integers(0, 3, n), rng.normal(size=n), rng.normal(size=n)
    y = np.expm1(0.7 * x) + 0.4 * z + 0.1 * rng.normal(size=n) - 0.5 * (fold == 1)
    df = spark.createDataFrame([(int(a), float(b), float(c), float(e)) for a, b, c, e in zip(fold, x, z, y)] + [(0, 1.0, 1.0, None)], "fold int, x double, z double, y double")
    return fold, x, z, y, df


def test_one_parameter_equals_a_fine_grid(rows):
    fold, x, _, y, df = rows
    got = {r.fold: r for r in bounded.bounded_fit(df, "fold", "y", lambda a: F.expm1(a * F.col("x")), [(0.0, 1.5)]).collect()}
    grid = np.linspace(0, 1.5, 15001)
    for h in range(3):
        loss = np.array([((np.expm1(a * x[fold != h]) - y[fold != h]) ** 2).sum() for a in grid])
        assert got[h].parameters[0] == pytest.approx(grid[loss.argmin()], abs=2e-4) and got[h].loss <= loss.min() * (1 + 1e-6)


def test_bounds_hold(rows):
    *_, df = rows
    for r in bounded.bounded_fit(df, "fold", "y", lambda a: F.expm1(a * F.col("x")), [(0.0, 0.2)]).collect():
        assert r.parameters == [0.2]
    for r in bounded.bounded_fit(df.withColumn("y", -F.col("y")), "fold", "y", lambda a: F.expm1(a * F.col("x")), [(0.0, 2.0)]).collect():
        assert r.parameters[0] == pytest.approx(0, abs=1e-3)


def test_two_parameters_equal_least_squares(rows):
    fold, x, z, y, df = rows
    got = {r.fold: r for r in bounded.bounded_fit(df, "fold", "y", lambda a, b: a * F.col("x") + b * F.col("z"), [(0.0, 2.0), (0.0, 2.0)]).collect()}
    for h in range(3):
        w = np.linalg.lstsq(np.column_stack([x, z])[fold != h], y[fold != h], rcond=None)[0]
        assert got[h].parameters == pytest.approx(w.tolist(), abs=3e-4)


def test_one_fold_and_no_rows(rows):
    *_, df = rows
    only = bounded.bounded_fit(df.where("fold = 1"), "fold", "y", lambda a: a * F.col("x"), [(0.5, 1.5)]).collect()
    assert [tuple(r.parameters) for r in only] == [(0.5,)] and only[0].loss == 0
    assert bounded.bounded_fit(df.where("fold = 9"), "fold", "y", lambda a: a * F.col("x"), [(0.0, 1.0)]).collect() == []


def test_anchor_is_never_positive(spark):
    rng = np.random.default_rng(5)
    for trial in range(20):
        x = rng.normal(size=(30, 6))
        y = x @ rng.normal(size=6)
        g, b = x.T @ x, x.T @ y
        w = signatures.matching_pursuit(g, b, 3, trial % 6, True)
        assert w[trial % 6] <= 0 and (w != 0).sum() <= 3
        chosen = [trial % 6, *(j for j in np.nonzero(w)[0] if j != trial % 6)]
        best = min(((y - x[:, s] @ np.linalg.lstsq(x[:, s], y, rcond=None)[0]) ** 2).sum() for s in ([chosen] if np.linalg.lstsq(x[:, chosen], y, rcond=None)[0][0] <= 0 else [chosen[1:]]) if s)
        assert ((y - x @ w) ** 2).sum() == pytest.approx(best)
    rows = [(k, i, j, float(i == j) * 2, 3.0 if i == k else -1.0) for k, i, j in itertools.product(range(2), range(3), range(3))]
    out = signatures.sparse_signatures(spark.createDataFrame(rows, "key long, i int, j int, g double, r double"), "key", 2, anchored=True).collect()
    assert {(r.key, r.i): r.weight for r in out}[0, 0] == 0 and sum(r.key == 0 for r in out) == 2
