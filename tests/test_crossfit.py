"""Nested cross-fits against direct fits per fold."""

import numpy as np
import pytest

from pertgrid.operators import crossfit as cf

MULTIPLIERS = [0.0, 0.1, 1.0, 10.0, float("inf")]
NAMES = ["f1", "f2"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    t, g = 24, 30
    x = rng.normal(size=(t, g)) * (rng.random((t, g)) < 0.8)
    features = np.column_stack([np.ones(g), rng.normal(size=(g, 2))])
    y = x * (0.6 + 0.3 * features[:, 1]) + rng.normal(0, 0.3, (t, g))
    strong = rng.random((t, g)) < 0.4
    strong[3] = False
    outer, inner = rng.integers(0, 3, t), rng.integers(0, 2, t)
    pairs = spark.createDataFrame([(i, j, float(x[i, j]), float(y[i, j]), bool(strong[i, j])) for i in range(t) for j in range(g)] + [(0, 99, None, 1.0, True)], "target long, gene_id long, x double, y double, strong boolean")
    folds = spark.createDataFrame([(i, int(outer[i]), int(inner[i])) for i in range(t)], "target long, outer int, inner int")
    feats = spark.createDataFrame([(j, float(features[j, 1]), float(features[j, 2])) for j in range(g)], "gene_id long, f1 double, f2 double")
    return x, y, strong, features, outer, inner, pairs, folds, feats


def scales_of(x, y, m):
    pooled = (x * y).sum() / (x * x).sum()
    energy = (x * x).sum(0)
    if np.isinf(m):
        return np.full(x.shape[1], pooled)
    lam = m * np.median(energy[energy > 0])
    below = energy + lam
    return np.where(below > 0, ((x * y).sum(0) + lam * pooled) / np.where(below > 0, below, 1), pooled)


def beta_of(x, y, f, m):
    e = (x * x).sum(0)
    a, b = f.T @ (e[:, None] * f), f.T @ (x * y).sum(0)
    if np.isinf(m):
        return np.array([(x * y).sum() / (x * x).sum(), 0, 0])
    return np.linalg.pinv(a + np.diag([0, m * a[0, 0], m * a[0, 0]])) @ b


def loss_of(x, y, strong, s):
    use = strong & (strong.sum(1) >= cf.MIN_STRONG)[:, None]
    r = (x * s - y)[use]
    return r @ r, len(r)


def nested(x, y, strong, outer, inner, held, fit):
    train = outer != held
    out = []
    for m in MULTIPLIERS:
        error = n = 0
        for i in (0, 1):
            a, b = train & (inner != i), train & (inner == i)
            e, k = loss_of(x[b], y[b], strong[b], fit(x[a], y[a], m))
            error, n = error + e, n + k
        out.append((error / n, m))
    return min(out)


def test_nested_choice_equals_direct_fits(spark, data):
    x, y, strong, f, outer, inner, pairs, folds, feats = data
    sums = cf.fold_sums(pairs, folds).persist()
    chosen, scales = cf.gene_scales(sums, MULTIPLIERS)
    betas = cf.context_model(sums, feats, NAMES, MULTIPLIERS)
    got, beta = {r.held: r for r in chosen.collect()}, {r.held: r for r in betas.collect()}
    found = {(r.held, r.gene_id): r.scale for r in scales.collect()}
    pooled = {r.held: r.pooled for r in cf.pooled_scales(sums).collect()}
    want = np.zeros((3, *x.shape))
    for h in range(3):
        train = outer != h
        loss, m = nested(x, y, strong, outer, inner, h, scales_of)
        assert got[h].multiplier == m and np.isclose(got[h].loss, loss)
        s = scales_of(x[train], y[train], m)
        assert np.allclose([found[h, j] for j in range(30)], s)
        loss, m = nested(x, y, strong, outer, inner, h, lambda a, b, m: f @ beta_of(a, b, f, m))
        assert beta[h].multiplier == m and np.isclose(beta[h].loss, loss)
        b = beta_of(x[train], y[train], f, m)
        assert np.allclose(beta[h].beta, b)
        assert np.isclose(pooled[h], (x[train] * y[train]).sum() / (x[train] ** 2).sum())
        held = outer == h
        want[:, held] = x[held] * pooled[h], x[held] * s, x[held] * (f @ b)
    out = cf.predictions(pairs, folds, scales, betas, cf.pooled_scales(sums), feats, NAMES).where("gene_id < 99").collect()
    assert len(out) == x.size
    for r in out:
        assert np.allclose((r.one_scale, r.gene_scales, r.context), want[:, r.target, r.gene_id])


def test_bootstrap_equals_the_explicit_resample(spark, data):
    x, y, strong, f, outer, inner, pairs, folds, feats = data
    sums = cf.fold_sums(pairs, folds)
    betas = cf.context_model(sums, feats, NAMES, MULTIPLIERS)
    keys = np.array([r[0] for r in spark.range(24).selectExpr("xxhash64(id) AS k").collect()])
    w = cf.poisson_weights(keys, 40, 3)
    assert abs(w.mean() - 1) < 0.15 and (w == cf.poisson_weights(keys, 40, 3)).all() and set(np.unique(w)) <= set(range(9))
    got = {(r.held, r.coefficient): r for r in cf.bootstrap_context(pairs, folds, feats, NAMES, betas, 40, 3).collect()}
    multiplier = {r.held: r.multiplier for r in betas.collect()}
    chosen = spark.createDataFrame([(0, 0.5, 7.0), (1, float("inf"), 7.0), (2, 0.0, 7.0)], "held int, multiplier double, energy double")
    genes = {(r.held, r.gene_id): r for r in cf.bootstrap_genes(pairs, folds, chosen, 40, 3, genes_together=8).collect()}
    for h, m in ((0, 0.5), (1, np.inf), (2, 0.0)):
        train, samples, away = outer != h, [], []
        for b in range(40):
            rows = np.repeat(np.nonzero(train)[0], w[train, b].astype(int))
            xs, ys = x[rows], y[rows]
            samples.append(beta_of(xs, ys, f, multiplier[h]))
            pooled = (xs * ys).sum() / (xs * xs).sum()
            below = (xs * xs).sum(0) + m * 7.0
            away.append(np.zeros(30) if np.isinf(m) else ((xs * ys).sum(0) + m * 7.0 * pooled) / below - pooled)
        for k, name in enumerate(["constant", *NAMES]):
            v = np.array(samples)[:, k]
            r = got[h, name]
            assert np.allclose((r.q025, r["median"], r.q975), np.quantile(v, [0.025, 0.5, 0.975])) and np.isclose(r.positive_fraction, (v > 0).mean())
        for g in range(30):
            r, v = genes[h, g], np.array(away)[:, g]
            assert np.allclose((r.q025, r["median"], r.q975), np.quantile(v, [0.025, 0.5, 0.975]), atol=1e-12)


def test_imputed_ridge_equals_a_direct_fit(spark):
    rng = np.random.default_rng(2)
    n, p = 60, 3
    v = rng.normal(2, 1.5, (n, p))
    v[rng.random((n, p)) < 0.2] = np.nan
    v[:, 2] = 4.0
    y, fold = rng.normal(size=n), rng.integers(0, 3, n)
    rows = spark.createDataFrame([(int(fold[i]), *[None if np.isnan(a) and i % 2 else float(a) for a in v[i]], float(y[i])) for i in range(n)], "fold int, a double, b double, c double, y double")
    names = ["a", "b", "c"]
    fits = cf.imputed_ridge(rows, names, "y", 0.7)
    out = {(r.fold, r.y): r.predicted for r in cf.ridge_predictions(rows, fits, names).collect()}
    for h in range(3):
        a, b = v[fold != h], y[fold != h]
        med = np.nanmedian(a, axis=0)
        a = np.where(np.isnan(a), med, a)
        mean, sd = a.mean(0), a.std(0)
        sd[sd == 0] = 1
        d = (a - mean) / sd
        beta = np.linalg.pinv(d.T @ d + 0.7 * np.eye(p)) @ (d.T @ (b - b.mean()))
        for i in np.nonzero(fold == h)[0]:
            assert np.isclose(out[h, y[i]], b.mean() + (np.where(np.isnan(v[i]), med, v[i]) - mean) / sd @ beta)


def test_medians_of_many_bins_are_exact(spark):
    rng = np.random.default_rng(8)
    for n in (1, 2, 7, 200):
        v = [*np.exp(rng.normal(0, 3, n)), 0.0]
        found = cf.exact_medians(spark.createDataFrame([(k, float(x)) for k in (0, 1) for x in v] + [(2, 0.0)], "k int, v double"), ["k"], "v", "m").collect()
        assert sorted(r.k for r in found) == [0, 1] and all(np.isclose(r.m, np.median(v[:-1]), rtol=1e-15) for r in found)


def test_training_sums_of_genes_without_training_entries_are_exact_zeros(spark):
    sums = spark.createDataFrame([(0, 0, 5, 0.1, 0.2, 0.3, 0.1, 0.7, 1.0), (1, 0, 5, 0.3, 0.1, 0.2, 0.6, 0.1, 2.0), (1, 1, 6, 0.7, 0.3, 0.4, 0.9, 0.5, 1.0)], "outer int, inner int, gene_id int, xx double, xy double, mxx double, mxy double, myy double, n double")
    found = {(r.held, r.left_out, r.gene_id): (r.xx, r.xy) for r in cf.training_sums(sums).collect()}
    assert len(found) == 12 and found[1, cf.NONE, 6] == (0.0, 0.0) and found[0, 0, 5] == (0.0, 0.0) and found[0, cf.NONE, 5] == (0.3, 0.1)


def test_inputs_are_stored_and_pairs_dealt_once(spark):
    from pertgrid.plans import crossfit as plans

    pairs, folds, features = plans.inputs(spark, "/root/testdata/sf0.001")
    executed = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in executed(pairs) + executed(folds)
    nothing = spark.createDataFrame([], "held int, gene_id long, scale double")
    betas, pooled = spark.createDataFrame([], "held int, beta array<double>"), spark.createDataFrame([], "held int, pooled double")
    found = cf.predictions(pairs, folds, nothing.hint("merge"), betas, pooled, features.hint("merge"), plans.NAMES)
    assert found.count() == 0 and executed(found).split("Initial Plan")[0].count("hashpartitioning(held") == 0
