"""Panel scores of several models against dense brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pertgrid.operators import panel

GENES, DEPTHS = 30, (5, 12, 200)


@pytest.fixture(scope="module")
def effects(spark):
    rng = np.random.default_rng(3)
    truth = {t: np.round(rng.normal(size=GENES) * (rng.random(GENES) < 0.7), 1) for t in range(6)}
    models = {("a", t): np.round(truth[t] * 0.5 + rng.normal(size=GENES) * (rng.random(GENES) < 0.5), 1) for t in range(6)} | {("b", t): np.round(rng.normal(size=GENES), 1) for t in range(4)}
    models["b", 2] = np.zeros(GENES)
    rows = lambda of: [(*(k if isinstance(k, tuple) else (k,)), j, float(v[j])) for k, v in of.items() for j in range(GENES) if v[j] or not v.any()]
    m = spark.createDataFrame(rows(models) + [("a", 77, 1, 2.0), (None, 1, 1, 9.0), ("a", 1, None, 9.0)], "model string, target long, gene_id long, value double")
    return truth, models, m, spark.createDataFrame(rows(truth), "target long, gene_id long, value double")


def cosine(x, y):
    n = np.linalg.norm(x) * np.linalg.norm(y)
    return x @ y / n if n else 0.0


@pytest.mark.parametrize("own_genes", [True, False])
def test_frame_equals_dense_scores(spark, effects, own_genes):
    truth, models, m, t = effects
    strong = t.where("abs(value) > 0.9").select("target", "gene_id")
    source = m.where("model = 'a' AND target <> 77").select("target", "gene_id", "value")
    got = {(r.model, r.target): r for r in panel.evaluation_frame(m, t, source, GENES, strong, own_genes, DEPTHS, 6).collect()}
    assert set(got) == set(models)
    gated = set()
    for (model, target), r in got.items():
        keep = np.ones(GENES, bool)
        keep[target] = own_genes
        x, y = models[model, target][keep], truth[target][keep]
        assert r.cosine == pytest.approx(cosine(x, y)) and r.nae == pytest.approx(np.abs(x - y).sum() / np.abs(y).sum())
        assert r.norm_ratio == pytest.approx(np.linalg.norm(x) / np.linalg.norm(y)) and r.squared_error == pytest.approx(((x - y) ** 2).sum())
        mask = np.abs(y) > 0.9
        gated.add(mask.sum() >= 6)
        assert r.strong_genes == mask.sum() and (r.strong_direction is None) == (mask.sum() < 6)
        if mask.sum() >= 6:
            assert r.strong_direction == pytest.approx((np.sign(x) == np.sign(y))[mask].mean()) and r.strong_nae == pytest.approx(np.abs(x - y)[mask].sum() / np.abs(y)[mask].sum())
        for k in DEPTHS:
            top = [set(np.argsort(-np.abs(v), kind="stable")[:k]) for v in (x, y)]
            right = sum(1 for g in top[0] & top[1] if x[g] and np.sign(x[g]) == np.sign(y[g]))
            assert r[f"signed_recovery_{k}"] == pytest.approx(right / min(k, GENES))
        s = np.array([cosine(x, truth[c][keep]) for c in range(6)])
        if x.any():
            near = np.abs(s - s[target]) < 1e-12
            rank = 1 + ((s > s[target]) & ~near).sum() + 0.5 * (near.sum() - 1)
            assert r["rank"] == rank and r.retrieval == pytest.approx(1 - (rank - 1) / 5) and r.top1 == (rank == 1)
        else:
            assert r.retrieval == 0.5 and r["rank"] is None and not r.top1
        a = models["a", target][keep]
        assert r.source_norm == pytest.approx(np.linalg.norm(a)) and r.oracle_projection == pytest.approx(a @ y / (a @ a))
    assert gated == {True, False}


def test_composite_and_empty(spark, effects):
    truth, models, m, t = effects
    frame = panel.evaluation_frame(m, t, t, GENES, depths=(5,))
    c = {r.model: r for r in panel.composite(frame, {"cosine": 1, "nae": -1, "strong_genes": 1}, "b", "a").collect()}
    assert (c["a"].cosine, c["a"].nae, c["a"].composite) == (1, 1, 1) and (c["b"].cosine, c["b"].composite) == (0, 0) and c["a"].strong_genes is None
    assert panel.composite(frame, {"cosine": 1}, "b", "none").where("composite IS NOT NULL").count() == 0
    assert panel.evaluation_frame(m.limit(0), t, t, GENES).count() == 0 and panel.evaluation_frame(m, t.limit(0), t, GENES).count() == 0
    alone = panel.evaluation_frame(m.where("target = 1"), t.where("target = 1"), t.limit(0), GENES, depths=(5,)).where("model = 'a'").first()
    assert alone.retrieval == 0.5 and alone.source_norm is None
    repeated = panel.panel_pairs(m.where("model IS NOT NULL").withColumn("extra", F.lit(1)), t)
    assert repeated.columns == ["model", "target", "gene_id", "prediction", "truth"]


def test_packed_effects_give_the_same_frame_without_a_row_per_gene(spark, effects):
    from pertgrid.operators import retrieval

    _, _, m, t = effects
    m, t = m.where("model IS NOT NULL AND gene_id IS NOT NULL"), t.where("value <> 0 OR gene_id = 0")
    pack = lambda df, *keys: df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("gene_id", "value"))).alias("e")).select(*keys, F.col("e.gene_id").alias("genes"), F.col("e.value").alias("values"))
    source, strong = m.where("model = 'a'").select("target", "gene_id", "value"), t.where("abs(value) > 0.9")
    rows = lambda df: sorted(str({k: round(v, 9) if isinstance(v, float) else v for k, v in r.asDict().items()}) for r in df.collect())
    packed = (pack(m, "model", "target"), pack(t, "target"), pack(source, "target"), GENES, pack(strong, "target").select("target", "genes"), False, DEPTHS, 6)
    assert rows(panel.evaluation_frame(*packed)) == rows(panel.evaluation_frame(m, t, source, GENES, strong, False, DEPTHS, 6))
    marked = packed[1].withColumn("strong", F.col("genes"))
    plan = panel._met(packed[0], marked, False, DEPTHS)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "window" not in plan and plan.count("aggregate [") == 2  # those that packed the test's rows
