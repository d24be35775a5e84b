"""Enrichment with its null against full running sums."""

import numpy as np

from pertgrid.operators import gsea


def running(order, score, members):
    """The extreme of the whole running sum, gene by gene."""
    hit = np.array([g in members for g in order])
    w = np.abs(score) * hit
    w = w / w.sum() if w.sum() else hit / hit.sum()
    path = np.cumsum(w - ~hit / max(1, (~hit).sum()))
    top, low = max(0, path.max()), min(0, path.min())
    return top if top >= -low - 1e-12 else low


def test_scores_null_and_fdr_equal_whole_running_sums(spark):
    rng = np.random.default_rng(8)
    genes, sets, perms = rng.permutation(60) * 3 + 1, {f"s{k}": set((rng.choice(60, m, replace=False) * 3 + 1).tolist()) for k, m in enumerate([3, 5, 8, 20, 30, 2, 60])}, 25
    rank = {"a": rng.normal(size=60), "b": np.round(rng.normal(size=60)), "c": np.zeros(60)}
    rows = [(t, int(g), float(v)) for t, s in rank.items() for g, v in zip(genes, s)] + [("a", 999, None)]
    rankings = spark.createDataFrame(rows, "ranking string, gene_id long, score double")
    lib = spark.createDataFrame([(k, g) for k, v in sets.items() for g in v] + [("s1", 5000), ("s0", next(iter(sets["s0"])))], "set string, gene_id long")
    out = {(r.ranking, r.set): r for r in gsea.preranked(rankings, lib, perms, 7, min_size=3, max_size=30).collect()}
    raw = {(r.ranking, r.set): r for r in gsea.null_scores(rankings, lib, perms, 7, min_size=3, max_size=30).collect()}
    assert set(out) == set(raw) == {(t, s) for t in rank for s in ("s0", "s1", "s2", "s3", "s4")}
    for t, score in rank.items():
        order = np.lexsort((genes, -score))
        by_place, ranked = score[order], genes[order]
        nes, null = {}, []
        for s in ("s0", "s1", "s2", "s3", "s4"):
            es = running(ranked, by_place, sets[s])
            own = []
            for p in range(perms):
                axis = np.sort(genes)
                place = gsea.permuted_places(axis, p, 7)
                assert sorted(place.tolist()) == list(range(60))
                moved = np.empty(60, int)
                moved[place] = axis
                own.append(running(moved, by_place, sets[s]))
            own = np.array(own)
            r = out[t, s]
            assert np.isclose(r.es, es) and r.size == len(sets[s]) and np.allclose(raw[t, s].null, own)
            same = own[(own >= 0) == (es >= 0)]
            nes[s] = es / abs(same.mean())
            assert np.isclose(r.nes, nes[s]) and np.isclose(r.p_value, (same >= es - 1e-12).mean() if es >= 0 else (same <= es + 1e-12).mean())
            pos, neg = own[own >= 0], own[own < 0]
            null += [*(pos / pos.mean() if len(pos) else []), *(-neg / neg.mean() if len(neg) else [])]
        null, seen = np.array(null), np.array(list(nes.values()))
        for s, x in nes.items():
            n, o = (null[null >= 0], seen[seen >= 0]) if x >= 0 else (-null[null < 0], -seen[seen < 0])
            assert np.isclose(out[t, s].fdr, min(1, (n >= abs(x) - 1e-12).mean() / (o >= abs(x) - 1e-12).mean()), atol=1e-9)


def test_blocks_leave_no_trace_and_empty_inputs(spark, monkeypatch):
    rankings = spark.createDataFrame([("a", g, float(g % 7) - 3) for g in range(40)], "ranking string, gene_id long, score double")
    lib = spark.createDataFrame([(k, g) for k in range(6) for g in range(k, 40, k + 2)], "set int, gene_id long")
    whole = sorted(map(tuple, gsea.preranked(rankings, lib, 20, min_size=2).collect()))
    monkeypatch.setattr(gsea, "BLOCK_MEMBERS", 7)
    assert np.allclose(np.array(sorted(tuple(r)[1:] for r in gsea.preranked(rankings, lib, 20, min_size=2).collect()), float), np.array([r[1:] for r in whole], float))
    assert gsea.preranked(rankings.where("1 = 0"), lib, 5).collect() == [] and gsea.preranked(rankings, lib.where("1 = 0"), 5).collect() == []
    assert gsea.preranked(rankings, lib, 5, min_size=100).collect() == []


def test_a_ranking_meets_only_the_sets_of_its_genes(spark):
    rankings = spark.createDataFrame([("a", g, float(g)) for g in range(6)], "ranking string, gene_id long, score double")
    lib = spark.range(3000).selectExpr("concat('s', id % 3) AS set", "id AS gene_id")
    out = gsea.null_scores(rankings, lib, 2, min_size=1)
    plan = out._jdf.queryExecution().toString()
    assert "sets" in plan and "explode" not in plan  # no ranking is copied for blocks of all sets
    assert sorted((r.set, r.size) for r in out.collect()) == [("s0", 2), ("s1", 2), ("s2", 2)]
