"""Closed-form, brute-force and edge cases of the core operators."""

import itertools
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from pertgrid.functions import scalar as S
from pertgrid.operators import audits, catalog, de, decoders, effects, latent, metrics, moments, pooling, ranks, resampling, selection, sets, signatures, transfer
from pertgrid.sources import readers, writers
from pertgrid.streaming import incremental

RAGGED = [([0, 2], [2.0, 1.0], "A", "A-1", 1), ([1, 2], [3.0, 4.0], "A", "A-2", 1), ([0, 3], [5.0, 1.0], "Non-Targeting", "NT-1", 1), ([2], [9.0], "B", "B-1", 0)]


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_ragged_pooling(spark):
    cells = spark.createDataFrame(RAGGED, "gene_token_id array<int>, gene_expression array<double>, gene_target string, guide_target string, pass_guide_filter int")
    got = rows(pooling.pool_ragged(cells, ["A", "B"], "Non-Targeting"), "gene_target", "gene_id", "count")
    assert got == [("A", 0, 2), ("A", 1, 3), ("A", 2, 5), ("Non-Targeting", 0, 5), ("Non-Targeting", 3, 1)]
    assert tuple(pooling.ragged_counters(cells, ["A", "B"], "Non-Targeting").first()) == (4, 3, 3, 1)
    with pytest.raises(Exception, match="differ in length"):
        readers.ragged_counts(spark.createDataFrame([(1, [1], [1.0, 2.0])], "k int, a array<int>, b array<double>"), "k", "a", "b").collect()


def test_levels_agree_and_duplicates_collapse(spark):
    cells = spark.createDataFrame([(0, 0, 1, "A", "g1", "one"), (0, 1, 2, "A", "g1", "one"), (1, 1, 1, "A", "g2", "two"), (1, 2, 3, "A", "g2", "two"), (2, 0, 2, "NTC", "n", "one")], "row_id int, gene_id int, count long, target string, guide string, batch string")
    levels = pooling.pool_levels(cells, {"target": ["target"], "guide": ["guide"], "target_batch": ["target", "batch"]})
    assert {t for _, t in rows(pooling.conservation(levels), "level", "total")} == {9}
    genes = spark.createDataFrame([(0, "A", 0), (1, "B", 1), (2, "A", 2)], "gene_id int, symbol string, pos int")
    counts = spark.createDataFrame([(0, 0, 2), (0, 1, 3), (0, 2, 5), (1, 0, 7), (1, 1, 11), (1, 2, 13)], "row_id int, gene_id int, count long")
    assert rows(pooling.collapse_symbols(counts, genes), "row_id", "pos", "symbol", "count") == [(0, 0, "A", 7), (0, 1, "B", 3), (1, 0, "A", 20), (1, 1, "B", 11)]


def test_pooling_is_invariant_to_partitions_and_empty_input(spark):
    cells = spark.createDataFrame([(k, k % 7, k % 5 + 1, f"t{k % 3}") for k in range(500)], "row_id int, gene_id int, count long, target string")
    assert rows(pooling.pool(cells, ["target"]), "target", "gene_id", "count", "n_rows") == rows(pooling.pool(cells.repartition(9), ["target"]), "target", "gene_id", "count", "n_rows")
    assert pooling.pool(cells.limit(0), ["target"]).collect() == []


def test_effects_against_control(spark):
    pools = spark.createDataFrame([(t, g, c) for t, v in {"x": [10, 10, 80], "y": [20, 20, 60], "ctrl": [10, 10, 80]}.items() for g, c in enumerate(v)], "target string, gene_id int, count long")
    got = {(r.target, r.gene_id): r.lfc for r in effects.pseudobulk_effects(pools, "ctrl").collect()}
    assert [got["x", g] for g in range(3)] == [0, 0, 0] and got["y", 0] == pytest.approx(1) and got["y", 2] < 0


def test_retrieval_fixtures(spark):
    def relation(m):
        return spark.createDataFrame([(i, j, float(v)) for i, r in enumerate(m) for j, v in enumerate(r)], "target int, gene_id int, value double")

    eye = np.eye(4)
    scores = lambda p: [r.score for r in metrics.retrieval(relation(p), relation(eye)).orderBy("target").collect()]
    assert scores(eye) == [1, 1, 1, 1] and scores(np.zeros((4, 4))) == [0.5] * 4
    assert scores(np.roll(eye, 1, axis=1)) == pytest.approx([1 / 3] * 4) and statistics.mean(scores(np.ones((4, 4)))) == 0.5


def test_signed_recovery_fixture(spark):
    pairs = spark.createDataFrame([("t", g, p, t) for g, (p, t) in enumerate(zip([9.0, -8.0, -7.0, 6.0, 1.0], [3.0, -2.5, 2.0, 0.1, 0.0]))], "target string, gene_id int, prediction double, truth double")
    r = metrics.signed_recovery(pairs, 3).first()
    assert r.recall == 1 and r.signed_recovery == pytest.approx(2 / 3)


def brute_u(x, y):
    return sum((a > b) + 0.5 * (a == b) for a in x for b in y)


def test_mann_whitney_with_implicit_zeros(spark):
    rng = random.Random(2)
    groups = {r: rng.choice(["a", "b", "ctrl"]) for r in range(60)}
    dense = {(r, g): rng.choice([0, 0, 0, 1, 2, 3]) for r in groups for g in range(5)}
    cells = spark.createDataFrame([(r, g, float(v), groups[r]) for (r, g), v in dense.items() if v], "row_id int, gene_id int, value double, grp string")
    obs = spark.createDataFrame(list(groups.items()), "row_id int, grp string")
    for row in de.mann_whitney(cells, obs, "grp", "ctrl").collect():
        x = [dense[r, row.gene_id] for r in groups if groups[r] == row.grp]
        y = [dense[r, row.gene_id] for r in groups if groups[r] == "ctrl"]
        both = x + y
        ties = sum(both.count(v) ** 3 - both.count(v) for v in set(both))
        n, m = len(x), len(y)
        sd = math.sqrt(n * m / 12 * (n + m + 1 - ties / ((n + m) * (n + m - 1))))
        u = brute_u(x, y)
        assert (row.u, row.tie_term, row.auc) == (u, ties, pytest.approx(u / (n * m)))
        assert row.z == pytest.approx(math.copysign(max(0, abs(u - n * m / 2) - 0.5) / sd, u - n * m / 2))


def test_normal_tail(spark):
    z = [0.0, 0.3, -1.0, 1.96, 4.0, 8.0, 20.0]
    got = [r.p for r in spark.createDataFrame([(x,) for x in z], "z double").select(S.normal_two_sided("z").alias("p")).collect()]
    assert got == [pytest.approx(math.erfc(abs(x) / math.sqrt(2)), rel=2e-7) for x in z]


def test_multiplicity_ignores_nulls(spark):
    p = [0.01, 0.04, 0.03, 0.005, None]
    df = spark.createDataFrame([("k", i, x) for i, x in enumerate(p)], "k string, i int, p double")
    bh = [r.p_adj for r in ranks.benjamini_hochberg(df, "p", ["k"], tie="i").orderBy("i").collect()]
    assert bh[:4] == pytest.approx([0.02, 0.04, 0.04, 0.02]) and bh[4] is None
    missing = spark.createDataFrame([("a", 1, 0.01), ("a", 2, 0.02), ("a", 3, None), ("a", 4, None)], "k string, i int, p double")
    assert [r.p_holm for r in ranks.holm(missing, "p", ["k"], tie="i").orderBy("i").collect()] == [0.02, 0.02, None, None]
    hm = [r.p_holm for r in ranks.holm(df.where("p is not null"), "p", ["k"], tie="i").orderBy("i").collect()]
    assert hm == pytest.approx([0.03, 0.06, 0.06, 0.02])


def test_guide_labels(spark):
    labels = {"CAST_P1-1|CAST_P1-2": ("CAST", "P1"), "ABCD1_P1P2-1|x": ("ABCD1", "P1P2"), "KDM2B_ENST00000377069.4-1|y": ("KDM2B", None), "non-targeting_1": ("Non-Targeting", None), "odd": (None, None)}
    got = spark.createDataFrame([(x,) for x in labels], "g string").select("g", S.guide_target("g").alias("t"), S.promoter_class("g").alias("p")).collect()
    assert {r.g: (r.t, r.p) for r in got} == labels


def test_splits_are_balanced_and_do_not_leak(spark):
    obs = spark.createDataFrame([(k, f"b{k % 3}") for k in range(100)], "row_id int, batch string")
    parts = resampling.round_robin(obs, ["batch"], "row_id")
    assert audits.unbalanced(parts, ["batch"], "part", 4).collect() == []
    assert rows(parts, "row_id", "part") == rows(resampling.round_robin(obs.repartition(5), ["batch"], "row_id"), "row_id", "part")
    items = spark.createDataFrame([(k,) for k in range(11)], "t int")
    assert all(r.t != r.other for r in resampling.derangement(items, "t").collect())
    fitted = lambda shift: {r.fold: r.fitted for r in transfer.cross_fitted(spark.createDataFrame([(k % 3, float(k + (shift if k % 3 == 0 else 0))) for k in range(12)], "fold int, v double"), "fold", "v").collect()}
    assert fitted(0)[0] == fitted(1000)[0] and fitted(0)[1] != fitted(1000)[1]


def test_sign_flip(spark):
    r = resampling.exact_sign_flip(spark.createDataFrame([("k", i, v) for i, v in enumerate([1.0, 2.0, 3.0])], "k string, i int, v double"), ["k"], "i", "v").first()
    assert r.p == pytest.approx(2 / 8)


def test_sign_flip_of_large_groups(spark, tmp_path):
    from pertgrid.plans import QUERIES

    cases = {"meet": (30, 9, 1.0), "count": (60, 22, 0.37), "walk": (42, 15, math.pi), "ties": (48, 24, 1.5)}
    data = [(k, i, -v if i < minus else v) for k, (n, minus, v) in cases.items() for i in range(n)]
    got = {r.k: r for r in resampling.exact_sign_flip(spark.createDataFrame(data, "k string, i int, v double"), ["k"], "i", "v").collect()}
    for k, (n, minus, _) in cases.items():
        far = sum(math.comb(n, x) for x in range(n + 1) if abs(n - 2 * x) >= abs(n - 2 * minus))
        assert got[k].n == n and got[k].p == pytest.approx(far / 2**n, rel=1e-9)
    rng = random.Random(3)
    cents = np.array([rng.randrange(-4000, 6000) / 100 for _ in range(36)])
    assert resampling._flip_by_counts(np.abs(np.rint(cents * 100)).astype(int), abs(round(cents.sum() * 100))) == pytest.approx(resampling.sign_flip_p(cents), rel=1e-9)
    spark.createDataFrame([(i, i % 2, 4000.0 + rng.randrange(-99, 999) / 100) for i in range(90)], "s_suppkey long, s_nationkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    assert [(r.n, r.p is None) for r in QUERIES["exact_sign_flip"](spark, str(tmp_path)).collect()] == [(45, False)] * 2


def test_sign_flip_query_equals_all_sign_vectors(spark, tmp_path):
    from pertgrid.plans import QUERIES

    rng = random.Random(8)
    rows = [(i, i % 3, 4000.0 + rng.randrange(-300, 500) / 100) for i in range(34)] + [(100, 7, 4001.5), (101, 8, 4000.0)]
    spark.createDataFrame(rows, "s_suppkey long, s_nationkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    want = {}
    for k in {k for _, k, _ in rows}:
        v = [round(100 * (a - 4000)) for _, n, a in rows if n == k]
        sums = [sum(s * x for s, x in zip(signs, v)) for signs in itertools.product((1, -1), repeat=len(v))]
        want[k] = (len(v), round(sum(abs(s) >= abs(sum(v)) for s in sums) / len(sums), 6))
    assert {r.k: (r.n, r.p) for r in QUERIES["exact_sign_flip"](spark, str(tmp_path)).collect()} == want


@pytest.mark.parametrize("rounding", [decoders.largest_remainder, decoders.systematic_rounding])
def test_roundings_keep_totals(spark, rounding):
    rng = random.Random(4)
    e = spark.createDataFrame([(k % 4, k, rng.random() * 3) for k in range(200)], "key int, item int, expected double")
    out = rounding(e, ["key"], "item")
    assert all(abs(r.rounded - r.expected) < 1 for r in out.collect())
    for r in out.groupBy("key").agg(F.sum("rounded").alias("a"), F.sum("expected").alias("b")).collect():
        assert abs(r.a - r.b) <= 1


def test_draws_repeat_and_have_their_totals(spark):
    e = spark.createDataFrame([(k % 3, k, float(k % 5 + 1), 100) for k in range(60)], "key int, item int, expected double, total int")
    one = decoders.multinomial_draw(e, "key", "item", "expected", "total")
    assert rows(one, "key", "item", "drawn") == rows(decoders.multinomial_draw(e.repartition(7), "key", "item", "expected", "total"), "key", "item", "drawn")
    assert {r["sum(drawn)"] for r in one.groupBy("key").sum("drawn").collect()} == {100}
    mean = decoders.poisson_draw(spark.range(4000).select("id", F.lit(3.0).alias("m")), ["id"], "m").agg(F.avg("drawn")).first()[0]
    assert abs(mean - 3) < 0.2
    nb = decoders.negative_binomial_draw(spark.range(4000).select("id", F.lit(3.0).alias("m"), F.lit(2.0).alias("t")), ["id"], "m", "t").agg(F.avg("drawn"), F.var_samp("drawn")).first()
    assert abs(nb[0] - 3) < 0.3 and 5 < nb[1] < 10
    same = decoders.nb_quantile_map(spark.createDataFrame([(k, k, 4.0) for k in range(12)], "id int, c int, mu double"), ["id"], "c", "mu", "mu", 3.0)
    assert all(r.mapped == r.c for r in same.collect())


def test_scattered_counts_arrive(spark):
    cells = spark.createDataFrame([("t", k, float(k % 4)) for k in range(40)], "target string, row_id int, depth double")
    extra = spark.createDataFrame([("t", 1, 30), ("t", 2, 7), ("t", 3, 0)], "target string, gene_id int, extra int")
    got = decoders.scatter_increases(extra, cells).groupBy("gene_id").agg(F.sum("added").alias("n")).collect()
    assert {r.gene_id: r.n for r in got} == {1: 30, 2: 7}


def test_tangent_is_the_derivative(spark):
    cells = spark.createDataFrame([(0, g, c) for g, c in enumerate([5, 3, 2, 9])], "row_id int, gene_id int, count long")
    d = spark.createDataFrame([(0, 0.5), (1, -1.0), (2, 0.2)], "gene_id int, value double")
    value = lambda a: {r.gene_id: r.expected for r in decoders.log_rate(cells, d, a).collect()}
    up, down = value(1e-5), value(-1e-5)
    for r in decoders.tangent(cells, d).collect():
        assert r.tangent == pytest.approx((up[r.gene_id] - down[r.gene_id]) / 2e-5, abs=1e-6)
    assert up[3] == 9 and sum(up.values()) == pytest.approx(19)


def test_linear_algebra_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 6)) @ np.diag([5, 3, 1, 1, 1, 1])
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "id int, v array<double>").repartition(4)
    values, directions = moments.gram_eigen(df, "id", "v", 2)
    want = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1][:2]
    assert values == pytest.approx(want) and directions.shape == (6, 2)
    g, r = [[4.0, 1.0], [1.0, 3.0]], [1.0, -2.0]
    assert transfer.nonnegative_weights(g, r) == pytest.approx([0.25, 0]) and transfer.ridge(g, r, [1, 1]) == pytest.approx(np.linalg.solve([[5, 1], [1, 4]], r))
    w = signatures.matching_pursuit(np.diag([1.0, 2.0, 3.0]), np.array([5.0, 0.1, 6.0]), 2)
    assert list(np.nonzero(w)[0]) == [0, 2]
    assert signatures.lasso_path(np.eye(2), np.array([3.0, 0.5]), [1.0])[0] == pytest.approx([2.0, 0.0])
    weights = moments.normal_mixture(rng.normal(0, 2, 500), np.full(500, 0.1), np.array([0.01, 2.0]))
    assert weights[1] > 0.9


def test_leave_one_out_median_matches_brute_force(spark):
    rng = random.Random(1)
    vals = [(g, t, rng.random()) for g in range(4) for t in range(rng.choice([1, 2, 5, 8]))]
    got = {(r.gene_id, r.target): r.others_median for r in effects.leave_one_out_median(spark.createDataFrame(vals, "gene_id int, target int, value double"), "gene_id", "target", "value").collect()}
    for g, t, _ in vals:
        rest = [v for g2, t2, v in vals if g2 == g and t2 != t]
        assert got[g, t] == (pytest.approx(statistics.median(rest)) if rest else None)


def test_neighbours_match_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 8))
    df = spark.createDataFrame([(k, k % 2, [float(v) for v in r]) for k, r in enumerate(x)], "id long, batch int, v array<double>")
    got = {}
    for r in signatures.nearest(df.where("id % 10 = 0"), df, "id", "v", 4, keys=("batch",), block=16).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["neighbour"]))
    for q in range(0, 120, 10):
        others = [k for k in range(120) if k != q and k % 2 == q % 2]
        want = sorted(others, key=lambda k: np.linalg.norm(x[k] - x[q]))[:4]
        assert [n for _, n in sorted(got[q])] == want


def test_mixture_and_families(spark):
    rng = random.Random(3)
    rows_ = [("g", k, rng.gauss(0 if k % 2 else 6, 1)) for k in range(400)]
    post = {r.item: r.posterior for r in signatures.mixture_posteriors(spark.createDataFrame(rows_, "grp string, item int, s double"), "grp", "item", "s").collect()}
    assert sum((post[k] > 0.5) == (k % 2 == 0) for _, k, _ in rows_) > 395
    assert signatures.complete_linkage([("a", "b", 0.9), ("b", "c", 0.8), ("a", "c", 0.1), ("c", "d", 0.7)], list("abcd"), 0.5) == {"a": 0, "b": 0, "c": 1, "d": 1}


def test_sets_and_joins(spark):
    a = spark.createDataFrame([("k", 1), ("k", 2)], "key string, m int")
    b = spark.createDataFrame([("k", 2), ("k", 3)], "key string, m int")
    r = sets.compare_sets(a, b, ["key"], "m").first()
    assert (r.shared, r.gained, r.lost, r.jaccard) == (1, 1, 1, pytest.approx(1 / 3))
    with pytest.raises(sets.CardinalityError):
        sets.checked_join(a, b, ["key"])
    assert sets.multiset_difference(a.unionByName(a), a).count() == 2


def test_near_intervals_match_brute_force(spark):
    rng = random.Random(6)
    g = [(k, rng.choice("XY"), s, s + rng.randrange(1, 400)) for k in range(150) for s in [rng.randrange(0, 5000)]]
    df = spark.createDataFrame(g, "gene_id int, chr string, start int, end int")
    got = rows(sets.near_intervals(df, df.where("gene_id % 9 = 0").withColumnRenamed("gene_id", "target"), 120), "target", "gene_id", "gap")
    want = sorted((t[0], x[0], gap) for t in g if t[0] % 9 == 0 for x in g if x[1] == t[1] for gap in [max(0, x[2] - t[3], t[2] - x[3])] if gap <= 120)
    assert got == want


def test_catalog_invariants(spark):
    obs = spark.createDataFrame([(g, c, "s", 10 * g) for g in range(8) for c in ("a", "b", "c") if (g + ord(c)) % 3], "gene int, context string, study string, n_cells int")
    overlaps = catalog.overlap_counts(obs)
    assert {r.n for r in catalog.violations(obs, overlaps).collect()} == {0}
    broken = catalog.violations(obs.unionByName(obs.limit(1)), overlaps.where("a <> 'a' or b <> 'b'")).collect()
    assert {r.check: r.n > 0 for r in broken} == {"duplicate_key": True, "asymmetric_overlap": True, "wrong_diagonal": False}


def test_audits_find_corruption(spark):
    cells = spark.createDataFrame([(1, 0, 3), (1, 1, 4), (2, 0, 5)], "row_id int, gene_id int, count long")
    obs = spark.createDataFrame([(1, 7), (2, 6), (3, 0)], "row_id int, n int")
    assert rows(audits.total_mismatch(cells, obs, "n"), "row_id") == [(2,)]
    with pytest.raises(audits.AuditError):
        audits.require_empty(audits.not_counts(spark.createDataFrame([(1.5,)], "v double"), "v"), "counts")
    a, b = audits.table_digest(cells).first(), audits.table_digest(cells.repartition(3)).first()
    assert a == b != audits.table_digest(cells.withColumn("count", F.col("count") + 1)).first()


def test_text_readers(spark, tmp_path):
    (tmp_path / "targets.txt").write_text(" abc # note\n#x\n\nDEF\n")
    assert rows(readers.target_list(spark, str(tmp_path / "targets.txt")), "target") == [("ABC",), ("DEF",)]
    (tmp_path / "sets.gmt").write_text("s1\tdesc\tA\tB\ns2\tdesc\n")
    assert rows(readers.gmt(spark, str(tmp_path / "sets.gmt")), "set", "gene") == [("s1", "A"), ("s1", "B")]
    (tmp_path / "x.bed").write_text("#c\nchr1\t0\t10\tn\nchr1\t9\t5\nchr2\tx\t3\n")
    assert tuple(readers.interval_audit(readers.intervals(spark, str(tmp_path / "x.bed"))).first()) == (3, 3, 4, 2)
    (tmp_path / "t.csv").write_text("a,b\n1,x\n")
    assert rows(readers.csv(spark, str(tmp_path / "t.csv"), "a int, b string"), "a", "b") == [(1, "x")]
    d = readers.file_digests(spark, str(tmp_path), "*.csv").first()
    assert d["size"] == 8 and len(d.sha256) == 64
    manifest = spark.createDataFrame([(d.path, d["size"], d.sha256), ("gone", 1, "x")], "path string, size long, sha256 string")
    assert rows(audits.manifest_mismatch(readers.file_digests(spark, str(tmp_path), "*.csv"), manifest), "path") == [("gone",)]
    with pytest.raises(readers.BudgetError):
        readers.within_budget(readers.shards(spark, str(tmp_path), "t", ".csv"), 3)


def test_inheritance():
    assert readers.inherited({"a": {"x": 1, "y": 2}, "b": {"inherit": "a", "y": 3}})["b"] == {"x": 1, "y": 3}
    with pytest.raises(ValueError, match="cycle"):
        readers.inherited({"a": {"inherit": "b"}, "b": {"inherit": "a"}})


def test_runs_and_sparse_rows(spark):
    ids = spark.createDataFrame([(x,) for x in (1, 2, 5, 9, 10)], "x long")
    assert rows(readers.contiguous_runs(ids, "x"), "first", "last") == [(1, 3), (5, 6), (9, 11)]
    ptr = spark.createDataFrame([(0, 0, 2), (1, 2, 2), (2, 2, 3)], "row_id int, first long, last long")
    entries = spark.createDataFrame([(0, 4, 1), (1, 5, 2), (2, 6, 3)], "pos long, gene_id int, count int")
    assert rows(readers.csr_rows(ptr, entries), "row_id", "gene_id", "count") == [(0, 4, 1), (0, 5, 2), (2, 6, 3)]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(f"t{k % 2}", k, k % 3) for k in range(20)], "target string, row_id int, count long")
    assert writers.verified(df, str(tmp_path / "v"))["rows"] == 20
    writers.partitioned(df, str(tmp_path / "p"), ["target"])
    writers.replace_partitions(df.where("target = 't0'").withColumn("count", F.lit(9).cast("long")), str(tmp_path / "p"), ["target"])
    back = spark.read.parquet(str(tmp_path / "p"))
    assert back.count() == 20 and back.where("target = 't0' and count <> 9").count() == 0
    with pytest.raises(Exception, match="(?i)exist"):
        writers.partitioned(df, str(tmp_path / "p"), ["target"])
    with pytest.raises(ValueError):
        writers.prediction(df, str(tmp_path / "q"), 9)
    writers.prediction(df, str(tmp_path / "q"), 10)
    assert spark.read.parquet(str(tmp_path / "q")).where("count = 0").count() == 0
    assert '"rows": 20' in writers.manifest(df, {"a": 1}, {})


def test_incremental_pooling(spark, tmp_path):
    schema = "target string, gene_id int, count long"
    for k in range(3):
        spark.createDataFrame([("a", 1, k + 1), ("b", 2, 10)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = incremental.shard_stream(spark, str(tmp_path / "in"), schema, 1)
    incremental.run_available(stream, str(tmp_path / "out"), str(tmp_path / "ck"), ["target"])
    spark.createDataFrame([("a", 1, 100)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    incremental.run_available(incremental.shard_stream(spark, str(tmp_path / "in"), schema, 1), str(tmp_path / "out"), str(tmp_path / "ck"), ["target"])
    total = pooling.merge_shards(spark.read.parquet(str(tmp_path / "out")).drop("batch"), keys=["target"])
    assert rows(total, "target", "gene_id", "count") == [("a", 1, 106), ("b", 2, 30)]


def test_latent_model_recovers_a_covariance(spark):
    rng = np.random.default_rng(0)
    p, n = 12, 400
    w = np.zeros((p, 1))
    w[:4, 0], w[4:8, 0] = 0.8, -0.8
    rate = 600 / p * np.exp(rng.normal(size=(n, 1)) @ w.T)
    y = rng.poisson(rate)
    cells = spark.createDataFrame([(i, j, int(y[i, j])) for i in range(n) for j in range(p) if y[i, j]], "row_id int, gene_id int, count long")
    v = latent.cell_vectors(cells).repartition(3).persist()
    saved = []
    mu, got, trace = latent.fit(v, p, 1, rounds=8, on_round=lambda k, m, x, value: saved.append((m, x)))
    assert trace[-1] > trace[0] and len(saved) == len(trace)
    assert abs(np.corrcoef((got @ got.T).ravel(), (w @ w.T).ravel())[0, 1]) > 0.9
    again = latent.fit(v, p, 1, rounds=1, resume=saved[-1])[2][0]
    assert again == pytest.approx(trace[-1])
    assert latent.cell_scores(v, mu, got).count() == n
    v.unpersist()


def test_latent_helpers():
    rng = np.random.default_rng(1)
    w1, w2, d1, d2 = rng.normal(size=(7, 2)), rng.normal(size=(7, 3)), rng.random(7), rng.random(7)
    dense = np.linalg.norm(w1 @ w1.T + np.diag(d1) - w2 @ w2.T - np.diag(d2)) ** 2
    assert latent.covariance_distance(w1, d1, w2, d2) == pytest.approx(dense)
    columns = latent.response_columns(w1, [2])
    assert columns[2, 0] == -1 and columns[0, 0] == pytest.approx(-(w1[0] @ w1[2]) / (w1[2] @ w1[2]))
    assert latent.permuted_loadings_p(lambda x: float(((x - w1) ** 2).sum()), w1, 19) == pytest.approx(1 / 20)


def test_shifted_counts_of_absent_genes(spark):
    cells = spark.createDataFrame([(1, 0, 6), (1, 1, 4), (2, 0, 1000)], "row_id long, gene_id long, count long")
    delta = spark.createDataFrame([(0, -700000.0), (2, 300000.0), (3, 40000.0), (1, 0.0)], "gene_id long, value double")
    got = {(r.row_id, r.gene_id): r["count"] for r in decoders.shifted_counts(cells, delta, 100.0).collect()}
    assert got == {(1, 1): 4, (1, 2): 3, (2, 0): 30, (2, 2): 30, (2, 3): 4}


def test_selection_edges(spark):
    rows = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b")], "i int, c string")
    assert {(r.i, r.code) for r in selection.remapped(rows, "c").collect()} == {(1, 1), (2, None), (3, 0), (4, 1)}
    values = spark.createDataFrame([("k", float("nan")), ("k", float("inf")), ("k", 1.0), ("k", 3.0), ("k", None)], "k string, v double")
    assert tuple(selection.quantile_vector(values, "v", ["k"]).first())[1:] == pytest.approx((1.0, 1.2, 1.5, 2.0, 2.5, 2.8, 3.0))
    assert {(r.bin, r.n) for r in selection.log_histogram(spark.createDataFrame([(0.0,), (-1.0,), (1e-9,), (10.0,), (1e9,)], "v double"), "v", 0.0, 2.0).collect()} == {(0, 1), (50, 1), (99, 1)}
    pairs = spark.createDataFrame([("t", 1.0, 2.0), ("t", -2.0, -4.0), ("u", 0.0, 1.0)], "g string, prediction double, truth double")
    assert {tuple(r) for r in selection.absolute_scale(pairs, "g").collect()} == {("t", 2.0)} and selection.absolute_scale(pairs, "g", least=3).isEmpty()
    found = selection.inventory(spark.createDataFrame([(1, "x"), (1, "y"), (2, None)], "id int, ref string"), "id", {"ref": spark.createDataFrame([("x",)], "r string")})
    assert {tuple(r) for r in found.collect()} == {("repeated id", 1), ("unresolved ref", 1)}
    assert [r.s for r in spark.createDataFrame([(1.5,), (None,)], "v double").select(selection.markdown_float(F.col("v")).alias("s")).collect()] == ["1.500", "-"]
