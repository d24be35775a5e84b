"""Steps whose work, memory or results must not turn with the size of the input."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pertgrid.operators import ranks, resampling


def plan(df):
    return df._jdf.queryExecution().toString().lower()


def test_benjamini_hochberg_walks_each_key_once(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), int(i), float(p)) for k in range(3) for i, p in enumerate(np.round(rng.uniform(size=40) ** 3, 2))] + [(1, 99, None)]
    found = ranks.benjamini_hochberg(spark.createDataFrame(rows, "k int, i int, p double"), "p", ["k"], tie="i")
    assert "currentrow$(), unboundedfollowing" not in plan(found)
    got = {(r.k, r.i): r.p_adj for r in found.collect()}
    assert got.pop((1, 99)) is None
    for k in range(3):
        own = sorted((p, i) for key, i, p in rows if key == k and p is not None)
        scaled = [p * len(own) / (n + 1) for n, (p, _) in enumerate(own)]
        assert [got[k, i] for _, i in own] == pytest.approx([min(1.0, min(scaled[n:])) for n in range(len(own))])


def test_bootstrap_draws_are_never_broadcast(spark):
    items = spark.range(50).select("id", (F.col("id") * 1.5).alias("v"), F.lit(2.0).alias("w"))
    for ci in (resampling.bootstrap_mean_ci(items, "id", "v", 40), resampling.bootstrap_ratio_ci(items, "id", "v", "w", 40)):
        below = plan(ci).split("== physical plan ==")[1]
        assert "shuffledhashjoin" in below and "broadcasthashjoin" not in below


def test_roles_are_of_every_year_that_the_first_sql_had(spark, tmp_path):
    from pertgrid.plans import QUERIES

    rows = [(k, k, "5-LOW", f"{year}-06-01 00:00:00") for k, year in enumerate((1992, 1993, 1995, 1996))]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderpriority string, o_orderdate string")
    orders.withColumn("o_orderdate", F.to_timestamp("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    assert sorted(r.row_id for r in QUERIES["rows_with_roles"](spark, str(tmp_path)).collect()) == [1, 2, 3]


def test_sign_flips_are_counted_once_and_dealt_over_tasks(spark):
    rows = [(k, i, float((7 * i + k) % 5) + 0.25) for k in range(12) for i in range(6)]
    found = resampling.exact_sign_flip(spark.createDataFrame(rows, "k int, i int, v double"), ["k"], "i", "v")
    assert {r.k: r.p for r in found.collect()} == {k: pytest.approx(resampling.sign_flip_p([v for key, _, v in rows if key == k])) for k in range(12)}
    assert "repartition_by_num" in plan(found) and "inmemorytablescan" in plan(found)


def sorts(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Sort [")


def test_corrections_sort_a_key_once(spark):
    rows = [(k % 3, k, None if k % 7 == 0 else (k % 5) / 10) for k in range(60)]
    df = spark.createDataFrame(rows, "k int, i int, p double")
    for correct in (ranks.benjamini_hochberg, ranks.holm):
        assert sorts(correct(df, "p", ["k"], tie="i")) == 1


def test_axis_difference_is_one_aggregate(spark):
    from pertgrid.sources import readers

    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (3, "y")], "i int, s string")
    b = spark.createDataFrame([(2, None), (3, "z"), (4, None), (4, None)], "i int, s string")
    found = readers.axis_difference(a, b, ["i", "s"])
    assert sorted(map(str, map(tuple, found.collect()))) == ["(1, 'x')", "(3, 'y')", "(3, 'z')", "(4, None)"]
    assert plan(found).split("== physical plan ==")[1].split("== initial plan ==")[0].count("exchange ") == 1


def test_mixture_rows_are_not_dealt_by_group(spark):
    from pertgrid.operators import signatures

    rows = [("ab"[i % 2], i, float((i * 37 % 101) + 100 * (i % 3 == 0))) for i in range(600)]
    found = signatures.mixture_posteriors(spark.createDataFrame(rows, "g string, i int, v double"), "g", "i", "v")
    assert found.count() == 600 and "sortmergejoin" not in plan(found) and plan(found).split("== physical plan ==")[1].count("rightouter") == 0
    assert plan(found.hint("merge")).count("broadcasthashjoin") >= 2


def test_halves_are_dealt_in_parts(spark):
    from pertgrid.functions.scalar import hash_order
    from pertgrid.operators import de

    obs = spark.range(60).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("string")).alias("target"))
    hashes = {r.row_id: r.h for r in obs.select("row_id", hash_order("row_id", seed=4).alias("h")).collect()}
    for keys, of in ((["target"], lambda k: k % 3), ([], lambda k: 0)):
        found = resampling.halves(obs, keys, "row_id", 4)
        assert found.columns == ["row_id", "target", "half"] and "windowspecdefinition(_h" not in plan(found)
        got = {r.row_id: r.half for r in found.collect()}
        for stratum in {of(k) for k in hashes}:
            own = sorted((k for k in hashes if of(k) == stratum), key=hashes.get)
            assert [got[k] for k in own] == [(n + 1) % 2 for n in range(len(own))]
    cells = obs.withColumn("gene_id", F.lit(1)).withColumn("count", F.lit(2))
    halves = de.paired_halves(cells, obs, "target", 1, 4)
    assert "_part" in plan(halves) and {r.target: round(r.half_0 / r.whole, 6) for r in halves.collect()} == {"1": 0.5, "2": 0.5, None: 0.5}


def test_shifted_cells_are_not_joined_gene_by_gene(spark):
    """The dense axis is made row by row: nothing that has a row per cell and gene is sorted, joined or shuffled."""
    from pertgrid.operators import decoders

    cells = spark.createDataFrame([(1, 1, 5), (1, 2, 3), (1, 9, 4), (2, 2, 7)], "row_id long, gene_id long, count long")
    effects = spark.createDataFrame([(1, 0.5), (2, -0.2), (3, 1.0)], "gene_id long, value double")
    got = decoders.shift_and_renormalise(cells, effects)
    above = got._jdf.queryExecution().executedPlan().toString().split("BroadcastNestedLoopJoin")[0]
    assert not any(step in above for step in ("SortMergeJoin", "Window", "Exchange"))
    raw = {(c, g): max(np.expm1(np.log1p(n * 1e4 / t) + d), 0.0) for c, t, of in ((1, 12, {1: 5, 2: 3}), (2, 7, {2: 7})) for g, d in ((1, 0.5), (2, -0.2), (3, 1.0)) for n in (of.get(g, 0),)}
    want = {(c, g): t * x / sum(y for (e, _), y in raw.items() if e == c) for (c, g), x in raw.items() for t in ((12, 7)[c - 1],)}
    assert {(r.row_id, r.gene_id): pytest.approx(r.expected) for r in got.collect()} == want


def test_multinomial_draws_use_one_generator_a_key(spark):
    from pertgrid.operators import decoders

    e = spark.createDataFrame([(k, i, float(i % 5), 300) for k in range(3) for i in range(50)], "k long, i long, v double, t long").coalesce(1)
    drawn = decoders.multinomial_draw(e, "k", "i", "v", "t")
    whole = {(r.k, r.i): r.drawn for r in drawn.collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert {(r.k, r.i): r.drawn for r in drawn.collect()} == whole  # a batch's end changes no draw
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [sum(n for (k, _), n in whole.items() if k == o) for o in range(3)] == [300] * 3 and all(whole[k, 5 * j] == 0 for k in range(3) for j in range(10))
    assert re.search(r"xxhash64\(0, k#\d+l?, 42\)", plan(drawn))  # a key's seed
    assert "currentrow$(), unboundedfollowing" not in plan(drawn)


def test_cosine_pairs_meet_in_blocks(spark):
    from pertgrid.operators import signatures

    rng = np.random.default_rng(8)
    v = {k: [float(x) for x in rng.normal(size=3)] for k in range(30)}
    v[4], v[5] = None, [0.0, 0.0, 0.0]
    rows = spark.createDataFrame([(k, x, None if k == 7 else k % 2) for k, x in v.items()], "id long, v array<float>, label int")
    made = signatures.cosine_pairs(rows, "id", "v", "label", block=4)
    assert "applyinpandas" in plan(made).replace("flatmapgroupsinpandas", "applyinpandas") and "mergejoin" not in plan(made).split("flatmapgroupsinpandas")[0]
    got = {(r.i, r.j): r.cosine for r in made.collect()}
    assert set(got) == {(i, j) for i in v for j in v if i < j and i % 2 == j % 2 and 7 not in (i, j)}
    for (i, j), x in got.items():
        a, b = v[i], v[j]
        assert x is None if 4 in (i, j) or 5 in (i, j) else x == pytest.approx(np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b)), abs=1e-6)


def test_levels_share_one_shuffle_whose_parts_grow(spark):
    from pertgrid.operators import pooling
    from pertgrid.plans import registry

    assert registry.parts(spark, 1000) == 3 and registry.parts(spark, 100 * registry.PART_ROWS) == 100
    cells = spark.createDataFrame([(1, "a", 5, 2), (2, "a", 5, 3), (2, "b", 6, 4)], "row_id long, target string, gene_id long, count long")
    dealt = registry.spread(cells, 10 * registry.PART_ROWS, "gene_id")
    levels = pooling.pool_levels(dealt, {"target": ["target"], "all": []})
    physical = levels._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in physical and physical.count("Exchange hashpartitioning") == physical.count("Exchange hashpartitioning(gene_id") == 2  # the second one is that of the first
    assert {(r.level, r.target, r.gene_id, r["count"]) for r in levels.collect()} == {("target", "a", 5, 5), ("target", "b", 6, 4), ("all", None, 5, 5), ("all", None, 6, 4)}
