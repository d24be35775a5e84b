"""Queries: effects, differential expression, resampling, signatures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import ERFC_FIT
from ..operators import de, effects, pooling, resampling, sets, signatures
from . import registry as R
from .registry import CONTROL, query, r, sql

_T = "(1 / (1 + 0.5 * abs(z) / 1.4142135623730951))"
_FIT = f"{ERFC_FIT[0]}::DOUBLE"
for _c in ERFC_FIT[1:]:
    _FIT = f"({_c}::DOUBLE + {_T} * {_FIT})"
P_VALUE = f"{_T} * exp(-z * z / 2 + {_FIT})"


def _mod(spark, d):
    """Cells on the module axis, and their obs."""
    o = R.obs(spark, d).select("row_id", "target", "guide", "batch")
    return R.modules(spark, d).join(o, "row_id"), o


#: Every target's and the controls' cells on the dense gene axis.
_DENSE = dict(
    cellsum="SELECT row_id, sum(count) AS total FROM modules GROUP BY row_id",
    dense="SELECT o.row_id, o.target, g.gene_id, coalesce(m.count, 0) / (coalesce(s.total, 1) / 1e6) AS v FROM obs o CROSS JOIN (SELECT DISTINCT gene_id FROM modules) g LEFT JOIN cellsum s ON s.row_id = o.row_id LEFT JOIN modules m ON m.row_id = o.row_id AND m.gene_id = g.gene_id",
    means=f"SELECT t.target, t.gene_id, t.m AS target_mean, c.m AS control_mean, t.n AS n_target, c.n AS n_control, t.p AS pct_target, c.p AS pct_control FROM (SELECT target, gene_id, avg(v) AS m, count(*) AS n, avg(CASE WHEN v > 0 THEN 1.0::DOUBLE ELSE 0 END) AS p FROM dense GROUP BY ALL) t JOIN (SELECT gene_id, avg(v) AS m, count(*) AS n, avg(CASE WHEN v > 0 THEN 1.0::DOUBLE ELSE 0 END) AS p FROM dense WHERE target = '{CONTROL}' GROUP BY ALL) c USING (gene_id) WHERE t.target <> '{CONTROL}'",
    sides=f"SELECT d.target AS grp, d.gene_id, d.v, true AS own FROM dense d WHERE target <> '{CONTROL}' UNION ALL SELECT t.target, d.gene_id, d.v, false FROM dense d, (SELECT DISTINCT target FROM obs WHERE target <> '{CONTROL}') t WHERE d.target = '{CONTROL}'",
    ranked="SELECT grp, gene_id, v, own, rank() OVER (PARTITION BY grp, gene_id ORDER BY v) + (count(*) OVER (PARTITION BY grp, gene_id, v) - 1) / 2.0::DOUBLE AS rk FROM sides",
    ties="SELECT grp, gene_id, sum(c * c * c - c) AS tie FROM (SELECT grp, gene_id, v, count(*)::DOUBLE AS c FROM sides GROUP BY ALL) GROUP BY ALL",
    mwu="SELECT grp AS target, gene_id, sum(rk) FILTER (own) - (count(*) FILTER (own))::DOUBLE * ((count(*) FILTER (own)) + 1) / 2 AS u, count(*) FILTER (own) AS n1, count(*) FILTER (NOT own) AS n0 FROM ranked GROUP BY ALL",
    mw="SELECT m.*, t.tie, m.u / (n1::DOUBLE * n0) AS auc, n1::DOUBLE * n0 / 12 * (n1 + n0 + 1 - t.tie / ((n1 + n0)::DOUBLE * (n1 + n0 - 1))) AS var FROM mwu m JOIN ties t ON t.grp = m.target AND t.gene_id = m.gene_id",
    tested="SELECT *, CASE WHEN var > 1e-9 THEN sign(u - n1::DOUBLE * n0 / 2) * greatest(0, abs(u - n1::DOUBLE * n0 / 2) - 0.5) / sqrt(var) END AS z FROM mw",
)
_TABLE = dict(
    gated=f"SELECT m.*, t.u, t.auc, t.z, coalesce({P_VALUE}, 1) AS p_value, log2((m.target_mean + 1e-9) / (m.control_mean + 1e-9)) AS log2_fold_change FROM means m JOIN tested t USING (target, gene_id) WHERE m.control_mean > 5",
    numbered="SELECT *, row_number() OVER (PARTITION BY target ORDER BY p_value, gene_id) AS rn, count(*) OVER (PARTITION BY target) AS m FROM gated",
    de="SELECT *, least(1.0, min(p_value * m / rn) OVER (PARTITION BY target ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_adj FROM numbered",
)


@query("de_means", sql("modules", "obs", **_DENSE, body="SELECT target, gene_id, round(target_mean, 4) AS target_mean, round(control_mean, 4) AS control_mean, n_target, n_control, round(pct_target, 6) AS pct_target, round(pct_control, 6) AS pct_control FROM means"))
def de_means(spark, d):
    c, o = _mod(spark, d)
    m = de.mean_table(de.cell_cpm(c), o, "target", CONTROL)
    return m.select("target", "gene_id", r("target_mean", 4).alias("target_mean"), r("control_mean", 4).alias("control_mean"), "n_target", "n_control", r("pct_target").alias("pct_target"), r("pct_control").alias("pct_control"))


@query("mann_whitney", sql("modules", "obs", **_DENSE, body="SELECT target, gene_id, u, tie AS tie_term, round(auc, 6) AS auc, round(z, 6) AS z FROM tested"))
def mann_whitney(spark, d):
    c, o = _mod(spark, d)
    return de.mann_whitney(de.cell_cpm(c).select("row_id", "target", "gene_id", "value"), o, "target", CONTROL).select("target", "gene_id", "u", "tie_term", r("auc").alias("auc"), r("z").alias("z"))


@query("de_table", sql("modules", "obs", **_DENSE, **_TABLE, body="SELECT target, gene_id, round(log2_fold_change, 6) AS log2_fold_change, round(p_value, 6) AS p_value, round(p_adj, 6) AS p_adj, round(auc, 6) AS auc FROM de"))
def de_table(spark, d):
    c, o = _mod(spark, d)
    return de.de_table(c, o, "target", CONTROL).select("target", "gene_id", *[r(x).alias(x) for x in ("log2_fold_change", "p_value", "p_adj", "auc")])


@query("de_summary", sql("modules", "obs", **_DENSE, **_TABLE, body="SELECT target, max(n_target) AS n_cells, count(*) FILTER (p_adj < 0.5) AS n_de, count(*) FILTER (p_adj < 0.5 AND log2_fold_change > 0) AS n_up, count(*) FILTER (p_adj < 0.5 AND log2_fold_change < 0) AS n_down FROM de GROUP BY target"))
def de_summary(spark, d):
    c, o = _mod(spark, d)
    return de.de_summary(de.de_table(c, o, "target", CONTROL), "target", fdr=0.5)


@query("de_criteria", sql("modules", "obs", **_DENSE, **_TABLE, body="SELECT target, gene_id, p_adj < 0.5 AS passes_fdr, abs(log2_fold_change) >= 0.05 AS passes_lfc, greatest(auc, 1 - auc) >= 0.51 AS passes_auc, (p_adj < 0.5 OR abs(log2_fold_change) >= 0.05 OR greatest(auc, 1 - auc) >= 0.51) AS passes_any, (p_adj < 0.5 AND abs(log2_fold_change) >= 0.05 AND greatest(auc, 1 - auc) >= 0.51) AS passes_all FROM de"))
def de_criteria(spark, d):
    c, o = _mod(spark, d)
    return de.criteria(de.de_table(c, o, "target", CONTROL), 0.5, 0.05, 0.51).select("target", "gene_id", "passes_fdr", "passes_lfc", "passes_auc", "passes_any", "passes_all")


_SWEEP = sql("modules", "obs", **_DENSE, **_TABLE, body="SELECT fdr, lfc, min_auc, CAST(sum(n) AS BIGINT) AS genes, count(*) FILTER (n > 0) AS groups, median(n)::DOUBLE AS median_calls FROM (SELECT f.fdr, l.lfc, 0.5::DOUBLE AS min_auc, t.target, count(de.gene_id) AS n FROM (VALUES (0.2::DOUBLE), (0.5), (0.9)) f(fdr) CROSS JOIN (VALUES (0.0::DOUBLE), (0.1)) l(lfc) CROSS JOIN (SELECT DISTINCT target FROM obs) t LEFT JOIN de ON de.target = t.target AND de.p_adj < f.fdr AND abs(de.log2_fold_change) >= l.lfc AND greatest(de.auc, 1 - de.auc) >= 0.5 GROUP BY ALL) GROUP BY ALL")


@query("threshold_sweep", _SWEEP)
def threshold_sweep(spark, d):
    c, o = _mod(spark, d)
    grid = spark.createDataFrame([(f, x, 0.5) for f in (0.2, 0.5, 0.9) for x in (0.0, 0.1)], "fdr double, lfc double, min_auc double")
    return de.threshold_sweep(de.de_table(c, o, "target", CONTROL), grid, "target", o)


@query("best_threshold", None)
def best_threshold(spark, d):
    """Null calls come from random halves of the controls."""
    c, o = _mod(spark, d)
    grid = spark.createDataFrame([(f, x, 0.5) for f in (0.2, 0.5, 0.9) for x in (0.0, 0.1)], "fdr double, lfc double, min_auc double")
    halves = resampling.halves(o.where(F.col("target") == CONTROL), [], "row_id").withColumn("target", F.when(F.col("half") == 1, "a").otherwise("b")).drop("half")
    null = de.de_table(c.drop("target", "guide", "batch").join(halves, "row_id"), halves, "target", "b")
    return de.best_threshold(de.threshold_sweep(de.de_table(c, o, "target", CONTROL), grid, "target", o), de.threshold_sweep(null, grid, "target", halves))


@query("geometric_de", sql("modules", "obs", **{k: v for k, v in _DENSE.items() if k == "cellsum"}, dense="SELECT o.row_id, o.target, g.gene_id, ln(1 + coalesce(m.count, 0) * 1e4 / coalesce(s.total, 1)) AS v FROM obs o CROSS JOIN (SELECT DISTINCT gene_id FROM modules) g LEFT JOIN cellsum s ON s.row_id = o.row_id LEFT JOIN modules m ON m.row_id = o.row_id AND m.gene_id = g.gene_id", geo="SELECT target, gene_id, exp(avg(v)) - 1 AS g FROM dense GROUP BY ALL", body=f"SELECT t.target, t.gene_id, round(t.g, 6) AS target_geo, round(c.g, 6) AS control_geo, round(log2((t.g + 1e-9) / (c.g + 1e-9)), 6) AS lfc FROM geo t JOIN geo c USING (gene_id) WHERE c.target = '{CONTROL}' AND t.target <> '{CONTROL}'"))
def geometric_de(spark, d):
    c, o = _mod(spark, d)
    return de.geometric_de(c, o, "target", CONTROL).select("target", "gene_id", r("target_geo").alias("target_geo"), r("control_geo").alias("control_geo"), r("lfc").alias("lfc"))


@query("random_groups", "WITH r AS (SELECT o_orderkey AS row_id, k AS replicate, row_number() OVER (PARTITION BY k ORDER BY sha256('0:' || k || ':' || o_orderkey)) AS rn FROM orders, range(3) t(k)) SELECT row_id, replicate, CASE WHEN rn <= 10 THEN 10 WHEN rn <= 40 THEN 30 ELSE 100 END AS size FROM r WHERE rn <= 140")
def random_groups(spark, d):
    return de.random_groups(R.obs(spark, d), [10, 30, 100], 3).withColumn("replicate", F.col("replicate").cast("long"))


@query("subsample", sql("obs", body="SELECT row_id, guide, replicate FROM (SELECT o.row_id, o.guide, k AS replicate, row_number() OVER (PARTITION BY o.guide, k ORDER BY sha256('0:' || k || ':' || o.row_id)) AS rn FROM (SELECT *, count(*) OVER (PARTITION BY guide) AS n FROM obs) o, range(3) t(k) WHERE n > 370 OR k = 0) WHERE rn <= 370"))
def subsample(spark, d):
    return de.subsample(R.obs(spark, d), ["guide"], 370, 3).withColumn("replicate", F.col("replicate").cast("long"))


@query("null_floor", "WITH n AS (SELECT l_suppkey % 7 AS n_cells, count(*) AS n_de FROM lineitem GROUP BY l_suppkey) SELECT n_cells, median(n_de)::DOUBLE AS median_de, min(n_de) AS min_de, max(n_de) AS max_de, round(avg(n_de), 6) AS mean_de FROM n GROUP BY n_cells")
def null_floor(spark, d):
    n = R.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n_de")).withColumn("n_cells", F.col("l_suppkey") % 7)
    return de.null_floor(n).withColumn("mean_de", r("mean_de"))


@query("strong_masks", sql("modules", "obs", **_DENSE, **_TABLE, body="SELECT target, gene_id, p_adj < 0.9 AND abs(log2_fold_change) >= 0.05 AS strong, p_adj < 0.9 AND abs(log2_fold_change) < 0.05 AS weak, true AS all_genes FROM de"))
def strong_masks(spark, d):
    c, o = _mod(spark, d)
    return de.strong_masks(de.de_table(c, o, "target", CONTROL), "target", 0.9, 0.05).select("target", "gene_id", "strong", "weak", "all_genes")


@query("paired_halves", sql("modules", "obs", h="SELECT row_id, row_number() OVER (PARTITION BY target ORDER BY sha256('0:' || row_id)) % 2 = 1 AS a, row_number() OVER (PARTITION BY target ORDER BY sha256('1:' || row_id)) % 2 = 1 AS b FROM obs", v="SELECT m.row_id, o.target, m.gene_id, m.count / (sum(m.count) OVER (PARTITION BY m.row_id) / 1e6) AS v FROM modules m JOIN obs o USING (row_id)", body="SELECT target, gene_id, round(sum(v), 2) AS whole, round(sum(CASE WHEN a THEN v ELSE 0 END), 2) AS half_0, round(sum(CASE WHEN b THEN v ELSE 0 END), 2) AS half_1 FROM v JOIN h USING (row_id) GROUP BY ALL"))
def paired_halves(spark, d):
    c, o = _mod(spark, d)
    return de.paired_halves(c, o, "target", 2).select("target", "gene_id", *[r(x, 2).alias(x) for x in ("whole", "half_0", "half_1")])


@query("stable_signs", sql("effects", body="SELECT target, gene_id, count(*) FILTER (sign(f) = sign(o) AND f <> 0) AS agreeing, count(*) FILTER (sign(f) = sign(o) AND f <> 0) >= 1 AS stable FROM (SELECT target, gene_id, max(CASE WHEN context = 'F' THEN value END) AS f, max(CASE WHEN context = 'O' THEN value END) AS o FROM effects GROUP BY ALL) WHERE f IS NOT NULL AND o IS NOT NULL GROUP BY ALL"))
def stable_signs(spark, d):
    halves = R.truth(spark, d).withColumnRenamed("value", "a").join(R.prediction(spark, d).withColumnRenamed("value", "b"), ["target", "gene_id"])
    return effects.stable_sign(halves, ["target", "gene_id"], 1)


@query("stable_strong", sql("modules", "obs", **_DENSE, **_TABLE, body="SELECT target, gene_id, CAST(sign(log2_fold_change) = 1 AS INT) + CAST(sign(log2_fold_change) = -1 AS INT) + 0 AS agreeing, p_adj < 0.95 AND abs(log2_fold_change) >= 0.02 AND log2_fold_change <> 0 AS stable_strong FROM de"))
def stable_strong(spark, d):
    c, o = _mod(spark, d)
    t = de.de_table(c, o, "target", CONTROL)
    halves = t.select("target", "gene_id", *[F.col("log2_fold_change").alias(x) for x in ("lfc_a_0", "lfc_b_0")])
    return de.stable_strong(t, halves, ["target", "gene_id"], 1, 1, 0.95, 0.02).select("target", "gene_id", "agreeing", "stable_strong")


@query("dirichlet_lfc", sql("cells", p="SELECT target, gene_id, sum(count) AS n, sum(sum(count)) OVER (PARTITION BY target) AS tot FROM cells GROUP BY target, gene_id", body=f"SELECT g.target, g.gene_id, CASE WHEN c.n > 0 THEN round(log2(((coalesce(p.n, 0) + 1e4 * c.n / c.tot) / (t.tot + 1e4)) / (c.n / c.tot)), 6) ELSE 0 END AS lfc FROM (SELECT target, gene_id FROM (SELECT DISTINCT target FROM p WHERE target <> '{CONTROL}') CROSS JOIN (SELECT DISTINCT gene_id FROM p)) g JOIN (SELECT DISTINCT target, tot FROM p) t ON t.target = g.target LEFT JOIN p ON p.target = g.target AND p.gene_id = g.gene_id LEFT JOIN p c ON c.target = '{CONTROL}' AND c.gene_id = g.gene_id"))
def dirichlet_lfc(spark, d):
    return effects.dirichlet_lfc(pooling.pool_sums(R.cells(spark, d), ["target"]), CONTROL).withColumn("lfc", r("lfc"))


@query("group_mean_log1p", sql("modules", "obs", v="SELECT m.row_id, m.gene_id, o.target, o.batch, ln(1 + m.count * 1e4 / sum(m.count) OVER (PARTITION BY m.row_id)) AS v FROM modules m JOIN obs o USING (row_id)", body="SELECT target, v.batch, gene_id, round(sum(v) / n, 6) AS value, n AS n_cells FROM v JOIN (SELECT target, batch, count(*) AS n FROM obs GROUP BY ALL) USING (target, batch) GROUP BY target, v.batch, gene_id, n"))
def group_mean_log1p(spark, d):
    c, o = _mod(spark, d)
    return effects.group_mean_log1p(c, o, ["target", "batch"]).withColumn("value", r("value"))


@query("centroids", sql("modules", "obs", v="SELECT m.row_id, m.gene_id, o.target, o.batch, ln(1 + m.count * 1e4 / sum(m.count) OVER (PARTITION BY m.row_id)) AS v FROM modules m JOIN obs o USING (row_id)", g="SELECT target, batch, gene_id, sum(v) / n AS value, n FROM v JOIN (SELECT target, batch, count(*) AS n FROM obs GROUP BY ALL) USING (target, batch) GROUP BY target, batch, gene_id, n", body="SELECT target, gene_id, round(avg(value), 6) AS mean, round(sum(value * n) / sum(n), 6) AS cell_mean FROM g GROUP BY ALL"))
def centroids(spark, d):
    c, o = _mod(spark, d)
    return effects.unweighted_centroid(effects.group_mean_log1p(c, o, ["target", "batch"]), ["target"]).select("target", "gene_id", r("mean").alias("mean"), r("cell_mean").alias("cell_mean"))


@query("cosine_pairs", sql("prediction", "truth", body="SELECT p.target AS i, t.target AS j, round(sum(p.value * t.value) / (max(pn.n) * max(tn.n)), 6) AS cosine FROM prediction p JOIN truth t USING (gene_id) JOIN (SELECT target, sqrt(sum(value * value)) AS n FROM prediction GROUP BY ALL) pn ON pn.target = p.target JOIN (SELECT target, sqrt(sum(value * value)) AS n FROM truth GROUP BY ALL) tn ON tn.target = t.target GROUP BY p.target, t.target"))
def cosine_pairs(spark, d):
    return effects.cosine_pairs(R.prediction(spark, d), R.truth(spark, d)).withColumn("cosine", r("cosine"))


@query("nearest_other", sql("truth", c="SELECT a.target AS i, b.target AS j, sum(a.value * b.value) / (sqrt(max(an.n)) * sqrt(max(bn.n))) AS cosine FROM truth a JOIN truth b USING (gene_id) JOIN (SELECT target, sum(value * value) AS n FROM truth GROUP BY ALL) an ON an.target = a.target JOIN (SELECT target, sum(value * value) AS n FROM truth GROUP BY ALL) bn ON bn.target = b.target WHERE a.target <> b.target GROUP BY a.target, b.target", body="SELECT i, arg_max(j, cosine) AS nearest, round(max(cosine), 6) AS cosine FROM c GROUP BY i"))
def nearest_other(spark, d):
    t = R.truth(spark, d)
    return effects.nearest_other(effects.cosine_pairs(t, t)).withColumn("cosine", r("cosine"))


@query("axis_residual", sql("truth", ax="SELECT gene_id, avg(value) AS v FROM truth GROUP BY gene_id", u="SELECT gene_id, v / (SELECT sqrt(sum(v * v)) FROM ax) AS a FROM ax", body="SELECT target, gene_id, round(value - sum(value * a) OVER (PARTITION BY target) * a, 6) AS value FROM truth JOIN u USING (gene_id)"))
def axis_residual(spark, d):
    t = R.truth(spark, d)
    return effects.residual_from_axis(t, t.groupBy("gene_id").agg(F.avg("value").alias("value"))).withColumn("value", r("value"))


@query("leave_one_out", sql("truth", body="SELECT target, gene_id, round(value, 6) AS value, round((sum(value) OVER w - value) / nullif(count(*) OVER w - 1, 0), 6) AS others, round(value - (sum(value) OVER w - value) / nullif(count(*) OVER w - 1, 0), 6) AS residual FROM truth WINDOW w AS (PARTITION BY gene_id)"))
def leave_one_out(spark, d):
    return effects.leave_one_out(R.truth(spark, d)).select("target", "gene_id", r("value").alias("value"), r("others").alias("others"), r("residual").alias("residual"))


@query("leave_one_out_median", sql("truth", body="SELECT a.target, a.gene_id, round(median(b.value), 6) AS others_median FROM truth a LEFT JOIN truth b ON a.gene_id = b.gene_id AND a.target <> b.target AND b.value > -0.5 GROUP BY ALL"))
def leave_one_out_median(spark, d):
    t = R.truth(spark, d)
    return effects.leave_one_out_median(t, "gene_id", "target", "value", F.col("value") > -0.5).select("target", "gene_id", r("others_median").alias("others_median"))


@query("split_half_weight", sql("prediction", "truth", body="SELECT gene_id, round(s * s / nullif(s * s + d2 / 4, 0), 6) AS weight FROM (SELECT gene_id, avg((p.value + t.value) / 2) AS s, avg((p.value - t.value) * (p.value - t.value)) AS d2 FROM prediction p JOIN truth t USING (target, gene_id) GROUP BY gene_id)"))
def split_half_weight(spark, d):
    halves = R.prediction(spark, d).withColumnRenamed("value", "a").join(R.truth(spark, d).withColumnRenamed("value", "b"), ["target", "gene_id"])
    return effects.split_half_weight(halves, ["gene_id"]).withColumn("weight", r("weight"))


@query("correlations", sql("pairs", rk="SELECT target, prediction AS x, truth AS y, rank() OVER (PARTITION BY target ORDER BY prediction) + (count(*) OVER (PARTITION BY target, prediction) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY target ORDER BY truth) + (count(*) OVER (PARTITION BY target, truth) - 1) / 2.0 AS ry FROM pairs", body="SELECT target, round(corr(x, y), 6) AS pearson, round(corr(rx::DOUBLE, ry::DOUBLE), 6) AS spearman FROM rk GROUP BY target"))
def correlations(spark, d):
    return effects.correlations(R.pairs(spark, d), ["target"], "prediction", "truth").select("target", r("pearson").alias("pearson"), r("spearman").alias("spearman"))


@query("energy_shares", sql("truth", e="SELECT target, gene_id, value * value / sum(value * value) OVER (PARTITION BY target) AS s, row_number() OVER (PARTITION BY target ORDER BY value * value DESC, gene_id) AS rn FROM truth", body="SELECT target, round(sum(s) FILTER (rn <= 3), 6) AS top_share, round(exp(-sum(s * ln(s)) FILTER (s > 0)), 6) AS effective FROM e GROUP BY target"))
def energy_shares(spark, d):
    return effects.energy_shares(R.truth(spark, d)).select("target", r("top_share").alias("top_share"), r("effective").alias("effective"))


@query("sha_roles", "SELECT c_custkey, CAST(('0x' || substr(sha256('[\"' || c_name || '\",\"' || c_custkey || '\"]'), 16, 1))::INT % 4 AS INT) AS split FROM customer")
def sha_roles(spark, d):
    from ..functions.scalar import canonical_json

    return resampling.roles(R.table(spark, d, "customer"), canonical_json("c_name", "c_custkey")).select("c_custkey", "split")


_RR = sql("obs", body="SELECT row_id, CAST((row_number() OVER (PARTITION BY target, batch ORDER BY sha256('0:' || row_id), row_id) - 1 + ('0x' || substr(sha256('0:' || target || ':' || batch), 1, 8))::BIGINT % 4) % 4 AS INT) AS part FROM obs")


@query("round_robin", _RR)
def round_robin(spark, d):
    return resampling.round_robin(R.obs(spark, d), ["target", "batch"], "row_id").select("row_id", "part")


@query("split_balance", sql("obs", body="SELECT target, batch, count(*) // 4 AS smallest, (count(*) + 3) // 4 AS largest FROM obs GROUP BY ALL"))
def split_balance(spark, d):
    return resampling.balance(resampling.round_robin(R.obs(spark, d), ["target", "batch"], "row_id"), ["target", "batch"]).select("target", "batch", "smallest", "largest")


@query("hash_halves", sql("obs", body="SELECT row_id, CAST(row_number() OVER (PARTITION BY target ORDER BY sha256('7:' || row_id), row_id) % 2 AS INT) AS half FROM obs"))
def hash_halves(spark, d):
    return resampling.halves(R.obs(spark, d), ["target"], "row_id", seed=7).select("row_id", "half")


@query("target_folds", "SELECT s_suppkey, CAST((row_number() OVER (ORDER BY sha256('0:' || s_suppkey), s_suppkey) - 1) % 5 AS INT) AS fold FROM supplier")
def target_folds(spark, d):
    return resampling.folds(R.table(spark, d, "supplier").select("s_suppkey"), "s_suppkey")


@query("derangement", "WITH p AS (SELECT s_suppkey, row_number() OVER (ORDER BY sha256('0:' || s_suppkey), s_suppkey) - 1 AS k, count(*) OVER () AS n FROM supplier) SELECT a.s_suppkey, b.s_suppkey AS other FROM p a JOIN p b ON (a.k + 1) % a.n = b.k")
def derangement(spark, d):
    return resampling.derangement(R.table(spark, d, "supplier"), "s_suppkey")


@query("balanced_draw", sql("obs", body="SELECT row_id FROM (SELECT *, row_number() OVER (PARTITION BY guide ORDER BY sha256('0:' || row_id), row_id) AS turn FROM obs WHERE target = '5-LOW') ORDER BY turn, sha256('0:' || guide), sha256('0:' || row_id) LIMIT 100"))
def balanced_draw(spark, d):
    return resampling.balanced_draw(R.obs(spark, d).where(F.col("target") == CONTROL), "guide", "row_id", 100).select("row_id")


@query("random_subsample", sql("obs", body="SELECT row_id FROM obs ORDER BY sha256('3:' || row_id), row_id LIMIT 250"))
def random_subsample(spark, d):
    return resampling.random_subsample(R.obs(spark, d), "row_id", 250, seed=3).select("row_id")


_DRAWS = "SELECT k AS replicate, ('0x' || substr(sha256('0:' || k || ':' || j), 1, 12))::BIGINT % (SELECT count(*) FROM supplier) AS place FROM range(2000) t(k), range((SELECT count(*) FROM supplier)) u(j)"


@query("bootstrap_mean_ci", f"WITH p AS (SELECT s_acctbal AS v, row_number() OVER (ORDER BY s_suppkey) - 1 AS place FROM supplier), m AS (SELECT replicate, avg(v) AS m FROM ({_DRAWS}) JOIN p USING (place) GROUP BY replicate) SELECT round((SELECT avg(s_acctbal) FROM supplier), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m")
def bootstrap_mean_ci(spark, d):
    return resampling.bootstrap_mean_ci(R.table(spark, d, "supplier"), "s_suppkey", "s_acctbal").select(*[r(x).alias(x) for x in ("mean", "low", "high")])


@query("bootstrap_ratio_ci", f"WITH p AS (SELECT s_acctbal AS a, abs(s_acctbal) + s_nationkey AS b, row_number() OVER (ORDER BY s_suppkey) - 1 AS place FROM supplier), m AS (SELECT replicate, sum(a) / sum(b) AS m FROM ({_DRAWS}) JOIN p USING (place) GROUP BY replicate) SELECT round((SELECT sum(a) / sum(b) FROM p), 6) AS ratio, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m")
def bootstrap_ratio_ci(spark, d):
    s = R.table(spark, d, "supplier").withColumn("a", F.col("s_acctbal")).withColumn("b", F.abs("s_acctbal") + F.col("s_nationkey"))
    return resampling.bootstrap_ratio_ci(s, "s_suppkey", "a", "b").select(*[r(x).alias(x) for x in ("ratio", "low", "high")])


@query("empirical_p", sql("effects", body="SELECT o.target, round((1.0::DOUBLE + count(*) FILTER (n.v >= o.v)) / (1 + count(*)), 6) AS p FROM (SELECT target, max(value) AS v FROM effects WHERE context = 'F' GROUP BY target) o JOIN (SELECT target, value AS v FROM effects WHERE context = 'O') n USING (target) GROUP BY o.target"))
def empirical_p(spark, d):
    observed = R.truth(spark, d).groupBy("target").agg(F.max("value").alias("value"))
    return resampling.empirical_p(R.prediction(spark, d), observed, ["target"]).withColumn("p", r("p"))


@query("exact_sign_flip", None)
def exact_sign_flip(spark, d):
    x = R.table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("i"), (F.col("s_acctbal") - 4000).alias("v"))
    return resampling.exact_sign_flip(x, ["k"], "i", "v").withColumn("p", r("p")).withColumn("se", r("se"))


@query("set_comparison", sql("observations", body="SELECT coalesce(a.context, b.context) AS context, count(*) FILTER (a.gene IS NOT NULL AND b.gene IS NOT NULL) AS shared, count(*) FILTER (a.gene IS NULL) AS gained, count(*) FILTER (b.gene IS NULL) AS lost, round(count(*) FILTER (a.gene IS NOT NULL AND b.gene IS NOT NULL) / count(*), 6) AS jaccard FROM (SELECT context, gene FROM observations WHERE n_cells < 3) a FULL JOIN (SELECT context, gene FROM observations WHERE n_cells > 1) b ON a.context = b.context AND a.gene = b.gene GROUP BY 1"))
def set_comparison(spark, d):
    o = R.observations(spark, d)
    return sets.compare_sets(o.where("n_cells < 3"), o.where("n_cells > 1"), ["context"], "gene").withColumn("jaccard", r("jaccard"))


@query("common_axis", sql("observations", body="SELECT gene FROM observations WHERE context IN ('NATION_1', 'NATION_2', 'NATION_3') GROUP BY gene HAVING count(DISTINCT context) = 3"))
def common_axis(spark, d):
    o = R.observations(spark, d)
    return sets.common_axis([o.where(F.col("context") == f"NATION_{k}") for k in (1, 2, 3)], "gene")


@query("union_intersection", sql("observations", body="SELECT t.gene, count(s.context) > 0 AS broad, count(s.context) = 2 AS strict FROM (SELECT gene FROM observations WHERE context = 'NATION_3') t LEFT JOIN (SELECT gene, context FROM observations WHERE context IN ('NATION_1', 'NATION_2')) s USING (gene) GROUP BY t.gene"))
def union_intersection(spark, d):
    o = R.observations(spark, d)
    c = lambda k: o.where(F.col("context") == f"NATION_{k}")
    return sets.union_intersection(c(3), [c(1), c(2)], "gene")


@query("row_differences", "SELECT a.c_custkey, a.c_nationkey, b.n AS c_nationkey_other FROM customer a JOIN (SELECT c_custkey, c_nationkey % 20 AS n FROM customer) b USING (c_custkey) WHERE a.c_nationkey <> b.n")
def row_differences(spark, d):
    c = R.table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return sets.row_differences(c, c.withColumn("c_nationkey", F.col("c_nationkey") % 20), ["c_custkey"], ["c_nationkey"])


@query("multiset_difference", "SELECT l_suppkey, 'left' AS side, NULL::BIGINT IS NULL AS flag FROM (SELECT l_suppkey FROM lineitem WHERE l_tax > 0.02 EXCEPT ALL SELECT l_suppkey FROM lineitem WHERE l_tax < 0.06) UNION ALL SELECT l_suppkey, 'right', true FROM (SELECT l_suppkey FROM lineitem WHERE l_tax < 0.06 EXCEPT ALL SELECT l_suppkey FROM lineitem WHERE l_tax > 0.02)")
def multiset_difference(spark, d):
    li = R.table(spark, d, "lineitem")
    return sets.multiset_difference(li.where("l_tax > 0.02").select("l_suppkey"), li.where("l_tax < 0.06").select("l_suppkey")).withColumn("flag", F.lit(True))


@query("ordered_pairs", "SELECT a.s_nationkey, a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey")
def ordered_pairs(spark, d):
    return sets.ordered_pairs(R.table(spark, d, "supplier"), ["s_nationkey"], "s_suppkey")


@query("near_intervals", sql("genes", body="SELECT t.gene_id AS target, g.gene_id, greatest(0, g.start - t.\"end\", t.start - g.\"end\") AS gap FROM genes g JOIN genes t ON g.chr = t.chr WHERE greatest(0, g.start - t.\"end\", t.start - g.\"end\") <= 5000"))
def near_intervals(spark, d):
    g = R.genes(spark, d)
    return sets.near_intervals(g, g.withColumnRenamed("gene_id", "target"), 5000)


@query("checked_join", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def checked_join(spark, d):
    c = R.table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("k"))
    return sets.checked_join(c, R.table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name"), ["k"], validate="many_to_one").select("c_custkey", "n_name")


@query("cell_quality", sql("counts", "genes", t="SELECT row_id, count, row_number() OVER (PARTITION BY row_id ORDER BY count DESC, gene_id) AS rn, coalesce(symbol LIKE 'MT-%', false) AS mt FROM counts LEFT JOIN genes USING (gene_id)", body="SELECT row_id, CAST(sum(count) AS BIGINT) AS total, count(*) FILTER (count > 0) AS n_genes, round(sum(count) FILTER (rn <= 2) / sum(count), 6) AS top_share, round(coalesce(sum(count) FILTER (mt), 0) / sum(count), 6) AS mito_share, round(100.0::DOUBLE * count(*) FILTER (count = 1) / sum(count), 6) AS unseen_mass FROM t GROUP BY row_id"))
def cell_quality(spark, d):
    return signatures.cell_quality(R.counts(spark, d), R.genes(spark, d), top=2).select("row_id", "total", "n_genes", r("top_share").alias("top_share"), r("mito_share").alias("mito_share"), r("unseen_mass").alias("unseen_mass"))


@query("mad_selection", "WITH v AS (SELECT l_suppkey AS gene_id, log2(l_quantity + 1) AS v FROM lineitem), m AS (SELECT gene_id, median(v) AS m FROM v GROUP BY gene_id), s AS (SELECT gene_id, round(median(abs(v - m)), 6) AS mad FROM v JOIN m USING (gene_id) GROUP BY gene_id) SELECT gene_id, mad FROM s ORDER BY mad DESC, gene_id LIMIT 200")
def mad_selection(spark, d):
    v = R.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("gene_id"), F.col("l_quantity").alias("value"))
    return signatures.mad_selection(v, 200).withColumn("mad", r("mad"))


@query("variable_genes", sql("modules", k="SELECT count(*)::DOUBLE AS n FROM orders", m="SELECT gene_id, sum(count) / (SELECT n FROM k) AS mean, sum(count * count) AS ss FROM modules GROUP BY gene_id", l="SELECT gene_id, ln(1 + mean) AS lm, ln((ss - n * mean * mean) / (n - 1) / mean) AS ld FROM m, k WHERE (ss - n * mean * mean) / (n - 1) / mean > 0", b="SELECT *, least(19, floor((lm - min(lm) OVER ()) * 20 / (max(lm) OVER () - min(lm) OVER ()))) AS bin FROM l", body="SELECT gene_id, CAST(bin AS BIGINT) AS bin, round(coalesce((ld - avg(ld) OVER w) / nullif(stddev_samp(ld) OVER w, 0), 0), 6) AS normalised FROM b WINDOW w AS (PARTITION BY bin)"))
def variable_genes(spark, d):
    return signatures.variable_genes(R.modules(spark, d).withColumn("value", F.col("count").cast("double")), R.obs(spark, d).count()).select("gene_id", F.col("bin").cast("long").alias("bin"), r("normalised").alias("normalised"))


@query("nearest_vectors", "WITH p AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, sqrt(list_sum(list_transform(range(64), lambda k: pow(a.embedding[k + 1]::DOUBLE - b.embedding[k + 1]::DOUBLE, 2)))) AS dist FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) SELECT query, neighbour, round(dist, 5) AS distance, row_number() OVER (PARTITION BY query ORDER BY dist, neighbour) AS rank FROM p QUALIFY rank <= 20")
def nearest_vectors(spark, d):
    e = R.table(spark, d, "embeddings")
    return signatures.nearest(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 20, block=128).select("query", "neighbour", r("distance", 5).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query("axis_scores", sql("modules", body="SELECT row_id, round(sum(count * (gene_id - 30.0)), 6) AS score FROM modules GROUP BY row_id"))
def axis_scores(spark, d):
    v = R.modules(spark, d).withColumn("value", F.col("count").cast("double"))
    return signatures.axis_scores(v, spark.range(60).select(F.col("id").alias("gene_id"), (F.col("id") - 30.0).alias("weight"))).withColumn("score", r("score"))


@query("separation", "WITH x AS (SELECT *, CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS y FROM lineitem), k AS (SELECT l_suppkey, y, l_extendedprice AS s, rank() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_suppkey, l_extendedprice) - 1) / 2.0 AS rk FROM x) SELECT l_suppkey, round((avg(s) FILTER (y = 1) - avg(s) FILTER (y = 0)) / sqrt((var_samp(s) FILTER (y = 1) + var_samp(s) FILTER (y = 0)) / 2), 6) AS d_prime, round((sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc FROM k GROUP BY l_suppkey")
def separation(spark, d):
    x = R.table(spark, d, "lineitem").withColumn("y", F.when(F.col("l_returnflag") == "A", 1).otherwise(0))
    return signatures.separation(x, "y", "l_extendedprice", ("l_suppkey",)).select("l_suppkey", r("d_prime").alias("d_prime"), r("auc").alias("auc"))


@query("diagonal_fisher", sql("modules", o="SELECT o_orderkey AS row_id, CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE 1 END AS y FROM orders WHERE o_orderkey % 3 <> 1", n="SELECT y, count(*)::DOUBLE AS n FROM o GROUP BY y", s="SELECT g.gene_id, n.y, n.n, coalesce(x.s, 0) AS s, coalesce(x.ss, 0) AS ss FROM (SELECT DISTINCT gene_id FROM modules JOIN o USING (row_id)) g CROSS JOIN n LEFT JOIN (SELECT gene_id, y, sum(count)::DOUBLE AS s, sum(count * count)::DOUBLE AS ss FROM modules JOIN o USING (row_id) GROUP BY ALL) x ON x.gene_id = g.gene_id AND x.y = n.y", p="SELECT gene_id, sum(CASE WHEN y = 1 THEN s / n ELSE -s / n END) AS diff, sum(ss - s * s / n) / (sum(n) - 2) AS v FROM s GROUP BY gene_id", body="SELECT gene_id, round(diff / (v + (SELECT 0.1 * median(v) FROM p)), 6) AS weight FROM p"))
def diagonal_fisher(spark, d):
    o = R.obs(spark, d).select("row_id", F.when(F.col("target") == CONTROL, 0).otherwise(1).alias("y"), (F.col("row_id") % 3).alias("fold"))
    return signatures.diagonal_fisher(R.modules(spark, d).withColumn("value", F.col("count").cast("double")), o, "y", "fold", 1).withColumn("weight", r("weight"))


@query("enrichment", sql("truth", s="SELECT g AS gene_id, concat('s', g % 4) AS \"set\" FROM range(60) t(g)", p="SELECT target, gene_id, value, row_number() OVER (PARTITION BY target ORDER BY value DESC, gene_id) AS place, count(*) OVER (PARTITION BY target) AS n FROM truth", w="SELECT p.target, x.\"set\", p.place, p.n, p.gene_id, CASE WHEN s.\"set\" IS NOT NULL THEN abs(p.value) END AS hit FROM p CROSS JOIN (SELECT DISTINCT \"set\" FROM s) x LEFT JOIN s ON s.gene_id = p.gene_id AND s.\"set\" = x.\"set\"", c="SELECT target, \"set\", count(hit) OVER k AS size, sum(hit) OVER (k ORDER BY place) / nullif(sum(hit) OVER k, 0) AS up, (place - count(hit) OVER (k ORDER BY place)) / nullif(n - count(hit) OVER k, 0) AS miss FROM w WINDOW k AS (PARTITION BY target, \"set\")", body="SELECT target, \"set\", max(size) AS size, round(CASE WHEN max(coalesce(up, 0) - miss) >= -min(coalesce(up, 0) - miss) THEN max(coalesce(up, 0) - miss) ELSE min(coalesce(up, 0) - miss) END, 6) AS es FROM c WHERE size >= 5 GROUP BY ALL"))
def enrichment(spark, d):
    s = spark.range(60).select(F.col("id").alias("gene_id"), F.concat(F.lit("s"), (F.col("id") % 4).cast("string")).alias("set"))
    return signatures.enrichment(R.truth(spark, d), s, ["target"], "value", least=5).withColumn("es", r("es"))


@query("partner_mean", sql("truth", m="SELECT DISTINCT target, target % 6 AS complex FROM truth", body="SELECT a.target, e.gene_id, round(avg(e.value), 6) AS value FROM m a JOIN m b ON a.complex = b.complex AND a.target <> b.target JOIN truth e ON e.target = b.target JOIN truth own ON own.target = a.target AND own.gene_id = e.gene_id GROUP BY ALL"))
def partner_mean(spark, d):
    t = R.truth(spark, d)
    return signatures.partner_mean(t, t.select("target", (F.col("target") % 6).alias("complex")).distinct()).withColumn("value", r("value"))


@query("multinomial_energy", sql("cells", p="SELECT target, gene_id, sum(count) AS n, sum(sum(count)) OVER (PARTITION BY target) AS tot FROM cells GROUP BY target, gene_id", body="SELECT target, round(1e12 * (1 - sum((n / tot) * (n / tot))) / max(tot), 2) AS noise, round(1e12 * sum((n / tot) * (n / tot)), 2) AS energy FROM p GROUP BY target"))
def multinomial_energy(spark, d):
    return signatures.multinomial_energy(pooling.pool_sums(R.cells(spark, d), ["target"])).select("target", r("noise", 2).alias("noise"), r("energy", 2).alias("energy"))


@query("mixture_posteriors", None)
def mixture_posteriors(spark, d):
    li = R.table(spark, d, "lineitem").withColumn("item", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return signatures.mixture_posteriors(li, "l_returnflag", "item", "l_extendedprice")


@query("neighbour_signature", None)
def neighbour_signature(spark, d):
    e = R.table(spark, d, "embeddings")
    nn = signatures.nearest(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 5, block=256)
    values = e.select(F.col("vec_id").alias("row_id"), F.posexplode("embedding").alias("gene_id", "value")).withColumn("value", F.log1p(F.abs("value")))
    return signatures.neighbour_signature(nn.select("query", "neighbour"), values)


@query("sparse_signatures", None)
def sparse_signatures(spark, d):
    p = R.pairs(spark, d)
    a, b = p.alias("a"), p.alias("b")
    g = a.join(b, F.col("a.target") == F.col("b.target")).groupBy(F.col("a.gene_id").alias("i"), F.col("b.gene_id").alias("j")).agg(F.sum(F.col("a.prediction") * F.col("b.prediction")).alias("g"))
    rr = p.alias("a").join(p.alias("b"), F.col("a.target") == F.col("b.target")).groupBy(F.col("a.gene_id").alias("i"), F.col("b.gene_id").alias("y")).agg(F.sum(F.col("a.prediction") * F.col("b.truth")).alias("r"))
    return signatures.sparse_signatures(g.join(rr, "i"), "y", 3)
