"""Queries of roles, masks, arms and report columns."""

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import effects, ranks, selection
from . import registry as R
from .registry import query, r, sql


@query("rows_with_roles", sql("obs", body="SELECT row_id, 'orders' AS context, guide AS exact_construct_id, CASE WHEN is_control THEN 'control' ELSE 'target' END AS control_role, substr(guide, 3) IN ('g1', 'g2') AS in_panel FROM obs WHERE batch >= 1993 AND (is_control OR substr(guide, 3) IN ('g1', 'g2'))"))
def rows_with_roles(spark, d):
    o = R.obs(spark, d)
    panel = o.where(F.substring("guide", 3, 9).isin("g1", "g2")).select("guide")
    return selection.with_roles(o, F.col("batch") >= 1993, F.col("is_control"), panel, "guide", "orders").select("row_id", "context", "exact_construct_id", "control_role", "in_panel")


@query("remapped_categories", sql("obs", body="SELECT row_id, guide, dense_rank() OVER (ORDER BY guide) - 1 AS code FROM obs WHERE batch = 1995 AND target <> '3-MEDIUM'"))
def remapped_categories(spark, d):
    return selection.remapped(R.obs(spark, d).where("batch = 1995 and target <> '3-MEDIUM'"), "guide").select("row_id", "guide", F.col("code").cast("long").alias("code"))


@query("panel_exclusion", sql("effects", body="SELECT context, target, gene_id, round(value, 6) AS value FROM effects WHERE gene_id NOT IN (SELECT target FROM effects)"))
def panel_exclusion(spark, d):
    e = R.effects(spark, d)
    return selection.outside(e, "gene_id", e.select("target")).select("context", "target", "gene_id", r("value").alias("value"))


@query("downstream_mask", sql("effects", body="SELECT context, target, gene_id, gene_id < 45 AND gene_id <> target AS downstream FROM effects"))
def downstream_mask(spark, d):
    return R.effects(spark, d).select("context", "target", "gene_id", selection.is_downstream(F.col("gene_id"), F.col("gene_id"), F.col("target"), 45).alias("downstream"))


@query("label_select", sql("obs", body="SELECT row_id, CASE WHEN batch < 1996 THEN 'excluded' WHEN is_control THEN 'NT' ELSE guide END AS label FROM obs"))
def label_select(spark, d):
    return R.obs(spark, d).select("row_id", selection.first_label((F.col("batch") < 1996, "excluded"), (F.col("is_control"), "NT"), default=F.col("guide")).alias("label"))


@query("strata_support", sql("obs", x="SELECT target, batch, row_id % 97 AS split, count(*) AS total FROM obs WHERE NOT is_control GROUP BY ALL", c="SELECT batch, row_id % 97 AS split, count(*) AS n FROM obs WHERE is_control GROUP BY ALL", body="SELECT target, x.batch, x.split, total, coalesce(n, 0) AS n_controls, coalesce(n, 0) > 0 OR total = 0 AS available FROM x LEFT JOIN c ON x.batch = c.batch AND x.split = c.split"))
def strata_support(spark, d):
    o = R.obs(spark, d).withColumn("split", F.col("row_id") % 97)
    x = o.where(~F.col("is_control")).groupBy("target", "batch", "split").agg(F.count(F.lit(1)).alias("total"))
    return selection.strata_support(x, o.where("is_control"), ["batch", "split"], "total").select("target", "batch", "split", "total", "n_controls", "available")


_QUANTILES = ", ".join(f"round(quantile_cont(total, {q}), 6) AS {n}" for n, q in (("min", 0), ("q10", 0.1), ("q25", 0.25), ("median", 0.5), ("q75", 0.75), ("q90", 0.9), ("max", 1)))


@query("quantile_vector", sql("cells", x="SELECT target, row_id, sum(count)::DOUBLE AS total FROM cells GROUP BY ALL", body=f"SELECT target, {_QUANTILES} FROM x GROUP BY target"))
def quantile_vector(spark, d):
    x = R.cells(spark, d).groupBy("target", "row_id").agg(F.sum("count").cast("double").alias("total"))
    q = selection.quantile_vector(x, "total", ["target"])
    return q.select("target", *[r(c).alias(c) for c in q.columns[1:]])


@query("log_histogram", "SELECT least(99, greatest(0, floor((log10(l_extendedprice) - 2.5) / 2 * 100)))::BIGINT AS bin, count(*) AS n FROM lineitem WHERE l_extendedprice > 0 GROUP BY ALL")
def log_histogram(spark, d):
    return selection.log_histogram(R.table(spark, d, "lineitem"), "l_extendedprice", 2.5, 4.5)


@query("size_matched_arm", sql("obs", s="SELECT target, count(*) AS wanted FROM obs WHERE batch = 1995 GROUP BY target", body="SELECT target, row_id FROM obs JOIN s USING (target) QUALIFY row_number() OVER (PARTITION BY target ORDER BY sha256('0:' || target || ':' || row_id)) <= wanted"))
def size_matched_arm(spark, d):
    o = R.obs(spark, d)
    return selection.size_matched(o, o.where("batch = 1995"), ["target"], "row_id").select("target", "row_id")


@query("named_tertiles", sql("counts", x="SELECT gene_id, sum(count)::DOUBLE AS total FROM counts GROUP BY gene_id", q="SELECT quantile_cont(total, 1 / 3.0::DOUBLE) AS a, quantile_cont(total, 2 / 3.0::DOUBLE) AS b FROM x", body="SELECT gene_id, total, CASE WHEN total <= a THEN 'low' WHEN total <= b THEN 'mid' ELSE 'high' END AS bin FROM x, q"))
def named_tertiles(spark, d):
    return selection.tertiles(R.counts(spark, d).groupBy("gene_id").agg(F.sum("count").cast("double").alias("total")), "total").select("gene_id", "total", "bin")


_SCALE = "SELECT target, min(ratio) AS scale FROM (SELECT target, ratio, sum(w) OVER (PARTITION BY target ORDER BY ratio) AS cum, sum(w) OVER (PARTITION BY target) AS total FROM (SELECT target, truth / prediction AS ratio, abs(prediction) AS w FROM pairs WHERE prediction <> 0)) WHERE cum >= total / 2 GROUP BY target"


@query("absolute_scale", sql("pairs", s=_SCALE, body="SELECT target, round(scale, 6) AS scale FROM s"))
def absolute_scale(spark, d):
    return selection.absolute_scale(R.pairs(spark, d), "target").select("target", r("scale").alias("scale"))


@query("transferred_scale", sql("pairs", s=_SCALE, body="SELECT a.target, round(median(b.scale), 6) AS scale FROM s a JOIN s b ON a.target <> b.target GROUP BY a.target"))
def transferred_scale(spark, d):
    """Each target gets the median of the other targets' scales."""
    own = selection.absolute_scale(R.pairs(spark, d), "target").withColumn("all", F.lit(0))
    out = effects.leave_one_out_median(own, "all", "target", "scale")
    return out.select("target", r([c for c in out.columns if c not in own.columns][0]).alias("scale"))


_FACTORS = [0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0]


@query("refined_scale", sql("pairs", s=_SCALE, e=f"SELECT p.target, s.scale AS centre, f, sum(abs(truth - s.scale * f * prediction)) / sum(abs(truth)) AS nmae FROM pairs p JOIN s USING (target), (SELECT unnest({_FACTORS})::DOUBLE AS f) GROUP BY ALL", body="SELECT target, round(centre, 6) AS centre, min_by(f, nmae) AS factor, round(min(nmae), 6) AS nmae, min_by(f, nmae) IN (0.25, 3.0) AS at_boundary FROM e GROUP BY target, centre"))
def refined_scale(spark, d):
    p = R.pairs(spark, d)
    found = selection.refined_scales(p, selection.absolute_scale(p, "target").withColumnRenamed("scale", "centre"), _FACTORS, "target")
    return found.select("target", r("centre").alias("centre"), "factor", r("nmae").alias("nmae"), "at_boundary")


@query("arm_summary", sql("effects", x="SELECT *, count(*) OVER (PARTITION BY target, gene_id) = 2 AS o FROM effects", body="SELECT context, target, count(*) AS n, count(*) FILTER (o) AS n_overlap, round(avg(value), 6) AS mean_all, round(avg(value) FILTER (o), 6) AS mean_overlap, count(*) FILTER (o) >= 10 AS eligible FROM x GROUP BY ALL"))
def arm_summary(spark, d):
    e = R.effects(spark, d)
    both = e.groupBy("target", "gene_id").agg((F.count(F.lit(1)) == 2).alias("o"))
    s = selection.arm_summary(e.join(both, ["target", "gene_id"]), "context", "target", F.col("o"))
    return s.select("context", "target", "n", "n_overlap", r("mean_all").alias("mean_all"), r("mean_overlap").alias("mean_overlap"), "eligible")


@query("wide_metrics", sql("obs", body="SELECT guide, max(n) FILTER (batch = 1996) AS m1996, max(n) FILTER (batch = 1997) AS m1997 FROM (SELECT guide, batch, count(*)::DOUBLE AS n FROM obs GROUP BY ALL) GROUP BY guide HAVING m1996 IS NOT NULL AND m1997 IS NOT NULL"))
def wide_metrics(spark, d):
    long = R.obs(spark, d).groupBy("guide", F.concat(F.lit("m"), F.col("batch").cast("string")).alias("metric")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return selection.wide_metrics(long, ["guide"], ["m1996", "m1997"])


@query("markdown_floats", "SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN '-' ELSE printf('%.3f', o_totalprice) END AS shown FROM orders")
def markdown_floats(spark, d):
    return R.table(spark, d, "orders").select("o_orderkey", selection.markdown_float(F.when(F.col("o_custkey") % 5 != 0, F.col("o_totalprice"))).alias("shown"))


@query("residual_variance_ratio", sql("pairs", body="SELECT gene_id, round(CASE WHEN var_pop(truth) > 0 THEN var_pop(truth - prediction) / var_pop(truth) END, 6) AS ratio FROM pairs GROUP BY gene_id"))
def residual_variance_ratio(spark, d):
    return selection.residual_variance_ratio(R.pairs(spark, d), "gene_id").select("gene_id", r("ratio").alias("ratio"))


@query("anchor_rows", sql("obs", body="SELECT guide, row_id, row_number() OVER (PARTITION BY guide ORDER BY sha256('0:' || guide || ':' || row_id)) AS place FROM obs QUALIFY place <= 25"))
def anchor_rows(spark, d):
    return selection.anchor_rows(R.obs(spark, d), ["guide"], "row_id", 25).select("guide", "row_id", F.col("place").cast("long").alias("place"))


@query("inventory", """SELECT 'repeated l_orderkey' AS "check", count(*) AS n FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'unresolved l_partkey', count(DISTINCT l_partkey) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5) UNION ALL SELECT 'unresolved l_suppkey', count(DISTINCT l_suppkey) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)""")
def inventory(spark, d):
    parts = R.table(spark, d, "part").where("p_size > 5").select("p_partkey")
    return selection.inventory(R.table(spark, d, "lineitem"), "l_orderkey", {"l_partkey": parts, "l_suppkey": R.table(spark, d, "supplier").select("s_suppkey")})


@query("spearman_brown", sql("cells", h="SELECT target, gene_id, coalesce(sum(count) FILTER (row_id % 2 = 0), 0)::DOUBLE AS a, coalesce(sum(count) FILTER (row_id % 2 = 1), 0)::DOUBLE AS b FROM cells GROUP BY ALL", body="SELECT target, round(2 * corr(a, b) / (1 + corr(a, b)), 6) AS reliability FROM h GROUP BY target"))
def spearman_brown(spark, d):
    half = lambda k: F.sum(F.when(F.col("row_id") % 2 == k, F.col("count")).otherwise(0)).cast("double")
    h = R.cells(spark, d).groupBy("target", "gene_id").agg(half(0).alias("a"), half(1).alias("b"))
    return h.groupBy("target").agg(F.corr("a", "b").alias("c")).select("target", r(ranks.spearman_brown("c")).alias("reliability"))


@query("interval_gaps", sql("genes", body="SELECT a.gene_id, b.gene_id AS next_id, greatest(0, b.start - a.\"end\", a.start - b.\"end\") AS gap FROM genes a JOIN genes b ON b.gene_id = a.gene_id + 1 AND a.chr = b.chr"))
def interval_gaps(spark, d):
    g = R.genes(spark, d)
    b = g.select((F.col("gene_id") - 1).alias("gene_id"), F.col("gene_id").alias("next_id"), F.col("chr").alias("c2"), F.col("start").alias("s2"), F.col("end").alias("e2"))
    return g.join(b, "gene_id").select("gene_id", "next_id", scalar.interval_gap("chr", "start", "end", "c2", "s2", "e2").alias("gap")).where("gap is not null")


_MISSING = "SELECT l_suppkey AS k, l_partkey AS item, CASE WHEN l_partkey % 3 <> 0 THEN min(l_discount + l_quantity / 100) END AS p FROM lineitem GROUP BY l_suppkey, l_partkey"


@query("holm_with_missing", f"WITH x AS ({_MISSING}), y AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p, item) AS rn, count(*) OVER (PARTITION BY k) AS m FROM x WHERE p IS NOT NULL) SELECT k, item, round(least(1.0, max(p * (m - rn + 1)) OVER (PARTITION BY k ORDER BY rn ROWS UNBOUNDED PRECEDING)), 6) AS p_holm FROM y UNION ALL SELECT k, item, NULL FROM x WHERE p IS NULL")
def holm_with_missing(spark, d):
    p = R.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("item")).agg(F.min(F.col("l_discount") + F.col("l_quantity") / 100).alias("p"))
    return ranks.holm(p.withColumn("p", F.when(F.col("item") % 3 != 0, F.col("p"))), "p", ["k"], tie="item").select("k", "item", r("p_holm").alias("p_holm"))


