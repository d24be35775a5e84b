"""Queries: crosstabs, histograms, scaling, explicit zeros, filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import aggregates, effects, metrics, sets
from . import registry as R
from .registry import CONTROL, query, r, sql


@query("crosstab", "SELECT o_orderstatus, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '5-LOW') AS low FROM orders GROUP BY o_orderstatus")
def crosstab(spark, d):
    o = R.table(spark, d, "orders")
    return aggregates.crosstab(o, "o_orderstatus", "o_orderpriority", ["1-URGENT", CONTROL]).withColumnsRenamed({"1-URGENT": "urgent", CONTROL: "low"})


@query("mode_of", "SELECT l_suppkey, part, n FROM (SELECT l_suppkey, l_partkey % 10 AS part, count(*) AS n FROM lineitem GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, part) = 1")
def mode_of(spark, d):
    return aggregates.mode_of(R.table(spark, d, "lineitem").withColumn("part", F.col("l_partkey") % 10), "l_suppkey", "part")


@query("ordered_distinct", "SELECT l_partkey, min(l_orderkey) AS first FROM lineitem GROUP BY l_partkey")
def ordered_distinct(spark, d):
    return aggregates.ordered_distinct(R.table(spark, d, "lineitem"), "l_partkey", "l_orderkey")


@query("histogram", "SELECT CAST(least(99, floor((greatest(1000, least(90000, l_extendedprice)) - 1000) * 100 / 89000)) AS INT) AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def histogram(spark, d):
    return aggregates.histogram(R.table(spark, d, "lineitem"), "l_extendedprice", 1000.0, 90000.0)


@query("binned_curve", "SELECT CASE WHEN l_quantity <= 10 THEN 1 WHEN l_quantity <= 30 THEN 2 ELSE 3 END AS bin, round(avg(l_extendedprice) FILTER (l_linestatus = 'F'), 4) AS F, round(avg(l_extendedprice) FILTER (l_linestatus = 'O'), 4) AS O FROM lineitem GROUP BY 1")
def binned_curve(spark, d):
    c = aggregates.binned_curve(R.table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", [0.0, 10.0, 30.0, 50.0], "l_linestatus", ["F", "O"])
    return c.select("bin", r("F", 4).alias("F"), r("O", 4).alias("O"))


@query("norm_matched", sql("prediction", "truth", body="SELECT p.target, p.gene_id, round(p.value * coalesce(sqrt(t.n) / nullif(sqrt(sum(p.value * p.value) OVER (PARTITION BY p.target)), 0), 0), 6) AS value FROM prediction p LEFT JOIN (SELECT target, sum(value * value) AS n FROM truth GROUP BY target) t USING (target)"))
def norm_matched(spark, d):
    return aggregates.norm_matched(R.prediction(spark, d), R.truth(spark, d)).withColumn("value", r("value"))


@query("standardised", "SELECT l_orderkey, l_linenumber, l_partkey, round(greatest(-10, least(10, coalesce((l_extendedprice - avg(l_extendedprice) OVER w) / nullif(stddev_samp(l_extendedprice) OVER w, 0), 0))), 6) + 0 AS z FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)")
def standardised(spark, d):
    li = R.table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", r(aggregates.standardised(li, "l_extendedprice", ["l_suppkey"])).alias("z"))


@query("densified_strata", sql("obs", body="SELECT g.guide, g.batch, t.part, count(o.row_id) AS n FROM (SELECT DISTINCT guide, batch FROM obs) g CROSS JOIN (VALUES (0), (1), (2), (3)) t(part) LEFT JOIN obs o ON o.guide = g.guide AND o.batch = g.batch AND o.row_id % 9 = t.part GROUP BY ALL"))
def densified_strata(spark, d):
    o = R.obs(spark, d)
    n = o.withColumn("part", (F.col("row_id") % 9).cast("int")).groupBy("guide", "batch", "part").agg(F.count(F.lit(1)).alias("n"))
    return aggregates.densified(n, ["guide", "batch"], "part", 4, "n")


@query("gated_genes", sql("panel_cpm", body="SELECT gene_id FROM panel_cpm WHERE context = 'F' AND target = 0 AND cpm > 16000"))
def gated_genes(spark, d):
    return aggregates.gated_genes(R.panel_cpm(spark, d).where("context = 'F' and target = 0").withColumn("mean", F.col("cpm")), 16000.0)


@query("deduplicated_by_size", "SELECT l_partkey, l_suppkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_suppkey) = 1")
def deduplicated_by_size(spark, d):
    li = R.table(spark, d, "lineitem").withColumn("o", F.struct("l_orderkey", "l_linenumber", "l_suppkey"))
    return aggregates.deduplicated_by_size(li, "l_partkey", "l_quantity", "o").select("l_partkey", "l_suppkey", "l_quantity")


@query("two_level_median", "WITH c AS (SELECT l_suppkey, l_linenumber, count(*) FILTER (l_discount > 0.05) AS n FROM lineitem GROUP BY ALL) SELECT l_suppkey, median(n)::DOUBLE AS median_n, round(avg(n), 6) AS mean_n, count(*) AS groups FROM c GROUP BY l_suppkey")
def two_level_median(spark, d):
    return aggregates.two_level_median(R.table(spark, d, "lineitem"), "l_suppkey", "l_linenumber", F.col("l_discount") > 0.05).withColumn("mean_n", r("mean_n"))


@query("technical_genes", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'MT-ND' WHEN 1 THEN 'RPS6KA' WHEN 2 THEN 'RPL3-' ELSE 'ACT' END || p_size AS symbol, p_partkey % 4 IN (0, 2) AS technical FROM part")
def technical_genes(spark, d):
    k = F.col("p_partkey") % 4
    symbol = F.concat(F.when(k == 0, "MT-ND").when(k == 1, "RPS6KA").when(k == 2, "RPL3-").otherwise("ACT"), F.col("p_size").cast("string"))
    return R.table(spark, d, "part").select("p_partkey", symbol.alias("symbol"), S.is_technical(symbol).alias("technical"))


@query("context_combinations", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_name < b.n_name")
def context_combinations(spark, d):
    return sets.combinations(R.table(spark, d, "nation"), "n_name")


@query("left_fill", "SELECT n_nationkey, n_name, coalesce(x.n, 0) AS n FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey) x ON c_nationkey = n_nationkey")
def left_fill(spark, d):
    n = R.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    return sets.left_fill(R.table(spark, d, "nation").select("n_nationkey", "n_name"), n, ["n_nationkey"], "n", 0)


@query("reference_scaled", sql("pairs", s="SELECT target, 1 - sum(abs(prediction - truth)) / sum(abs(truth)) AS v FROM pairs GROUP BY target", body="SELECT target, round((v - 0.1) / (0.9 - 0.1), 6) + 0 AS scaled FROM s"))
def reference_scaled(spark, d):
    m = metrics.profile_metrics(R.pairs(spark, d), ["target"])
    return m.select("target", r(metrics.reference_scaled(1 - F.col("nae"), F.lit(0.1), F.lit(0.9))).alias("scaled"))


@query("aligned_sources", sql("truth", "prediction", body="SELECT t.target, t.gene_id, round(t.value, 6) + 0 AS value FROM truth t WHERE t.target IN (SELECT target FROM prediction) AND t.gene_id IN (SELECT gene_id FROM prediction)"))
def aligned_sources(spark, d):
    p = R.prediction(spark, d)
    return sets.align([R.truth(spark, d), p], ["target", "gene_id"])[0].select("target", "gene_id", r("value").alias("value"))


@query("vector_norms", sql("truth", body="SELECT target, round(sqrt(sum(value * value)), 6) AS norm FROM truth GROUP BY target"))
def vector_norms(spark, d):
    return effects.norms(R.truth(spark, d), ["target"]).withColumn("norm", r("norm"))
