"""Queries: coverage algebra over the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog
from ..streaming import incremental
from . import registry as R
from .registry import query, r, sql

_PANEL = "SELECT p_partkey AS gene FROM part WHERE p_partkey % 7 = 1 OR p_partkey % 7 = 5"


def _panel(spark, d):
    return R.table(spark, d, "part").where("p_partkey % 7 in (1, 5)").select(F.col("p_partkey").alias("gene"))


@query("catalog_observations", "WITH l AS (SELECT l_partkey AS gene, n_name AS context, count(*) AS n_cells, l_returnflag AS src FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL), k AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY gene, context ORDER BY n_cells DESC, src) = 1) SELECT gene, context, n_cells, r_name AS study FROM k JOIN nation ON n_name = context JOIN region ON n_regionkey = r_regionkey")
def catalog_observations(spark, d):
    s = R.table(spark, d, "supplier").join(R.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("context"))
    loads = R.table(spark, d, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("l_partkey").alias("gene"), "context", F.col("l_returnflag").alias("source_order")).agg(F.count(F.lit(1)).alias("n_cells"))
    return catalog.build_observations(loads, R.contexts(spark, d).select("context", "study"))


@query("presence_matrix", sql("observations", body="SELECT gene, max(CASE WHEN context = 'NATION_1' THEN 1 ELSE 0 END) AS NATION_1, max(CASE WHEN context = 'NATION_2' THEN 1 ELSE 0 END) AS NATION_2, max(CASE WHEN context = 'NATION_3' THEN 1 ELSE 0 END) AS NATION_3 FROM observations GROUP BY gene"))
def presence_matrix(spark, d):
    return catalog.presence_matrix(R.observations(spark, d), ["NATION_1", "NATION_2", "NATION_3"])


_OV = "SELECT a.context AS a, b.context AS b, count(*) AS shared FROM observations a JOIN observations b USING (gene) GROUP BY ALL"


@query("overlap_counts", sql("observations", body=_OV))
def overlap_counts(spark, d):
    return catalog.overlap_counts(R.observations(spark, d))


@query("overlap_matrix", sql("observations", o=_OV, body="SELECT a, CAST(coalesce(max(CASE WHEN b = 'NATION_1' THEN shared END), 0) AS BIGINT) AS NATION_1, CAST(coalesce(max(CASE WHEN b = 'NATION_2' THEN shared END), 0) AS BIGINT) AS NATION_2 FROM o GROUP BY a"))
def overlap_matrix(spark, d):
    return catalog.overlap_matrix(R.observations(spark, d), ["NATION_1", "NATION_2"])


@query("bridge_edges", sql("observations", "contexts", o=_OV, n="SELECT context, count(*) AS n FROM observations GROUP BY context", body="SELECT a AS context_a, b AS context_b, shared, round(shared / na.n, 6) AS share_a, round(shared / nb.n, 6) AS share_b, ca.study = cb.study AS same_study, ca.canonical = cb.canonical AS same_canonical FROM o JOIN contexts ca ON ca.context = a JOIN contexts cb ON cb.context = b JOIN n na ON na.context = a JOIN n nb ON nb.context = b WHERE ca.ord < cb.ord"))
def bridge_edges(spark, d):
    return catalog.bridge_edges(R.observations(spark, d), R.contexts(spark, d)).withColumn("share_a", r("share_a")).withColumn("share_b", r("share_b"))


@query("gene_exposure", sql("observations", p=_PANEL, body="SELECT coalesce(o.gene, p.gene) AS gene, count(o.context) AS n_contexts, coalesce(string_agg(o.context, ';' ORDER BY o.context), '') AS contexts, bool_or(p.gene IS NOT NULL) AS in_panel, CASE count(o.context) WHEN 0 THEN 'unseen' WHEN 1 THEN 'seen-1' ELSE 'seen-multi' END AS exposure FROM observations o FULL JOIN p ON p.gene = o.gene GROUP BY 1"))
def gene_exposure(spark, d):
    return catalog.exposure(R.observations(spark, d), _panel(spark, d))


@query("sampling_capacity", sql("observations", body="SELECT context, count(*) AS n, min(n_cells) AS min_cells, median(n_cells)::DOUBLE AS median_cells, max(n_cells) AS max_cells, count(*) FILTER (n_cells >= 3) AS n_3, count(*) FILTER (n_cells >= 5) AS n_5 FROM observations WHERE n_cells >= 2 GROUP BY context"))
def sampling_capacity(spark, d):
    return catalog.sampling_capacity(R.observations(spark, d), (3, 5))


@query("cross_study_pairs", sql("contexts", body="SELECT a.context AS source, b.context AS target FROM contexts a JOIN contexts b ON a.canonical = b.canonical AND a.study <> b.study"))
def cross_study_pairs(spark, d):
    return catalog.cross_study_pairs(R.contexts(spark, d))


@query("within_study_pairs", sql("contexts", body="SELECT a.context AS source, b.context AS target FROM contexts a JOIN contexts b ON a.study = b.study AND a.context <> b.context"))
def within_study_pairs(spark, d):
    return catalog.within_study_pairs(R.contexts(spark, d))


@query("pair_units", sql("observations", "contexts", body="SELECT a.context AS source, b.context AS target, count(*) AS genes FROM contexts a JOIN contexts b ON a.study = b.study AND a.context <> b.context JOIN observations x ON x.context = a.context JOIN observations y ON y.context = b.context AND y.gene = x.gene GROUP BY ALL"))
def pair_units(spark, d):
    return catalog.pair_units(catalog.within_study_pairs(R.contexts(spark, d)), R.observations(spark, d))


@query("leave_one_context_out", sql("observations", k="SELECT study, count(DISTINCT context) AS k FROM observations GROUP BY study", g="SELECT study, gene, count(*) AS m FROM observations GROUP BY ALL", body="SELECT study, context, count(*) FILTER (m > 1) AS broad, count(*) FILTER (m = k) AS strict FROM observations JOIN g USING (study, gene) JOIN k USING (study) WHERE k > 1 GROUP BY ALL"))
def leave_one_context_out(spark, d):
    return catalog.leave_one_context_out(R.observations(spark, d))


@query("anchor_units", sql("observations", body="SELECT o.context, count(*) AS genes FROM observations o JOIN observations a ON a.context = 'NATION_1' AND a.gene = o.gene AND a.study <> o.study GROUP BY o.context"))
def anchor_units(spark, d):
    return catalog.anchor_units(R.observations(spark, d), "NATION_1")


def _canonical(spark, d):
    return R.observations(spark, d).join(R.contexts(spark, d).select("context", "canonical"), "context")


_HOLD = "SELECT o.gene, o.context, count(x.context) AS k FROM c o LEFT JOIN c x ON x.gene = o.gene AND x.canonical <> o.canonical GROUP BY ALL"


@query("multi_source_holdout", sql("observations", "contexts", c="SELECT o.*, x.canonical FROM observations o JOIN contexts x USING (context)", h=_HOLD, body="SELECT gene, context, k, CASE k WHEN 0 THEN 'unseen' WHEN 1 THEN 'seen-1' ELSE 'seen-multi' END AS class FROM h"))
def multi_source_holdout(spark, d):
    return catalog.multi_source_holdout(_canonical(spark, d))


@query("holdout_summary", sql("observations", "contexts", c="SELECT o.*, x.canonical FROM observations o JOIN contexts x USING (context)", h=_HOLD, body="SELECT CASE k WHEN 0 THEN 'unseen' WHEN 1 THEN 'seen-1' ELSE 'seen-multi' END AS class, count(*) AS n FROM h GROUP BY 1"))
def holdout_summary(spark, d):
    return catalog.multi_source_holdout(_canonical(spark, d)).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query("attrition", sql("observations", body="SELECT t AS threshold, count(*) FILTER (n_cells >= t) AS units FROM observations, (VALUES (1::BIGINT), (2), (3), (5), (8)) v(t) GROUP BY t"))
def attrition(spark, d):
    return catalog.attrition(R.observations(spark, d), (1, 2, 3, 5, 8))


@query("eligible_observations", sql("observations", "contexts", body="SELECT o.gene, o.context, o.n_cells FROM observations o JOIN contexts c USING (context) WHERE has_controls AND has_raw_counts"))
def eligible_observations(spark, d):
    return catalog.eligible(R.observations(spark, d), R.contexts(spark, d)).select("gene", "context", "n_cells")


@query("coverage_summary", sql("observations", "contexts", p=_PANEL, body="SELECT c.context, count(o.gene) AS covered, count(*) AS panel, round(count(o.gene) / count(*), 6) AS share FROM p CROSS JOIN contexts c LEFT JOIN observations o ON o.gene = p.gene AND o.context = c.context GROUP BY c.context"))
def coverage_summary(spark, d):
    return catalog.coverage_summary(catalog.coverage_long(_panel(spark, d), R.observations(spark, d), R.contexts(spark, d))).withColumn("share", r("share"))


@query("coverage_long", sql("observations", "contexts", p=_PANEL, body="SELECT p.gene, c.context, coalesce(o.n_cells, 0) AS n_cells FROM p CROSS JOIN contexts c LEFT JOIN observations o ON o.gene = p.gene AND o.context = c.context"))
def coverage_long(spark, d):
    return catalog.coverage_long(_panel(spark, d), R.observations(spark, d), R.contexts(spark, d))


@query("occupancy", sql("obs", s="SELECT guide, batch, count(*) AS n FROM obs GROUP BY ALL", body="SELECT guide, count(*) AS n_strata, count(*) FILTER (n >= 4) AS n_4, count(*) FILTER (n >= 8) AS n_8, count(*) FILTER (n >= 20) AS n_20, min(n) AS min_cells, quantile_cont(n, 0.25)::DOUBLE AS q25, quantile_cont(n, 0.75)::DOUBLE AS q75 FROM s GROUP BY guide"))
def occupancy(spark, d):
    return catalog.occupancy(R.obs(spark, d).groupBy("guide", "batch").agg(F.count(F.lit(1)).alias("n_cells")), "guide")


@query("catalog_violations", sql("observations", body="SELECT unnest(['duplicate_key', 'asymmetric_overlap', 'wrong_diagonal']) AS \"check\", 0::BIGINT AS n"))
def catalog_violations(spark, d):
    o = R.observations(spark, d)
    return catalog.violations(o, catalog.overlap_counts(o))


@query("promoter_pairs", "WITH c AS (SELECT l_linestatus AS context, l_suppkey AS guide, l_suppkey % 50 AS target, CASE l_suppkey % 3 WHEN 0 THEN 'P1' WHEN 1 THEN 'P2' END AS promoter FROM lineitem GROUP BY ALL) SELECT a.target, a.guide, b.guide AS other, CASE WHEN a.guide = b.guide THEN 'exact' WHEN a.promoter IS NOT DISTINCT FROM b.promoter THEN 'same_promoter' ELSE 'cross_promoter' END AS relation FROM c a JOIN c b ON a.target = b.target AND a.context = 'F' AND b.context = 'O'")
def promoter_pairs(spark, d):
    li = R.table(spark, d, "lineitem").select(F.col("l_linestatus").alias("context"), F.col("l_suppkey").alias("guide")).distinct()
    c = li.withColumn("target", F.col("guide") % 50).withColumn("promoter", F.when(F.col("guide") % 3 == 0, "P1").when(F.col("guide") % 3 == 1, "P2"))
    return catalog.promoter_pairs(c, "F", "O")


@query("windowed_events", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_events(spark, d):
    return incremental.windowed(R.table(spark, d, "events"), "ts", ["event_type"], "value").withColumn("total", r("total", 4))
