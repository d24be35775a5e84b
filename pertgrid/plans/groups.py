"""Queries: projected scans, group sizes, gates, balance of parts, axes, pooled slopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import audits, catalog, de, pooling, transfer
from ..sources import readers
from . import registry as R
from .registry import query, r, sql


@query("projected_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 25 AND l_returnflag = 'R'")
def projected_scan(spark, d):
    return readers.parquet(spark, f"{d}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_quantity"], "l_quantity > 25 and l_returnflag = 'R'")


@query("nullable_strings", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN o_orderpriority END AS label FROM orders")
def nullable_strings(spark, d):
    o = R.table(spark, d, "orders").withColumn("mask", F.col("o_orderstatus") == "O")
    return readers.nullable_strings(o, "o_orderpriority", "mask", "label").select("o_orderkey", "label")


@query("axis_difference", "(SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R') UNION ALL (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A')")
def axis_difference(spark, d):
    li = R.table(spark, d, "lineitem")
    return readers.axis_difference(li.where("l_returnflag = 'A'"), li.where("l_returnflag = 'R'"), ["l_partkey", "l_suppkey"])


@query("group_sizes", sql("obs", body="SELECT guide, batch, count(*) AS n_cells FROM obs GROUP BY guide, batch"))
def group_sizes(spark, d):
    return pooling.group_sizes(R.obs(spark, d), ["guide", "batch"])


@query("cpm_within", sql("counts", body="SELECT row_id, gene_id, round(count * 1e6 / sum(count) OVER (PARTITION BY row_id), 4) AS cpm FROM counts"))
def cpm_within(spark, d):
    return R.counts(spark, d).select("row_id", "gene_id", r(S.cpm_within("count", "row_id"), 4).alias("cpm"))


_CONTROL_MEANS = "SELECT gene_id, sum(count) / (SELECT count(*) FROM obs WHERE is_control) AS control_mean FROM cells WHERE is_control GROUP BY gene_id"


@query("gated_by_control", sql("cells", means=_CONTROL_MEANS, body="SELECT gene_id, round(control_mean, 6) AS control_mean FROM means WHERE control_mean > 0.05"))
def gated_by_control(spark, d):
    n = R.obs(spark, d).where("is_control").agg(F.count(F.lit(1)).alias("n"))  # one row
    sums = R.cells(spark, d).where("is_control").groupBy("gene_id").agg(F.sum("count").alias("total"))
    means = sums.join(F.broadcast(n), how="cross").select("gene_id", (F.col("total") / F.col("n")).alias("control_mean"))
    return de.gate(means, 0.05).select("gene_id", r("control_mean").alias("control_mean"))


@query("unbalanced_parts", sql("obs", c="SELECT guide, count(*) FILTER (row_id % 3 = 0) AS n_0, count(*) FILTER (row_id % 3 = 1) AS n_1, count(*) FILTER (row_id % 3 = 2) AS n_2 FROM obs GROUP BY guide", body="SELECT * FROM c WHERE greatest(n_0, n_1, n_2) - least(n_0, n_1, n_2) > 1"))
def unbalanced_parts(spark, d):
    return audits.unbalanced(R.obs(spark, d).withColumn("part", F.col("row_id") % 3), ["guide"], "part", 3)


@query("rows_per_group", "SELECT l_orderkey, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_linenumber) <> 4")
def rows_per_group(spark, d):
    return audits.rows_per_group(R.table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", 4)


@query("second_best", sql("observations", body="SELECT gene, context, n_cells FROM observations QUALIFY row_number() OVER (PARTITION BY gene ORDER BY n_cells DESC, context) = 2"))
def second_best(spark, d):
    return catalog.second_best(R.observations(spark, d))


_STATES = "SELECT l_suppkey AS target, l_partkey AS gene_id, coalesce(sum(l_quantity) FILTER (l_linestatus = 'F'), 0) AS x, coalesce(sum(l_quantity) FILTER (l_linestatus = 'O'), 0) AS y FROM lineitem GROUP BY ALL"


@query("pooled_slope", sql(p=_STATES, body="SELECT target, round(sum(x * y) / nullif(sum(x * x), 0), 6) + 0 AS slope FROM p GROUP BY target"))
def pooled_slope(spark, d):
    """Of every target, over the whole axis of genes."""
    li = R.table(spark, d, "lineitem")
    state = lambda s: F.coalesce(F.sum(F.when(F.col("l_linestatus") == s, F.col("l_quantity"))), F.lit(0.0))
    pairs = li.groupBy(F.col("l_suppkey").alias("target"), F.col("l_partkey").alias("gene_id")).agg(state("F").alias("x"), state("O").alias("y"))
    return transfer.pooled_slope(pairs, ["target"]).select("target", r("slope").alias("slope"))


@query("embedding_norms", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 4) AS energy FROM embeddings")
def embedding_norms(spark, d):
    return R.table(spark, d, "embeddings").select("vec_id", r(S.array_dot("embedding", "embedding"), 4).alias("energy"))
