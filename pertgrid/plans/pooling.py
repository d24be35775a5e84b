"""Queries: pooling, normalisation, ranks and selection."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import audits, effects, pooling, ranks, signatures
from ..sources import readers
from . import registry as R
from .registry import CONTROL, query, r, sql

_LFC = "log2((CASE WHEN t.cpm IS NULL THEN 0 ELSE t.cpm END + 1e-9) / (coalesce(c.cpm, 0) + 1e-9))"


@query("pseudobulk_lfc", sql("cells", body=f"""
, pools AS (SELECT target, gene_id, sum(count) AS count FROM cells GROUP BY ALL), p AS (SELECT *, count / (sum(count) OVER (PARTITION BY target) / 1e6) AS cpm FROM pools),
grid AS (SELECT * FROM (SELECT DISTINCT target FROM p WHERE target <> '{CONTROL}') CROSS JOIN (SELECT DISTINCT gene_id FROM p)),
e AS (SELECT g.target, g.gene_id, coalesce(t.cpm, 0) AS cpm, coalesce(c.cpm, 0) AS control_cpm, {_LFC} AS lfc FROM grid g LEFT JOIN p t ON t.target = g.target AND t.gene_id = g.gene_id LEFT JOIN p c ON c.target = '{CONTROL}' AND c.gene_id = g.gene_id)
SELECT target, gene_id, round(cpm, 6) AS cpm, round(control_cpm, 6) AS control_cpm, round(lfc, 6) AS lfc, row_number() OVER (PARTITION BY target ORDER BY abs(round(lfc, 6)) DESC, gene_id) AS rank FROM e QUALIFY rank <= 20"""))  # fmt: skip
def pseudobulk_lfc(spark, d):
    pools = pooling.pool_sums(R.cells(spark, d), ["target"])
    e = effects.pseudobulk_effects(pools, CONTROL).select("target", "gene_id", r("cpm").alias("cpm"), r("control_cpm").alias("control_cpm"), r("lfc").alias("lfc"))
    return ranks.top_k(e, 20, ["target"], F.abs("lfc").desc(), F.col("gene_id")).withColumn("rank", F.col("rank").cast("long"))


@query("pool_target", sql("cells", body="SELECT target, gene_id, CAST(sum(count) AS BIGINT) AS count, count(DISTINCT row_id) AS n_rows FROM cells GROUP BY ALL"))
def pool_target(spark, d):
    return pooling.pool(R.cells(spark, d), ["target"])


@query("pool_levels", sql("cells", body="""
SELECT CASE WHEN grouping(guide) = 0 AND grouping(target) = 0 THEN 'guide' WHEN grouping(batch) = 0 THEN 'target_batch' ELSE 'target' END AS level, target, guide, coalesce(batch, 0) AS batch, gene_id, CAST(sum(count) AS BIGINT) AS count
FROM cells GROUP BY GROUPING SETS ((target, gene_id), (target, guide, gene_id), (target, batch, gene_id))"""))
def pool_levels(spark, d):
    cells = R.spread(R.cells(spark, d, dealt=True), R.table(spark, d, "lineitem").count(), "gene_id")
    return pooling.pool_levels(cells, {"target": ["target"], "guide": ["target", "guide"], "target_batch": ["target", "batch"]}).na.fill(0, ["batch"])


@query("pool_conservation", sql("cells", body="SELECT unnest(['target', 'guide', 'target_batch']) AS level, CAST(sum(count) AS BIGINT) AS total FROM cells"))
def pool_conservation(spark, d):
    return pooling.conservation(pool_levels(spark, d))


@query("merge_shards", sql("cells", body="SELECT target, gene_id, CAST(sum(count) AS BIGINT) AS count FROM cells GROUP BY ALL"))
def merge_shards(spark, d):
    c = R.cells(spark, d)
    return pooling.merge_shards(*[pooling.pool_sums(c.where(F.col("row_id") % 3 == k), ["target"]) for k in range(3)], keys=["target"])


@query("pool_guides_to_targets", sql("cells", body="SELECT target, gene_id, CAST(sum(count) AS BIGINT) AS count FROM cells GROUP BY ALL"))
def pool_guides_to_targets(spark, d):
    return pooling.pool_guides_to_targets(pooling.pool_sums(R.cells(spark, d), ["target", "guide"]))


@query("pool_totals_differ", sql("cells", body="SELECT target, CAST(sum(count) AS BIGINT) AS left_total, CAST(sum(count) FILTER (batch <> 1998) AS BIGINT) AS right_total FROM cells GROUP BY target"))
def pool_totals_differ(spark, d):
    c = R.cells(spark, d)
    return pooling.totals_differ(pooling.pool_sums(c, ["target"]), pooling.pool_sums(c.where("batch <> 1998"), ["target"]), ["target"])


@query("collapse_symbols", sql("counts", "genes", body="SELECT row_id, symbol, (SELECT min(pos) FROM genes x WHERE x.symbol = g.symbol) AS pos, CAST(sum(count) AS BIGINT) AS count FROM counts JOIN genes g USING (gene_id) GROUP BY row_id, symbol"))
def collapse_symbols(spark, d):
    lines = R.table(spark, d, "lineitem")
    return pooling.collapse_symbols(R.counts(spark, d, dealt=True), R.genes(spark, d), R.parts(spark, lines.count()))


@query("row_totals", sql("counts", body="SELECT row_id, CAST(sum(count) AS BIGINT) AS total, count(*) FILTER (count > 0) AS n_genes FROM counts GROUP BY row_id"))
def row_totals(spark, d):
    return pooling.row_totals(R.counts(spark, d))


@query("strata", sql("cells", body="SELECT target, guide, batch, count(DISTINCT row_id) AS n_cells, CAST(sum(count) AS BIGINT) AS total FROM cells GROUP BY ALL"))
def strata(spark, d):
    return pooling.strata(R.cells(spark, d), ["target", "guide", "batch"])


@query("weighted_flags", sql("obs", body="SELECT guide, CAST(sum(batch) AS BIGINT) AS weight, round(avg(CASE WHEN batch > 1997 THEN 1.0::DOUBLE ELSE 0 END), 6) AS flag_share FROM obs GROUP BY guide"))
def weighted_flags(spark, d):
    o = R.obs(spark, d).withColumn("late", F.col("batch") > 1997)
    return pooling.weighted_flags(o, "guide", "batch", "late").withColumn("flag_share", r("flag_share"))


def _ragged(spark, d):
    c = R.cells(spark, d).groupBy("row_id", "target", "guide", "batch").agg(F.collect_list("gene_id").alias("gene_token_id"), F.collect_list("count").alias("gene_expression"))
    return c.select("row_id", F.col("target").alias("gene_target"), F.col("guide").alias("guide_target"), (F.col("batch") != 1996).cast("int").alias("pass_guide_filter"), "gene_token_id", "gene_expression")


@query("ragged_pool", sql("cells", body=f"SELECT target AS gene_target, gene_id, CAST(sum(count) AS BIGINT) AS count FROM cells WHERE batch <> 1996 AND target IN ('1-URGENT', '2-HIGH', '{CONTROL}') GROUP BY ALL"))
def ragged_pool(spark, d):
    return pooling.pool_ragged(_ragged(spark, d), ["1-URGENT", "2-HIGH"], CONTROL)


@query("ragged_counters", sql("cells", body=f"SELECT count(*) AS n_input, count(*) FILTER (batch <> 1996) AS n_passed, count(*) FILTER (batch <> 1996 AND target IN ('1-URGENT', '2-HIGH', '{CONTROL}')) AS n_selected, count(*) FILTER (batch <> 1996 AND target = '{CONTROL}') AS n_control FROM (SELECT DISTINCT row_id, target, batch FROM cells)"))
def ragged_counters(spark, d):
    return pooling.ragged_counters(_ragged(spark, d), ["1-URGENT", "2-HIGH"], CONTROL)


@query("ragged_scan", sql("counts", body="SELECT row_id, gene_id, count FROM counts"))
def ragged_scan(spark, d):
    return readers.ragged_counts(_ragged(spark, d).select("row_id", "gene_token_id", "gene_expression").unionByName(
        R.counts(spark, d).join(R.obs(spark, d), "row_id", "left_anti").groupBy("row_id").agg(F.collect_list("gene_id").alias("gene_token_id"), F.collect_list("count").alias("gene_expression"))), "row_id", "gene_token_id", "gene_expression")


@query("dense_embedding_long", "SELECT vec_id AS row_id, generate_subscripts(embedding, 1) - 1 AS gene_id, round(unnest(embedding)::DOUBLE, 6) AS count FROM embeddings")
def dense_embedding_long(spark, d):
    return readers.dense_rows(R.table(spark, d, "embeddings"), "vec_id", "embedding").select("row_id", F.col("gene_id").cast("long").alias("gene_id"), r(F.col("count").cast("double")).alias("count"))


@query("contiguous_runs", "WITH x AS (SELECT DISTINCT l_suppkey * 64 + CAST(l_quantity AS BIGINT) AS x FROM lineitem), g AS (SELECT x, x - row_number() OVER (ORDER BY x) AS k FROM x) SELECT min(x) AS first, max(x) + 1 AS last FROM g GROUP BY k")
def contiguous_runs(spark, d):
    return readers.contiguous_runs(R.table(spark, d, "lineitem").select((F.col("l_suppkey") * 64 + F.col("l_quantity").cast("long")).alias("x")), "x")


@query("category_histogram", "SELECT n_name AS category, count(c_custkey) AS n_cells FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")
def category_histogram(spark, d):
    codes = R.table(spark, d, "customer").select(F.col("c_nationkey").alias("code"))
    return readers.category_histogram(codes, R.table(spark, d, "nation").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("category")))


@query("categorical_decode", "SELECT c_custkey, n_name AS category FROM customer JOIN nation ON c_nationkey = n_nationkey")
def categorical_decode(spark, d):
    codes = R.table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("code"))
    return readers.categorical(codes, R.table(spark, d, "nation").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("category"))).select("c_custkey", "category")


@query("author_cell_counts", "SELECT upper(trim(o_orderpriority)) AS target, CASE WHEN upper(trim(o_orderpriority)) = '5-LOW' THEN 'control' WHEN regexp_matches(upper(trim(o_orderpriority)), '[,;+]') THEN 'several' ELSE 'single' END AS kind, count(*) AS n_cells FROM orders GROUP BY ALL")
def author_cell_counts(spark, d):
    return readers.author_cell_counts(R.table(spark, d, "orders"), "o_orderpriority", [CONTROL])


@query("reconstructed_counts", "SELECT l_suppkey, CAST(round_even(avg(l_quantity) * count(*), 0) AS BIGINT) AS count, round(abs(avg(l_quantity) * count(*) - round_even(avg(l_quantity) * count(*), 0)), 6) AS distance FROM lineitem GROUP BY l_suppkey")
def reconstructed_counts(spark, d):
    m = R.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("mean"), F.count(F.lit(1)).alias("n"))
    return readers.reconstructed_counts(m, "mean", "n").select("l_suppkey", "count", r("distance").alias("distance"))


@query("memberships", "WITH m AS (SELECT s_nationkey AS complex, CAST(s_suppkey AS VARCHAR) AS gene FROM supplier) SELECT complex, gene FROM m WHERE complex IN (SELECT complex FROM m GROUP BY complex HAVING count(*) >= 2)")
def memberships(spark, d):
    s = R.table(spark, d, "supplier")
    packed = s.groupBy(F.col("s_nationkey").alias("complex")).agg(F.array_join(F.collect_list(F.col("s_suppkey").cast("string")), ";").alias("subunits"))
    return readers.memberships(packed, "complex", "subunits", s.select(F.col("s_suppkey").cast("string").alias("gene"))).select("complex", "gene")


@query("grid_from_long", "SELECT n.n_nationkey AS nation, s.seg AS segment, round(x.v, 6) AS v FROM nation n CROSS JOIN (SELECT DISTINCT c_mktsegment AS seg FROM customer) s LEFT JOIN (SELECT c_nationkey, c_mktsegment, max(c_acctbal) AS v FROM customer GROUP BY ALL) x ON x.c_nationkey = n.n_nationkey AND x.c_mktsegment = s.seg")
def grid_from_long(spark, d):
    c = R.table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), "c_acctbal")
    v = c.groupBy("nation", "segment").agg(F.max("c_acctbal").alias("v"))
    return readers.grid_from_long(v, R.table(spark, d, "nation").select(F.col("n_nationkey").alias("nation")), c, "nation", "segment", "v").withColumn("v", r("v"))


@query("scalar_cpm", sql("counts", body="SELECT row_id, gene_id, round(count / (sum(count) OVER w / 1e6), 6) AS cpm, round(ln(1 + count * 1e4 / sum(count) OVER w), 6) AS cp10k, round(ln(1 + count * 5e4 / sum(count) OVER w), 6) AS profile FROM counts WINDOW w AS (PARTITION BY row_id)"))
def scalar_cpm(spark, d):
    total = F.sum("count").over(Window.partitionBy("row_id"))
    c = R.counts(spark, d).withColumn("total", total)
    return c.select("row_id", "gene_id", r(S.cpm("count", "total")).alias("cpm"), r(S.log1p_cp10k("count", "total")).alias("cp10k"), r(S.log_pseudobulk("count", "total")).alias("profile"))


@query("panel_closure", sql("counts", body="SELECT row_id, gene_id, round(count / (sum(count) OVER (PARTITION BY row_id) / 1e6), 6) AS cpm FROM counts WHERE gene_id % 10 < 4"))
def panel_closure(spark, d):
    c = R.counts(spark, d)
    return effects.with_cpm(c, ["row_id"], R.genes(spark, d).where("gene_id % 10 < 4")).select("row_id", "gene_id", r("cpm").alias("cpm"))


@query("scalar_arithmetic", "SELECT l_orderkey, l_linenumber, l_partkey, round(greatest(-2.0, least(2.0, (l_quantity - 25) / sqrt(25 + 25 * 25 / 10.0))), 6) AS residual, round(log2((l_quantity + 1e-9) / (l_tax + 1e-9)), 6) AS ratio, sign(l_discount - l_tax) = sign(l_tax - 0.04) AS agrees, round(ln(1 + l_quantity / 20), 6) AS profile, round(ln(exp(l_quantity / 10) - 1), 6) AS inverse, CASE WHEN l_tax <> 0 THEN round(l_discount / l_tax, 6) END AS guarded FROM lineitem")
def scalar_arithmetic(spark, d):
    li = R.table(spark, d, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", r(S.pearson_residual("l_quantity", F.lit(25.0), 10.0, 2.0)).alias("residual"), r(S.log2_ratio("l_quantity", "l_tax")).alias("ratio"),
        S.sign_agrees(F.col("l_discount") - F.col("l_tax"), F.col("l_tax") - 0.04).alias("agrees"), r(S.log_profile("l_quantity")).alias("profile"), r(S.softplus_inverse(F.col("l_quantity") / 10)).alias("inverse"), r(S.safe_divide("l_discount", "l_tax")).alias("guarded"),
    )


@query("scalar_labels", """
SELECT p_partkey, upper(trim(p_name)) AS symbol, CASE WHEN lower(p_brand || '_P1-' || p_size) LIKE 'non-targeting%' THEN 'Non-Targeting' ELSE p_brand END AS target,
  CASE p_partkey % 3 WHEN 0 THEN 'P1' WHEN 1 THEN 'P1P2' ELSE 'P1+P2' END AS promoter, p_type AS population, CAST(p_partkey % 10 AS INT) AS batch, p_name AS stripped,
  p_partkey % 3 = 0 AS flag, CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE -1 END AS number, '["' || p_partkey || '","' || p_brand || '"]' AS identity
FROM part""")  # fmt: skip
def scalar_labels(spark, d):
    p = R.table(spark, d, "part")
    mark = F.when(F.col("p_partkey") % 3 == 0, "_P1-1|x_P1-2").when(F.col("p_partkey") % 3 == 1, "_P1P2-1|x_P1P2-2").otherwise("_P2-1|x_P1-2")
    guide = F.concat("p_brand", mark)
    return p.select(
        "p_partkey", S.normalize_symbol(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("symbol"), S.guide_target(guide).alias("target"), S.promoter_class(guide).alias("promoter"),
        S.population_part(F.concat(F.lit("a_"), "p_type", F.lit("_b_c"))).alias("population"), S.batch_number(F.concat(F.lit("x Flex_"), (F.col("p_partkey") % 10).cast("string"))).alias("batch"),
        S.strip_suffix(F.concat("p_name", F.lit(" (clone 7)"))).alias("stripped"), S.lenient_bool(F.when(F.col("p_partkey") % 3 == 0, " Yes ").otherwise("no")).alias("flag"),
        F.coalesce(S.nullable_int(F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string")).otherwise("")).cast("int"), F.lit(-1)).alias("number"), S.canonical_json("p_partkey", "p_brand").alias("identity"),
    )


@query("scalar_hashes", """
WITH h AS (SELECT c_custkey, c_name, sha256(c_name) AS s, sha256('0:' || c_name) AS o FROM customer)
SELECT c_custkey, CAST(('0x' || substr(s, 16, 1))::INT % 4 AS INT) AS bucket, CAST(('0x' || substr(s, 2, 1))::INT % 2 AS INT) AS bit, o AS hash_order, round((('0x' || substr(o, 1, 12))::BIGINT + 0.5) / 281474976710656.0, 6) AS u FROM h""")
def scalar_hashes(spark, d):
    c = R.table(spark, d, "customer")
    return c.select("c_custkey", S.sha_bucket("c_name").alias("bucket"), S.sha_bit("c_name").alias("bit"), S.hash_order("c_name").alias("hash_order"), r(S.hash_uniform("c_name")).alias("u"))


@query("embedding_cosine", """
SELECT a.vec_id AS i, b.vec_id AS j, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS cosine
FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id""")
def embedding_cosine(spark, d):
    found = signatures.cosine_pairs(R.table(spark, d, "embeddings"), "vec_id", "embedding", "label")
    return found.select("i", "j", r("cosine").alias("cosine"))


@query("evidence_tiers", sql("obs", body="SELECT guide, batch, count(*) AS n, CASE WHEN count(*) < 10 THEN 'insufficient' WHEN count(*) <= 30 THEN 'exploratory' WHEN count(*) <= 100 THEN 'usable' ELSE 'standard' END AS tier FROM obs GROUP BY guide, batch"))
def evidence_tiers(spark, d):
    return R.obs(spark, d).groupBy("guide", "batch").agg(F.count(F.lit(1)).alias("n")).withColumn("tier", S.evidence_tier("n"))


@query("midrank", sql("counts", body="SELECT row_id, gene_id, rank() OVER (PARTITION BY gene_id ORDER BY count) + (count(*) OVER (PARTITION BY gene_id, count) - 1) / 2.0::DOUBLE AS midrank FROM counts"))
def midrank(spark, d):
    return R.counts(spark, d).select("row_id", "gene_id", ranks.midrank("count", "gene_id").alias("midrank"))


@query("tolerant_rank", sql("observations", body=", o AS (SELECT gene, min(context) AS own FROM observations GROUP BY gene), m AS (SELECT x.gene, x.n_cells, x.context = o.own AS is_own, max(CASE WHEN x.context = o.own THEN x.n_cells END) OVER (PARTITION BY x.gene) AS v FROM observations x JOIN o USING (gene)) SELECT gene, count(*) FILTER (n_cells > v) + 0.5::DOUBLE * (count(*) FILTER (n_cells = v) - 1) AS rank0, count(*) AS n FROM m GROUP BY gene"))
def tolerant_rank(spark, d):
    o = R.observations(spark, d)
    own = F.col("context") == F.min("context").over(Window.partitionBy("gene"))
    return ranks.tolerant_rank(o.withColumn("own", own).withColumn("v", F.col("n_cells").cast("double")), "gene", "context", "v", F.col("own"))


@query("top_k_genes", sql("cells", body=", p AS (SELECT guide, gene_id, CAST(sum(count) AS BIGINT) AS count FROM cells GROUP BY ALL) SELECT guide, gene_id, count, row_number() OVER (PARTITION BY guide ORDER BY count DESC, gene_id) AS rank FROM p QUALIFY rank <= 50"))
def top_k_genes(spark, d):
    p = pooling.pool_sums(R.cells(spark, d), ["guide"])
    return ranks.top_k(p, 50, ["guide"], F.col("count").desc(), F.col("gene_id")).withColumn("rank", F.col("rank").cast("long"))


@query("second_best_context", sql("observations", body="SELECT gene, context, n_cells FROM observations QUALIFY row_number() OVER (PARTITION BY gene ORDER BY n_cells DESC, context) = 2"))
def second_best_context(spark, d):
    return ranks.nth_best(R.observations(spark, d), 2, ["gene"], F.col("n_cells").desc(), F.col("context")).select("gene", "context", "n_cells")


@query("bottom_k_random_ties", sql("observations", body="SELECT context, gene, n_cells FROM observations QUALIFY row_number() OVER (PARTITION BY context ORDER BY n_cells, sha256('0:' || gene)) <= 10"))
def bottom_k_random_ties(spark, d):
    return ranks.bottom_k_random_ties(R.observations(spark, d), 10, ["context"], "n_cells", "gene").select("context", "gene", "n_cells")


_P = "SELECT l_suppkey AS k, l_partkey AS item, min(l_discount + l_quantity / 100) AS p FROM lineitem GROUP BY ALL"


def _p_values(spark, d):
    return R.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("item")).agg(F.min(F.col("l_discount") + F.col("l_quantity") / 100).alias("p"))


@query("benjamini_hochberg", f"WITH x AS ({_P}), y AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p, item) AS rn, count(*) OVER (PARTITION BY k) AS m FROM x) SELECT k, item, round(least(1.0, min(p * m / rn) OVER (PARTITION BY k ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS p_adj FROM y")
def benjamini_hochberg(spark, d):
    return ranks.benjamini_hochberg(_p_values(spark, d), "p", ["k"], tie="item").select("k", "item", r("p_adj").alias("p_adj"))


@query("holm", f"WITH x AS ({_P}), y AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p, item) AS rn, count(*) OVER (PARTITION BY k) AS m FROM x) SELECT k, item, round(least(1.0, max(p * (m - rn + 1)) OVER (PARTITION BY k ORDER BY rn ROWS UNBOUNDED PRECEDING)), 6) AS p_holm FROM y")
def holm(spark, d):
    return ranks.holm(_p_values(spark, d), "p", ["k"], tie="item").select("k", "item", r("p_holm").alias("p_holm"))


@query("weighted_median", "WITH x AS (SELECT l_suppkey, l_extendedprice AS v, sum(l_quantity) AS w FROM lineitem GROUP BY ALL), y AS (SELECT *, sum(w) OVER (PARTITION BY l_suppkey ORDER BY v) AS cum, sum(w) OVER (PARTITION BY l_suppkey) AS tot FROM x) SELECT l_suppkey, round(min(v), 6) AS weighted_median FROM y WHERE cum >= tot / 2 GROUP BY l_suppkey")
def weighted_median(spark, d):
    return ranks.weighted_median(R.table(spark, d, "lineitem"), "l_extendedprice", "l_quantity", ["l_suppkey"]).withColumn("weighted_median", r("weighted_median"))


@query("quantile_bins", "SELECT c_custkey, ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS bin FROM customer")
def quantile_bins(spark, d):
    return ranks.quantile_bins(R.table(spark, d, "customer"), "c_acctbal", "c_custkey", 4, ("c_mktsegment",)).select("c_custkey", F.col("bin").cast("long").alias("bin"))


@query("value_deciles", "WITH e AS (SELECT list_distinct(quantile_cont(c_acctbal, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1])) AS q FROM customer) SELECT c_custkey, greatest(1, len(list_filter(q, lambda x: x < c_acctbal))) AS bin FROM customer, e")
def value_deciles(spark, d):
    c = R.table(spark, d, "customer")
    return c.select("c_custkey", ranks.cut("c_acctbal", ranks.value_edges(c, "c_acctbal", 10)).cast("long").alias("bin"))


@query("permute_within", "WITH a AS (SELECT c_custkey, c_mktsegment, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS i, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('0:' || c_custkey)) AS h FROM customer) SELECT a.c_custkey, round(b.c_acctbal, 6) AS permuted FROM a JOIN a b ON a.c_mktsegment = b.c_mktsegment AND a.i = b.h")
def permute_within(spark, d):
    return ranks.permute_within(R.table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), ["c_mktsegment"], "c_custkey", "c_acctbal").select("c_custkey", r("permuted").alias("permuted"))


@query("reach", "WITH x AS (SELECT l_suppkey, row_number() OVER w AS rn, avg(CASE WHEN l_quantity > 10 THEN 1.0 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS s FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey)) SELECT l_suppkey, CAST(coalesce(max(rn) FILTER (s >= 0.9 - 1e-12), 0) AS BIGINT) AS reach, count(*) AS n FROM x GROUP BY l_suppkey")
def reach(spark, d):
    li = R.table(spark, d, "lineitem").withColumn("hit", F.col("l_quantity") > 10)
    return ranks.reach(li, ["l_suppkey"], "hit", F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")).withColumn("reach", F.col("reach").cast("long"))


@query("boundaries", "SELECT o_orderkey, coalesce(o_orderstatus IS DISTINCT FROM lag(o_orderstatus) OVER w, true) OR row_number() OVER w = 1 AS is_boundary FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def boundaries(spark, d):
    return R.table(spark, d, "orders").select("o_orderkey", ranks.boundary("o_orderstatus", "o_orderdate", "o_orderkey", keys=("o_custkey",)).alias("is_boundary"))


@query("crossing_counts", "WITH x AS (SELECT l_partkey, l_suppkey, sum(l_discount) AS v FROM lineitem GROUP BY ALL), y AS (SELECT l_partkey, l_suppkey, floor(sum(v) OVER w - 0.37 + 1e-9) AS f, row_number() OVER w AS rn FROM x WINDOW w AS (PARTITION BY l_partkey ORDER BY sha256('0:' || l_partkey || ':' || l_suppkey))) SELECT l_partkey, l_suppkey, CAST(f - coalesce(lag(f) OVER (PARTITION BY l_partkey ORDER BY rn), -1) AS BIGINT) AS drawn FROM y")
def crossing_counts(spark, d):
    x = R.table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_discount").alias("v"))
    return ranks.crossing_counts(x, ["l_partkey"], "v", "l_suppkey", F.lit(0.37 - 1e-9)).select("l_partkey", "l_suppkey", "drawn")


@query("audit_table", sql("cells", body="SELECT 'not_counts' AS \"check\", count(*) FILTER (l_discount <> floor(l_discount)) AS n FROM lineitem UNION ALL SELECT 'guide_target', (SELECT count(*) FROM (SELECT guide FROM obs GROUP BY guide HAVING count(DISTINCT target) > 1)) UNION ALL SELECT 'not_unique', (SELECT count(*) FROM (SELECT l_orderkey, l_partkey FROM lineitem GROUP BY ALL HAVING count(*) > 1))"))
def audit_table(spark, d):
    li = R.table(spark, d, "lineitem")
    return audits.check_table({"not_counts": audits.not_counts(li, "l_discount"), "guide_target": audits.broken_dependency(R.obs(spark, d), "guide", "target"), "not_unique": audits.not_unique(li, ["l_orderkey", "l_partkey"])})


@query("audit_totals", sql("counts", body="SELECT o.o_orderkey AS row_id, 100 AS declared, coalesce(s.total, 0) AS total FROM orders o LEFT JOIN (SELECT row_id, CAST(sum(count) AS BIGINT) AS total FROM counts GROUP BY row_id) s ON s.row_id = o.o_orderkey WHERE coalesce(s.total, 0) <> 100"))
def audit_totals(spark, d):
    o = R.obs(spark, d).withColumn("n", F.lit(100))
    return audits.total_mismatch(R.counts(spark, d), o, "n")


@query("audit_coverage", "SELECT n_nationkey AS k, 'missing' AS problem FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) UNION ALL SELECT DISTINCT s_nationkey, 'extra' FROM supplier WHERE s_acctbal > 5000 AND s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey < 50)")
def audit_coverage(spark, d):
    have = R.table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))
    return audits.coverage_gaps(have, R.table(spark, d, "nation").select(F.col("n_nationkey").alias("k")), "k")


@query("trace_deltas", "WITH t AS (SELECT date_trunc('month', o_orderdate) AS step, sum(o_totalprice) AS v FROM orders GROUP BY ALL) SELECT step, round(v - lag(v) OVER w, 4) AS delta, round(abs(v - lag(v) OVER w) / abs(lag(v) OVER w), 6) AS relative, coalesce(v - lag(v) OVER w < 0, false) AS falls FROM t WINDOW w AS (ORDER BY step)")
def trace_deltas(spark, d):
    t = R.table(spark, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("step")).agg(F.sum("o_totalprice").alias("v"))
    return audits.trace_deltas(t, "step", "v").select("step", r("delta", 4).alias("delta"), r("relative").alias("relative"), "falls")


@query("table_digest", None)
def table_digest(spark, d):
    return audits.table_digest(R.table(spark, d, "lineitem"))
