"""Nested cross-fits of the effects of one context on another.  Targets are suppliers, genes are parts, contexts line states; axes are whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bounded, crossfit
from ..operators.transfer import direction, realise
from . import registry as R
from .calibration import _BASE, _COUNTS, _value, guide_counts_of
from .registry import query, r, sql, stored

MULTIPLIERS = [0.0, 0.1, 1.0, 10.0, float("inf")]
NAMES = ["mean_expression", "difference"]
#: Effects of this size or more are strong.
STRONG = 1.0


def _fold(first: int, k: int):
    return (F.conv(F.substring(F.md5(F.col("target").cast("string").cast("binary")), first, 8), 16, 10).cast("long") % k).cast("int")


def _target_genes(spark: SparkSession, d: str) -> DataFrame:
    """target, gene_id and the counts of the two line states, F and O, null where a state has no line; stored."""
    lines = R.table(spark, d, "lineitem").repartition("l_suppkey", "l_partkey")  # both aggregates are made where these lie
    g = guide_counts_of(lines)
    return stored(g.groupBy("target", "gene_id").agg(*[F.sum(F.when(F.col("context") == c, F.col("count"))).alias(c) for c in "FO"]), "cross-counts")


def _base_cpm(own: DataFrame) -> DataFrame:
    """gene_id, F, O: CPM of each gene in the pool of a line state, null where no target has it."""
    whole = own.agg(*[F.sum(c).alias(f"all_{c}") for c in "FO"])
    pool = own.groupBy("gene_id").agg(*[F.sum(c).alias(c) for c in "FO"])
    return pool.join(F.broadcast(whole), how="cross").select("gene_id", *[(F.col(c) * 1e6 / F.col(f"all_{c}")).alias(c) for c in "FO"])  # one row


def inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, folds, features): effects of F and O of each target, 0 where one is not observed; three outer and two inner folds."""
    pairs, folds, base = pairs_and_base(spark, d)
    logs = base.select("gene_id", *[F.log2(1 + F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in "FO"])
    raw = logs.select("gene_id", ((F.col("F") + F.col("O")) / 2).alias("m"), (F.col("O") - F.col("F")).alias("s"))
    moments = raw.agg(*[f(c).alias(f"{c}_{name}") for c in "ms" for name, f in (("mean", F.avg), ("sd", F.stddev_pop))])
    scaled = raw.join(F.broadcast(moments), how="cross")  # one row
    return pairs, folds, scaled.select("gene_id", *[((F.col(c) - F.col(f"{c}_mean")) / F.nullif(F.col(f"{c}_sd"), F.lit(0.0))).alias(n) for c, n in zip("ms", NAMES)])


def pairs_and_base(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, folds, base): those of ``inputs``, and each gene's CPM in both line states.  All that later steps read again is stored."""
    own = _target_genes(spark, d)
    base = stored(_base_cpm(own), "cross-base")
    totals = own.groupBy("target").agg(*[F.sum(c).alias(f"of_{c}") for c in "FO"])
    met = own.where("F IS NOT NULL OR O IS NOT NULL").join(base.select("gene_id", *[F.col(c).alias(f"base_{c}") for c in "FO"]), "gene_id").join(totals, "target")
    effect = lambda c: F.coalesce(F.log((F.col(c) * 1e6 / F.col(f"of_{c}") + 20) / (F.col(f"base_{c}") + 20)), F.lit(0.0))
    pairs = stored(met.select("target", "gene_id", effect("F").alias("x"), effect("O").alias("y")), "cross-pairs").withColumn("strong", F.abs("y") >= STRONG)
    folds = stored(own.select("target").distinct().withColumns({"outer": _fold(1, 3), "inner": _fold(9, 2)}), "cross-folds")
    return pairs, folds, base


def _sums(pairs: DataFrame, folds: DataFrame) -> DataFrame:
    return stored(crossfit.fold_sums(pairs, folds), "cross-sums")


@query("nested_gene_scales", sql(
    g=_COUNTS, b=_BASE,
    gt="SELECT context, target, gene_id, sum(count) AS count FROM g GROUP BY ALL",
    tv=f"SELECT gt.context, target, gt.gene_id, {_value('count', 'sum(count) OVER (PARTITION BY gt.context, target)')} AS value FROM gt JOIN b ON b.context = gt.context AND b.gene_id = gt.gene_id",
    xy="SELECT target, gene_id, coalesce(a.value, 0) AS x, coalesce(o.value, 0) AS y FROM (SELECT * FROM tv WHERE context = 'F') a FULL JOIN (SELECT * FROM tv WHERE context = 'O') o USING (target, gene_id)",
    p="SELECT *, abs(y) >= 1 AS strong, count(*) FILTER (abs(y) >= 1) OVER (PARTITION BY target) >= 10 AS eligible, ('0x' || substr(md5(target::VARCHAR), 1, 8))::BIGINT % 3 AS \"outer\", ('0x' || substr(md5(target::VARCHAR), 9, 8))::BIGINT % 2 AS \"inner\" FROM xy",
    fits="SELECT h.held, l.left_out FROM range(3) h(held), (VALUES (-1), (0), (1)) l(left_out)",
    tr="SELECT held, left_out, q.gene_id, coalesce(sum(x * x), 0) AS xx, coalesce(sum(x * y), 0) AS xy FROM (SELECT DISTINCT gene_id FROM p) q CROSS JOIN fits LEFT JOIN p ON p.gene_id = q.gene_id AND p.\"outer\" <> held AND p.\"inner\" <> left_out GROUP BY ALL",
    pool="SELECT held, left_out, sum(xy) / sum(xx) AS g, coalesce(median(CASE WHEN xx > 1e-12 THEN xx END), 1) AS e FROM tr GROUP BY ALL",
    sc="SELECT tr.held, tr.left_out, gene_id, m, CASE WHEN m = 'infinity'::DOUBLE THEN g ELSE coalesce((xy + m * e * g) / nullif(xx + m * e, 0), g) END AS scale FROM tr JOIN pool USING (held, left_out), (SELECT unnest([0, 0.1, 1, 10, 'infinity'::DOUBLE]) AS m)",
    loss="SELECT sc.held, m, sum((scale * x - y) * (scale * x - y)) / count(*) AS loss FROM p JOIN sc ON p.\"outer\" <> sc.held AND p.\"inner\" = sc.left_out AND p.gene_id = sc.gene_id WHERE strong AND eligible GROUP BY ALL",
    ch="SELECT held, first(m ORDER BY loss, m) AS multiplier, min(loss) AS loss FROM loss GROUP BY held",
    body="SELECT CAST(ch.held AS INTEGER) AS held, CASE WHEN multiplier = 'infinity'::DOUBLE THEN -1 ELSE multiplier END AS multiplier, round(loss, 6) AS loss, count(*) AS n_genes, round(avg(scale), 6) AS mean_scale, round(stddev_pop(scale), 6) AS sd_scale FROM ch JOIN sc ON sc.held = ch.held AND sc.left_out = -1 AND sc.m = multiplier WHERE sc.gene_id IN (SELECT gene_id FROM p WHERE p.\"outer\" <> sc.held) GROUP BY ch.held, multiplier, loss",
))
def nested_gene_scales(spark, d):
    """Per held-out fold the chosen prior (-1: infinite), its loss, and the final scales' number, mean and deviation over the genes of the training targets."""
    pairs, folds, _ = inputs(spark, d)
    chosen, scales = crossfit.gene_scales(_sums(pairs, folds), MULTIPLIERS)
    trained = pairs.join(folds, "target").groupBy("gene_id", "outer").agg(F.count(F.lit(1)).alias("n"))
    trained = trained.join(F.broadcast(folds.select(F.col("outer").alias("held")).distinct()), F.col("outer") != F.col("held")).select("held", "gene_id").distinct()
    summed = scales.join(trained, ["held", "gene_id"], "left_semi").groupBy("held").agg(F.count(F.lit(1)).alias("n_genes"), r(F.avg("scale")).alias("mean_scale"), r(F.stddev_pop("scale")).alias("sd_scale"))
    multiplier = F.when(F.col("multiplier") == float("inf"), -1.0).otherwise(F.col("multiplier")).alias("multiplier")
    return chosen.join(summed, "held").select("held", multiplier, r("loss").alias("loss"), "n_genes", "mean_scale", "sd_scale")


@query("nested_context_model", None)
def nested_context_model(spark, d):
    pairs, folds, features = inputs(spark, d)
    return crossfit.context_model(_sums(pairs, folds), features, NAMES, MULTIPLIERS)


@query("crossfit_errors", None)
def crossfit_errors(spark, d):
    """Error over energy of all held-out targets by model."""
    pairs, folds, features = inputs(spark, d)
    sums = _sums(pairs, folds)
    _, scales = crossfit.gene_scales(sums, MULTIPLIERS)
    betas = crossfit.context_model(sums, features, NAMES, MULTIPLIERS)
    found = crossfit.predictions(pairs, folds, scales, betas, crossfit.pooled_scales(sums), features, NAMES)
    y = F.col("y")
    return found.groupBy("target").agg(F.sum(y * y).alias("energy"), *[F.sum((F.col(c) - y) * (F.col(c) - y)).alias(c) for c in ("one_scale", "gene_scales", "context")])


@query("bootstrap_context_model", None)
def bootstrap_context_model(spark, d):
    pairs, folds, features = inputs(spark, d)
    betas = crossfit.context_model(_sums(pairs, folds), features, NAMES, MULTIPLIERS)
    return crossfit.bootstrap_context(pairs, folds, features, NAMES, betas)


@query("bootstrap_gene_scales", None)
def bootstrap_gene_scales(spark, d):
    pairs, folds, _ = inputs(spark, d)
    sums = _sums(pairs, folds)
    chosen, _ = crossfit.gene_scales(sums, MULTIPLIERS)
    energy = crossfit._pooled(crossfit.training_sums(sums)).where(F.col("left_out") == crossfit.NONE).select("held", "energy")
    return crossfit.bootstrap_genes(pairs, folds, chosen.join(energy, "held"))


@query("imputed_ridge", None)
def imputed_ridge(spark, d):
    """Each supplier's scale of O on F, from its size, balance, spread and share of returned lines; spreads of single lines are missing."""
    pairs, folds, _ = inputs(spark, d)
    scale = pairs.groupBy("target").agg((F.sum(F.col("x") * F.col("y")) / F.nullif(F.sum(F.col("x") * F.col("x")), F.lit(0.0))).alias("scale"))
    lines = R.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("target")).agg(F.log(F.count(F.lit(1)).cast("double")).alias("size"), F.stddev_samp("l_discount").alias("spread"), F.avg((F.col("l_returnflag") == "R").cast("double")).alias("returned"))
    balance = R.table(spark, d, "supplier").select(F.col("s_suppkey").alias("target"), F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")).alias("balance"))
    rows = lines.join(balance, "target", "left").join(scale, "target").join(folds.select("target", F.col("outer").alias("fold")), "target")
    rows = stored(rows, "cross-ridge")
    names = ["size", "spread", "returned", "balance"]
    found = crossfit.ridge_predictions(rows, crossfit.imputed_ridge(rows, names, "scale", 1.0), names)
    return found.select("target", "fold", r("scale").alias("scale"), r("predicted").alias("predicted"))


def _closed(change):
    """The effect on a gene of expression ``base`` of a change in the logarithm, clipped where expression would be negative."""
    return direction(realise(F.col("base"), change), F.col("base"))


def _fold_rows(spark: SparkSession, d: str) -> DataFrame:
    """outer, x, y, base (CPM of the gene in O), shared (mean x of the gene, its own perturbation left out) and specific (x less it)."""
    pairs, folds, both = pairs_and_base(spark, d)
    base = both.where("O IS NOT NULL").select("gene_id", F.col("O").alias("base"))
    shared = pairs.where("target <> gene_id").groupBy("gene_id").agg(F.avg("x").alias("shared"))
    rows = pairs.join(base.join(shared, "gene_id", "left").na.fill(0.0, ["shared"]), "gene_id").join(folds.select("target", "outer"), "target")
    return stored(rows.select("outer", "x", "y", "base", "shared", (F.col("x") - F.col("shared")).alias("specific")), "cross-rows")


@query("fold_change_scale", None)
def fold_change_scale(spark, d):
    """Each fold's scale of the source's effects, fitted to the others in fold-change space between 0 and 1.5."""
    found = bounded.bounded_fit(_fold_rows(spark, d), "outer", "y", lambda a: _closed(a * F.col("x")), [(0.0, 1.5)])
    return found.select("outer", r(F.get("parameters", F.lit(0)), 4).alias("scale"), r("loss").alias("loss"))


@query("shared_specific_fit", None)
def shared_specific_fit(spark, d):
    """Each fold's weights of the specific and the shared part, between 0 and 2."""
    found = bounded.bounded_fit(_fold_rows(spark, d), "outer", "y", lambda a, b: _closed(a * F.col("specific") + b * F.col("shared")), [(0.0, 2.0), (0.0, 2.0)], 1e-3)
    return found.select("outer", r(F.get("parameters", F.lit(0)), 3).alias("specific"), r(F.get("parameters", F.lit(1)), 3).alias("shared"), r("loss").alias("loss"))
