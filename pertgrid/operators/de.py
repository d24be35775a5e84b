"""Differential expression of cells against controls.

Mann-Whitney statistics are counted against the control distribution of each gene, without ranking every
group anew: per gene and value the numbers of controls below and equal are window sums over the distinct
values, and the implicit zeros enter as one block in closed form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions.scalar import hash_order, log2_ratio, normal_two_sided, safe_divide
from .ranks import benjamini_hochberg, hash_ranks


def cell_cpm(cells: DataFrame) -> DataFrame:
    """Per-cell CPM over the whole gene axis."""
    total = F.sum("count").over(Window.partitionBy("row_id"))
    return cells.withColumn("value", F.col("count").cast("double") / (total.cast("double") / config.CPM_SCALE))


def mean_table(values: DataFrame, obs: DataFrame, group: str, control: str) -> DataFrame:
    """(group, gene_id, target_mean, control_mean, n_target, n_control, pct_target, pct_control): cell-equal means; absent cells are 0."""
    sizes = obs.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    sums = values.groupBy(group, "gene_id").agg(F.sum("value").alias("s"), F.count_if(F.col("value") > 0).alias("expressed"))
    genes = sums.select("gene_id").distinct()
    ctrl = sums.where(F.col(group) == control).select("gene_id", F.col("s").alias("cs"), F.col("expressed").alias("ce"))
    n_control = sizes.where(F.col(group) == control).select(F.col("n").alias("n_control"))
    grid = sizes.where(F.col(group) != control).join(n_control, how="cross").join(genes, how="cross")
    full = grid.join(sums, [group, "gene_id"], "left").join(ctrl, "gene_id", "left").na.fill(0, ["s", "cs", "expressed", "ce"])
    return full.select(
        group, "gene_id",
        (F.col("s") / F.col("n")).alias("target_mean"), safe_divide(F.col("cs"), F.col("n_control")).alias("control_mean"),
        F.col("n").alias("n_target"), "n_control",
        (F.col("expressed") / F.col("n")).alias("pct_target"), safe_divide(F.col("ce"), F.col("n_control")).alias("pct_control"),
    )


def gate(means: DataFrame, threshold: float = config.EXPRESSION_GATE) -> DataFrame:
    """Genes whose control mean is above the threshold; one universe for all groups."""
    return means.where(F.col("control_mean") > threshold)


def mann_whitney(values: DataFrame, obs: DataFrame, group: str, control: str) -> DataFrame:
    """(group, gene_id, u, tie_term, n_target, n_control, auc, z) for every group and gene seen in it or in the controls.

    ``values`` has positive values only; absent cells are zeros.  z has the tie-corrected variance and a
    continuity correction of one half; it is null where all values are equal.
    """
    sizes = obs.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    n_c = sizes.where(F.col(group) == control).select(F.col("n").alias("n_control"))
    by_value = values.groupBy("gene_id", "value").agg(F.count_if(F.col(group) == control).alias("eq"))
    below = Window.partitionBy("gene_id").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    by_value = by_value.withColumn("less", F.coalesce(F.sum("eq").over(below), F.lit(0)))
    control_genes = by_value.groupBy("gene_id").agg(F.sum("eq").alias("control_positive"), F.sum(_tie(F.col("eq"))).alias("control_ties"))
    counted = values.where(F.col(group) != control).groupBy(group, "gene_id", "value").agg(F.count(F.lit(1)).alias("k"))
    met = counted.join(by_value, ["gene_id", "value"])
    sums = met.groupBy(group, "gene_id").agg(
        F.sum("k").alias("positive"),
        F.sum(F.col("k") * (F.col("less") + F.col("eq") / 2)).alias("above"),
        F.sum(_tie(F.col("eq") + F.col("k")) - _tie(F.col("eq"))).alias("more_ties"),
    )
    grid = sizes.where(F.col(group) != control).join(n_c, how="cross").join(control_genes, how="cross")
    full = grid.join(sums, [group, "gene_id"], "left").na.fill(0, ["positive", "above", "more_ties"])
    z_c, z_t = F.col("n_control") - F.col("control_positive"), F.col("n") - F.col("positive")
    u = F.col("above") + F.col("positive") * z_c + z_t * z_c / 2
    ties = F.col("control_ties") + F.col("more_ties") + _tie(z_c + z_t)
    total = F.col("n") + F.col("n_control")
    product = F.col("n").cast("double") * F.col("n_control")
    variance = product / 12 * (total + 1 - safe_divide(ties, total * (total - 1)))
    centred = F.col("u") - F.col("product") / 2
    scored = full.select(group, "gene_id", u.cast("double").alias("u"), ties.cast("double").alias("tie_term"), F.col("n").alias("n_target"), "n_control", product.alias("product"), variance.alias("variance"))
    z = F.when(F.col("variance") > 1e-9, F.signum(centred) * F.greatest(F.lit(0.0), F.abs(centred) - 0.5) / F.sqrt("variance"))
    return scored.select(group, "gene_id", "u", "tie_term", "n_target", "n_control", (F.col("u") / F.col("product")).alias("auc"), z.alias("z"))


def _tie(n: Column) -> Column:
    n = n.cast("double")
    return n * n * n - n


def de_table(cells: DataFrame, obs: DataFrame, group: str, control: str, threshold: float = config.EXPRESSION_GATE) -> DataFrame:
    """The DE table: means, log2 fold change, p (normal), BH within each group over gated genes, AUC."""
    values = cell_cpm(cells).select("row_id", group, "gene_id", "value")
    means = gate(mean_table(values, obs, group, control), threshold)
    tests = mann_whitney(values, obs, group, control).select(group, "gene_id", "u", "auc", "z")
    joined = means.join(tests, [group, "gene_id"]).withColumn("p_value", F.coalesce(normal_two_sided("z"), F.lit(1.0)))
    out = joined.withColumn("log2_fold_change", log2_ratio("target_mean", "control_mean"))
    return benjamini_hochberg(out, "p_value", [group], tie="gene_id")


def geometric_de(cells: DataFrame, obs: DataFrame, group: str, control: str) -> DataFrame:
    """Geometric means at CP10K: exp(mean log1p) - 1 with zeros, and their log2 ratio."""
    total = F.sum("count").over(Window.partitionBy("row_id"))
    values = cells.withColumn("value", F.log1p(F.col("count") * 1e4 / total))
    means = mean_table(values, obs, group, control)
    return means.select(group, "gene_id", F.expm1("target_mean").alias("target_geo"), F.expm1("control_mean").alias("control_geo"), log2_ratio(F.expm1("target_mean"), F.expm1("control_mean")).alias("lfc"))


def criteria(table: DataFrame, fdr: float = config.FDR, lfc: float = config.STRONG_LFC, auc: float = 0.6) -> DataFrame:
    """Flags passes_fdr, passes_lfc, passes_auc, passes_any and passes_all."""
    t = (
        table.withColumn("passes_fdr", F.col("p_adj") < fdr)
        .withColumn("passes_lfc", F.abs("log2_fold_change") >= lfc)
        .withColumn("passes_auc", F.greatest(F.col("auc"), 1 - F.col("auc")) >= auc)
    )
    flags = [F.col(c) for c in ("passes_fdr", "passes_lfc", "passes_auc")]
    return t.withColumn("passes_any", flags[0] | flags[1] | flags[2]).withColumn("passes_all", flags[0] & flags[1] & flags[2])


def de_summary(table: DataFrame, group: str, fdr: float = config.FDR) -> DataFrame:
    sig = F.col("p_adj") < fdr
    return table.groupBy(group).agg(
        F.max("n_target").alias("n_cells"),
        F.count_if(sig).alias("n_de"),
        F.count_if(sig & (F.col("log2_fold_change") > 0)).alias("n_up"),
        F.count_if(sig & (F.col("log2_fold_change") < 0)).alias("n_down"),
    )


def threshold_sweep(table: DataFrame, grid: DataFrame, group: str, groups: DataFrame) -> DataFrame:
    """For each (fdr, lfc, auc) of ``grid``: genes called, groups with a call, and the median of calls per group, zeros included.

    ``grid`` is a few rows; each gene row meets each of them once, and calls are summed on the map side.
    """
    called = (F.col("p_adj") < F.col("fdr")) & (F.abs("log2_fold_change") >= F.col("lfc")) & (F.greatest(F.col("auc"), 1 - F.col("auc")) >= F.col("min_auc"))
    calls = table.join(F.broadcast(grid), how="cross").where(called).groupBy("fdr", "lfc", "min_auc", group).agg(F.count(F.lit(1)).alias("calls"))
    every = grid.join(groups.select(group).distinct(), how="cross").join(calls, ["fdr", "lfc", "min_auc", group], "left").na.fill(0, ["calls"])
    return every.groupBy("fdr", "lfc", "min_auc").agg(F.sum("calls").alias("genes"), F.count_if(F.col("calls") > 0).alias("groups"), F.median("calls").alias("median_calls"))


def best_threshold(sweep: DataFrame, null_sweep: DataFrame) -> DataFrame:
    """The grid point with the largest median of calls among those that call nothing in the null; ties to the laxest."""
    keys = ["fdr", "lfc", "min_auc"]
    clean = sweep.join(null_sweep.where("genes = 0").select(*keys), keys, "left_semi")
    return clean.orderBy(F.col("median_calls").desc(), F.col("genes").desc(), F.col("fdr").desc(), "lfc", "min_auc").limit(1)


def random_groups(obs: DataFrame, sizes: list[int], replicates: int, seed: int = 0) -> DataFrame:
    """Disjoint random groups of the given sizes, drawn anew per replicate: (row_id, replicate, size)."""
    reps = obs.select("row_id").withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    ranked = reps.withColumn("rn", F.row_number().over(Window.partitionBy("replicate").orderBy(hash_order("replicate", "row_id", seed=seed))))
    size, end = F.lit(None).cast("int"), 0
    for s in sizes:
        size = F.when((F.col("rn") > end) & (F.col("rn") <= end + s), s).otherwise(size)
        end += s
    return ranked.where(F.col("rn") <= end).select("row_id", "replicate", size.alias("size"))


def subsample(obs: DataFrame, keys: list[str], n: int, replicates: int = 1, seed: int = 0) -> DataFrame:
    """At most n rows per key and replicate in a hash order; smaller groups come whole, in replicate 0 only."""
    sized = obs.select("row_id", *keys).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    reps = sized.withColumn("replicate", F.explode(F.when(F.col("_n") <= n, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(replicates - 1)))))
    rn = F.row_number().over(Window.partitionBy(*keys, "replicate").orderBy(hash_order("replicate", "row_id", seed=seed)))
    return reps.withColumn("rn", rn).where(F.col("rn") <= n).drop("rn", "_n")


def null_floor(summary: DataFrame) -> DataFrame:
    return summary.groupBy("n_cells").agg(F.median("n_de").alias("median_de"), F.min("n_de").alias("min_de"), F.max("n_de").alias("max_de"), F.avg("n_de").alias("mean_de"))


def strong_masks(table: DataFrame, group: str, fdr: float = config.FDR, lfc: float = config.STRONG_LFC) -> DataFrame:
    """strong, weak and all masks; a target's own gene is in none."""
    own = F.col(group).cast("string") == F.col("gene_id").cast("string")
    sig = F.col("p_adj") < fdr
    return table.withColumn("strong", sig & (F.abs("log2_fold_change") >= lfc) & ~own).withColumn("weak", sig & (F.abs("log2_fold_change") < lfc) & ~own).withColumn("all_genes", ~own)


def paired_halves(cells: DataFrame, obs: DataFrame, group: str, splits: int, seed: int = 0) -> DataFrame:
    """CPM sums of the whole group and of half a of each split, all in one pass: (group, gene_id, whole, half_0..)."""
    halves = obs.select("row_id", group)
    for k in range(splits):  # no task orders a group
        halves = hash_ranks(halves, [group], hash_order("row_id", seed=seed + k), ["row_id"], f"in_{k}").withColumn(f"in_{k}", F.col(f"in_{k}") % 2 == 1)
    values = cell_cpm(cells).join(halves.drop(group), "row_id")
    return values.groupBy(group, "gene_id").agg(F.sum("value").alias("whole"), *[F.sum(F.when(F.col(f"in_{k}"), F.col("value")).otherwise(0.0)).alias(f"half_{k}") for k in range(splits)])


def stable_strong(table: DataFrame, halves: DataFrame, keys: list[str], splits: int, need: int, fdr: float = config.FDR, lfc: float = config.STRONG_LFC) -> DataFrame:
    """Significant, large, and with the sign of the fold change in both halves of at least ``need`` splits.

    ``halves`` has for every key lfc_a_k and lfc_b_k of the splits k.
    """
    agree = [F.when((F.signum(f"lfc_a_{k}") == F.signum("log2_fold_change")) & (F.signum(f"lfc_b_{k}") == F.signum("log2_fold_change")), 1).otherwise(0) for k in range(splits)]
    joined = table.join(halves, keys).withColumn("agreeing", sum(agree[1:], agree[0]))
    return joined.withColumn("stable_strong", (F.col("p_adj") < fdr) & (F.abs("log2_fold_change") >= lfc) & (F.col("agreeing") >= need))
