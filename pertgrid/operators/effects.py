"""Effects of groups against a control, and geometry of effect vectors.

A profile is (group, gene_id, count or cpm); an effect relation is (target, gene_id, value).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions.scalar import cpm, log1p_cp10k, log2_ratio, safe_divide


def with_cpm(pools: DataFrame, keys: list[str], genes: DataFrame | None = None) -> DataFrame:
    """CPM of pooled counts.  The denominator is the whole gene axis, or the axis ``genes`` (panel closure) if given."""
    if genes is not None:
        pools = pools.join(genes.select("gene_id").distinct(), "gene_id", "left_semi")
    return pools.withColumn("cpm", cpm("count", F.sum("count").over(Window.partitionBy(*keys))))


def against_control(profiles: DataFrame, target: str, control: str, columns: list[str]) -> DataFrame:
    """Every target's genes beside the control's: an equi join on the gene, both sides filled with 0 where absent."""
    names = [f"control_{c}" for c in columns]
    own = profiles.where(F.col(target) == control).select("gene_id", *[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)])
    genes = profiles.select("gene_id").distinct()
    grid = profiles.where(F.col(target) != control).select(target).distinct().join(genes, how="cross")
    filled = grid.join(profiles.select(target, "gene_id", *columns), [target, "gene_id"], "left").join(own, "gene_id", "left")
    return filled.na.fill(0, [*columns, *names])


def pseudobulk_effects(pools: DataFrame, control: str, epsilon: float = config.LFC_EPSILON) -> DataFrame:
    """(target, gene_id, cpm, control_cpm, lfc, log1p_difference) of summed counts, CPM over the whole axis."""
    both = against_control(with_cpm(pools, ["target"]), "target", control, ["cpm"])
    return both.select("target", "gene_id", "cpm", "control_cpm", log2_ratio("cpm", "control_cpm", epsilon).alias("lfc"), (F.log1p("cpm") - F.log1p("control_cpm")).alias("log1p_difference"))


def dirichlet_lfc(pools: DataFrame, control: str, prior: float = 1e4) -> DataFrame:
    """log2 of the shrunk composition (count + prior * p0) / (total + prior) over the control's p0; 0 where p0 is 0."""
    totals = pools.withColumn("total", F.sum("count").over(Window.partitionBy("target")))
    p = against_control(totals.withColumn("share", F.col("count") / F.col("total")), "target", control, ["count", "share"])
    sums = totals.where(F.col("target") != control).groupBy("target").agg(F.max("total").alias("total"))
    shrunk = (F.col("count") + prior * F.col("control_share")) / (F.col("total") + prior)
    return p.join(sums, "target").select("target", "gene_id", F.when(F.col("control_share") > 0, F.log2(shrunk / F.col("control_share"))).otherwise(0.0).alias("lfc"))


def group_mean_log1p(cells: DataFrame, obs: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over cells of log1p(CP10K); cells without the gene count as 0."""
    total = F.sum("count").over(Window.partitionBy("row_id"))
    values = cells.withColumn("v", log1p_cp10k("count", total))
    n = obs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cells"))
    return values.groupBy(*keys, "gene_id").agg(F.sum("v").alias("s")).join(n, keys).select(*keys, "gene_id", (F.col("s") / F.col("n_cells")).alias("value"), "n_cells")


def unweighted_centroid(means: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over groups of group means, weighted by cells and not."""
    return means.groupBy(*keys, "gene_id").agg(F.avg("value").alias("mean"), (F.sum(F.col("value") * F.col("n_cells")) / F.sum("n_cells")).alias("cell_mean"))


def norms(effects: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    return effects.groupBy(*keys).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("norm"))


def pair_scores(a: DataFrame, b: DataFrame, value: str = "value") -> DataFrame:
    """For every gene-sharing pair (i of a, j of b): dot product and the norms over all genes of each.

    One equi join on the gene, summed by pair on the map side: genes times targets squared rows flow through the join,
    targets squared leave it.  For many targets use ``pair_scores_blocked``.
    """
    left = a.select(F.col("target").alias("i"), "gene_id", F.col(value).alias("x"))
    right = b.select(F.col("target").alias("j"), "gene_id", F.col(value).alias("y"))
    dots = left.join(right, "gene_id").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    ni = a.groupBy(F.col("target").alias("i")).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("norm_i"))
    nj = b.groupBy(F.col("target").alias("j")).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("norm_j"))
    return dots.join(ni, "i").join(nj, "j")


def pair_scores_blocked(a: DataFrame, b: DataFrame, value: str = "value", block: int = 256) -> DataFrame:
    """``pair_scores`` for many targets: vectors meet as blocks of about ``block`` targets, multiplied as matrices.

    A target's vector (at most the gene axis) is one row; each goes to as many tasks as the other side has blocks.
    """

    def vectors(df: DataFrame, name: str) -> DataFrame:
        v = df.groupBy(F.col("target").alias(name)).agg(F.collect_list(F.struct("gene_id", F.col(value).cast("double").alias("v"))).alias("e"))
        n = v.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / block)).cast("int").alias("blocks"))
        return v.join(F.broadcast(n), how="cross").withColumn("block", F.pmod(F.xxhash64(name), F.col("blocks")).cast("int"))

    x, y = vectors(a, "i"), vectors(b, "j")
    bx, by = x.select(F.col("blocks").alias("bx")).limit(1), y.select(F.col("blocks").alias("by")).limit(1)
    left = x.join(F.broadcast(by), how="cross").select(F.col("block").alias("p"), F.explode(F.sequence(F.lit(0), F.col("by") - 1)).alias("q"), F.col("i").cast("long").alias("key"), F.lit(True).alias("is_left"), "e")
    right = y.join(F.broadcast(bx), how="cross").select(F.explode(F.sequence(F.lit(0), F.col("bx") - 1)).alias("p"), F.col("block").alias("q"), F.col("j").cast("long").alias("key"), F.lit(False).alias("is_left"), "e")

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        axis = {g: k for k, g in enumerate(sorted({x["gene_id"] for e in pdf.e for x in e}))}

        def matrix(part: pd.DataFrame) -> np.ndarray:
            m = np.zeros((len(part), len(axis)))
            for k, e in enumerate(part.e):
                for x in e:
                    m[k, axis[x["gene_id"]]] += x["v"]
            return m

        l, r = pdf[pdf.is_left], pdf[~pdf.is_left]  # noqa: E741
        ml, mr = matrix(l), matrix(r)
        nl, nr = np.linalg.norm(ml, axis=1), np.linalg.norm(mr, axis=1)
        i, j = np.repeat(l.key.to_numpy(), len(r)), np.tile(r.key.to_numpy(), len(l))
        return pd.DataFrame({"i": i, "j": j, "dot": (ml @ mr.T).ravel(), "norm_i": np.repeat(nl, len(r)), "norm_j": np.tile(nr, len(l))})

    return left.unionByName(right).groupBy("p", "q").applyInPandas(multiply, "i long, j long, dot double, norm_i double, norm_j double")


def cosine_of(dot: str, a: str, b: str, zero_norm: float | None = None) -> Column:
    return safe_divide(F.col(dot), F.col(a) * F.col(b), zero_norm)


def cosine_pairs(a: DataFrame, b: DataFrame, zero_norm: float | None = None) -> DataFrame:
    return pair_scores(a, b).select("i", "j", cosine_of("dot", "norm_i", "norm_j", zero_norm).alias("cosine"))


def residual_from_axis(effects: DataFrame, axis: DataFrame) -> DataFrame:
    """value - (value . a) a for the unit vector a along ``axis`` (gene_id, value)."""
    length = axis.agg(F.sqrt(F.sum(F.col("value") * F.col("value")))).first()[0] or 1.0
    unit = axis.select("gene_id", (F.col("value") / length).alias("axis"))
    joined = effects.join(unit, "gene_id", "left").na.fill(0.0, ["axis"])
    dot = F.sum(F.col("value") * F.col("axis")).over(Window.partitionBy("target"))
    return joined.select("target", "gene_id", (F.col("value") - dot * F.col("axis")).alias("value"))


def leave_one_out(effects: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean of the other targets per gene, and the residual to it; null for a single target."""
    w = Window.partitionBy(*(keys or ["gene_id"]))
    rest = safe_divide(F.sum("value").over(w) - F.col("value"), F.count("value").over(w) - 1)
    return effects.withColumn("others", rest).withColumn("residual", F.col("value") - F.col("others"))


def leave_one_out_median(values: DataFrame, group: str, item: str, value: str, eligible: Column | None = None) -> DataFrame:
    """Median of the group's eligible values but the own one.

    From the sorted values alone: without place p the median of n - 1 values is found at places shifted by one,
    so no pair of rows is made.
    """
    known = values.where(F.col(value).isNotNull())
    donors = known.where(eligible) if eligible is not None else known
    ranked = donors.select(group, item, value, F.row_number().over(Window.partitionBy(group).orderBy(value, item)).alias("p"), F.count(F.lit(1)).over(Window.partitionBy(group)).alias("n"))
    table = ranked.select(group, F.col("p").alias("place"), F.col(value).alias("v"))
    rows = values.join(ranked.select(group, item, "p"), [group, item], "left").join(ranked.groupBy(group).agg(F.max("n").alias("n")), group, "left")
    left = F.when(F.col("p").isNull(), F.col("n")).otherwise(F.col("n") - 1)
    shift = lambda k: k + F.when(F.col("p").isNotNull() & (k >= F.col("p")), 1).otherwise(0)
    lo, hi = F.floor((left + 1) / 2), F.floor((left + 2) / 2)
    placed = rows.withColumn("lo", F.when(left > 0, shift(lo))).withColumn("hi", F.when(left > 0, shift(hi)))
    a = placed.join(table.select(group, F.col("place").alias("lo"), F.col("v").alias("v_lo")), [group, "lo"], "left")
    b = a.join(table.select(group, F.col("place").alias("hi"), F.col("v").alias("v_hi")), [group, "hi"], "left")
    return b.select(*values.columns, ((F.col("v_lo") + F.col("v_hi")) / 2).alias("others_median"))


def split_half_weight(halves: DataFrame, keys: list[str]) -> DataFrame:
    """Wiener weight s^2 / (s^2 + d^2 / 4) of repeated halves (a, b): s the mean of both, d^2 the mean squared difference."""
    agg = halves.groupBy(*keys).agg(F.avg((F.col("a") + F.col("b")) / 2).alias("s"), F.avg(F.pow(F.col("a") - F.col("b"), F.lit(2))).alias("d2"))
    return agg.select(*keys, safe_divide(F.col("s") * F.col("s"), F.col("s") * F.col("s") + F.col("d2") / 4, 0.0).alias("weight"))


def stable_sign(halves: DataFrame, keys: list[str], repeats: int) -> DataFrame:
    """Both halves have the same nonzero sign in at least ``repeats`` repeats."""
    agree = (F.signum("a") == F.signum("b")) & (F.col("a") != 0)
    return halves.groupBy(*keys).agg(F.count_if(agree).alias("agreeing")).withColumn("stable", F.col("agreeing") >= repeats)


def correlations(pairs: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Pearson and Spearman (midrank) correlation; 0 for a constant side."""
    rx = F.rank().over(Window.partitionBy(*keys).orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, x)) - 1) / 2.0
    ry = F.rank().over(Window.partitionBy(*keys).orderBy(y)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, y)) - 1) / 2.0
    ranked = pairs.withColumn("_rx", rx).withColumn("_ry", ry)

    def corr(a: str, b: str) -> Column:
        n, sa, sb = F.count(F.lit(1)), F.sum(a), F.sum(b)
        cov = F.sum(F.col(a) * F.col(b)) - sa * sb / n
        va, vb = F.sum(F.col(a) * F.col(a)) - sa * sa / n, F.sum(F.col(b) * F.col(b)) - sb * sb / n
        flat = (F.max(a) == F.min(a)) | (F.max(b) == F.min(b))
        return F.when(flat, 0.0).otherwise(safe_divide(cov, F.sqrt(va * vb), 0.0))

    return ranked.groupBy(*keys).agg(corr(x, y).alias("pearson"), corr("_rx", "_ry").alias("spearman"))


def energy_shares(effects: DataFrame, top: int = 3) -> DataFrame:
    """Share of a target's squared norm in its largest entries, and the effective number of entries."""
    e = effects.withColumn("e", F.col("value") * F.col("value"))
    w = Window.partitionBy("target").orderBy(F.col("e").desc(), "gene_id")
    ranked = e.withColumn("rn", F.row_number().over(w)).withColumn("share", safe_divide(F.col("e"), F.sum("e").over(Window.partitionBy("target"))))
    return ranked.groupBy("target").agg(F.sum(F.when(F.col("rn") <= top, F.col("share"))).alias("top_share"), F.exp(-F.sum(F.when(F.col("share") > 0, F.col("share") * F.log("share")))).alias("effective"))


def nearest_other(pairs: DataFrame) -> DataFrame:
    """Most similar other vector of each vector; ties go to the smaller one."""
    return pairs.where("i <> j").groupBy("i").agg(F.max(F.struct(F.col("cosine"), (-F.col("j")).alias("neg"))).alias("m")).select("i", (-F.col("m.neg")).alias("nearest"), F.col("m.cosine").alias("cosine"))
