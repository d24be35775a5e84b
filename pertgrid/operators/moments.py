"""Moments of cells, response columns from covariances, and small latent models on top of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import safe_divide


def covariance_columns(values: DataFrame, targets: list[int], n_cells: int) -> DataFrame:
    """Sample covariance of every gene with each target gene, implicit zeros included: (gene_id, target_gene, covariance).

    A row's target genes are joined with all its genes: a cell of g genes makes g times its target genes rows.
    """
    t = values.where(F.col("gene_id").isin(targets)).select("row_id", F.col("gene_id").alias("target_gene"), F.col("value").alias("y"))
    cross = values.join(t, "row_id").groupBy("gene_id", "target_gene").agg(F.sum(F.col("value") * F.col("y")).alias("xy"))
    sx = values.groupBy("gene_id").agg(F.sum("value").alias("sx"))
    sy = t.groupBy("target_gene").agg(F.sum("y").alias("sy"))
    grid = sx.join(F.broadcast(sy), how="cross").join(cross, ["gene_id", "target_gene"], "left").na.fill(0.0, ["xy"])
    return grid.select("gene_id", "target_gene", ((F.col("xy") - F.col("sx") * F.col("sy") / n_cells) / (n_cells - 1)).alias("covariance"))


def pooled_within(values: DataFrame, obs: DataFrame, group: str, targets: list[int]) -> DataFrame:
    """Covariance pooled within groups: sums of squares about each group's mean over n minus the number of groups."""
    n = obs.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    t = values.where(F.col("gene_id").isin(targets)).select("row_id", F.col("gene_id").alias("target_gene"), F.col("value").alias("y"))
    cross = values.join(t, "row_id").groupBy(group, "gene_id", "target_gene").agg(F.sum(F.col("value") * F.col("y")).alias("xy"))
    sx = values.groupBy(group, "gene_id").agg(F.sum("value").alias("sx"))
    sy = sx.where(F.col("gene_id").isin(targets)).select(group, F.col("gene_id").alias("target_gene"), F.col("sx").alias("sy"))
    grid = sx.join(sy, group).join(n, group).join(cross, [group, "gene_id", "target_gene"], "left").na.fill(0.0, ["xy"])
    freedom = n.agg((F.sum("n") - F.count(F.lit(1))).alias("freedom"))
    ss = grid.groupBy("gene_id", "target_gene").agg(F.sum(F.col("xy") - F.col("sx") * F.col("sy") / F.col("n")).alias("ss"))
    return ss.join(F.broadcast(freedom), how="cross").select("gene_id", "target_gene", safe_divide(F.col("ss"), F.col("freedom")).alias("covariance"))


def between_states(means: DataFrame, state: str, targets: list[int]) -> DataFrame:
    """Covariance over states (each with equal weight) of the states' mean values."""
    t = means.where(F.col("gene_id").isin(targets)).select(state, F.col("gene_id").alias("target_gene"), F.col("value").alias("y"))
    return means.join(t, state).groupBy("gene_id", "target_gene").agg(F.covar_samp("value", "y").alias("covariance"))


def response_columns(covariance: DataFrame) -> DataFrame:
    """Response of every gene to a unit fall of the target: -cov / var, -1 for the target itself."""
    var = covariance.where(F.col("gene_id") == F.col("target_gene")).select("target_gene", F.col("covariance").alias("variance"))
    own = F.col("gene_id") == F.col("target_gene")
    return covariance.join(F.broadcast(var), "target_gene").select("gene_id", "target_gene", F.when(own, -1.0).otherwise(-safe_divide(F.col("covariance"), F.col("variance"))).alias("response"))


def soft_threshold(columns: DataFrame, value: str, se: str, tau: float) -> DataFrame:
    return columns.withColumn("thresholded", F.signum(value) * F.greatest(F.lit(0.0), F.abs(value) - tau * F.col(se)))


def factorial_moments(counts: DataFrame, n_cells: int, targets: list[int]) -> DataFrame:
    """E[rate_i rate_j] of Poisson counts with rate count / total; on the diagonal count (count - 1) takes the place of count^2."""
    rates = counts.withColumn("total", F.sum("count").over(Window.partitionBy("row_id"))).withColumn("rate", F.col("count") / F.col("total"))
    t = rates.where(F.col("gene_id").isin(targets)).select("row_id", F.col("gene_id").alias("target_gene"), F.col("rate").alias("y"), F.col("count").alias("raw"), F.col("total").alias("t"))
    product = F.when(F.col("gene_id") == F.col("target_gene"), F.col("raw") * (F.col("raw") - 1) / (F.col("t") * F.col("t")).cast("double")).otherwise(F.col("rate") * F.col("y"))
    return rates.join(t, "row_id").groupBy("gene_id", "target_gene").agg((F.sum(product) / n_cells).alias("second_moment"))


def mean_rates(counts: DataFrame, n_cells: int) -> DataFrame:
    rate = F.col("count") / F.sum("count").over(Window.partitionBy("row_id"))
    return counts.withColumn("rate", rate).groupBy("gene_id").agg((F.sum("rate") / n_cells).alias("mean_rate"))


def lognormal_columns(second: DataFrame, means: DataFrame) -> DataFrame:
    """Latent covariance log(second / (m m')) of a Poisson-lognormal model; null where the ratio is not positive."""
    other = means.select(F.col("gene_id").alias("target_gene"), F.col("mean_rate").alias("other_rate"))
    joined = second.join(means, "gene_id").join(other, "target_gene")
    ratio = safe_divide(F.col("second_moment"), F.col("mean_rate") * F.col("other_rate"))
    return joined.select("gene_id", "target_gene", F.when(ratio > 0, F.log(ratio)).alias("log_covariance"))


def nb_dispersion(counts: DataFrame, obs_totals: DataFrame) -> DataFrame:
    """Method-of-moments dispersion per gene: sum((y - mu)^2 - mu) / sum(mu^2), at least 0, over all cells.

    mu = share of the gene times the cell's total; absent cells enter through sum(mu^2) over all of them.
    """
    sums = obs_totals.agg(F.sum("total").cast("double").alias("t1"), F.sum(F.col("total").cast("double") * F.col("total")).alias("t2"))
    joined = counts.join(obs_totals.select("row_id", F.col("total").cast("double").alias("total")), "row_id")
    g = joined.groupBy("gene_id").agg(F.sum("count").cast("double").alias("s"), F.sum(F.col("count").cast("double") * F.col("count")).alias("yy"), F.sum(F.col("count") * F.col("total")).alias("yt")).join(F.broadcast(sums), how="cross")
    share = F.col("s") / F.col("t1")
    mu2 = share * share * F.col("t2")
    return g.select("gene_id", F.greatest(F.lit(0.0), safe_divide(F.col("yy") - 2 * share * F.col("yt") + mu2 - F.col("s"), mu2)).alias("dispersion"))


def gram_eigen(vectors: DataFrame, key: str, array: str, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvalues and eigenvectors of the second-moment matrix of fixed-length arrays about their mean.

    Sums of products are formed per task by numpy and added: only p x p numbers per task leave it.
    """

    def partial(batches):
        import pandas as pd

        n, s, g = 0, None, None
        for pdf in batches:
            x = np.stack(pdf[array].to_numpy()).astype(float) if len(pdf) else np.empty((0, 0))
            if len(x):
                n += len(x)
                s = x.sum(0) if s is None else s + x.sum(0)
                g = x.T @ x if g is None else g + x.T @ x
        if n:
            p = len(s)
            i, j = np.divmod(np.arange(p * p), p)
            yield pd.DataFrame({"i": np.append(i, -1), "j": np.append(j, -1), "v": np.append(g.ravel(), n)})
            yield pd.DataFrame({"i": np.full(p, -2), "j": np.arange(p), "v": s})

    rows = vectors.select(array).mapInPandas(partial, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    if not rows:
        return np.empty(0), np.empty((0, 0))
    n = next(r.v for r in rows if r.i == -1)
    p = 1 + max(r.j for r in rows)
    g, s = np.zeros((p, p)), np.zeros(p)
    for r in rows:
        if r.i >= 0:
            g[r.i, r.j] = r.v
        elif r.i == -2:
            s[r.j] = r.v
    c = (g - np.outer(s, s) / n) / max(1.0, n - 1)
    values, directions = np.linalg.eigh(c)
    order = np.argsort(values)[::-1][:rank]
    directions = directions[:, order]
    return values[order], directions * np.where(directions[np.abs(directions).argmax(axis=0), range(len(order))] < 0, -1, 1)


def project_components(vectors: DataFrame, key: str, array: str, directions: np.ndarray) -> DataFrame:
    """Coordinates along the directions as an array column."""
    rows = [F.array(*[F.lit(float(x)) for x in d]) for d in directions.T]
    dot = lambda d: F.aggregate(F.zip_with(F.col(array), d, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    return vectors.select(key, F.array(*[dot(d) for d in rows]).alias("components"))


def normal_mixture(sample: np.ndarray, se: np.ndarray, scales: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Weights of a scale mixture of centred normals by EM, from a bounded sample."""
    var = scales[None, :] ** 2 + se[:, None] ** 2
    density = np.exp(-0.5 * sample[:, None] ** 2 / var) / np.sqrt(2 * np.pi * var)
    w = np.full(len(scales), 1 / len(scales))
    for _ in range(rounds):
        post = density * w
        post /= np.maximum(post.sum(axis=1, keepdims=True), 1e-300)
        w = post.mean(axis=0)
    return w


def posterior_mean(df: DataFrame, value: str, se: str, scales: list[float], weights: list[float]) -> DataFrame:
    """Posterior mean under the mixture, by column expressions: a sum of one term per scale."""
    x, e2 = F.col(value), F.col(se) * F.col(se)
    terms = [(F.lit(float(w)) * F.exp(-x * x / (2 * (s * s + e2))) / F.sqrt(s * s + e2), s * s / (s * s + e2)) for s, w in zip(scales, weights, strict=True)]
    top, all_ = sum((d * k for d, k in terms), F.lit(0.0)), sum((d for d, _ in terms), F.lit(0.0))
    return df.withColumn("posterior_mean", x * safe_divide(top, all_, 0.0))


def quadratic_dose(df: DataFrame, group: str, dose: str, y: str) -> DataFrame:
    """y = b1 dose + b2 dose^2 about each group's means, by 2x2 normal equations over all groups, per gene."""
    d2 = F.col(dose) * F.col(dose)
    w = Window.partitionBy("gene_id", group)
    c = df.withColumn("_a", F.col(dose) - F.avg(dose).over(w)).withColumn("_b", d2 - F.avg(d2).over(w)).withColumn("_y", F.col(y) - F.avg(y).over(w))
    s = c.groupBy("gene_id").agg(*[F.sum(F.col(p) * F.col(q)).alias(n) for n, p, q in (("aa", "_a", "_a"), ("ab", "_a", "_b"), ("bb", "_b", "_b"), ("ay", "_a", "_y"), ("by", "_b", "_y"))])
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    ok = det > 1e-9 * F.col("aa") * F.col("bb")
    return s.select("gene_id", F.when(ok, (F.col("ay") * F.col("bb") - F.col("by") * F.col("ab")) / F.nullif(det, F.lit(0.0))).alias("b1"), F.when(ok, (F.col("by") * F.col("aa") - F.col("ay") * F.col("ab")) / F.nullif(det, F.lit(0.0))).alias("b2"))


def poisson_log_likelihood(counts: DataFrame, means: DataFrame, row_totals: DataFrame) -> DataFrame:
    """Per-cell negative log likelihood (without the factorial) of Poisson counts with mean total * share(group, gene): only
    observed genes need their logarithm, the rest of the mass is the total of the cell's group shares."""
    mass = means.groupBy("group").agg(F.sum("share").alias("mass"))
    seen = counts.join(row_totals, "row_id").join(means, ["group", "gene_id"], "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
    log = seen.groupBy("row_id", "group").agg(F.sum(F.when(F.col("share") > 0, F.col("count") * F.log(F.col("share") * F.col("total")))).alias("log_part"), F.max("total").alias("total"), F.count_if(F.col("share") <= 0).alias("impossible"))
    return log.join(mass, "group").select("row_id", "group", (F.col("total") * F.col("mass") - F.coalesce("log_part", F.lit(0.0))).alias("nll"), "impossible")
