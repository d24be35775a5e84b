"""Transfer of effects between contexts, shrinkage and calibration.

Regressions reduce to sums per fold, target or gene; only these few numbers are solved, most of them in closed
form by column expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions.scalar import safe_divide

INFINITE = float("inf")


def transferred(h0: Column, k0: Column, kp: Column, rule: str) -> Column:
    """CPM expected in context h under a change from k0 to kp in context k: rules additive, ratio, log1p."""
    if rule == "additive":
        return h0 + kp - k0
    if rule == "ratio":
        return h0 * F.when(k0 > 0, kp / F.nullif(k0, F.lit(0.0))).otherwise(1.0)
    if rule == "log1p":
        return (h0 + 1) * (kp + 1) / (k0 + 1) - 1
    raise ValueError(f"unknown rule {rule!r}")


def close_boundary(profiles: DataFrame, keys: list[str], value: str, scale: float = config.CPM_SCALE) -> DataFrame:
    """Negative values clipped to 0 and the rest rescaled to ``scale``; ``negative_mass`` is what was clipped."""
    w = Window.partitionBy(*keys)
    clipped = F.greatest(F.col(value), F.lit(0.0))
    return profiles.withColumn("closed", safe_divide(clipped * scale, F.sum(clipped).over(w))).withColumn("negative_mass", F.sum(F.greatest(-F.col(value), F.lit(0.0))).over(w))


def direction(sp: Column, s0: Column, c: float = config.TRANSFER_PSEUDOCOUNT) -> Column:
    """ln((sp + c) / (s0 + c)); for c = inf the difference; null for a log of 0."""
    if c == INFINITE:
        return sp - s0
    return F.when((sp + c > 0) & (s0 + c > 0), F.log((sp + c) / F.nullif(s0 + c, F.lit(0.0))))


def realise(h0: Column, change: Column, c: float = config.TRANSFER_PSEUDOCOUNT) -> Column:
    """Inverse of ``direction`` at h0, at least 0; a null change is a fall to -c."""
    if c == INFINITE:
        return F.greatest(h0 + change, F.lit(0.0))
    return F.greatest(F.coalesce((h0 + c) * F.exp(change) - c, F.lit(0.0)), F.lit(0.0))


def average_change(donors: list[DataFrame]) -> DataFrame:
    """Cell-wise mean of (target, gene_id, value) over the donors that measure the cell."""
    return reduce(DataFrame.unionByName, [d.select("target", "gene_id", "value") for d in donors]).groupBy("target", "gene_id").agg(F.avg("value").alias("value"), F.count("value").alias("donors"))


def on_grid(values: DataFrame, grid: DataFrame, otherwise: float = 0.0) -> DataFrame:
    """Values of every (target, gene_id) of the grid, ``otherwise`` where absent."""
    return grid.join(values, ["target", "gene_id"], "left").na.fill(otherwise, ["value"])


def with_fallback(values: DataFrame, grid: DataFrame) -> DataFrame:
    """Values on the grid; absent ones are the gene's mean over targets, then 0."""
    mean = values.groupBy("gene_id").agg(F.avg("value").alias("gene_mean"))
    return grid.join(values, ["target", "gene_id"], "left").join(mean, "gene_id", "left").select("target", "gene_id", F.coalesce("value", "gene_mean", F.lit(0.0)).alias("value"), F.col("value").isNull().alias("is_fallback"))


def global_axis(effects: DataFrame) -> DataFrame:
    """Mean change per gene without each gene's own perturbation."""
    return effects.where(F.col("target").cast("string") != F.col("gene_id").cast("string")).groupBy("gene_id").agg(F.avg("value").alias("value"))


def shared_specific(effects: DataFrame) -> DataFrame:
    """Each value as the gene's mean (own perturbation left out) and the residual to it."""
    shared = global_axis(effects).withColumnRenamed("value", "shared")
    return effects.join(shared, "gene_id", "left").na.fill(0.0, ["shared"]).withColumn("specific", F.col("value") - F.col("shared"))


def project(pairs: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Least-squares slope of y on x through the origin, cosine, norm ratio and orthogonal energy, from three sums."""
    s = pairs.groupBy(*keys).agg(F.sum(F.col(x) * F.col(x)).alias("xx"), F.sum(F.col(x) * F.col(y)).alias("xy"), F.sum(F.col(y) * F.col(y)).alias("yy"))
    return s.select(
        *keys,
        safe_divide(F.col("xy"), F.col("xx")).alias("slope"),
        safe_divide(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy"))).alias("cosine"),
        F.sqrt(safe_divide(F.col("xx"), F.col("yy"))).alias("norm_ratio"),
        (F.col("yy") - F.coalesce(safe_divide(F.col("xy") * F.col("xy"), F.col("xx")), F.lit(0.0))).alias("orthogonal_energy"),
    )


def two_column_ols(rows: DataFrame, keys: list[str], x: str, d: str, y: str) -> DataFrame:
    """y = a x + b x d by the 2x2 normal equations; null where they are singular."""
    xd = F.col(x) * F.col(d)
    s = rows.groupBy(*keys).agg(F.sum(F.col(x) * F.col(x)).alias("g11"), F.sum(F.col(x) * xd).alias("g12"), F.sum(xd * xd).alias("g22"), F.sum(F.col(x) * F.col(y)).alias("r1"), F.sum(xd * F.col(y)).alias("r2"))
    det = F.col("g11") * F.col("g22") - F.col("g12") * F.col("g12")
    ok = F.abs(det) > 1e-9 * F.col("g11") * F.col("g22")
    return s.select(*keys, F.when(ok, (F.col("r1") * F.col("g22") - F.col("r2") * F.col("g12")) / F.nullif(det, F.lit(0.0))).alias("a"), F.when(ok, (F.col("r2") * F.col("g11") - F.col("r1") * F.col("g12")) / F.nullif(det, F.lit(0.0))).alias("b"))


def pooled_slope(pairs: DataFrame, keys: list[str]) -> DataFrame:
    return pairs.groupBy(*keys).agg(safe_divide(F.sum(F.col("x") * F.col("y")), F.sum(F.col("x") * F.col("x"))).alias("slope"))


def cross_fitted(values: DataFrame, fold: str, value: str, statistic: str = "median") -> DataFrame:
    """Of every fold the median (or mean) of the values of the other folds: nothing of a fold enters its own fit."""
    names = values.select(F.col(fold).alias("_held")).distinct()
    agg = F.median(value) if statistic == "median" else F.avg(value)
    return names.join(values, F.col("_held") != F.col(fold)).groupBy(F.col("_held").alias(fold)).agg(agg.alias("fitted"))


def shrunk_gene_slopes(pairs: DataFrame, strength: float = 1.0) -> DataFrame:
    """Per gene (sum xy + lambda g) / (sum xx + lambda): g the pooled slope, lambda = strength * median positive energy."""
    genes = pairs.groupBy("gene_id").agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"))
    pooled = genes.agg(safe_divide(F.sum("xy"), F.sum("xx"), 0.0).alias("g"), (strength * F.coalesce(F.median(F.when(F.col("xx") > 0, F.col("xx"))), F.lit(0.0))).alias("lam"))
    return genes.join(F.broadcast(pooled), how="cross").select("gene_id", safe_divide(F.col("xy") + F.col("lam") * F.col("g"), F.col("xx") + F.col("lam"), 0.0).alias("slope"))


def gram(values: DataFrame, truth: DataFrame, sources: list[str]) -> tuple[list[list[float]], list[float]]:
    """Sums of products of k source columns with each other and with the truth: k * (k + 3) / 2 numbers in one pass."""
    joined = values.join(truth.withColumnRenamed("value", "truth"), ["target", "gene_id"])
    pairs = [(a, b) for i, a in enumerate(sources) for b in sources[i:]]
    row = joined.agg(*[F.sum(F.col(a) * F.col(b)) for a, b in pairs], *[F.sum(F.col(a) * F.col("truth")) for a in sources]).first()
    where = {p: row[k] or 0.0 for k, p in enumerate(pairs)}
    return [[where.get((a, b), where.get((b, a))) for b in sources] for a in sources], [row[len(pairs) + k] or 0.0 for k in range(len(sources))]


def nonnegative_weights(g: list[list[float]], r: list[float], rounds: int = 500) -> list[float]:
    """min w'Gw - 2 r'w over w >= 0 for a k x k matrix, by cyclic coordinate descent."""
    w = [0.0] * len(r)
    for _ in range(rounds):
        for i in range(len(r)):
            rest = sum(g[i][j] * w[j] for j in range(len(r)) if j != i)
            w[i] = max(0.0, (r[i] - rest) / g[i][i]) if g[i][i] > 0 else 0.0
    return w


def ridge(g: list[list[float]], r: list[float], penalty: list[float]) -> list[float]:
    """(G + diag(penalty)) w = r; least squares where singular."""
    import numpy as np

    a = np.asarray(g, float) + np.diag(penalty)
    return [float(x) for x in np.linalg.lstsq(a, np.asarray(r, float), rcond=None)[0]]


def scale_scan(pairs: DataFrame, keys: list[str], amplitudes: list[float]) -> DataFrame:
    """Error and energy of the prediction at every amplitude, from the three sums alone."""
    s = pairs.groupBy(*keys).agg(F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    grid = s.withColumn("amplitude", F.explode(F.array(*[F.lit(float(a)) for a in amplitudes])))
    return grid.select(*keys, "amplitude", (F.col("yy") - 2 * F.col("amplitude") * F.col("xy") + F.col("amplitude") * F.col("amplitude") * F.col("xx")).alias("error"), F.col("yy").alias("energy"))


def chosen_amplitude(scan: DataFrame, keys: list[str]) -> DataFrame:
    """Amplitude with the smallest summed error per key; ties to the smaller one."""
    total = scan.groupBy(*keys, "amplitude").agg(F.sum("error").alias("error"))
    return total.groupBy(*keys).agg(F.min(F.struct("error", "amplitude")).alias("m")).select(*keys, F.col("m.amplitude").alias("amplitude"), F.col("m.error").alias("error"))


def cross_fit_curve(scan: DataFrame, fold: str) -> DataFrame:
    """Per fold and amplitude the mean error of training and held-out targets, and whether the training error is the smallest.

    ``scan`` has one row per target and amplitude with its fold.
    """
    total = scan.groupBy("amplitude").agg(F.sum("error").alias("all_error"), F.count(F.lit(1)).alias("all_n"))
    own = scan.groupBy(fold, "amplitude").agg(F.sum("error").alias("own_error"), F.count(F.lit(1)).alias("own_n"))
    curve = own.join(total, "amplitude").select(fold, "amplitude", ((F.col("all_error") - F.col("own_error")) / F.nullif(F.col("all_n") - F.col("own_n"), F.lit(0))).alias("training"), (F.col("own_error") / F.col("own_n")).alias("held_out"))
    return curve.withColumn("selected", F.row_number().over(Window.partitionBy(fold).orderBy("training", "amplitude")) == 1)


def inverse_noise_weights(noise: DataFrame, source: str, energy: str) -> DataFrame:
    """Weights of the sources proportional to 1 / noise energy, with sum 1."""
    w = noise.withColumn("w", safe_divide(F.lit(1.0), F.col(energy), 0.0))
    return w.select(source, safe_divide(F.col("w"), F.sum("w").over(Window.partitionBy()), 0.0).alias("weight"))


def weighted_average(values: DataFrame, weights: DataFrame, source: str) -> DataFrame:
    joined = values.join(F.broadcast(weights), source)
    return joined.groupBy("target", "gene_id").agg(safe_divide(F.sum(F.col("weight") * F.col("value")), F.sum("weight")).alias("value"))


def wrong_target(effects: DataFrame, targets: DataFrame, shift: int = 1) -> DataFrame:
    """Every target with the effects of the target ``shift`` places on (in order of name, cyclic)."""
    placed = targets.select("target", (F.row_number().over(Window.orderBy("target")) - 1).alias("pos"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
    mapping = placed.join(placed.select(F.col("target").alias("donor"), F.col("pos").alias("p")), (F.col("pos") + shift) % F.col("n") == F.col("p")).select(F.col("target").alias("as_target"), "donor")
    return effects.join(mapping, F.col("target") == F.col("donor")).select(F.col("as_target").alias("target"), "gene_id", "value")


def own_axis_average(sources: list[DataFrame], c: float = config.TRANSFER_PSEUDOCOUNT) -> DataFrame:
    """Average of log changes, each source's CPM closed on its own genes: sources have target, gene_id, count, control_count."""
    closed = []
    for s in sources:
        w = Window.partitionBy("target")
        sp, s0 = F.col("count") * config.CPM_SCALE / F.sum("count").over(w), F.col("control_count") * config.CPM_SCALE / F.sum("control_count").over(w)
        closed.append(s.select("target", "gene_id", F.log((sp + c) / (s0 + c)).alias("value")))
    return average_change(closed)
