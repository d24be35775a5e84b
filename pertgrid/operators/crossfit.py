"""Nested cross-fitting of scales from sufficient statistics, and their bootstrap.

``pairs`` has target, gene_id, x (effect in the source), y (effect in the context) and strong (a boolean).  Targets have an outer
fold and an inner one.  Every model is  y = s_g x  with a scale per gene, and needs per gene only the sums of x x and x y over its
training targets; every validation loss needs those of the strong entries.  One pass makes these sums per (outer, inner, gene).  The
sums of every fit are then added up from these, all fits of a gene at once.  Several steps read ``pairs`` and the sums, so both should be stored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Strong entries that a target needs to count in a loss.
MIN_STRONG = 10
#: Inner fold of the fits that leave none out.
NONE = -1
#: Bins of values per power of two when a median is sought.
MEDIAN_BINS = 64
_SUMS = ("xx", "xy", "mxx", "mxy", "myy", "n")


def fold_sums(pairs: DataFrame, folds: DataFrame, min_strong: int = MIN_STRONG) -> DataFrame:
    """outer, inner, gene_id and the sums of all entries (xx, xy) and of strong entries of targets with ``min_strong`` of them
    (mxx, mxy, myy, n).  ``folds`` has target, outer, inner.  Null effects count as absent."""
    known = pairs.where("x IS NOT NULL AND y IS NOT NULL").withColumn("strong", F.coalesce("strong", F.lit(False)))
    eligible = known.groupBy("target").agg((F.count_if("strong") >= min_strong).alias("eligible"))
    rows = known.join(eligible.join(folds, "target"), "target")
    m = F.when(F.col("strong") & F.col("eligible"), 1.0).otherwise(0.0)
    x, y = F.col("x"), F.col("y")
    return rows.groupBy("outer", "inner", "gene_id").agg(F.sum(x * x).alias("xx"), F.sum(x * y).alias("xy"), F.sum(m * x * x).alias("mxx"), F.sum(m * x * y).alias("mxy"), F.sum(m * y * y).alias("myy"), F.sum(m).alias("n"))


def _folds_of(sums: DataFrame) -> tuple[list[int], list[int]]:
    rows = sums.select("outer", "inner").distinct().collect()  # folds times folds
    return tuple(sorted({r[j] for r in rows if r[j] is not None}) for j in (0, 1))


def _by_gene(sums: DataFrame, fits: list[tuple[int, int]], uses: Callable[[int, int], Column], names: tuple[str, ...]) -> DataFrame:
    """held, left_out, gene_id and the sums of ``names`` over the folds that ``uses`` of each fit; one aggregate per gene makes all fits."""
    of_fit = lambda h, i: F.struct(F.lit(h).cast("int").alias("held"), F.lit(i).cast("int").alias("left_out"), *[F.sum(F.when(uses(h, i), F.col(c)).otherwise(0.0)).alias(c) for c in names])
    fitted = F.array(*[of_fit(h, i) for h, i in fits]) if fits else F.array().cast(f"array<struct<held:int,left_out:int,{','.join(f'{c}:double' for c in names)}>>")
    return sums.groupBy("gene_id").agg(fitted.alias("fits")).select("gene_id", F.explode("fits").alias("x")).select("x.held", "x.left_out", "gene_id", *[f"x.{c}" for c in names])


def training_sums(sums: DataFrame) -> DataFrame:
    """held, left_out, gene_id, xx, xy: the training sums of every fit.  ``left_out`` is an inner fold, or ``NONE`` for the final fit;
    a gene without training entries has zeros."""
    outers, inners = _folds_of(sums)
    return _by_gene(sums, [(h, i) for h in outers for i in [NONE, *inners]], lambda h, i: (F.col("outer") != h) & (F.col("inner") != i), _SUMS[:2])


def _validation(sums: DataFrame) -> DataFrame:
    """held, left_out, gene_id and the strong sums of the inner fold among the training targets."""
    outers, inners = _folds_of(sums)
    return _by_gene(sums, [(h, i) for h in outers for i in inners], lambda h, i: (F.col("outer") != h) & (F.col("inner") == i), _SUMS[2:])


def exact_medians(values: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """keys, out: the median of the positive ``value`` within each key; keys without one are no rows.

    Counts by bins of the logarithm tell which bins hold the middle places; only these bins are ordered, so no task holds a key's values.
    """
    binned = values.where(F.col(value) > 0).select(*keys, F.col(value).alias("_v"), F.floor(F.log2(value) * MEDIAN_BINS).alias("_bin"))
    key = Window.partitionBy(*keys)
    counts = binned.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_k"))
    placed = counts.withColumn("_upto", F.sum("_k").over(key.orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_m", F.sum("_k").over(key))
    low, high = F.floor((F.col("_m") + 1) / 2), F.floor(F.col("_m") / 2) + 1
    before = F.col("_upto") - F.col("_k")
    middle = placed.where((F.col("_upto") >= low) & (before < high)).select(*keys, "_bin", before.alias("_before"), low.alias("_low"), high.alias("_high"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_bin").orderBy("_v"))
    ranked = binned.join(F.broadcast(middle), [*keys, "_bin"]).withColumn("_rank", F.col("_before") + inside)  # two bins a key at most
    return ranked.where((F.col("_rank") == F.col("_low")) | (F.col("_rank") == F.col("_high"))).groupBy(*keys).agg(F.avg("_v").alias(out))


def _pooled(training: DataFrame) -> DataFrame:
    """held, left_out, pooled (one scale for all genes) and energy (the median positive xx of a gene)."""
    fit = ["held", "left_out"]
    sums = training.groupBy(*fit).agg(F.coalesce(F.sum("xy") / F.nullif(F.sum("xx"), F.lit(0.0)), F.lit(0.0)).alias("pooled"))
    return sums.join(F.broadcast(exact_medians(training.where("xx > 1e-12"), fit, "xx", "energy")), fit, "left").na.fill(1.0, ["energy"])


def _shrunk(training: DataFrame, multipliers: list[float]) -> DataFrame:
    """Gene scales of every fit at every prior: (xy + lambda pooled) / (xx + lambda), lambda a multiple of the median energy; infinite: pooled."""
    grid = F.explode(F.array(*[F.lit(float(m)) for m in multipliers])).alias("multiplier")
    rows = training.join(F.broadcast(_pooled(training)), ["held", "left_out"]).select("*", grid)
    lam = F.col("multiplier") * F.col("energy")
    finite = (F.col("xy") + lam * F.col("pooled")) / F.nullif(F.col("xx") + lam, F.lit(0.0))
    scale = F.when(F.col("multiplier") == float("inf"), F.col("pooled")).otherwise(F.coalesce(finite, F.col("pooled")))
    return rows.select("held", "left_out", "gene_id", "multiplier", scale.alias("scale"))


def _losses(scales: DataFrame, validation: DataFrame) -> DataFrame:
    """held, multiplier, loss: squared error a strong entry over all inner folds."""
    s = F.col("scale")
    error = F.col("myy") - 2 * s * F.col("mxy") + s * s * F.col("mxx")
    met = scales.where(F.col("left_out") != NONE).join(validation, ["held", "left_out", "gene_id"])
    return met.groupBy("held", "multiplier").agg((F.sum(error) / F.nullif(F.sum("n"), F.lit(0.0))).alias("loss"))


def _chosen(losses: DataFrame) -> DataFrame:
    """The multiplier of the smallest loss; ties go to the smaller one, and to it where no loss is defined."""
    order = F.struct(F.coalesce("loss", F.lit(float("inf"))).alias("loss"), "multiplier")
    return losses.groupBy("held").agg(F.min(order).alias("m")).select("held", F.col("m.multiplier").alias("multiplier"), F.col("m.loss").alias("loss"))


def gene_scales(sums: DataFrame, multipliers: list[float]) -> tuple[DataFrame, DataFrame]:
    """Nested choice of the gene prior: (held, multiplier, loss), and the final scales (held, gene_id, scale)."""
    training = training_sums(sums)
    scales = _shrunk(training, multipliers)
    chosen = _chosen(_losses(scales, _validation(sums)))
    return chosen, scales.where(F.col("left_out") == NONE).join(F.broadcast(chosen.select("held", "multiplier")), ["held", "multiplier"]).select("held", "gene_id", "scale")


def context_model(sums: DataFrame, features: DataFrame, names: list[str], multipliers: list[float]) -> DataFrame:
    """held, multiplier, loss, penalty, beta: nested ridge of the scale on a constant and gene features, s_g = beta . (1, f_g).

    ``features`` has gene_id and the columns ``names``; genes without a row have no part.  The slopes' penalty is the multiple
    of the constant's energy, infinite: the pooled scale alone.  The k x k systems of all (held, left out, multiplier) are solved on the driver
    from one small table of Gram sums; the losses are quadratic in beta and need a second such table.
    """
    k = len(names) + 1
    f = [F.lit(1.0), *[F.col(c).cast("double") for c in names]]
    gram = lambda c: F.array(*[F.sum(F.col(c) * f[a] * f[b]) for a in range(k) for b in range(k)]).alias(c)
    cross = lambda c: F.array(*[F.sum(F.col(c) * x) for x in f]).alias(c)
    training = training_sums(sums).join(features, "gene_id").groupBy("held", "left_out").agg(gram("xx"), cross("xy"))
    checks = _validation(sums).join(features, "gene_id").groupBy("held", "left_out").agg(gram("mxx"), cross("mxy"), F.sum("myy").alias("myy"), F.sum("n").alias("n"))
    fits = {(r.held, r.left_out): (np.array(r.xx).reshape(k, k), np.array(r.xy)) for r in training.collect()}  # folds times folds rows
    tests = {(r.held, r.left_out): (np.array(r.mxx).reshape(k, k), np.array(r.mxy), r.myy, r.n) for r in checks.collect()}

    def solved(held: int, left_out: int, multiplier: float) -> tuple[np.ndarray, float]:
        a, b = fits[held, left_out]
        if np.isinf(multiplier):
            return np.array([b[0] / a[0, 0] if a[0, 0] else 0.0, *[0.0] * (k - 1)]), float("inf")
        penalty = multiplier * (a[0, 0] or 1.0)
        return np.linalg.pinv(a + np.diag([0.0, *[penalty] * (k - 1)])) @ b, penalty

    rows = []
    for held in sorted({h for h, _ in fits}):
        losses = []
        for m in multipliers:
            error = n = 0.0
            for (h, left_out), (a, b, yy, count) in tests.items():
                if h == held:
                    beta, _ = solved(held, left_out, m)
                    error, n = error + yy - 2 * beta @ b + beta @ a @ beta, n + count
            losses.append((error / n if n else float("inf"), m))
        loss, m = min(losses)
        beta, penalty = solved(held, NONE, m)
        rows.append((held, float(m), float(loss), float(penalty), [float(v) for v in beta]))
    return sums.sparkSession.createDataFrame(rows, "held int, multiplier double, loss double, penalty double, beta array<double>")


def predictions(pairs: DataFrame, folds: DataFrame, scales: DataFrame, betas: DataFrame, pooled: DataFrame, features: DataFrame, names: list[str]) -> DataFrame:
    """Held-out predictions of all three models: target, gene_id, y, one_scale, gene_scales, context."""
    s = F.get("beta", F.lit(0)) + sum((F.get("beta", F.lit(j + 1)) * F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for j, c in enumerate(names)), F.lit(0.0))
    rows = pairs.join(folds.select("target", F.col("outer").alias("held")), "target").join(F.broadcast(pooled), "held").join(F.broadcast(betas.select("held", "beta")), "held")
    # a row per gene with the scales of all held folds, so that the pairs are dealt once
    folded = scales.groupBy("gene_id").agg(F.map_from_entries(F.collect_list(F.struct("held", "scale"))).alias("scales"))
    rows = rows.join(folded.join(features, "gene_id", "full"), "gene_id", "left").withColumn("scale", F.try_element_at("scales", F.col("held")))
    return rows.select("target", "gene_id", "y", (F.col("x") * F.col("pooled")).alias("one_scale"), (F.col("x") * F.coalesce("scale", "pooled")).alias("gene_scales"), (F.col("x") * s).alias("context"))


def pooled_scales(sums: DataFrame) -> DataFrame:
    """held, pooled: one scale of each final fit."""
    return _pooled(training_sums(sums)).where(F.col("left_out") == NONE).select("held", "pooled")


def imputed_ridge(rows: DataFrame, features: list[str], outcome: str, alpha: float) -> DataFrame:
    """fold, medians, means, scales, centre, beta: of every fold the ridge fit of the other folds.

    ``rows`` has fold, the features (null or NaN: missing) and the outcome (rows without it have no part).  Missing features get the
    training median of the fit, then all are standardised (population deviation, 1 where it is 0).  Sums of present and missing
    entries are made per fold in one pass, so the Gram matrix of any medians, and of any fold left out, follows from them.
    A feature without a training value is 0.
    """
    present = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    known = rows.where(present(outcome)).select("fold", F.col(outcome).cast("double").alias("_y"), *[F.when(present(c), F.col(c).cast("double")).alias(f"_f{j}") for j, c in enumerate(features)])
    p = len(features)
    v = [F.coalesce(F.col(f"_f{j}"), F.lit(0.0)) for j in range(p)] + [F.lit(1.0), F.col("_y")]  # with a constant and the outcome
    gone = [F.col(f"_f{j}").isNull().cast("double") for j in range(p)] + [F.lit(0.0)] * 2
    every = [(a, b) for a in range(p + 2) for b in range(p + 2)]
    sums = known.groupBy("fold").agg(F.array(*[F.sum(v[a] * v[b]) for a, b in every]).alias("vv"), F.array(*[F.sum(v[a] * gone[b]) for a, b in every]).alias("vg"), F.array(*[F.sum(gone[a] * gone[b]) for a, b in every]).alias("gg"))
    names = known.select(F.col("fold").alias("held")).distinct()
    medians = known.join(F.broadcast(names), F.col("held") != F.col("fold")).groupBy("held").agg(F.array(*[F.coalesce(F.median(f"_f{j}"), F.lit(0.0)) for j in range(p)]).alias("medians"))
    parts = {r.fold: [np.array(x).reshape(p + 2, p + 2) for x in (r.vv, r.vg, r.gg)] for r in sums.collect()}  # a row per fold
    whole = [sum(x[k] for x in parts.values()) for k in range(3)] if parts else []
    out = []
    for r in medians.collect():
        vv, vg, gg = (w - own for w, own in zip(whole, parts[r.held], strict=True))
        m = np.array([*r.medians, 0.0, 0.0])
        filled = vv + vg * m + (vg * m).T + gg * np.outer(m, m)
        n = filled[p, p]
        mean, centre = filled[p, :p] / n, filled[p, p + 1] / n
        covariance = filled[:p, :p] - n * np.outer(mean, mean)
        scale = np.sqrt(np.maximum(np.diag(covariance), 0) / n)
        scale[scale <= 1e-12 * np.maximum(1, np.abs(mean))] = 1
        a, b = covariance / np.outer(scale, scale), (filled[:p, p + 1] - n * mean * centre) / scale
        beta = np.linalg.pinv(a + alpha * np.eye(p)) @ b
        out.append((r.held, list(r.medians), mean.tolist(), scale.tolist(), float(centre), beta.tolist()))
    return rows.sparkSession.createDataFrame(out, "fold int, medians array<double>, means array<double>, scales array<double>, centre double, beta array<double>")


def ridge_predictions(rows: DataFrame, fits: DataFrame, features: list[str]) -> DataFrame:
    """``rows`` with ``predicted``, by the fit that left their fold out."""
    terms = []
    for j, c in enumerate(features):
        at = lambda name, j=j: F.get(name, F.lit(j))
        x = F.col(c).cast("double")
        terms.append(at("beta") * (F.coalesce(F.when(~F.isnan(x), x), at("medians")) - at("means")) / at("scales"))
    return rows.join(F.broadcast(fits), "fold").withColumn("predicted", F.col("centre") + sum(terms, F.lit(0.0))).drop("medians", "means", "scales", "centre", "beta")


def poisson_weights(keys: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """(len(keys), replicates) bootstrap weights, Poisson of mean 1, each from a hash of its key and replicate."""
    upto = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 20)]))
    with np.errstate(over="ignore"):
        x = keys.astype(np.int64).view(np.uint64)[:, None] + (np.arange(replicates, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 32) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    # the first 8 bits decide all but the numbers that share them with a boundary
    low, high = (np.searchsorted(upto, (np.arange(256) + k) / 256, side="right") for k in (0, 1))
    top = (x >> np.uint64(56)).astype(np.uint8)
    weights, near = low.astype(float)[top], np.nonzero((low != high)[top])
    weights[near] = np.searchsorted(upto, (x[near] >> np.uint64(11)) / float(1 << 53), side="right")
    return weights


def bootstrap_context(pairs: DataFrame, folds: DataFrame, features: DataFrame, names: list[str], chosen: DataFrame, replicates: int = 2000, seed: int = 0) -> DataFrame:
    """held, coefficient, q025, median, q975, positive_fraction of the context model, resampling training targets.

    Each target is reduced to its own Gram sums once; tasks multiply them by the weights of all replicates and add, so a task
    emits one row a replicate and held fold.  ``chosen`` is what ``context_model`` returned.
    """
    k = len(names) + 1
    f = [F.lit(1.0), *[F.col(c).cast("double") for c in names]]
    x, y = F.col("x"), F.col("y")
    stats = F.array(*[F.sum(x * x * f[a] * f[b]) for a in range(k) for b in range(k)], *[F.sum(x * y * v) for v in f]).alias("stats")
    own = pairs.where("x IS NOT NULL AND y IS NOT NULL").join(features, "gene_id").groupBy("target").agg(stats).join(folds.select("target", "outer"), "target")
    penalties = {r.held: (r.multiplier, r.penalty) for r in chosen.collect()}  # a row per fold
    width = k * k + k

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {h: np.zeros((replicates, width)) for h in penalties}
        for batch in batches:
            key, outer = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            values = np.array(batch.column(2).to_pylist(), float).reshape(len(key), width)
            w = poisson_weights(key, replicates, seed)
            for h in total:
                total[h] += w[outer != h].T @ values[outer != h]
        for h, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(replicates, h), pa.int32()), pa.array(np.arange(replicates), pa.int32()), pa.array(list(sums), pa.list_(pa.float64()))], names=["held", "replicate", "sums"])

    weighed = own.select(F.xxhash64("target").alias("key"), F.col("outer").cast("int").alias("outer"), "stats").mapInArrow(weigh, "held int, replicate int, sums array<double>")
    summed = weighed.groupBy("held", "replicate").agg(F.array(*[F.sum(F.get("sums", F.lit(j))) for j in range(width)]).alias("sums"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, betas = batch.column(0).to_pylist(), []
            for h, s in zip(held, batch.column(2).to_pylist(), strict=True):
                a, b = np.array(s[: k * k]).reshape(k, k), np.array(s[k * k :])
                if np.isinf(penalties[h][0]):
                    betas.append([b[0] / a[0, 0] if a[0, 0] else 0.0, *[0.0] * (k - 1)])
                else:
                    betas.append(np.linalg.pinv(a + np.diag([0.0, *[penalties[h][0] * (a[0, 0] or 1.0)] * (k - 1)])) @ b)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([list(map(float, b)) for b in betas], pa.list_(pa.float64()))], names=["held", "beta"])

    solved = summed.mapInArrow(solve, "held int, beta array<double>").select("held", F.posexplode("beta").alias("k", "value"))
    label = F.element_at(F.array(*[F.lit(c) for c in ("constant", *names)]), F.col("k") + 1)
    return solved.groupBy("held", label.alias("coefficient")).agg(
        F.percentile("value", F.lit(0.025)).alias("q025"), F.percentile("value", F.lit(0.5)).alias("median"), F.percentile("value", F.lit(0.975)).alias("q975"), F.avg((F.col("value") > 0).cast("double")).alias("positive_fraction")
    )


def bootstrap_genes(pairs: DataFrame, folds: DataFrame, chosen: DataFrame, replicates: int = 500, seed: int = 0, genes_together: int = 128) -> DataFrame:
    """held, gene_id and the q025, median, q975 and positive_fraction of a gene's scale less the pooled scale of the same replicate.

    The prior's multiplier is that of ``chosen`` (held, multiplier); its energy is the final fit's, ``energy``.  A task holds the entries of
    ``genes_together`` genes over all targets, and ``replicates`` x genes sums; replicates times targets rows are never made.
    """
    known = pairs.where("x IS NOT NULL AND y IS NOT NULL").join(folds.select("target", "outer"), "target").select(F.xxhash64("target").alias("key"), F.col("outer").cast("int").alias("outer"), "gene_id", "x", "y")
    settings = {r.held: (r.multiplier, r.energy) for r in chosen.collect()}  # a row per fold
    totals = known.groupBy("key", "outer").agg(F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("x") * F.col("y")).alias("xy"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {h: np.zeros((2, replicates)) for h in settings}
        for batch in batches:
            key, outer, xx, xy = (batch.column(j).to_numpy() for j in range(4))
            w = poisson_weights(key, replicates, seed)
            for h in total:
                keep = outer != h
                total[h] += np.stack([xx[keep] @ w[keep], xy[keep] @ w[keep]])
        for h, (xx, xy) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(replicates, h), pa.int32()), pa.array(np.arange(replicates), pa.int32()), pa.array(xx), pa.array(xy)], names=["held", "replicate", "xx", "xy"])

    pooled = {h: np.zeros(replicates) for h in settings}
    for r in totals.mapInArrow(weigh, "held int, replicate int, xx double, xy double").groupBy("held", "replicate").agg(F.sum("xx").alias("xx"), F.sum("xy").alias("xy")).collect():  # folds times replicates
        pooled[r.held][r.replicate] = r.xy / r.xx if r.xx else 0.0
    kind = pairs.schema["gene_id"].dataType.simpleString()

    def of_genes(table: pa.Table) -> pa.Table:
        gene, key, outer, x, y = (table[c].to_numpy() for c in ("gene_id", "key", "outer", "x", "y"))
        order = np.argsort(gene, kind="stable")
        gene, key, outer, x, y = gene[order], key[order], outer[order], x[order], y[order]
        keys, row = np.unique(key, return_inverse=True)
        w = poisson_weights(keys, replicates, seed)
        genes, starts = np.unique(gene, return_index=True)
        terms = np.stack([v * (outer != h) for h in settings for v in (x * x, x * y)])  # of all held folds, each gene's weights are taken once
        sums = np.stack([terms[:, at:end] @ w[row[at:end]] for at, end in zip(starts, [*starts[1:], len(gene)], strict=True)], axis=1)
        found = []
        for j, (h, (multiplier, energy)) in enumerate(settings.items()):
            if np.isinf(multiplier):
                away = np.zeros((len(genes), replicates))
            else:
                lam = multiplier * energy
                below = sums[2 * j] + lam
                seen = sums[2 * j] > 0  # a replicate without an entry of the gene has the pooled scale, not one beside it by rounding
                away = np.where(seen, (sums[2 * j + 1] + lam * pooled[h]) / np.where(seen, below, 1), pooled[h]) - pooled[h]
            found.append(pa.table([np.full(len(genes), h, np.int64), genes, *np.quantile(away, [0.025, 0.5, 0.975], axis=1), (away > 0).mean(axis=1)], names=["held", "gene_id", "q025", "median", "q975", "positive_fraction"]))
        return pa.concat_tables(found)

    dealt = known.withColumn("block", F.floor(F.col("gene_id") / genes_together))
    return dealt.groupBy("block").applyInArrow(of_genes, f"held long, gene_id {kind}, q025 double, median double, q975 double, positive_fraction double")
