"""Cell quality, neighbours, signatures, gene-set scores and families."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import MITOCHONDRIAL_PREFIX, safe_divide
from .ranks import midrank


def cell_quality(cells: DataFrame, genes: DataFrame, top: int = 20) -> DataFrame:
    """Per cell: total, genes, share of its ``top`` largest genes, mitochondrial share, and unseen mass (Good-Turing) in percent."""
    named = cells.join(genes.select("gene_id", "symbol"), "gene_id", "left")
    rn = F.row_number().over(Window.partitionBy("row_id").orderBy(F.col("count").desc(), "gene_id"))
    r = named.withColumn("_r", rn)
    total = F.sum("count")
    return r.groupBy("row_id").agg(
        total.cast("long").alias("total"), F.count_if(F.col("count") > 0).alias("n_genes"),
        safe_divide(F.sum(F.when(F.col("_r") <= top, F.col("count"))), total).alias("top_share"),
        safe_divide(F.coalesce(F.sum(F.when(F.col("symbol").startswith(MITOCHONDRIAL_PREFIX), F.col("count"))), F.lit(0)), total).alias("mito_share"),
        safe_divide(100.0 * F.count_if(F.col("count") == 1), total).alias("unseen_mass"),
    )


def mad_selection(values: DataFrame, n: int) -> DataFrame:
    """The n genes with the largest median absolute deviation of log2(value + 1) over the rows given."""
    logged = values.select("gene_id", F.log2(F.col("value") + 1).alias("v"))
    centre = logged.groupBy("gene_id").agg(F.median("v").alias("m"))
    spread = logged.join(centre, "gene_id").groupBy("gene_id").agg(F.median(F.abs(F.col("v") - F.col("m"))).alias("mad"))
    return spread.orderBy(F.col("mad").desc(), "gene_id").limit(n)


def variable_genes(values: DataFrame, n_cells: int, bins: int = 20, n: int = 2000) -> DataFrame:
    """Dispersion of each gene (variance over mean, zeros counted), standardised within equal-width bins of the log mean; the top n."""
    m = values.groupBy("gene_id").agg((F.sum("value") / n_cells).alias("mean"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    d = m.withColumn("dispersion", safe_divide((F.col("ss") - n_cells * F.col("mean") * F.col("mean")) / (n_cells - 1), F.col("mean")))
    logged = d.where("dispersion > 0").select("gene_id", F.log1p("mean").alias("lm"), F.log("dispersion").alias("ld"))
    span = logged.agg(F.min("lm").alias("lo"), F.max("lm").alias("hi"))
    binned = logged.join(F.broadcast(span), how="cross").withColumn("bin", F.least(F.lit(bins - 1), F.floor(safe_divide((F.col("lm") - F.col("lo")) * bins, F.col("hi") - F.col("lo"), 0.0))))
    w = Window.partitionBy("bin")
    z = safe_divide(F.col("ld") - F.avg("ld").over(w), F.stddev_samp("ld").over(w))
    return binned.select("gene_id", "bin", F.coalesce(z, F.lit(0.0)).alias("normalised")).orderBy(F.col("normalised").desc(), "gene_id").limit(n)


def nearest(queries: DataFrame, base: DataFrame, key: str, array: str, k: int, keys: tuple[str, ...] = (), block: int = 2048) -> DataFrame:
    """The k nearest base vectors (Euclidean) of every query of the same group: (query, neighbour, distance, rank).

    The base is dealt into blocks of about ``block`` vectors; every query meets every block of its group once, as
    matrices, and only its k best of each block go on.  ``queries`` is a stated set; a row does not find itself.
    """
    group = [F.col(c) for c in keys]
    sizes = base.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")) if keys else base.agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    attach = lambda df: df.join(F.broadcast(sizes), list(keys)) if keys else df.join(F.broadcast(sizes), how="cross")
    b = attach(base.select(*group, F.col(key).cast("long").alias("id"), F.col(array).cast("array<double>").alias("v"))).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("is_query", F.lit(False))
    q = attach(queries.select(*group, F.col(key).cast("long").alias("id"), F.col(array).cast("array<double>").alias("v"))).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("is_query", F.lit(True))
    both = b.drop("blocks").unionByName(q.drop("blocks"))

    def block_best(pdf: pd.DataFrame) -> pd.DataFrame:
        queries_, rows = pdf[pdf.is_query], pdf[~pdf.is_query]
        out = []
        if len(queries_) and len(rows):
            x, ids = np.stack(rows.v.to_numpy()), rows.id.to_numpy()
            xx = (x * x).sum(axis=1)
            for at in range(0, len(queries_), 1024):
                part = queries_.iloc[at : at + 1024]
                y = np.stack(part.v.to_numpy())
                d2 = np.maximum(0.0, (y * y).sum(axis=1)[:, None] + xx[None, :] - 2 * y @ x.T)
                d2[part.id.to_numpy()[:, None] == ids[None, :]] = np.inf
                take = min(k, len(ids))
                best = np.argpartition(d2, take - 1, axis=1)[:, :take]
                for own, cols, dist in zip(part.id.to_numpy(), best, d2, strict=True):
                    out += [(int(own), int(ids[c]), float(np.sqrt(dist[c]))) for c in cols if np.isfinite(dist[c])]
        return pd.DataFrame(out, columns=["query", "neighbour", "distance"]).astype({"query": "int64", "neighbour": "int64", "distance": "float64"})

    found = both.groupBy(*group, "block").applyInPandas(block_best, "query long, neighbour long, distance double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "neighbour"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def neighbour_signature(neighbours: DataFrame, values: DataFrame) -> DataFrame:
    """log1p of the neighbours' mean expression minus the cell's own log expression; ``values`` (row_id, gene_id, value) are log1p."""
    n = neighbours.groupBy("query").agg(F.count(F.lit(1)).alias("k"))
    around = neighbours.join(values.withColumnRenamed("row_id", "neighbour"), "neighbour").groupBy("query", "gene_id").agg(F.sum(F.expm1("value")).alias("s")).join(n, "query").select(F.col("query").alias("row_id"), "gene_id", F.log1p(F.col("s") / F.col("k")).alias("around"))
    own = values.join(neighbours.select(F.col("query").alias("row_id")).distinct(), "row_id", "left_semi")
    return own.join(around, ["row_id", "gene_id"], "full").na.fill(0.0, ["value", "around"]).select("row_id", "gene_id", (F.col("around") - F.col("value")).alias("value"))


def mixture_posteriors(scores: DataFrame, group: str, item: str, score: str, bins: int = 512, rounds: int = 100) -> DataFrame:
    """Posterior of the upper of two normal components per group, fitted by EM to each group's histogram.

    A histogram of ``bins`` cells bounds what one task holds for a group; posteriors are then computed row by row.  Groups are few beside
    their rows, so a row per group is broadcast and no group's rows meet in one task.
    """
    span = scores.groupBy(group).agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    binned = scores.join(F.broadcast(span), group).withColumn("b", F.least(F.lit(bins - 1), F.floor(safe_divide((F.col(score) - F.col("lo")) * bins, F.col("hi") - F.col("lo"), 0.0)))).groupBy(group, "b").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("x"))
    kind = next(f.dataType.simpleString() for f in scores.schema.fields if f.name == group)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("b")
        x, n = pdf.x.to_numpy(float), pdf.n.to_numpy(float)
        mid = np.average(x, weights=n)
        m = np.array([np.average(x[x <= mid], weights=n[x <= mid]), np.average(x[x > mid], weights=n[x > mid]) if (x > mid).any() else mid])
        spread = max(np.sqrt(np.average((x - mid) ** 2, weights=n)), 1e-6)
        s, w = np.array([spread, spread]), np.array([0.5, 0.5])
        for _ in range(rounds):
            d = w / s * np.exp(-0.5 * ((x[:, None] - m) / s) ** 2)
            r = d / np.maximum(d.sum(axis=1, keepdims=True), 1e-300) * n[:, None]
            mass = np.maximum(r.sum(axis=0), 1e-9)
            w, m = mass / mass.sum(), (r * x[:, None]).sum(axis=0) / mass
            s = np.maximum(np.sqrt((r * (x[:, None] - m) ** 2).sum(axis=0) / mass), 1e-3 * spread)
        a, b = np.argsort(m)
        return pd.DataFrame([(pdf[group].iloc[0], m[a], s[a], w[a], m[b], s[b], w[b])], columns=[group, "m0", "s0", "w0", "m1", "s1", "w1"])

    fitted = binned.groupBy(group).applyInPandas(fit, f"{group} {kind}, m0 double, s0 double, w0 double, m1 double, s1 double, w1 double")
    dens = lambda k: F.log(F.col(f"w{k}") / F.col(f"s{k}")) - F.pow((F.col(score) - F.col(f"m{k}")) / F.col(f"s{k}"), F.lit(2)) / 2
    return scores.join(F.broadcast(fitted), group).select(group, item, score, (1 / (1 + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), dens(0) - dens(1)))))).alias("posterior"))


def diagonal_fisher(values: DataFrame, obs: DataFrame, label: str, fold: str, held: int) -> DataFrame:
    """Weights (mean difference) / (pooled variance + a tenth of its median) from all folds but ``held``; label is 1 for perturbed cells."""
    train = obs.where(F.col(fold) != held)
    n = train.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    s = values.join(train.select("row_id", label), "row_id").groupBy("gene_id", label).agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    g = s.select("gene_id").distinct().join(n, how="cross").join(s, ["gene_id", label], "left").na.fill(0.0, ["s", "ss"])
    m = g.withColumn("mean", F.col("s") / F.col("n")).withColumn("dev", F.col("ss") - F.col("s") * F.col("s") / F.col("n"))
    p = m.groupBy("gene_id").agg(F.sum(F.when(F.col(label) == 1, F.col("mean")).otherwise(-F.col("mean"))).alias("difference"), safe_divide(F.sum("dev"), F.sum("n") - 2).alias("variance"))
    floor = p.agg((0.1 * F.median("variance")).alias("floor"))
    return p.join(F.broadcast(floor), how="cross").select("gene_id", safe_divide(F.col("difference"), F.col("variance") + F.col("floor"), 0.0).alias("weight"))


def axis_scores(values: DataFrame, axis: DataFrame) -> DataFrame:
    """Dot product of each cell with an axis (gene_id, weight); absent genes add nothing."""
    return values.join(axis, "gene_id").groupBy("row_id").agg(F.sum(F.col("value") * F.col("weight")).alias("score"))


def separation(scores: DataFrame, label: str, score: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """d-prime and ROC AUC (by midranks) of label 1 over label 0."""
    ranked = scores.withColumn("_r", midrank(score, *keys))
    one, zero = F.col(label) == 1, F.col(label) == 0
    n1, n0 = F.count_if(one), F.count_if(zero)
    pooled = F.sqrt((F.var_samp(F.when(one, F.col(score))) + F.var_samp(F.when(zero, F.col(score)))) / 2)
    return ranked.groupBy(*keys).agg(
        safe_divide(F.avg(F.when(one, F.col(score))) - F.avg(F.when(zero, F.col(score))), pooled).alias("d_prime"),
        safe_divide(F.sum(F.when(one, F.col("_r"))) - n1 * (n1 + 1) / 2, n1 * n0).alias("auc"),
    )


def enrichment(ranked: DataFrame, sets: DataFrame, keys: list[str], score: str, least: int = 10, most: int = 500) -> DataFrame:
    """Weighted running-sum enrichment score of each gene set in each ranking.

    Only the places of a set's members matter: the running sum moves down linearly between them, so extremes lie just before
    or at a member.  Rows therefore are members, not whole rankings.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), "gene_id")
    placed = ranked.withColumn("place", F.row_number().over(w)).withColumn("n_genes", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    member = placed.join(sets, "gene_id")
    own = Window.partitionBy(*keys, "set")
    upto = own.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    m = member.withColumn("size", F.count(F.lit(1)).over(own)).where((F.col("size") >= least) & (F.col("size") <= most))
    m = m.withColumn("k", F.row_number().over(own.orderBy("place"))).withColumn("up", safe_divide(F.sum(F.abs(score)).over(upto), F.sum(F.abs(score)).over(own), 0.0))
    before = safe_divide(F.abs(score), F.sum(F.abs(score)).over(own), 0.0)
    miss = safe_divide(F.col("place") - F.col("k"), F.col("n_genes") - F.col("size"), 0.0)
    steps = m.withColumn("high", F.col("up") - miss).withColumn("low", F.col("up") - before - miss)
    e = steps.groupBy(*keys, "set").agg(F.max("high").alias("top"), F.min("low").alias("bottom"), F.max("size").alias("size"))
    return e.select(*keys, "set", "size", F.when(F.col("top") >= -F.col("bottom"), F.col("top")).otherwise(F.col("bottom")).alias("es"))


def complete_linkage(pairs: list[tuple], items: list, min_similarity: float) -> dict:
    """Families of a short list by complete linkage: {item: family}; families are numbered by their first item.

    ``pairs`` has the similarities (a, b, s) of a few hundred items at most; absent ones count as -1.
    """
    sim = {frozenset((a, b)): s for a, b, s in pairs if a != b}
    families = [[x] for x in sorted(items)]
    while len(families) > 1:
        best, at = -2.0, None
        for i in range(len(families)):
            for j in range(i + 1, len(families)):
                s = min(sim.get(frozenset((a, b)), -1.0) for a in families[i] for b in families[j])
                if s > best:
                    best, at = s, (i, j)
        if best < min_similarity:
            break
        families[at[0]] += families.pop(at[1])
    return {x: k for k, f in enumerate(sorted(families, key=min)) for x in f}


def partner_mean(effects: DataFrame, membership: DataFrame) -> DataFrame:
    """Mean effect of a target's complex partners: members (target, complex) of a complex predict each other."""
    per_complex = effects.join(membership, "target").groupBy("complex", "gene_id").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("n"))
    own = effects.join(membership, "target").join(per_complex, ["complex", "gene_id"])
    return own.groupBy("target", "gene_id").agg(safe_divide(F.sum(F.col("s") - F.col("value")), F.sum(F.col("n") - 1)).alias("value")).where("value is not null")


def multinomial_energy(pools: DataFrame) -> DataFrame:
    """Expected squared noise of each group's CPM profile under multinomial sampling: 1e12 * (1 - sum p^2) / total, and the measured energy."""
    p = pools.withColumn("total", F.sum("count").over(Window.partitionBy("target"))).withColumn("p", F.col("count") / F.col("total"))
    return p.groupBy("target").agg((1e12 * (1 - F.sum(F.col("p") * F.col("p"))) / F.max("total")).alias("noise"), (1e12 * F.sum(F.col("p") * F.col("p"))).alias("energy"))


def permutation_p(pairs: DataFrame, item_a: str, item_b: str, labels: dict, similarity: str, permutations: int = 1000, seed: int = 0) -> float:
    """(1 + number of label permutations with a mean within-label similarity at least the observed one) / (1 + permutations).

    The pair table of a few hundred items comes to the driver, the permutations run there as numpy arrays.
    """
    rows = pairs.select(item_a, item_b, similarity).collect()
    items = sorted(labels)
    place = {x: k for k, x in enumerate(items)}
    a, b = np.array([place[r[0]] for r in rows]), np.array([place[r[1]] for r in rows])
    s, lab = np.array([r[2] for r in rows], float), np.array([labels[x] for x in items])
    score = lambda x: s[x[a] == x[b]].mean() if (x[a] == x[b]).any() else -np.inf
    observed, rng = score(lab), np.random.default_rng(seed)
    return (1 + sum(score(rng.permutation(lab)) >= observed - 1e-12 for _ in range(permutations))) / (1 + permutations)


def lasso_path(gram: np.ndarray, xy: np.ndarray, lambdas: list[float], rounds: int = 300) -> list[np.ndarray]:
    """Coefficients by coordinate descent on p x p sufficient statistics, from the largest penalty down."""
    out, w = [], np.zeros(len(xy))
    for lam in sorted(lambdas, reverse=True):
        for _ in range(rounds):
            old = w.copy()
            for i in range(len(w)):
                r = xy[i] - gram[i] @ w + gram[i, i] * w[i]
                w[i] = np.sign(r) * max(0.0, abs(r) - lam) / gram[i, i] if gram[i, i] > 0 else 0.0
            if np.abs(w - old).max() < 1e-10:
                break
        out.append(w.copy())
    return out


def _at_most_zero(gram: np.ndarray, xy: np.ndarray) -> np.ndarray:
    """Least squares with the first weight at most 0: where it would be positive, the optimum has it at 0."""
    w = np.linalg.lstsq(gram, xy, rcond=None)[0]
    if w[0] > 0:
        w = np.append(0.0, np.linalg.lstsq(gram[1:, 1:], xy[1:], rcond=None)[0] if len(xy) > 1 else [])
    return w


def matching_pursuit(gram: np.ndarray, xy: np.ndarray, k: int, first: int | None = None, first_negative: bool = False) -> np.ndarray:
    """Orthogonal matching pursuit on sufficient statistics; ``first`` is always chosen, with a weight of at most 0 if ``first_negative``."""
    chosen, w = ([first] if first is not None else []), np.zeros(len(xy))
    while True:
        if chosen:
            w = np.zeros(len(xy))
            own = gram[np.ix_(chosen, chosen)]
            w[chosen] = _at_most_zero(own, xy[chosen]) if first_negative and first is not None else np.linalg.lstsq(own, xy[chosen], rcond=None)[0]
        if len(chosen) >= min(k, len(xy)):
            return w
        r = np.abs(xy - gram @ w) / np.sqrt(np.maximum(np.diag(gram), 1e-300))
        r[chosen] = -1
        chosen.append(int(r.argmax()))


def sparse_signatures(statistics: DataFrame, key: str, k: int, anchored: bool = False) -> DataFrame:
    """Pursuit per key from its own statistics (i, j, g, r): the p x p numbers of one key are what a task holds.

    ``anchored``: a whole-number key names its own column, which is always chosen and never gets a positive weight; it has a row
    with weight 0 where the bound holds it.
    """
    kind = next(f.dataType.simpleString() for f in statistics.schema.fields if f.name == key)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        p = int(max(pdf.i.max(), pdf.j.max())) + 1
        g, r = np.zeros((p, p)), np.zeros(p)
        g[pdf.i, pdf.j] = pdf.g
        r[pdf.i] = pdf.r
        first = int(pdf[key].iloc[0]) if anchored and 0 <= int(pdf[key].iloc[0]) < p else None
        w = matching_pursuit(g, r, k, first, anchored)
        keep = np.nonzero((w != 0) | (np.arange(p) == (-1 if first is None else first)))[0]
        return pd.DataFrame({key: pdf[key].iloc[0], "i": keep, "weight": w[keep]})

    return statistics.groupBy(key).applyInPandas(fit, f"{key} {kind}, i long, weight double")


def cosine_pairs(vectors: DataFrame, key: str, array: str, group: str, block: int = 1024) -> DataFrame:
    """(i, j, cosine) of all pairs i < j of a group's vectors; null where a vector is null or of length 0.  Rows of no group have no pair.

    Blocks of about ``block`` vectors meet once, in tasks of their own: a task holds two blocks and their products, however large the group.
    """
    kind = vectors.schema[key].dataType.simpleString()
    rows = vectors.select(F.col(key).alias("_key"), F.col(array).cast("array<double>").alias("_v"), F.col(group).alias("_group")).where("_key IS NOT NULL AND _group IS NOT NULL")
    sizes = rows.groupBy("_group").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks"))
    dealt = rows.join(sizes, "_group").withColumn("_own", F.pmod(F.xxhash64("_key"), F.col("_blocks")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    met = dealt.select("_group", F.least("_own", "_other").alias("_a"), F.greatest("_own", "_other").alias("_b"), "_own", "_key", "_v")

    def matrix(pdf: pd.DataFrame) -> np.ndarray:
        width = max((len(v) for v in pdf["_v"] if v is not None), default=0)
        return np.stack([np.full(width, np.nan) if v is None else np.asarray(v, float) for v in pdf["_v"]])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        at, own = matrix(pdf), pdf["_own"].to_numpy()
        keys, first = pdf["_key"].to_numpy(), own == pdf["_a"].to_numpy()
        second = first if pdf["_a"].iloc[0] == pdf["_b"].iloc[0] else ~first
        one, other = keys[first], keys[second]
        square = (at * at).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = (at[first] @ at[second].T) / np.sqrt(square[first][:, None] * square[second][None, :])
        row, column = np.nonzero(one[:, None] < other[None, :])
        found = [(one[row], other[column], cosine[row, column])]
        if second is not first:
            row, column = np.nonzero(other[None, :] < one[:, None])
            found.append((other[column], one[row], cosine[row, column]))
        i, j, x = (np.concatenate(part) for part in zip(*found))
        return pd.DataFrame({"i": i, "j": j, "cosine": x})

    return met.groupBy("_group", "_a", "_b").applyInPandas(meet, f"i {kind}, j {kind}, cosine double").withColumn("cosine", F.when(~F.isnan("cosine"), F.col("cosine")))
