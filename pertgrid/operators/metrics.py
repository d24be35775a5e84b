"""Scores of predicted effects against measured ones.

``pairs`` has target, gene_id, prediction and truth, on a common grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import safe_divide
from .effects import cosine_of, pair_scores

P, T = F.col, F.col


def aligned(prediction: DataFrame, truth: DataFrame, own_genes: bool = True) -> DataFrame:
    """Both relations on the genes that either has for the target; absent values are 0.  Without ``own_genes`` a target's own gene is left out."""
    both = prediction.select("target", "gene_id", F.col("value").alias("prediction")).join(truth.select("target", "gene_id", F.col("value").alias("truth")), ["target", "gene_id"], "full").na.fill(0.0, ["prediction", "truth"])
    return both if own_genes else both.where(F.col("target").cast("string") != F.col("gene_id").cast("string"))


def profile_metrics(pairs: DataFrame, keys: list[str], zero_norm: float | None = None) -> DataFrame:
    """cosine, normalised absolute error, norm ratio, mean squared error and sign agreement per key, in one pass."""
    p, t = F.col("prediction"), F.col("truth")
    s = pairs.groupBy(*keys).agg(F.sum(p * t).alias("pt"), F.sum(p * p).alias("pp"), F.sum(t * t).alias("tt"), F.sum(F.abs(p - t)).alias("ae"), F.sum(F.abs(t)).alias("at"), F.sum((p - t) * (p - t)).alias("se"), F.avg((F.signum(p) == F.signum(t)).cast("double")).alias("sign_agreement"))
    return s.select(
        *keys, cosine_of_sums("pt", "pp", "tt", zero_norm).alias("cosine"), safe_divide(F.col("ae"), F.col("at")).alias("nae"),
        F.sqrt(safe_divide(F.col("pp"), F.col("tt"))).alias("norm_ratio"), F.col("se").alias("squared_error"), F.col("tt").alias("energy"), "sign_agreement",
    )


def cosine_of_sums(pt: str, pp: str, tt: str, zero_norm: float | None = None) -> Column:
    return safe_divide(F.col(pt), F.sqrt(F.col(pp) * F.col(tt)), zero_norm)


def ratio_of_sums(scores: DataFrame, keys: list[str], numerator: str = "squared_error", denominator: str = "energy") -> DataFrame:
    return scores.groupBy(*keys).agg(safe_divide(F.sum(numerator), F.sum(denominator)).alias("ratio"))


def energy_decomposition(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """error / energy = 1 + P / Y - 2 C / Y, of the three sums P, Y and C."""
    p, t = F.col("prediction"), F.col("truth")
    s = pairs.groupBy(*keys).agg(F.sum(p * p).alias("pp"), F.sum(t * t).alias("yy"), F.sum(p * t).alias("c"), F.sum((p - t) * (p - t)).alias("se"))
    return s.select(*keys, safe_divide(F.col("se"), F.col("yy")).alias("ratio"), (1 + safe_divide(F.col("pp"), F.col("yy")) - 2 * safe_divide(F.col("c"), F.col("yy"))).alias("decomposed"))


def signed_recovery(pairs: DataFrame, k: int | str, keys: tuple[str, ...] = ("target",)) -> DataFrame:
    """Of the k truths largest in size: share among the k largest predictions (recall), and with the right sign too.

    ``k`` is a number or a column that holds each target's own number.  Ties go to the smaller gene.
    """
    limit = F.lit(k) if isinstance(k, int) else F.col(k)
    by = lambda c: F.row_number().over(Window.partitionBy(*keys).orderBy(F.abs(F.col(c)).desc(), "gene_id"))
    r = pairs.withColumn("pr", by("prediction")).withColumn("tr", by("truth")).withColumn("k", limit)
    both = (F.col("pr") <= F.col("k")) & (F.col("tr") <= F.col("k"))
    right = both & (F.signum("prediction") == F.signum("truth"))
    return r.groupBy(*keys).agg(
        safe_divide(F.count_if(both), F.max("k")).alias("recall"), safe_divide(F.count_if(right), F.max("k")).alias("signed_recovery"), safe_divide(F.count_if(right), F.count_if(both)).alias("sign_given_recovered")
    )


def retrieval(prediction: DataFrame, truth: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Rank of each target's own truth among all truths by cosine with its prediction: score 1 - rank0 / (n - 1), midranks.

    A prediction without norm scores 0.5.  ``tolerance`` widens ties.
    """
    scores = pair_scores(prediction, truth).withColumn("similarity", cosine_of("dot", "norm_i", "norm_j", 0.0))
    targets = truth.select(F.col("target").alias("j")).distinct()
    every = prediction.select(F.col("target").alias("i")).distinct().join(targets, how="cross").join(scores.select("i", "j", "similarity"), ["i", "j"], "left").na.fill(0.0, ["similarity"])
    mine = F.max(F.when(F.col("i") == F.col("j"), F.col("similarity"))).over(Window.partitionBy("i"))
    marked = every.withColumn("own", mine)
    equal = F.abs(F.col("similarity") - F.col("own")) <= tolerance * (1 + F.abs("own"))
    ranked = marked.groupBy(F.col("i").alias("target")).agg((F.count_if((F.col("similarity") > F.col("own")) & ~equal) + 0.5 * (F.count_if(equal) - 1)).alias("rank0"), F.count(F.lit(1)).alias("n"), F.max("own").alias("similarity"))
    return ranked.where(F.col("similarity").isNotNull()).select("target", "rank0", (1 - safe_divide(F.col("rank0"), F.col("n") - 1, 0.5)).alias("score"), (F.col("rank0") == 0).alias("top1"), "similarity")


def matched_minus_wrong(pairs: DataFrame) -> DataFrame:
    """Matched cosine minus the median of the wrong ones; ``pairs`` has i, j and cosine."""
    return pairs.groupBy("i").agg((F.max(F.when(F.col("i") == F.col("j"), F.col("cosine"))) - F.median(F.when(F.col("i") != F.col("j"), F.col("cosine")))).alias("margin"))


def expression_bins(pairs: DataFrame, expression: str, edges=(0.0, 0.1, 1.0, 5.0, 20.0, 100.0)) -> DataFrame:
    """Share of the error and of the truth's energy per half-open expression bin; the last bin is open."""
    label = F.lit(None).cast("int")
    for k, low in enumerate(edges):
        label = F.when(F.col(expression) >= low, F.lit(k)).otherwise(label)
    e = (F.col("prediction") - F.col("truth")) * (F.col("prediction") - F.col("truth"))
    s = pairs.withColumn("bin", label).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum(e).alias("se"), F.sum(F.col("truth") * F.col("truth")).alias("tt"))
    w = Window.partitionBy()
    return s.select("bin", "n", safe_divide(F.col("se"), F.sum("se").over(w)).alias("error_share"), safe_divide(F.col("tt"), F.sum("tt").over(w)).alias("energy_share"))


def common_response(prediction: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Every target with the mean of the predicted profiles."""
    return prediction.withColumn("value", F.avg("value").over(Window.partitionBy(*keys, "gene_id")))


def reference_scaled(score: Column, baseline: Column, reference: Column) -> Column:
    """(score - baseline) / (reference - baseline)."""
    return safe_divide(score - baseline, reference - baseline)


def scoped_summary(scores: DataFrame, quartile: str, values: list[str], numerator: str, denominator: str) -> DataFrame:
    """Mean and median of the values, and the ratio of sums, overall and per quartile."""
    scoped = scores.withColumn("scope", F.explode(F.array(F.lit("overall"), F.concat(F.lit("Q"), F.col(quartile).cast("string")))))
    aggs = [a for v in values for a in (F.avg(v).alias(f"mean_{v}"), F.median(v).alias(f"median_{v}"))]
    return scoped.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), *aggs, safe_divide(F.sum(numerator), F.sum(denominator)).alias("ratio"))


def paired_differences(scores: DataFrame, model: str, a: str, b: str, value: str) -> DataFrame:
    """Per target the value of model a minus that of model b, for targets that both have."""
    x = scores.where(F.col(model) == a).select("target", F.col(value).alias("va"))
    y = scores.where(F.col(model) == b).select("target", F.col(value).alias("vb"))
    return x.join(y, "target").select("target", (F.col("va") - F.col("vb")).alias("difference"))


def best_per_target(scores: DataFrame, *order: Column) -> DataFrame:
    return scores.withColumn("_r", F.row_number().over(Window.partitionBy("target").orderBy(*order))).where("_r = 1").drop("_r")


def significant_jaccard(a: DataFrame, b: DataFrame, keys: list[str], empty: float | None = 1.0) -> DataFrame:
    """Jaccard similarity of the significant genes (``significant``) of two tables per key; ``empty`` for an empty union."""
    x = a.select(*keys, "gene_id", F.col("significant").alias("sa"))
    y = b.select(*keys, "gene_id", F.col("significant").alias("sb"))
    both = x.join(y, [*keys, "gene_id"], "full").na.fill(False, ["sa", "sb"])
    return both.groupBy(*keys).agg(safe_divide(F.count_if(F.col("sa") & F.col("sb")), F.count_if(F.col("sa") | F.col("sb")), empty).alias("jaccard"))
