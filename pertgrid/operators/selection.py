"""Row roles, masks, arms and report columns: narrow maps, aggregates and joins that keep every row they should."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import hash_order


def with_roles(obs: DataFrame, eligible: Column, is_control: Column, panel: DataFrame, construct: str, context: str) -> DataFrame:
    """Eligible rows that are controls or whose construct is in ``panel`` (one column), with context, exact_construct_id,
    control_role and in_panel."""
    wanted = panel.select(F.col(panel.columns[0]).alias(construct), F.lit(True).alias("in_panel")).distinct()
    joined = obs.where(eligible).join(wanted, construct, "left").withColumn("in_panel", F.coalesce("in_panel", F.lit(False)))
    role = F.when(is_control, "control").otherwise("target")
    return joined.where(is_control | F.col("in_panel")).select("*", F.lit(context).alias("context"), F.col(construct).alias("exact_construct_id"), role.alias("control_role"))


def remapped(rows: DataFrame, category: str, out: str = "code") -> DataFrame:
    """``rows`` with dense codes, from 0, of the categories that they still hold, in their order.

    Only the distinct categories are ordered; null has no code."""
    codes = rows.where(F.col(category).isNotNull()).select(category).distinct().withColumn(out, F.dense_rank().over(Window.orderBy(category)) - 1)
    return rows.join(codes, category, "left")


def outside(effects: DataFrame, gene: str, targets: DataFrame) -> DataFrame:
    """Rows whose gene is not among the one column of ``targets``."""
    return effects.join(targets.select(F.col(targets.columns[0]).alias(gene)).distinct(), gene, "left_anti")


def is_downstream(position: Column, gene: Column, target: Column, output_count: int) -> Column:
    """Among the first ``output_count`` genes and not the target itself."""
    return (position < output_count) & ~gene.eqNullSafe(target)


def first_label(*cases: tuple[Column, str], default: Column) -> Column:
    """The label of the first condition that holds, else ``default``."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for condition, label in cases:
        out = out.when(condition, label)
    return out.otherwise(default)


def strata_support(exposures: DataFrame, controls: DataFrame, strata: list[str], total: str) -> DataFrame:
    """Exposures with the controls of their stratum and whether an effect can be computed there: with controls, or without
    anything to compare."""
    counted = controls.groupBy(*strata).agg(F.count(F.lit(1)).alias("n_controls"))
    joined = exposures.join(counted, strata, "left").withColumn("n_controls", F.coalesce("n_controls", F.lit(0)))
    return joined.withColumn("available", (F.col("n_controls") > 0) | (F.col(total) == 0))


def quantile_vector(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """min, q10, q25, median, q75, q90 and max of the finite values, exact."""
    finite = df.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")))
    points = {"min": 0.0, "q10": 0.1, "q25": 0.25, "median": 0.5, "q75": 0.75, "q90": 0.9, "max": 1.0}
    cut = finite.groupBy(*keys).agg(F.percentile(value, F.array(*[F.lit(x) for x in points.values()])).alias("q"))
    return cut.select(*keys, *[F.get("q", F.lit(k)).alias(name) for k, name in enumerate(points)])


def log_histogram(df: DataFrame, value: str, low: float, high: float, bins: int = 100) -> DataFrame:
    """(bin, n) over equal steps of log10 between ``low`` and ``high``; values beyond are moved to the edges, others than
    positive ones take no part."""
    place = (F.log10(value) - low) / (high - low) * bins
    return df.where(F.col(value) > 0).groupBy(F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(place))).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def size_matched(rows: DataFrame, selected: DataFrame, keys: list[str], item: str, seed: int = 0) -> DataFrame:
    """Of each group of ``rows`` as many, in a random order of the items, as ``selected`` has of it."""
    sizes = selected.groupBy(*keys).agg(F.count(F.lit(1)).alias("wanted"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(hash_order(*keys, item, seed=seed)))
    return rows.join(sizes, keys).withColumn("place", place).where("place <= wanted").drop("place", "wanted")


def tertiles(df: DataFrame, value: str, labels=("low", "mid", "high"), out: str = "bin") -> DataFrame:
    """The named third of each value: cuts at the quantiles 1/3 and 2/3, right-closed."""
    cuts = df.agg(F.percentile(value, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("cuts"))
    third = F.when(F.col(value) <= F.get("cuts", F.lit(0)), labels[0]).when(F.col(value) <= F.get("cuts", F.lit(1)), labels[1]).when(F.col(value).isNotNull(), labels[2])
    return df.crossJoin(F.broadcast(cuts)).withColumn(out, third).drop("cuts")  # one row


def refined_scales(pairs: DataFrame, centres: DataFrame, factors: list[float], group: str) -> DataFrame:
    """Per group the factor of its centre with the least normalised absolute error, and whether it is the grid's edge.

    ``pairs`` (group, prediction, truth) is read once; the errors of all factors are sums of one aggregate.  Ties go to the
    smaller factor."""
    scaled = pairs.join(centres.select(group, "centre"), group)
    sums = scaled.groupBy(group).agg(
        F.first("centre").alias("centre"), F.sum(F.abs("truth")).alias("size"),
        *[F.sum(F.abs(F.col("truth") - F.col("centre") * f * F.col("prediction"))).alias(f"e{k}") for k, f in enumerate(factors)],
    )
    best = F.least(*[F.struct(F.try_divide(F.col(f"e{k}"), F.col("size")).alias("nmae"), F.lit(f).alias("factor")) for k, f in enumerate(factors)])
    picked = sums.select(group, "centre", best.alias("b"))
    return picked.select(group, "centre", F.col("b.factor").alias("factor"), F.col("b.nmae").alias("nmae"), F.col("b.factor").isin(min(factors), max(factors)).alias("at_boundary"))


def absolute_scale(pairs: DataFrame, group: str, least: int = 1) -> DataFrame:
    """The scale of the prediction with the least absolute error: the lower median of truth / prediction weighted by |prediction|;
    groups with fewer than ``least`` non-zero predictions have none."""
    ratios = pairs.where("prediction <> 0").select(group, (F.col("truth") / F.col("prediction")).alias("ratio"), F.abs("prediction").alias("weight"))
    upto = Window.partitionBy(group).orderBy("ratio").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    cum = ratios.withColumn("cum", F.sum("weight").over(upto)).withColumn("all", F.sum("weight").over(Window.partitionBy(group))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(group)))
    return cum.where((F.col("cum") >= F.col("all") / 2) & (F.col("n") >= least)).groupBy(group).agg(F.min("ratio").alias("scale"))


def arm_summary(scores: DataFrame, arm: str, population: str, overlap: Column, least: int = 10) -> DataFrame:
    """Per arm and population the mean score over all rows and over the overlap alone, and whether it has enough of the latter."""
    return scores.groupBy(arm, population).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(overlap).alias("n_overlap"), F.avg("value").alias("mean_all"),
        F.avg(F.when(overlap, F.col("value"))).alias("mean_overlap"), (F.count_if(overlap) >= least).alias("eligible"),
    )


def wide_metrics(scores: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """One row per key from long (keys, metric, value) scores; keys that lack one of the metrics are left out."""
    wide = scores.groupBy(*keys).agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics])
    return wide.dropna(subset=metrics)


def markdown_float(value: Column, digits: int = 3) -> Column:
    """The value with so many digits, a dash for null."""
    return F.when(value.isNull(), "-").otherwise(F.format_string(f"%.{digits}f", value))


def residual_variance_ratio(pairs: DataFrame, key: str) -> DataFrame:
    """Per key the variance of truth - prediction over that of the truth; null where the truth does not vary."""
    s = pairs.groupBy(key).agg(F.var_pop(F.col("truth") - F.col("prediction")).alias("left"), F.var_pop("truth").alias("whole"))
    return s.select(key, F.when(F.col("whole") > 0, F.col("left") / F.col("whole")).alias("ratio"))


def anchor_rows(obs: DataFrame, keys: list[str], item: str, n: int, seed: int = 0) -> DataFrame:
    """(keys, item, place): the first ``n`` items of each group in a random order; the table is what later steps draw from."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(hash_order(*keys, item, seed=seed)))
    return obs.select(*keys, item).withColumn("place", place).where(F.col("place") <= n)


def inventory(rows: DataFrame, id_col: str, refs: dict[str, DataFrame]) -> DataFrame:
    """(check, n): ids that occur more than once, and for each referring column its values that the table of one column lacks."""
    repeated = rows.groupBy(id_col).agg(F.count(F.lit(1)).alias("c")).where("c > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"repeated {id_col}").alias("check"), "n")
    for column, known in refs.items():
        names = rows.where(F.col(column).isNotNull()).select(column).distinct()
        lost = names.join(known.select(F.col(known.columns[0]).alias(column)), column, "left_anti")
        repeated = repeated.unionByName(lost.agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"unresolved {column}").alias("check"), "n"))
    return repeated
