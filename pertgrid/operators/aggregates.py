"""Tables over groups: crosstabs, modes, histograms, curves, scaling, explicit zeros."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions.scalar import clip, safe_divide


def crosstab(df: DataFrame, row: str, column: str, members: list) -> DataFrame:
    """Counts of rows by columns; the named columns are there even when empty."""
    return df.groupBy(row).pivot(column, members).agg(F.count(F.lit(1))).na.fill(0)


def mode_of(df: DataFrame, key: str, value: str) -> DataFrame:
    """Most frequent value per key with its count; ties go to the smaller value."""
    n = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(key).orderBy(F.col("n").desc(), value)
    return n.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(key, value, "n")


def ordered_distinct(df: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values with the first place of each."""
    return df.groupBy(value).agg(F.min(order).alias("first"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int = 100) -> DataFrame:
    """Counts of values, winsorised to the range, in equal bins numbered from 0; empty bins are left out."""
    inside = F.greatest(F.lit(low), F.least(F.lit(high), F.col(value)))
    return df.where(F.col(value).isNotNull()).groupBy(F.least(F.lit(bins - 1), F.floor((inside - low) * bins / (high - low))).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def binned_curve(df: DataFrame, x: str, y: str, edges: list[float], series: str, members: list) -> DataFrame:
    """Mean of y per right-closed bin of x, one column per series."""
    label = F.lit(None).cast("int")
    for k in range(len(edges) - 1, 0, -1):
        label = F.when((F.col(x) > edges[k - 1]) & (F.col(x) <= edges[k]), k).otherwise(label)
    return df.withColumn("bin", label).where("bin is not null").groupBy("bin").pivot(series, members).agg(F.avg(y))


def norm_matched(values: DataFrame, reference: DataFrame) -> DataFrame:
    """Each target's vector scaled to the norm of its reference vector; a zero vector stays zero, a missing reference means 0."""
    own = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy("target")))
    norm = reference.groupBy("target").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    return values.withColumn("own", own).join(norm, "target", "left").select("target", "gene_id", (F.col("value") * F.coalesce(safe_divide(F.col("norm"), F.col("own")), F.lit(0.0))).alias("value"))


def standardised(df: DataFrame, value: str, keys: list[str], limit: float = 10.0) -> Column:
    """z-scores (n - 1) within the keys, clipped; 0 where all values are equal."""
    w = Window.partitionBy(*keys)
    return clip(F.coalesce(safe_divide(F.col(value) - F.avg(value).over(w), F.stddev_samp(value).over(w)), F.lit(0.0)), -limit, limit)


def densified(strata: DataFrame, keys: list[str], part: str, parts: int, value: str) -> DataFrame:
    """Explicit zero rows for the parts that a stratum lacks."""
    grid = strata.select(*keys).distinct().withColumn(part, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return grid.join(strata, [*keys, part], "left").na.fill(0, [value])


def gated_genes(means: DataFrame, threshold: float = config.EXPRESSION_GATE) -> DataFrame:
    """Genes whose mean in the reference group is above the threshold."""
    return means.where(F.col("mean") > threshold).select("gene_id")


def deduplicated_by_size(loads: DataFrame, key: str, size: str, order: str) -> DataFrame:
    """Per key the row with the larger size; null loses, ties keep the first."""
    w = Window.partitionBy(key).orderBy(F.col(size).desc_nulls_last(), order)
    return loads.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def two_level_median(df: DataFrame, outer: str, inner: str, flag: Column) -> DataFrame:
    """Count of flagged rows per inner group, then its median (and mean) per outer group."""
    counts = df.groupBy(outer, inner).agg(F.count_if(flag).alias("n"))
    return counts.groupBy(outer).agg(F.median("n").alias("median_n"), F.avg("n").alias("mean_n"), F.count(F.lit(1)).alias("groups"))
