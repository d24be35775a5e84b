"""Joins with checks, set algebra over gene lists, and axis alignment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import safe_divide


class CardinalityError(ValueError):
    """A join key is not unique where it must be."""


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def checked_join(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner", validate: str = "one_to_one") -> DataFrame:
    """Join after checking that the sides are unique on the keys as ``validate`` says (one_to_one, many_to_one, one_to_many)."""
    left, right = validate.split("_to_")
    for side, df, name in ((left, a, "left"), (right, b, "right")):
        if side == "one" and not duplicates(df, keys).isEmpty():
            raise CardinalityError(f"{name} side is not unique on {keys}")
    return a.join(b, keys, how)


def left_fill(a: DataFrame, b: DataFrame, keys: list[str], value: str, otherwise: float = 0.0) -> DataFrame:
    return a.join(b, keys, "left").na.fill(otherwise, [value])


def common_axis(relations: list[DataFrame], axis: str) -> DataFrame:
    """Members that all relations have."""
    tagged = reduce(DataFrame.unionByName, [r.select(axis).distinct().withColumn("_s", F.lit(k)) for k, r in enumerate(relations)])
    return tagged.groupBy(axis).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(relations)).select(axis)


def align(relations: list[DataFrame], axes: list[str]) -> list[DataFrame]:
    """All relations cut to the members that they share on every axis."""
    out = relations
    for axis in axes:
        shared = common_axis(relations, axis)
        out = [r.join(shared, axis, "left_semi") for r in out]
    return out


def union_intersection(target: DataFrame, sources: list[DataFrame], key: str) -> DataFrame:
    """Members of the target with ``broad`` (in any source) and ``strict`` (in all)."""
    tagged = reduce(DataFrame.unionByName, [s.select(key).distinct().withColumn("_s", F.lit(k)) for k, s in enumerate(sources)])
    n = tagged.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return target.select(key).distinct().join(n, key, "left").select(key, F.col("_n").isNotNull().alias("broad"), (F.coalesce("_n", F.lit(0)) == len(sources)).alias("strict"))


def compare_sets(before: DataFrame, after: DataFrame, keys: list[str], member: str, empty: float | None = None) -> DataFrame:
    """shared, gained, lost and Jaccard per key; ``empty`` for an empty union."""
    b = before.select(*keys, member).distinct().withColumn("_b", F.lit(True))
    a = after.select(*keys, member).distinct().withColumn("_a", F.lit(True))
    both = b.join(a, [*keys, member], "full").na.fill(False, ["_a", "_b"])
    shared, gained, lost = F.count_if(F.col("_a") & F.col("_b")), F.count_if(F.col("_a") & ~F.col("_b")), F.count_if(~F.col("_a") & F.col("_b"))
    return both.groupBy(*keys).agg(shared.alias("shared"), gained.alias("gained"), lost.alias("lost"), safe_divide(shared, F.count(F.lit(1)), empty).alias("jaccard"))


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one that the other lacks, repetitions counted; ``side`` says which has them."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def row_differences(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys of both whose values differ (null equals null)."""
    other = b.select(*keys, *[F.col(v).alias(f"{v}_other") for v in values])
    differ = reduce(lambda x, y: x | y, [~F.col(v).eqNullSafe(F.col(f"{v}_other")) for v in values])
    return a.join(other, keys).where(differ)


def ordered_pairs(df: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Ordered pairs of different items of a group: an equi join on the group, for groups that are small by their nature."""
    x, y = df.select(*keys, F.col(item).alias("a")), df.select(*keys, F.col(item).alias("b"))
    return x.join(y, keys).where("a <> b")


def combinations(items: DataFrame, item: str) -> DataFrame:
    """Unordered pairs of a short list such as the contexts."""
    x, y = items.select(F.col(item).alias("a")), items.select(F.col(item).alias("b"))
    return x.join(y, F.col("a") < F.col("b"))


def near_intervals(genes: DataFrame, targets: DataFrame, max_gap: int, bin_size: int | None = None) -> DataFrame:
    """(target, gene_id, gap) within ``max_gap`` on the same chromosome: an equi join on bins of the axis, not on all pairs.

    ``genes`` has gene_id, chr, start, end; ``targets`` target and the same.  A pair is found in the bin where the
    later of both windows begins, so it comes once.
    """
    width = bin_size or max(1, 2 * max_gap)

    def binned(df: DataFrame, low: Column, high: Column) -> DataFrame:
        return df.withColumn("lo", low).withColumn("bin", F.explode(F.sequence(F.floor(low / width), F.floor(high / width))))

    g = binned(genes.select("gene_id", "chr", "start", "end"), F.col("start"), F.col("end"))
    t = binned(targets.select("target", F.col("chr"), F.col("start").alias("ts"), F.col("end").alias("te")), F.col("ts") - max_gap, F.col("te") + max_gap).withColumnRenamed("lo", "tlo")
    gap = F.greatest(F.lit(0), F.col("start") - F.col("te"), F.col("ts") - F.col("end"))
    met = g.join(t, ["chr", "bin"]).where(F.col("bin") == F.floor(F.greatest("lo", "tlo") / width))
    return met.select("target", "gene_id", gap.alias("gap")).where(F.col("gap") <= max_gap)
