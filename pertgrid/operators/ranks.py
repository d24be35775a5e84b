"""Ranks, order-based selection and multiplicity corrections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import hash_order


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def midrank(value: Column | str, *keys: str, descending: bool = False) -> Column:
    """Average rank of ties, from 1."""
    order = _c(value).desc() if descending else _c(value).asc()
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, _c(value)))
    return F.rank().over(Window.partitionBy(*keys).orderBy(order)) + (ties - 1) / 2.0


def tolerant_rank(scores: DataFrame, key: str, item: str, value: str, own: Column, tolerance: float = 1e-12) -> DataFrame:
    """Rank (from 0) of the row ``own`` marks among its key's rows: greater ones, and half of those equal within the tolerance.

    The own value is carried to the other rows by a window, so no pair is made.
    """
    whole = Window.partitionBy(key)
    mine = F.max(F.when(own, F.col(value))).over(whole)
    close = F.abs(F.col(value) - mine) <= tolerance * (1 + F.abs(mine))
    marked = scores.select(key, item, value, own.alias("is_own"), mine.alias("own_value"), close.alias("close"))
    return marked.groupBy(key).agg(
        (F.count_if((F.col(value) > F.col("own_value")) & ~F.col("close")) + 0.5 * (F.count_if("close") - 1)).alias("rank0"),
        F.count(F.lit(1)).alias("n"),
    )


def position(*order: Column | str, keys: tuple[str, ...] = ()) -> Column:
    """1-based place in the order within the keys."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


def hash_ranks(rows: DataFrame, keys: list[str], order: Column, tie: list[str], name: str = "rank") -> DataFrame:
    """``rows`` with their rank (from 1) within ``keys`` along ``order``, a column of hexadecimal hashes; ``tie`` decides equal hashes.

    Counts of the first three digits give the rank at which each of 4096 parts begins; only parts are ordered.  Null keys are a key.
    """
    marked = rows.withColumn("_h", order).withColumn("_part", F.substring("_h", 1, 3))
    sizes = marked.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_part").alias("_begins"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    same = F.col("_part") == F.col("_begins")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    within = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("_h", *tie))
    return marked.join(starts, same).withColumn(name, F.col("_start") + within).select(*rows.columns, name)


def top_k(df: DataFrame, k: int | Column, keys: list[str], *order: Column) -> DataFrame:
    """First k rows per key.  Spark limits each task's groups before the shuffle."""
    return df.withColumn("rank", position(*order, keys=tuple(keys))).where(F.col("rank") <= k)


def nth_best(df: DataFrame, n: int, keys: list[str], *order: Column) -> DataFrame:
    return df.withColumn("rank", position(*order, keys=tuple(keys))).where(F.col("rank") == n)


def bottom_k_random_ties(df: DataFrame, k: int, keys: list[str], value: str, item: str, seed: int = 0) -> DataFrame:
    return top_k(df, k, keys, F.col(value).asc(), hash_order(item, seed=seed))


def _corrected(df: DataFrame, p: str, keys: list[str], out: str, order: list[Column], scaled: Callable[[Column, Column], Column], best: Callable[[str], Column]) -> DataFrame:
    """``best`` over the rows so far, along ``order`` within each key, of ``scaled(m, place)``; at most 1, null where p is.

    All windows have the same order, nulls last, so that a key's rows are sorted once.
    """
    walk = Window.partitionBy(*keys).orderBy(*order)
    placed = df.withColumn("_place", F.row_number().over(walk)).withColumn("_m", F.count(F.col(p)).over(Window.partitionBy(*keys)))
    known = F.col(p).isNotNull()
    valued = placed.withColumn("_scaled", F.when(known, scaled(F.col("_m"), F.col("_place"))))
    upto = walk.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return valued.withColumn(out, F.when(known, F.least(F.lit(1.0), best("_scaled").over(upto)))).drop("_place", "_m", "_scaled")


def benjamini_hochberg(df: DataFrame, p: str, keys: list[str], out: str = "p_adj", tie: str | None = None) -> DataFrame:
    """Reverse cumulative minimum of p * m / rank within each key, at most 1; null p take no part."""
    order = [F.col(p).desc_nulls_last()] + ([F.col(tie).desc()] if tie else [])
    return _corrected(df, p, keys, out, order, lambda m, place: F.col(p) * m / (m - place + 1), F.min)  # the last place has rank 1


def holm(df: DataFrame, p: str, keys: list[str], out: str = "p_holm", tie: str | None = None) -> DataFrame:
    """Forward cumulative maximum of p * (m - rank + 1), at most 1; null p take no part and stay null."""
    order = [F.col(p).asc_nulls_last()] + ([F.col(tie).asc()] if tie else [])
    return _corrected(df, p, keys, out, order, lambda m, place: F.col(p) * (m - place + 1), F.max)


def weighted_median(df: DataFrame, value: str, weight: str, keys: list[str]) -> DataFrame:
    """Lower weighted median: the first value at which the cumulative weight reaches half."""
    summed = df.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    upto = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = summed.withColumn("_cum", F.sum("_w").over(upto)).withColumn("_all", F.sum("_w").over(Window.partitionBy(*keys)))
    return cum.where(F.col("_cum") >= F.col("_all") / 2).groupBy(*keys).agg(F.min(value).alias("weighted_median"))


def quantile_bins(df: DataFrame, value: str, item: str, bins: int, keys: tuple[str, ...] = (), out: str = "bin") -> DataFrame:
    """Equal-count bins over first-come ranks, numbered from 1."""
    return df.withColumn(out, F.ntile(bins).over(Window.partitionBy(*keys).orderBy(value, item)))


def value_edges(df: DataFrame, value: str, bins: int) -> list[float]:
    """Distinct interpolated quantile edges: ``bins`` + 1 numbers at most."""
    row = df.agg(F.percentile(value, F.array(*[F.lit(k / bins) for k in range(bins + 1)])).alias("e")).first()
    return sorted(set(row.e)) if row.e else []


def cut(value: Column | str, edges: list[float]) -> Column:
    """Number of the right-closed interval, from 1; the lowest edge belongs to the first.  Null outside."""
    out = F.lit(None).cast("int")
    for k in range(len(edges) - 1, 0, -1):
        low = (_c(value) >= edges[0]) if k == 1 else (_c(value) > edges[k - 1])
        out = F.when(low & (_c(value) <= edges[k]), F.lit(k)).otherwise(out)
    return out


def permute_within(df: DataFrame, keys: list[str], item: str, value: str, seed: int = 0, out: str = "permuted") -> DataFrame:
    """Values dealt anew among the items of each key: the k-th item in order gets the value of the k-th in a hash order."""
    by_item = df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(item)))
    by_hash = df.select(*keys, F.col(value).alias(out), F.row_number().over(Window.partitionBy(*keys).orderBy(hash_order(item, seed=seed))).alias("_k"))
    return by_item.join(by_hash, [*keys, "_k"]).drop("_k")


def reach(df: DataFrame, keys: list[str], correct: str, *order: Column, purity: float = 0.9) -> DataFrame:
    """Length of the deepest prefix in the order whose share of correct rows is at least ``purity``; 0 without one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    share = F.avg(F.col(correct).cast("double")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = df.select(*keys, F.row_number().over(w).alias("_rn"), share.alias("_share"))
    return ranked.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("_share") >= purity - 1e-12, F.col("_rn"))), F.lit(0)).alias("reach"), F.count(F.lit(1)).alias("n"))


def spearman_brown(r: Column | str) -> Column:
    return F.try_divide(2 * _c(r), 1 + _c(r))


def boundary(value: str, *order: str, keys: tuple[str, ...] = ()) -> Column:
    """True where the value differs from the one before, and in the first row."""
    return ~F.col(value).eqNullSafe(F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))) | (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1)


def crossing_counts(df: DataFrame, keys: list[str], value: str, item: str, offset: Column, seed: int = 0) -> DataFrame:
    """Integers whose running sums follow those of ``value``: differences of floor(cumsum - offset) in a hash order."""
    w = Window.partitionBy(*keys).orderBy(hash_order(*keys, item, seed=seed))
    cum = F.floor(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - offset)
    stepped = df.withColumn("_f", cum)
    return stepped.withColumn("drawn", (F.col("_f") - F.coalesce(F.lag("_f").over(w), F.lit(-1))).cast("long")).drop("_f")
