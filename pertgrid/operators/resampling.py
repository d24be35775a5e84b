"""Deterministic splits, folds, draws and resampling nulls.  Draws follow hashes of identities, never row order."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import hash_order, sha_bucket
from .ranks import hash_ranks


def roles(obs: DataFrame, identity: Column, buckets: int = 4) -> DataFrame:
    return obs.withColumn("split", sha_bucket(identity, buckets))


def round_robin(obs: DataFrame, keys: list[str], identity: str, parts: int = 4) -> DataFrame:
    """Parts dealt in turn along a hash order within each stratum, starting at a place that the stratum's hash gives."""
    order = F.row_number().over(Window.partitionBy(*keys).orderBy(hash_order(identity), identity))
    rotation = F.conv(F.substring(hash_order(*keys), 1, 8), 16, 10).cast("long") % parts
    return obs.withColumn("part", ((order - 1 + rotation) % parts).cast("int"))


def balance(parts: DataFrame, keys: list[str], n_parts: int = 4) -> DataFrame:
    """Smallest and largest part of each stratum, absent parts being 0."""
    counts = parts.groupBy(*keys).agg(*[F.count_if(F.col("part") == k).alias(f"n_{k}") for k in range(n_parts)])
    cols = [F.col(f"n_{k}") for k in range(n_parts)]
    return counts.withColumn("smallest", F.least(*cols)).withColumn("largest", F.greatest(*cols))


def halves(obs: DataFrame, keys: list[str], identity: str, seed: int = 0) -> DataFrame:
    """Alternating halves 0 and 1 along a hash order within each stratum; no task orders a stratum."""
    return hash_ranks(obs, keys, hash_order(identity, seed=seed), [identity], "half").withColumn("half", (F.col("half") % 2).cast("int"))


def folds(items: DataFrame, item: str, k: int = 5, seed: int = 0) -> DataFrame:
    """Fold of each item: its place in a hash order mod k.  ``items`` is a list of targets, one row each."""
    return items.withColumn("fold", ((F.row_number().over(Window.orderBy(hash_order(item, seed=seed), item)) - 1) % k).cast("int"))


def derangement(items: DataFrame, item: str, shift: int = 1, seed: int = 0) -> DataFrame:
    """Every item with another one: the item ``shift`` places on in a hash order.  Fixed-point-free for 0 < shift < n."""
    placed = items.select(item, (F.row_number().over(Window.orderBy(hash_order(item, seed=seed), item)) - 1).alias("place"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
    other = placed.select(F.col(item).alias("other"), F.col("place").alias("p"))
    return placed.join(other, (F.col("place") + shift) % F.col("n") == F.col("p")).select(item, "other")


def balanced_draw(obs: DataFrame, group: str, identity: str, total: int, seed: int = 0) -> DataFrame:
    """``total`` rows dealt as evenly as the groups allow: rows ranked within their group, then across groups."""
    within = F.row_number().over(Window.partitionBy(group).orderBy(hash_order(identity, seed=seed), identity))
    turn = obs.withColumn("turn", within).where(F.col("turn") <= total)
    return turn.orderBy("turn", hash_order(group, seed=seed), hash_order(identity, seed=seed)).limit(total)


def random_subsample(obs: DataFrame, identity: str, n: int, seed: int = 0) -> DataFrame:
    return obs.orderBy(hash_order(identity, seed=seed), identity).limit(n)


def bootstrap_draws(n: int, replicates: int, spark, seed: int = 0) -> DataFrame:
    """(replicate, draw, place): n places of 0..n-1 with replacement per replicate, from a hash."""
    grid = spark.range(replicates).select(F.col("id").alias("replicate"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw"))
    return grid.withColumn("place", F.conv(F.substring(hash_order("replicate", "draw", seed=seed), 1, 12), 16, 10).cast("long") % n)


def _drawn(placed: DataFrame, n: int, replicates: int, seed: int) -> DataFrame:
    """The draws with the columns of ``placed``.  Draws look small to the planner (their rows come from a sequence), so without the hint they would
    be the side that is broadcast; built on ``placed``, a task holds its share of the items."""
    return bootstrap_draws(n, replicates, placed.sparkSession, seed).join(placed.hint("shuffle_hash"), "place")


def bootstrap_mean_ci(items: DataFrame, item: str, value: str, replicates: int = 2000, seed: int = 0) -> DataFrame:
    """Mean and the 2.5 and 97.5 percentiles of resampled means.  ``items`` has one row per target."""
    placed = items.where(F.col(value).isNotNull()).select(F.col(value).alias("v"), (F.row_number().over(Window.orderBy(item)) - 1).alias("place"))
    n = placed.count()
    if not n:
        return placed.agg(F.avg("v").alias("mean"), F.avg("v").alias("low"), F.avg("v").alias("high"))
    means = _drawn(placed, n, replicates, seed).groupBy("replicate").agg(F.avg("v").alias("m"))
    return means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high")).join(placed.agg(F.avg("v").alias("mean")), how="cross").select("mean", "low", "high")


def bootstrap_ratio_ci(items: DataFrame, item: str, numerator: str, denominator: str, replicates: int = 2000, seed: int = 0) -> DataFrame:
    """Ratio of sums with its percentile interval; both sums share the draws."""
    placed = items.select(F.col(numerator).alias("a"), F.col(denominator).alias("b"), (F.row_number().over(Window.orderBy(item)) - 1).alias("place"))
    means = _drawn(placed, placed.count(), replicates, seed).groupBy("replicate").agg(F.try_divide(F.sum("a"), F.sum("b")).alias("m"))
    whole = placed.agg(F.try_divide(F.sum("a"), F.sum("b")).alias("ratio"))
    return means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high")).join(whole, how="cross").select("ratio", "low", "high")


def empirical_p(nulls: DataFrame, observed: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(1 + number of null values >= the observed) / (1 + number of null values)."""
    joined = nulls.select(*keys, F.col(value).alias("null_value")).join(observed.select(*keys, F.col(value).alias("observed")), keys)
    return joined.groupBy(*keys).agg(((1 + F.count_if(F.col("null_value") >= F.col("observed"))) / (1 + F.count(F.lit(1)))).alias("p"))


#: Values whose sign vectors are halved into two sorted lists (2 ** 20 sums each); vectors of further ones are walked through.
_HALVED = 40
#: Cells of half a count over scaled sums, and values that are walked through where that is too large.
_CELLS, _WALKED = 1 << 26, 16


def _signed_sums(v: np.ndarray) -> np.ndarray:
    out = np.zeros(1)
    for x in v:
        out = np.concatenate([out - x, out + x])
    return np.sort(out)


def _flip_by_halves(v: np.ndarray) -> float:
    """Meet in the middle: every sum of one half finds its partners in the sorted sums of the other."""
    least = abs(v.sum()) - 1e-12 * max(1.0, np.abs(v).sum())
    if least <= 0:
        return 1.0
    walked, rest = v[_HALVED:], v[:_HALVED]
    a, b = _signed_sums(rest[::2]), _signed_sums(rest[1::2])
    above = sum(int((len(b) - np.searchsorted(b, least - w - a)).sum()) for w in _signed_sums(walked))
    return above / 2.0 ** (len(v) - 1)


def _flip_by_counts(size: np.ndarray, least: int) -> float:
    """Shares of all subset sums of the integers ``size``, in two halves; the signed sum is twice a subset's less the whole."""
    halves = []
    for part in (size[::2], size[1::2]):
        h, n = np.zeros(int(part.sum()) + 1), 1
        h[0] = 1.0
        for x in part:
            half = h[:n] / 2
            h[:n] = half
            h[x : n + x] += half
            n += int(x)
        halves.append(h)
    a, b = halves
    tail = np.append(np.cumsum(b[::-1])[::-1], 0.0)
    tail[0] = 1.0
    places = np.clip((int(size.sum()) + least) // 2 - np.arange(len(a)), 0, len(b))
    return min(1.0, 2 * float(a @ tail[places]))


def sign_flip_p(values) -> float | None:
    """Share of the 2^n sign vectors under which the sum is as far from 0 as it is, counted in whole; null with a null value.

    Up to ``_HALVED`` values meet in the middle.  More are counted on the integers that they are multiples of (up to six
    decimals), or, where there are none or their sum is too large, walked through; NaN where neither can finish.
    """
    if values is None or any(x is None or x != x for x in values):
        return None
    v = np.asarray(values, float)
    v = v[np.argsort(np.abs(v), kind="stable")]
    if len(v) <= _HALVED:
        return _flip_by_halves(v)
    for scale in (10.0**k for k in range(7)):
        whole = np.rint(v * scale)
        if np.abs(v * scale - whole).max() <= 1e-6:
            size = np.abs(whole).astype(np.int64)
            size, least = size[size > 0], abs(int(whole.astype(np.int64).sum()))
            if least == 0:
                return 1.0
            unit = int(np.gcd.reduce(size))
            size, least = size // unit, least // unit
            if size.sum() <= 2 * _CELLS:
                return _flip_by_counts(size, least)
            break
    if len(v) > _HALVED + _WALKED:
        return math.nan
    return _flip_by_halves(v)


def _signs(keys: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """(len(keys), draws) signs, a bit each of a hash of the row's key and the draw's block of 64."""
    words = -(-draws // 64)
    with np.errstate(over="ignore"):
        x = keys.astype(np.int64).view(np.uint64)[:, None] + (np.arange(1, words + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 32)) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return 1.0 - 2.0 * np.unpackbits(x.view(np.uint8), axis=1)[:, :draws]


def drawn_sign_flip(differences: DataFrame, keys: list[str], item: str, value: str, draws: int = 9999, seed: int = 0) -> DataFrame:
    """keys, n, p, se: (1 + sign vectors as far from 0) / (1 + draws) over hashed sign vectors, for keys of any size.

    Tasks add their rows' signed values draw by draw, so a key's values are never gathered; a null value makes p null.
    """
    kinds = ", ".join(f"`{k}` {differences.schema[k].dataType.simpleString()}" for k in keys)
    rows = differences.select(*keys, F.xxhash64(item).alias("_key"), F.col(value).cast("double").alias("_v"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, part in pdf.groupby(keys, dropna=False, sort=False):
                v, total = part["_v"].to_numpy(float), np.zeros(draws)
                for at in range(0, len(v), 512):
                    total += v[at : at + 512] @ _signs(part["_key"].to_numpy()[at : at + 512], draws, seed)
                yield pd.DataFrame({**dict(zip(keys, ([x] * draws for x in (key if isinstance(key, tuple) else (key,))), strict=True)), "draw": np.arange(draws), "total": total})

    sums = rows.mapInPandas(run, f"{kinds}, draw int, total double").groupBy(*keys, "draw").agg(F.sum("total").alias("total"))
    own = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("_v").alias("_own"), F.sum(F.abs("_v")).alias("_size"), F.count_if(F.col("_v").isNull() | F.isnan("_v")).alias("_gone"))
    renamed = own.select(*[F.col(k).alias(f"_{k}") for k in keys], "n", "_own", "_size", "_gone")
    met = sums.join(renamed, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    far = F.abs("total") >= F.abs("_own") - 1e-12 * F.greatest(F.lit(1.0), F.col("_size"))
    p = met.groupBy(*keys).agg(F.max("n").alias("n"), ((1 + F.count_if(far)) / (draws + 1)).alias("p"), F.max("_gone").alias("_gone"))
    p = p.withColumn("p", F.when(F.col("_gone") == 0, F.col("p")))
    return p.select(*keys, "n", "p", F.sqrt(F.col("p") * (1 - F.col("p")) / draws).alias("se"))


def exact_sign_flip(differences: DataFrame, keys: list[str], item: str, value: str, gathered: int = 4096, draws: int = 9999) -> DataFrame:
    """keys, n, p, se, method: two-sided p of the mean under all 2^n sign vectors, for keys of any size.

    Keys of up to ``gathered`` values are counted exactly in one task each (``method`` exact, se 0) where that can be done: up to 56
    values, or any number with a common unit.  All others get ``draws`` hashed sign vectors (``method`` drawn) and the standard error of
    that p.  A null value makes p null.
    """
    sizes = differences.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    named = sizes.select(*[F.col(k).alias(f"_{k}") for k in keys], "_n")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    sized = differences.join(named, same).drop(*[f"_{k}" for k in keys])
    groups = sized.where(F.col("_n") <= gathered).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(item).alias("i"), F.col(value).cast("double").alias("v")))).alias("vs"), F.count(F.lit(1)).alias("n"))
    gone = F.exists("vs", lambda x: x["v"].isNull() | F.isnan(x["v"]))
    p = F.pandas_udf(lambda vs: vs.map(sign_flip_p).astype("float64"), "double")
    # a count takes seconds whatever its bytes: groups are dealt over many tasks, which are not put together again, and counted once for both uses
    spread = groups.repartition(max(64, 4 * differences.sparkSession.sparkContext.defaultParallelism), *keys)
    counted = spread.select(*keys, "n", gone.alias("gone"), p(F.col("vs.v")).alias("p")).withColumn("p", F.when(~F.isnan("p"), F.col("p"))).persist()
    exact = counted.where(F.col("gone") | F.col("p").isNotNull()).select(*keys, "n", "p", F.when(F.col("p").isNotNull(), 0.0).alias("se"), F.lit("exact").alias("method"))
    done = exact.select(*[F.col(k).alias(f"_{k}") for k in keys])
    rest = differences.join(done, same, "left_anti")
    return exact.unionByName(drawn_sign_flip(rest, keys, item, value, draws).withColumn("method", F.lit("drawn")))


def hypergeometric_overlap(population: int, marked: int, drawn: int) -> list[float]:
    """P(overlap = k), k = 0..min(marked, drawn): the null of random gene sets."""
    from math import comb

    whole = comb(population, drawn)
    return [comb(marked, k) * comb(population - marked, drawn - k) / whole for k in range(min(marked, drawn) + 1)]


def fold_search(counts: list[list[float]], k: int, candidates: int, seed: int = 0) -> list[int]:
    """Assignment of items to k folds, of ``candidates`` random ones the one with the smallest imbalance of column sums.

    ``counts`` is a small crosstab (items by strata) on the driver.
    """
    import numpy as np

    rng, table = np.random.default_rng(seed), np.asarray(counts, float)
    base, best, least = np.arange(len(table)) % k, None, np.inf
    for _ in range(candidates):
        assigned = rng.permutation(base)
        sums = np.stack([table[assigned == f].sum(axis=0) for f in range(k)])
        worst = float((sums.max(axis=0) - sums.min(axis=0)).sum())
        if worst < least:
            best, least = assigned, worst
    return [int(x) for x in best]
