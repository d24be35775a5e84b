"""Audits: each gives the offending rows or a small table of (check, n); nothing offending means an empty result or n = 0."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class AuditError(ValueError):
    """An audit found offending rows."""


def require_empty(offending: DataFrame, what: str) -> None:
    rows = offending.limit(3).collect()
    if rows:
        raise AuditError(f"{what}: {rows}")


def not_counts(values: DataFrame, value: str) -> DataFrame:
    """Rows that are null, negative or not integral."""
    v = F.col(value)
    return values.where(v.isNull() | (v < 0) | (v != F.floor(v)))


def broken_dependency(df: DataFrame, key: str, dependent: str) -> DataFrame:
    """Keys with several values of the dependent column."""
    return df.groupBy(key).agg(F.count_distinct(dependent).alias("n")).where("n > 1")


def total_mismatch(cells: DataFrame, obs: DataFrame, declared: str) -> DataFrame:
    """Rows whose summed counts differ from the declared total; a row without counts sums to 0."""
    sums = cells.groupBy("row_id").agg(F.sum("count").alias("total"))
    return obs.select("row_id", F.col(declared).alias("declared")).join(sums, "row_id", "left").na.fill(0, ["total"]).where("total <> declared")


def unbalanced(parts: DataFrame, keys: list[str], part: str, n_parts: int) -> DataFrame:
    """Strata whose largest and smallest part differ by more than one."""
    counts = parts.groupBy(*keys).agg(*[F.count_if(F.col(part) == k).alias(f"n_{k}") for k in range(n_parts)])
    cols = [F.col(f"n_{k}") for k in range(n_parts)]
    return counts.where(F.greatest(*cols) - F.least(*cols) > 1)


def not_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def coverage_gaps(df: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Members that are missing from, or extra in, a table: (key, problem)."""
    have = df.select(key).distinct()
    return expected.select(key).distinct().join(have, key, "left_anti").withColumn("problem", F.lit("missing")).unionByName(have.join(expected, key, "left_anti").withColumn("problem", F.lit("extra")))


def rows_per_group(df: DataFrame, key: str, item: str, expected: int) -> DataFrame:
    """Groups that do not have exactly ``expected`` different items."""
    return df.groupBy(key).agg(F.count_distinct(item).alias("n")).where(F.col("n") != expected)


def check_table(checks: dict[str, DataFrame]) -> DataFrame:
    """(check, n): the number of offending rows of every audit."""
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n") for name, df in checks.items()])


def trace_deltas(trace: DataFrame, step: str, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Change from the step before, relative change, and whether the trace never falls."""
    w = Window.partitionBy(*keys).orderBy(step)
    delta = F.col(value) - F.lag(value).over(w)
    return trace.withColumn("delta", delta).withColumn("relative", F.try_divide(F.abs(delta), F.abs(F.lag(value).over(w)))).withColumn("falls", F.coalesce(delta < 0, F.lit(False)))


def manifest_mismatch(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose size or SHA-256 differs from the manifest's, or that one of both lacks.

    ``files`` comes from ``sources.readers.file_digests``; ``manifest`` has path, size and sha256.
    """
    m = manifest.select("path", F.col("size").alias("declared_size"), F.col("sha256").alias("declared_sha256"))
    same = F.col("size").eqNullSafe(F.col("declared_size")) & F.col("sha256").eqNullSafe(F.col("declared_sha256"))
    return files.join(m, "path", "full").where(~same)


def table_digest(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Digest of a table that does not depend on the order of rows: rows, and two sums of row hashes."""
    cols = columns or sorted(df.columns)
    h: Column = F.xxhash64(*cols)
    g: Column = F.xxhash64(F.lit(1), *cols)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(h).alias("xor"), F.sum(g.cast("decimal(38,0)")).cast("string").alias("sum"))


def rebuilt_differs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of an independent rebuild that differ, repetitions counted."""
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("rebuilt")))
