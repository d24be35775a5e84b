"""Writers.  Spark's committer makes each of them atomic; a second write to the same place is refused unless asked for."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.audits import rows_per_group, table_digest


def partitioned(df: DataFrame, path: str, by: list[str], mode: str = "errorifexists", codec: str = "zstd") -> None:
    """Parquet partitioned by columns; rows of a partition are first brought together, so that files stay few.

    Skewed partitions are split into several files by the rebalancing that adaptive execution does.
    """
    df.hint("rebalance", *[F.col(c) for c in by]).write.mode(mode).option("compression", codec).partitionBy(*by).parquet(path)


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Overwrites only the partitions that ``df`` has: the shard-wise checkpoint of a long run."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def frozen_slice(df: DataFrame, path: str, replicate: int, targets: DataFrame) -> None:
    df.where(F.col("replicate") == replicate).join(targets.select("target").distinct(), "target", "left_semi").drop("replicate").write.parquet(path)


def single_csv(df: DataFrame, path: str, columns: list[str], order: list[str]) -> None:
    """One CSV file of a small table, its columns and order fixed; further columns are ignored."""
    df.select(*columns).orderBy(*order).coalesce(1).write.option("header", "true").csv(path)


def prediction(df: DataFrame, path: str, rows_per_target: int) -> None:
    """Counts without zeros, after checking that every target has its number of rows (cells without counts included)."""
    bad = rows_per_group(df, "target", "row_id", rows_per_target).limit(3).collect()
    if bad:
        raise ValueError(f"targets without exactly {rows_per_target} rows: {bad}")
    df.where("count > 0").write.partitionBy("target").parquet(path)


def verified(df: DataFrame, path: str) -> dict:
    """Writes and reads back; raises unless the digests agree.  Returns the digest."""
    df.write.parquet(path)
    written = df.sparkSession.read.parquet(path)
    a, b = table_digest(df).first(), table_digest(written.select(df.columns)).first()
    if tuple(a) != tuple(b):
        raise ValueError(f"{path}: written {tuple(a)}, read {tuple(b)}")
    return a.asDict()


def manifest(df: DataFrame, parameters: dict, inputs: dict[str, str]) -> str:
    """JSON record of a run: parameters, input digests, the output's digest, time and engine version."""
    return json.dumps({"parameters": parameters, "inputs": inputs, "output": table_digest(df).first().asDict(), "spark": df.sparkSession.version, "created": datetime.now(UTC).isoformat()}, sort_keys=True, default=str)
