"""Incremental pooling of shards as they arrive: a file stream whose checkpoint remembers which shards are done."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def shard_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def pooled(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Running sums per group and gene."""
    return stream.groupBy(*keys, "gene_id").agg(F.sum("count").cast("long").alias("count"), F.count(F.lit(1)).alias("n_entries"))


def windowed(stream: DataFrame, time: str, keys: list[str], value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Sums per time window; rows later than the watermark are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def run_available(df: DataFrame, path: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Pools each batch of new shards and appends its partial sums; ``merge_shards`` of the sink gives the totals.

    Appending partial sums keeps no state between batches, and a repeated batch overwrites its own folder.
    """

    def batch(part: DataFrame, number: int) -> None:
        part.groupBy(*keys, "gene_id").agg(F.sum("count").cast("long").alias("count")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = df.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
