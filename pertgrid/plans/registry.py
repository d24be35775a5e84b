"""Registry of queries, and the relations that they share: each once as a DataFrame and once as SQL."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

CONTROL = "5-LOW"

#: Shared relations in SQL; each may use the ones before it.
RELATIONS = {
    "counts": "SELECT l_orderkey AS row_id, l_partkey AS gene_id, CAST(sum(l_quantity) AS BIGINT) AS count FROM lineitem GROUP BY l_orderkey, l_partkey",
    "obs": "SELECT o_orderkey AS row_id, o_orderpriority AS target, concat(substr(o_orderpriority, 1, 1), '-g', o_custkey % 8) AS guide, year(o_orderdate) AS batch, o_orderpriority = '5-LOW' AS is_control FROM orders",
    "cells": "SELECT c.row_id, c.gene_id, c.count, o.target, o.guide, o.batch, o.is_control FROM counts c JOIN obs o ON c.row_id = o.row_id",
    "genes": "SELECT p_partkey AS gene_id, concat(p_brand, '-', p_type) AS symbol, p_partkey AS pos, p_type AS chr, p_partkey * 100 AS start, p_partkey * 100 + p_size * 10 AS \"end\" FROM part",
    "modules": "SELECT row_id, gene_id % 60 AS gene_id, CAST(sum(count) AS BIGINT) AS count FROM counts GROUP BY row_id, gene_id % 60",
    "panel": "SELECT l_linestatus AS context, l_suppkey % 40 AS target, l_partkey % 60 AS gene_id, CAST(sum(l_quantity) AS BIGINT) AS count FROM lineitem GROUP BY ALL",
    "panel_cpm": "SELECT *, count * 1e6 / sum(count) OVER (PARTITION BY context, target) AS cpm FROM panel",
    "effects": "SELECT p.context, p.target, p.gene_id, ln((p.cpm + 20) / (coalesce(c.cpm, 0) + 20)) AS value FROM panel_cpm p LEFT JOIN panel_cpm c ON c.context = p.context AND c.gene_id = p.gene_id AND c.target = 0 WHERE p.target <> 0",
    "truth": "SELECT target, gene_id, value FROM effects WHERE context = 'F'",
    "prediction": "SELECT target, gene_id, value FROM effects WHERE context = 'O'",
    "pairs": "SELECT target, gene_id, coalesce(p.value, 0) AS prediction, coalesce(t.value, 0) AS truth FROM prediction p FULL JOIN truth t USING (target, gene_id)",
    "observations": "SELECT l_partkey AS gene, n_name AS context, r_name AS study, count(*) AS n_cells FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
    "contexts": "SELECT n_name AS context, r_name AS study, concat('c', n_nationkey % 9) AS canonical, n_nationkey AS ord, n_nationkey % 4 <> 0 AS has_controls, n_nationkey % 3 <> 0 AS has_raw_counts FROM nation JOIN region ON n_regionkey = r_regionkey",
}
_NEEDS = {
    "cells": ["counts", "obs"], "modules": ["counts"], "panel_cpm": ["panel"], "effects": ["panel_cpm"], "truth": ["effects"], "prediction": ["effects"], "pairs": ["truth", "prediction"],
}


def _closure(names: tuple[str, ...]) -> list[str]:
    need: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, []):
            add(n)
        if name not in need:
            need.append(name)

    for n in names:
        add(n)
    return need


def sql(*names: str, body: str, **more: str) -> str:
    """A query over shared relations, further ones by keyword, and the body."""
    parts = [f"{n} AS ({RELATIONS[n]})" for n in _closure(names)] + [f"{n} AS ({text})" for n, text in more.items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + body


def query(name: str, oracle: str | None = None):
    def add(f):
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


def r(x: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, digits) + F.lit(0.0)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset in a session of one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: intermediate tables need a folder that all executors share")
        folder = "file:" + tempfile.mkdtemp(prefix="pertgrid-tables-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: steps that read it again do not make it again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of the largest table a task of a shuffle is meant to take, about.
PART_ROWS = 500_000


def parts(spark: SparkSession, rows: int) -> int:
    """Parts of a shuffle of ``rows`` rows: the session's, or as many more as keep a part at ``PART_ROWS``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // PART_ROWS))


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to that many parts."""
    return df.repartition(parts(df.sparkSession, rows), *keys)


def counts(spark: SparkSession, d: str, dealt: bool = False) -> DataFrame:
    """``dealt``: in as many parts of the rows as their number asks for."""
    lines = table(spark, d, "lineitem")
    lines = spread(lines, lines.count(), "l_orderkey") if dealt else lines
    return lines.groupBy(F.col("l_orderkey").alias("row_id"), F.col("l_partkey").alias("gene_id")).agg(F.sum("l_quantity").cast("long").alias("count"))


def obs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("target"),
        F.concat(F.substring("o_orderpriority", 1, 1), F.lit("-g"), (F.col("o_custkey") % 8).cast("string")).alias("guide"),
        F.year("o_orderdate").cast("long").alias("batch"), (F.col("o_orderpriority") == CONTROL).alias("is_control"),
    )


def cells(spark: SparkSession, d: str, dealt: bool = False) -> DataFrame:
    return counts(spark, d, dealt).join(obs(spark, d), "row_id")


def genes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("gene_id"), F.concat("p_brand", F.lit("-"), "p_type").alias("symbol"), F.col("p_partkey").alias("pos"),
        F.col("p_type").alias("chr"), (F.col("p_partkey") * 100).alias("start"), (F.col("p_partkey") * 100 + F.col("p_size") * 10).alias("end"),
    )


def modules(spark: SparkSession, d: str) -> DataFrame:
    return counts(spark, d).groupBy("row_id", (F.col("gene_id") % 60).alias("gene_id")).agg(F.sum("count").alias("count"))


def panel(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("context"), (F.col("l_suppkey") % 40).alias("target"), (F.col("l_partkey") % 60).alias("gene_id")).agg(F.sum("l_quantity").cast("long").alias("count"))


def panel_cpm(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    return panel(spark, d).withColumn("cpm", F.col("count") * 1e6 / F.sum("count").over(Window.partitionBy("context", "target")))


def effects(spark: SparkSession, d: str) -> DataFrame:
    p = panel_cpm(spark, d)
    control = p.where("target = 0").select("context", "gene_id", F.col("cpm").alias("control_cpm"))
    return p.where("target <> 0").join(control, ["context", "gene_id"], "left").select("context", "target", "gene_id", F.log((F.col("cpm") + 20) / (F.coalesce("control_cpm", F.lit(0.0)) + 20)).alias("value"))


def truth(spark: SparkSession, d: str) -> DataFrame:
    return effects(spark, d).where("context = 'F'").drop("context")


def prediction(spark: SparkSession, d: str) -> DataFrame:
    return effects(spark, d).where("context = 'O'").drop("context")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.metrics import aligned

    return aligned(prediction(spark, d), truth(spark, d))


def observations(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    suppliers = table(spark, d, "supplier").join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey"))
    joined = table(spark, d, "lineitem").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.groupBy(F.col("l_partkey").alias("gene"), F.col("n_name").alias("context"), F.col("r_name").alias("study")).agg(F.count(F.lit(1)).alias("n_cells"))


def contexts(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(
        F.col("n_name").alias("context"), F.col("r_name").alias("study"), F.concat(F.lit("c"), (F.col("n_nationkey") % 9).cast("string")).alias("canonical"),
        F.col("n_nationkey").cast("long").alias("ord"), (F.col("n_nationkey") % 4 != 0).alias("has_controls"), (F.col("n_nationkey") % 3 != 0).alias("has_raw_counts"),
    )
