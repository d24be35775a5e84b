"""Pooling counts over groups of rows, and the audits of what pooling must conserve.

``counts`` is (row_id, gene_id, count), with zeros left out; ``obs`` has one row per row_id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pool(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of counts per group and gene, and the number of rows behind each."""
    return counts.groupBy(*keys, "gene_id").agg(F.sum("count").cast("long").alias("count"), F.count(F.lit(1)).alias("n_rows"))  # (row_id, gene_id) is unique


def pool_sums(counts: DataFrame, keys: list[str]) -> DataFrame:
    return counts.groupBy(*keys, "gene_id").agg(F.sum("count").cast("long").alias("count"))


def pool_levels(cells: DataFrame, levels: dict[str, list[str]]) -> DataFrame:
    """Several levels: (level, key..., gene_id, count); keys that a level lacks are null.

    Cells are dealt by their gene once, and every level is summed from the same parts: where ``cells`` already are dealt by gene_id, no other
    shuffle is made, and what a task holds follows from the number of these parts.
    """
    keys = list(dict.fromkeys(k for v in levels.values() for k in v))
    kinds = {k: cells.schema[k].dataType for k in keys}
    of = lambda name, own: cells.groupBy(*own, "gene_id").agg(F.sum("count").cast("long").alias("count")).select(F.lit(name).alias("level"), *[(F.col(k) if k in own else F.lit(None).cast(kinds[k])).alias(k) for k in keys], "gene_id", "count")
    return reduce(DataFrame.unionByName, [of(name, own) for name, own in levels.items()])


def merge_shards(*partials: DataFrame, keys: list[str]) -> DataFrame:
    """Final sums of partial pools."""
    return reduce(DataFrame.unionByName, partials).groupBy(*keys, "gene_id").agg(F.sum("count").cast("long").alias("count"))


def group_sizes(obs: DataFrame, keys: list[str]) -> DataFrame:
    return obs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cells"))


def row_totals(counts: DataFrame) -> DataFrame:
    """Library size and number of genes observed of every row."""
    return counts.groupBy("row_id").agg(F.sum("count").cast("long").alias("total"), F.count_if(F.col("count") > 0).alias("n_genes"))


def strata(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells and counts per stratum.  Rows are summed first, so that no distinct count is needed."""
    rows = cells.groupBy(*keys, "row_id").agg(F.sum("count").alias("total"))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cells"), F.sum("total").cast("long").alias("total"))


def weighted_flags(rows: DataFrame, key: str, weight: str, flag: str) -> DataFrame:
    """Summed weights per key and the share of its rows whose flag is set."""
    return rows.groupBy(key).agg(F.sum(weight).alias("weight"), F.avg(F.col(flag).cast("double")).alias("flag_share"))


def collapse_symbols(counts: DataFrame, genes: DataFrame, parts: int | None = None) -> DataFrame:
    """Duplicate symbols summed in count space; ``pos`` is the first place of the symbol.

    ``genes`` has gene_id, symbol, pos.  Spark broadcasts it while it is below the session's threshold.
    With ``parts`` the sums are made in that many parts of the rows.
    """
    first = genes.groupBy("symbol").agg(F.min("pos").alias("pos"))
    named = counts.join(genes.select("gene_id", "symbol"), "gene_id")
    summed = (named.repartition(parts, "row_id") if parts else named).groupBy("row_id", "symbol").agg(F.sum("count").cast("long").alias("count"))
    return summed.join(first, "symbol").select("row_id", "symbol", "pos", "count")


def totals_differ(a: DataFrame, b: DataFrame, keys: list[str], value: str = "count") -> DataFrame:
    """Keys where two pools disagree; a key that one lacks counts as 0 there.  Empty when all is conserved."""
    sums = lambda df, name: df.groupBy(*keys).agg(F.sum(value).cast("long").alias(name))
    both = sums(a, "left_total").join(sums(b, "right_total"), keys, "full")
    return both.na.fill(0, ["left_total", "right_total"]).where("left_total <> right_total")


def conservation(pools: DataFrame) -> DataFrame:
    """Total of every level; equal totals mean that nothing was lost."""
    return pools.groupBy("level").agg(F.sum("count").cast("long").alias("total"))


def pool_guides_to_targets(guides: DataFrame) -> DataFrame:
    return guides.groupBy("target", "gene_id").agg(F.sum("count").cast("long").alias("count"))


def pool_ragged(cells: DataFrame, wanted: list[str], control: str, genes: str = "gene_token_id", values: str = "gene_expression") -> DataFrame:
    """Ragged cells (list columns) pooled per target over the cells that pass their filter.

    ``cells`` has gene_target, guide_target, pass_guide_filter and the two list columns.
    """
    keep = (F.col("pass_guide_filter") == 1) & (F.col("gene_target").isin(*wanted) | (F.col("gene_target") == control))
    flat = cells.where(keep).select("gene_target", "guide_target", F.explode(F.arrays_zip(F.col(genes).alias("gene_id"), F.col(values).alias("count"))).alias("x"))
    return flat.groupBy("gene_target", F.col("x.gene_id").alias("gene_id")).agg(F.sum("x.count").cast("long").alias("count"))


def ragged_counters(cells: DataFrame, wanted: list[str], control: str) -> DataFrame:
    """Numbers of cells read, passed, selected and of controls."""
    passed = F.col("pass_guide_filter") == 1
    return cells.agg(
        F.count(F.lit(1)).alias("n_input"),
        F.count_if(passed).alias("n_passed"),
        F.count_if(passed & (F.col("gene_target").isin(*wanted) | (F.col("gene_target") == control))).alias("n_selected"),
        F.count_if(passed & (F.col("gene_target") == control)).alias("n_control"),
    )
