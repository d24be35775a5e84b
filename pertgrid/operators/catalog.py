"""Coverage algebra over a catalog of observations: which gene was perturbed in which context of which study.

``observations`` has gene, context, study, n_cells, unique per (gene, context); contexts have context, study,
canonical (the biological context) and ord (their order).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import safe_divide


def build_observations(loads: DataFrame, contexts: DataFrame) -> DataFrame:
    """One row per gene and context: the load with the most cells (null loses; ties keep the first source), enriched with the context."""
    w = Window.partitionBy("gene", "context").orderBy(F.col("n_cells").desc_nulls_last(), "source_order")
    kept = loads.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "source_order")
    return kept.join(F.broadcast(contexts), "context")


def presence_matrix(observations: DataFrame, contexts: list[str]) -> DataFrame:
    return observations.groupBy("gene").pivot("context", contexts).agg(F.max(F.lit(1))).na.fill(0)


def overlap_counts(observations: DataFrame) -> DataFrame:
    """(a, b, shared) for all pairs of contexts, the diagonal included.

    A gene's contexts are one bounded set (there are few contexts), exploded twice on the map side.
    """
    sets = observations.groupBy("gene").agg(F.collect_set("context").alias("cs"))
    return sets.select(F.explode("cs").alias("a"), "cs").select("a", F.explode("cs").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def overlap_matrix(observations: DataFrame, contexts: list[str]) -> DataFrame:
    return overlap_counts(observations).groupBy("a").pivot("b", contexts).agg(F.max("shared")).na.fill(0)


def bridge_edges(observations: DataFrame, contexts: DataFrame) -> DataFrame:
    """Unordered context pairs that share genes, with shares of each side and same_study / same_canonical flags."""
    n = observations.groupBy("context").agg(F.count_distinct("gene").alias("n"))
    info = contexts.select("context", "study", "canonical", "ord").join(n, "context")
    side = lambda p: info.select(*[F.col(c).alias(f"{c}_{p}") for c in info.columns])
    pairs = overlap_counts(observations).withColumnsRenamed({"a": "context_a", "b": "context_b"})
    joined = pairs.join(F.broadcast(side("a")), "context_a").join(F.broadcast(side("b")), "context_b").where("ord_a < ord_b")
    return joined.select(
        "context_a", "context_b", "shared",
        (F.col("shared") / F.col("n_a")).alias("share_a"), (F.col("shared") / F.col("n_b")).alias("share_b"),
        (F.col("study_a") == F.col("study_b")).alias("same_study"), (F.col("canonical_a") == F.col("canonical_b")).alias("same_canonical"),
    )


def exposure(observations: DataFrame, panel: DataFrame) -> DataFrame:
    """Every gene of the panel or the observations: number of contexts, their sorted list, and its class."""
    g = observations.groupBy("gene").agg(F.count_distinct("context").alias("n_contexts"), F.array_join(F.sort_array(F.collect_set("context")), ";").alias("contexts"))
    all_genes = g.join(panel.select("gene").distinct().withColumn("in_panel", F.lit(True)), "gene", "full").na.fill(False, ["in_panel"]).na.fill(0, ["n_contexts"]).na.fill("", ["contexts"])
    return all_genes.withColumn("exposure", F.when(F.col("n_contexts") == 0, "unseen").when(F.col("n_contexts") == 1, "seen-1").otherwise("seen-multi"))


def sampling_capacity(observations: DataFrame, thresholds=(100, 200, 400, 800), least: int = 2) -> DataFrame:
    """Per context: observations with at least ``least`` cells, their spread, and how many reach each threshold."""
    o = observations.where(F.col("n_cells") >= least)
    return o.groupBy("context").agg(F.count(F.lit(1)).alias("n"), F.min("n_cells").alias("min_cells"), F.median("n_cells").alias("median_cells"), F.max("n_cells").alias("max_cells"), *[F.count_if(F.col("n_cells") >= t).alias(f"n_{t}") for t in thresholds])


def cross_study_pairs(contexts: DataFrame) -> DataFrame:
    """Ordered pairs of contexts of the same biological context in different studies."""
    a, b = contexts.alias("a"), contexts.alias("b")
    return a.join(b, (F.col("a.canonical") == F.col("b.canonical")) & (F.col("a.study") != F.col("b.study"))).select(F.col("a.context").alias("source"), F.col("b.context").alias("target"))


def within_study_pairs(contexts: DataFrame) -> DataFrame:
    a, b = contexts.alias("a"), contexts.alias("b")
    return a.join(b, (F.col("a.study") == F.col("b.study")) & (F.col("a.context") != F.col("b.context"))).select(F.col("a.context").alias("source"), F.col("b.context").alias("target"))


def pair_units(pairs: DataFrame, observations: DataFrame) -> DataFrame:
    """Genes that both sides of a context pair have."""
    s, t = observations.select("gene", F.col("context").alias("source")), observations.select("gene", F.col("context").alias("target"))
    return s.join(F.broadcast(pairs), "source").join(t, ["gene", "target"]).groupBy("source", "target").agg(F.count(F.lit(1)).alias("genes"))


def leave_one_context_out(observations: DataFrame) -> DataFrame:
    """Per study and held-out context: genes seen in any other context of the study (broad) and in all of them (strict)."""
    k = observations.groupBy("study").agg(F.count_distinct("context").alias("k"))
    g = observations.groupBy("study", "gene").agg(F.count_distinct("context").alias("m"))
    joined = observations.select("study", "context", "gene").distinct().join(g, ["study", "gene"]).join(k, "study").where("k > 1")
    return joined.groupBy("study", "context").agg(F.count_if(F.col("m") > 1).alias("broad"), F.count_if(F.col("m") == F.col("k")).alias("strict"))


def anchor_units(observations: DataFrame, anchor: str) -> DataFrame:
    """Genes of the anchor context that other studies' contexts have too."""
    a = observations.where(F.col("context") == anchor).select("gene", F.col("study").alias("anchor_study"))
    return observations.join(a, "gene").where(F.col("study") != F.col("anchor_study")).groupBy("context").agg(F.count(F.lit(1)).alias("genes"))


def multi_source_holdout(observations: DataFrame) -> DataFrame:
    """Per observation the number of contexts outside its canonical context that saw its gene, and the class of that number.

    Counts come from two groupings; no observation meets another one.
    """
    total = observations.groupBy("gene").agg(F.count_distinct("context").alias("all_contexts"))
    own = observations.groupBy("gene", "canonical").agg(F.count_distinct("context").alias("own_contexts"))
    k = observations.select("gene", "context", "canonical").join(total, "gene").join(own, ["gene", "canonical"]).withColumn("k", F.col("all_contexts") - F.col("own_contexts"))
    return k.select("gene", "context", "k", F.when(F.col("k") == 0, "unseen").when(F.col("k") == 1, "seen-1").otherwise("seen-multi").alias("class"))


def attrition(units: DataFrame, thresholds=(50, 100, 200, 400, 800)) -> DataFrame:
    """Units (with n_cells) that reach each threshold: one row per threshold."""
    row = units.agg(*[F.count_if(F.col("n_cells") >= t).alias(str(t)) for t in thresholds])
    return row.select(F.explode(F.array(*[F.struct(F.lit(t).cast("long").alias("threshold"), F.col(f"`{t}`").alias("units")) for t in thresholds])).alias("x")).select("x.*")


def eligible(observations: DataFrame, contexts: DataFrame) -> DataFrame:
    """Observations of contexts that have controls and raw counts."""
    return observations.join(F.broadcast(contexts.where(F.col("has_controls") & F.col("has_raw_counts")).select("context")), "context", "left_semi")


def coverage_long(panel: DataFrame, observations: DataFrame, contexts: DataFrame) -> DataFrame:
    """Panel genes by contexts: n_cells, 0 where the context lacks the gene."""
    grid = panel.select("gene").distinct().join(F.broadcast(contexts.select("context")), how="cross")
    return grid.join(observations.select("gene", "context", "n_cells"), ["gene", "context"], "left").na.fill(0, ["n_cells"])


def coverage_summary(long: DataFrame) -> DataFrame:
    return long.groupBy("context").agg(F.count_if(F.col("n_cells") > 0).alias("covered"), F.count(F.lit(1)).alias("panel"), safe_divide(F.count_if(F.col("n_cells") > 0), F.count(F.lit(1))).alias("share"))


def second_best(observations: DataFrame) -> DataFrame:
    """Per gene the second largest number of cells, the bottleneck of a pair of contexts."""
    w = Window.partitionBy("gene").orderBy(F.col("n_cells").desc(), "context")
    return observations.withColumn("_r", F.row_number().over(w)).where("_r = 2").select("gene", "context", "n_cells")


def occupancy(strata: DataFrame, construct: str, thresholds=(4, 8, 20)) -> DataFrame:
    """Per construct: strata, how many reach each threshold, the smallest and quartiles."""
    return strata.groupBy(construct).agg(F.count(F.lit(1)).alias("n_strata"), *[F.count_if(F.col("n_cells") >= t).alias(f"n_{t}") for t in thresholds], F.min("n_cells").alias("min_cells"), F.percentile("n_cells", F.lit(0.25)).alias("q25"), F.percentile("n_cells", F.lit(0.75)).alias("q75"))


def violations(observations: DataFrame, overlaps: DataFrame) -> DataFrame:
    """(check, n): rows that break uniqueness, symmetry of overlaps, or the diagonal; all 0 in a sound catalog."""
    dup = observations.groupBy("gene", "context").count().where("count > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("duplicate_key").alias("check"), "n")
    flip = overlaps.select(F.col("b").alias("a"), F.col("a").alias("b"), "shared")
    sym = overlaps.exceptAll(flip).agg(F.count(F.lit(1)).alias("n")).select(F.lit("asymmetric_overlap").alias("check"), "n")
    sizes = observations.groupBy(F.col("context").alias("a")).agg(F.count_distinct("gene").alias("genes"))
    diag = overlaps.where("a = b").join(sizes, "a").where("shared <> genes").agg(F.count(F.lit(1)).alias("n")).select(F.lit("wrong_diagonal").alias("check"), "n")
    return dup.unionByName(sym).unionByName(diag)


def promoter_pairs(constructs: DataFrame, left: str, right: str) -> DataFrame:
    """Constructs of two contexts: the exact same guide, or another of the same target, by promoter class."""
    a = constructs.where(F.col("context") == left).select("guide", "target", "promoter")
    b = constructs.where(F.col("context") == right).select(F.col("guide").alias("other"), "target", F.col("promoter").alias("other_promoter"))
    kind: Column = F.when(F.col("guide") == F.col("other"), "exact").when(F.col("promoter").eqNullSafe(F.col("other_promoter")), "same_promoter").otherwise("cross_promoter")
    return a.join(b, "target").select("target", "guide", "other", kind.alias("relation"))
