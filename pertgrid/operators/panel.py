"""Scores of several models against one truth: one row per model and target, with recovery at several depths, strong genes and retrieval.

Effects are long relations without zeros, or packed ones (genes and values in the place of gene_id and value); absent genes are zeros of an axis of ``axis_size`` genes.  A
prediction meets its truth as one row, whose sums and ranks are made in a task; retrieval comes from blocked products (``retrieval.ranks_among``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import safe_divide
from . import retrieval
from .metrics import cosine_of_sums, reference_scaled

KEYS = ["model", "target"]


def panel_pairs(models: DataFrame, truth: DataFrame, own_genes: bool = True) -> DataFrame:
    """model, target, gene_id, prediction, truth of every target that has a truth, on the genes that either has.

    ``models`` has model, target, gene_id, value; ``truth`` target, gene_id, value.  Null values are zeros, rows with a null key are left out.
    Without ``own_genes`` a target's own gene is left out.
    """
    known = F.col("gene_id").isNotNull() if own_genes else F.col("gene_id").cast("string") != F.col("target").cast("string")
    m = models.where(known & F.col("model").isNotNull() & F.col("target").isNotNull()).select(*KEYS, "gene_id", F.col("value").alias("prediction"))
    t = truth.where(known).select("target", "gene_id", F.col("value").alias("truth"))
    names = models.select(*KEYS).distinct()
    every = names.join(t, "target").unionByName(m.join(truth.select("target").distinct(), "target", "left_semi"), allowMissingColumns=True)
    return every.groupBy(*KEYS, "gene_id").agg(F.coalesce(F.sum("prediction"), F.lit(0.0)).alias("prediction"), F.coalesce(F.sum("truth"), F.lit(0.0)).alias("truth"))


def _packed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, genes, values) of a long relation, null values as zeros; a packed one stays as it is."""
    if "genes" in rows.columns:
        return rows
    entry = F.struct(F.col("gene_id").cast("long").alias("g"), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("v"))
    found = rows.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).groupBy(*keys).agg(F.collect_list(F.when(F.col("gene_id").isNotNull(), entry)).alias("e"))
    return found.select(*keys, F.col("e.g").alias("genes"), F.col("e.v").alias("values"))


#: Sums of a prediction x and its truth y that all scores are made of.
_SUMS = ["n", "xy", "xx", "yy", "gap", "size", "squared_error", "strong_genes", "strong_same", "strong_gap", "strong_size"]


def _met(models: DataFrame, truth: DataFrame, own_genes: bool, depths: tuple[int, ...]) -> DataFrame:
    """model, target, the sums of ``_SUMS`` and found_<k> of every packed prediction whose target has a row in ``truth`` (target, genes, values, strong)."""
    pairs = models.select(*KEYS, F.col("genes").alias("xg"), F.col("values").alias("xv")).join(truth.select("target", F.col("genes").alias("yg"), F.col("values").alias("yv"), "strong"), "target")
    names = [*_SUMS, *[f"found_{k}" for k in depths]]
    whole = {"n", "strong_genes", "strong_same", *names[len(_SUMS) :]}
    pairs = pairs.withColumn("own", F.expr("try_cast(target AS long)"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n = part.num_rows
                sides = [retrieval.flat(part.column(g), part.column(v)) for g, v in (("xg", "xv"), ("yg", "yv"))]
                width = part.column("strong").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                marked = part.column("strong").flatten().to_numpy(zero_copy_only=False)
                sides.append((np.repeat(np.arange(n), width), marked, np.ones(len(marked))))
                row, gene = (np.concatenate([s[k] for s in sides]).astype(np.int64) for k in (0, 1))
                columns = [np.concatenate([s[2] if k == m else np.zeros(len(s[2])) for m, s in enumerate(sides)]) for k in range(3)]
                # strong genes mark entries, they make none
                entry = np.concatenate([np.full(len(s[0]), k < 2, float) for k, s in enumerate(sides)])
                own = part.column("own")
                has, own = own.is_valid().to_numpy(zero_copy_only=False), own.fill_null(0).to_numpy(zero_copy_only=False)
                kept = np.ones(len(row), bool) if own_genes else ~(has[row] & (gene == own[row]))
                row, gene, x, y, strong, entry = retrieval.merged(row[kept], gene[kept], *(c[kept] for c in columns), entry[kept])
                real = entry > 0
                row, gene, x, y, strong = row[real], gene[real], x[real], y[real], strong[real] > 0
                add = lambda v, row=row, n=n: retrieval.added(row, v, n)
                first = np.searchsorted(row, np.arange(n))

                def ranked(v: np.ndarray, row: np.ndarray = row, gene: np.ndarray = gene, first: np.ndarray = first) -> np.ndarray:
                    order = np.lexsort((gene, -np.abs(v), row))
                    out = np.empty(len(v), np.int64)
                    out[order] = np.arange(len(v)) - first[row[order]]
                    return out

                of_x, of_y, same = ranked(x), ranked(y), np.sign(x) == np.sign(y)
                made = {
                    "n": add(np.ones(len(row))), "xy": add(x * y), "xx": add(x * x), "yy": add(y * y), "gap": add(np.abs(x - y)), "size": add(np.abs(y)), "squared_error": add((x - y) ** 2), "strong_genes": add(strong.astype(float)),
                    "strong_same": add((strong & same).astype(float)), "strong_gap": add(np.where(strong, np.abs(x - y), 0.0)), "strong_size": add(np.where(strong, np.abs(y), 0.0)),
                    **{f"found_{k}": add((same & (x != 0) & (of_x < k) & (of_y < k)).astype(float)) for k in depths},
                }
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in KEYS), *(pa.array(made[c].astype(np.int64) if c in whole else made[c]) for c in names)], names=[*KEYS, *names])

    kinds = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in KEYS)
    return pairs.select(*KEYS, "own", "xg", "xv", "yg", "yv", "strong").mapInArrow(run, f"{kinds}, " + ", ".join(f"{c} {'long' if c in whole else 'double'}" for c in names)).where("n > 0")


def panel_scores(met: DataFrame, axis_size: int, depths: tuple[int, ...] = (50, 100, 200), strong_gate: int = 10) -> DataFrame:
    """model, target, cosine, nae, predicted_norm, truth_norm, norm_ratio, squared_error, strong_genes, strong_direction, strong_nae and
    ``signed_recovery_<k>`` for every depth.

    ``met`` are the sums of ``_met``.  Recovery is the share of the k genes of
    largest truth that are among the k of largest prediction with the same sign, zeros never; of equals the smaller gene goes first, and k is at
    most the axis.  Strong figures are null below ``strong_gate`` strong genes; cosine is 0 without a norm.
    """
    gated = lambda c: F.when(F.col("strong_genes") >= strong_gate, c)
    return met.select(
        *KEYS, cosine_of_sums("xy", "xx", "yy", 0.0).alias("cosine"), safe_divide(F.col("gap"), F.col("size")).alias("nae"), F.sqrt("xx").alias("predicted_norm"), F.sqrt("yy").alias("truth_norm"),
        F.sqrt(safe_divide(F.col("xx"), F.col("yy"))).alias("norm_ratio"), "squared_error", "strong_genes",
        gated(safe_divide(F.col("strong_same"), F.col("strong_genes"))).alias("strong_direction"), gated(safe_divide(F.col("strong_gap"), F.col("strong_size"))).alias("strong_nae"),
        *[(F.col(f"found_{k}") / F.lit(float(max(1, min(k, axis_size))))).alias(f"signed_recovery_{k}") for k in depths],
    )


def panel_retrieval(models: DataFrame, truth: DataFrame, scores: DataFrame, own_genes: bool = True) -> DataFrame:
    """model, target, retrieval, rank, top1: the place of each target's own truth among all truths, by cosine with its prediction.

    ``scores`` are those of ``panel_scores`` on the same genes.  Ranks are midranks from 1; a prediction without a norm scores 0.5 and has no rank.
    A target's own gene is left out of all its similarities unless ``own_genes``; targets must then be whole numbers like genes.
    """
    name = F.to_json(F.struct(*KEYS))
    own = F.lit(None).cast("long") if own_genes else F.col("target").cast("long")
    queries = scores.select(name.alias("id"), F.col("target").alias("group"), own.alias("own_gene"), F.array(F.when(F.col("predicted_norm") > 0, F.col("cosine"))).alias("references"))
    vectors, candidates = (retrieval.packed(df.where("value <> 0")) if "value" in df.columns else df for df in (models.withColumn("id", name), truth.where("target IS NOT NULL").withColumn("id", F.col("target"))))
    vectors, candidates = (df.select("id", "genes", "values") for df in (vectors, candidates))
    found = retrieval.ranks_among(queries, vectors, candidates.select("id", F.col("id").alias("group")), candidates)
    above, tied = F.get("above", F.lit(0)), F.get("tied", F.lit(0))
    ranked = scores.select(*KEYS, name.alias("id"), F.when(F.col("predicted_norm") > 0, F.col("cosine")).alias("c")).join(found, "id", "left")
    defined = F.col("c").isNotNull() & F.col("n_others").isNotNull()
    score = retrieval.score(above, tied, F.coalesce("n_others", F.lit(0)), F.col("c"))
    return ranked.select(*KEYS, score.alias("retrieval"), F.when(defined, 1 + above + 0.5 * tied).alias("rank"), F.coalesce(F.when(defined, (above == 0) & (tied == 0)), F.lit(False)).alias("top1"))


def evaluation_frame(models: DataFrame, truth: DataFrame, source: DataFrame, axis_size: int, strong: DataFrame | None = None, own_genes: bool = True, depths: tuple[int, ...] = (50, 100, 200), strong_gate: int = 10, keep: retrieval.Keep = lambda df, name: df) -> DataFrame:
    """``panel_scores`` and ``panel_retrieval`` of every model and target, with what the measured ``source`` effect says of the target:
    source_norm, source_to_truth, and oracle_projection, the factor that brings the source closest to the truth.

    ``strong`` (target, gene_id; packed: target, genes) marks strong genes.  Targets without a source have nulls there, ones without a truth no row.
    All tables are long or packed; they are read several times, so hand on stored ones.
    """
    many, known, own = _packed(models, KEYS), _packed(truth, ["target"]), _packed(source, ["target"])
    if strong is None:
        marked = known.withColumn("strong", F.lit(None).cast("array<long>"))
    else:
        genes = strong if "genes" in strong.columns else strong.where("gene_id IS NOT NULL").groupBy("target").agg(F.collect_list(F.col("gene_id").cast("long")).alias("genes"))
        marked = known.join(genes.select("target", F.col("genes").alias("strong")), "target", "left")
    scores = keep(panel_scores(_met(many, marked, own_genes, depths), axis_size, depths, strong_gate), "panel-scores")
    met = _met(own.withColumn("model", F.lit("source")), marked, own_genes, ())
    of_source = met.select("target", F.sqrt("xx").alias("source_norm"), safe_divide(F.sqrt("xx"), F.sqrt("yy")).alias("source_to_truth"), safe_divide(F.col("xy"), F.col("xx")).alias("oracle_projection"))
    return scores.join(panel_retrieval(models, truth, scores, own_genes), KEYS).join(of_source, "target", "left")


def composite(frame: DataFrame, metrics: dict[str, int], baseline: str, reference: str) -> DataFrame:
    """model, composite and each metric's mean over the targets, scaled so that ``baseline`` has 0 and ``reference`` 1.

    ``metrics`` names columns with 1 where more is better and -1 where less is.  The composite is the mean of the scaled metrics; one
    in which baseline and reference are equal is null and does not count.  Without either model nothing is scaled.
    """
    means = frame.groupBy("model").agg(*[F.avg(F.col(m) * sign).alias(m) for m, sign in metrics.items()])
    of = lambda model, m: F.max(F.when(F.col("model") == model, F.col(m))).over(Window.partitionBy())  # noqa: E731  (a row per model)
    scaled = means.select("model", *[reference_scaled(F.col(m), of(baseline, m), of(reference, m)).alias(m) for m in metrics])
    known = F.array_compact(F.array(*metrics))
    return scaled.withColumn("composite", safe_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known)))
