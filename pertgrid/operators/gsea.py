"""Pre-ranked enrichment of gene sets with a permutation null.

A set's score is the extreme of a running sum over the ranked genes, which moves between two members by a known amount; so it
follows from the members' places alone.  A permutation gives every gene another place, by the order of a hash of permutation
and gene; the extremes of all sets are found together.  Genes meet their sets before they are gathered by ranking, so a task holds one
ranking with the memberships of its own genes, whatever the number of rankings and sets; what leaves it is one row per set with its null scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Memberships of a ranking whose null scores are found together, at about most.
BLOCK_MEMBERS = 1 << 20


def permuted_places(genes: np.ndarray, permutation: int, seed: int) -> np.ndarray:
    """The place of every gene (a number) in a permutation: its rank by a hash of both; equal hashes follow the genes' order."""
    with np.errstate(over="ignore"):
        x = genes.astype(np.int64).view(np.uint64) + np.uint64((permutation + 1) * 0x9E3779B97F4A7C15 + seed * 0xD1342543DE82EF95 & (1 << 64) - 1)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    places = np.empty(len(genes), np.int64)
    places[np.lexsort((genes, x ^ (x >> np.uint64(31))))] = np.arange(len(genes))
    return places


def scores(places: np.ndarray, owner: np.ndarray, sizes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The running sum's extreme of each set.

    ``places`` are those of all members, ``owner`` their set's number (ascending), ``sizes`` the members of each set, none empty;
    ``weight`` belongs to the places.  Members without any weight together count alike.  Of two extremes of one size the positive wins.
    """
    n = len(weight)
    place = np.sort(owner * n + places) - owner * n
    starts = np.cumsum(sizes) - sizes
    nth = np.arange(len(place)) - np.repeat(starts, sizes)
    w = weight[place]
    whole = np.add.reduceat(w, starts)
    w = np.where(np.repeat(whole, sizes) > 0, w, 1.0)
    whole = np.where(whole > 0, whole, sizes)
    upto = np.cumsum(w)
    hits = upto - np.repeat(upto[starts] - w[starts], sizes)
    whole = np.repeat(whole, sizes)
    missed = (place - nth) / np.repeat(np.maximum(n - sizes, 1), sizes)
    top = np.maximum.reduceat(hits / whole - missed, starts)
    low = np.minimum.reduceat((hits - w) / whole - missed, starts)
    return np.where(top >= -low, top, low)


def null_scores(rankings: DataFrame, sets: DataFrame, permutations: int, seed: int = 0, min_size: int = 10, max_size: int = 500, power: float = 1.0) -> DataFrame:
    """ranking, set, size, es, null (array of ``permutations`` scores).

    ``rankings`` has ranking, gene_id (a whole number) and score, one row a gene; ``sets`` has set and gene_id.  A gene of weight
    |score| ** power; equal scores rank by gene_id.  Genes without a score are no part of a ranking, and sets count their
    members within it: those below ``min_size`` or above ``max_size`` give no row.
    """
    members = sets.select("set", F.col("gene_id").cast("long").alias("gene_id")).distinct()
    of_gene = members.where("set IS NOT NULL").groupBy("gene_id").agg(F.collect_list("set").alias("sets"))
    known = rankings.where("score IS NOT NULL AND NOT isnan(score)").select("ranking", F.col("gene_id").cast("long").alias("gene_id"), F.col("score").cast("double").alias("score"))
    met = known.join(of_gene, "gene_id", "left").groupBy("ranking").agg(F.collect_list(F.struct("gene_id", "score", "sets")).alias("entries"))
    kinds = {c: df.schema[c].dataType for df, c in ((rankings, "ranking"), (sets, "set"))}

    together = BLOCK_MEMBERS

    def one(ranking: pa.Array, entries: pa.StructArray) -> Iterator[pa.RecordBatch]:
        gene, score = entries.field("gene_id").to_numpy(), entries.field("score").to_numpy()
        order, by_gene = np.lexsort((gene, -score)), np.argsort(gene)
        weight, axis = np.abs(score[order]) ** power, gene[by_gene]
        place, nth = np.empty(len(gene), np.int64), np.empty(len(gene), np.int64)
        place[order] = nth[by_gene] = np.arange(len(gene))
        place = place[by_gene]
        lists = entries.field("sets")
        named = lists.flatten().dictionary_encode()
        block, owner = named.dictionary, named.indices.to_numpy()
        at = np.repeat(nth, pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
        by_owner = np.lexsort((at, owner))
        owner, at = owner[by_owner], at[by_owner]
        sizes = np.bincount(owner, minlength=len(block))
        good = (sizes >= max(1, min_size)) & (sizes <= max_size)
        keep, number = good[owner], np.cumsum(good) - 1
        owner, at, sizes = number[owner[keep]], at[keep], sizes[good]
        kept, ends = block.filter(pa.array(good)), np.cumsum(sizes)
        cuts = np.nonzero(np.diff((ends - 1) // together, prepend=-1))[0].tolist() + [len(sizes)]
        for first, last in zip(cuts, cuts[1:]):
            span = slice(ends[first] - sizes[first], ends[last - 1])
            own, its, n = owner[span] - first, at[span], sizes[first:last]
            es = scores(place[its], own, n, weight)
            null = np.stack([scores(permuted_places(axis, p, seed)[its], own, n, weight) for p in range(permutations)], axis=1) if permutations else np.empty((len(n), 0))
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([ranking] * len(n)), kept.slice(first, last - first), pa.array(n), pa.array(es), pa.array(list(null), pa.list_(pa.float64()))], names=["ranking", "set", "size", "es", "null"]
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from one(batch.column("ranking").slice(k, 1), batch.column("entries")[k].values)

    return met.mapInArrow(run, f"ranking {kinds['ranking'].simpleString()}, set {kinds['set'].simpleString()}, size long, es double, null array<double>")


def preranked(rankings: DataFrame, sets: DataFrame, permutations: int = 1000, seed: int = 0, min_size: int = 10, max_size: int = 500, power: float = 1.0) -> DataFrame:
    """ranking, set, size, es, nes, p_value, fdr.

    nes is the score over the mean of the set's null scores of its sign, p_value the share of those at least as extreme (both null without one).
    fdr compares, among scores of the sign within a ranking, the share of all sets' normalised null scores at least as extreme with the share of the
    observed ones, at most 1.  A score of 0 counts as positive.
    """
    found = null_scores(rankings, sets, permutations, seed, min_size, max_size, power)
    up = F.col("es") >= 0
    same = F.filter("null", lambda x: (x >= 0) == up)
    away = F.filter(same, lambda x: F.when(up, x >= F.col("es")).otherwise(x <= F.col("es")))
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(xs), F.lit(0))
    parts = found.withColumns({"pos": F.filter("null", lambda x: x >= 0), "neg": F.filter("null", lambda x: x < 0)}).withColumns({"pos_mean": mean(F.col("pos")), "neg_mean": mean(F.col("neg"))})
    scored = parts.select(
        "ranking", "set", "size", "es",
        F.when(up, F.col("es") / F.nullif(F.col("pos_mean"), F.lit(0.0))).otherwise(-F.col("es") / F.nullif(F.col("neg_mean"), F.lit(0.0))).alias("nes"),
        (F.size(away) / F.nullif(F.size(same), F.lit(0))).alias("p_value"),
        F.concat(F.transform("pos", lambda x: x / F.nullif(F.col("pos_mean"), F.lit(0.0))), F.transform("neg", lambda x: -x / F.nullif(F.col("neg_mean"), F.lit(0.0)))).alias("normalised"),
    )

    def of_ranking(table: pa.Table) -> pa.Table:
        nes = table["nes"].to_numpy()
        null = np.concatenate([np.empty(0), *(np.array(x, float) for x in table["normalised"].to_pylist())])
        fdr = np.full(len(nes), np.nan)
        for sign in (1, -1):
            own = (sign * nes >= 0) if sign > 0 else nes < 0
            n, o = (np.sort(sign * v[(v >= 0) if sign > 0 else (v < 0)]) for v in (null, nes))
            if own.any() and len(n):
                x = sign * nes[own]
                fdr[own] = np.minimum(1, (len(n) - np.searchsorted(n, x)) / len(n) / ((len(o) - np.searchsorted(o, x)) / len(o)))
        return table.drop_columns(["normalised"]).append_column("fdr", pa.array(fdr, from_pandas=True))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in scored.schema.fields if f.name != "normalised")
    return scored.groupBy("ranking").applyInArrow(of_ranking, f"{kinds}, fdr double")
