"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words (``targets``).  A document's expected number of copies is its source's
target over its source's size, scaled by an optional importance weight.  The whole part of that number is
allocated as certain copies.  The remainder is sampled: with inclusion probability p (the fractional part)
and a random u, documents are ranked by  (u / (1 - u)) / (p / (1 - p))  and taken in that order until the
words that the certain copies leave open are filled.  With equal sizes this is Pareto sampling of fixed
size n; with unequal sizes the fixed size is the number of words.

No source is ordered in one task: ranks are first summed into ``RANK_BINS`` bins per source, which finds
the one bin where the source's open words run out; that bin is cut into as many finer ones in the same way,
and only the documents of the one where the words run out are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored, word_count

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: The largest multiple of its size that a source or document is repeated.
MAX_COPIES = 3
#: Bins of the Pareto rank per source.
RANK_BINS = 2048
_RANDOM_BITS = 52


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from the key alone, the same in every run."""
    bits = F.conv(F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{seed}")).cast("binary")), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(2**_RANDOM_BITS)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """``sizes`` (source, source_size) with ``weight`` and ``target``: all words shared by weight, no target above
    ``max_copies`` times its source, the excess reshared by weight until none is above.

    A source at its cap has the smallest ratio of cap to weight, so the shares follow from one order of
    the sources by that ratio: those whose ratio is below the level that the rest would get are capped.
    The input is one row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weighted = sizes.withColumn("place", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    )
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    levels = (
        weighted.withColumn("cap", F.col("source_size") * float(max_copies))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(by_ratio), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("caps_before")) / F.col("weight_left"))
        .withColumn("free", F.col("cap") >= F.col("level") * F.col("weight"))
        .withColumn("final_level", F.min(F.when(F.col("free"), F.struct(F.col("source_size") / F.col("weight"), "place", "level"))).over(everything).getField("level"))
    )
    return levels.select("source", "source_size", "weight", F.least(F.col("cap"), F.coalesce(F.col("final_level") * F.col("weight"), F.col("cap"))).alias("target"))


def _thresholds(sized: DataFrame, seed: int, rank_bins: int, weights: tuple[int, ...]) -> DataFrame:
    """One row per source of ``sized`` (doc_id, source, size, importance): ``s``, source_size, target, mass, and of its ``border``
    (the finer bin where its open words run out) with the words taken ``before`` it and the words ``open``; null without any."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("importance")).alias("mass"))
    aims = targets(sums.select("source", "source_size"), weights).join(sums.select(F.col("source").alias("s"), "mass"), F.col("source").eqNullSafe(F.col("s"))).drop("source")
    planned = _planned(sized, aims, seed, rank_bins)
    whole, upto = Window.partitionBy("source"), Window.partitionBy("source").orderBy(F.col("bin").asc_nulls_first())
    bins = planned.groupBy("source", F.floor(F.col("fine") / rank_bins).alias("bin")).agg(F.sum(F.when(F.col("rank").isNotNull(), F.col("size")).otherwise(0)).alias("words"), F.sum(F.col("certain") * F.col("size")).alias("certain_words"), F.max("target").alias("target"))
    coarse = (
        bins.withColumn("open", F.max("target").over(whole) - F.sum("certain_words").over(whole))
        .withColumn("before", F.sum("words").over(upto) - F.col("words"))
        .where(F.col("bin").isNotNull() & (F.col("before") < F.col("open")))
        .groupBy("source")
        .agg(F.max(F.struct("bin", "before", "open")).alias("b"))
        .select(F.col("source").alias("bs"), "b.*")
    )
    inside = planned.select("source", "size", "fine").join(coarse, F.col("source").eqNullSafe(F.col("bs")) & (F.floor(F.col("fine") / rank_bins) == F.col("bin")))
    fine = inside.groupBy("source", "fine").agg(F.sum("size").alias("words"), F.min("before").alias("first"), F.min("open").alias("open"))
    upto = Window.partitionBy("source").orderBy("fine")
    borders = (
        fine.withColumn("before", F.col("first") + F.sum("words").over(upto) - F.col("words"))
        .where(F.col("before") < F.col("open"))
        .groupBy("source")
        .agg(F.max(F.struct(F.col("fine").alias("border"), "before", "open")).alias("b"))
        .select(F.col("source").alias("bs"), "b.*")
    )
    return aims.join(borders, F.col("s").eqNullSafe(F.col("bs")), "left").drop("bs")


def _planned(rows: DataFrame, sources: DataFrame, seed: int, rank_bins: int) -> DataFrame:
    """``rows`` (doc_id, source, importance, ...) with what their source's row says: certain copies, rank and finer bin.

    ``sources`` has one row per source; Spark broadcasts it only while it is below the session's threshold."""
    return (
        rows.join(sources, F.col("source").eqNullSafe(F.col("s")))
        .drop("s")
        .withColumn("wanted", F.least(F.lit(float(MAX_COPIES)), F.coalesce(F.col("target") * F.col("importance") / F.nullif(F.col("mass"), F.lit(0.0)), F.lit(0.0))))
        .withColumn("certain", F.floor(F.col("wanted") + 1e-9).cast("long"))
        .withColumn("p", F.greatest(F.lit(0.0), F.col("wanted") - F.col("certain")))
        .withColumn("u", uniform(F.col("doc_id"), seed))
        .withColumn("rank", F.when(F.col("p") > 0, (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))))
        .withColumn("fine", F.floor(F.col("rank") / (1 + F.col("rank")) * rank_bins * rank_bins))
        .drop("wanted", "p", "u", "mass")
    )


def _decided(planned: DataFrame, size: Column, has_words: Column) -> DataFrame:
    """``planned`` with ``copies``.  Only rows of the borders are moved, to be ordered; the others stay where they are."""
    at_border = F.coalesce(F.col("fine") == F.col("border"), F.lit(False))
    copies = F.when(has_words, F.least(F.col("certain") + F.col("extra"), F.lit(MAX_COPIES))).otherwise(F.lit(0)).cast("long")
    border = planned.where(at_border).withColumn("words", size)
    order = Window.partitionBy("source").orderBy("rank", F.col("doc_id").asc_nulls_last(), "words").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.col("before") + F.sum("words").over(order)
    border = border.withColumn("upto", upto).withColumn("extra", (F.col("upto") - F.col("words") / 2 <= F.col("open")).cast("long")).withColumn("copies", copies)
    others = planned.where(~at_border).withColumn("extra", F.coalesce(F.col("fine") < F.col("border"), F.lit(False)).cast("long")).withColumn("copies", copies)
    return border.drop("upto", "words", "extra").unionByName(others.drop("extra"))


def _sizes(docs: DataFrame, importance: str | None) -> DataFrame:
    weight = F.col(importance).cast("double") if importance else F.lit(1.0)
    return stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), weight.alias("importance")), "mix-sizes")  # the texts are read once


def mix(docs: DataFrame, seed: int = 17, importance: str | None = None, rank_bins: int = RANK_BINS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, ``copies`` (whole copies in the mix), ``taken`` (words).

    ``docs`` has doc_id, text, source; ``importance`` names an optional non-negative weight column.  A null
    text has size 0 and is taken 0 times, a null source is a source of its own, the last one.  Rows that
    repeat a doc_id get the same random number and are ranked next to each other by size.  An empty table
    gives no rows.  Only whole documents are taken, so a source misses its target by at most half of the
    document at its border; no document is taken more than ``MAX_COPIES`` times.
    """
    sized = _sizes(docs, importance)
    sources = stored(_thresholds(sized, seed, rank_bins, weights), "mix-sources")
    decided = _decided(_planned(sized, sources, seed, rank_bins), F.col("size"), F.col("size") > 0)
    return decided.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 17, importance: str | None = None, rank_bins: int = RANK_BINS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mix itself: the columns of ``docs``, whatever their names, each row as often as ``mix`` takes it.

    A row's copies follow from its own columns and the one row of its source, so texts are not shuffled but
    those of the finest bin at each source's border.
    """
    sources = stored(_thresholds(_sizes(docs, importance), seed, rank_bins, weights), "mix-sources")
    weight = F.col(importance).cast("double") if importance else F.lit(1.0)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source", weight.alias("importance"))
    taken = _decided(_planned(rows, sources, seed, rank_bins), word_count(F.col("row.text")), F.coalesce(F.col("row.text").rlike(WORD), F.lit(False))).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")
