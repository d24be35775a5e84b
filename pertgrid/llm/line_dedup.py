"""Line deduplication by winnowing over line hashes.

A document is its sequence of lines.  In every window of ``WINDOW`` lines the line with the smallest hash (the right one of
equals) is selected: a fingerprint.  All copies of a run of ``WINDOW`` lines select the same line of it, so a run of
that length, the shortest that counts, is never missed (the guaranteed length k + w - 1 for fingerprints of k = 1 line
and windows of w = 3).  One or two lines count as a run when they have ``MIN_WORDS`` words; such a run is a fingerprint itself.

Fingerprints that occur once are dropped first: their windows never leave the task that holds the text.  The windows
around the others are joined with the first position (by doc_id, then line) where the same lines stand, compared
by 128 bits of hashes.  A later position is deleted; windows that match one line further on extend the match, to both sides
as far as the lines agree, and overlapping matches merge.

Only one join partner, the first position, is used for each window, so that a line which occurs in a
third of all documents makes as many rows as it has positions and no pairs among them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import narrowed, stored, unused

#: Words from which one or two repeated lines count as a run.
MIN_WORDS = 50
#: Lines of a window, and of the shortest run that counts whatever its words.
WINDOW = 3


def _windows(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, prints, windows): the hashes of the fingerprints, one for each selected line or wide window; and each
    qualifying window with its ``print``, ``size``, ``start`` and the 128 bits ``g1``, ``g2`` of its lines."""
    lines = docs.select("doc_id", F.split(F.coalesce(F.col("text"), F.lit("")), "\n").alias("lines")).select(
        "doc_id",
        F.transform("lines", lambda x: F.xxhash64(x)).alias("h"),
        F.transform("lines", lambda x: F.xxhash64(F.lit(1), x)).alias("k"),
        F.transform("lines", lambda x: F.size(F.split(F.trim(x), "[\\x20\\x09-\\x0D]+"))).alias("w"),
    )
    n = F.size("h")

    def window(start: Column, size: int) -> Column:
        h, k = ([F.get(c, start + i) for i in range(size)] for c in "hk")
        gram = F.xxhash64(F.lit(size), *h)
        print_ = gram if size < WINDOW else F.least(*h)
        return F.struct(print_.alias("print"), F.lit(size).alias("size"), start.cast("int").alias("start"), gram.alias("g1"), F.xxhash64(F.lit(size), *k).alias("g2"))

    def selected(start: Column) -> Column:
        h = [F.get("h", start + i) for i in range(WINDOW)]
        return start + F.when(h[2] <= F.least(h[0], h[1]), 2).when(h[1] <= h[0], 1).otherwise(0)

    def starts(size: int) -> Column:
        return F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))

    one = F.filter(starts(1), lambda i: F.get("w", i) >= min_words)
    two = F.filter(starts(2), lambda i: F.get("w", i) + F.get("w", i + 1) >= min_words)
    wide = F.concat(F.transform(two, lambda i: window(i, 2)), F.transform(one, lambda i: window(i, 1)))
    # neighbouring windows that select the same line have one fingerprint; its place, a number, tells them apart
    prints = F.transform(F.array_distinct(F.transform(starts(WINDOW), selected)), lambda i: F.get("h", i))
    found = F.concat(F.transform(starts(WINDOW), lambda i: window(i, WINDOW)), wide)
    return lines.select("doc_id", F.concat(prints, F.transform(wide, lambda x: x["print"])).alias("prints"), found.alias("windows"))


def _candidates(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, size, start, g1, g2) of the windows whose fingerprint may occur at several positions."""
    windows = _windows(docs, min_words)
    # explode_outer: for explode a filter on the array's size would go below the projections and compute all arrays anew for each line
    prints = windows.select(F.explode_outer("prints").alias("print")).where("print is not null")
    repeated = stored(prints.groupBy("print").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("print"), "repeated-lines")
    rows = windows.select("doc_id", F.explode_outer("windows").alias("x")).where("x is not null").select("doc_id", "x.print", "x.size", "x.start", "x.g1", "x.g2")
    return stored(narrowed(rows, F.col("print"), repeated).drop("print"), "line-windows")


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, spans): for documents with deleted lines, the (start, size) of every later copy of a window."""
    windows = _candidates(docs.where(F.col("doc_id").isNotNull()), min_words)
    first = windows.groupBy("g1", "g2", "size").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = windows.join(first, ["g1", "g2", "size"]).where(
        (F.col("doc_id") != F.col("first.doc_id")) | (F.col("start") >= F.col("first.start") + F.col("size"))
    )
    return later.groupBy("doc_id").agg(F.collect_set(F.struct("start", "size")).alias("spans"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``text`` without later repeated runs, ``n_lines`` and ``n_removed``.

    Every row stays, also one whose lines all go (its text becomes empty).  A null text has no lines and stays
    null; an empty text is one empty line.  Rows with a null doc_id neither lose lines nor take part.  Rows
    that repeat a doc_id are copies of one document: each keeps what is first.  A run that repeats within a
    document loses its later copies that do not overlap the first.  Extra columns are handed on; columns of ``docs`` that
    are named n_lines or n_removed are replaced.
    """
    docs = docs.drop("n_lines", "n_removed")
    of, spans, gone = unused(docs, "span_doc", "deleted_spans", "deleted_lines")
    found = repeated_spans(docs.select("doc_id", "text"), min_words).select(F.col("doc_id").alias(of), F.col("spans").alias(spans))
    joined = docs.join(found, F.col("doc_id") == F.col(of), "left").drop(of)
    lines = F.split(F.col("text"), "\n")
    places = F.flatten(F.transform(spans, lambda s: F.sequence(s["start"], s["start"] + s["size"] - 1)))
    joined = joined.withColumn(gone, F.when(F.col(spans).isNotNull(), F.array_distinct(places)))
    keep = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone)), lambda i: F.get(lines, i))
    return (
        joined.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long"))
        .withColumn("n_removed", F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long"))
        .withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(keep, "\n")))
        .drop(spans, gone)
    )
