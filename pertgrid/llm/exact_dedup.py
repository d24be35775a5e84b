"""Exact deduplication with a heavy-hitter split.

Texts are equal when they are identical without ASCII white space.  The digests of all texts are written
once as a narrow table.  Misra-Gries counters (``DataFrame.freqItems``) name every digest that can hold
more than ``support`` of the rows, at most ``1 / support`` of them.  For these the winner and the exact group size
are computed by aggregates that combine on the map side, and broadcast: the bound on the counters bounds
the broadcast.  Rows of a heavy digest get their winner on the map side and are never shuffled; the
remaining digests, none of which is frequent, are shuffled in the ordinary way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Share of the rows above which a digest counts as heavy; its inverse bounds what is broadcast.
SUPPORT = 0.002
_SPACE = " \t\n\x0b\x0c\r"


def digest(text: Column) -> Column:
    """SHA-256 (hex) of the text without ASCII white space; null counts as empty."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), _SPACE, "").cast("binary"), 256)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Of equal texts the one with the most code points in its original form stays, then the smallest id.
    Null texts equal empty ones.  A null id comes after all others.  Rows that repeat an id and its text
    count each in ``group_size`` and share ``kept``.  An empty table gives no rows; further columns of
    ``docs`` are not read.
    """
    rows = stored(
        docs.select(F.col(id_col).alias("id"), F.unhex(digest(F.col(text_col))).alias("digest"), F.coalesce(F.length(text_col), F.lit(0)).alias("len")),
        "exact-digests",
    )
    best = F.struct((-F.col("len")).alias("neg_len"), F.col("id").isNull().alias("no_id"), F.col("id"))
    candidates = rows.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    heavy = (
        rows.join(F.broadcast(candidates), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.min(best).getField("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    heavy = stored(heavy, "exact-heavy")
    split = rows.join(F.broadcast(heavy), "digest", "left")
    removed = split.where(F.col("group_size").isNotNull())
    rest = split.where(F.col("group_size").isNull()).select("id", "digest", "len")
    # aggregated and joined back: a group below the support may still be larger than a task should hold
    groups = rest.groupBy("digest").agg(F.min(best).getField("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    rest = rest.join(groups, "digest")
    return removed.select("id", "digest", "keep_id", "group_size").unionByName(rest.select("id", "digest", "keep_id", "group_size")).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
