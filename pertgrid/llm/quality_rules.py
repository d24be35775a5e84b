"""Quality rules: counts of each text, and a hashed n-gram log-likelihood ratio against a trusted target.

Features are the runs of one and two words of a text, hashed to ``BUCKETS``.  One scan counts every bucket over all
documents (the raw corpus) and over the trusted ones (the target), which gives two multinomials; each bucket has ``SMOOTHING``
more features in both, of which the target gets its share of the corpus, so rare buckets say little.  A bucket's gain is the
logarithm of the ratio of its two probabilities in whole thousandths, so sums do not depend on their order.  A document's
score is the mean gain of its features, with ``PRIOR`` features of gain 0 added to keep short texts near 0; every document
below ``MIN_SCORE`` is rejected, and so is every one that fails the base rules.

Everything is column expressions.  A text is cut and counted within its row, so no word is shuffled: the count's partial
sums are one row a bucket and task, and the model is one array of ``BUCKETS`` integers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, flagged, stored

BUCKETS = 1 << 16
#: Features that a bucket has besides those counted.
SMOOTHING = 16
#: Features of gain 0 that every document has besides its own.
PRIOR = 16
#: Thousandths of a natural logarithm a feature.  By held-out labels of sf0.1 (README) trusted documents are above it.
MIN_SCORE = -175
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 10, 5, 20
SYMBOLS = r"[#*$%&|<>]"
_GAP = r"[\x20\x09-\x0D]+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: acc + x)


def words(text: Column) -> Column:
    """The words of a text in order; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _GAP), "")


def _bucket(feature: Column, buckets: int) -> Column:
    return (F.crc32(feature.cast("binary")) % buckets).cast("int")


def trusted_ids(labels: DataFrame, max_docs: int | None = None) -> DataFrame:
    """The distinct doc_id labelled of quality 1 and not toxic: all of them, which is what ``judge`` fits on.  A caller that wants no more than
    about ``max_docs`` gets a choice by hash."""
    ids = labels.where((F.col("quality") == 1) & (F.col("toxic") == 0) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    if max_docs is None:
        return ids
    n = ids.count()
    if n <= max_docs:
        return ids
    return ids.where(F.crc32(F.concat(F.lit("trusted:"), F.col("doc_id").cast("string")).cast("binary")) < int((1 << 32) * max_docs / n))


def fit(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row: ``gains``, an array of ``buckets`` long.  ``trusted`` has the distinct doc_id of the target.

    A null text has no features; rows that repeat a doc_id count each.  Without a feature in the target all gains are 0.
    Whole doc_id of ``trusted`` are broadcast as bits, so no text is shuffled for them (``common.flagged``).
    """
    marked = flagged(docs.select("doc_id", "text"), "doc_id", trusted, "in_target")
    w = marked.select(words(F.col("text")).alias("w"), F.col("in_target").cast("int").alias("in_target"))
    following = F.slice("w", F.lit(2), F.size("w"))  # one shorter: the last word has none
    pairs = w.select("in_target", F.explode(F.arrays_zip(F.col("w").alias("word"), following.alias("next"))).alias("x"))
    pair = F.concat(F.col("x.word"), F.lit(" "), F.col("x.next"))
    hashed = pairs.select("in_target", F.explode(F.array(_bucket(F.col("x.word"), buckets), _bucket(pair, buckets))).alias("bucket")).where("bucket IS NOT NULL")
    counts = hashed.groupBy("bucket").agg(F.count(F.lit(1)).alias("s"), F.sum("in_target").alias("t"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    rows = every.agg(F.sort_array(F.collect_list(F.struct("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")))).alias("rows"))
    sums = rows.select("rows", _total(F.transform("rows", lambda x: x["s"])).cast("double").alias("s"), _total(F.transform("rows", lambda x: x["t"])).cast("double").alias("t"))

    def gain(x: Column) -> Column:
        ratio = (x["t"] * F.col("s") + SMOOTHING * F.col("t")) / ((x["s"] + SMOOTHING) * F.col("t"))
        return F.when(F.col("t") > 0, F.floor(1000 * F.log(ratio))).otherwise(0).cast("int")

    return sums.select(F.transform("rows", gain).alias("gains"))


def summed_gains(w: Column, gains: Column, buckets: int) -> Column:
    """The gains of all features of a text, added."""

    def at(x: Column, i: Column) -> Column:
        pair = F.concat(F.get(w, i - 1), F.lit(" "), x)  # null at the first word
        return F.get(gains, _bucket(x, buckets)) + F.coalesce(F.get(gains, _bucket(pair, buckets)), F.lit(0))

    return _total(F.transform(w, at))


def n_repeat_words(w: Column) -> Column:
    """Words that lie in a window of ``WINDOW`` words which the text holds twice or more, the first of them included.

    Windows are equal when their 64-bit hashes are; two unlike ones among a text's n meet with a chance of n * n / 2 ** 65.
    """

    starts = F.sequence(F.lit(0), F.size(w) - WINDOW)

    def hashed(i: Column) -> Column:
        return F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])

    def repeated(sorted_windows: Column) -> Column:
        def same(x: Column, j: Column) -> Column:
            return (x["h"] == F.get(sorted_windows, j - 1)["h"]) | (x["h"] == F.get(sorted_windows, j + 1)["h"])

        return F.array_sort(F.transform(F.filter(sorted_windows, lambda x, j: F.coalesce(same(x, j), F.lit(False))), lambda x: x["p"]))

    def covered(places: Column) -> Column:
        return _total(F.transform(places, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - p, F.lit(WINDOW))).cast("long")))

    def counted(hashes: Column) -> Column:
        windows = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_let(_let(windows, repeated), covered))

    return F.when(F.size(w) < WINDOW, F.lit(0).cast("long")).otherwise(_let(F.transform(starts, hashed), counted))


def n_dup_lines(text: Column) -> Column:
    """Lines that hold a word and equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(WORD))
    return _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def judge(docs: DataFrame, labels: DataFrame, min_score: int = MIN_SCORE, buckets: int = BUCKETS) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept.

    ``docs`` has doc_id (any type that ``labels.doc_id`` can be joined with) and text; other columns, whatever their names, are
    not read.  ``labels`` has doc_id, quality, toxic.  A null or empty text has no words, fails the base rules and scores 0.
    Rows that repeat a doc_id or a text are judged each, alike where their texts are; equal scores get equal verdicts.  A null
    doc_id is judged like any other.  An empty table gives no rows; without trusted documents every score is 0.  A text is held
    whole by its task, as an array of its words.
    """
    model = stored(fit(docs, trusted_ids(labels), buckets), "quality-gains")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("w", words(F.col("text"))).withColumn("gains", model.scalar())
    w = F.col("w")
    counted = rows.select(
        "doc_id",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        n_dup_lines(F.col("text")).alias("n_dup_lines"),
        n_repeat_words(w).alias("n_repeat_words"),
        summed_gains(w, F.col("gains"), buckets).alias("gain"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    score = F.floor(F.col("gain") / (F.greatest(2 * F.col("n_words") - 1, F.lit(0)) + PRIOR))
    judged = counted.withColumns({"base_failed": failed, "score": score}).drop("gain")
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= min_score))
