"""Language identification by compression.

For each language a zstandard raw-content dictionary is filled with sample texts.  A text is cut into pieces of
``PIECE_BYTES``; every piece is compressed with each language's dictionary, and the language with the
smallest sum wins.  The relative lead over the second smallest is the margin; a document whose margin is below
``MIN_MARGIN`` is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches

#: Bounds of the sample that is fitted: documents per language and bytes of a dictionary.  Whole documents fill a dictionary in
#: the order of a hash of their doc_id; the one that does not fit any more is the last, cut after a character.
SAMPLE_DOCS, DICTIONARY_BYTES = 200, 1 << 18
#: Languages that are learned at most; a table with more is refused, as its column holds something else.
MAX_LANGUAGES = 400
PIECE_BYTES = 1024
LEVEL = 9
#: Lead of the winner, as a share of the second smallest size, below which a document is rejected.
MIN_MARGIN = 0.01
UNDETERMINED = "und"


def fit(labelled: DataFrame) -> dict[str, bytes]:
    """Dictionaries from ``labelled`` (doc_id, text, lang): of each language the documents that a hash of doc_id puts first,
    ``SAMPLE_DOCS`` or as many as fill ``DICTIONARY_BYTES``.  What comes to the driver is bounded by these bytes times
    ``MAX_LANGUAGES``; more languages raise.  Languages are in the order of their numbers of documents: it decides
    ties.  Null texts and languages teach nothing; an empty table gives no dictionary.  Of rows that repeat a doc_id each
    counts, the smaller text first."""
    known = labelled.where("lang is not null and text is not null")
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    rows = known.select("doc_id", "lang", F.octet_length("text").alias("bytes"), F.xxhash64("text").alias("content"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "bytes", "content")
    placed = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= SAMPLE_DOCS)
    upto = Window.partitionBy("lang").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    chosen = placed.withColumn("before", F.coalesce(F.sum(F.col("bytes") + 1).over(upto), F.lit(0))).where(F.col("before") < DICTIONARY_BYTES)
    chosen = chosen.groupBy("doc_id", "lang", "bytes", "content").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("n"))
    texts = known.select("doc_id", "lang", F.octet_length("text").alias("bytes"), F.xxhash64("text").alias("content"), F.substring("text", 1, DICTIONARY_BYTES).alias("text"))
    # at most SAMPLE_DOCS rows for each of MAX_LANGUAGES
    picked = texts.join(F.broadcast(chosen), ["doc_id", "lang", "bytes", "content"]).dropDuplicates(["doc_id", "lang", "bytes", "content"])
    samples: dict[str, list] = {}
    for r in picked.select("lang", "place", "n", "text").collect():
        samples.setdefault(r.lang, []).append((r.place, r.n, r.text.lower()))
    found: dict[str, bytes] = {}
    for lang in sorted(samples, key=lambda x: (-counts[x], x)):
        sample = "\n".join(text for _, n, text in sorted(samples[lang]) for _ in range(n))
        found[lang] = sample.encode()[:DICTIONARY_BYTES].decode(errors="ignore").encode()
    return found


def _classifier(dictionaries: dict[str, bytes]):
    def compressor(content: bytes):
        data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)

    kinds = [(lang, compressor(content)) for lang, content in dictionaries.items()]

    def classify(text: str | None) -> tuple[str, float, float]:
        """Language, score and margin."""
        if text is None or not kinds or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, 0.0
        raw = text.lower().encode()
        sums = [0] * len(kinds)
        for at in range(0, len(raw), PIECE_BYTES):
            piece = raw[at : at + PIECE_BYTES]
            for k, (_, c) in enumerate(kinds):
                sums[k] += len(c.compress(piece))
        order = sorted(range(len(kinds)), key=lambda k: (sums[k], k))
        best, second = sums[order[0]], sums[order[1]] if len(order) > 1 else 2 * sums[order[0]]
        margin = (second - best) / second
        return kinds[order[0]][0], min(1.0, margin / (margin + MIN_MARGIN)), margin

    return classify


def identify(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """One row per input row: doc_id, lang_pred, score, margin, accepted.

    ``lang_pred`` is a language of ``dictionaries``, or ``und`` for a null text or one without a letter, which is
    not accepted.  ``score`` is margin / (margin + MIN_MARGIN): one half where rejection begins.  With a
    single dictionary all text belongs to it.  Only doc_id, of any type, and text are read.
    """
    bounded_batches(docs.sparkSession)
    content = dict(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = _classifier(content)
        for batch in batches:
            found = [classify(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([x[0] for x in found], pa.string()),
                    pa.array([x[1] for x in found], pa.float64()),
                    pa.array([x[2] for x in found], pa.float64()),
                    pa.array([x[0] != UNDETERMINED and x[2] >= MIN_MARGIN for x in found], pa.bool_()),
                ],
                names=["doc_id", "lang_pred", "score", "margin", "accepted"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, margin double, accepted boolean")


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4, is 2; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def keep_accepted(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """The rows of ``docs`` whose text is accepted, with all their columns; no row is moved between tasks."""
    bounded_batches(docs.sparkSession)
    content = dict(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = _classifier(content)
        for batch in batches:
            found = [classify(t.as_py()) for t in batch.column("text")]
            yield batch.filter(pa.array([x[0] != UNDETERMINED and x[2] >= MIN_MARGIN for x in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
