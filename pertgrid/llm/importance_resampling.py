"""Target-distribution importance resampling over a stored sparse matrix.

Features are the runs of one and two words of a text, hashed to buckets.  The counts of documents by buckets are written once
as CSR blocks: a block holds the documents of one Arrow batch, with row ends, the differences of neighbouring bucket numbers
within a row, and counts.  Everything after that reads the blocks and not the texts: their column sums give the corpus'
distribution, those of the target's blocks the target's, and the product of the matrix with the vector of gains gives each
document's weight.  A row of Gumbel noise, from a hash of the document's id, turns the largest scores into a draw without
replacement; ranks come from the counts of the distinct scores, so no sort of all documents is needed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StructType

from .common import bounded_batches, stored

BUCKETS = 10_000
SEED = 7
MIN_WORDS, PERCENT = 20, 25
#: Bytes of a text that are cut into words at a time.
PIECE_BYTES = 1 << 20
#: Everything but letters, digits and what is beyond ASCII becomes a space, A-Z lower case.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: CRC-32's polynomial, reflected (a fixed value).
_POLYNOMIAL = 0xEDB88320
#: Parquet options of the stored blocks.  A reader holds all blocks of a row group at once and a writer those of an unfinished one, so a group is
#: two blocks: what a task holds does not grow with the part of the table that it is dealt.
_SMALL_GROUPS = {"compression": "zstd", "parquet.block.row.count.limit": "2"}
#: Lengths up to which the effect of appending so many bytes to a CRC is looked up.
_SHIFTS = 48


def _step(crc: np.ndarray, bits: int = 8) -> np.ndarray:
    for _ in range(bits):
        crc = np.where(crc & 1, (crc >> np.uint32(1)) ^ np.uint32(_POLYNOMIAL), crc >> np.uint32(1))
    return crc


def _shift_tables() -> np.ndarray:
    """(length, byte of the CRC, its value): what becomes of it after ``length`` zero bytes."""
    now = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    out = [now]
    for _ in range(_SHIFTS):
        now = _step(now)
        out.append(now)
    return np.stack(out)


_SHIFT = _shift_tables()


def _pair_crcs(words: list[bytes], crcs: np.ndarray) -> np.ndarray:
    """CRC-32 of each word and the next one, joined by a space.

    A CRC is linear: that of two strings is the first's, moved on by the second's length, xor the second's."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))[1:]
    short = np.minimum(lengths, _SHIFTS)
    space = np.uint32(zlib.crc32(b" "))
    moved = crcs[:-1].copy()  # first the space behind it
    moved = _SHIFT[1, 0][moved & 255] ^ _SHIFT[1, 1][(moved >> 8) & 255] ^ _SHIFT[1, 2][(moved >> 16) & 255] ^ _SHIFT[1, 3][moved >> 24] ^ space
    out = _SHIFT[short, 0, moved & 255] ^ _SHIFT[short, 1, (moved >> 8) & 255] ^ _SHIFT[short, 2, (moved >> 16) & 255] ^ _SHIFT[short, 3, moved >> 24] ^ crcs[1:]
    for k in np.nonzero(lengths > _SHIFTS)[0]:
        out[k] = zlib.crc32(words[k + 1], zlib.crc32(b" ", zlib.crc32(words[k])))
    return out


def _pieces(raw: bytes) -> Iterator[bytes]:
    """``raw`` cut behind spaces into pieces of about ``PIECE_BYTES``."""
    start = 0
    while len(raw) - start > PIECE_BYTES:
        end = raw.find(b" ", start + PIECE_BYTES)
        if end < 0:
            break
        yield raw[start:end]
        start = end
    yield raw[start:]


def features(text: str | None, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text in ascending order, and how many of its features each holds."""
    found, last = [], b""
    for piece in _pieces((text or "").encode().translate(_BYTES)):
        words = piece.split()
        if not words:
            continue
        if last:
            words.insert(0, last)
        crcs = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
        hashed = np.concatenate([crcs[1:] if last else crcs, _pair_crcs(words, crcs)]) % np.uint32(buckets)
        found.append(hashed)
        last = words[-1]
    if not found:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    all_found = np.concatenate(found) if len(found) > 1 else found[0]
    return np.unique(all_found, return_counts=True)


def _block_schema(docs: DataFrame) -> StructType:
    """doc_ids of the documents' own type, ends, steps, counts."""
    kinds = StructType().add("doc_ids", ArrayType(docs.schema["doc_id"].dataType))
    for name in ("ends", "steps", "counts"):
        kinds = kinds.add(name, BinaryType())
    return kinds


def csr_blocks(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``docs`` (doc_id of any type, text) as CSR blocks, one a batch of texts: ``doc_ids``, and as little-endian bytes
    ``ends`` (int64, where each row ends), ``steps`` (uint32, a bucket less the one before it in its row) and ``counts`` (uint32).

    A null or empty text is a row without entries.
    """
    bounded_batches(docs.sparkSession)
    schema = _block_schema(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [features(t.as_py(), buckets) for t in batch.column(1)]
            ends = np.cumsum([len(b) for b, _ in rows]).astype("<i8")
            steps = np.concatenate([np.diff(b, prepend=np.uint32(0)) for b, _ in rows]).astype("<u4")
            counts = np.concatenate([n for _, n in rows]).astype("<u4")
            ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([x.tobytes()], pa.binary()) for x in (ends, steps, counts))], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _rows_of(ends: bytes, steps: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row starts and ends (n + 1), buckets, counts of a block."""
    bounds = np.concatenate([[0], np.frombuffer(ends, "<i8")])
    run = np.cumsum(np.frombuffer(steps, "<u4"), dtype=np.int64)
    before = np.concatenate([[0], run])[bounds[:-1]]  # the sum of all steps before the row
    return bounds, run - np.repeat(before, np.diff(bounds)), np.frombuffer(counts, "<u4").astype(np.int64)


def _row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(values)])
    return upto[bounds[1:]] - upto[bounds[:-1]]


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how many features of all documents of the blocks each bucket holds, where it holds any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for row in zip(*(batch.column(k) for k in range(3)), strict=True):
                _, bucket, count = _rows_of(*(x.as_py() for x in row))
                np.add.at(total, bucket, count)
        held = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], names=["bucket", "n"])

    return blocks.select("ends", "steps", "counts").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """For each bucket the logarithm of target over corpus probability, one added to each count, in whole thousandths.

    One vector of ``buckets`` numbers, whatever the size of the data, so the driver may hold it."""
    spark = corpus.sparkSession
    every = spark.range(buckets).withColumnRenamed("id", "bucket").join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    counts = np.array([tuple(r) for r in every.select("bucket", F.coalesce("s", F.lit(0)), F.coalesce("t", F.lit(0))).collect()], np.int64)
    s, t = counts[np.argsort(counts[:, 0]), 1:].T
    ratio = (t + 1).astype(float) * float(s.sum() + buckets) / ((s + 1).astype(float) * float(t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weights(blocks: DataFrame, vector: np.ndarray) -> DataFrame:
    """doc_id, n_features, weight of every row of the blocks: the matrix times the vector over the row's features, floored; 0 without any."""
    kind = blocks.schema["doc_ids"].dataType.elementType
    schema = StructType().add("doc_id", kind).add("n_features", "long").add("weight", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, *row in zip(*(batch.column(k) for k in range(4)), strict=True):
                bounds, bucket, count = _rows_of(*(x.as_py() for x in row))
                n, gained = _row_sums(count, bounds), _row_sums(count * vector[bucket], bounds)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(n), pa.array(np.where(n > 0, gained // np.maximum(n, 1), 0))], names=schema.names)

    return blocks.select("doc_ids", "ends", "steps", "counts").mapInArrow(run, schema)


def drawn(weighted: DataFrame, seed: int = SEED, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """``weighted`` (doc_id, n_features, weight) with score and rank.

    Scores are whole numbers of a range that does not grow with the data, so a table of their counts is small; it gives the
    score at which the draw ends, and the rank at which each score begins.  Only documents that reach that score are ordered,
    those of each score by doc_id (null last), and rows of one doc_id and score by n_features.
    """
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    score = F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = stored(weighted.withColumn("score", score.cast("long")), "importance-scores")
    eligible = F.col("n_features") >= 2 * min_words - 1
    by_score = scored.where(eligible).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    above = Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = by_score.select("score", (F.sum("n").over(above) - F.col("n")).alias("above"), F.floor(percent * F.sum("n").over(Window.partitionBy()) / 100).alias("wanted"))
    starts = stored(starts.where(F.col("above") < F.col("wanted")), "importance-starts")
    met = scored.where(eligible).join(starts, "score")
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features"))
    met = met.withColumn("rank", F.col("above") + place).withColumn("rank", F.when(F.col("rank") <= F.col("wanted"), F.col("rank")))
    lowest = F.coalesce(starts.agg(F.min("score")).scalar(), F.lit((1 << 63) - 1))
    rest = scored.where(~(eligible & (F.col("score") >= lowest))).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return met.select(columns).unionByName(rest.select(columns))


def resample(docs: DataFrame, target: DataFrame, seed: int = SEED, percent: int = PERCENT, buckets: int = BUCKETS, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (null where it is not drawn).

    ``docs`` has doc_id (any type) and text, ``target`` text; no other column is read, whatever its name.  A null or empty text,
    or one without a word, has no features, weight 0, and is not drawn; of an empty target, every bucket counts one.  Rows that
    repeat a doc_id get the same noise and a rank each; equal scores rank by doc_id, a null one last.  Empty ``docs`` give no
    rows.  Very long texts are cut into words piece by piece.
    """
    blocks = stored(csr_blocks(docs, buckets), "importance-blocks", **_SMALL_GROUPS)
    aims = csr_blocks(target.select(F.lit(0).alias("doc_id"), "text"), buckets)
    return drawn(weights(blocks, gains(column_sums(blocks, buckets), column_sums(aims, buckets), buckets)), seed, percent, min_words)


def resampled_documents(docs: DataFrame, target: DataFrame, **options: int) -> DataFrame:
    """The rows of ``docs`` that the draw takes, with all their columns; doc_id should be unique (a repeated one stays when any of its rows is drawn)."""
    ids = resample(docs, target, **options).where("rank IS NOT NULL").select("doc_id").distinct()
    return docs.join(ids, "doc_id", "left_semi").select(docs.columns)
