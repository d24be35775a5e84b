"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over ``SPAN`` neighbouring words: the words where it has a 0 are ignored, so a
substituted word there does not break the hit.  The masked words of every place of the benchmark items
are hashed.  A Bloom-like bit table over these hashes goes to all tasks, sized by their number up to a bound;
training documents keep only the hashes whose bits are set, and those are joined with the benchmark's, once for
each document and item.  The equal hashes of such a pair give its alignments (offsets); each is verified word by word
along the whole item, allowing substitutions: as a share of the item, or within a stretch of fixed length.  Items
shorter than the span are met as one hash of all their words, and leak where they stand word for word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, excluding, stored

#: 1: the word counts; 0: it is ignored.
SEEDS = ("11110000111", "11011010011", "11101100101", "10110111001")
SPAN = 11
#: Bits of the table that goes to all tasks: 2 ** MIN_BITS (2 MB) to 2 ** MAX_BITS (32 MB), at least BITS_PER_HASH for each hash
#: while there is room; and bits that each hash sets in it.  A table that is too small lets more hashes through to the join.
MIN_BITS, MAX_BITS, BITS_PER_HASH, PROBES = 24, 28, 256, 2
#: Equal words of an alignment that make a leak, as a share of the item and at least.
MIN_SHARE, MIN_WORDS = 0.5, 8
#: Neighbouring words of an alignment, of which so many are equal, make a leak however long the item is.
LOCAL_WORDS, LOCAL_EQUAL = 20, 18
_MULT = np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def words(text: str | None) -> np.ndarray:
    """64-bit hashes of the words: runs without ASCII white space, A-Z in lower case."""
    found = (text or "").encode().lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


def seed_hashes(ids: np.ndarray) -> list[np.ndarray]:
    """For each seed the hashes at all places; empty for texts shorter than the span."""
    n = len(ids) - SPAN + 1
    if n <= 0:
        return [np.empty(0, np.uint64)] * len(SEEDS)
    out = []
    for number, mask in enumerate(SEEDS):
        h = np.full(n, np.uint64(number + 1))
        for k in range(SPAN):
            if mask[k] == "1":
                h = h * _MULT + ids[k : k + n]
        out.append(_mix(h))
    return out


def whole_hashes(ids: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all ``length`` words at all places; ``length`` is less than the span."""
    n = len(ids) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, np.uint64(len(SEEDS) + length))
    for k in range(length):
        h = h * _MULT + ids[k : k + n]
    return _mix(h)


def leaked(same: np.ndarray, item_words: int) -> bool:
    """Whether an alignment along which the words are ``same`` or not is a leak."""
    total = int(same.sum())
    if item_words < SPAN:
        return 0 < total == item_words
    if total >= max(MIN_WORDS, MIN_SHARE * item_words):
        return True
    upto = np.concatenate([[0], np.cumsum(same)])
    return len(same) >= LOCAL_WORDS and int((upto[LOCAL_WORDS:] - upto[:-LOCAL_WORDS]).max()) >= LOCAL_EQUAL


def item_hashes(ids: np.ndarray) -> list[np.ndarray]:
    """The hashes of an item at all its places: by seed, or of all its words when they are fewer than the span."""
    return seed_hashes(ids) if len(ids) >= SPAN else [whole_hashes(ids, len(ids))] if len(ids) else []


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [words(t.as_py()) for t in batch.column(1)]
        found = [np.unique(np.concatenate([np.empty(0, np.uint64), *item_hashes(x)])).view(np.int64) for x in ids]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.view(np.int64) for x in ids], pa.list_(pa.int64())), pa.array(found, pa.list_(pa.int64()))], names=["item_id", "item", "hashes"])


def _bits(hash_: Column, bits: int) -> Column:
    """Places of a hash in the table, from one as Spark's bitmaps count them, by its highest bits and on downwards."""
    return F.array(*[F.shiftrightunsigned(F.shiftleft(hash_, bits * k), 64 - bits) + 1 for k in range(PROBES)])


def _possible(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of the hashes whose bits are all set."""
    some, bits = np.arange(len(h)), (8 * len(table)).bit_length() - 1
    for k in range(PROBES):
        bit = ((h[some] << np.uint64(bits * k)) >> np.uint64(64 - bits)).astype(np.int64)
        some = some[(table[bit >> 3] >> (bit & 7).astype(np.uint8) & 1) > 0]
    return some


def offsets(text: np.ndarray, item: np.ndarray) -> list[int]:
    """The offsets of ``item`` in ``text`` (hashes of words) along which a hash of both is equal."""
    found: set[int] = set()
    mine = seed_hashes(text) if len(item) >= SPAN else [whole_hashes(text, len(item))]
    for own, theirs in zip(mine, item_hashes(item), strict=True):
        order = np.argsort(own, kind="stable")
        ranked = own[order]
        for at, (lo, hi) in enumerate(zip(np.searchsorted(ranked, theirs), np.searchsorted(ranked, theirs, "right"), strict=True)):
            found.update((order[lo:hi] - at).tolist())
    return sorted(found)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, item_id, text, item in zip(*(batch.column(k) for k in range(4)), strict=True):
            text, item, best, place = text.values.to_numpy(), item.values.to_numpy(), 0, 0
            for offset in offsets(text.view(np.uint64), item.view(np.uint64)):
                lo, hi = max(0, offset), min(len(text), offset + len(item))
                equal = text[lo:hi] == item[lo - offset : hi - offset]
                same = int(equal.sum())
                if same > best and leaked(equal, len(item)):
                    best, place = same, offset
            if best:
                rows.append((doc.as_py(), item_id.as_py(), len(item), best, best / len(item), place))
        kinds = [pa.int64()] * 4 + [pa.float64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["doc_id", "item_id", "item_words", "matched", "share", "doc_at"])


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, item_words, matched, share, doc_at): the best alignment of each leaked pair.

    A pair leaks when along one offset at least ``MIN_SHARE`` of the item's words and ``MIN_WORDS`` are equal, or
    ``LOCAL_EQUAL`` of some ``LOCAL_WORDS`` neighbouring ones.  An item shorter than the span leaks where all its words
    stand in a row, be it a single word.  Null or empty items match nothing; neither do documents without text or
    doc_id.  Rows that repeat an id are one document or item: the best alignment of any of them counts.
    Documents without a leak have no row.  Further columns are not read.  Ids are whole numbers, of any type that can be cast
    to long, and come back as such.
    """
    bounded_batches(docs.sparkSession)
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text").distinct()
    items = stored(items.mapInArrow(_item_rows, "item_id long, item array<long>, hashes array<long>").withColumn("variant", F.xxhash64("item")), "benchmark-items")
    places = items.select("item_id", "variant", F.explode("hashes").alias("hash"))
    hashes = places.select("hash").distinct()
    lengths = [r.n for r in items.where(F.size("item").between(1, SPAN - 1)).select(F.size("item").alias("n")).distinct().collect()]  # fewer than SPAN numbers
    n_bits = min(MAX_BITS, max(MIN_BITS, (BITS_PER_HASH * hashes.count()).bit_length()))
    bits = hashes.select(F.explode(_bits(F.col("hash"), n_bits)).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    table = np.zeros(1 << (n_bits - 3), np.uint8)
    for row in bits.toLocalIterator():  # at most 2 ** n_bits bits in all
        part = np.frombuffer(row.bits, np.uint8)
        table[(row.bucket - 1) * len(part) : row.bucket * len(part)] = part
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = words(text.as_py())
                found = [h[_possible(bits, h)] for h in seed_hashes(ids) + [whole_hashes(ids, length) for length in lengths]]
                found = np.unique(np.concatenate(found))
                if len(found):
                    rows.append((doc.as_py(), ids.view(np.int64), found.view(np.int64)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())))], names=["doc_id", "words", "hashes"])

    wanted = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text")
    hit = stored(wanted.mapInArrow(hits, "doc_id long, words array<long>, hashes array<long>").withColumn("row", F.xxhash64("words")), "seed-hits")
    # one row for each document and item, however many hashes they share and however often these occur in either
    pairs = hit.select("doc_id", "row", F.explode("hashes").alias("hash")).join(places, "hash").select("doc_id", "row", "item_id", "variant").distinct()
    candidates = pairs.join(hit.select("doc_id", "row", "words").dropDuplicates(["doc_id", "row"]), ["doc_id", "row"]).join(items.select("item_id", "variant", "item"), ["item_id", "variant"])
    confirmed = candidates.select("doc_id", "item_id", "words", "item").mapInArrow(_confirm, "doc_id long, item_id long, item_words long, matched long, share double, doc_at long")
    best = F.max(F.struct("matched", (-F.col("doc_at")).alias("neg_at"), "item_words", "share")).alias("b")
    return confirmed.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.col("b.item_words").alias("item_words"), F.col("b.matched").alias("matched"), F.col("b.share").alias("share"), (-F.col("b.neg_at")).alias("doc_at"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a leak; rows with a null doc_id stay."""
    return excluding(docs, "doc_id", stored(leaks(docs, benchmark).select("doc_id").distinct(), "leaked"))
