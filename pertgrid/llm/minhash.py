"""Near-duplicate detection: fast similarity sketching, banding, exact verification.

Sketch.  Every distinct five-word shingle of a document is placed in rounds.  In round i < COORDS a hash
puts it in one of COORDS bins with a value in [i, i + 1); in round COORDS + j it goes to bin j.  A bin
keeps its smallest value, and a document's rounds end when no bin is empty, after COORDS extra rounds at the
latest: every coordinate is filled, and the share of equal coordinates is concentrated around the Jaccard
similarity (Dahlgaard, Knudsen, Thorup 2017).

Candidates.  Documents with equal shingle sets become one representative first, so groups of copies cost
nothing further.  Coordinates are cut into BANDS bands.  In a first pass the members of a band's bucket
are paired with its smallest member only; of its centres in all bands a document meets the most similar one first,
and the others only where they are in another component then.  After these links are verified and components found, only
buckets that still hold several components are left; there all pairs of different components are
compared by their sketches, in blocks of bounded size when the bucket is large.  So a bucket of thousands of
copies costs few pairs for each, while no link between two components is left out: in large buckets the most
similar pairs are verified first, as these links mostly join what is left.

Verification.  Each candidate pair is confirmed on the full shingle sets, streamed in groups by the pair's
smaller member: a task holds one set and the texts of one Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, excluding, narrowed, released, stored

SHINGLE = 5
#: Link when 100 * intersection >= PERCENT * union.
PERCENT = 75
COORDS, ROWS = 128, 4
BANDS = COORDS // ROWS
#: Equal two-bit coordinates, of COORDS, that a pair needs to be verified.  At the threshold their mean is
#: 104 and their standard deviation 4.4; this is 4.3 of them below.
MIN_AGREE = 85
#: Coordinates, a byte of each, of the finer sketches of documents in large buckets, and equal ones that a pair needs: at the
#: threshold 384 on average with a standard deviation of 9.8.
FINE, FINE_AGREE = 512, 342
#: Candidates of each document in each block that are verified first in large buckets; afterwards all that are left between
#: the components are.
BEST = 3
#: Members from which an open bucket is compared in blocks, and the size of these.
SMALL_BUCKET, BLOCK = 48, 512
#: Members of one centre that are verified by one task, on average: a centre of more is dealt to several.
MEMBERS = 256
#: Shingles of the documents that are sketched together, and of those the ones that one step of numpy takes.
TOGETHER, CHUNK = 1 << 19, 1 << 17
#: Edges of a file that the search for components writes.
EDGES_PER_FILE = 1 << 20
_SEED = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text: words are runs without ASCII white space, A-Z in lower
    case; a text of fewer words is one shingle, one without words has none."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    width = min(n, SHINGLE)
    h = np.full(n - width + 1, np.uint64(width), np.uint64)
    for k in range(width):
        h = _mix(h * np.uint64(0xD6E8FEB86659FD93) ^ ids[k : n - width + 1 + k])
    return np.unique(h)


def sketches(sets: list[np.ndarray], coords: int = COORDS) -> np.ndarray:
    """One row of ``coords`` (a power of two) 64-bit coordinates for each non-empty set."""
    sizes = np.array([len(s) for s in sets])
    keys, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
    empty, shift = np.iinfo(np.uint64).max, np.uint64(65 - coords.bit_length())
    out = np.full(len(sets) * coords, empty, np.uint64)
    for i in range(2 * coords):
        for at in range(0, len(keys), CHUNK):
            h = _mix(keys[at : at + CHUNK] + np.uint64((i + 1) * int(_SEED) & (2**64 - 1)))
            bins = (h >> shift).astype(np.int64) if i < coords else np.int64(i - coords)
            value = (np.uint64(i) << np.uint64(52)) | (_mix(h) >> np.uint64(12))
            np.minimum.at(out, owner[at : at + CHUNK].astype(np.int64) * coords + bins, value)
        left = ~(out.reshape(-1, coords) != empty).all(axis=1)[owner]
        if not left.any():
            break
        keys, owner = keys[left], owner[left]
    return out.reshape(-1, coords)


def _in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """Ids and shingle sets of some documents at a time: ``TOGETHER`` shingles, or a document that has more alone."""
    for batch in batches:
        ids, start, sets, total = batch.column(0), 0, [], 0
        for k, text in enumerate(batch.column(1)):
            own = shingles(text.as_py())
            if sets and total + len(own) + FINE > TOGETHER:  # a sketch takes memory too
                yield ids[start:k], sets
                start, sets, total = k, [], 0
            sets.append(own)
            total += len(own) + FINE
        if sets:
            yield ids[start:], sets


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, sets in _in_parts(batches):
        some = [s for s in sets if len(s)]
        n = len(sets)
        bands, planes, prints = [None] * n, np.zeros((n, 4), np.int64), [None] * n
        if some:
            s = sketches(some)
            groups = s.reshape(len(some), BANDS, ROWS)
            key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _SEED, (len(some), BANDS))
            for r in range(ROWS):
                key = _mix(key * np.uint64(0xD6E8FEB86659FD93) ^ groups[:, :, r])
            low = _mix(s)
            bits = np.concatenate([np.packbits((low & np.uint64(1)).astype(np.uint8), axis=1), np.packbits(((low >> np.uint64(1)) & np.uint64(1)).astype(np.uint8), axis=1)], axis=1)
            where = [k for k, x in enumerate(sets) if len(x)]
            planes[where] = np.ascontiguousarray(bits).view(np.int64)
            for k, row in zip(where, key.view(np.int64), strict=True):
                bands[k] = row
                prints[k] = xxhash.xxh3_128_digest(sets[k].tobytes())
        yield pa.RecordBatch.from_arrays(
            [
                ids,
                pa.array([len(x) for x in sets], pa.int64()),
                pa.array(prints, pa.binary()),
                pa.array(bands, pa.list_(pa.int64())),
                *[pa.array(planes[:, k]) for k in range(4)],
            ],
            names=["doc_id", "n_shingles", "print", "bands", "p0", "p1", "p2", "p3"],
        )


def sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, print, bands, p0..p3): set size, 128-bit digest of the set, band keys, two-bit sketch."""
    return docs.select("doc_id", "text").mapInArrow(_sketch_batches, "doc_id long, n_shingles long, print binary, bands array<long>, p0 long, p1 long, p2 long, p3 long")


def _fine_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, sets in _in_parts(batches):
        keep = pa.array([len(x) > 0 for x in sets])
        some = [x for x in sets if len(x)]
        rows = (_mix(sketches(some, FINE)) & np.uint64(255)).astype(np.uint8) if some else []
        yield pa.RecordBatch.from_arrays([ids.filter(keep), pa.array([x.tobytes() for x in rows], pa.binary())], names=["doc_id", "fine"])


def _with_fine(rows: DataFrame, texts: DataFrame, reps: DataFrame) -> DataFrame:
    """``rows`` with the finer sketch and all bands of each document."""
    ids = rows.select("doc_id").distinct()
    fine = stored(narrowed(texts, F.col("doc_id"), ids).select("doc_id", "text").mapInArrow(_fine_batches, "doc_id long, fine binary"), "fine-sketches")
    return rows.join(fine.join(reps.select("doc_id", "bands"), "doc_id"), "doc_id")


def _differ(a: str, b: str) -> Column:
    """Two-bit coordinates that differ."""
    return sum(
        (F.bit_count(F.col(f"{a}.p{k}").bitwiseXOR(F.col(f"{b}.p{k}")).bitwiseOR(F.col(f"{a}.p{k + 2}").bitwiseXOR(F.col(f"{b}.p{k + 2}")))) for k in (0, 1)),
        F.lit(0),
    )


def _agree(a: str, b: str) -> Column:
    """Enough equal two-bit coordinates, and sizes that allow the similarity."""
    small, large = F.least(f"{a}.n_shingles", f"{b}.n_shingles"), F.greatest(f"{a}.n_shingles", f"{b}.n_shingles")
    return (_differ(a, b) <= COORDS - MIN_AGREE) & (small * 100 >= large * PERCENT)


def _verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    centre, held = None, None
    for batch in batches:
        found: list[tuple[int, int]] = []
        for a, b, text in zip(*(batch.column(k) for k in (0, 1, 2)), strict=True):
            own = shingles(text.as_py())
            if a != centre:
                centre, held = a, None
            if b.as_py() is None:
                held = own
            elif held is not None:
                shared = len(np.intersect1d(held, own, assume_unique=True))
                if 100 * shared >= PERCENT * (len(held) + len(own) - shared) > 0:
                    found.append((a.as_py(), b.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets are similar enough.  ``docs`` has one row per doc_id."""
    sides = [pairs.select(F.col(side).alias("id")).distinct() for side in ("a", "b")]
    docs = narrowed(docs, F.col("doc_id"), sides[0].unionByName(sides[1]), n_wanted=2 * pairs.count())  # a stored table: its count is read
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("parts"))
    salted = pairs.join(parts, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).drop("parts")
    members = salted.join(docs.hint("merge"), F.col("b") == F.col("doc_id")).select("a", "b", "text", "salt")
    each = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)).alias("salt"))  # a part without members does no harm
    centres = each.join(docs.hint("merge"), F.col("a") == F.col("doc_id")).select("a", F.lit(None).cast("long").alias("b"), "text", "salt")
    dealt = members.unionByName(centres).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return dealt.select("a", "b", "text").mapInArrow(_verify_batches, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``edges`` (a, b).

    Alternates the large-star and small-star steps (Kiveris et al. 2014) until the edges are stars; each
    round is written to the shared folder.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    files = edges.count() // EDGES_PER_FILE + 1  # of two numbers each; a round has at most as many edges as the one before
    current = stored(edges.coalesce(files), "components")
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        before, current = current, stored(small.coalesce(files), "components")
        released(before)
        # stars: a node points at one other, or is pointed at
        sides = current.select("u", F.lit(1).alias("out")).unionByName(current.select(F.col("v").alias("u"), F.lit(0).alias("out")))
        if sides.groupBy("u").agg(F.sum("out").alias("outs"), F.min("out").alias("least")).where("outs > 1 or (outs = 1 and least = 0)").isEmpty():
            return current.select(F.col("u").alias("node"), F.col("v").alias("component"))


_KEPT = ["doc_id", "component", "n_shingles", "p0", "p1", "p2", "p3"]


def _relabelled(rows: DataFrame, labels: DataFrame, least: int) -> DataFrame:
    """``rows`` with the component of each doc_id, and only those whose bucket (band) holds several components and ``least`` members."""
    own = rows.drop("component", "members").join(labels.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    buckets = own.groupBy("band").agg(F.count(F.lit(1)).alias("members"), F.min("component").alias("lo"), F.max("component").alias("hi")).where((F.col("members") >= least) & (F.col("lo") != F.col("hi")))
    return own.join(buckets.select("band", "members"), "band")


def _small_pairs(rows: DataFrame) -> DataFrame:
    """All pairs of different components in the small buckets, by their sketches similar enough."""
    a, b = rows.alias("a"), rows.alias("b")
    differ = (F.col("a.doc_id") < F.col("b.doc_id")) & (F.col("a.component") != F.col("b.component"))
    return a.join(b, (F.col("a.band") == F.col("b.band")) & differ & _agree("a", "b")).select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b")).distinct()


def _blocks(rows: DataFrame) -> DataFrame:
    """``rows`` with the ``block`` of their bucket: some ``BLOCK`` members each, components as far as possible together.

    A component with a fair share of a block is a bin of its own, the others are dealt to bins by hash; the sizes of the
    bins, added up in their order, make the block numbers.  What is ordered is a hundredth of the members, and a component
    of any size spreads over its range.
    """
    of_hash = F.pmod(F.xxhash64("component"), F.greatest(F.lit(1), F.ceil(F.max("members") * 4 / BLOCK)))
    bins = rows.groupBy("band", "component").agg(F.count(F.lit(1)).alias("own"), of_hash.alias("bin"))
    bins = bins.withColumn("bin", F.when(F.col("own") * 8 >= BLOCK, -1 - F.col("component")).otherwise(F.col("bin")))
    sizes = bins.groupBy("band", "bin").agg(F.sum("own").alias("size"))
    before = F.sum("size").over(Window.partitionBy("band").orderBy("bin")) - F.col("size")
    bins = bins.join(sizes.withColumn("before", before), ["band", "bin"]).select("band", "component", "before", "size")
    part = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(1)), 12) / float(1 << 52)) * F.col("size")
    return rows.join(bins, ["band", "component"]).withColumn("block", F.floor((F.col("before") + part) / BLOCK))


def _numbers(column: pa.ChunkedArray, rows: np.ndarray) -> np.ndarray:
    return column.to_numpy()[rows]


def _bytes(column: pa.ChunkedArray, rows: np.ndarray, width: int) -> np.ndarray:
    """A matrix of bytes from a binary column whose values all have ``width``."""
    return np.frombuffer(b"".join(column.take(pa.array(rows)).to_pylist()), np.uint8).reshape(-1, width)


def _block_pairs(rows: DataFrame, best: int | None) -> DataFrame:
    """Pairs of different components in the large buckets: of every document the ``best`` most similar of each block
    (all for None).  Blocks follow the components, and two blocks of one component do not meet.  A pair that shares several
    bands is met in the first of them alone."""
    blocks = stored(_blocks(rows).select("band", "block", *_KEPT, "fine", F.transform("bands", lambda x: x.cast("long")).alias("bands")), "open-blocks")
    spans = blocks.groupBy("band", "block").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    x, y = spans.alias("x"), spans.alias("y")
    several = ~((F.col("x.lo") == F.col("x.hi")) & (F.col("y.lo") == F.col("y.hi")) & (F.col("x.lo") == F.col("y.lo")))
    tasks = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.block") <= F.col("y.block")) & several).select(F.col("x.band").alias("band"), F.col("x.block").alias("i"), F.col("y.block").alias("j"))
    sides = tasks.select("band", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        band, i, j = (k.as_py() for k in key)
        block = table["block"].to_numpy()
        left, right = np.nonzero(block == i)[0], np.nonzero(block == j)[0]
        differ = np.zeros((len(left), len(right)), np.int16)
        for k in (0, 1):
            low, high = table[f"p{k}"], table[f"p{k + 2}"]
            bits = np.bitwise_xor.outer(_numbers(low, left), _numbers(low, right)) | np.bitwise_xor.outer(_numbers(high, left), _numbers(high, right))
            differ += np.bitwise_count(bits.view(np.uint64))
        n, m = _numbers(table["n_shingles"], left)[:, None], _numbers(table["n_shingles"], right)[None, :]
        good = (differ <= COORDS - MIN_AGREE) & (np.minimum(n, m) * 100 >= np.maximum(n, m) * PERCENT)
        good &= _numbers(table["component"], left)[:, None] != _numbers(table["component"], right)[None, :]
        s, t = np.nonzero(good)
        if len(s):
            x, y = _bytes(table["fine"], left, FINE), _bytes(table["fine"], right, FINE)
            bands = table["bands"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
            u, v = bands[left], bands[right]
            here = np.nonzero(u[0] == band)[0][0]
            parts = range(0, len(s), 4096)
            first_here = np.concatenate([~(u[s[k : k + 4096], :here] == v[t[k : k + 4096], :here]).any(axis=1) for k in parts])
            same = np.concatenate([(x[s[k : k + 4096]] == y[t[k : k + 4096]]).sum(axis=1) for k in parts])
            same = np.where(first_here, same, 0)
            good[s, t] = same >= FINE_AGREE
            if best is not None:
                cost = np.full(good.shape, FINE + 1, np.int16)
                cost[s, t] = np.where(same >= FINE_AGREE, FINE - same, FINE + 1)
                first, second = np.zeros_like(good), np.zeros_like(good)
                np.put_along_axis(first, np.argsort(cost, axis=1, kind="stable")[:, :best], True, axis=1)
                np.put_along_axis(second, np.argsort(cost, axis=0, kind="stable")[:best], True, axis=0)
                good &= first | second
        s, t = np.nonzero(good)
        p, q = _numbers(table["doc_id"], left)[s], _numbers(table["doc_id"], right)[t]
        pairs = np.unique(np.stack([np.minimum(p, q), np.maximum(p, q)], axis=1), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return blocks.join(sides, ["band", "block"]).groupBy("band", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def _between(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose documents are in different components."""
    for side in ("a", "b"):
        own = labels.select(F.col("node").alias(side), F.col("component").alias(f"{side}_component"))
        pairs = pairs.join(own, side, "left").withColumn(f"{side}_component", F.coalesce(f"{side}_component", side))
    return pairs.where("a_component <> b_component").select("a", "b")


def _closed(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Components after further links."""
    return labels if links.isEmpty() else components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))


def _linked(reps: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, component) of the documents of different sets that links join."""
    rows = reps.select("doc_id", F.explode("bands").alias("band"))
    centres = stored(rows.groupBy("band").agg(F.min("doc_id").alias("a"), F.count(F.lit(1)).alias("members")).where("members > 1"), "shared-bands")
    shared = narrowed(rows, F.col("band"), centres.select("band")).join(centres, "band")
    light = reps.drop("bands", "print")
    shared = stored(shared.join(light, "doc_id"), "shared-rows")
    stars = shared.where("a <> doc_id").select("a", F.col("doc_id").alias("b")).distinct()
    stars = stars.join(light.alias("x"), F.col("a") == F.col("x.doc_id")).join(light.alias("y"), F.col("b") == F.col("y.doc_id")).where(_agree("x", "y"))
    stars = stored(stars.select("a", "b", _differ("x", "y").alias("differ")), "star-pairs")
    # of each document its most similar centre first, then the centres that these links have not joined it with
    first = stored(stars.groupBy("b").agg(F.min(F.struct("differ", "a")).getField("a").alias("a")).select("a", "b"), "first-pairs")
    links = stored(verify(first, texts), "first-links")
    labels = stored(components(links), "first-labels")
    others = stored(_between(stars.select("a", "b").join(first, ["a", "b"], "left_anti"), labels), "other-pairs")
    labels = _closed(stored(verify(others, texts), "star-links"), labels)
    tested = first.unionByName(others)

    rows = stored(_relabelled(shared.where("members > 2").drop("a"), labels, 3), "open-buckets")
    large = rows.where(F.col("members") > SMALL_BUCKET)
    pairs = _small_pairs(rows.where(F.col("members") <= SMALL_BUCKET))
    any_large = not large.isEmpty()
    if any_large:
        large = stored(_with_fine(large, texts, reps), "large-buckets")
        best = stored(_block_pairs(large, BEST), "best-pairs")
        pairs = pairs.unionByName(best).distinct()
    fresh = stored(pairs.join(tested, ["a", "b"], "left_anti"), "open-pairs")
    links = stored(verify(fresh, texts), "open-links")
    labels = _closed(links, labels)
    if any_large:
        # a document without a candidate so far has none among fewer components either
        again = best.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        left = stored(_relabelled(large.join(again, "doc_id", "left_semi"), labels, 2), "left-buckets")
        if not left.isEmpty():
            fresh = stored(_block_pairs(left, None).join(tested.unionByName(fresh), ["a", "b"], "left_anti"), "left-pairs")
            links = stored(verify(fresh, texts), "left-links")
            labels = _closed(links, labels)
    return labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    ``component_id`` is the smallest doc_id that links reach; a text that is null or has no word has no
    shingle and links with nothing.  Rows that repeat a doc_id are one document, whose text is the smallest of theirs; they
    share its component and n_shingles.  A null doc_id links with nothing and has a null component.  An empty table gives
    no rows; further columns are not read.  Ids are whole numbers, of any type that can be cast to long, and come back as such.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    known = docs.where(F.col("doc_id").isNotNull())
    if known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return _near_duplicates(docs)
    single = _near_duplicates(known.groupBy("doc_id").agg(F.min("text").alias("text")))
    return known.select("doc_id").join(single, "doc_id").unionByName(_near_duplicates(docs.where(F.col("doc_id").isNull())))


def _near_duplicates(docs: DataFrame) -> DataFrame:
    """The same for documents none of which shares its doc_id with another."""
    all_sketches = stored(sketch(docs), "sketches")
    known = all_sketches.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = stored(known.groupBy("print", "n_shingles").agg(F.min("doc_id").alias("rep")), "set-classes")
    reps = stored(known.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"), "representatives")
    labels = _linked(reps, docs.where(F.col("doc_id").isNotNull()))

    by_class = classes.join(labels, F.col("rep") == F.col("node"), "left").select("print", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    found = known.select("doc_id", "print", "n_shingles").join(by_class, ["print", "n_shingles"]).select("doc_id", "n_shingles", "component_id")
    alone = all_sketches.where(F.col("doc_id").isNull() | (F.col("n_shingles") == 0)).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest of its group; a repeated row stays once per repetition."""
    gone = stored(near_duplicates(docs).where("not kept").select("doc_id").distinct(), "near-duplicates")
    return excluding(docs, "doc_id", gone)
