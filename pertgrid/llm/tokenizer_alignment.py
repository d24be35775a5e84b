"""Alignment of two tokenizers' tokens with deduplicated segments.

Neither vocabulary has an entry in which certain white space follows another character (``Pair`` looks through both for it),
so no merge crosses the place before such white space, and a text may be cut there: each segment's tokens are the text's.  Tasks
cut their documents into segments and store them as blocks: the documents as numbers of segments, and the block's distinct
segments.  One shuffle brings equal segments of all blocks together and sorts them; each distinct one is tokenised and aligned
once, and its alignment goes back to the blocks that hold it, where documents are composed.  Each block also counts, for
every linked pair of ids, its documents that hold the pair; the sums over all blocks are joined back to them.  Every shuffled
row is a distinct segment or pair of a block, so words and pairs that are frequent in the corpus have no more rows than there
are blocks.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructType

from .common import bounded_batches, released, stored

#: Characters of text after which a block is closed; a document is never cut.
BLOCK_CHARS = 16 << 20
#: Segments of a block whose documents' pairs are looked at together.
CHUNK = 1 << 17
#: Segments whose groups are parsed at a time.
PARSED = 1 << 15
#: Aligned segments that a task gathers by block before it hands them on.
GATHERED = 1 << 18
_SPACES = "\t\n\x0b\x0c\r "


def _byte_characters() -> dict[str, int]:
    """The characters by which byte-level vocabularies write the 256 bytes: printable ones as they are, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Cutter:
    """Cuts texts before each run of white space that begins with a character of ``cuts`` and follows another character."""

    def __init__(self, cuts: str):
        self._no_cut = re.compile(rf"[^\S{re.escape(cuts)}]") if cuts else re.compile(r"\s")
        self._cut = re.compile(rf"(?<=\S)(?=[{re.escape(cuts)}])") if cuts else re.compile(r"(?!)")
        self._run = re.compile(r"\s*\S+|\s+")

    def __call__(self, text: str) -> list[str]:
        return self._cut.split(text) if self._no_cut.search(text) else self._run.findall(text)


class Pair:
    """Both tokenizers: A from a file of the tokenizers library, byte-level; B a sentencepiece model, which adds a space."""

    _of: dict[tuple[str, str], Pair] = {}

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        whole = sentencepiece.SentencePieceProcessor(model_file=b_path)
        # a further normalizer_spec that sets add_dummy_prefix to false: messages of one field are merged
        self.b = sentencepiece.SentencePieceProcessor(model_proto=whole.serialized_model_proto() + b"\x1a\x02\x18\x00")
        of_byte = _byte_characters()
        self.a_bytes: list[bytes] = [b""] * self.a.get_vocab_size()
        for token, k in self.a.get_vocab().items():
            self.a_bytes[k] = bytes(of_byte[c] for c in token) if all(c in of_byte for c in token) else token.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        entries = [x.decode(errors="replace") for x in self.a_bytes + self.b_bytes]
        #: The white space that follows another character in no entry of either vocabulary.
        self.cuts = "".join(c for c in _SPACES if not any(re.search(rf"\S{re.escape(c)}", x) for x in entries))

    @classmethod
    def of(cls, a_path: str, b_path: str) -> Pair:
        key = a_path, b_path
        return cls._of.get(key) or cls._of.setdefault(key, cls(*key))

    def groups(self, segments: list[str]) -> list[str | None]:
        """Each segment's groups as ``a1,a2|b1;a3|b2,b3``; None where the tokens' bytes are not the segment's."""
        a = [x.ids for x in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        b = self.b.encode(segments, num_threads=1)
        a_bytes, b_bytes = self.a_bytes, self.b_bytes
        raw = [s.encode() for s in segments]
        fits = [bool(r) and b"".join([a_bytes[k] for k in x]) == r == b"".join([b_bytes[k] for k in y]) for r, x, y in zip(raw, a, b, strict=True)]
        good = [k for k, f in enumerate(fits) if f]
        out: list[str | None] = [None] * len(segments)
        if good:
            for k, text in zip(good, self._written([a[k] for k in good], [b[k] for k in good]), strict=True):
                out[k] = text
        return out

    def _written(self, a: list[list[int]], b: list[list[int]]) -> list[str]:
        ids = [np.array([k for x in side for k in x], np.int64) for side in (a, b)]
        last = np.cumsum([len(x) for x in a]) - 1  # each segment's last token of A
        ends = [np.cumsum(sizes[x]) for sizes, x in zip((self.a_sizes, self.b_sizes), ids, strict=True)]
        both = ends[0][np.isin(ends[0], ends[1], assume_unique=True)]
        group = [np.searchsorted(both, e) for e in ends]
        every, of, side = np.concatenate(ids), np.concatenate(group), np.repeat([0, 1], [len(ids[0]), len(ids[1])])
        order = np.argsort(2 * of + side, kind="stable")
        every, of, side = every[order], of[order], side[order]
        closes = np.zeros(len(both), bool)
        closes[group[0][last]] = True
        behind = np.full(len(every), ",")
        turn, done = np.append(of[1:] == of[:-1], False) & np.append(side[1:] != side[:-1], False), np.append(of[1:] != of[:-1], True)
        behind[turn], behind[done] = "|", np.where(closes[of[done]], "\n", ";")
        parts: list[str] = [""] * (2 * len(every))
        parts[0::2], parts[1::2] = map(str, every.tolist()), behind.tolist()
        return "".join(parts[:-1]).split("\n")


def _parsed(groups: list[bytes]) -> list[np.ndarray]:
    """n_a, n_b, n_groups and n_links of each segment, and all links in order as A's id times 2 ** 32 plus B's."""
    text = b"\n".join(groups) + b"\n"
    raw = np.frombuffer(text, np.uint8)
    behind = raw[(raw < 48) | (raw > 57)]
    number = np.array(re.sub(rb"\D", b" ", text).split(), np.int64)
    closed = (behind == 59) | (behind == 10)
    before = np.concatenate([[0], np.cumsum(closed)])
    of = before[:-1]
    side = np.concatenate([[0], np.cumsum(behind == 124)])[:-1] - of
    segment = np.concatenate([[0], np.cumsum(behind == 10)])[:-1]
    n, n_groups = len(groups), int(before[-1])
    a_at, b_at = np.nonzero(side == 0)[0], np.nonzero(side == 1)[0]
    per_group = np.bincount(of[b_at], minlength=n_groups)
    first = np.cumsum(per_group) - per_group
    times = per_group[of[a_at]]  # links of each token of A
    links = np.repeat(number[a_at], times) << 32 | number[b_at][_expanded(first[of[a_at]], times)]
    counts = [np.bincount(x, minlength=n) for x in (segment[a_at], segment[b_at], segment[closed], np.repeat(segment[a_at], times))]
    return [*counts, links]


class Links:
    """Of segments, from their groups as written by ``Pair.groups``: numbers per segment, the distinct pairs, and every link's pair."""

    def __init__(self, groups: list[bytes]):
        parts = [_parsed(groups[k : k + PARSED]) for k in range(0, len(groups), PARSED)]
        self.n_a, self.n_b, self.n_groups, self.n_links, links = (np.concatenate([np.empty(0, np.int64), *x]) for x in (zip(*parts) if parts else [()] * 5))
        self.ends = np.cumsum(self.n_links)
        pairs, self.pair = np.unique(links, return_inverse=True)
        self.pair_a, self.pair_b = pairs >> 32, pairs & 0xFFFFFFFF


def _packed(x: np.ndarray) -> bytes:
    """Numbers below 2 ** 32: their first bytes, then their second, and so on, compressed."""
    import zstandard

    planes = np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the stretches of ``values`` that end at ``ends``."""
    upto = np.concatenate([[0], np.cumsum(values)])[np.concatenate([[0], ends])]
    return np.diff(upto)


def _expanded(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all stretches, one after the other."""
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))


def blocks(docs: DataFrame, cuts: str) -> DataFrame:
    """The documents as blocks: block, doc_ids, ends (where each ends in ``places``), places (packed numbers of segments), segments (distinct)."""
    bounded_batches(docs.sparkSession)
    schema = StructType().add("block", LongType()).add("doc_ids", ArrayType(docs.schema["doc_id"].dataType)).add("ends", ArrayType(LongType())).add("places", BinaryType()).add("segments", ArrayType(StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, part, n_blocks = Cutter(cuts), TaskContext.get().partitionId(), 0
        ids: list[pa.Array] = []
        known: dict[str, int] = {}
        places: list[np.ndarray] = []
        sizes: list[int] = []
        chars = 0

        def closed() -> pa.RecordBatch:
            held = pa.concat_arrays(ids)
            ends = np.cumsum(sizes, dtype=np.int64)
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            return pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | n_blocks], pa.int64()), one(held), one(pa.array(ends)), pa.array([_packed(np.concatenate(places))], pa.binary()), one(pa.array(list(known), pa.string()))],
                names=schema.names,
            )

        for batch in batches:
            start = 0
            for k, t in enumerate(batch.column(1)):
                text = t.as_py()
                found = cut(" " + text) if text else []
                places.append(np.fromiter((known.setdefault(s, len(known)) for s in found), np.uint32, len(found)))
                sizes.append(len(found))
                chars += len(text or "")
                if chars >= BLOCK_CHARS:
                    ids.append(batch.column(0).slice(start, k + 1 - start))
                    yield closed()
                    ids, known, places, sizes, chars, n_blocks, start = [], {}, [], [], 0, n_blocks + 1, k + 1
            if start < batch.num_rows:
                ids.append(batch.column(0).slice(start))
        if sizes:
            yield closed()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def aligned_segments(held: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The groups of each row of ``held`` (segment, block, number), gathered by block: block, numbers (packed), groups (compressed
    lines, empty where a tokenizer does not give the segment's bytes back).  Equal segments come one after the other, so each
    distinct one is tokenised and aligned once."""
    import zstandard

    def gathered(parts: list[tuple[np.ndarray, np.ndarray, list[bytes]]]) -> pa.RecordBatch:
        block, number = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        groups = [g for p in parts for g in p[2]]
        order = np.lexsort((number, block))
        starts = np.nonzero(np.diff(block[order], prepend=block[order[0]] - 1))[0]
        rows = [order[a:b] for a, b in zip(starts, [*starts[1:], len(order)], strict=True)]
        pack = zstandard.ZstdCompressor(level=3).compress
        columns = [pa.array([block[r[0]] for r in rows], pa.int64()), pa.array([_packed(number[r]) for r in rows], pa.binary()), pa.array([pack(b"\n".join([groups[k] for k in r])) for r in rows], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["block", "numbers", "groups"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, last, known = Pair.of(a_path, b_path), None, None
        parts, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column("segment").dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            fresh = distinct[1:] if distinct[0] == last else distinct
            groups = ([known] if len(fresh) < len(distinct) else []) + [(g or "").encode() for g in (pair.groups(fresh) if fresh else [])]
            last, known = distinct[-1], groups[-1]
            parts.append((batch.column("block").to_numpy(), batch.column("number").to_numpy(), [groups[k] for k in coded.indices.to_pylist()]))
            n += batch.num_rows
            if n >= GATHERED:
                yield gathered(parts)
                parts, n = [], 0
        if parts:
            yield gathered(parts)
        Pair._of.clear()  # the worker lives on, and has other tasks that need the memory

    together = held.select("segment", "block", "number").repartition("segment").sortWithinPartitions("segment")
    return together.mapInArrow(run, "block long, numbers binary, groups binary")


def _pair_documents(places: np.ndarray, ends: np.ndarray, links: Links) -> np.ndarray:
    """For each pair, the number of documents that hold it."""
    out, n_pairs = np.zeros(len(links.pair_a), np.int64), len(links.pair_a)
    document = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    starts, at = links.ends - links.n_links, 0
    while at < len(places):
        upto = int(ends[np.searchsorted(ends, min(len(places), at + CHUNK))])  # whole documents
        met = np.unique(document[at:upto] * len(links.ends) + places[at:upto])
        doc, segment = np.divmod(met, len(links.ends))
        n = links.n_links[segment]
        pair = links.pair[_expanded(starts[segment], n)]
        out += np.bincount(np.unique(np.repeat(doc, n) * n_pairs + pair) % n_pairs, minlength=n_pairs)
        at = upto
    return out


def composed(joined: DataFrame) -> DataFrame:
    """A row per block of ``joined`` (a block of ``blocks`` with ``found``: numbers and groups of its segments): its documents' numbers and
    digests, its places without those of documents that have no tokens, its links, and its pairs with their documents."""
    counts = ["n_a", "n_b", "n_groups", "n_links"]
    schema = StructType().add("block", LongType()).add("doc_ids", joined.schema["doc_ids"].dataType)
    for name in counts:
        schema = schema.add(name, ArrayType(LongType()))
    schema = schema.add("digests", ArrayType(StringType())).add("ends", ArrayType(LongType())).add("places", BinaryType()).add("link_ends", BinaryType()).add("link_pairs", BinaryType())
    for name in ("pair_a", "pair_b", "pair_docs"):
        schema = schema.add(name, ArrayType(IntegerType()))

    kinds = [to_arrow_type(f.dataType) for f in schema.fields[2:]]

    def of_block(ends: np.ndarray, places: np.ndarray, number: np.ndarray, groups: list[bytes]) -> list[object]:
        given = [k for k, g in enumerate(groups) if g]
        links = Links([groups[k] for k in given])
        at, texts = np.full(len(groups), -1), [b""] * len(given)  # each number's place among the segments that have groups
        for n, k in enumerate(given):
            at[number[k]], texts[n] = n, groups[k]
        places = at[places]
        whole = (_sums((places < 0).astype(np.int64), ends) == 0) & (np.diff(ends, prepend=0) > 0)
        places = places[np.repeat(whole, np.diff(ends, prepend=0))]
        ends = np.cumsum(np.where(whole, np.diff(ends, prepend=0), 0))
        sums = [_sums(x[places], ends) for x in (links.n_a, links.n_b, links.n_groups, links.n_links)]
        digests, start = [], 0
        for end, ok in zip(ends.tolist(), whole.tolist(), strict=True):
            digests.append(hashlib.sha256(b";".join([texts[k] for k in places[start:end].tolist()])).hexdigest() if ok else "")
            start = end
        return [*sums, digests, ends, _packed(places), _packed(links.ends), _packed(links.pair), *(x.astype(np.int32) for x in (links.pair_a, links.pair_b, _pair_documents(places, ends, links)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            block, ids, ends, places, found = (batch.column(name) for name in ("block", "doc_ids", "ends", "places", "found"))
            for k in range(batch.num_rows):
                number, groups = [np.empty(0, np.int64)], []
                for part in found[k].as_py() or []:  # None without a segment
                    number.append(_unpacked(part["numbers"]))
                    groups += unpack(part["groups"]).split(b"\n")
                row = of_block(ends[k].values.to_numpy(), _unpacked(places[k].as_py()), np.concatenate(number), groups)
                yield pa.RecordBatch.from_arrays(
                    [block.slice(k, 1), ids.slice(k, 1), *(pa.array([x], kind) for x, kind in zip(row, kinds, strict=True))],
                    names=schema.names,
                )

    return joined.select("block", "doc_ids", "ends", "places", "found").mapInArrow(run, schema)


def _with_counts(joined: DataFrame) -> DataFrame:
    """The documents of ``joined`` (a row of ``composed`` with ``met``: number, n and best of its pairs), with the sums over their links."""
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    schema = StructType().add("doc_id", joined.schema["doc_ids"].dataType.elementType)
    for name in names:
        schema = schema.add(name, LongType())
    schema = schema.add("groups_sha256", StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in batch.schema.names}
                ends, places = row["ends"].values.to_numpy(), _unpacked(row["places"].as_py())
                link_ends, pair = _unpacked(row["link_ends"].as_py()), _unpacked(row["link_pairs"].as_py())
                met = row["met"].values  # None without a pair
                n, best = np.zeros((2, len(met) if met is not None else 0), np.int64)
                if met is not None:
                    number = met.field("number").to_numpy()
                    n[number], best[number] = met.field("n").to_numpy(), met.field("best").to_numpy(zero_copy_only=False)
                sums = [_sums(_sums(x[pair], link_ends)[places], ends) for x in (best, n)]
                columns = [row["doc_ids"].values, *(row[name].values for name in names[:4]), *map(pa.array, sums), row["digests"].values]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    needed = ["doc_ids", *names[:4], "digests", "ends", "places", "link_ends", "link_pairs", "met"]
    return joined.select(needed).mapInArrow(run, schema)


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Tokens are those of a space and the text, special tokens' strings being plain text.  Byte offsets where tokens of both end
    cut them into groups; all pairs of an A and a B token of one group are linked.  A pair's count is the number of documents
    that hold it linked; ``n_best`` are the links whose count is the largest of their A id, ``count_sum`` adds the counts
    of all links.  A null or empty text, and one whose tokens' bytes are not those of a space and the text, has no tokens:
    zeros and an empty digest.  Rows that repeat a doc_id or a text count each.  An empty table gives no rows; doc_id may be of
    any type, and no column but it and text is read.  A document of any length is one part of one block.
    """
    cut = stored(blocks(docs, Pair.of(a_path, b_path).cuts), "alignment-blocks", compression="zstd")
    held = cut.select("block", F.posexplode("segments").alias("number", "segment"))
    found = aligned_segments(held, a_path, b_path).groupBy("block").agg(F.collect_list(F.struct("numbers", "groups")).alias("found"))
    whole = stored(composed(cut.drop("segments").join(found, "block", "left")), "alignment-composed", compression="zstd")
    released(cut)
    pairs = whole.select("block", F.posexplode(F.arrays_zip("pair_a", "pair_b", "pair_docs")).alias("number", "x")).select("block", "number", "x.*")
    counts = pairs.groupBy("pair_a", "pair_b").agg(F.sum("pair_docs").alias("n"))
    counts = counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("pair_a")))
    met = pairs.drop("pair_docs").join(counts, ["pair_a", "pair_b"]).groupBy("block").agg(F.collect_list(F.struct("number", "n", "best")).alias("met"))
    return _with_counts(whole.drop("pair_a", "pair_b", "pair_docs").join(met, "block", "left"))
