"""Token-id output in patched frame-of-reference blocks.

Documents are dealt to tasks by ranges of doc_id and encoded with a public tokenizer.  A task cuts its
documents into segments of about ``SEGMENT_TOKENS`` ids.  A segment is one binary file image: a header, the
table of its documents, the index of block starts, and blocks of 128 ids.  A block stores its minimum, the
differences packed at the width that ``PERCENTILE`` of them need, and a list of the exceptions (position and
full difference).  Segments are rows of a Parquet folder, numbered in ascending doc_id order, so that
Spark's committer makes the write atomic and a lost task is repeated alone.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, shared_folder

BLOCK = 128
#: Share of a block's differences that the packed width must hold.
PERCENTILE = 0.9
#: Ids after which a segment is closed; a document is never cut.
SEGMENT_TOKENS = 1 << 19
END_ID = 1
MAGIC = b"PFR1"
_HEADER = struct.Struct("<4sIIQ")
SEGMENT_SCHEMA = "part int, seq int, n_docs long, n_tokens long, image binary"

#: Memory of the distinct pieces whose ids a Python worker keeps: by number, at some 170 bytes each with the table, and by
#: the characters and bytes in them.  Longer pieces than the last number are not kept.  Half of it is for pieces met since the
#: last change of generations, half for those of the one before.
CACHE_PIECES, CACHE_BYTES, PIECE_CHARS = 240_000, 16 << 20, 64
#: Texts encoded together, and their characters, after which no more are added.
TEXTS, TEXT_CHARS = 64, 1 << 17
#: Texts of these characters alone are cut into pieces here.  For them normalisation changes nothing but
#: white space and case, one character at a time.  All other texts go to the tokenizer whole.
_PLAIN = re.compile("[\t\n\x0b\x0c\r\x20-\x7e\xa1-įı-ſ]*")
#: The parts of a tokenizer's file that make its cut (fixed values).  Texts of a tokenizer with others go to it whole.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTE_LEVEL]}
#: The same cut, for lower-case text of the characters above.
_LETTER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-ſ"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\\s{_LETTER}{_NUMBER}\xa0]+")


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, 128) values to (blocks, 16 * width) bytes: one stream of bits, the lowest first."""
    if width in (8, 16):
        return np.ascontiguousarray(values.astype(f"<u{width // 8}")).view(np.uint8).reshape(len(values), -1)
    eights = values.reshape(-1, 8).T.astype(np.uint64)
    out = np.zeros((width, eights.shape[1]), np.uint8)  # eight values fill ``width`` bytes
    for k in range(8):
        first, shift = divmod(k * width, 8)
        moved = eights[k] << np.uint64(shift)
        for b in range((shift + width + 7) // 8):
            out[first + b] |= (moved >> np.uint64(8 * b)).astype(np.uint8)
    return np.ascontiguousarray(out.T).reshape(len(values), -1)


def _unpack(packed: np.ndarray, width: int) -> np.ndarray:
    if width in (8, 16):
        return np.ascontiguousarray(packed).view(f"<u{width // 8}").astype(np.uint32)
    parts = np.ascontiguousarray(packed.reshape(-1, width).T)
    out = np.empty((8, parts.shape[1]), np.uint64)
    for k in range(8):
        first, shift = divmod(k * width, 8)
        x = parts[first].astype(np.uint64)
        for b in range(1, (shift + width + 7) // 8):
            x |= parts[first + b].astype(np.uint64) << np.uint64(8 * b)
        out[k] = (x >> np.uint64(shift)) & np.uint64((1 << width) - 1)
    return np.ascontiguousarray(out.T).astype(np.uint32).reshape(len(packed), BLOCK)


#: Bits that a number below 2 ** 16 needs.
_BITS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)


def _bits(x: np.ndarray) -> np.ndarray:
    high = x >> np.uint32(16)
    return np.where(high > 0, _BITS[high] + np.uint8(16), _BITS[x & np.uint32(0xFFFF)]) if high.any() else _BITS[x]


def encode_segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    n = len(ids)
    n_blocks = -(-n // BLOCK)
    padded = np.empty(n_blocks * BLOCK, np.uint32)
    padded[:n] = ids
    padded[n:] = ids[-1] if n else 0
    blocks = padded.reshape(n_blocks, BLOCK)
    base = blocks.min(axis=1) if n_blocks else np.empty(0, np.uint32)
    diff = blocks - base[:, None]
    place = int(PERCENTILE * BLOCK) - 1
    width = _bits(np.partition(diff, place, axis=1)[:, place]) if n_blocks else np.empty(0, np.uint8)
    out = diff >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    n_out = out.sum(axis=1)
    low = np.where(out, np.uint32(0), diff)
    packed: list[bytes] = [b""] * n_blocks
    for w in np.unique(width[width > 0]):
        rows = np.nonzero(width == w)[0]
        for k, x in zip(rows, _pack(low[rows], int(w)), strict=True):
            packed[k] = x.tobytes()
    places, outliers = np.nonzero(out)[1].astype(np.uint8), diff[out].astype("<u4")
    ends = np.cumsum(n_out)
    heads = np.zeros(n_blocks, np.dtype([("base", "<u4"), ("width", "u1"), ("out", "u1")]))
    heads["base"], heads["width"], heads["out"] = base, width, n_out
    parts: list[bytes] = []
    for k in range(n_blocks):
        s, e = ends[k] - n_out[k], ends[k]
        parts.append(heads[k].tobytes() + packed[k] + places[s:e].tobytes() + outliers[s:e].tobytes())
    starts = np.zeros(n_blocks + 1, "<u8")
    np.cumsum([len(p) for p in parts], out=starts[1:])
    known = np.array([d is not None for d in doc_ids], np.uint8)
    return b"".join([
        _HEADER.pack(MAGIC, len(doc_ids), n_blocks, n),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), known.tobytes(), np.array(lengths, "<u8").tobytes(), starts.tobytes(),
        *parts,
    ])


def decode_segment(image: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, their numbers of ids, and all ids of a segment."""
    magic, n_docs, n_blocks, n = _HEADER.unpack_from(image)
    if magic != MAGIC:
        raise ValueError(f"not a token segment: it starts with {magic!r}")
    at = _HEADER.size

    def read(kind: str, count: int) -> np.ndarray:
        nonlocal at
        x = np.frombuffer(image, kind, count, at)
        at += x.nbytes
        return x

    ids, known, lengths, starts = read("<i8", n_docs), read("u1", n_docs), read("<u8", n_docs), read("<u8", n_blocks + 1)
    body = np.frombuffer(image, np.uint8, offset=at)
    first = starts[:-1].astype(np.int64)
    head = body[first[:, None] + np.arange(6)] if n_blocks else np.empty((0, 6), np.uint8)
    base = np.ascontiguousarray(head[:, :4]).view("<u4").ravel()
    width, n_out = head[:, 4].astype(np.int64), head[:, 5].astype(np.int64)
    out = np.zeros((n_blocks, BLOCK), np.uint32)
    for w in np.unique(width[width > 0]):
        rows = np.nonzero(width == w)[0]
        out[rows] = _unpack(body[first[rows][:, None] + 6 + np.arange(16 * w)], int(w))
    total = int(n_out.sum())
    if total:
        row = np.repeat(np.arange(n_blocks), n_out)
        nth = np.arange(total) - np.repeat(np.cumsum(n_out) - n_out, n_out)
        place_at = (first + 6 + 16 * width)[row] + nth
        value_at = (first + 6 + 16 * width + n_out)[row] + 4 * nth
        out[row, body[place_at]] = np.ascontiguousarray(body[value_at[:, None] + np.arange(4)]).view("<u4").ravel()
    return [int(i) if k else None for i, k in zip(ids, known, strict=True)], lengths.astype(np.int64), (out + base[:, None]).ravel()[:n]


class PieceEncoder:
    """Ids of texts by the tokenizers library, as bytes; distinct pieces are encoded once, as far as the cache holds them.

    Pieces that are cut here go through the same model without its normaliser and with a cut at white space alone.  This
    holds for the tokenizers whose cut is the known one, without a prefix or other text of its own; all texts of others,
    and texts that may hold an added token, go to the library whole.
    """

    _of: dict[str, PieceEncoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.ids, self.older, self.held = Tokenizer.from_file(path), {}, {}, 0
        kind = json.loads(self.tokenizer.to_str())
        self.known = kind["normalizer"] == _NORMALIZER and kind["pre_tokenizer"] == _PRE_TOKENIZER
        self.known &= not kind["truncation"] and not kind["padding"] and all(t["content"].startswith("<|") for t in kind["added_tokens"])
        if self.known:
            bare = kind | {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, _BYTE_LEVEL]}}
            self.model = Tokenizer.from_str(json.dumps(bare))

    @classmethod
    def of(cls, path: str) -> PieceEncoder:
        return cls._of.get(path) or cls._of.setdefault(path, cls(path))

    def __call__(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.encode([text])[0]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; pieces that are new to the texts go through the model together."""
        cut = [_PIECE.findall(t.lower()) if self.known and "<|" not in t and _PLAIN.fullmatch(t) else None for t in texts]
        new = set().union(*filter(None, cut)).difference(self.ids)
        own = {p: self.older[p] for p in new if p in self.older}
        missing = list(new.difference(own))
        if missing:
            # with white space between them the pieces stay the pieces of this one text
            found = self.model.encode(" ".join(missing), add_special_tokens=False)
            raw = np.array(found.ids, "<u4").tobytes()
            ends = (4 * np.cumsum(np.bincount(np.array(found.word_ids, np.int64), minlength=len(missing)))).tolist()
            own.update((p, raw[start:end]) for p, start, end in zip(missing, [0, *ends], ends, strict=False))
        self.ids.update(own)
        of = self.ids.__getitem__
        out = [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if p is None else b"".join(map(of, p)) for t, p in zip(texts, cut, strict=True)]
        self._keep(own)
        return out

    def _keep(self, own: dict[str, bytes]) -> None:
        """Keeps the new pieces, or takes them out again; a full generation becomes the older one."""
        kept = {p: x for p, x in own.items() if len(p) <= PIECE_CHARS}
        size = sum(len(p) + len(x) for p, x in kept.items())
        full = len(self.ids) - len(own) + len(kept) > CACHE_PIECES // 2 or self.held + size > CACHE_BYTES // 2
        if full or len(kept) < len(own):
            for p in own if full else own.keys() - kept.keys():
                del self.ids[p]
        if full:
            fits = len(kept) <= CACHE_PIECES // 2 and size <= CACHE_BYTES // 2
            self.older, self.ids, self.held = self.ids, kept if fits else {}, size if fits else 0
        else:
            self.held += size


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str) -> None:
    """Writes the segments of ``docs`` (doc_id, text) to the folder ``path``.

    Null texts count as empty: they consist of the end id alone.  Null ids come first; rows that repeat a
    doc_id follow each other, ordered by their text.  An empty table makes a folder without segments.
    """

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, part, seq = PieceEncoder.of(tokenizer_path).encode, TaskContext.get().partitionId(), 0
        ids, lengths, parts, total, end = [], [], [], 0, END_ID.to_bytes(4, "little")

        def encoded() -> Iterator[tuple[int | None, bytes]]:
            for batch in batches:
                names, texts, chars = [], [], 0
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    names.append(doc_id)
                    texts.append(text.as_py() or "")
                    chars += len(texts[-1])
                    if len(texts) >= TEXTS or chars >= TEXT_CHARS:
                        yield from zip(names, encode(texts), strict=True)
                        names, texts, chars = [], [], 0
                yield from zip(names, encode(texts), strict=True)

        def closed() -> pa.RecordBatch:
            image = encode_segment(ids, lengths, np.frombuffer(b"".join(parts), "<u4"))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([total], pa.int64()), pa.array([image], pa.binary())],
                names=["part", "seq", "n_docs", "n_tokens", "image"],
            )

        for doc_id, x in encoded():
            n = len(x) // 4 + 1
            ids.append(doc_id)
            lengths.append(n)
            parts += (x, end)
            total += n
            if total >= SEGMENT_TOKENS:
                yield closed()
                ids, lengths, parts, total, seq = [], [], [], 0, seq + 1
        if ids:
            yield closed()

    bounded_batches(docs.sparkSession)
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(segments, SEGMENT_SCHEMA).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the folder: doc_id, start, n_tokens, ids_crc32."""
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    sizes = segments.select("part", "seq", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row per task of the write
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    within = Window.partitionBy("part").orderBy("seq")
    starts = sizes.join(parts, "part").select("part", "seq", (F.col("part_start") + F.sum("n_tokens").over(within) - F.col("n_tokens")).alias("segment_start"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, image in zip(*(batch.column(k) for k in range(3)), strict=True):
                ids, lengths, tokens = decode_segment(image.as_py())
                ends = np.cumsum(lengths)
                raw = memoryview(tokens.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                k = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.as_py()] * k, pa.int32()), pa.array([seq.as_py()] * k, pa.int32()), pa.array(ids, pa.int64()), pa.array(ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())],
                    names=["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    read = segments.select("part", "seq", "image").mapInArrow(documents, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return read.join(starts, ["part", "seq"]).select("doc_id", (F.col("segment_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer_path: str, path: str | None = None) -> DataFrame:
    """Writes ``docs`` and returns what ``read_tokens`` finds in the files; ``path`` defaults to a new folder below
    the shared one."""
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, tokenizer_path, path)
    return read_tokens(spark, path)
