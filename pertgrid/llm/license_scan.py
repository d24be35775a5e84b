"""License scans: exact containment join between text blocks and license templates.

A document's words are cut into overlapping blocks.  A block matches a template when it contains at least
``CONTAINMENT`` of the template's distinct words.  Template words are ordered by their frequency in the whole
corpus, rarest first.  A match must hold a word of the template's prefix (as many rarest words as
may be absent, and one), so only blocks around such words are looked at; the length filter drops blocks with too few distinct
words, the positional filter those that hold too few template words from their first shared word on, in that order.
The survivors are verified, so the join is exact.  Blocks of a template are twice as long as the larger of it and ``BLOCK_STEP``
words, from half a block to the next, so every stretch of a template's length stands whole in some block.

Besides, fixed phrases are looked up as consecutive words.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

CONTAINMENT = 0.9
#: Words of a block, and words from one block's start to the next one's, at least: a longer template has longer ones.
BLOCK_WORDS, BLOCK_STEP = 48, 24
#: Templates are given to all tasks: more words than this are refused.
MAX_TEMPLATE_WORDS = 100_000
#: (phrase, label), fixed values.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: (template, label): usual forms of license notices.
TEMPLATES = (
    ("Licensed under the Apache License, Version 2.0", "apache-2.0"),
    ("Released under the MIT License", "mit"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd"),
    ("This work is licensed under the GNU General Public License, version 3", "gpl-3.0"),
    ("GNU Lesser General Public License", "lgpl"),
    ("GNU Affero General Public License", "agpl"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License", "mpl-2.0"),
    ("Licensed under CC BY-NC 4.0", "cc-by-nc-4.0"),
    ("Licensed under CC BY-SA 4.0", "cc-by-sa-4.0"),
    ("Licensed under a Creative Commons Attribution 4.0 International License", "cc-by-4.0"),
    ("This is free and unencumbered software released into the public domain", "unlicense"),
)
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8: runs of digits, letters a-z and characters above U+007F, A-Z in lower case."""
    return _WORD.findall((text or "").encode().lower())


def word_frequencies(docs: DataFrame, wanted: set[bytes]) -> dict[bytes, int]:
    """Occurrences of the ``wanted`` words in all texts; as many rows come to the driver as there are words wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(w for w in words(text.as_py()) if w in wanted)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    rows = docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r.word): r.n for r in rows}


class Scanner:
    """The two searches over one document's words."""

    def __init__(self, templates, phrases, frequency: dict[bytes, int], containment: float = CONTAINMENT):
        self.phrases = [(words(p), label) for p, label in phrases]
        vocabulary = {w for text, _ in templates for w in words(text)}
        self.rank = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
        self.templates, self.prefix = [], {}
        for text, label in templates:
            order = sorted(set(words(text)), key=self.rank.__getitem__)
            need = math.ceil(containment * len(order) - 1e-9)
            step = max(BLOCK_STEP, len(words(text)))
            start = order[: len(order) - need + 1]
            self.templates.append((set(order), start, need, label, step))
            for w in start:
                self.prefix.setdefault(w, []).append(len(self.templates) - 1)
        self.triggers = set(self.prefix) | {p[0] for p, _ in self.phrases}

    def _block(self, found: list[bytes], start: int, size: int) -> tuple[set[bytes], list[int], set[int]]:
        """Distinct words of a block, the ordered ranks of those that templates have, and templates already tried on it."""
        own = set(found[start : start + size])
        return own, sorted(self.rank[w] for w in own if w in self.rank), set()

    def scan(self, found: list[bytes]) -> tuple[list[tuple[int, str]], dict[str, float]]:
        """Places of the phrases with their labels, and labels of matched templates with their containment."""
        base, labels, near = [], {}, {}
        for at in [i for i, w in enumerate(found) if w in self.triggers]:
            w = found[at]
            for phrase, label in self.phrases:
                if phrase[0] == w and found[at : at + len(phrase)] == phrase:
                    base.append((at, label))
            for number in self.prefix.get(w, ()):
                members, prefix, need, label, step = self.templates[number]
                blocks = near.setdefault(step, {})
                for passed in [b for b in blocks if b < at // step - 1]:  # later words are in none of them
                    del blocks[passed]
                for block in range(max(0, at // step - 1), at // step + 1):
                    if block not in blocks:
                        blocks[block] = self._block(found, block * step, 2 * step)
                    own, ranks, tried = blocks[block]
                    if number in tried:
                        continue
                    tried.add(number)
                    if len(own) < need:  # length filter
                        continue
                    first = next(p for p in prefix if p in own)
                    if len(ranks) - bisect_left(ranks, self.rank[first]) < need:  # positional filter: what may be shared begins there
                        continue
                    if (shared := len(own & members)) >= need:
                        labels[label] = max(labels.get(label, 0.0), shared / len(members))
        return base, labels


def scan_licenses(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, containment: float = CONTAINMENT) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A null text is empty.  Labels are distinct, sorted and joined by commas, empty without any; first_word and
    last_word are null without a phrase.  ``score`` is 1 with a phrase, else the largest containment of a matched
    template, else 0.  Only doc_id, of any type, and text are read.
    """
    bounded_batches(docs.sparkSession)
    vocabulary = {w for text, _ in templates for w in words(text)}
    if sum(len(words(t)) for t, _ in templates) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates of more than {MAX_TEMPLATE_WORDS} words")
    frequency = word_frequencies(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases, frequency, containment)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                found = words(text.as_py())
                base, labels = scanner.scan(found)
                own = {label for _, label in base}
                places = [at for at, _ in base]
                rows.append((
                    len(found), len(base), min(places, default=None), max(places, default=None),
                    ",".join(sorted(own)), ",".join(sorted(own | set(labels))), 1.0 if base else max(labels.values(), default=0.0),
                ))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
