"""Tokenizer alignment against encoding whole texts, and its edge rows."""

import hashlib
import os
from collections import Counter

import pytest

from pertgrid.llm import tokenizer_alignment as op

P = pytest.importorskip("public_tokenizers")
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


def decoded_a(tokenizer):
    """Bytes of A's entries, by the rule of byte-level vocabularies."""
    table, n = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            table[chr(b)] = b
        else:
            table[chr(256 + n)] = b
            n += 1
    return {k: bytes(table[c] for c in t) for t, k in tokenizer.get_vocab().items() if all(c in table for c in t)}


def brute(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    ta, tb = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    ta.encode_special_tokens = True
    entries = decoded_a(ta)
    aligned, counts = [], Counter()
    for _, text in rows:
        groups = []
        if text:
            a, b = ta.encode(" " + text, add_special_tokens=False).ids, tb.encode(text)
            xs = [entries[k] for k in a]
            ys = [bytes([int(tb.id_to_piece(k)[3:5], 16)]) if tb.is_byte(k) else tb.id_to_piece(k).replace("▁", " ").encode() for k in b]
            if b"".join(xs) == (" " + text).encode() == b"".join(ys):
                ends = [set(), set()]
                for side, parts in zip(ends, (xs, ys)):
                    at = 0
                    for x in parts:
                        at += len(x)
                        side.add(at)
                i = j = at_a = at_b = 0
                for end in sorted(ends[0] & ends[1]):
                    group = ([], [])
                    while at_a < end:
                        at_a += len(xs[i])
                        group[0].append(a[i])
                        i += 1
                    while at_b < end:
                        at_b += len(ys[j])
                        group[1].append(b[j])
                        j += 1
                    groups.append(group)
        aligned.append(groups)
        counts.update({(x, y) for g in groups for x in g[0] for y in g[1]})
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for (d, _), groups in zip(rows, aligned):
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((
            d, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links),
            sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
TEXTS = [
    None, "", " ", "   ", "\n", "hello world", "hello  world\n\n  next line\r\nwin;\r x", " leading", "trailing \t", "it's don't WE'LL  'tis 's", "<|endoftext|> <s> </s> <unk> <0x0A> [INST]",
    "a b    c　 d   e\x85 f", "U+2581 ▁ stays out ▁x", "日本語のテキスト と 한국어 עברית", "é combining ́ alone  ﬁ Ａ", "\x00 nul \x1c\x1d \x1f x\x0b\x0c\n y", "🙂🙂 emoji👩‍👩‍👧 z",
    "x" * 3000, "1234567890 12,345.67 1.2.3", "tab\tsep\t\tcols \t mixed", "The same words the same words", "The same words the same words", "a  b   c    d     e", ";\r}\r)\r\n", "́ start",
]


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_equals_whole_texts(spark):
    rows = list(enumerate(TEXTS)) + [(5, "hello world"), (5, "another text"), (None, "hello there")]
    docs = spark.createDataFrame([(d, t, "clash", "clash") for d, t in rows], "doc_id long, text string, groups string, block string").repartition(3)
    assert found(op.align(docs, A, B)) == brute(rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query_equals_whole_texts(spark, monkeypatch):
    from pertgrid.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert found(QUERIES["op13_tokenizer_alignment"](spark, SF)) == brute(rows)


def test_blocks_and_chunks_leave_no_trace(spark, monkeypatch):
    rows = [(k, f"{TEXTS[k % len(TEXTS)] or ''} word{k % 7} in row {k}") for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    monkeypatch.setattr(op, "BLOCK_CHARS", 200)
    assert op.blocks(docs, op.Pair.of(A, B).cuts).count() > 10
    assert found(op.align(docs, A, B)) == brute(rows)
    links = op.Links([b"1|2;3,4|5", b"3|5", b"1,2|7,8;1|2"])
    places, ends = op.np.array([0, 1, 1, 2, 0, 2, 1]), op.np.array([2, 2, 5, 6, 7])
    whole = op._pair_documents(places, ends, links)
    assert dict(zip(zip(links.pair_a.tolist(), links.pair_b.tolist()), whole.tolist())) == {(1, 2): 3, (3, 5): 3, (4, 5): 2, (1, 7): 2, (1, 8): 2, (2, 7): 2, (2, 8): 2}
    monkeypatch.setattr(op, "CHUNK", 1)
    assert op._pair_documents(places, ends, links).tolist() == whole.tolist()


def test_cuts_are_where_no_entry_crosses():
    pair = op.Pair.of(A, B)
    assert " " in pair.cuts and "\n" in pair.cuts and "\r" not in pair.cuts
    cut = op.Cutter(pair.cuts)
    for text in TEXTS:
        if text:
            assert "".join(cut(" " + text)) == " " + text
            whole = pair.a.encode(" " + text, add_special_tokens=False).ids
            assert [k for s in cut(" " + text) for k in pair.a.encode(s, add_special_tokens=False).ids] == whole
            assert [k for s in cut(" " + text) for k in pair.b.encode(s)] == pair.b.encode(" " + text)


@pytest.mark.parametrize("kind", ["int", "string"])
def test_types_of_doc_id(spark, kind):
    docs = spark.createDataFrame([(k, "some words here") for k in range(3)], "doc_id long, text string").selectExpr(f"CAST(doc_id AS {kind}) AS doc_id", "text")
    out = op.align(docs, A, B)
    assert dict(out.dtypes)["doc_id"] == kind and len(out.collect()) == 3


def test_empty_tables(spark):
    assert op.align(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert found(op.align(docs, A, B)) == brute([(1, None), (2, "")])
