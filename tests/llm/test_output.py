import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pertgrid.llm import mixing, token_output, url_filter
from pertgrid.llm.queries import tokenizer_path


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 60_000), st.integers(0, 2**32 - 1)), min_size=0, max_size=300), max_size=6))
def test_segment_round_trip(docs):
    ids = np.array([x for d in docs for x in d], np.uint32)
    names = [None if k % 3 == 2 else -k for k in range(len(docs))]
    found, lengths, back = token_output.decode_segment(token_output.encode_segment(names, [len(d) for d in docs], ids))
    assert found == names and lengths.tolist() == [len(d) for d in docs] and back.tolist() == ids.tolist()


def test_segment_rejects_other_bytes():
    with pytest.raises(ValueError):
        token_output.decode_segment(b"\0" * 40)


def test_pieces_equal_the_tokenizer():
    encode = token_output.PieceEncoder.of(tokenizer_path())
    texts = ["", " ", "it's 'tis ''s don't --'s", "İx é a\u0301 x\x85y a\xa0b <|endoftext|> ²½ªº ſK ŉ Ŀ", "ΑΣ 中文", "'ſ 'S 'RE'lLx", "a\x1cb\u200d"]
    texts += [f"a{chr(c)}b {chr(c)}'s 1{chr(c)}2" for c in range(1, 0x250)]
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("limits", [(5, 1 << 20, 64), (1000, 40, 64), (1000, 1 << 20, 4), (0, 0, 0)])
def test_piece_cache_limits(monkeypatch, limits):
    for name, value in zip(("CACHE_PIECES", "CACHE_BYTES", "PIECE_CHARS"), limits, strict=True):
        monkeypatch.setattr(token_output, name, value)
    encode = token_output.PieceEncoder(tokenizer_path())
    for text in ("one two three", "four five six one", "one two seven eight nine ten eleven", "", "one one two one"):
        assert np.frombuffer(encode(text), "<u4").tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids
        assert len(encode.ids) <= limits[0] and sum(len(p) + len(x) for p, x in encode.ids.items()) == encode.held <= limits[1]


def test_other_tokenizers_get_whole_texts():
    import public_tokenizers

    encode = token_output.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not encode.known and token_output.PieceEncoder(tokenizer_path()).known
    for text in ("Two  Words it's", "ÉA x1", " lead\n", ""):
        assert np.frombuffer(encode(text), "<u4").tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


def test_token_files_round_trip(spark, monkeypatch):
    monkeypatch.setattr(token_output, "SEGMENT_TOKENS", 500)
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice(["the", "Éa", "x1", "quux", "\n"]) for _ in range(rng.randrange(0, 400))), "n") for k in rng.sample(range(1000), 80)] + [(2000, None, "n"), (2001, "", "n"), (2002, "word " * 30_000, "n")]
    got = token_output.token_output(spark.createDataFrame(rows, "doc_id long, text string, seq string"), tokenizer_path()).orderBy("doc_id").collect()
    tokenizer, start = token_output.PieceEncoder.of(tokenizer_path()).tokenizer, 0
    for r, (doc, text, _) in zip(got, sorted(rows), strict=True):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_files_edge_rows(spark):
    schema = "doc_id long, text string"
    assert token_output.token_output(spark.createDataFrame([], schema), tokenizer_path()).collect() == []
    got = token_output.token_output(spark.createDataFrame([(5, "b"), (None, "a"), (5, "a")], schema), tokenizer_path()).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(None, 0, 2), (5, 2, 2), (5, 4, 2)] and got[0].ids_crc32 == got[1].ids_crc32


def reshared(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        target = {s: 3 * sizes[s] if s in capped else rest * weight[s] / sum(weight[x] for x in free) for s in order}
        over = {s for s in free if target[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return target
        capped |= over


def test_mix_hits_its_targets(spark):
    rng = random.Random(9)
    names = ["src1", "src10", "src2", "Z", "é", "", None, "hot"]
    rows = [(k, " ".join(["w"] * rng.randrange(0, 60)), "hot" if k % 3 == 0 else rng.choice(names)) for k in range(3000)] + [(5000, None, "hot"), (5001, "", "only empty"), (5002, "w " * 9000, "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want, taken, largest = reshared(sizes), dict.fromkeys(sizes, 0), dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1, s
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    whole = mixing.mix(docs, rank_bins=1).collect()  # one bin: every source ordered as a whole
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in whole)


def test_mixed_documents_are_the_mix(spark):
    rng = random.Random(4)
    rows = [(k, "w " * rng.randrange(0, 30), rng.choice(["a", "b", None])) for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name in ("mix_copies", "copies", "row", "s", "copy", "size", "fine", "border", "importance", "extra"):
        docs = docs.withColumn(name, F.concat(F.lit(name), F.col("doc_id").cast("string")))
    for bins in (mixing.RANK_BINS, 1, 3):
        want = {r.doc_id: r.copies for r in mixing.mix(docs, rank_bins=bins).collect() if r.copies}
        mixed = mixing.mixed_documents(docs, rank_bins=bins)
        assert mixed.columns == docs.columns
        found = {}
        for r in mixed.collect():
            assert (r.text, r.source) == rows[r.doc_id][1:] and r.mix_copies == f"mix_copies{r.doc_id}" and r.row == f"row{r.doc_id}"
            found[r.doc_id] = found.get(r.doc_id, 0) + 1
        assert found == want


def test_mix_edge_rows(spark):
    schema = "doc_id long, text string, source string, size int, copies int, target string"
    assert mixing.mix(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, "a b", "s", 7, 7, "x"), (1, "a b", "s", 7, 7, "x"), (None, "a", None, 7, 7, "x"), (2, None, "s", 7, 7, "x")]
    docs = spark.createDataFrame(rows, schema)
    assert len(mixing.mix(docs).collect()) == 4
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and {r.text for r in mixed.collect()} <= {"a b", "a"}


def test_mix_with_importance(spark):
    rows = [(k, "w " * 10, "s", float(k % 2)) for k in range(200)] + [(1000 + k, "w " * 10, "t", 1.0) for k in range(200)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, value double"), importance="value").collect()
    assert all(r.taken == 0 for r in got if r.source == "s" and r.doc_id % 2 == 0)


URLS = [
    ("https://a.com/x?y#z", "a.com", "/x", "com/", "allow"),
    ("http://a.com", "a.com", "", None, "allow"),
    ("http://sub.EXAMPLE.com/en/1", "sub.example.com", "/en/1", "example.com/en/", "block"),
    ("http://www.example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("http://m.www.example.com/en/", "m.www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("http://badexample.com/en/", "badexample.com", "/en/", "com/", "allow"),
    ("x://a.net/es/#q", "a.net", "/es/", "net/es/", "block"),
    ("x://a.net?u=http://b.com/es/", "a.net", "", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("x://" + "a" * 100_000 + ".org/", "a" * 100_000 + ".org", "/", None, "allow"),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(k, u[0], "clash") for k, u in enumerate(URLS)], "page_id long, url string, domain string")
    labels = spark.createDataFrame([], "page_id long, bad int")
    got = {r.page_id: r for r in url_filter.judge(pages, labels).collect()}
    for k, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[k].host, got[k].path, got[k].rule, got[k].verdict) == (host, path, rule, verdict)
    assert url_filter.judge(pages.limit(0), labels).collect() == []


def test_url_reputation(spark):
    pages = [(k, f"http://{'spam' if k % 4 == 0 else f'h{k % 9}'}.site{k % 3}.org/p{k}") for k in range(1200)]
    bad = [(k, int(k % 4 == 0 or k % 50 == 1)) for k, _ in pages if k % 2 == 0 or k % 3 == 0] + [(3, None), (3, 0)]
    got = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(bad, "page_id long, bad int")).collect()
    assert len(got) == len(pages)
    assert all((r.verdict == "block") == r.host.startswith("spam") for r in got)
    assert all(r.lower < r.rate < 1 for r in got)


def test_url_of_unlabelled_hosts(spark):
    pages = [(k, f"http://h{k % 7}.{'worst.biz' if k % 2 else 'fine.org'}/p") for k in range(1400)]
    new = ["http://new.worst.biz/", "http://new.fine.org/", "http://new.other.biz/", "http://new.other.org/", "http://new.other.info/", "http://worst.biz:80/"]
    labels = [(k, k % 2) for k, _ in pages]
    frame = spark.createDataFrame(pages + [(5000 + k, u) for k, u in enumerate(new)], "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge(frame, spark.createDataFrame(labels, "page_id long, bad int")).collect()}
    assert len(got) == len(pages) + len(new)
    assert [got[5000 + k].verdict for k in range(6)] == ["block", "allow", "block", "allow", "block", "block"]
    assert got[5004].rate == pytest.approx(0.5)  # of all pages: neither domain nor suffix has labels
    assert all(got[k].verdict == ("block" if k % 2 else "allow") for k, _ in pages)


def test_joined_rules_are_the_literal_ones(spark, monkeypatch):
    some = [u[0] for u in URLS] + ["http://example.com./en/", "http://a.b.c.d.example.com/en/x", "http://example.com/e", "x://" + "a." * 20_000 + "net/es/"] + ["http://a.net/fr/"] * 3
    pages = spark.createDataFrame(list(enumerate(some)), "page_id long, url string")
    labels = spark.createDataFrame([], "page_id long, bad int")
    rules = [*url_filter.RULES, ("block", "", "/en/"), ("allow", "com", ""), ("block", "com", "/e"), ("block", "com", "/e")]
    want = sorted(map(tuple, url_filter.judge(pages, labels, rules).select("page_id", "host", "path", "rule", "verdict").collect()))
    monkeypatch.setattr(url_filter, "MAX_RULES", 3)
    got = url_filter.judge(pages, labels, rules).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, got)) == want
    table = spark.createDataFrame([], "verdict string, host string, path string")
    assert {(r.rule, r.verdict) for r in url_filter.judge(pages, labels, table).collect()} == {(None, "allow")}


def test_parents_of_hosts(spark):
    hosts = ["a.example.com", "x.y.co.uk", "co.uk", "127.0.0.1:80", "user@m.example.com:8080", "localhost", "", "foo.pages.dev", "a.b.c.kyoto.jp", "[::1]:80", "k" * 50_000 + ".org", "b." * 5_000 + "c.org"]
    frame = spark.createDataFrame([(h,) for h in hosts], "host string")
    plain = {r.host: (r.domain, r.suffix) for r in url_filter.with_parents(frame).collect()}
    assert plain["x.y.co.uk"] == ("y.co.uk", "co.uk") and plain["127.0.0.1:80"] == ("127.0.0.1", "") and plain["foo.pages.dev"] == ("pages.dev", "dev")
    suffixes = spark.createDataFrame([(x,) for x in ("com", "co.uk", "uk", "pages.dev", "dev", "c.kyoto.jp", None)], "suffix string")
    got = {r.host: (r.domain, r.suffix) for r in url_filter.with_parents(frame, suffixes).collect()}
    assert got == plain | {"foo.pages.dev": ("foo.pages.dev", "pages.dev"), "a.b.c.kyoto.jp": ("b.c.kyoto.jp", "c.kyoto.jp")}
    pages = spark.createDataFrame([(k, f"http://u{k}.pages.dev/") for k in range(9)], "page_id long, url string")
    assert len(url_filter.judge(pages, spark.createDataFrame([(1, 1)], "page_id long, bad int"), suffixes=suffixes).collect()) == 9


def test_pieces_met_again_are_not_encoded_again(monkeypatch):
    """A full cache keeps the pieces that texts still use."""
    monkeypatch.setattr(token_output, "CACHE_PIECES", 40)
    encode, asked = token_output.PieceEncoder(tokenizer_path()), []

    class Counting:
        def __init__(self, model):
            self.model = model

        def encode(self, text, **options):
            asked.extend(text.split())
            return self.model.encode(text, **options)

    encode.model = Counting(encode.model)
    for k in range(60):
        text = " ".join(["always", "here", *("abcdefghij"[k // 10] + "abcdefghij"[k % 10] + c for c in "xyz")])
        assert np.frombuffer(encode(text), "<u4").tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids
        assert len(encode.ids) + len(encode.older) <= 40
    assert asked.count("always") == asked.count("here") == 1
    many = [f"word{c} always" for c in "abcdefgh"]
    assert encode.encode(many) == [encode(t) for t in many]
