import hashlib
import random

from pyspark.sql import functions as F

from pertgrid.llm import exact_dedup, line_dedup, minhash

DOCS = "doc_id long, text string, source int"


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def brute_components(rows):
    sets = {}
    for doc, text in rows:
        w = (text or "").encode().lower().split()
        sets[doc] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d)) for d in sets}


def near_rows():
    rng = random.Random(3)
    rows, base = [], [prose(rng, rng.choice((3, 5, 40, 200, 900))) for _ in range(30)]
    for k in range(260):
        words = base[k % len(base)].split()
        for _ in range(rng.choice((0, 0, 1, 2, 6))):
            words[rng.randrange(len(words))] = f"x{rng.randrange(9)}"
        rows.append((k, (" " if k % 2 else "\n\t").join(words).upper() if k % 5 == 0 else " ".join(words)))
    shared = prose(rng, 60)
    rows += [(1000 + k, shared + " " + prose(rng, 15, 10**6)) for k in range(120)]  # a common passage, similarity near the threshold
    return rows + [(2000, None), (2001, ""), (2002, " \n"), (2003, "one"), (2004, "ONE"), (2005, "x" * 10**6)]


def test_near_duplicates_match_brute_force(spark):
    rows = near_rows()
    got = minhash.near_duplicates(spark.createDataFrame([(*r, 1) for r in rows], DOCS)).collect()
    want = brute_components(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)


def test_near_duplicates_in_large_open_buckets(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL_BUCKET", 4)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rows = near_rows()
    got = minhash.near_duplicates(spark.createDataFrame([(*r, 1) for r in rows], DOCS)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)


def test_near_duplicates_edge_rows(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []
    rows = [(1, "a b c d e f", 1), (1, "a b c d e f", 1), (None, "a b c d e f", 1), (2, "A b  c d e f", None)]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (None, None, True)], key=str)


def test_near_duplicates_of_repeated_ids_with_other_texts(spark):
    rows = [(1, "z y x w v u", 1), (1, "a b c d e f", 1), (1, None, 1), (2, "a b c d e f", 1), (3, "z y x w v u", 1), (None, None, 1)]
    want = [("1", 1, True), ("1", 1, True), ("1", 1, True), ("2", 1, False), ("3", 3, True), ("None", None, True)]
    for parts in (1, 6):
        got = minhash.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(parts)).collect()
        assert sorted(((str(r.doc_id), r.component_id, r.kept) for r in got), key=str) == want


def test_sketches_do_not_depend_on_their_parts(spark, monkeypatch):
    texts = [prose(random.Random(k), 10 + 37 * k) for k in range(40)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    want = sorted(map(tuple, minhash.sketch(docs).collect()))
    sets = [minhash.shingles(t) for t in texts]
    whole = minhash.sketches(sets)
    monkeypatch.setattr(minhash, "CHUNK", 64)
    assert (minhash.sketches(sets) == whole).all()
    monkeypatch.setattr(minhash, "TOGETHER", 500)
    parts = list(minhash._in_parts([docs.toArrow().to_batches()[0]]))
    assert len(parts) > 10 and sum(len(sets) for _, sets in parts) == 40
    assert sorted(map(tuple, minhash.sketch(docs).collect())) == want


def test_components_of_a_long_chain(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 101)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.component for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 61)}, 101: 100}


def test_exact_groups_match_brute_force(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice(["a b", "ab", " ab\n", "c", "", None, f"u{k}"]), k) for k in range(400)] + [(900 + k, "hot", 1) for k in range(300)]
    got = {r.doc_id: r for r in exact_dedup.exact_groups(spark.createDataFrame(rows, DOCS), support=0.05).collect()}
    groups = {}
    for doc, text, _ in rows:
        norm = "".join((text or "").split())
        groups.setdefault(norm, []).append((-len(text or ""), doc))
    assert len(got) == len(rows)
    for norm, members in groups.items():
        for _, doc in members:
            r = got[doc]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (min(members)[1], len(members), doc == min(members)[1], hashlib.sha256(norm.encode()).hexdigest())


def test_exact_groups_edge_rows(spark):
    assert exact_dedup.exact_groups(spark.createDataFrame([], DOCS)).collect() == []
    rows = [(None, "a", 1), (4, "a", 1), (4, "a", 1)]
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, DOCS)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got] == [(None, 4, 3, False), (4, 4, 3, True), (4, 4, 3, True)]


def brute_lines(rows, min_words):
    first, gone = {}, {}
    grams = []
    for doc, text in sorted(r for r in rows if r[1] is not None):
        lines = text.split("\n")
        for at in range(len(lines)):
            for size in (1, 2, 3):
                g = tuple(lines[at : at + size])
                if len(g) == size and (size == 3 or sum(len(x.split()) or 1 for x in g) >= min_words):
                    grams.append((doc, at, g))
                    first.setdefault(g, (doc, at))
    for doc, at, g in grams:
        d, p = first[g]
        if d != doc or at >= p + len(g):
            gone.setdefault(doc, set()).update(range(at, at + len(g)))
    return {d: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(d, ())) for d, t in rows}


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(8)
    pool = ["", "a", "b b", "c c c", prose(rng, 12), prose(rng, 13)]
    rows = [(k, "\n".join(rng.choice(pool) if rng.random() < 0.7 else prose(rng, 4) for _ in range(rng.randrange(1, 14)))) for k in range(150)]
    rows += [(500, None), (501, ""), (502, "\n".join(["r"] * 50)), (503, "z" * 200_000)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("lines", F.lit(2)), min_words=10)
    found = {r.doc_id: r for r in got.collect()}
    assert {d: r.text for d, r in found.items()} == brute_lines(rows, 10)
    assert found[500].n_lines == 0 and found[501].n_lines == 1 and found[502].text == "r\nr\nr" and found[502].n_removed == 47
    assert {"spans", "lines"} <= set(got.columns)


def test_line_dedup_edge_rows(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(None, "a\nb\nc"), (1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == [("1", "a\nb\nc"), ("1", "a\nb\nc"), ("2", ""), ("None", "a\nb\nc")]


def test_line_dedup_keeps_clashing_columns(spark):
    names = ["span_doc", "deleted_spans", "deleted_lines", "print", "start", "h", "n_lines"]
    docs = spark.createDataFrame([(1, "a\nb\nc"), (2, "x\na\nb\nc")], "doc_id long, text string").select("*", *[F.lit(n).alias(n) for n in names])
    got = line_dedup.dedup_lines(docs)
    assert got.columns == ["doc_id", "text", *names[:-1], "n_lines", "n_removed"]
    assert sorted(map(tuple, got.collect())) == [(1, "a\nb\nc", *names[:-1], 3, 0), (2, "x", *names[:-1], 4, 3)]


def test_windows_of_single_lines_stay_in_their_task(spark):
    rng = random.Random(2)
    rows = [(k, "\n".join(prose(rng, 5, 10**6) for _ in range(20))) for k in range(300)]
    rows += [(1000 + k, rows[k][1]) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert line_dedup._windows(docs, 50).selectExpr("sum(size(windows))").first()[0] == 305 * 18
    assert 2 * 5 * 18 <= line_dedup._candidates(docs, 50).count() < 2 * 5 * 18 + 400
