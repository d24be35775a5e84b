"""Quality rules against a plain Python version, and their edge rows."""

import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pertgrid.llm import common
from pertgrid.llm import quality_rules as q

BUCKETS = 256
SCHEMA = "doc_id long, text string, score string, w string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def features(text):
    w = words(text)
    return [zlib.crc32(f.encode()) % BUCKETS for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def brute(rows, trusted):
    s, t = Counter(), Counter()
    for doc_id, text in rows:
        s.update(features(text))
        if doc_id in trusted:
            t.update(features(text))
    total, target = sum(s.values()), sum(t.values())
    out = []
    for doc_id, text in rows:
        w = words(text)
        windows = Counter(zip(*[w[k:] for k in range(5)]))
        covered = {i + k for i, x in enumerate(zip(*[w[k:] for k in range(5)])) if windows[x] > 1 for k in range(5)}
        lines = [x for x in (text or "").split("\n") if words(x)]
        gains = [math.floor(1000 * math.log((t[b] * total + q.SMOOTHING * target) / ((s[b] + q.SMOOTHING) * target))) if target else 0 for b in features(text)]
        score = math.floor(sum(gains) / (len(gains) + q.PRIOR))
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        out.append((doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed, score, not failed and score >= q.MIN_SCORE))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
GOOD = "the river runs past the old mill and the children watch it from the bridge every day in spring"
TEXTS = [
    None, "", " \t\n\x0b\x0c\r", "one", GOOD, GOOD, GOOD.replace("river", "brook"), "a b c d e a b c d e a b c d e f g h", "\n".join(["same line here"] * 4 + ["", " ", ""]),
    "x &&& y ### z $$$ " * 5, " lead and trail  two  spaces ", "é ü   ß " * 4, "a a a a a a a", "w1 w2 w3 w4 w5 w6 w1 w2 w3 w4 w5", " ".join(f"v{k % 97}" for k in range(6000)), "x" * 70000,
]


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_counts_and_scores_equal_brute_force(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, GOOD), (4, GOOD), (4, "another text of the same id")]
    docs = spark.createDataFrame([(d, t, "clash", "clash") for d, t in rows], SCHEMA)
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, 0), (6, 1, 0), (9, 0, 0), (7, 1, 1), (8, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = found(q.judge(docs, labels, buckets=BUCKETS))
    assert got == brute(rows, {4, 6})
    assert {r[0]: r[-1] for r in got if r[0] not in (None, 4)}[5]


@pytest.mark.parametrize("kind", ["int", "string"])
def test_types_of_doc_id(spark, kind):
    docs = spark.createDataFrame([(k, GOOD) for k in range(3)], "doc_id long, text string").selectExpr(f"CAST(doc_id AS {kind}) AS doc_id", "text")
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").selectExpr(f"CAST(doc_id AS {kind}) AS doc_id", "quality", "toxic")
    out = q.judge(docs, labels, buckets=BUCKETS)
    assert dict(out.dtypes)["doc_id"] == kind and [r.kept for r in out.collect()] == [True] * 3


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert q.judge(spark.createDataFrame([], SCHEMA), none, buckets=BUCKETS).collect() == []
    docs = spark.createDataFrame([(1, GOOD), (2, "junk")], "doc_id long, text string")
    assert found(q.judge(docs, none, buckets=BUCKETS)) == brute([(1, GOOD), (2, "junk")], set())


def test_trusted_sample_is_bounded_and_repeatable(spark):
    labels = spark.range(4000).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    some = {r.doc_id for r in q.trusted_ids(labels, 1000).collect()}
    assert 800 < len(some) < 1200 and some == {r.doc_id for r in q.trusted_ids(labels.repartition(7), 1000).collect()}
    assert q.trusted_ids(labels, 4000).count() == 4000


def test_junk_is_rejected_and_clean_text_kept(spark):
    clean = [(k, " ".join(f"{a}{(k * 7 + j * 3) % 11}" for j, a in enumerate(["river", "stone", "wind", "field", "light", "house"] * 4))) for k in range(200)]
    junk = [(k, " ".join(f"&&{(k + j * 5) % 13}|" for j in range(24))) for k in range(200, 260)]
    docs = spark.createDataFrame(clean + junk, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(0, 200, 2)], "doc_id long, quality int, toxic int")
    for r in q.judge(docs, labels).where("NOT base_failed").collect():
        assert r.kept == (r.doc_id < 200)


def test_every_trusted_document_is_fitted_on(spark):
    labels = spark.range(140_000).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    assert q.trusted_ids(labels).count() == 140_000


@pytest.mark.parametrize("kind", ["long", "int", "string"])
def test_trusted_documents_move_no_text(spark, kind):
    """However many they are: whole ids are broadcast as bits, and no join by shuffle meets the texts."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    keys = [0, 1, -1, 32767, 32768, 32769, -32768, -32769, 10**9, None]
    docs = spark.createDataFrame([(k, "a b c") for k in [*keys, 5, -5, 32770]], "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    trusted = spark.createDataFrame([(k,) for k in keys if k is not None], "doc_id long").withColumn("doc_id", F.col("doc_id").cast(kind))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as when the table is too large for it
    try:
        for tables in (1 << 12, 0):
            out = common.flagged(docs, "doc_id", trusted, "found", tables)
            assert out.columns == ["doc_id", "text", "found"] and out.count() == len(keys) + 3
            assert {r.doc_id for r in out.where("found").collect()} == {r.doc_id for r in trusted.collect()}
            if tables and kind != "string":
                assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
