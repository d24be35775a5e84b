"""Importance resampling against a plain Python version, and its edge rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pertgrid.llm import importance_resampling as op

BUCKETS = 97


def words(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def buckets_of(text, buckets=BUCKETS):
    w = words(text)
    return [zlib.crc32(f.encode()) % buckets for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def brute(rows, target, percent=25, min_words=20):
    s, t = Counter(b for _, x in rows for b in buckets_of(x)), Counter(b for x in target for b in buckets_of(x))
    total, aim = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (total + BUCKETS) / ((s[b] + 1) * (aim + BUCKETS)))) for b in range(BUCKETS)}
    out = []
    for d, x in rows:
        f = buckets_of(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    order = sorted((r for r in out if r[1] >= 2 * min_words - 1), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(order[: percent * len(order) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, out), key=str)


def found(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in df.collect()), key=str)


TARGET = ["solve the equation for x and give the answer in full", None, "", "What is 2+2? Give the ANSWER"]
TEXTS = [f"Row {k} of the table: {'solve the equation ' * (k % 5)}{'zebra fish ' * (k % 7)}{'filler word number ' * 7}{k * 31 % 17}" for k in range(60)]


def test_equals_brute_force(spark):
    rows = list(enumerate(TEXTS)) + [(100, None), (101, ""), (102, "...!"), (103, "ÀÉ über straße 日本語 Ünïcode" * 9), (None, TEXTS[3]), (5, TEXTS[5]), (5, TEXTS[9]), (104, "x" * 200 + " " + "y" * 100 + " a")]
    docs = spark.createDataFrame([(d, t, "clash", "clash") for d, t in rows], "doc_id long, text string, rank string, ends string").repartition(5)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    assert found(op.resample(docs, target, buckets=BUCKETS)) == brute(rows, TARGET)


def test_long_text_is_cut_without_a_trace(monkeypatch):
    text = " ".join(f"w{k * k % 1013}" for k in range(3000)) + " " + "z" * 500 + "  end"
    whole = op.features(text, 10_000)
    monkeypatch.setattr(op, "PIECE_BYTES", 64)
    for a, b in zip(whole, op.features(text, 10_000), strict=True):
        assert np.array_equal(a, b)
    assert Counter(buckets_of(text, 10_000)) == dict(zip(whole[0].tolist(), whole[1].tolist(), strict=True))


def test_blocks_are_the_count_matrix(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)) + [(99, None)], "doc_id long, text string").coalesce(2)
    seen = {}
    for r in op.csr_blocks(docs, BUCKETS).collect():
        bounds, bucket, count = op._rows_of(bytes(r.ends), bytes(r.steps), bytes(r.counts))
        for d, a, b in zip(r.doc_ids, bounds, bounds[1:], strict=False):
            seen[d] = dict(zip(bucket[a:b].tolist(), count[a:b].tolist(), strict=True))
    assert seen == {d: Counter(buckets_of(t)) for d, t in [*enumerate(TEXTS), (99, None)]}
    sums = {r.bucket: r.n for r in op.column_sums(op.csr_blocks(docs, BUCKETS), BUCKETS).collect()}
    assert sums == Counter(b for t in TEXTS for b in buckets_of(t))


@pytest.mark.parametrize("kind", ["int", "string"])
def test_types_of_doc_id_and_ties(spark, kind):
    docs = spark.createDataFrame([(k, TEXTS[k % 2]) for k in range(40)], "doc_id long, text string").selectExpr(f"CAST(doc_id AS {kind}) AS doc_id", "text")
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    out = op.resample(docs, target, buckets=BUCKETS)
    assert dict(out.dtypes)["doc_id"] == kind
    ranks = sorted(r["rank"] for r in out.collect() if r["rank"])
    assert ranks == list(range(1, 11))
    same = spark.createDataFrame([(7, TEXTS[0])] * 8, "doc_id long, text string")
    assert sorted(r["rank"] or 0 for r in op.resample(same, target, buckets=BUCKETS).collect()) == [0] * 6 + [1, 2]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert op.resample(none, none, buckets=BUCKETS).collect() == []
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    assert found(op.resample(docs, none, buckets=BUCKETS)) == brute(list(enumerate(TEXTS)), [])


def test_drawn_documents_keep_their_columns(spark):
    docs = spark.createDataFrame([(k, t, k) for k, t in enumerate(TEXTS)], "doc_id long, text string, weight int")
    kept = op.resampled_documents(docs, spark.createDataFrame([(t,) for t in TARGET], "text string"), buckets=BUCKETS)
    assert kept.columns == docs.columns and kept.count() == 15


def test_stored_blocks_lie_in_small_row_groups(spark):
    import glob

    import pyarrow.parquet as pq

    from pertgrid.llm.common import shared_folder

    folder = shared_folder(spark).removeprefix("file:") + "/importance-blocks-*"
    before = set(glob.glob(folder))
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(1000)), lambda i: F.hex(F.xxhash64("doc_id", i))), " ")
    docs = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id")).withColumn("text", text)
    op.resample(docs, spark.createDataFrame([("one two",)], "text string"))
    (new,) = set(glob.glob(folder)) - before
    groups = [m.row_group(k).total_byte_size for f in glob.glob(new + "/*.parquet") for m in [pq.ParquetFile(f).metadata] for k in range(m.num_row_groups)]
    assert sum(groups) > 40 << 20 and max(groups) <= 16 << 20
