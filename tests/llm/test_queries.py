"""The registered queries on the smallest tables: against their SQL, and the pipeline against brute force."""

import glob
import os
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from pertgrid.llm import language_id
from pertgrid.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path

from .test_dedup import brute_components
from .test_output import reshared
from .test_text import brute_leaks

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    return round(float(v), 6) if isinstance(v, (int, float, bool)) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    found, want = QUERIES[name](spark, SF), con.execute(ORACLE_SQL[name])
    names = [x[0] for x in want.description]
    assert sorted(found.columns) == sorted(names)
    got = [tuple(plain(r[c]) for c in names) for r in found.collect()]
    assert sorted(got, key=str) == sorted((tuple(plain(v) for v in r) for r in want.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert len(QUERIES[name](spark, SF).collect()) > 0


def test_pipeline_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    classify = language_id._classifier(language_id.fit(docs.where(~language_id.is_held_out(docs.doc_id))))
    kept = {d: r for d, r in rows.items() if classify(r.text)[0] != "und" and classify(r.text)[2] >= language_id.MIN_MARGIN}
    components = brute_components([(d, r.text) for d, r in kept.items()])
    kept = {d: r for d, r in kept.items() if components[d][1] == d}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    kept = {d: r for d, r in kept.items() if d not in {x for x, _ in brute_leaks([(d, r.text) for d, r in kept.items()], items)}}
    sizes = {}
    for r in kept.values():
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    target = reshared(sizes)

    stage, folder = docs, []
    for name, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, SF)
        assert stage.columns == docs.columns, name
        folder.append(stage)
        stage = spark.createDataFrame(stage.collect(), docs.schema)
    mixed = stage.collect()
    assert {r.doc_id for r in folder[2].collect()} == set(kept)
    taken = dict.fromkeys(sizes, 0)
    for r in mixed:
        taken[r.source] += len(r.text.split())
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(len(r.text.split()) for r in kept.values() if r.source == s) / 2 + 1
    from tokenizers import Tokenizer

    tokenizer, start, want = Tokenizer.from_file(tokenizer_path()), 0, []
    for r in sorted(mixed, key=lambda r: r.doc_id):
        ids = np.array(tokenizer.encode(r.text, add_special_tokens=False).ids + [1], "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()) == want
