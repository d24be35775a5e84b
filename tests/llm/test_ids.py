"""Types of doc_id that the operators with Python tasks take."""

import pytest

from pertgrid.llm import decontamination, language_id, license_scan, minhash

WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"


@pytest.mark.parametrize("kind", ["int", "string", "long"])
def test_types_of_doc_id(spark, kind):
    rows = [(1, WORDS, "en"), (2, WORDS, "en"), (3, "released under cc by today", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr(f"CAST(doc_id AS {kind}) AS doc_id", "text", "lang")
    items = spark.createDataFrame([(7, WORDS)], "item_id long, text string").selectExpr(f"CAST(item_id AS {kind}) AS item_id", "text")
    own = (lambda k: str(k)) if kind == "string" else (lambda k: k)
    assert sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(docs).collect()) == [(1, 1), (2, 1), (3, 3)]
    assert sorted(r.doc_id for r in minhash.without_near_duplicates(docs).collect()) == [own(1), own(3)]
    assert sorted((r.doc_id, r.item_id) for r in decontamination.leaks(docs, items).collect()) == [(1, 7), (2, 7)]
    assert [r.doc_id for r in decontamination.without_leaks(docs, items).collect()] == [own(3)]
    assert sorted(r.doc_id for r in license_scan.scan_licenses(docs).where("n_base > 0").collect()) == [own(3)]
    found = language_id.identify(docs, language_id.fit(docs))
    assert dict(found.dtypes)["doc_id"] == docs.schema["doc_id"].dataType.simpleString() and sorted(r.doc_id for r in found.collect()) == [own(1), own(2), own(3)]
