"""Effects made row by row against the grouped ones."""

import pytest
from pyspark.sql import functions as F

from pertgrid.plans import calibration as c


def test_effects_of_rows_equal_grouped_ones(spark, tmp_path):
    lines = [("FO"[k % 2], k % 3, "ANR"[k * k % 5 % 3], (7 * k) % 11, float(1 + k % 9)) for k in range(90)] + [("F", 9, "A", 3, 5.0)]
    spark.createDataFrame(lines, "l_linestatus string, l_suppkey long, l_returnflag string, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    g = c.guide_counts(spark, str(tmp_path))
    base = c._base(g)
    made = c.vectors_of(c.target_rows(spark, str(tmp_path)), "pool", "guide", "rest")
    entries = {}
    for r in made.collect():
        assert r.genes == sorted(r.genes)
        entries.update({(r.kind, r.context, r.target, r.guide, gene): v for gene, v in zip(r.genes, r["values"])})
    names = g.select("context", "target", "guide").distinct()
    other = g.withColumnRenamed("guide", "o")
    rest = names.join(other, ["context", "target"]).where("o <> guide").groupBy("context", "target", "guide", "gene_id").agg(F.sum("count").alias("count"))
    want = {}
    for kind, counts, keys in (("guide", g, ["context", "target", "guide"]), ("rest", rest, ["context", "target", "guide"]), ("pool", g, ["context", "target"])):
        for r in c.effects_of(counts, keys, base).collect():
            want[kind, r.context, r.target, r.guide if kind != "pool" else None, r.gene_id] = r.value
    assert entries == {k: pytest.approx(v) for k, v in want.items()} and not any(k[0] == "rest" and k[2] == 9 for k in want)
