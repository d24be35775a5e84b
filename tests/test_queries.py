"""Every registered core query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from pertgrid.plans import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if v is None or isinstance(v, str):
        return str(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    v = float(v)
    return "None" if math.isnan(v) else f"{v:.5g}" if abs(v) > 1e-9 else "0"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):
    found, want = QUERIES[name](spark, SF), con.execute(ORACLE_SQL[name])
    names = [x[0] for x in want.description]
    assert sorted(found.columns) == sorted(names)
    got = sorted(tuple(plain(r[c]) for c in names) for r in found.collect())
    assert got == sorted(tuple(plain(v) for v in r) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF).limit(1).count() == 1


def test_entry_and_contract(spark):
    assert entry_module.entry(spark).limit(1).count() == 1
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_queries_without_sql_read_all_rows(spark, tmp_path):
    lines = [(k, 1 + (7 * k + 11 * j) % 90, (3 * k + j) % 80, "FO"[(k // 2 + j) % 2], 1.0 + (k * j) % 5) for k in range(1, 161) for j in range(12)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linestatus string, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    cells = {(k, g % 60) for k, g, *_ in lines}
    mapped = QUERIES["nb_quantile_map"](spark, str(tmp_path)).select("row_id", "gene_id").collect()
    assert len(mapped) == len(cells) and {tuple(r) for r in mapped} == cells
    chosen = QUERIES["sparse_signatures"](spark, str(tmp_path)).collect()
    assert {r.y for r in chosen} == {g % 60 for _, g, *_ in lines} and max(r.i for r in chosen) >= 12
    scored = QUERIES["latent_components"](spark, str(tmp_path)).collect()
    assert sorted(r.row_id for r in scored) == list(range(1, 161))
