import pytest
from pyspark.sql import functions as F

from pertgrid.llm.common import excluding, narrowed, shared_folder, stored


def test_narrowed_and_excluding(spark):
    df = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"), F.lit("x").alias("bit"))
    df = df.unionByName(spark.createDataFrame([(None, 1, "x")], "k long, v long, bit string"))
    wanted = spark.range(0, 2000, 50).select(F.col("id").alias("k"))
    near = {r.k for r in narrowed(df, F.col("k"), wanted).collect()}
    assert set(range(0, 2000, 50)) <= near and len(near) < 200
    few_bits = {r.k for r in narrowed(df, F.col("k"), wanted, max_bits=3).collect()}
    assert set(range(0, 2000, 50)) <= few_bits
    for bits, broadcast in ((27, 0), (3, 0), (27, 1000)):
        left = excluding(df, "k", wanted, max_bits=bits, broadcast_keys=broadcast)
        assert left.columns == df.columns
        assert sorted(str(r.k) for r in left.collect()) == sorted(str(k) for k in [None, *(k for k in range(2000) if k % 50)])
    assert narrowed(df, F.col("k"), wanted.limit(0)).collect() == [] and excluding(df, "k", wanted.limit(0)).count() == 2001
    assert stored(df.limit(0), "empty").count() == 0


def test_columns_of_the_caller_survive(spark):
    names = ["key_bit", "key_bucket", "key_bits", "key_maybe", "KEY_MAYBE_", "bit"]
    df = spark.range(50).select(F.col("id").alias("k"), *[F.lit(f"v{k}").alias(n) for k, n in enumerate(names)])
    wanted = spark.range(0, 50, 5).select(F.col("id").alias("k"))
    for broadcast in (0, 1000):
        left = excluding(df, "k", wanted, broadcast_keys=broadcast)
        assert left.columns == df.columns
        assert sorted(map(tuple, left.collect())) == sorted((k, *(f"v{n}" for n in range(len(names)))) for k in range(50) if k % 5)
    assert {tuple(r)[1:] for r in narrowed(df, F.col("k"), wanted).collect()} == {tuple(f"v{n}" for n in range(len(names)))}


def test_a_cluster_needs_its_shared_folder():
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError):
        shared_folder(Session())
