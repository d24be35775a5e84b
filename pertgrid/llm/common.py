"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: Integer keys, of eight bytes each, that are broadcast at most (some 3 MB with their table).
BROADCAST_KEYS = 1 << 17
#: Bit tables that ``flagged`` broadcasts at most, of 4 kB and 32,768 neighbouring keys each (16 MB).
BIT_TABLES = 1 << 12
#: Bytes of an Arrow batch of texts.
BATCH_BYTES = 4 << 20
_BATCH_SETTING, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
#: One run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of ``WORD`` runs; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset in a session of one machine (as in tests) a temporary folder takes its place; on a cluster an
    unset folder is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: intermediate tables need a folder that all executors share")
        configured = "file:" + tempfile.mkdtemp(prefix="pertgrid-shared-")
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of ``BATCH_BYTES`` at most from here on in this session, where its setting has Spark's default of 64 MB.

    Operators that read texts in Python call it: a task holds a batch several times over, in its worker and outside the heap
    of its executor, and texts make batches as long as the limit lets them."""
    if spark.conf.get(_BATCH_SETTING) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_SETTING, f"{BATCH_BYTES}b")


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written as a table of the shared folder and read again: its lineage ends here, and a lost
    executor costs no recomputation of what came before.  ``options`` are those of the Parquet writer."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(df: DataFrame) -> None:
    """Removes a table of ``stored`` that nothing reads any more."""
    files = df.inputFiles()
    if files:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def unused(df: DataFrame, *stems: str) -> list[str]:
    """A column name for each stem that ``df`` does not have."""
    taken, found = {c.lower() for c in df.columns}, []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        found.append(stem)
    return found


def _bit(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - bits)


def _has_bit(table: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(table, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.call_function("getbit", byte, (place % 8).cast("int")) == 1


def _marked(df: DataFrame, key: Column, wanted: DataFrame, max_bits: int, n_wanted: int) -> tuple[DataFrame, str]:
    """``df`` with a further column, and its name: false only for rows whose key is surely not among the one column of ``wanted``.

    A bit table over hashes of the wanted keys is broadcast: eight bits a key, at most 2 ** ``max_bits`` of them (16 MB)
    however many keys there are.  When it is too small for the keys it marks more rows, and nothing is lost.
    """
    bits = min(max_bits, max(16, (8 * max(1, n_wanted)).bit_length()))
    key_bit, bucket, found, maybe = unused(df, "key_bit", "key_bucket", "key_bits", "key_maybe")
    bit = _bit(F.col(wanted.columns[0]), bits)
    table = (
        wanted.select(bit.alias("bit"))
        .groupBy(F.bitmap_bucket_number("bit").alias(bucket))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias(found))
    )
    own = df.withColumn(key_bit, _bit(key, bits)).withColumn(bucket, F.bitmap_bucket_number(key_bit))
    place = F.bitmap_bit_position(key_bit)
    return own.join(F.broadcast(table), bucket, "left").withColumn(maybe, F.coalesce(_has_bit(F.col(found), place), F.lit(False))), maybe


def narrowed(df: DataFrame, key: Column, wanted: DataFrame, max_bits: int = 27, n_wanted: int | None = None) -> DataFrame:
    """Rows of ``df`` whose key may be among the one column of ``wanted``: all that are, and a few others.

    It keeps most other rows out of the shuffle of the exact join that follows.  ``n_wanted``, where it is known to be about
    the number of wanted keys, saves counting them.
    """
    marked, maybe = _marked(df, key, wanted, max_bits, wanted.count() if n_wanted is None else n_wanted)
    return marked.where(F.col(maybe)).select(df.columns)


def flagged(df: DataFrame, key: str, wanted: DataFrame, name: str, bit_tables: int = BIT_TABLES) -> DataFrame:
    """``df`` with the boolean column ``name``: whether the key is among the distinct ones of ``wanted`` (one column of the same name); a null key is not.

    Whole keys are broadcast as a bit each, exactly, so no row of ``df`` moves however many keys there are.  Keys of other types, and
    whole ones spread over more than ``bit_tables`` stretches, meet in a join.
    """
    bucket, bits = unused(df, "key_bucket", "key_bits")
    of = F.bitmap_bucket_number(F.col(key).cast("long"))
    whole = all(isinstance(x.schema[key].dataType, IntegralType) for x in (df, wanted))
    if not whole or wanted.select(of.alias(bucket)).distinct().count() > bit_tables:
        return df.join(wanted.select(key, F.lit(True).alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    place = F.bitmap_bit_position(F.col(key).cast("long"))
    tables = wanted.groupBy(of.alias(bucket)).agg(F.bitmap_construct_agg(place).alias(bits))
    met = df.withColumn(bucket, of).join(F.broadcast(tables), bucket, "left")
    return met.withColumn(name, F.coalesce(_has_bit(F.col(bits), place), F.lit(False))).drop(bucket, bits)


def excluding(df: DataFrame, key: str, unwanted: DataFrame, max_bits: int = 27, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """Rows of ``df`` whose integer key is not among those of ``unwanted`` (one column of the same name); null keys stay.

    Up to ``broadcast_keys`` unwanted keys (counted here) are broadcast, and ``df`` is read once.  Beyond that only rows
    that may have to go are shuffled for the exact join, and the others pass where they are.
    """
    n = unwanted.count()
    if n <= broadcast_keys and isinstance(unwanted.schema[key].dataType, IntegralType):
        return df.join(F.broadcast(unwanted), key, "left_anti").select(df.columns)
    marked, maybe = _marked(df, F.col(key), unwanted, max_bits, n)
    rest = marked.where(F.col(maybe)).select(df.columns).join(unwanted, key, "left_anti")
    return marked.where(~F.col(maybe)).select(df.columns).unionByName(rest)
