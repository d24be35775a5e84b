"""Readers.  All return DataFrames; only configuration files are read on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None, where: Column | str | None = None) -> DataFrame:
    """Projected and filtered scan; both reach the Parquet reader."""
    df = spark.read.parquet(path)
    df = df if where is None else df.where(where)
    return df if columns is None else df.select(*columns)


def ragged_counts(cells: DataFrame, key: str, ids: str, values: str) -> DataFrame:
    """Two list columns to (row_id, gene_id, count).  Lists of different lengths raise when they are met."""
    same = F.assert_true(F.size(ids) == F.size(values), "list columns differ in length")
    checked = cells.select(F.col(key).alias("row_id"), ids, values, same.alias("_ok")).where(F.col("_ok").isNull())
    return checked.select("row_id", F.explode(F.arrays_zip(F.col(ids).alias("gene_id"), F.col(values).alias("count"))).alias("x")).select("row_id", "x.gene_id", "x.count")


def ragged_mismatch(cells: DataFrame, ids: str, values: str) -> DataFrame:
    return cells.where(F.size(ids) != F.size(values))


def dense_rows(df: DataFrame, key: str, array: str) -> DataFrame:
    """Dense row arrays to the long form without zeros; gene_id is the place in the array."""
    return df.select(F.col(key).alias("row_id"), F.posexplode(array).alias("gene_id", "count")).where("count <> 0")


def csr_rows(indptr: DataFrame, entries: DataFrame) -> DataFrame:
    """Row pointers (row_id, first, last) and entries (pos, gene_id, count) to the long form.

    Pointers are exploded to positions and equi-joined: entries need no order and either orientation (rows or columns) works.
    """
    return indptr.where("last > first").select("row_id", F.explode(F.sequence("first", F.col("last") - 1)).alias("pos")).join(entries, "pos").select("row_id", "gene_id", "count")


def contiguous_runs(ids: DataFrame, key: str) -> DataFrame:
    """Maximal runs of consecutive ids as half-open ranges (first, last).

    Run starts are rows without a predecessor, ends rows without a successor; the k-th start belongs to the k-th end.
    Only starts and ends are ordered globally.
    """
    x = ids.select(F.col(key).cast("long").alias("x")).distinct()
    starts = x.join(x.select((F.col("x") + 1).alias("x")), "x", "left_anti").select("x", F.lit(0).alias("is_end"))
    ends = x.join(x.select((F.col("x") - 1).alias("x")), "x", "left_anti").select((F.col("x") + 1).alias("x"), F.lit(1).alias("is_end"))
    marks = starts.unionByName(ends)
    w = Window.orderBy("x", F.col("is_end").desc())
    return marks.select("x", "is_end", F.lead("x").over(w).alias("last")).where("is_end = 0").select(F.col("x").alias("first"), "last")


def categorical(codes: DataFrame, categories: DataFrame, code: str = "code") -> DataFrame:
    """Category codes decoded; a code without a category (such as -1 for missing) raises when it is met."""
    joined = codes.join(F.broadcast(categories), code, "left")
    return joined.where(F.assert_true(F.col("category").isNotNull(), "missing category").isNull())


def nullable_strings(df: DataFrame, values: str, mask: str, out: str) -> DataFrame:
    return df.withColumn(out, F.when(~F.col(mask), F.col(values)))


def csv(spark: SparkSession, path: str, schema: str | T.StructType, sep: str = ",", header: bool = True) -> DataFrame:
    return spark.read.csv(path, schema=schema, sep=sep, header=header, enforceSchema=False if header else True)


def target_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines stripped and upper-cased; comments from # on and empty lines go."""
    line = F.upper(F.trim(F.regexp_replace("value", "#.*$", "")))
    return spark.read.text(path).select(line.alias("target")).where("target <> ''").distinct()


def gene_list(spark: SparkSession, path: str) -> DataFrame:
    """One gene per line, the first line included."""
    return spark.read.text(path).select(F.trim(F.split("value", ",")[0]).alias("gene")).where("gene <> ''")


def gmt(spark: SparkSession, path: str) -> DataFrame:
    """Gene sets of tab-separated lines (name, description, members) as (set, gene)."""
    parts = F.split("value", "\t")
    return spark.read.text(path).select(parts[0].alias("set"), F.explode(F.slice(parts, 3, F.greatest(F.lit(0), F.size(parts) - 2))).alias("gene")).where("gene <> ''")


def memberships(df: DataFrame, key: str, members: str, panel: DataFrame | None = None, sep: str = ";", least: int = 2) -> DataFrame:
    """Delimited members as rows, cut to the panel; groups of fewer than ``least`` go."""
    m = df.select(key, F.explode(F.split(members, sep)).alias("gene")).withColumn("gene", F.trim("gene")).where("gene <> ''").distinct()
    if panel is not None:
        m = m.join(panel.select("gene").distinct(), "gene", "left_semi")
    return m.join(m.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(key), key, "left_semi")


def intervals(spark: SparkSession, path: str) -> DataFrame:
    """BED-like lines (gz too): chr, start, end, number of columns, and whether start >= 0 and end > start.  Comments and track lines go."""
    parts = F.split("value", "\t")
    lines = spark.read.text(path).where(~F.col("value").rlike("^(#|track|browser)") & (F.trim("value") != ""))
    start, end = F.get(parts, F.lit(1)).try_cast("long"), F.get(parts, F.lit(2)).try_cast("long")
    return lines.select(parts[0].alias("chr"), start.alias("start"), end.alias("end"), F.size(parts).alias("n_columns"), F.coalesce((start >= 0) & (end > start), F.lit(False)).alias("valid"))


def interval_audit(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("records"), F.min("n_columns").alias("min_columns"), F.max("n_columns").alias("max_columns"), F.count_if(~F.col("valid")).alias("invalid"))


def file_digests(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, size, sha256, md5) of the files below a folder; each file is read whole by one task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))


def shards(spark: SparkSession, path: str, prefix: str, suffix: str) -> DataFrame:
    """Files of the folder in the order of the number in their name, within the size budget's view: (path, name, number, size)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"))
    name = F.element_at(F.split("path", "/"), -1)
    number = F.regexp_extract(name, r"(\d+)", 1).try_cast("int")
    return files.withColumn("name", name).withColumn("number", number).where(F.col("name").startswith(prefix) & F.col("name").endswith(suffix)).orderBy("number", "name")


class BudgetError(ValueError):
    """More bytes would be read than allowed."""


def within_budget(files: DataFrame, max_bytes: int) -> DataFrame:
    total = files.agg(F.sum("size")).first()[0] or 0
    if total > max_bytes:
        raise BudgetError(f"{total} bytes; {max_bytes} are allowed")
    return files


def category_histogram(codes: DataFrame, categories: DataFrame, code: str = "code") -> DataFrame:
    """Cells per category; categories without cells count 0."""
    n = codes.groupBy(code).agg(F.count(F.lit(1)).alias("n_cells"))
    return categories.join(n, code, "left").na.fill(0, ["n_cells"]).select("category", "n_cells")


def grid_from_long(df: DataFrame, rows: DataFrame, columns: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Values on the full grid of two axes, null where absent; values outside the axes are left out."""
    grid = rows.select(row).distinct().join(F.broadcast(columns.select(column).distinct()), how="cross")
    return grid.join(df.select(row, column, value), [row, column], "left")


def axis_difference(a: DataFrame, b: DataFrame, axis: list[str]) -> DataFrame:
    """Axis members of one relation that the other lacks; empty for identical axes.

    Both are grouped together once, so a task holds one table of members and nulls are equal.
    """
    side = lambda df, left: df.select(*axis, F.lit(left).alias("_left"))
    sides = side(a, True).unionByName(side(b, False)).groupBy(*axis).agg(F.bool_or("_left").alias("_a"), F.bool_and("_left").alias("_only_a"))
    return sides.where("_a = _only_a").select(*axis)


def author_cell_counts(meta: DataFrame, label: str, controls: list[str]) -> DataFrame:
    """Cells per normalised target label, and the kind of label: control, several targets, or one."""
    name = F.upper(F.trim(F.col(label)))
    kind = F.when(name.isNull() | name.isin(*[c.upper() for c in controls]), "control").when(name.rlike("[,;+]"), "several").otherwise("single")
    return meta.select(name.alias("target"), kind.alias("kind")).groupBy("target", "kind").agg(F.count(F.lit(1)).alias("n_cells"))


def reconstructed_counts(means: DataFrame, mean: str, n: str) -> DataFrame:
    """Integer sums from means, and their distance from an integer."""
    product = F.col(mean) * F.col(n)
    return means.withColumn("count", F.rint(product).cast("long")).withColumn("distance", F.abs(product - F.rint(product)))


def inherited(config: dict[str, dict], key: str = "inherit") -> dict[str, dict]:
    """Entries completed from the entries that they inherit; an entry's own values win.  Cycles and unknown parents raise."""
    done: dict[str, dict] = {}

    def resolve(name: str, path: tuple[str, ...]) -> dict:
        if name in path:
            raise ValueError(f"inheritance cycle: {' -> '.join((*path, name))}")
        if name not in config:
            raise ValueError(f"unknown entry {name!r}")
        if name not in done:
            own = dict(config[name])
            parent = own.pop(key, None)
            done[name] = {**(resolve(parent, (*path, name)) if parent else {}), **own}
        return done[name]

    return {name: resolve(name, ()) for name in config}
