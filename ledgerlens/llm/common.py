"""Pieces shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.plans.session import scratch_path

#: A word: a run without space, tab, LF, VT, FF or CR.  The same pattern works
#: for Spark (Java), DuckDB (RE2) and Python.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    This cuts the lineage: later jobs, and retries after a lost executor, read
    the files instead of repeating the work above them."""
    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def own_names(docs: DataFrame):
    """A function from stems to column names that ``docs`` does not have (nor in
    another case), for the columns that an operator adds on its way."""
    taken = {c.lower() for c in docs.columns}

    def name(stem: str) -> str:
        out = f"_ll_{stem}"
        while out.lower() in taken:
            out += "_"
        return out

    return name


def column_of(name: str) -> Column:
    """The column of exactly this name, whatever its characters."""
    return F.col("`" + name.replace("`", "``") + "`")


def value_ranks(rows: DataFrame, column: str) -> tuple[DataFrame, int]:
    """``value, rank`` of every distinct value of a column, null apart: the rank is
    the number of rows with a smaller one.  And the number of values.

    Counts first; their prefix sums are taken within range partitions, and over
    the partitions, of which there are few."""
    counts = rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    ordered = staged(counts.repartitionByRange("value").sortWithinPartitions("value").withColumn(
        "place", F.monotonically_increasing_id()), "value-ranks").withColumn("part", F.shiftright("place", 33))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ordered.groupBy("part").agg(F.sum("n").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    ranks = ordered.withColumn("ahead", F.coalesce(F.sum("n").over(within), F.lit(0))).join(parts, "part").select(
        "value", (F.col("offset") + F.col("ahead")).cast("long").alias("rank"))
    return ranks, ordered.count()


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def digest_pair(*columns: Column) -> tuple[Column, Column]:
    """A 128-bit content digest as two longs; nulls differ from empty values."""
    marked = [x for c in columns for x in (c.isNull(), c)]
    return F.xxhash64(F.lit(1), *marked), F.xxhash64(F.lit(2), *marked, F.lit(3))


def broadcast_counted(df: DataFrame, rows: int, bound: int) -> DataFrame:
    """Hint a broadcast for a frame whose row count is already known to be at
    most ``bound``; beyond it, leave the join to a shuffle."""
    return F.broadcast(df) if rows <= bound else df
