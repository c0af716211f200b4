"""Global places of rows in a sort order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.plans.session import broadcast_bounded, scratch_path

#: Rows of a table with a row per partition that are broadcast.
MAX_PARTS = 1_000_000


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with ``name``: 1, 2, ... over all rows in ``order``.

    Range partitions in order, sorted within and written once; a row's rank is its
    place in its partition plus the sizes of the partitions before.  The sizes are
    one row per partition.  A sort key that many rows share stays in one partition,
    so ``order`` should end in an id."""
    spark = df.sparkSession
    path = scratch_path(spark, "ranked")
    place = F.monotonically_increasing_id()  # partition << 33 | place within it
    df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", place).write.parquet(path)
    written = spark.read.parquet(path).withColumn("_part", F.shiftright("_place", 33))
    sizes = written.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return written.join(broadcast_bounded(offsets, MAX_PARTS), "_part").withColumn(
        name, within + F.col("_before") + 1).drop("_part", "_place", "_before")
