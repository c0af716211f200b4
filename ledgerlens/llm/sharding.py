"""Hilbert-curve sharding (DataFrame functions only).

Several metadata dimensions are quantised to a few bits each, rows are ordered
along the Hilbert curve through the quantised cells, and the order is cut into
runs of equal row counts.  Neighbours on the curve are close in every
dimension, so each shard covers a small range of all of them and a reader can
skip files by their min/max statistics.

The global order needs no single-task sort: the curve has a fixed number of
cells, the n rows of a cell are split into about sqrt(n) hash buckets, and
positions are prefix sums over cells, then over the buckets of a cell, then
within a bucket.

Defined cases: null dimension values form the lowest class, a null text has no
bytes, rows that repeat each other get neighbouring slots, an empty table gives
no rows, and extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import broadcast_counted, column_of, own_names, staged, text_or_empty, value_ranks

#: Bits per dimension; 3 dimensions give 2 ** 12 cells.
BITS = 4
#: Distinct values of a dimension whose ranks are broadcast.
BROADCAST_VALUES = 100_000
#: A cell table is broadcast; this is its largest size.
MAX_CELLS = 1 << 16


def hilbert_cells(spark, dims: int, bits: int) -> DataFrame:
    """All cells of the grid with their index on the Hilbert curve.

    Columns ``q0..q{dims-1}`` and ``curve``.  The transformation works on the
    bits of the coordinates, from the highest down: where a coordinate has the
    bit, the lower bits of the first coordinate are inverted, otherwise they
    are exchanged with the first coordinate's; Gray coding of the result
    interleaved over the dimensions gives the index."""
    cells = spark.range(1 << (dims * bits)).select(*(
        F.shiftright(F.col("id"), bits * i).bitwiseAND(F.lit((1 << bits) - 1)).alias(f"q{i}") for i in range(dims)))
    cells = cells.select("*", *(F.col(f"q{i}").alias(f"x{i}") for i in range(dims)))

    def has(column: str, bit: int) -> Column:
        return F.col(column).bitwiseAND(F.lit(bit)) != 0

    for level in range(bits - 1, 0, -1):
        low = F.lit((1 << level) - 1)
        for i in range(dims):
            swap = F.col("x0").bitwiseXOR(F.col(f"x{i}")).bitwiseAND(low)
            first = F.when(has(f"x{i}", 1 << level), F.col("x0").bitwiseXOR(low)).otherwise(
                F.col("x0").bitwiseXOR(swap))
            other = F.when(has(f"x{i}", 1 << level), F.col(f"x{i}")).otherwise(F.col(f"x{i}").bitwiseXOR(swap))
            cells = cells.withColumns({"x0": first} if i == 0 else {"x0": first, f"x{i}": other})
    for i in range(1, dims):
        cells = cells.withColumn(f"x{i}", F.col(f"x{i}").bitwiseXOR(F.col(f"x{i - 1}")))
    flips = F.lit(0).cast("long")
    for level in range(bits - 1, 0, -1):
        flips = flips.bitwiseXOR(F.when(has(f"x{dims - 1}", 1 << level), F.lit((1 << level) - 1)).otherwise(F.lit(0)))
    cells = cells.withColumn("flips", flips)
    curve = F.lit(0).cast("long")
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            bit = F.shiftright(F.col(f"x{i}").bitwiseXOR(F.col("flips")), level).bitwiseAND(F.lit(1))
            curve = F.shiftleft(curve, 1).bitwiseOR(bit)
    return cells.select(*(f"q{i}" for i in range(dims)), curve.alias("curve"))


def quantise(rows: DataFrame, dims: list[str], bits: int) -> DataFrame:
    """Equal-depth classes ``q0..`` (0 for null) of the long columns ``dims``;
    only the cut points, at most 2 ** bits - 2 a dimension, reach the driver."""
    share = [i / ((1 << bits) - 1) for i in range(1, (1 << bits) - 1)]
    cuts = rows.agg(*(F.percentile_approx(d, share, 10_000).alias(d) for d in dims)).first()
    out = {}
    for i, d in enumerate(dims):
        level = F.lit(1).cast("long")
        for cut in sorted(set(cuts[d] or [])):
            level = level + (F.col(d) > F.lit(cut)).cast("long")
        out[f"q{i}"] = F.when(F.col(d).isNull(), F.lit(0).cast("long")).otherwise(level)
    return rows.withColumns(out)


def hilbert_order(rows: DataFrame, dims: list[str], tie: list[str], bits: int = BITS) -> tuple[DataFrame, int]:
    """``rows`` with ``position``, 0 .. n-1 along the curve, and n.  ``tie`` are
    the columns that order the rows of one cell (through their hash)."""
    if 1 << (len(dims) * bits) > MAX_CELLS:
        raise ValueError(f"{len(dims)} dimensions of {bits} bits make more than {MAX_CELLS} cells")
    spark = rows.sparkSession
    quantised = quantise(rows, dims, bits)
    keys = [f"q{i}" for i in range(len(dims))]
    placed = staged(quantised.join(F.broadcast(hilbert_cells(spark, len(dims), bits)), keys).drop(*keys), "hilbert-rows")

    # At most MAX_CELLS rows: totals and offsets of the cells along the curve.
    along = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    cells = placed.groupBy("curve").agg(F.count("*").alias("n")).select(
        "curve", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("cell_offset"),
        F.ceil(F.sqrt("n")).alias("buckets"))
    key = F.xxhash64(*tie)
    rows = placed.join(F.broadcast(cells), "curve").withColumn("bucket_key", key).withColumn(
        "bucket", F.pmod(F.col("bucket_key"), F.col("buckets"))).drop("buckets")
    within = Window.partitionBy("curve").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = rows.groupBy("curve", "bucket").agg(F.count("*").alias("n")).select(
        "curve", "bucket", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("bucket_offset"))
    ranked = rows.withColumn("rank", F.row_number().over(
        Window.partitionBy("curve", "bucket").orderBy("bucket_key", *tie)))
    out = ranked.join(buckets, ["curve", "bucket"]).withColumn(
        "position", F.col("cell_offset") + F.col("bucket_offset") + F.col("rank") - 1)
    return out.drop("curve", "bucket", "bucket_key", "rank", "cell_offset", "bucket_offset"), placed.count()


def ranked(rows: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` with the rank of a string column (of whole values; null for null) in
    its place.  A value that many rows share is no hot key: the values are broadcast
    if they are few, and else the join's skewed partitions are split."""
    ranks, values = value_ranks(rows, column)
    ranks = broadcast_counted(ranks.select(F.col("value").alias(column), F.col("rank").alias(name)), values, BROADCAST_VALUES)
    return rows.join(ranks, column, "left").drop(column)


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` per row, by
    the law ``rows``: shard counts differ by one at most.  Dimensions: source,
    language and size."""
    text = text_or_empty()
    rows = docs.select("doc_id", (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), "source", "lang")
    for column in ("source", "lang"):
        rows = ranked(rows, column, f"d_{column}")
    ordered, n = hilbert_order(rows, ["d_source", "d_lang", "size"], ["doc_id", "text_crc32", "size"])
    shard = F.expr(f"(position * {shards}L) div {max(n, 1)}L")
    first = F.expr(f"(shard * {max(n, 1)}L + {shards - 1}L) div {shards}L")
    return ordered.withColumn("shard", shard).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("position") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 40, files_per_shard: int = 8) -> str:
    """Write the documents as one folder per shard, in curve order within each
    file, so that file statistics prune on source, language and size.  Returns the
    name of the folder column: ``shard``, or a free name if ``docs`` has that one.

    Rows that share id and text get the slots of these rows in any order."""
    own = own_names(docs)
    folder = "shard" if "shard" not in {c.lower() for c in docs.columns} else own("shard")
    key, crc, nth, slot, run = (own(n) for n in ("id", "crc", "nth", "slot", "run"))
    same = Window.partitionBy(key, crc)
    placed = shard_documents(docs, shards).select(
        F.col("doc_id").alias(key), F.col("text_crc32").alias(crc), F.col("shard").alias(folder), F.col("slot").alias(slot))
    placed = placed.withColumn(nth, F.row_number().over(same.orderBy(folder, slot))).withColumnsRenamed(
        {key: f"{key}_", crc: f"{crc}_", nth: f"{nth}_"})
    body = docs.withColumn(key, F.col("doc_id")).withColumn(crc, F.crc32(text_or_empty().cast("binary")))
    body = body.withColumn(nth, F.row_number().over(same.orderBy(key)))
    joined = body.join(placed, F.col(key).eqNullSafe(F.col(f"{key}_")) & (F.col(crc) == F.col(f"{crc}_"))
                       & (F.col(nth) == F.col(f"{nth}_")))
    last = F.max(slot).over(Window.partitionBy(folder))
    number = F.floor(F.col(slot) / F.greatest(F.lit(1), F.floor((last + files_per_shard) / files_per_shard)))
    (joined.withColumn(run, number).repartition(folder, run).sortWithinPartitions(folder, slot)
     .select(*map(column_of, docs.columns), folder).write.partitionBy(folder).parquet(path))
    return folder
