"""Mixing sources to target weights (DataFrame functions only).

Every row gets a hash-random key.  Within a source the rows are ordered by that
key (range buckets of the key, then a sort inside each bucket), prefix sums of
the word counts give every row its place, and each source is cut at its exact
budget.  A budget above the source's size repeats whole epochs first.

Sources in code-point order, null last, weigh 1, 2, 3, 1, 2, 3, ...; together
the targets are 100 % of all words.  A target stops at ``MAX_EPOCHS`` times its
source's size and the excess goes to the others by weight until none is above:
this level is found in closed form from prefix sums over the sources.

Defined cases: a null text has no words; a source without words has target 0;
the row at the cut is taken in part; rows that repeat the same id, source and
text are ordered as one block; null ids are allowed; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import WORD, broadcast_counted, column_of, own_names, staged

MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
BUCKET_ROWS = 500
MAX_BUCKETS = 1 << 16
#: The table of sources is broadcast up to this many rows, else shuffled.
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(seed: int) -> Column:
    """60 random bits of id, text digest and seed, as other engines can compute
    them too: the first 15 hexadecimal digits of an md5."""
    named = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "text_md5")
    return F.conv(F.substring(F.md5(named), 1, 15), 16, 10).cast("long")


def row_key(text_md5: Column) -> Column:
    """One string for id, source and text; rows that share it are equal."""
    return F.md5(F.concat_ws("|", F.col("doc_id").isNull().cast("string"), F.col("doc_id").cast("string"), text_md5,
                             F.col("source").isNull().cast("string"), F.col("source")))


def source_targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS, weights: tuple = WEIGHTS) -> DataFrame:
    """``source, source_size, rows, target`` from ``source, source_size, rows``;
    one row per source goes through each window."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("nth") - 1, F.lit(len(weights))) + 1).cast("int"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    caps = sizes.withColumn("nth", F.row_number().over(by_name)).withColumn("weight", weight.cast("long")).withColumn(
        "cap", F.col("source_size") * max_epochs)
    # Sources reach their cap in the order of cap per weight.
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "nth")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    levels = caps.select(
        "*", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("words_left"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weight_left"))
    # The first source that the level of those from it on doesn't fill up sets
    # the level; if there is none, all words are zero.
    level = F.col("words_left") / F.col("weight_left")
    open_level = F.when(level * F.col("weight") <= F.col("cap"), level)
    final = F.max(F.when(F.col("place") == F.col("opens"), level)).over(everything)
    levels = levels.withColumn("place", F.row_number().over(filling)).withColumn(
        "opens", F.min(F.when(open_level.isNotNull(), F.col("place"))).over(everything)).withColumn("level", final)
    return levels.select("source", "source_size", "rows", F.when(
        F.col("place") < F.col("opens"), F.col("cap").cast("double")).otherwise(
        F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))).alias("target"))


def mix_blocks(docs: DataFrame, seed: int = 17, max_epochs: int = MAX_EPOCHS,
               weights: tuple = WEIGHTS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per distinct (doc_id, source, text): its place in the source's
    random order, the number of equal rows and the source's epochs and rest."""
    rows = staged(docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"),
        F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_md5"))
        .groupBy("doc_id", "source", "size", "text_md5").agg(F.count("*").alias("copies")), "mix-rows")
    totals = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"),
                                        F.count("*").alias("rows"))
    targets = staged(source_targets(totals, max_epochs, weights), "mix-targets")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = targets.select(
        F.col("source").alias("of"), "source_size", "target", epochs.cast("long").alias("epochs"),
        F.least(F.lit(MAX_BUCKETS), F.ceil(F.col("rows") / bucket_rows)).cast("long").alias("buckets")).withColumn(
        "rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    plan = broadcast_counted(plan, targets.count(), BROADCAST_SOURCES)
    # Keys are uniform, so equal ranges of them hold about equal numbers of rows.
    keyed = rows.withColumn("rnd", random_key(seed)).join(plan, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    keyed = keyed.withColumn("bucket", F.shiftright(F.shiftright("rnd", 30) * F.col("buckets"), 30)).withColumn(
        "src", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    words = F.col("size") * F.col("copies")
    sums = keyed.groupBy("src", "bucket").agg(F.sum(words).alias("words"))
    ahead = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("src", "bucket", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("offset"))
    inside = (Window.partitionBy("src", "bucket").orderBy("rnd", "doc_id", "text_md5")
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = keyed.withColumn("ahead", F.coalesce(F.sum(words).over(inside), F.lit(0)))
    return placed.join(offsets, ["src", "bucket"]).withColumn("begin", F.col("offset") + F.col("ahead")).drop(
        "src", "bucket", "buckets", "offset", "ahead", "rnd")


def taken_of(copy: Column) -> Column:
    """Words that the mix takes from the ``copy``-th (from 0) row of a block."""
    rest = F.col("rest") - F.col("begin") - copy * F.col("size")
    return (F.col("epochs") * F.col("size") + F.least(F.col("size"), F.greatest(rest, F.lit(0)))).cast("long")


def mix_documents(docs: DataFrame, seed: int = 17) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` per input row."""
    blocks = mix_blocks(docs, seed)
    return blocks.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).select(
        "doc_id", "source", "size", "source_size", "target", taken_of(F.col("copy")).alias("taken"))


def mixed_texts(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The mix itself: the columns of ``docs``, a row once per time it is taken,
    the row at the cut with the words up to the budget only."""
    own = own_names(docs)
    name, size, begin, epochs, rest, copy, part, times, time = (
        own(n) for n in ("key", "size", "begin", "epochs", "rest", "copy", "part", "times", "time"))
    blocks = mix_blocks(docs, seed).select(
        row_key(F.col("text_md5")).alias(name), F.col("size").alias(size), F.col("begin").alias(begin),
        F.col("epochs").alias(epochs), F.col("rest").alias(rest))
    key = row_key(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    rows = docs.withColumn(name, key).withColumn(
        copy, F.row_number().over(Window.partitionBy(name).orderBy(name)) - 1).join(blocks, name)
    left = F.col(rest) - F.col(begin) - F.col(copy) * F.col(size)
    rows = rows.withColumn(part, F.greatest(F.least(left, F.col(size)), F.lit(0))).withColumn(
        times, F.col(epochs) + F.when(F.col(part) > 0, 1).otherwise(0)).filter(F.col(times) > 0)
    rows = rows.withColumn(time, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times).cast("long"))))
    cut = (F.col(time) == F.col(times)) & (F.col(part) > 0) & (F.col(part) < F.col(size))
    # The first n words with what stands between them.
    words = F.regexp_extract_all("text", F.lit(r"(?:^|[\x20\x09-\x0D]+)?[^\x20\x09-\x0D]+"), F.lit(0))
    first = F.array_join(F.slice(words, 1, F.greatest(F.col(part).cast("int"), F.lit(0))), "")
    return rows.select(*(F.when(cut, first).otherwise(F.col("text")).alias("text") if c == "text" else column_of(c)
                         for c in docs.columns))
