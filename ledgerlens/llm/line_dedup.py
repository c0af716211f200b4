"""Line deduplication by overlapping three-line windows (DataFrame functions only).

Every run of three consecutive lines is hashed (128 bits), hashes that occur
more than once are found globally, and every occurrence but the first is
removed: the lines that removed windows cover are merged and cut.

The first occurrence is the one with the smallest ``doc_id`` (null first), then
the smallest text hash, then the smallest line number.

Defined cases: a document of fewer than three lines has no window and is left
alone; a null text stays null; windows of blank lines only are never removed;
rows that repeat the same ``doc_id`` and text are one document and get the same
result; an empty table gives no rows; other columns pass through unchanged,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import column_of, own_names, staged

#: Lines of a window; the method's fixed value.
WINDOW = 3


def window_table(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, text_hash, line, w1, w2`` of every window that is not blank."""
    hashed = docs.filter(F.col("text").isNotNull()).select(
        F.col("doc_id"), F.xxhash64("text").alias("text_hash"),
        F.split("text", "\n", -1).alias("lines")).filter(F.size("lines") >= window).select(
        "doc_id", "text_hash",
        F.transform("lines", lambda x: F.struct(
            F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x).alias("b"),
            (F.length(F.trim(x)) > 0).alias("full"))).alias("h"))

    def at(i, part):
        return [F.col("h")[i + k][part] for k in range(window)]

    def blank(i):
        found = F.lit(False)
        for column in at(i, "full"):
            found = found | column
        return ~found

    windows = F.transform(
        F.sequence(F.lit(0), F.size("h") - window),
        lambda i: F.struct(i.alias("line"), F.xxhash64(*at(i, "a")).alias("w1"),
                           F.xxhash64(*at(i, "b")).alias("w2"), blank(i).alias("blank")))
    return hashed.select("doc_id", "text_hash", F.inline(windows)).filter(~F.col("blank")).drop("blank")


def covered_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, text_hash, starts``: sorted starts of the windows to remove."""
    windows = staged(window_table(docs, window), "line-windows")
    place = F.struct("doc_id", "text_hash", "line")
    repeated = (windows.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.count("*").alias("n"))
                .filter("n > 1").drop("n"))
    later = windows.join(repeated, ["w1", "w2"]).filter(~place.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("line")).alias("starts"))


def line_dedup(docs: DataFrame, window: int = WINDOW, lines: str = "_ll_lines",
               removed: str = "_ll_removed") -> DataFrame:
    """``docs`` with the later occurrences cut out of ``text``, and the columns
    ``lines`` (lines before) and ``removed`` (lines cut), whose names ``docs`` must
    not have."""
    own = own_names(docs)
    key, digest, starts, every, kept = (own(n) for n in ("id", "hash", "starts", "all", "kept"))
    found = covered_lines(docs, window).select(
        F.col("doc_id").alias(key), F.col("text_hash").alias(digest), F.col("starts").alias(starts))
    joined = docs.join(found, F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(digest)), "left")
    joined = joined.withColumn(every, F.split("text", "\n", -1))
    # Lines between the end of one removed window and the start of the next.
    gaps = F.zip_with(F.concat(F.array(F.lit(-window)), F.col(starts)),
                      F.concat(F.col(starts), F.array(F.size(every))),
                      lambda a, b: F.struct((a + window).alias("lo"), F.greatest(b - a - window, F.lit(0)).alias("n")))
    rest = F.flatten(F.transform(gaps, lambda g: F.slice(every, g["lo"] + 1, g["n"])))
    joined = joined.withColumn(kept, F.when(F.col(starts).isNotNull(), rest))
    count = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(every))
    return joined.select(
        *(F.when(F.col(kept).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text")
          if c == "text" else column_of(c) for c in docs.columns),
        count.alias(lines), F.when(F.col(kept).isNull(), F.lit(0)).otherwise(count - F.size(kept)).alias(removed))
