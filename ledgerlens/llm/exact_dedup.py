"""Exact deduplication by progressive refinement (DataFrame functions only).

Rows are grouped by text length first, then by a hash of the text's beginning,
and only groups that still have several rows get the digest of the whole text.
Two texts are equal when they are identical after lower-casing A-Z.

Defined cases: a null text counts as empty, and empty texts equal one another.
Of equal texts the row with the largest ``doc_id`` stays; null ids count as
smallest.  If several rows share that ``doc_id`` and text, exactly one of them
stays.  An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import broadcast_counted, staged, text_or_empty

#: Characters of the beginning that the second level hashes.
PREFIX_CHARS = 256
#: Repeated lengths or (length, prefix) keys up to this number are broadcast (about 10 MB).
BROADCAST_KEYS = 100_000


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; texts of one byte per character take the fast path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                prefix_chars: int = PREFIX_CHARS, digest_all: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``text_sha256`` is the digest of the normalised text where the refinement
    needed it, and null elsewhere; with ``digest_all`` it is filled for all."""
    text = text_or_empty(text_col)
    keyed = docs.select(
        F.col(id_col).alias("doc_id"), text.alias("body"), F.octet_length(text).alias("len"),
        F.xxhash64(lower_ascii(F.substring(text, 1, prefix_chars))).alias("prefix"))

    # Level 1: lengths that occur more than once; level 2: prefixes within them.
    narrow = staged(keyed.select("len", "prefix"), "exact-keys")
    lengths = staged(narrow.groupBy("len").agg(F.count("*").alias("n")).filter("n > 1").select("len"), "exact-lengths")
    shared = broadcast_counted(lengths, lengths.count(), BROADCAST_KEYS)
    repeated = staged(narrow.join(shared, "len", "left_semi").groupBy("len", "prefix")
                      .agg(F.count("*").alias("n")).filter("n > 1")
                      .select("len", "prefix", F.lit(True).alias("again")), "exact-repeated")

    # Level 3: the whole text is hashed only where both levels found company.
    again = broadcast_counted(repeated, repeated.count(), BROADCAST_KEYS)
    digest = F.sha2(lower_ascii(F.col("body")), 256)
    hashed = keyed.join(again, ["len", "prefix"], "left").select(
        "doc_id", "len", "prefix", F.coalesce("again", F.lit(False)).alias("again"),
        (digest if digest_all else F.when(F.col("again"), digest)).alias("text_sha256"))
    rows = staged(hashed.groupBy("doc_id", "len", "prefix", "again", "text_sha256")
                  .agg(F.count("*").alias("copies")), "exact-hashed")

    groups = (rows.filter("again").groupBy("text_sha256")
              .agg(F.max("doc_id").alias("keep"), F.sum("copies").alias("size")))
    joined = (rows.alias("r").join(groups.alias("g"), (F.col("r.text_sha256") == F.col("g.text_sha256"))
                                   & F.col("r.again"), "left")
              .select("r.doc_id", "r.text_sha256", "r.copies", "again",
                      F.when(F.col("again"), F.col("keep")).otherwise(F.col("r.doc_id")).alias("keep_id"),
                      F.when(F.col("again"), F.col("size")).otherwise(F.col("copies")).alias("group_size")))
    return joined.select(
        "doc_id", "keep_id", "group_size", "text_sha256",
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")
