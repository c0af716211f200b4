"""Corpus pipeline: five operators, each over all that the one before it kept.

``STAGES`` lists the stages in order.  Each takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read back as the next
stage's ``docs``; all but the last return the columns of ``documents``.

Defined cases, as in the operators: a null or empty text is rejected by the quality
rules (too few words); of rows that repeat each other one stays (near duplicates);
an empty table gives no rows; further columns, whatever their names, stay with
their rows up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import documents, own_names, staged
from ledgerlens.llm.line_dedup import line_dedup
from ledgerlens.llm.minhash import near_dedup_filter
from ledgerlens.llm.mixing import mixed_texts
from ledgerlens.llm.packing import pack_documents
from ledgerlens.llm.quality import quality_filter


def _with_length(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows a changed text, where the table has that column."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_filter(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated three-line windows cut; a document of which nothing is left goes."""
    own = own_names(docs)
    lines, removed = own("lines"), own("removed")
    cut = line_dedup(docs, lines=lines, removed=removed)
    left = (F.col(removed) == 0) | (F.col(removed) < F.col(lines))
    return _with_length(cut.filter(left).drop(lines, removed))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dedup_filter(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row each time a document is taken, the last one of a source
    cut to the budget."""
    return _with_length(mixed_texts(docs))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents with their sequence and offset."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("piece_id")


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("minhash_near_dedup", near_stage),
    ("source_mix", mix_stage),
    ("best_fit_packing", pack_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: No SQL: signatures, tokenisers and best-fit packing are beyond it.  The tests
#: compare the stages with brute-force versions.
ORACLE_SQL = None
