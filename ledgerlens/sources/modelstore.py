"""Model package (S9): everything that scoring needs, as versioned tables.

A version is a folder with one table each: ``models`` (intercept, weights, class
counts, objective), ``features`` (position and label of every feature),
``feature_map`` (the features that each model uses), ``scaler`` (age labels, means,
deviations), ``thresholds`` (the split) and ``metrics`` (test AUC).  A version
counts once its row stands in the ``versions`` table: one appended file, so a
reader sees a whole version or none.  Older versions stay readable by name.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators.features import Scaler, scaler_table
from ledgerlens.operators.scoring import feature_table

TABLES = ("models", "features", "feature_map", "scaler", "thresholds", "metrics")


@dataclass(frozen=True)
class Package:
    version: str
    tables: dict[str, DataFrame]

    @property
    def scaler(self) -> Scaler:
        """The fitted preprocessing; its table has a row per label and moment."""
        rows = {(r.column, r.key): r.value for r in self.tables["scaler"].collect()}
        labels = sorted((v, k) for (c, k), v in rows.items() if c == "age_bucket")
        return Scaler(tuple(k for _, k in labels), *(rows[c, k] for c in ("revenue", "credit_score") for k in ("mean", "std")))


def feature_map(models: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``prod_id, features``: the names of the features each model uses, in order."""
    used = models.select("prod_id", F.posexplode("weights").alias("idx", "w")).filter("w IS NOT NULL").join(
        feature_table(catalogue).select("idx", "feature"), "idx")
    return used.groupBy("prod_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "feature"))),
                                                   lambda x: x["feature"]).alias("features"))


def save_package(root: str, catalogue: DataFrame, models: DataFrame, scaler: Scaler, thresholds: DataFrame,
                 metrics: DataFrame) -> str:
    """Writes a version and then its row; returns its name."""
    spark = models.sparkSession
    version = uuid.uuid4().hex
    tables = {"models": models, "features": feature_table(catalogue), "feature_map": feature_map(models, catalogue),
              "scaler": scaler_table(spark, scaler), "thresholds": thresholds, "metrics": metrics}
    counts = {}
    for name in TABLES:
        tables[name].coalesce(1).write.parquet(f"{root}/{version}/{name}")
        counts[name] = spark.read.parquet(f"{root}/{version}/{name}").count()
    told = spark.createDataFrame([(version, counts)], "version string, row_counts map<string,bigint>")
    told.withColumn("saved_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{root}/versions")
    return version


def versions(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/versions")


def load_package(spark: SparkSession, root: str, version: str | None = None) -> Package:
    """A version (default: the last saved one); refused if a table lacks rows."""
    told = versions(spark, root)
    chosen = told.filter(F.col("version") == version) if version else told.orderBy(F.desc("saved_at"), F.desc("version"))
    row = chosen.first()
    if row is None:
        raise ValueError(f"no version {version or ''} under {root}")
    tables = {name: spark.read.parquet(f"{root}/{row.version}/{name}") for name in TABLES}
    wrong = [name for name, df in tables.items() if df.count() != row.row_counts[name]]
    if wrong:
        raise ValueError(f"version {row.version}: rows are missing in {wrong}")
    return Package(row.version, tables)
