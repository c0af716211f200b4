"""Feature matrix (M1), label encoding (M2), standardisation (M3).

The stratified split (M4) lives in :mod:`ledgerlens.operators.models`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.plans import rules as R


def flag_col(prod_id: int) -> str:
    return f"has_{prod_id}"


def ownership_flags(ownership: DataFrame, product_ids=R.PRODUCT_IDS) -> DataFrame:
    """One row per owning customer with 0/1 flags for every product in the list.

    A single hash aggregate (partial on the map side, so a customer with very
    many rows ships one partial row per partition), instead of one join per product.
    """
    ids = ", ".join(str(int(p)) for p in product_ids)
    aggs = [f"CAST(max(CASE WHEN prod_id = {int(p)} THEN 1 ELSE 0 END) AS INT) AS {flag_col(p)}"
            for p in product_ids]
    return (ownership.select("cust_id", "prod_id")
            .where(F.expr(f"prod_id IN ({ids})"))
            .groupBy("cust_id").agg(*[F.expr(a) for a in aggs]))


def build_features(customers: DataFrame, ownership: DataFrame, product_ids=R.PRODUCT_IDS) -> DataFrame:
    """M1: cust_id, age_bucket, revenue, credit_score, has_<p> for the fixed product list.

    Customers without any product keep a row of zeros; a product nobody owns
    still gets its all-zero column (the list is fixed, not taken from the data).
    """
    flags = ownership_flags(ownership, product_ids)
    base = customers.select("cust_id", "age_bucket", "revenue", "credit_score")
    out = base.join(flags, "cust_id", "left")
    return out.selectExpr("cust_id", "age_bucket", "revenue", "credit_score",
                          *[f"coalesce({flag_col(p)}, 0) AS {flag_col(p)}" for p in product_ids])


@dataclass(frozen=True)
class Scaler:
    """Fitted preprocessing: label order for age buckets, population moments."""

    age_labels: tuple[str, ...]
    revenue_mean: float
    revenue_std: float
    credit_mean: float
    credit_std: float

    def as_rows(self):
        return ([("age_bucket", lbl, float(i)) for i, lbl in enumerate(self.age_labels)]
                + [("revenue", "mean", self.revenue_mean), ("revenue", "std", self.revenue_std),
                   ("credit_score", "mean", self.credit_mean), ("credit_score", "std", self.credit_std)])


def _moments(n: int, sx, sxx) -> tuple[float, float]:
    mean = float(sx) / n
    var = float(sxx) / n - mean * mean
    std = math.sqrt(var) if var > 0 else 0.0
    return mean, (std if std != 0.0 else 1.0)


#: Digits after the point that sums of fractional columns keep.
FRACTION = 6
MAX_LABELS = 10_000


def fit_scaler(features: DataFrame, max_labels: int = MAX_LABELS) -> Scaler:
    """M2 + M3 fit: sorted distinct age labels; mean and population std of each
    column over its own values (nulls are left out).

    One pass, exact decimal moments (sum x, sum x^2; six digits after the point for
    fractional columns), so the result does not depend on partitioning.  Only the
    one-row aggregate and the bounded label list reach the driver; a longer list
    is not a category and is refused."""
    def moments(c):
        whole = dict(features.dtypes)[c] in ("tinyint", "smallint", "int", "bigint")
        x = F.col(c).cast("decimal(19,0)" if whole else f"decimal(20,{FRACTION})")
        return [F.count(c).alias(f"n_{c}"), F.sum(x).alias(f"s_{c}"), F.sum((x * x).cast(
            "decimal(38,0)" if whole else "decimal(38,9)")).alias(f"q_{c}")]

    columns = ("revenue", "credit_score")
    row = features.agg(*(m for c in columns for m in moments(c))).first()
    labels_df = features.select("age_bucket").where(F.col("age_bucket").isNotNull()).distinct()
    labels = [r[0] for r in labels_df.limit(max_labels + 1).collect()]
    if len(labels) > max_labels:
        raise ValueError(f"age_bucket has more than {max_labels} labels")
    fitted = [_moments(row[f"n_{c}"], row[f"s_{c}"], row[f"q_{c}"]) if row[f"n_{c}"] else (0.0, 1.0) for c in columns]
    return Scaler(tuple(sorted(labels)), *fitted[0], *fitted[1])


def _encoded(scaler: Scaler) -> tuple[Column, Column, Column]:
    """Age label index (null for an unknown label) and the two z-scores."""
    labels = F.array(*map(F.lit, scaler.age_labels)) if scaler.age_labels else F.array().cast("array<string>")
    place = F.array_position(labels, F.col("age_bucket"))
    age = F.when(place > 0, (place - 1).cast("int"))
    return (age, (F.col("revenue") - F.lit(scaler.revenue_mean)) / F.lit(scaler.revenue_std),
            (F.col("credit_score") - F.lit(scaler.credit_mean)) / F.lit(scaler.credit_std))


def encode_features(features: DataFrame, scaler: Scaler) -> DataFrame:
    """M2 + M3 transform: age label index and z-scores, as pure column expressions."""
    age, revenue, credit = _encoded(scaler)
    others = [F.col(f"`{c}`") for c in features.columns if c not in ("age_bucket", "revenue", "credit_score")]
    return features.select(*others, age.alias("age_bucket_encoded"), revenue.alias("revenue"), credit.alias("credit_score"))


def encode_vectors(vectors: DataFrame, scaler: Scaler) -> DataFrame:
    """``vectors`` with the encoded base features as the array ``base``, in the order
    of ``rules.BASE_FEATURES``."""
    return vectors.withColumn("base", F.array(*(c.cast("double") for c in _encoded(scaler))))


def scaler_table(spark, scaler: Scaler) -> DataFrame:
    return spark.createDataFrame(scaler.as_rows(), "column string, key string, value double")
