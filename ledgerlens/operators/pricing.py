"""Credit terms (C1-C4) and CRM reporting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.expressions import credit_rate, credit_risk_class, deal_volume_bounds
from ledgerlens.plans import rules as R
from ledgerlens.plans.session import broadcast_bounded

MAX_CATALOGUE = 10_000


def credit_terms(customers: DataFrame, products: DataFrame, credit_ids=R.CREDIT_PRODUCT_IDS,
                 jitter_col: str | None = None) -> DataFrame:
    """C1-C4 for every customer x credit product.

    The credit products are a fixed short list, so the pairs come from a
    generator on each customer row, not from a join; the catalogue (base rate)
    and credit-type table are size-checked broadcasts.
    """
    cat = broadcast_bounded(products.select("prod_id", F.col("interest_rate").alias("base_rate")), MAX_CATALOGUE)
    types = R.credit_types(products.sparkSession)
    cols = ["cust_id", "revenue", "credit_score"] + ([jitter_col] if jitter_col else [])
    pairs = customers.select(*cols, F.explode(F.array(*[F.lit(p) for p in credit_ids])).alias("prod_id"))
    df = pairs.join(cat, "prod_id", "left").join(types, "prod_id", "left")
    lo, hi = deal_volume_bounds("revenue")
    return df.select(
        "cust_id", "prod_id",
        F.coalesce("credit_type", F.lit(R.CREDIT_TYPE_DEFAULT)).alias("credit_type"),
        credit_rate("base_rate", "credit_score", "revenue", jitter_col).alias("interest_rate"),
        credit_risk_class("credit_score", "revenue").alias("risk_class"),
        lo.alias("deal_volume_min"), hi.alias("deal_volume_max"))


def _credit_rows(ownership: DataFrame, customers: DataFrame) -> DataFrame:
    cust = customers.select("cust_id", "revenue", "credit_score")
    return ownership.where(F.col("interest_rate").isNotNull()).join(cust, "cust_id")


def credit_rate_check(ownership: DataFrame, customers: DataFrame, products: DataFrame,
                      jitter: Column | None = None) -> DataFrame:
    """C1 on the stored credits: the rate the rules give next to the stored one.
    ``jitter`` is an individual adjustment, a column of the credit (default: none)."""
    cat = broadcast_bounded(products.select("prod_id", F.col("interest_rate").alias("base_rate")), MAX_CATALOGUE)
    df = _credit_rows(ownership, customers).join(cat, "prod_id", "left")
    df = df.withColumn("_jitter", F.lit(0.0) if jitter is None else jitter.cast("double"))
    return df.select("cust_id", "prod_id", F.col("interest_rate").alias("stored_rate"),
                     credit_rate("base_rate", "credit_score", "revenue", "_jitter").alias("rule_rate"))


def credit_risk_check(ownership: DataFrame, customers: DataFrame) -> DataFrame:
    """C2 on the stored credits."""
    df = _credit_rows(ownership, customers)
    derived = credit_risk_class("credit_score", "revenue")
    return df.select("cust_id", "prod_id", F.col("risk_class").alias("stored_risk_class"),
                     derived.alias("rule_risk_class"),
                     (F.col("risk_class") == derived).alias("agrees"))


def deal_volume_check(ownership: DataFrame, customers: DataFrame) -> DataFrame:
    """Volume band by revenue and whether the stored volume lies inside."""
    df = _credit_rows(ownership, customers)
    lo, hi = deal_volume_bounds("revenue")
    return df.select("cust_id", "prod_id", "deal_volume", lo.alias("band_min"), hi.alias("band_max"),
                     F.col("deal_volume").between(lo, hi).alias("in_band"))


def adviser_success(sales: DataFrame) -> DataFrame:
    """Closed / all per adviser, percent rounded half-up to 2 digits.

    The rounding is done in integers (hundredths of a percent), so the value
    is exact and engine-independent.
    """
    agg = (sales.where(F.col("adviser_id").isNotNull()).groupBy("adviser_id")
           .agg(F.count(F.when(F.col("decision") == "closed", 1)).alias("successes"),
                F.count(F.lit(1)).alias("total")))
    hundredths = F.expr("(successes * 20000 + total) div (total * 2)")
    return agg.select("adviser_id", "successes", "total",
                      (hundredths.cast("double") / F.lit(100.0)).alias("success_rate"))


def rejection_reasons(sales: DataFrame) -> DataFrame:
    """Reasons of rejected sales by frequency."""
    return (sales.where((F.col("decision") == "rejected") & F.col("reason").isNotNull())
            .groupBy("reason").agg(F.count(F.lit(1)).alias("rejections"))
            .orderBy(F.col("rejections").desc(), F.col("reason")))
