"""Customer / product profiles and KPIs.

All aggregates are hash aggregates with map-side partial aggregation, so a
customer or product holding a third of the rows ships one partial row per
map task.  Percent-of-total windows only run on already aggregated rows
(a handful of buckets), never on a base table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.expressions import age_bucket, customer_label, income_level, money_sum
from ledgerlens.plans import rules as R
from ledgerlens.plans.session import broadcast_bounded, collect_bounded, constant

MAX_CATALOGUE = 10_000


def exact_avg(x) -> F.Column:
    """Mean of a value with at most 2 decimals, summed exactly."""
    c = F.col(x) if isinstance(x, str) else x
    return (F.sum(c.cast("decimal(18,2)")).cast("double") / F.count(c).cast("double"))


def share(part, total) -> F.Column:
    """``part * 100 / total`` in double, 0 total guarded by 1."""
    return (F.col(part).cast("double") * F.lit(100.0)
            / F.coalesce(F.nullif(F.col(total).cast("double"), F.lit(0.0)), F.lit(1.0)))


# ---------------------------------------------------------------- lookups ---
def customer_lookup(customers: DataFrame, requests: DataFrame) -> DataFrame:
    """P1 in batch: the customers named by a request table (semi join)."""
    return customers.join(requests.select("cust_id").distinct(), "cust_id", "left_semi")


def risk_indicator(column: str = "risk_class") -> Column:
    """P5: the indicator of a risk class."""
    out = None
    for k, v in R.RISK_INDICATOR.items():
        cond = F.col(column) == k
        out = F.when(cond, v) if out is None else out.when(cond, v)
    return out.otherwise(R.RISK_INDICATOR_DEFAULT)


def product_explain(products: DataFrame, requests: DataFrame, category_info: DataFrame) -> DataFrame:
    """P2 + P4 + P5: resolve identifiers to products.

    An identifier that parses as an integer is looked up by id only; anything
    else by case-insensitive name (first in catalogue order).  All per-product
    work (name de-duplication, category text, risk label, description) is done
    on the small catalogue, which becomes one lookup table with tagged keys
    (``i:<id>`` and ``n:<lower name>``); each request then costs one key
    expression and one size-checked broadcast lookup.  Unmatched identifiers
    keep a row with ``matched = false``, with the names there are in ``available``.
    """
    from ledgerlens.functions.expressions import int_or_null
    cols = ["prod_id", "name", "category", "risk_class", "price", "interest_rate"]
    description = (F.coalesce(F.col("long_desc"), F.col("short_desc"))
                   if "long_desc" in products.columns else F.lit(None).cast("string"))
    cat = (products.select(*cols, description.alias("description"))
           .join(category_info, "category", "left")
           .select(*cols, "description",
                   F.coalesce(F.col("category_info"), F.lit(R.CATEGORY_INFO_DEFAULT)).alias("category_info"),
                   risk_indicator().alias("risk_indicator")))
    out_cols = cols + ["description", "category_info", "risk_indicator"]
    by_id = cat.select(F.concat(F.lit("i:"), F.col("prod_id").cast("string")).alias("_key"), *out_cols)
    by_name = (cat.groupBy(F.concat(F.lit("n:"), F.lower("name")).alias("_key"))
               .agg(F.min_by(F.struct(*out_cols), F.col("prod_id")).alias("_p"))
               .select("_key", "_p.*"))
    lookup = broadcast_bounded(by_id.unionByName(by_name), 2 * MAX_CATALOGUE)
    pid = int_or_null("identifier")
    key = F.when(pid.isNotNull(), F.concat(F.lit("i:"), pid.cast("string"))) \
           .otherwise(F.concat(F.lit("n:"), F.lower(F.col("identifier"))))
    req = requests.select("request_id", "identifier", key.alias("_key"))
    out = req.join(lookup, "_key", "left")
    names = constant(catalogue_names(products), "array<string>")
    available = F.when(F.col("prod_id").isNull(), F.array_join(names, ", "))
    return out.select("request_id", "identifier", F.col("prod_id").isNotNull().alias("matched"), *out_cols,
                      available.alias("available"))


def catalogue_names(products: DataFrame) -> list[str]:
    """Product names in id order (size-checked)."""
    rows = collect_bounded(products.select("prod_id", "name"), MAX_CATALOGUE)
    return [r["name"] for r in sorted(rows, key=lambda r: r["prod_id"]) if r["name"] is not None]


def product_list(products: DataFrame) -> DataFrame:
    """Catalogue listing in id order."""
    short = F.col("short_desc") if "short_desc" in products.columns else F.lit(None).cast("string").alias("short_desc")
    return products.select("prod_id", "name", "category", "price", "risk_class", short).orderBy("prod_id")


# ------------------------------------------------------------- expressions ---
def income_level_dist(customers: DataFrame) -> DataFrame:
    """P6 distribution: customers per income level."""
    return customers.groupBy(income_level("revenue").alias("income_level")).agg(
        F.count(F.lit(1)).alias("customers"))


def with_age_bucket(customers: DataFrame, ref_date: str) -> DataFrame:
    """Birthday-aware age and bucket at a fixed reference date."""
    ref = F.lit(ref_date).cast("date")
    from ledgerlens.functions.expressions import age_years
    return customers.select("cust_id", "birth_date", age_years("birth_date", ref).alias("age"),
                            age_bucket("birth_date", ref).alias("age_bucket"))


def financing_need(requests: DataFrame) -> DataFrame:
    """need = price - equity, loan-to-value % = need / price * 100."""
    need = F.col("purchase_price") - F.col("equity")
    return requests.select("request_id", "cust_id", "purchase_price", "equity",
                           need.alias("financing_need"),
                           (need / F.nullif(F.col("purchase_price"), F.lit(0.0)) * F.lit(100.0)).alias("ltv_ratio"))


def customer_labels(customers: DataFrame) -> DataFrame:
    """Display label and the id parsed back from it."""
    from ledgerlens.functions.expressions import parse_customer_label
    lbl = customer_label("first_name", "last_name", "cust_id")
    return customers.select("cust_id", lbl.alias("label")).withColumn("parsed_id", parse_customer_label("label"))


# ------------------------------------------------------------------ joins ---
def portfolio(ownership: DataFrame, products: DataFrame) -> DataFrame:
    """Ownership with catalogue attributes; clashing columns renamed
    ``individual_*`` (ownership) and ``catalogue_*`` (product)."""
    cat = broadcast_bounded(products.select(
        "prod_id", "name", "category", "price",
        F.col("interest_rate").alias("catalogue_interest_rate"),
        F.col("risk_class").alias("catalogue_risk_class")), MAX_CATALOGUE)
    kind = F.col("credit_type") if "credit_type" in ownership.columns else F.lit(None).cast("string").alias("credit_type")
    own = ownership.select("cust_id", "prod_id", "since_date", "deal_volume", "adviser_id", kind,
                           F.col("interest_rate").alias("individual_interest_rate"),
                           F.col("risk_class").alias("individual_risk_class"))
    return own.join(cat, "prod_id", "left")


def revenue_per_product_customer(sales: DataFrame, products: DataFrame) -> DataFrame:
    """A4 + J2: revenue and sale count per (customer, product) with the product name."""
    agg = sales.groupBy("cust_id", "prod_id").agg(money_sum("amount").alias("revenue"),
                                                 F.count("amount").alias("sales"))
    return agg.join(broadcast_bounded(products.select("prod_id", "name"), MAX_CATALOGUE), "prod_id")


# ------------------------------------------------------------- aggregates ---
def snapshot_sales(sales: DataFrame) -> DataFrame:
    """A1: total, number and mean amount per customer."""
    return sales.groupBy("cust_id").agg(money_sum("amount").alias("total_sales"),
                                        F.count(F.lit(1)).alias("transactions"),
                                        exact_avg("amount").alias("avg_sale"))


def snapshot_portfolio(ownership: DataFrame, products: DataFrame) -> DataFrame:
    """A2: number of products and annual fees (unknown products add no fee)."""
    p = broadcast_bounded(products.select("prod_id", "price"), MAX_CATALOGUE)
    return (ownership.select("cust_id", "prod_id").join(p, "prod_id", "left")
            .groupBy("cust_id").agg(F.count(F.lit(1)).alias("products"),
                                    F.coalesce(money_sum("price"), F.lit(0.0)).alias("annual_fees")))


def snapshot(customers: DataFrame, ownership: DataFrame, products: DataFrame, sales: DataFrame) -> DataFrame:
    """A3: master data + portfolio totals + sales totals for every customer."""
    out = (customers.select("cust_id", "first_name", "last_name", "location", "age_bucket", "revenue",
                            "credit_score")
           .join(snapshot_portfolio(ownership, products), "cust_id", "left")
           .join(snapshot_sales(sales), "cust_id", "left"))
    return out.select("cust_id", "first_name", "last_name", "location", "age_bucket", "revenue", "credit_score",
                      F.coalesce("products", F.lit(0)).cast("bigint").alias("products"),
                      F.coalesce("annual_fees", F.lit(0.0)).alias("annual_fees"),
                      F.coalesce("total_sales", F.lit(0.0)).alias("total_sales"),
                      F.coalesce("transactions", F.lit(0)).cast("bigint").alias("transactions"),
                      "avg_sale")


def revenue_per_product(sales: DataFrame) -> DataFrame:
    """A5: revenue and sales per product over all customers."""
    return sales.groupBy("prod_id").agg(money_sum("amount").alias("revenue"),
                                        F.count("amount").alias("sales"))


def sales_overview(sales: DataFrame, ownership: DataFrame) -> DataFrame:
    """Totals, mean, sales per owned pair, distinct customers and products."""
    s = sales.agg(money_sum("amount").alias("total_amount"), exact_avg("amount").alias("avg_amount"),
                  F.count(F.lit(1)).alias("sales"), F.countDistinct("cust_id").alias("customers"),
                  F.countDistinct("prod_id").alias("products"))
    owned_pairs = ownership.select(F.count(F.lit(1))).scalar()  # scalar subquery, no join
    return s.select(
        "total_amount", "avg_amount", "sales", "customers", "products", owned_pairs.alias("owned_pairs"),
        (F.col("sales").cast("double") / F.nullif(owned_pairs.cast("double"), F.lit(0.0)))
        .alias("sales_per_owned_pair"))


def value_at_ranks(df: DataFrame, c: str, ranks=None, rank_fn=None, buckets: int = 4096,
                   max_local: int = 100_000) -> dict:
    """Exact k-th smallest non-null values of ``c`` (1-based ranks).

    ``ranks`` is a list, or ``rank_fn(n)`` derives it from the number of
    non-null rows.  Distributed selection by histogram refinement: the
    distinct-value histogram ``(value, rows)`` is a hash aggregate; while a
    value range holds more than ``max_local`` distinct values, one pass counts
    rows per range bucket (at most ``buckets`` rows reach the driver) and only
    the buckets holding a wanted rank are refined.  A small enough range is
    ranked directly.  No group, task or driver ever holds all values.
    """
    from pyspark import StorageLevel
    hist = (df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("double").alias("v"))
            .agg(F.count(F.lit(1)).alias("n")).persist(StorageLevel.MEMORY_AND_DISK))
    out: dict = {}
    try:
        top = hist.agg(F.count(F.lit(1)).alias("d"), F.min("v").alias("lo"), F.max("v").alias("hi"),
                       F.sum("n").alias("rows")).first()
        total = int(top["rows"] or 0)
        wanted = sorted({int(r) for r in (rank_fn(total) if rank_fn else ranks)})
        if any(r < 1 or r > total for r in wanted):
            raise ValueError(f"ranks {wanted} outside 1..{total} for {c}")
        # work items: (lo, hi, rows before lo, ranks inside, distinct values inside)
        work = [(top["lo"], top["hi"], 0, wanted, top["d"])] if wanted else []
        while work:
            lo, hi, before, rks, d = work.pop()
            sub = hist.where(F.col("v").between(lo, hi))
            if d <= max_local or lo == hi:
                acc, todo = before, list(rks)
                for r in sub.orderBy("v").collect():
                    acc += r["n"]
                    while todo and acc >= todo[0]:
                        out[todo.pop(0)] = r["v"]
                    if not todo:
                        break
                continue
            width = (hi - lo) / buckets
            b = F.least(F.lit(buckets - 1), F.floor((F.col("v") - F.lit(lo)) / F.lit(width)).cast("int"))
            bins = sorted(sub.groupBy(b.alias("b")).agg(
                F.sum("n").alias("n"), F.count(F.lit(1)).alias("d"),
                F.min("v").alias("lo"), F.max("v").alias("hi")).collect(), key=lambda r: r["b"])
            acc = before
            for r in bins:
                inside = [k for k in rks if acc < k <= acc + r["n"]]
                if inside:
                    work.append((r["lo"], r["hi"], acc, inside, r["d"]))
                acc += r["n"]
    finally:
        hist.unpersist()
    return out


def exact_median(df: DataFrame, c: str, **kw) -> float | None:
    """Median of the non-null values (mean of the two middle values for even counts)."""
    def ranks(n):
        return [(n + 1) // 2, n // 2 + 1] if n else []
    vals = value_at_ranks(df, c, rank_fn=ranks, **kw)
    if not vals:
        return None
    lo_r, hi_r = min(vals), max(vals)
    return vals[lo_r] if lo_r == hi_r else (vals[lo_r] + vals[hi_r]) / 2.0


def exact_mean(column: str) -> Column:
    """Mean over a column's own values from an exact sum; six digits after the point."""
    return F.sum(F.col(column).cast("decimal(28,6)")).cast("double") / F.count(column)


def customer_overview(customers: DataFrame) -> DataFrame:
    """N, mean/min/max/median revenue and credit score.

    The medians are exact and computed by distributed selection
    (:func:`value_at_ranks`), so memory never depends on the number of
    distinct values.
    """
    med_r = exact_median(customers, "revenue")
    med_c = exact_median(customers, "credit_score")
    return customers.agg(
        F.count(F.lit(1)).alias("customers"),
        exact_mean("revenue").alias("revenue_mean"),
        F.min("revenue").alias("revenue_min"), F.max("revenue").alias("revenue_max"),
        F.lit(med_r).cast("double").alias("revenue_median"),
        exact_mean("credit_score").alias("credit_score_mean"),
        F.min("credit_score").alias("credit_score_min"), F.max("credit_score").alias("credit_score_max"),
        F.lit(med_c).cast("double").alias("credit_score_median"))


def age_distribution(customers: DataFrame) -> DataFrame:
    """Customers per age bucket and share of all, ordered by bucket."""
    agg = customers.where(F.col("age_bucket").isNotNull()).groupBy("age_bucket").agg(
        F.count(F.lit(1)).alias("customers"))
    total = F.sum("customers").over(Window.partitionBy())  # over <= #buckets rows
    return agg.withColumn("_total", total).withColumn("share", share("customers", "_total")) \
              .drop("_total").orderBy("age_bucket")


def top_cities(customers: DataFrame, n: int = 5) -> DataFrame:
    """Most frequent locations (ties by name)."""
    return (customers.where(F.col("location").isNotNull()).groupBy("location")
            .agg(F.count(F.lit(1)).alias("customers"))
            .orderBy(F.col("customers").desc(), F.col("location")).limit(n))


def product_penetration(ownership: DataFrame, customers: DataFrame) -> DataFrame:
    """A10: owners per product and share of all customers."""
    owners = ownership.groupBy("prod_id").agg(F.countDistinct("cust_id").alias("owners"))
    total = customers.select(F.count(F.lit(1))).scalar()  # scalar subquery, no join
    return owners.withColumn("_total", total).withColumn("share", share("owners", "_total")).drop("_total")


def products_per_customer(ownership: DataFrame) -> DataFrame:
    """Ownership rows / distinct owning customers."""
    return ownership.agg(F.count(F.lit(1)).alias("ownership_rows"),
                         F.countDistinct("cust_id").alias("owners")).withColumn(
        "products_per_customer",
        F.col("ownership_rows").cast("double") / F.nullif(F.col("owners").cast("double"), F.lit(0.0)))


def credit_stats(ownership: DataFrame) -> DataFrame:
    """Credit rows (with an individual rate): n, mean/min/max rate, mean volume."""
    c = ownership.where(F.col("interest_rate").isNotNull())
    return c.agg(F.count(F.lit(1)).alias("credits"), exact_avg("interest_rate").alias("rate_mean"),
                 F.min("interest_rate").alias("rate_min"), F.max("interest_rate").alias("rate_max"),
                 exact_avg("deal_volume").alias("deal_volume_mean"))


def credit_risk_dist(ownership: DataFrame) -> DataFrame:
    """Credits per individual risk class."""
    return (ownership.where(F.col("interest_rate").isNotNull() & F.col("risk_class").isNotNull())
            .groupBy("risk_class").agg(F.count(F.lit(1)).alias("credits")))


def class_balance(vectors: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Per product, customers with / without it and the share of each class.

    The owners of every product come from one count over the owned positions, the
    others from the number of customers; a class without customers has no row."""
    owners = vectors.select(F.explode("owned").alias("pos")).groupBy("pos").agg(F.count(F.lit(1)).alias("n1"))
    total = vectors.select(F.count(F.lit(1))).scalar()
    both = catalogue.select("pos", "prod_id").join(owners, "pos", "left").withColumns(
        {"_total": total, "n1": F.coalesce("n1", F.lit(0))})
    rows = both.select("prod_id", "_total", F.inline(F.array(
        F.struct(F.lit(0).alias("label"), (F.col("_total") - F.col("n1")).alias("customers")),
        F.struct(F.lit(1).alias("label"), F.col("n1").alias("customers")))))
    return rows.where("customers > 0").withColumn("share", share("customers", "_total")).drop("_total")
