"""Profiles, KPIs, lookups, cross-sell and credit terms on hand-made frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import rows
from ledgerlens.functions import expressions as X
from ledgerlens.operators import crosssell as CS
from ledgerlens.operators import pricing as PR
from ledgerlens.operators import profile as PF
from ledgerlens.plans import rules as R

PRODUCTS = "prod_id int, name string, category string, risk_class string, price double, interest_rate double"


def _products(spark):
    return spark.createDataFrame([
        (101, "Giro", "account", "low", 60.0, None), (102, "Depot", "depot", "medium", 35.0, None),
        (103, "Card", "card", "low", 85.0, None), (107, "Loan", "mortgage", "medium", 185.0, 3.85),
        (108, "giro", "mortgage", "weird", 210.0, 4.25)], PRODUCTS)


def test_income_level_strict(spark):
    df = spark.createDataFrame([(150000,), (150001,), (50000,), (50001,), (None,)], "r long")
    assert [r[0] for r in df.select(X.income_level("r")).collect()] == ["medium", "high", "low", "medium", "low"]


def test_age_bucket_birthday_aware_and_minors(spark):
    ref = "2025-07-01"
    df = spark.createDataFrame([(dt.date(2000, 7, 1),), (dt.date(2000, 7, 2),), (dt.date(2010, 1, 1),),
                                (dt.date(1965, 7, 2),)], "b date")
    got = df.select(X.age_years("b", F.lit(ref).cast("date")).alias("a"),
                    X.age_bucket("b", F.lit(ref).cast("date")).alias("k")).collect()
    assert [(r["a"], r["k"]) for r in got] == [(25, "25-39"), (24, "18-24"), (15, "60+"), (59, "40-59")]


def test_customer_label_round_trip(spark):
    df = spark.createDataFrame([(7, "Ann", "Lee")], "cust_id long, first_name string, last_name string")
    r = PF.customer_labels(df).collect()[0]
    assert (r["label"], r["parsed_id"]) == ("Ann Lee (ID 7)", 7)


def test_product_explain_id_name_unknown(spark):
    req = spark.createDataFrame([("a", "107"), ("b", "GIRO"), ("c", "nothing"), ("d", "999")],
                                "request_id string, identifier string")
    out = {r["request_id"]: r for r in PF.product_explain(_products(spark), req, R.category_info(spark)).collect()}
    assert out["a"]["prod_id"] == 107 and out["a"]["risk_indicator"] == R.RISK_INDICATOR["medium"]
    # case-insensitive name, first in catalogue order (101 "Giro" before 108 "giro")
    assert out["b"]["prod_id"] == 101 and out["b"]["category_info"] == R.CATEGORY_INFO["account"]
    assert not out["c"]["matched"] and out["c"]["category_info"] is None
    assert not out["d"]["matched"]                          # numeric: looked up by id only


def test_risk_indicator_default(spark):
    req = spark.createDataFrame([("x", "108")], "request_id string, identifier string")
    r = PF.product_explain(_products(spark), req, R.category_info(spark)).collect()[0]
    assert r["risk_indicator"] == R.RISK_INDICATOR_DEFAULT


def test_snapshot_keeps_customers_without_products_or_sales(spark):
    cust = spark.createDataFrame([(1, "a", "b", "X", "25-39", 50000, 600), (2, "c", "d", "Y", "60+", 90000, 700)],
                                 "cust_id long, first_name string, last_name string, location string, "
                                 "age_bucket string, revenue long, credit_score int")
    own = spark.createDataFrame([(1, 101), (1, 555)], "cust_id long, prod_id int")
    sales = spark.createDataFrame([(1, 101, 10.10), (1, 101, 20.20), (1, 101, None)],
                                  "cust_id long, prod_id int, amount double")
    out = {r["cust_id"]: r for r in PF.snapshot(cust, own, _products(spark), sales).collect()}
    assert (out[1]["products"], out[1]["annual_fees"]) == (2, 60.0)        # unknown product adds no fee
    assert (out[1]["total_sales"], out[1]["transactions"]) == (30.3, 3)    # count(*) keeps the null amount
    assert out[1]["avg_sale"] == pytest.approx(15.15)                      # mean over non-null amounts
    assert (out[2]["products"], out[2]["total_sales"], out[2]["transactions"], out[2]["avg_sale"]) == (0, 0.0, 0, None)


def test_portfolio_renames_clashing_columns(spark):
    own = spark.createDataFrame([(1, 107, dt.date(2020, 1, 1), 1e5, 7, 3.1, "high")],
                                "cust_id long, prod_id int, since_date date, deal_volume double, adviser_id long, "
                                "interest_rate double, risk_class string")
    r = PF.portfolio(own, _products(spark)).collect()[0]
    assert (r["individual_interest_rate"], r["catalogue_interest_rate"]) == (3.1, 3.85)
    assert (r["individual_risk_class"], r["catalogue_risk_class"]) == ("high", "medium")


def test_adviser_success_half_up(spark):
    # 1 of 8 = 12.5 %, 1 of 3 = 33.333 %, 2 of 3 = 66.667 %; null adviser ignored
    data = [(1, "closed")] + [(1, "rejected")] * 7 + [(2, "closed"), (2, "x"), (2, "y"),
                                                      (3, "closed"), (3, "closed"), (3, "z"), (None, "closed")]
    sales = spark.createDataFrame(data, "adviser_id long, decision string")
    got = rows(PR.adviser_success(sales), "adviser_id", "success_rate")
    assert got == [(1, 12.5), (2, 33.33), (3, 66.67)]


def test_rejection_reasons_skip_nulls(spark):
    sales = spark.createDataFrame([("rejected", "price"), ("rejected", "price"), ("rejected", None),
                                   ("rejected", "time"), ("closed", "price")], "decision string, reason string")
    assert [tuple(r) for r in PR.rejection_reasons(sales).collect()] == [("price", 2), ("time", 1)]


def test_credit_rate_rules_and_clamp(spark):
    df = spark.createDataFrame([(None, 750, 100000), (4.0, 749, 99999), (3.0, 549, 39999), (8.9, 300, 0),
                                (0.5, 800, 200000)], "base double, s int, r long")
    got = [r[0] for r in df.select(X.credit_rate("base", "s", "r")).collect()]
    assert got == [3.2, 4.0, 4.5, 9.0, 1.0]


def test_credit_risk_and_volume_band(spark):
    df = spark.createDataFrame([(700, 80000), (699, 80000), (600, 50000), (600, 49999)], "s int, r long")
    risk = [r[0] for r in df.select(X.credit_risk_class("s", "r")).collect()]
    assert risk == ["low", "medium", "medium", "high"]
    lo, hi = X.deal_volume_bounds("r")
    bands = [(r[0], r[1]) for r in df.select(lo, hi).collect()]
    assert bands == [(200000, 500000)] * 2 + [(100000, 300000)] * 2   # >= 60000 for the middle band


def test_credit_terms_every_customer_and_credit_product(spark):
    cust = spark.createDataFrame([(1, 120000, 760), (2, 30000, 500)], "cust_id long, revenue long, credit_score int")
    out = PR.credit_terms(cust, _products(spark))
    got = {(r["cust_id"], r["prod_id"]): r for r in out.collect()}
    assert len(got) == 2 * len(R.CREDIT_PRODUCT_IDS)
    assert got[(1, 107)]["interest_rate"] == pytest.approx(3.85 - 0.5 - 0.3)
    assert got[(2, 109)]["interest_rate"] == pytest.approx(4.0 + 1.0 + 0.5)   # no base rate in catalogue -> 4.0
    assert got[(2, 109)]["credit_type"] == R.CREDIT_TYPES[109]


def test_cross_sell_upsell_categories_coverage(spark):
    cat = CS.catalogue_rows(_products(spark))
    cs = CS.CrossSell(cat, edges={101: [103, 102], 102: [105], 103: [101]}, upsell={102: [105]})
    cust = spark.createDataFrame([(1,), (2,), (3,)], "cust_id long")
    own = spark.createDataFrame([(1, 101), (2, 102), (2, 103)], "cust_id long, prod_id int")
    sets = CS.owned_sets(cust, own)
    assert rows(CS.cross_sell(sets, cs), "cust_id", "prod_id") == [(1, 102), (1, 103), (2, 101)]  # 105 not in catalogue
    assert rows(CS.upsell(sets, cs), "cust_id", "to_prod_id") == [(2, 105)]
    miss = {}
    for r in CS.missing_categories(sets, cs).collect():
        miss.setdefault(r["cust_id"], set()).add(r["category"])
    assert miss[3] == {"account", "card", "depot", "mortgage"} and miss[1] == {"card", "depot", "mortgage"}
    cov = {r["cust_id"]: (r["coverage"], r["potential"]) for r in CS.coverage(sets, cs).collect()}
    assert cov == {1: (20.0, "high"), 2: (40.0, "medium"), 3: (0.0, "high")}


def test_age_distribution_shares_sum_to_100(spark):
    df = spark.createDataFrame([("18-24",), ("60+",), ("60+",), (None,)], "age_bucket string")
    out = PF.age_distribution(df).collect()
    assert [r["age_bucket"] for r in out] == ["18-24", "60+"]
    assert sum(r["share"] for r in out) == pytest.approx(100.0)


def test_top_cities_ties_by_name(spark):
    df = spark.createDataFrame([(c,) for c in "bbaaccdde"], "location string")
    assert [r["location"] for r in PF.top_cities(df, 3).collect()] == ["a", "b", "c"]


def test_exact_median_by_selection_matches_numpy(spark):
    import numpy as np
    rng = np.random.default_rng(11)
    vals = np.concatenate([rng.normal(size=3001), np.full(1500, 0.25), rng.integers(0, 5, 700).astype(float)])
    df = spark.createDataFrame([(float(x),) for x in vals] + [(None,)], "x double")
    # tiny max_local forces several refinement passes, including a hot value holding a third of the rows
    got = PF.exact_median(df, "x", buckets=8, max_local=16)
    assert got == float(np.median(vals))
    even = spark.createDataFrame([(float(x),) for x in [5, 1, 4, 2]], "x double")
    assert PF.exact_median(even, "x", buckets=2, max_local=1) == 3.0
    ranks = PF.value_at_ranks(df, "x", [1, len(vals)], buckets=4, max_local=8)
    assert (ranks[1], ranks[len(vals)]) == (float(vals.min()), float(vals.max()))
