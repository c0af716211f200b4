"""Features (M1-M4), scoring (M7, M8, W3), evaluation (M9-M12) and training (M5, M6)."""

import numpy as np
import pytest

from conftest import rows
from ledgerlens.operators import features as FE
from ledgerlens.operators import models as MD
from ledgerlens.plans import rules as R

CUST = "cust_id long, age_bucket string, revenue long, credit_score int"


def _customers(spark):
    return spark.createDataFrame([(1, "25-39", 40000, 600), (2, "60+", 90000, 700), (3, "18-24", 20000, 500),
                                  (4, "40-59", 150000, 800)], CUST)


def _ownership(spark):
    return spark.createDataFrame([(1, 101), (1, 103), (2, 101), (2, 107)], "cust_id long, prod_id int")


def test_features_fixed_columns_and_zero_rows(spark):
    f = FE.build_features(_customers(spark), _ownership(spark))
    assert f.columns == ["cust_id", "age_bucket", "revenue", "credit_score"] + [f"has_{p}" for p in R.PRODUCT_IDS]
    got = {r["cust_id"]: [r[f"has_{p}"] for p in R.PRODUCT_IDS] for r in f.collect()}
    assert got[1] == [1, 0, 1, 0, 0, 0, 0, 0, 0, 0]
    assert got[3] == [0] * 10 and got[4] == [0] * 10          # no products: a row of zeros
    assert all(v[9] == 0 for v in got.values())                # 110 owned by nobody: all-zero column


def test_scaler_population_std_and_label_order(spark):
    f = FE.build_features(_customers(spark), _ownership(spark))
    sc = FE.fit_scaler(f)
    rev = np.array([40000, 90000, 20000, 150000], dtype=float)
    assert sc.age_labels == ("18-24", "25-39", "40-59", "60+")
    assert sc.revenue_mean == pytest.approx(rev.mean())
    assert sc.revenue_std == pytest.approx(rev.std(ddof=0))
    enc = {r["cust_id"]: r for r in FE.encode_features(f, sc).collect()}
    assert enc[2]["age_bucket_encoded"] == 3 and enc[3]["age_bucket_encoded"] == 0
    assert enc[1]["revenue"] == pytest.approx((40000 - rev.mean()) / rev.std(ddof=0))


def test_scaler_constant_column_divides_by_one(spark):
    df = spark.createDataFrame([(i, "60+", 5000, 700) for i in range(5)], CUST)
    sc = FE.fit_scaler(FE.build_features(df, _ownership(spark).limit(0)))
    assert (sc.revenue_std, sc.credit_std) == (1.0, 1.0)


def test_scaler_leaves_nulls_out_and_keeps_fractions(spark):
    df = spark.createDataFrame([(1, None, 100.0, 0.4), (2, "a", None, 0.6), (3, "b", 300.0, None)],
                               "cust_id long, age_bucket string, revenue double, credit_score double")
    sc = FE.fit_scaler(df)
    assert (sc.revenue_mean, sc.revenue_std) == (200.0, 100.0)
    assert sc.credit_mean == pytest.approx(0.5) and sc.credit_std == pytest.approx(0.1)
    got = {r.cust_id: r for r in FE.encode_features(df, sc).collect()}
    assert got[1].age_bucket_encoded is None and got[2].revenue is None and got[3].age_bucket_encoded == 1
    many = spark.range(300).selectExpr("id as cust_id", "cast(id as string) as age_bucket", "1L as revenue", "1 as credit_score")
    assert len(FE.fit_scaler(many).age_labels) == 300


def test_auc_matches_pairwise_count(spark):
    rng = np.random.default_rng(7)
    score = np.round(rng.random(60), 1)           # many ties
    label = (rng.random(60) < 0.4).astype(int)
    data = [(i, 101, float(s), int(y), "test", int(s > 0.5)) for i, (s, y) in enumerate(zip(score, label))]
    pred = spark.createDataFrame(data, "cust_id long, prod_id int, score double, label int, split string, pred int")
    got = MD.auc(pred).collect()[0]["auc"]
    pos, neg = score[label == 1], score[label == 0]
    pairs = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert got == pytest.approx(pairs / (len(pos) * len(neg)))


def test_report_zero_denominators(spark):
    data = [(i, 101, 0.1, 0, "test", 0) for i in range(5)]   # no positives at all
    pred = spark.createDataFrame(data, "cust_id long, prod_id int, score double, label int, split string, pred int")
    rep = {r["class"]: r for r in MD.report(pred).collect()}
    assert (rep["1"]["precision"], rep["1"]["recall"], rep["1"]["f1"], rep["1"]["support"]) == (0.0, 0.0, 0.0, 0)
    assert (rep["0"]["precision"], rep["0"]["recall"], rep["0"]["support"]) == (1.0, 1.0, 5)
    assert rep["macro avg"]["f1"] == pytest.approx(0.5)


def test_age_labels_may_hold_quotes(spark):
    from ledgerlens.operators.features import Scaler, encode_features

    rows = spark.createDataFrame([(1, "it's\\30", 1.0, 2.0)], "cust_id int, age_bucket string, revenue double, credit_score double")
    scaler = Scaler(("a", "it's\\30"), 0.0, 1.0, 0.0, 1.0)
    assert encode_features(rows, scaler).first()["age_bucket_encoded"] == 1
