
import pytest
from pyspark.sql import functions as F

from conftest import rows
from ledgerlens.operators import recommend as RC
from ledgerlens.operators import scoring as SC
from ledgerlens.plans import rules as R

SCORED = "cust_id long, prod_id int, score double"


def _roles(spark, scenarios):
    return spark.createDataFrame(RC.scenario_role_rows(scenarios), "scenario string, prod_id int, role string")


def test_topk_ties_in_catalogue_order(spark):
    df = spark.createDataFrame(
        [(1, 105, 1.0), (1, 103, 1.0), (1, 101, 0.2), (1, 104, 1.0), (2, 101, 0.3)], SCORED)
    out = RC.recommend_topk(df, 2)
    assert rows(out, "cust_id", "rank", "prod_id") == [(1, 1, 103), (1, 2, 104), (2, 1, 101)]


def test_topk_at_most_k_per_customer(spark):
    data = [(c, p, ((c * 7 + p) % 11) / 10.0) for c in range(20) for p in R.PRODUCT_IDS]
    out = RC.recommend_topk(spark.createDataFrame(data, SCORED), 3)
    counts = {r["cust_id"]: r["n"] for r in out.groupBy("cust_id").agg(F.count("*").alias("n")).collect()}
    assert set(counts.values()) == {3} and len(counts) == 20


def test_holistic_is_plain_topk(spark):
    data = [(1, p, 0.1 * (p - 100)) for p in R.PRODUCT_IDS]
    df = spark.createDataFrame(data, SCORED)
    out = RC.recommend_scenario(df, _roles(spark, [R.HOLISTIC]), 3)
    assert rows(out, "rank", "prod_id", "score") == [(1, 110, 1.0), (2, 109, 0.9), (3, 108, 0.8)]


def test_quota_pick_real_estate(spark):
    # k=5: np = min(4, max(1, 2)) = 2 primaries, nc = min(3, 3) = 3 cross-sells, 0 other.
    data = [(1, p, 0.3) for p in R.PRODUCT_IDS]
    df = spark.createDataFrame(data, SCORED)
    fh, inv = F.lit(False), F.lit(False)
    out = RC.recommend_scenario(df, _roles(spark, [R.REAL_ESTATE]), 5, first_home_ok=fh, investor_ok=inv)
    got = rows(out, "rank", "prod_id", "role")
    assert [r[2] for r in got] == ["primary", "primary", "cross_sell", "cross_sell", "cross_sell"]
    # primaries (x2.0 = 0.6) in catalogue order, then cross-sells (x1.3 = 0.39)
    assert [r[1] for r in got] == [107, 108, 101, 104, 106]


def test_leftover_slots_only_from_other(spark):
    # protection: primaries 104, 106; cross 101.  Owning 106 and 101 leaves one primary, no cross.
    data = [(1, p, 0.4) for p in R.PRODUCT_IDS if p not in (106, 101)]
    df = spark.createDataFrame(data, SCORED)
    out = RC.recommend_scenario(df, _roles(spark, ["protection"]), 4)
    got = rows(out, "rank", "prod_id", "role")
    # np = min(1, 2) = 1; nc = min(0, 3) = 0; other fills 3 slots (0.04 each, catalogue order)
    assert got == [(1, 104, "primary"), (2, 102, "other"), (3, 103, "other"), (4, 105, "other")]


def test_unknown_scenario_all_primary_but_scaled(spark):
    data = [(1, p, 0.1) for p in R.PRODUCT_IDS]
    df = spark.createDataFrame(data, SCORED)
    out = RC.recommend_scenario(df, _roles(spark, ["no_such_scenario"]), 5)
    got = rows(out, "rank", "prod_id", "role", "score")
    # only max(1, k // 2) = 2 rows come back, every product x2.0
    assert got == [(1, 101, "primary", 0.2), (2, 102, "primary", 0.2)]


def test_scores_clamped_after_bonus(spark):
    df = spark.createDataFrame([(1, 110, 0.4), (1, 109, 0.3), (1, 107, 0.1)], SCORED)
    out = RC.recommend_scenario(df, _roles(spark, [R.REAL_ESTATE]), 2)
    got = {r["prod_id"]: r["score"] for r in out.collect()}
    # 110: 0.4 * 2.0 * 1.5 = 1.2 -> clamped to 1.0 (ltv missing counts as 80 <= 90)
    assert got[110] == 1.0
    assert all(0.0 <= s <= 1.0 for s in got.values())


def test_bonus_thresholds(spark):
    df = spark.createDataFrame([(90.0, 500000.0), (90.01, 500000.01), (None, None)],
                               "ltv double, need double")
    fh, inv = RC.bonus_flags(F.col("need"), F.col("ltv"))
    got = [(r[0], r[1]) for r in df.select(fh, inv).collect()]
    assert got == [(True, False), (False, True), (True, False)]


def test_requests_share_recommendations_per_flag(spark):
    scored = spark.createDataFrame([(1, p, 0.3) for p in R.PRODUCT_IDS], SCORED)
    req = spark.createDataFrame([("a", 1, 100.0, 50.0), ("b", 1, 600000.0, 95.0)],
                                "request_id string, cust_id long, financing_need double, ltv_ratio double")
    out = RC.recommend_for_requests(scored, req, _roles(spark, [R.REAL_ESTATE]), 5)
    a = {r["prod_id"]: r["score"] for r in out.where("request_id = 'a'").collect()}
    b = {r["prod_id"]: r["score"] for r in out.where("request_id = 'b'").collect()}
    assert a[107] == pytest.approx(0.6) and a.get(110) == pytest.approx(0.9)  # first-home bonus x1.5
    # investor x1.3 only: 109 (0.78) leads the primaries, 110 (0.6) loses the tie to 107
    assert b[109] == pytest.approx(0.78) and 110 not in b and sorted(b)[:2] == [101, 104]


def test_top_potential_zero_and_missing_price(spark):
    recs = spark.createDataFrame([(1, 101, 0.5, 1), (1, 999, 0.9, 2)], "cust_id long, prod_id int, score double, rank int")
    products = spark.createDataFrame([(101, "a", 10.0), (999, "b", None)], "prod_id int, name string, price double")
    customers = spark.createDataFrame([(1,), (2,)], "cust_id long")
    out = RC.top_potential(recs, products, customers)
    got = {r["cust_id"]: (r["expected_profit"], r["n_recs"]) for r in out.collect()}
    assert got == {1: (5.0, 1), 2: (0.0, 0)}


def test_best_customer_tie_by_id(spark):
    pot = spark.createDataFrame([(3, 5.0), (2, 5.0), (1, 4.0)], "cust_id long, expected_profit double")
    assert [r["cust_id"] for r in RC.best_customers(pot).collect()] == [2]


def test_bundle_needs_two_recs(spark):
    recs = spark.createDataFrame([(1, 101, 1), (1, 102, 2), (1, 103, 3), (1, 104, 4), (2, 101, 1)],
                                 "cust_id long, prod_id int, rank int")
    products = spark.createDataFrame([(101, "a", 10.0), (102, "b", 20.0), (103, "c", 30.0), (104, "d", 40.0)],
                                     "prod_id int, name string, price double")
    out = RC.bundle_offer(recs, products).collect()
    assert len(out) == 1
    r = out[0]
    assert (r["cust_id"], r["n_recs"], r["bundle_names"]) == (1, 4, "a + b + c")
    assert (r["total_price"], r["bundle_price"], r["saving"]) == (60.0, 54.0, 6.0)


def test_reason_default_and_decoration(spark):
    recs = spark.createDataFrame([(1, 101, "acc", 0.5, "cross_sell", "protection"),
                                  (1, 555, "odd", 0.456, "other", "protection")],
                                 "cust_id long, prod_id int, name string, score double, role string, scenario string")
    customers = spark.createDataFrame([(1, 60000, "25-39")], "cust_id long, revenue long, age_bucket string")
    out = RC.with_reason(recs, customers, R.reason_templates(spark), scenario_col="scenario")
    got = {r["prod_id"]: r["reason"] for r in out.collect()}
    pre, post = R.CROSS_SELL_DECORATION
    assert got[101].startswith(pre) and got[101].endswith(post) and "medium" in got[101]
    assert got[555] == "odd fits your profile with score 46%."


def _random_candidates(spark, n_cust=60, seed=5):
    import random
    rnd = random.Random(seed)
    rows = []
    for c in range(n_cust):
        cands = [(p, int(rnd.random() < 0.3), True, rnd.choice([0.0, 0.25, 0.5, 0.5, 0.75, 1.0, rnd.random()]), i)
                 for i, p in enumerate(R.PRODUCT_IDS)]
        rows.append((c, cands))
    return spark.createDataFrame(
        rows, "cust_id long, cands array<struct<prod_id:int, owned:int, has_model:boolean, score:double, pos:int>>")


def _matrix(products=None):
    rows = {r["prod_id"]: r for r in products.collect()} if products is not None else {}
    arrays = {"prod_ids": list(R.PRODUCT_IDS), "names": [f"p{p}" for p in R.PRODUCT_IDS],
              "prices": [rows[p]["price"] if p in rows else None for p in R.PRODUCT_IDS]}
    return SC.ModelMatrix(arrays, None, None, True)


def _long(cands):
    return cands.selectExpr("cust_id", "inline(cands)").where("owned = 0")


def test_row_local_topk_equals_window(spark):
    cands = _random_candidates(spark)
    cols = ("cust_id", "rank", "prod_id", "score")
    for k in (1, 3, 5):
        assert rows(RC.topk_rows(cands, k), *cols) == rows(RC.recommend_topk(_long(cands), k), *cols)


def test_row_local_scenarios_equal_window(spark):
    cands = _random_candidates(spark)
    scen = list(R.SCENARIOS) + ["no_such_scenario"]
    roles = _roles(spark, scen)
    cols = ("cust_id", "scenario", "rank", "prod_id", "role", "base_score", "score")
    for k in (2, 3, 5):
        assert rows(RC.scenario_rows(cands, _matrix(), scen, k), *cols) == rows(RC.recommend_scenario(_long(cands), roles, k), *cols)


def test_row_local_top_potential_equals_window(spark):
    cands = _random_candidates(spark)
    products = spark.createDataFrame([(p, f"p{p}", None if p == 104 else 10.0 + p % 7) for p in R.PRODUCT_IDS],
                                     "prod_id int, name string, price double")
    customers = cands.select("cust_id")
    a = RC.top_potential_rows(cands, _matrix(products), 3)
    b = RC.top_potential(RC.recommend_topk(_long(cands), 3), products, customers)
    cols = ("cust_id", "expected_profit", "n_recs")
    assert rows(a, *cols) == rows(b, *cols)
    ra = {r["cust_id"]: [x["prod_id"] for x in r["recommendations"]] for r in a.collect()}
    rb = {r["cust_id"]: [x["prod_id"] for x in r["recommendations"]] for r in b.collect()}
    assert ra == rb


def test_row_local_bundles_equal_grouped(spark):
    cands = _random_candidates(spark)
    scen = list(R.SCENARIOS)
    products = spark.createDataFrame([(p, f"p{p}", None if p == 104 else 10.5 + p % 7) for p in R.PRODUCT_IDS],
                                     "prod_id int, name string, price double")
    a = RC.bundle_rows(RC.scenario_lists(cands, _matrix(products), scen, 5), _matrix(products))
    b = RC.bundle_offer(RC.recommend_scenario(_long(cands), _roles(spark, scen), 5), products,
                        by=("cust_id", "scenario"))
    assert rows(a) == rows(b.select(*a.columns)) and a.count() > 0


def test_row_local_requests_equal_window(spark):
    import random
    rnd = random.Random(2)
    cands = _random_candidates(spark, n_cust=25)
    req = spark.createDataFrame(
        [(f"r{i}", rnd.randrange(25), rnd.choice([0.0, 500000.0, 500000.5, 900000.0, None]),
          rnd.choice([50.0, 90.0, 90.5, None])) for i in range(120)],
        "request_id string, cust_id long, financing_need double, ltv_ratio double")
    a = RC.recommend_for_requests_rows(cands, _matrix(), req, 5)
    b = RC.recommend_for_requests(_long(cands), req, _roles(spark, [R.REAL_ESTATE]), 5)
    cols = ("request_id", "cust_id", "rank", "prod_id", "role", "base_score", "score")
    assert rows(a, *cols) == rows(b, *cols) and a.count() > 0


def test_global_rank_equals_one_sort(spark):
    import random
    rnd = random.Random(3)
    data = [(i, rnd.choice([0.0, 1.0, 2.5, rnd.random(), None])) for i in range(3000)] + [(None, 2.5)]
    got = RC.ranked_customers(spark.createDataFrame(data, "cust_id long, expected_profit double").repartition(7))
    assert "Exchange SinglePartition" not in got._jdf.queryExecution().optimizedPlan().toString()
    order = sorted(data, key=lambda r: (r[1] is None, -(r[1] or 0), r[0] is not None, r[0] or 0))
    assert [(r["cust_id"], r["expected_profit"]) for r in sorted(got.collect(), key=lambda r: r["rank"])] == order
    assert sorted(r["rank"] for r in got.collect()) == list(range(1, len(data) + 1))
    assert RC.ranked_customers(got.limit(0).select("cust_id", "expected_profit")).count() == 0


def test_names_fall_back_to_the_id(spark):
    customers = spark.createDataFrame([(1, "Ada", "L"), (2, None, None), (3, None, "M"), (4, "", "")],
                                      "cust_id long, first_name string, last_name string")
    wanted = spark.createDataFrame([(1,), (2,), (3,), (4,), (9,)], "cust_id long")
    got = {r["cust_id"]: r["customer_name"] for r in RC.named_customers(wanted, customers).collect()}
    label = R.CUSTOMER_LABEL
    assert got == {1: "Ada L", 2: label + "2", 3: "M", 4: label + "4", 9: label + "9"}
