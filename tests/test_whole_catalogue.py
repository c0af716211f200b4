"""Every product of the catalogue and every lineitem reach the queries."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL, rows
from ledgerlens.operators import recommend as RC
from ledgerlens.operators import scoring as SC

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="driver test data not present")


@pytest.fixture(scope="module")
def raw():
    con = duckdb.connect()
    for t in ("part", "orders", "lineitem"):
        con.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    yield con
    con.close()


def test_sales_and_ownership_cover_all_brands_and_priorities(spark, raw):
    sold, pairs = raw.execute(
        "select count(*), count(distinct (o_custkey, p_brand)) from orders join lineitem on o_orderkey = l_orderkey "
        "join part on l_partkey = p_partkey").fetchone()
    got = E.queries()["sales_overview"](spark, SF_SMALL).first()
    assert (got["sales"], got["owned_pairs"]) == (sold, pairs)


def test_lookup_takes_every_request(spark, tmp_path):
    """Requests with equity and of any price name their customers, repeated and null ones too."""
    spark.sql("select * from values (1L, 'Customer#1', 1Y, 10.0D, 'AUTOMOBILE'), (2L, 'Customer#2', 2Y, 20.0D, 'BUILDING'), "
              "(3L, 'Customer#3', 3Y, 30.0D, 'MACHINERY') as t(c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment)"
              ).write.parquet(f"{tmp_path}/customer.parquet")
    spark.sql("select * from values (1Y, 'A'), (2Y, 'B'), (3Y, 'C') as t(n_nationkey, n_name)").write.parquet(f"{tmp_path}/nation.parquet")
    spark.sql("select * from values (5L, 1L, 10.0D), (6L, 2L, 9e6D), (7L, 2L, 9e6D), (8L, null, 10.0D) "
              "as t(o_orderkey, o_custkey, o_totalprice)").write.parquet(f"{tmp_path}/orders.parquet")
    got = E.queries()["customer_lookup"](spark, str(tmp_path))
    assert rows(got, "cust_id") == [(1,), (2,)]


def test_features_and_scores_cover_the_catalogue(spark, raw):
    brands = {100 + int(b[6:]) for b, in raw.execute("select distinct p_brand from part").fetchall()}
    features = E.queries()["features"](spark, SF_SMALL)
    assert {int(c[4:]) for c in features.columns if c.startswith("has_")} == brands
    assert {r[0] for r in E.queries()["train_split"](spark, SF_SMALL).select("prod_id").distinct().collect()} == brands


def test_product_without_a_role_is_other(spark):
    cands = spark.sql("select 1L as cust_id, array(named_struct('prod_id', 101, 'owned', 0, 'has_model', true, "
                      "'score', 0.5D, 'pos', 0), named_struct('prod_id', 999, 'owned', 0, 'has_model', false, 'score', 0.5D, 'pos', 1)) as cands")
    matrix = SC.ModelMatrix({"prod_ids": [101, 999]}, None, None, True)
    got = RC.scenario_rows(cands, matrix, ["account_opening"], 3)
    assert rows(got, "prod_id", "role", "score") == [(101, "primary", 1.0), (999, "other", 0.05)]
