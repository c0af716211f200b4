"""Readers and sinks of tables, and the model package."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from ledgerlens.operators import models as MD
from ledgerlens.operators import scoring as SC
from ledgerlens.operators.features import Scaler
from ledgerlens.sources import modelstore as MS
from ledgerlens.sources import tables as TB

OWNERSHIP = ("risk_class,cust_id,credit_type,prod_id,since_date,interest_rate,deal_volume,kundenbetreuer_id\n"
             'low,1,"annuity, fixed",107,2023-07-03,3.75,365828.0,\n,2,,102,2024-03-08,,,4\n')


def test_columns_are_matched_by_name(spark, tmp_path):
    (tmp_path / "o.csv").write_text(OWNERSHIP)
    got = TB.read_table(spark, str(tmp_path / "o.csv"), "ownership_csv")
    assert got.schema == TB.OWNERSHIP
    assert [tuple(map(str, r)) for r in got.collect()] == [
        ("1", "107", "2023-07-03", "365828.0", "annuity, fixed", "3.75", "low", "None"),
        ("2", "102", "2024-03-08", "None", "None", "None", "None", "4")]


def test_header_differences_are_listed(spark, tmp_path):
    (tmp_path / "o.csv").write_text(OWNERSHIP.replace("credit_type", "kind"))
    with pytest.raises(TB.HeaderMismatch) as e:
        TB.read_csv(spark, str(tmp_path / "o.csv"), TB.OWNERSHIP)
    assert (e.value.missing, e.value.unknown) == (["credit_type"], ["kind"])


def test_a_second_file_with_another_header_is_refused(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.csv").write_text(OWNERSHIP)
    head, *body = OWNERSHIP.split("\n")
    swapped = head.replace("cust_id,credit_type", "credit_type,cust_id")
    (tmp_path / "t" / "b.csv").write_text("\n".join([swapped, *body]))
    with pytest.raises(Exception, match="(?i)header"):
        TB.read_csv(spark, str(tmp_path / "t"), TB.OWNERSHIP).collect()


def test_values_without_type_are_rejects(spark, tmp_path):
    (tmp_path / "c.csv").write_text("cust_id,first_name,last_name,location,revenue,credit_score,age_bucket\n"
                                    "1,A,B,X,100,600,60+\n2,A,B,X,many,600,60+\n3,A,B,X,,1e9999,\n")
    read = TB.read_csv_checked(spark, str(tmp_path / "c.csv"), TB.CUSTOMERS)
    assert rows(read.rows, "cust_id", "birth_date") == [(1, None)]
    assert rows(read.rejects, "cust_id", "bad_columns") == [("2", ["revenue"]), ("3", ["credit_score"])]
    with pytest.raises(ValueError, match="revenue|credit_score"):
        TB.read_csv(spark, str(tmp_path / "c.csv"), TB.CUSTOMERS)


def test_product_texts_with_quotes_and_commas(spark, tmp_path):
    (tmp_path / "p.csv").write_text("prod_id,name,category,risk_class,price,interest_rate,short_desc,long_desc\n"
                                    '101,G,a,low,89.9,,Short,"Long, with ""quotes"" and more"\n')
    row = TB.read_csv(spark, str(tmp_path / "p.csv"), TB.PRODUCTS).first()
    assert (row.short_desc, row.long_desc) == ("Short", 'Long, with "quotes" and more')


def test_missing_parquet_path(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        TB.read_parquet(spark, str(tmp_path / "none"))


def test_digest_sees_every_value(spark):
    df = spark.createDataFrame([(1, "a", 1.5), (2, None, 2.0)], "i long, s string, d double")
    told = {r.column_name: (r.rows, r.present) for r in TB.column_digests(df, "t").collect()}
    assert told == {"i": (2, 2), "s": (2, 1), "d": (2, 2)}
    other = TB.column_digests(df.withColumn("d", F.col("d") + 0.01), "t")
    assert len(set(rows(other)) - set(rows(TB.column_digests(df, "t")))) == 1


def test_sorted_sink_file_count_and_order(spark, tmp_path):
    rnd = random.Random(1)
    data = [(rnd.choice([7, 7, rnd.randrange(1000)]), i, rnd.random()) for i in range(20_000)]
    df = spark.createDataFrame(data, "a long, b long, x double").repartition(6)
    path = str(tmp_path / "s")
    n = TB.write_sorted(df, path, ["a", "b"], file_bytes=40_000)
    told = TB.sorted_files(spark, path, ["a", "b"]).collect()
    assert n == len(told) > 3 and all(r.inside and r.behind for r in told) and sum(r.rows for r in told) == 20_000
    assert TB.write_sorted(df, path, ["a", "b"]) == 1
    df.write.mode("overwrite").parquet(path)
    assert not all(r.inside and r.behind for r in TB.sorted_files(spark, path, ["a", "b"]).collect())


def test_sorted_sink_small_files_in_few_ranges(spark, tmp_path):
    """Files are cut inside a range's task, more than a thousand of them too, and are known in their order."""
    df = spark.range(0, 6000, numPartitions=5).select((F.col("id") * 7919 % 6000).alias("a"), F.lit("x").alias("_begins"))
    path, few = str(tmp_path / "s"), str(tmp_path / "few")
    n = TB.write_sorted(df, few, ["a"], file_bytes=300)
    names = [r.file for r in TB.sorted_files(spark, few, ["a"]).collect()]
    assert len(names) == n > 3 * len({f.split("-")[1] for f in names})
    assert spark.read.parquet(few).columns == ["a", "_begins"]
    df.coalesce(1).sort("a").write.option("maxRecordsPerFile", 5).parquet(path)
    told = TB.sorted_files(spark, path, ["a"]).collect()
    assert len(told) == 1200 and all(r.inside and r.behind for r in told)
    assert TB.write_sorted(df.limit(0), str(tmp_path / "none"), ["a"], file_bytes=100) > 0
    same = spark.range(300).select(F.lit(1).alias("a"), "id")  # one key, one range
    n = TB.write_sorted(same, str(tmp_path / "same"), ["a"], file_bytes=100)
    told = TB.sorted_files(spark, str(tmp_path / "same"), ["a"]).collect()
    assert len(told) == n > 3 and all(r.inside and r.behind for r in told) and sum(r.rows for r in told) == 300


@pytest.fixture
def package(spark, tmp_path):
    cat = SC.catalogue_positions(spark.createDataFrame([(101, "a", "x", 1.0), (102, "b", "x", 2.0)],
                                                       "prod_id int, name string, category string, price double"))
    models = spark.createDataFrame([(101, 0.5, [1.0, 2.0, 0.25, None, -1.0], 10, 4, 2.0, 3.0, 5)], MD.MODEL_SCHEMA)
    scaler = Scaler(("18-24", "60+", "a'b"), 1.5, 2.0, 3.25, 0.1)
    limits = spark.createDataFrame([(101, 0, 0, 8, 2, 99)], "prod_id int, pos int, label int, rows long, n_test long, threshold long")
    metrics = spark.createDataFrame([(101, 0.75)], "prod_id int, auc double")
    root = str(tmp_path / "package")
    return root, (cat, models, scaler, limits, metrics)


def test_package_round_trip_and_versions(spark, package):
    root, (cat, models, scaler, limits, metrics) = package
    first = MS.save_package(root, cat, models, scaler, limits, metrics)
    second = MS.save_package(root, cat, models.withColumn("intercept", F.lit(9.0)), scaler, limits, metrics)
    back = MS.load_package(spark, root)
    assert back.version == second and back.tables["models"].first().intercept == 9.0
    old = MS.load_package(spark, root, first)
    assert old.tables["models"].collect() == models.collect() and old.scaler == scaler
    assert rows(old.tables["feature_map"]) == [(101, ["age_bucket_encoded", "revenue", "credit_score", "has_102"])]
    assert rows(old.tables["metrics"]) == [(101, 0.75)] and rows(old.tables["thresholds"]) == rows(limits)
    with pytest.raises(ValueError, match="no version"):
        MS.load_package(spark, root, "unknown")


def test_package_without_its_row_is_not_seen(spark, package):
    root, parts = package
    first = MS.save_package(root, *parts)
    cut = "0" * 32  # tables of a save that was cut off before its row
    parts[1].write.parquet(f"{root}/{cut}/models")
    assert MS.load_package(spark, root).version == first
    parts[1].limit(0).write.mode("overwrite").parquet(f"{root}/{first}/models")
    with pytest.raises(ValueError, match="models"):
        MS.load_package(spark, root)
