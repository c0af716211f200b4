"""Session guarantees: size-checked broadcasts, shared checkpoint folder, lineage cuts."""

from pyspark.sql import functions as F

from ledgerlens.plans import session as S


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_broadcast_only_within_proven_bound(spark):
    big = spark.range(0, 2000).withColumnRenamed("id", "k")
    dim = spark.range(0, 50).withColumnRenamed("id", "k").withColumn("v", F.col("k") * 2)
    inside = big.join(S.broadcast_bounded(dim, 100), "k")
    beyond = big.join(S.broadcast_bounded(dim, 10), "k")
    assert "BroadcastHashJoin" in _plan(inside)
    # beyond the bound no hint is given and the static planner never broadcasts on estimates
    assert "BroadcastHashJoin" not in _plan(beyond)
    assert inside.count() == beyond.count() == 50


def test_no_estimate_based_broadcast(spark):
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "-1"


def test_checkpoint_dir_is_read_from_session(spark):
    d = S.ensure_checkpoint_dir(spark)
    assert d and spark.sparkContext.getCheckpointDir()
    p1, p2 = S.scratch_path(spark, "x"), S.scratch_path(spark, "x")
    assert p1 != p2 and p1.startswith(d.rstrip("/"))


def test_cut_lineage_keeps_rows(spark):
    df = spark.range(0, 100).withColumn("y", F.col("id") % 7)
    cut = S.cut_lineage(df.groupBy("y").count())
    assert sorted(r["count"] for r in cut.collect()) == sorted(r["count"] for r in df.groupBy("y").count().collect())
    assert "Scan ExistingRDD" in _plan(cut) or "LogicalRDD" in cut._jdf.queryExecution().optimizedPlan().toString()
