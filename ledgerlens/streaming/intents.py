"""Continuous tagging of saved chat messages.

New files of JSON lines arriving in a folder are read as a stream, parsed under a
fixed schema, tagged with intent and customer reference (stateless expressions, so
no watermark or state is needed) and appended to a parquet sink.  A line that is no
message goes to the same sink as a reject, with its reason and its text.

Replay: the checkpoint names the files of every batch, and the sink's own log holds
a batch id once.  A query that was killed between writing a batch and noting it runs
the batch again under the same id, and readers of the sink see it once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.operators.messages import intent_expr
from ledgerlens.plans import rules as R

MESSAGE_SCHEMA = T.StructType([
    T.StructField("customer_id", T.LongType()), T.StructField("session_id", T.StringType()),
    T.StructField("seq", T.LongType()), T.StructField("session_date", T.DateType()),
    T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType())])
CORRUPT = "_corrupt_record"


def tag(messages: DataFrame, rules=R.INTENT_RULES, *more: str) -> DataFrame:
    low = F.lower(F.coalesce(F.col("content"), F.lit("")))
    return messages.select("customer_id", "session_id", "turn", "role",
                           intent_expr(low, rules).alias("intent"),
                           F.regexp_extract(F.col("content"), r"(\d+)", 1).alias("customer_ref"), *more)


def parsed(lines: DataFrame) -> DataFrame:
    """Messages of text lines, with ``reason`` and ``line`` for a line that is none."""
    schema = T.StructType([*MESSAGE_SCHEMA.fields, T.StructField(CORRUPT, T.StringType())])
    record = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    out = lines.select("value", record.alias("r")).select("value", "r.*")
    odd = F.col(CORRUPT).isNotNull() | ~F.ltrim("value").startswith("{") | F.coalesce(F.ltrim("value") == "", F.lit(True))
    reason = F.when(odd, "malformed").when(F.col("session_id").isNull(), "no session_id")
    return out.withColumn("reason", reason).withColumn("line", F.when(F.col("reason").isNotNull(), F.col("value"))).drop(
        "value", CORRUPT)


def start(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str, rules=R.INTENT_RULES,
          available_now: bool = True, max_files_per_trigger: int = 100):
    lines = spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger).text(source_dir)
    tagged = tag(parsed(lines), rules, "reason", "line").withColumn("rejected", F.col("reason").isNotNull().cast("int"))
    writer = (tagged.writeStream.format("parquet").outputMode("append").partitionBy("rejected")
              .option("checkpointLocation", checkpoint_dir))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start(sink_dir)


def drain(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str, rules=R.INTENT_RULES,
          max_files_per_trigger: int = 100) -> None:
    """Process everything available and stop."""
    q = start(spark, source_dir, sink_dir, checkpoint_dir, rules, True, max_files_per_trigger)
    q.awaitTermination()


def read_tags(spark: SparkSession, sink_dir: str) -> DataFrame:
    """The tagged messages (partition pruned)."""
    return spark.read.parquet(sink_dir).filter("rejected = 0").drop("rejected", "reason", "line")


def read_rejects(spark: SparkSession, sink_dir: str) -> DataFrame:
    """``reason, line`` of the lines that are no messages."""
    return spark.read.parquet(sink_dir).filter("rejected = 1").select("reason", "line")
