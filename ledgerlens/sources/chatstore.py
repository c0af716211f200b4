"""Chat session store.

The unit is the session: its id, time, stored message count and the caller's
metadata, with or without messages.  Layout: JSON lines, one record per session
block, partitioned by a bounded ``customer_bucket`` (hash of the customer id)
rather than by customer, so the number of folders stays fixed however many
customers chat.  A session longer than ``BLOCK_TURNS`` messages is split into
several records, so no record grows with one hot session.

Appending is a plain ``mode('append')`` write.  Deleting changes the store in
place: only the buckets that hold a deleted session are written again, with
Spark's dynamic partition overwrite, and a log next to the data says what each
deletion has to do before it starts and what it did once it is through, so one
that was cut off is found and repeated.  Lines that are no session records are
kept in a quarantine table, counted, not dropped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.plans.session import scratch_path

BLOCK_TURNS = 1024
CUSTOMER_BUCKETS = 64

MESSAGE = T.StructType([T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
                        T.StructField("content", T.StringType())])
#: The caller's metadata, whatever its keys.
METADATA = T.MapType(T.StringType(), T.StringType())
RECORD = T.StructType([
    T.StructField("customer_id", T.LongType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("block", T.IntegerType()),
    T.StructField("messages", T.ArrayType(MESSAGE)),
    T.StructField("message_count", T.IntegerType()),  # of the session, on its first block
    T.StructField("metadata", METADATA),
    T.StructField("customer_bucket", T.IntegerType()),
])
# The per-customer JSON-array files of the original tool (one array per file).
SESSION_FILE = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("customer_id", T.LongType()),
    T.StructField("messages", T.ArrayType(T.StructType([T.StructField("role", T.StringType()),
                                                        T.StructField("content", T.StringType())]))),
    T.StructField("message_count", T.IntegerType()),
    T.StructField("metadata", METADATA),
])
CORRUPT = "_corrupt_record"
_TIME = "yyyy-MM-dd'T'HH:mm:ss[.SSS][XXX]"
#: A record that keeps an emptied bucket's folder: a dynamic overwrite replaces only
#: folders that it writes.
EMPTY_BLOCK = -1


def bucket_of(customer: str = "customer_id"):
    return F.pmod(F.xxhash64(F.col(customer).cast("bigint")), F.lit(CUSTOMER_BUCKETS)).cast("int")


def sessions_from(messages: DataFrame, api_mode: str | None = None) -> DataFrame:
    """The sessions of flat messages, with the metadata that the tool itself saves."""
    saved = F.map_from_arrays(F.array(*map(F.lit, ("saved_at", "api_mode", "auto_saved"))), F.array(
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(api_mode).cast("string"), F.lit("true")))
    return messages.groupBy("customer_id", "session_id", "seq", "timestamp").agg(
        F.count(F.lit(1)).cast("int").alias("message_count")).withColumn("metadata", saved)


def to_records(messages: DataFrame, api_mode: str | None = None, sessions: DataFrame | None = None) -> DataFrame:
    """Store records of sessions and their flat messages (customer_id, session_id,
    seq, timestamp, turn, role, content), one per session and block of
    ``BLOCK_TURNS`` turns.

    ``sessions`` (customer_id, session_id, seq, timestamp, message_count, metadata)
    may hold sessions without messages, and any metadata; without it they are
    taken from the messages."""
    keys = ["customer_id", "session_id", "seq", "timestamp"]
    sessions = sessions_from(messages, api_mode) if sessions is None else sessions
    blocks = messages.withColumn("block", (F.col("turn") / F.lit(BLOCK_TURNS)).cast("int")).groupBy(
        "customer_id", "session_id", "seq", "block").agg(F.sort_array(F.collect_list(
            F.struct(F.col("turn").cast("bigint").alias("turn"), "role", "content"))).alias("messages"))
    # Every session has a first block, which carries its count and metadata.
    first = sessions.select(*keys, F.lit(0).alias("block"), F.col("message_count").cast("int").alias("message_count"), "metadata")
    later = blocks.filter("block > 0").join(sessions.select(*keys), ["customer_id", "session_id", "seq"]).select(
        *keys, "block", F.lit(None).cast("int").alias("message_count"), F.lit(None).cast(METADATA).alias("metadata"))
    out = first.unionByName(later).join(blocks, ["customer_id", "session_id", "seq", "block"], "left")
    return out.select(
        F.col("customer_id").cast("bigint").alias("customer_id"), "session_id", F.col("seq").cast("bigint").alias("seq"),
        "timestamp", "block", F.coalesce("messages", F.array().cast(T.ArrayType(MESSAGE))).cast(T.ArrayType(MESSAGE)).alias("messages"),
        "message_count", "metadata", bucket_of().alias("customer_bucket"))


def write_store(records: DataFrame, path: str, mode: str = "overwrite") -> None:
    records.write.mode(mode).partitionBy("customer_bucket").json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line of the store, one row each, parsed under the explicit schema (never
    inferred), with the line itself in ``_corrupt_record`` if it is no JSON object of
    that form.  (Spark's JSON reader makes no row of a line such as ``[]``.)"""
    schema = T.StructType([*RECORD.fields[:-1], T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "timestampFormat": _TIME}
    lines = spark.read.schema(T.StructType([T.StructField("value", T.StringType()), RECORD.fields[-1]])).text(path)
    parsed = F.from_json("value", schema, options)
    odd = F.col("r").isNull() | ~F.ltrim("value").startswith("{")
    return lines.select(F.input_file_name().alias("file"), "value", "customer_bucket", parsed.alias("r")).select(
        *(F.when(~odd, F.col(f"r.{f.name}")).alias(f.name) for f in schema.fields[:-1]),
        F.when(odd, F.col("value")).otherwise(F.col(f"r.{CORRUPT}")).alias(CORRUPT), "customer_bucket", "file")


def _reason():
    return (F.when(F.col(CORRUPT).isNotNull(), "malformed").when(F.col("session_id").isNull(), "no session_id")
            .when(F.col("customer_id").isNull(), "no customer_id"))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The records of the store; what is left out is in :func:`rejects`."""
    lines = read_lines(spark, path).filter(F.coalesce("block", F.lit(0)) != EMPTY_BLOCK)
    return lines.filter(_reason().isNull()).drop(CORRUPT, "file")


def rejects(lines: DataFrame) -> DataFrame:
    """``file, reason, line`` of what :func:`read_lines` or :func:`read_session_lines`
    found and the readers leave out.  Records and rejects are all lines."""
    kept = [c for c in lines.columns if c not in (CORRUPT, "file", "block_marker")]
    marker = F.coalesce(F.col("block"), F.lit(0)) if "block" in lines.columns else F.lit(0)
    return lines.filter((marker != EMPTY_BLOCK) | F.col(CORRUPT).isNotNull()).select(
        "file", _reason().alias("reason"), F.coalesce(CORRUPT, F.to_json(F.struct(*kept))).alias("line")).filter(
        "reason IS NOT NULL")


def quarantine(lines: DataFrame, path: str) -> DataFrame:
    """Writes the rejects to a table and returns their counts: ``reason, rows``."""
    rejects(lines).write.mode("append").parquet(path)
    return lines.sparkSession.read.parquet(path).groupBy("reason").agg(F.count("*").alias("rows"))


def read_session_lines(spark: SparkSession, path: str) -> DataFrame:
    """The original per-customer files, each a JSON array of sessions (``multiLine``:
    one task per file), with the text of an unreadable file in ``_corrupt_record``."""
    schema = T.StructType([*SESSION_FILE.fields, T.StructField(CORRUPT, T.StringType())])
    return (spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT).json(path).withColumn("file", F.input_file_name()))


def read_session_files(spark: SparkSession, path: str) -> DataFrame:
    """The sessions of the original files; an unreadable file, or an entry without
    a session id, is among the rejects of :func:`read_session_lines`."""
    return read_session_lines(spark, path).filter(F.col("session_id").isNotNull() & F.col(CORRUPT).isNull()).drop(
        CORRUPT).withColumn("timestamp", F.try_to_timestamp("timestamp"))


def messages_of(records: DataFrame) -> DataFrame:
    """Store records -> flat messages (inverse of :func:`to_records`)."""
    return records.select("customer_id", "session_id", "seq", "timestamp",
                          F.explode("messages").alias("m")).select(
        "customer_id", "session_id", "seq", "timestamp", "m.turn", "m.role", "m.content")


def sessions_of(records: DataFrame) -> DataFrame:
    """One row per session, empty ones too: the stored count and the metadata."""
    first = records.filter("block = 0")
    return first.select("customer_id", "session_id", "seq", "timestamp",
                        F.col("message_count").cast("bigint").alias("message_count"), "metadata")


def customers_with_chats(records: DataFrame) -> DataFrame:
    """Customer ids that have at least one session, sorted."""
    return records.select("customer_id").distinct().orderBy("customer_id")


# ------------------------------------------------------------------ deletion ---
def _log(spark: SparkSession, path: str) -> str:
    return f"{path.rstrip('/')}_log"


def _told(spark: SparkSession, path: str, deletion: str, state: str, rows: DataFrame) -> None:
    rows.select(F.lit(deletion).alias("deletion"), F.lit(state).alias("state"), "customer_id", "session_id",
                F.col("removed").cast("bigint").alias("removed")).coalesce(1).write.mode("append").parquet(_log(spark, path))


def delete_sessions(spark: SparkSession, path: str, deletes: DataFrame) -> DataFrame:
    """S11 in place: removes the sessions of the listed (customer_id, session_id) pairs;
    a null session_id removes all sessions of that customer.

    Returns the number of sessions removed per request; 0 means there was none.  Only
    buckets that hold such a session are written again."""
    asked = scratch_path(spark, "chat_delete")
    deletes.select(F.col("customer_id").cast("bigint").alias("customer_id"), "session_id").distinct().withColumn(
        "customer_bucket", bucket_of()).write.parquet(asked)
    return _delete(spark, path, spark.read.parquet(asked), uuid.uuid4().hex)


def _delete(spark: SparkSession, path: str, asked: DataFrame, deletion: str) -> DataFrame:
    _told(spark, path, deletion, "begun", asked.withColumn("removed", F.lit(None).cast("bigint")))
    buckets = [r[0] for r in asked.select("customer_bucket").distinct().collect()]  # at most CUSTOMER_BUCKETS
    records = read_store(spark, path).filter(F.col("customer_bucket").isin(buckets))
    one = asked.filter("session_id IS NOT NULL").select("customer_id", "session_id")
    whole = asked.filter("session_id IS NULL").select("customer_id")
    sessions = records.filter("block = 0").select("customer_id", "session_id", "customer_bucket")
    by_one = one.join(sessions, ["customer_id", "session_id"], "left").groupBy("customer_id", "session_id").agg(
        F.count("customer_bucket").alias("removed"))
    by_whole = whole.join(sessions.drop("session_id"), "customer_id", "left").groupBy("customer_id").agg(
        F.count("customer_bucket").alias("removed")).select("customer_id", F.lit(None).cast("string").alias("session_id"), "removed")
    counted = scratch_path(spark, "chat_delete")
    by_one.unionByName(by_whole).write.parquet(counted)
    counted = spark.read.parquet(counted)
    touched = [r[0] for r in counted.filter("removed > 0").select(bucket_of().alias("b")).distinct().collect()]
    if touched:
        kept = records.filter(F.col("customer_bucket").isin(touched)).join(
            one, ["customer_id", "session_id"], "left_anti").join(whole, "customer_id", "left_anti")
        marker = spark.createDataFrame([(EMPTY_BLOCK, b) for b in touched], "block int, customer_bucket int")
        staged = scratch_path(spark, "chat_kept")
        # Written aside first: the overwrite then reads nothing that it replaces.
        kept.select(*RECORD.fieldNames()).unionByName(marker, allowMissingColumns=True).write.parquet(staged)
        spark.read.parquet(staged).repartition("customer_bucket").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("customer_bucket").json(path)
    _told(spark, path, deletion, "done", counted)
    return counted


def unfinished(spark: SparkSession, path: str) -> DataFrame:
    """Requests of deletions that were begun and never done: ``deletion, customer_id,
    session_id``."""
    log = spark.read.parquet(_log(spark, path))
    done = log.filter("state = 'done'").select("deletion").distinct()
    return log.filter("state = 'begun'").join(done, "deletion", "left_anti").select("deletion", "customer_id", "session_id")


def finish_deletions(spark: SparkSession, path: str) -> int:
    """Repeats the deletions that were cut off; how many there were."""
    again = unfinished(spark, path)
    names = [r[0] for r in again.select("deletion").distinct().collect()]
    for name in names:
        requests = again.filter(F.col("deletion") == name).select("customer_id", "session_id").withColumn(
            "customer_bucket", bucket_of())
        asked = scratch_path(spark, "chat_delete")
        requests.write.parquet(asked)
        _delete(spark, path, spark.read.parquet(asked), name)
    return len(names)


def export_csv(messages: DataFrame, path: str) -> None:
    """Flat (customer_id, session_id, timestamp, turn, role, content) CSV with header."""
    (messages.select("customer_id", "session_id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
                     "turn", "role", "content")
     .write.mode("overwrite").option("header", True).option("escape", '"').csv(path))


EXPORT_SCHEMA = T.StructType([
    T.StructField("customer_id", T.LongType()), T.StructField("session_id", T.StringType()),
    T.StructField("timestamp", T.StringType()), T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])


def read_export(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.schema(EXPORT_SCHEMA).option("header", True).option("escape", '"')
            .option("multiLine", True).csv(path))
