"""Chat analytics on flat messages.

Inputs are stored sessions (customer_id, session_id, seq, timestamp, message_count)
or flat message rows; ``seq`` is the stored order of sessions.  All per-customer
results are two-level hash aggregates (session, then customer), so a customer
with a third of all sessions is combined map-side; listings are global
range-partitioned sorts, never a window over a customer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.ordering import global_rank


def session_counts(messages: DataFrame) -> DataFrame:
    """Sessions of flat messages, with the number of messages."""
    return messages.groupBy("customer_id", "session_id", "seq", "timestamp").agg(
        F.count(F.lit(1)).alias("message_count"))


def chat_stats(customers: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sessions, messages, mean per session, first and last session time
    (by stored order) for every customer; customers without chats get zeros.

    ``sessions`` is one row per stored session with its stored ``message_count``, so
    a session without messages counts as one."""
    per = sessions.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("total_sessions"),
        F.sum(F.coalesce("message_count", F.lit(0))).alias("total_messages"),
        F.min_by("timestamp", "seq").alias("first_chat"),
        F.max_by("timestamp", "seq").alias("last_chat"))
    out = customers.select(F.col("cust_id").alias("customer_id")).join(per, "customer_id", "left")
    n = F.coalesce("total_sessions", F.lit(0)).cast("bigint")
    msgs = F.coalesce("total_messages", F.lit(0)).cast("bigint")
    return out.select("customer_id", n.alias("total_sessions"), msgs.alias("total_messages"),
                      F.when(n == 0, F.lit(0.0)).otherwise(msgs.cast("double") / n.cast("double"))
                      .alias("avg_messages_per_session"), "first_chat", "last_chat")


def latest_session(sessions: DataFrame) -> DataFrame:
    """The last stored session of each customer, also if it is empty."""
    return sessions.groupBy("customer_id").agg(
        F.max_by(F.struct("session_id", "timestamp", "message_count"), "seq").alias("s")
    ).select("customer_id", "s.session_id", "s.timestamp", "s.message_count")


def recent_sessions(sessions: DataFrame) -> DataFrame:
    """W5 + P17: sessions newest first (missing time last, equal times in stored
    order), display time string, and the row's place in that list."""
    shown = sessions.select("customer_id", "session_id", "seq",
                            F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("display_time"),
                            "timestamp", "message_count")
    return global_rank(shown, [F.col("customer_id").asc_nulls_first(), F.col("timestamp").desc_nulls_last(),
                               F.col("seq").asc_nulls_first()], "place").drop("timestamp")


def search_sessions(messages: DataFrame, term: str) -> DataFrame:
    """Sessions with a message containing ``term`` (case-insensitive), each once.
    A null content never matches."""
    hit = F.lower(F.col("content")).contains(term.lower())
    return (messages.where(hit).select("customer_id", "session_id", "seq").distinct())


def search_counts(messages: DataFrame, term: str) -> DataFrame:
    """'k of n' per customer: matching sessions and all sessions."""
    hit = F.lower(F.col("content")).contains(term.lower())
    s = messages.groupBy("customer_id", "session_id", "seq").agg(F.max(hit.cast("int")).alias("hit"))
    return s.groupBy("customer_id").agg(F.sum(F.coalesce("hit", F.lit(0))).cast("bigint").alias("matching"),
                                        F.count(F.lit(1)).alias("sessions"))
