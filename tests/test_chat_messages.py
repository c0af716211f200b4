"""Chat store, chat analytics, message routing and the streaming variant."""

import datetime as dt
import pathlib

import pytest
from pyspark.sql import functions as F

from conftest import rows
from ledgerlens.operators import chat as CH
from ledgerlens.operators import messages as MS
from ledgerlens.sources import chatstore as CSTORE
from ledgerlens.streaming import intents as ST

MSG = "customer_id long, session_id string, seq long, timestamp timestamp, turn long, role string, content string"
T1, T2, T3 = dt.datetime(2024, 1, 1, 9), dt.datetime(2024, 3, 1, 9), dt.datetime(2024, 2, 1, 9)


def _messages(spark):
    return spark.createDataFrame([
        (1, "s1", 1, T1, 0, "user", "Hello Bank"), (1, "s1", 1, T1, 1, "assistant", None),
        (1, "s2", 2, T2, 0, "user", "need a LOAN"),
        (1, "s3", 3, T3, 0, "user", "loan again"), (1, "s3", 3, T3, 1, "assistant", "ok"),
        (1, "s3", 3, T3, 2, "user", "thanks"),
        (2, "s1", 4, None, 0, "user", "hi")], MSG)


def test_chat_stats_stored_order_and_zero_rows(spark):
    cust = spark.createDataFrame([(1,), (2,), (3,)], "cust_id long")
    out = {r["customer_id"]: r for r in CH.chat_stats(cust, CH.session_counts(_messages(spark))).collect()}
    assert (out[1]["total_sessions"], out[1]["total_messages"]) == (3, 6)
    assert out[1]["avg_messages_per_session"] == 2.0
    # first / last by stored order (seq), not by time: s3 (Feb) is stored after s2 (Mar)
    assert (out[1]["first_chat"], out[1]["last_chat"]) == (T1, T3)
    assert (out[3]["total_sessions"], out[3]["total_messages"], out[3]["avg_messages_per_session"]) == (0, 0, 0.0)
    assert out[3]["first_chat"] is None


def test_latest_and_recent(spark):
    lat = {r["customer_id"]: r["session_id"] for r in CH.latest_session(CH.session_counts(_messages(spark))).collect()}
    assert lat == {1: "s3", 2: "s1"}
    rec = [(r["customer_id"], r["session_id"], r["display_time"]) for r in CH.recent_sessions(CH.session_counts(_messages(spark))).orderBy("place").collect()]
    assert rec[:3] == [(1, "s2", "2024-03-01 09:00:00"), (1, "s3", "2024-02-01 09:00:00"), (1, "s1", "2024-01-01 09:00:00")]
    assert rec[3] == (2, "s1", None)                                   # missing time sorts last


def test_search_case_insensitive_null_safe(spark):
    hits = rows(CH.search_sessions(_messages(spark), "Loan"), "customer_id", "session_id")
    assert hits == [(1, "s2"), (1, "s3")]                                # each session once
    counts = {r["customer_id"]: (r["matching"], r["sessions"]) for r in CH.search_counts(_messages(spark), "loan").collect()}
    assert counts == {1: (2, 3), 2: (0, 1)}


def test_store_round_trip_append_and_delete(spark, tmp_path):
    msgs = _messages(spark)
    path = str(tmp_path / "store")
    CSTORE.write_store(CSTORE.to_records(msgs.where("seq <= 2")), path)
    CSTORE.write_store(CSTORE.to_records(msgs.where("seq > 2")), path, mode="append")
    back = CSTORE.read_store(spark, path)
    assert rows(CSTORE.messages_of(back)) == rows(msgs.select(*CSTORE.messages_of(back).columns))
    assert [r[0] for r in CSTORE.customers_with_chats(back).collect()] == [1, 2]
    # delete: (1, s1) removes that session; (2, null) removes every session of customer 2;
    # (1, nope) removes nothing
    deletes = spark.createDataFrame([(1, "s1"), (2, None), (1, "nope")], "customer_id long, session_id string")
    removed = CSTORE.delete_sessions(spark, path, deletes)
    kept = CSTORE.read_store(spark, path)
    assert rows(CSTORE.sessions_of(kept), "customer_id", "session_id") == [(1, "s2"), (1, "s3")]
    assert rows(removed, "customer_id", "session_id", "removed") == [(1, "nope", 0), (1, "s1", 1), (2, None, 1)]


def _files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in pathlib.Path(path).rglob("part-*")}


def test_delete_touches_only_buckets_with_a_deleted_session(spark, tmp_path):
    path = str(tmp_path / "store")
    msgs = spark.range(400).selectExpr("id % 100 as customer_id", "concat('s', id) as session_id", "id as seq",
                                       "timestamp'2024-01-01 00:00:00' as timestamp", "0L as turn", "'user' as role", "'x' as content")
    CSTORE.write_store(CSTORE.to_records(msgs), path)
    before = _files(path)
    bucket = spark.range(1).select(F.lit(7).cast("long").alias("customer_id")).select(CSTORE.bucket_of()).first()[0]
    removed = CSTORE.delete_sessions(spark, path, spark.createDataFrame(
        [(7, None), (8, "unknown"), (12345, None)], "customer_id long, session_id string"))
    assert rows(removed) == [(12345, None, 0), (7, None, 4), (8, "unknown", 0)]
    after = _files(path)
    changed = {f.split("/")[0] for f in before.keys() ^ after.keys()}
    assert changed == {f"customer_bucket={bucket}"}
    assert all(after[f] == t for f, t in before.items() if not f.startswith(f"customer_bucket={bucket}/"))
    assert CSTORE.sessions_of(CSTORE.read_store(spark, path)).count() == 396
    # Nothing left of any customer: every folder stays readable, and none has sessions.
    CSTORE.delete_sessions(spark, path, msgs.selectExpr("customer_id", "cast(null as string) as session_id"))
    assert CSTORE.read_store(spark, path).count() == 0 and CSTORE.rejects(CSTORE.read_lines(spark, path)).count() == 0


def test_deletion_that_was_cut_off_is_repeated(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    CSTORE.write_store(CSTORE.to_records(_messages(spark)), path)
    deletes = spark.createDataFrame([(1, "s2"), (2, None)], "customer_id long, session_id string")

    def lost(*args, **kwargs):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(CSTORE, "read_store", lost)
        with pytest.raises(RuntimeError):
            CSTORE.delete_sessions(spark, path, deletes)
    assert CSTORE.sessions_of(CSTORE.read_store(spark, path)).count() == 4
    assert rows(CSTORE.unfinished(spark, path), "customer_id", "session_id") == [(1, "s2"), (2, None)]
    assert CSTORE.finish_deletions(spark, path) == 1 and CSTORE.finish_deletions(spark, path) == 0
    assert rows(CSTORE.sessions_of(CSTORE.read_store(spark, path)), "session_id") == [("s1",), ("s3",)]


def test_empty_sessions_stored_counts_and_any_metadata(spark, tmp_path):
    path = str(tmp_path / "store")
    sessions = spark.createDataFrame(
        [(1, "a", 1, T1, 7, {"mood": "good", "n": "3"}), (1, "b", 2, T2, 0, {}), (2, "c", 3, T3, 1, None)],
        "customer_id long, session_id string, seq long, timestamp timestamp, message_count int, metadata map<string,string>")
    msgs = _messages(spark).where("session_id = 's1' AND customer_id = 1").withColumn("session_id", F.lit("a"))
    CSTORE.write_store(CSTORE.to_records(msgs, sessions=sessions), path)
    back = CSTORE.read_store(spark, path)
    got = {r.session_id: (r.message_count, r.metadata) for r in CSTORE.sessions_of(back).collect()}
    assert got["a"] == (7, {"mood": "good", "n": "3"}) and got["b"][0] == 0 and got["c"] == (1, None)
    assert CSTORE.messages_of(back).count() == 2
    stats = CH.chat_stats(spark.createDataFrame([(1,)], "cust_id long"), CSTORE.sessions_of(back)).first()
    assert (stats.total_sessions, stats.total_messages, stats.avg_messages_per_session) == (2, 7, 3.5)
    assert {r.customer_id: r.session_id for r in CH.latest_session(CSTORE.sessions_of(back)).collect()} == {1: "b", 2: "c"}


def test_rejected_lines_are_kept_and_counted(spark, tmp_path):
    path = tmp_path / "store"
    CSTORE.write_store(CSTORE.to_records(_messages(spark)), str(path))
    extra = path / "customer_bucket=3"
    extra.mkdir(exist_ok=True)
    (extra / "part-x.json").write_text('{"customer_id": 1, "session_id"\n{"customer_id": 5, "seq": 1}\n{"session_id": "z"}\n[]x\n'
                                       '{"customer_id": "one", "session_id": "q"}\n')
    lines = CSTORE.read_lines(spark, str(path))
    told = rows(CSTORE.quarantine(lines, str(tmp_path / "aside")))
    assert told == [("malformed", 3), ("no customer_id", 1), ("no session_id", 1)]
    kept = CSTORE.read_store(spark, str(path)).count()
    assert kept + 5 == spark.read.text(str(path)).count()
    aside = spark.read.parquet(str(tmp_path / "aside"))
    assert all("part-x.json" in r.file for r in aside.collect()) and aside.where("line LIKE '%[]x%'").count() == 1


def test_store_splits_long_sessions_into_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(CSTORE, "BLOCK_TURNS", 2)
    recs = CSTORE.to_records(_messages(spark))
    blocks = {r["session_id"]: r["n"] for r in recs.where("customer_id = 1").groupBy("session_id")
              .agg(F.count("*").alias("n")).collect()}
    assert blocks == {"s1": 1, "s2": 1, "s3": 2}
    got = CSTORE.sessions_of(recs)
    assert rows(got, "session_id", "message_count") == [("s1", 1), ("s1", 2), ("s2", 1), ("s3", 3)]


def test_export_csv_round_trip(spark, tmp_path):
    msgs = _messages(spark).withColumn("content", F.concat_ws(", ", F.col("content"), F.lit('a "quoted", b')))
    path = str(tmp_path / "export")
    CSTORE.export_csv(msgs, path)
    back = CSTORE.read_export(spark, path)
    assert rows(back, "session_id", "turn", "content") == rows(msgs, "session_id", "turn", "content")


RULES = [(1, "recommend", ["recommend"]), (2, "snapshot", ["overview"]), (3, "explain", ["price"])]


def test_intent_first_rule_wins(spark):
    df = spark.createDataFrame([(1, "Price overview please"), (2, "recommend a price"), (3, "hello"), (4, None)],
                               "id long, content string")
    got = rows(MS.intents(df, ["id"], RULES), "id", "intent")
    assert got == [(1, "snapshot"), (2, "recommend"), (3, "help"), (4, "help")]


def test_entities_first_digit_run_and_products(spark):
    msgs = spark.createDataFrame([(1, "customer 12 wants 104", 5), (2, "no digits here, about the Card", 7),
                                  (3, "nothing", 0), (4, "ids 999 then 103 then 105", None)],
                                 "msg_id long, text string, context_customer_id long")
    cat = [(101, "Giro", "account"), (103, "Card", "card"), (104, "Life", "insurance"), (105, "Pro", "depot")]
    out = {r["msg_id"]: r for r in MS.entities(msgs, cat).collect()}
    assert (out[1]["customer_id"], out[1]["prod_id"]) == (12, 104)
    assert (out[2]["customer_id"], out[2]["prod_id"], out[2]["status"]) == (7, 103, "ok")
    assert out[3]["status"] == "id_missing" and out[3]["prod_id"] is None
    # the first number is the customer even if it is a product id; product = first id in the catalogue
    assert (out[4]["customer_id"], out[4]["prod_id"]) == (999, 103)


def test_related_by_keyword_pattern_or_two_names(spark):
    msgs = spark.createDataFrame([(1, "what about Kunde 7"), (2, "anna meier called"), (3, "anna anna"),
                                  (4, "an offer"), (5, None)], "id long, content string")
    toks = spark.createDataFrame([("anna",), ("meier",)], "token string")
    got = {r["id"]: (r["related"], r["by_keyword"], r["by_pattern"], r["by_names"])
           for r in MS.related(msgs, ["id"], toks, keywords=["offer"]).collect()}
    assert got[1][2] and got[1][0]
    assert got[2] == (True, False, False, True)
    assert got[3] == (False, False, False, False)        # the same name twice is one distinct token
    assert got[4] == (True, True, False, False)
    assert got[5] == (False, False, False, False)


def _stream_messages(spark):
    return spark.createDataFrame([
        (1, "a", 1, dt.date(2024, 1, 1), 0, "user", "please recommend"),
        (1, "a", 1, dt.date(2024, 1, 1), 1, "assistant", "price is 12"),
        (2, "b", 2, dt.date(2024, 1, 2), 0, "user", None)], ST.MESSAGE_SCHEMA)


def test_stream_equals_batch(spark, tmp_path):
    msgs = _stream_messages(spark)
    src, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    msgs.repartition(2).write.json(src)
    ST.drain(spark, src, out, ckpt, RULES, max_files_per_trigger=1)
    assert rows(ST.read_tags(spark, out)) == rows(ST.tag(msgs, RULES))
    # a restart with the same checkpoint processes nothing twice
    ST.drain(spark, src, out, ckpt, RULES)
    assert ST.read_tags(spark, out).count() == 3 and ST.read_rejects(spark, out).count() == 0


def test_killed_stream_equals_batch(spark, tmp_path):
    """A batch that was written but not noted in the checkpoint runs again."""
    msgs = _stream_messages(spark)
    src, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    msgs.repartition(3).write.json(src)
    ST.drain(spark, src, out, ckpt, RULES, max_files_per_trigger=1)
    noted = sorted(pathlib.Path(ckpt, "commits").glob("[0-9]*"), key=lambda f: int(f.name))
    last = noted[-1]
    last.unlink()
    last.with_name(f".{last.name}.crc").unlink(missing_ok=True)
    msgs.withColumn("session_id", F.lit("later")).write.mode("append").json(src)
    ST.drain(spark, src, out, ckpt, RULES)
    want = rows(ST.tag(msgs.unionByName(msgs.withColumn("session_id", F.lit("later"))), RULES))
    assert rows(ST.read_tags(spark, out)) == want


def test_stream_keeps_bad_lines(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    _stream_messages(spark).coalesce(1).write.json(src)
    pathlib.Path(src, "bad.json").write_text('{"customer_id": 1,\n[]\n{"customer_id": 2, "content": "no id"}\n')
    ST.drain(spark, src, out, ckpt, RULES)
    assert ST.read_tags(spark, out).count() == 3
    assert rows(ST.read_rejects(spark, out)) == [("malformed", "[]"), ("malformed", '{"customer_id": 1,'),
                                                 ("no session_id", '{"customer_id": 2, "content": "no id"}')]


def test_names_that_begin_with_another_or_have_several_words(spark):
    cat = [(1, "Depot", "d"), (2, "Depot Plus", "d"), (3, "DepotBasic", "d"), (4, "Plus Card Gold", "c"), (5, None, "x"),
           (7, "depot", "d")]
    texts = ["my DEPOT PLUS please", "depotbasic", "xdepotx", "plus card gold or depot", "plus card", None, "", "no 7 here"]
    msgs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "msg_id long, text string, context_customer_id long")
    got = {r.msg_id: r.prod_id for r in MS.entities(msgs, cat).collect()}
    assert got == {0: 2, 1: 3, 2: 1, 3: 4, 4: None, 5: None, 6: None, 7: 7}


def test_names_equal_brute_force(spark):
    import random
    rnd = random.Random(8)
    names = list({"".join(rnd.choices("ab ", k=rnd.randrange(1, 6))).strip() for _ in range(150)} - {""})
    cat = [(i, n, "x") for i, n in enumerate(names)]
    texts = ["".join(rnd.choices("abc ", k=30)) for _ in range(200)]
    msgs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "msg_id long, text string, context_customer_id long")
    got = {r.msg_id: r.prod_id for r in MS.entities(msgs, cat).collect()}
    for i, t in enumerate(texts):
        inside = [(-len(n), p) for p, n, _ in cat if n in t]
        assert got[i] == (min(inside)[1] if inside else None)


def test_read_original_session_files(spark, tmp_path):
    """One JSON array of sessions per customer file; a corrupt file adds nothing,
    metadata keys may be missing."""
    import json
    d = tmp_path / "chatlogs"
    d.mkdir()
    (d / "customer_1_chatlogs.json").write_text(json.dumps([
        {"session_id": "20240101_090000", "timestamp": "2024-01-01T09:00:00.123456", "customer_id": 1,
         "messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "hello"}],
         "message_count": 2, "metadata": {"saved_at": "2024-01-01T09:00:01", "api_mode": "mock", "auto_saved": True}},
        {"session_id": "20240102_090000", "timestamp": "2024-01-02T09:00:00", "customer_id": 1,
         "messages": [], "message_count": 0, "metadata": {"saved_at": "x", "api_mode": "mock"}}], indent=2))
    (d / "customer_2_chatlogs.json").write_text("[{not json")
    (d / "customer_3_chatlogs.json").write_text('[{"customer_id": 3, "messages": []}]')
    df = CSTORE.read_session_files(spark, str(d))
    assert rows(CSTORE.rejects(CSTORE.read_session_lines(spark, str(d))), "reason") == [("malformed",), ("no session_id",)]
    got = rows(df, "customer_id", "session_id", "message_count")
    assert got == [(1, "20240101_090000", 2), (1, "20240102_090000", 0)]
    r = df.where("message_count = 0").collect()[0]
    assert "auto_saved" not in r["metadata"] and r["timestamp"] == dt.datetime(2024, 1, 2, 9)
