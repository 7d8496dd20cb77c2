"""Commits, ids, register, gone files, compaction and changing state (S2, S6, S10, P7, ST1, ST8, ST9, L2-L6)."""

import datetime as dt
import glob
import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from test_ingest import _files, _th4
from yieldlens import schemas as K
from yieldlens.operators import ingest as I
from yieldlens.sources import files as SF
from yieldlens.sources.store import Store, Table, bucket_of, changed, numbered
from yieldlens.streaming import ingest as SI
from yieldlens.streaming import line_rates as SL
from yieldlens.streaming import state as ST

TABLES = {"a": Table("id long, text string"), "b": Table("id long, day date", partition=("day",)),
          "s": Table("id long, state string", key="id")}


def rows(spark, *ids):
    return {"a": spark.createDataFrame([(k, f"t{k}") for k in ids], "id long, text string"),
            "b": spark.createDataFrame([(k, dt.date(2024, 1, 1 + k % 3) if k % 4 else None) for k in ids], "id long, day date")}


def ids(df):
    return sorted(r.id for r in df.collect())


def test_a_batch_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"), TABLES)
    assert store.read("a").count() == 0
    assert store.commit(rows(spark, 1, 2), "run", 0, 3)
    write = Store._write

    def fails(self, df, name, part, pack=False):
        if name == "b":
            raise RuntimeError("driver lost")
        write(self, df, name, part, pack)

    monkeypatch.setattr(Store, "_write", fails)
    with pytest.raises(RuntimeError):
        store.commit(rows(spark, 3, 4), "run", 1, 5)
    assert ids(store.read("a")) == ids(store.read("b")) == [1, 2] and store.next_id() == 3
    monkeypatch.setattr(Store, "_write", write)
    assert store.commit(rows(spark, 3, 5), "run", 1, 5)      # the batch again, with other rows
    assert not store.commit(rows(spark, 9), "run", 1, 9)     # a replay
    assert ids(store.read("a")) == ids(store.read("b")) == [1, 2, 3, 5] and store.next_id() == 5
    assert store.commit(rows(spark, 7), "other run", 1, 8)
    assert ids(store.read("a")) == [1, 2, 3, 5, 7]
    day = store.read("b").where("day = DATE '2024-01-02'")
    assert ids(day) == [1, 7] and "PartitionFilters: [(day" in day._jdf.queryExecution().executedPlan().toString()


def test_compaction_bounds_files_and_readers_stay(spark, tmp_path):
    root = str(tmp_path / "s")
    store = Store(spark, root, TABLES, fanout=2)
    early = None
    for k in range(5):
        state = spark.createDataFrame([(k % 2, f"v{k}")], "id long, state string")
        assert store.commit({"b": rows(spark, k)["b"], "s": state}, "run", k, k + 2)
        if k == 1:
            early = store.read("b")
    assert [(c.level, len(c.runs)) for c in store.commits()] == [(2, 1), (0, 1)]
    assert ids(store.read("b")) == list(range(5))
    assert store.has("run", 0) and store.has("run", 4) and not store.has("run", 5) and store.next_id() == 6
    assert {(r.id, r.state) for r in store.newest("s").collect()} == {(0, "v4"), (1, "v3")}
    assert ids(early) == [0, 1]                              # opened before the last rewrite, still there
    assert store.vacuum(3600) == 0
    assert store.vacuum(-1) > 0
    assert len(os.listdir(f"{root}/b")) == len(glob.glob(f"{root}/_commits/seq=*")) == 2
    assert ids(store.read("b")) == list(range(5)) and store.has("run", 3)


def test_another_writer_is_noticed(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"), TABLES)
    write = Store._write

    def slowly(self, df, name, part, pack=False):            # the other one commits while this one writes
        monkeypatch.setattr(Store, "_write", write)
        Store(spark, self.root, TABLES).commit(rows(spark, 1), "run", 0)
        write(self, df, name, part, pack)

    monkeypatch.setattr(Store, "_write", slowly)
    with pytest.raises(RuntimeError, match="another writer"):
        store.commit(rows(spark, 2), "other", 0)
    assert ids(store.read("a")) == [1]


def test_numbered_and_changed(spark, tmp_path):
    src = spark.range(1000).select((F.hash("id") % 50).alias("t"), F.col("id").alias("k"))
    src.repartitionByRange(7, "t", "k").withColumn("_p", F.spark_partition_id()).write.parquet(str(tmp_path / "r"))
    got = numbered(spark.read.parquet(str(tmp_path / "r")), "_p", ["t", "k"], 11).orderBy("t", "k").collect()
    assert [r.id for r in got] == list(range(11, 1011))
    before = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id long, v string")
    after = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, None)], "id long, v string")
    assert ids(changed(after, before, "id")) == [2, 3, 4] and changed(before, before, "id").count() == 0


def test_ids_follow_the_order_of_insertion(spark, tmp_path):
    root = str(tmp_path / "out")
    batches = [[(f"ic_T{b}_{k}.rslt", "HDR\n" + _th4(track=f"T{b}_{k}") + "\n") for k in range(5)] for b in range(2)]
    for b, batch in enumerate(batches):
        batch[2] = (batch[2][0], "no row")
        SI.process_batch(_files(spark, batch).repartition(3), b, root)
    SI.process_batch(_files(spark, batches[1]), 1, root)     # a replay
    facts = SF.read_table(spark, root, "log_data").orderBy("id").collect()
    assert [r.id for r in facts] == list(range(1, 9))
    assert [r.track_id for r in facts] == [f"T{b}_{k}" for b in range(2) for k in (0, 1, 3, 4)]


def test_register_reads_the_folders_of_the_names_only(spark, tmp_path):
    """As many names as 10,000 batches bring: a lookup opens the folders of its names, in as many files as there are commits."""
    store = SF.ingest_store(spark, str(tmp_path / "out"), fanout=3)
    names = spark.range(400_000).select(F.concat(F.lit("f"), F.col("id"), F.lit(".rslt")).alias("filename"))
    register = names.select("filename", F.lit(None).cast("timestamp_ntz").alias("processed_time"), bucket_of("filename").alias("bucket"))
    for k in range(3):
        store.commit({"processed_files": register.where(F.crc32(F.col("filename").cast("binary")) % 3 == k)}, "run", k)
    some = spark.createDataFrame([("f17.rslt",), ("f399999.rslt",), ("unknown.rslt",), ("f17.rslt",)], "filename string")
    found = store.find("processed_files", some)
    assert sorted(r.filename for r in found.collect()) == ["f17.rslt", "f399999.rslt"]
    folders = {r[0] for r in some.select(bucket_of("filename")).collect()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan
    read = store.read("processed_files").where(F.col("bucket").isin(list(folders)))
    files = read.select(F.col("_metadata.file_path").alias("f")).distinct().count()
    assert files <= len(folders) * len(store.commits()) * 4 and read.count() < 400_000 * (len(folders) + 1) / 60


def test_a_file_gone_between_listing_and_reading_is_recorded(spark, tmp_path):
    src = tmp_path / "in put"
    src.mkdir()
    root, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    for name in ("ic_A1_1.rslt", "ic_B2 x+%_2.rslt", "ic_C3_3.rslt"):
        (src / name).write_text("HDR\n" + _th4(track=name[3:5]) + "\n")

    def batch(df, bid):                                      # the body of ``start_ingest``, after one file has left
        if bid == 0:
            (src / "ic_B2 x+%_2.rslt").unlink()
        SI.process_batch(df, bid, root, "run", listed=SF.listed_files(spark, ck, bid))

    def run():
        (SI.stream_result_files(spark, str(src)).writeStream.option("checkpointLocation", ck).foreachBatch(batch)
         .trigger(availableNow=True).start().awaitTermination())

    # the source merges its log at every second batch
    spark.conf.set("spark.sql.streaming.fileSource.log.compactInterval", "2")
    run()
    assert sorted(r.track_id for r in SF.read_table(spark, root, "log_data").collect()) == ["A1", "C3"]
    assert [(r.filename, r.track_id) for r in SF.read_table(spark, root, "file_gone_log").collect()] == [("ic_B2 x+%_2.rslt", "B2 x+%")]
    (src / "ic_D_1.rslt").write_text("HDR\n" + _th4(track="D") + "\n")
    run()
    assert (tmp_path / "ck" / "sources" / "0" / "1.compact").exists()
    (src / "ic_E_1.rslt").write_text("HDR\n" + _th4(track="E") + "\n")
    SI.start_ingest(SI.stream_result_files(spark, str(src)), root, ck, {"availableNow": True}, result_files=True).awaitTermination()
    spark.conf.unset("spark.sql.streaming.fileSource.log.compactInterval")
    assert SF.read_table(spark, root, "file_gone_log").count() == 1
    assert sorted(r.track_id for r in SF.read_table(spark, root, "log_data").collect()) == ["A1", "C3", "D", "E"]


def test_records_without_a_file_name_all_stay(spark, tmp_path):
    root = str(tmp_path / "out")
    value = '{"track_id": "%s", "process": "UCT", "status": "P", "timestamp": "2024-01-05 10:00:00"}'

    def batch(tracks, at):
        data = [(t, value % t, 0, at + k) for k, t in enumerate(tracks)]
        return I.from_envelope(spark.createDataFrame(data, "key string, value string, partition int, offset long"))
    SI.relay_batch(batch(["T1", "T2"], 0), 0, root)
    SI.relay_batch(batch(["T3"], 2), 1, root)
    facts = SF.read_table(spark, root, "log_data").orderBy("id").collect()
    assert [(r.id, r.track_id, r.filename) for r in facts] == [(1, "T1", ""), (2, "T2", ""), (3, "T3", "")]
    assert SF.read_table(spark, root, "duplicate_files").count() == 0


def test_genuine_replacement_characters_stay(spark, tmp_path):
    text = "a\ufffdb\ufdd0c\ufdd0\ufdd2d\ufdd1"
    (tmp_path / "a_rslt.txt").write_bytes(b"\xff" + text.encode() + b"\xc3")
    assert SF.read_result_files(spark, str(tmp_path)).first().content == text


# --- state -----------------------------------------------------------------------

def message(spark, *sent):
    return spark.createDataFrame([(k, dt.datetime(2024, 1, 30, 12, m), "eng", kind, text) for k, m, kind, text in sent], K.MESSAGES)


def breach(spark, hour, line="L1"):
    t = dt.datetime(2024, 1, 30, hour)
    return spark.createDataFrame([(t, line, "S1", "UCT", "P", None, 12), (t, line, "S1", "UCT", "F", "TC_A_01", 8)],
                                 "window_end timestamp_ntz, line string, station string, process string, status string, "
                                 "failed_testcode string, units long")


def test_a_resolved_alert_lets_its_line_alert_again(spark, tmp_path):
    root = str(tmp_path / "state")
    alerts = lambda: [(r.id, r.line, r.resolved, r.resolved_at) for r in SL.alert_table(spark, root, "failure_alerts").orderBy("id").collect()]
    SL.alert_batch(breach(spark, 11), 0, root)
    SL.alert_batch(breach(spark, 12), 1, root)               # still open
    assert alerts() == [(1, "L1", 0, None)]
    ST.message_batch(message(spark, (1, 5, "text", "RCA:1:loose cable"), (2, 9, "button", "resolve_1"), (3, 10, "text", "RESOLVE:1"),
                             (4, 11, "text", "RESOLVE:77"), (5, 12, "text", "hello"), (6, 20, "text", "capa:1:train")), 0, root)
    ST.message_batch(message(spark, (9, 1, "text", "RCA:1:replayed")), 0, root)
    assert alerts() == [(1, "L1", 1, "2024-01-30 12:09:00")]
    store = ST.state_store(spark, root)
    repair = store.newest("repair_actions").collect()
    assert [(r.status, r.rca_text, r.capa_text, r.closed_at, r.updated_at) for r in repair] == [
        ("Closed", "loose cable", "train", "2024-01-30 12:09:00", "2024-01-30 12:20:00")]
    assert {r.msg_id: r.outcome for r in store.read("rejected_messages").collect()} == {4: "alert not found", 5: "unknown command"}
    assert {r.msg_id: r.ok for r in store.read("resolve_results").collect()} == {2: True, 3: False, 4: False}
    SL.alert_batch(breach(spark, 14), 2, root)
    assert alerts() == [(1, "L1", 1, "2024-01-30 12:09:00"), (2, "L1", 0, None)]
    ST.close_all(root, spark, "2024-01-30 15:00:00", "close", 0)
    assert [a[2] for a in alerts()] == [1, 1]
    assert {r.status for r in store.newest("repair_actions").collect()} == {"Closed"}


def test_messages_in_turn_equal_all_at_once(spark, tmp_path):
    sent = [(1, 1, "text", "RCA:1:a"), (2, 2, "photo", "IMG:1:x"), (3, 3, "text", "ACTION:2:b"), (4, 4, "text", "RESOLVE:2"),
            (5, 5, "text", "RCA:2:late"), (6, 6, "text", "RCA:1:c"), (7, 7, "button", "act_3_Cleaned"), (8, 8, "button", "resolve_1")]
    results = []
    for k, cuts in enumerate(([0, 8], [0, 4, 5, 8])):
        root = str(tmp_path / f"s{k}")
        SL.alert_batch(breach(spark, 11, "L0").unionByName(breach(spark, 11, "L1")).unionByName(breach(spark, 11, "L2")), 0, root)
        for b, (i, j) in enumerate(zip(cuts, cuts[1:])):
            ST.message_batch(message(spark, *sent[i:j]), b, root)
        store = ST.state_store(spark, root)
        results.append({n: sorted(map(str, store.newest(n).collect())) for n in ("failure_alerts", "repair_actions", "repair_media")})
    assert results[0] == results[1]


def test_late_rows_are_kept_and_their_windows_evaluated_again(spark, tmp_path):
    def facts(*cells):
        return spark.createDataFrame([(k, "UCT", "M", "L1", "S", s, "", t, d, c, f"{d} {c}") for k, t, s, d, c in cells], K.LOG_DATA)
    first = facts((1, "T1", "P", "2024-01-01", "10:00:00"), (2, "T2", "F", "2024-01-01", "10:05:00"), (3, "T9", "P", "2024-01-02", "10:00:00"))
    late = facts((4, "T1", "F", "2024-01-01", "10:10:00"), (5, "T3", "F", "2024-01-01", "03:00:00"), (6, "T4", "P", "2024-01-02", "09:59:00"))
    root = str(tmp_path / "late")
    SL.late_batch(first, 0, root, within_batch=False)
    SL.late_batch(late, 1, root, within_batch=False)
    SL.late_batch(late, 1, root, within_batch=False)
    kept = SL.late_store(spark, root).read("late_rows")
    assert ids(kept) == [4, 5]
    every = first.unionByName(late)
    want = {tuple(r) for r in SL.stream_line_rates(every).collect()}
    got = SL.settled_rates(SL.stream_line_rates(first.unionByName(late.where("id = 6"))), kept, every)
    assert {tuple(r) for r in got.collect()} == want


def test_a_commit_has_a_file_a_folder_whatever_the_tasks(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), SF.TABLES)
    names = spark.range(0, 400, numPartitions=8).select(
        F.concat(F.lit("n"), "id").alias("filename"), F.lit(None).cast("timestamp_ntz").alias("processed_time"),
        bucket_of(F.concat(F.lit("n"), "id")).alias("bucket"))
    store.commit({"processed_files": names}, "run", 0)
    files = glob.glob(str(tmp_path / "s/processed_files/*/*/*.parquet"))
    folders = {os.path.dirname(f) for f in files}
    assert len(files) == len(folders) <= 64
    assert sum(map(os.path.getsize, files)) < 64 * 100_000               # not a Bloom filter of 1 MB each
    assert store.read("processed_files").count() == 400


def test_message_batches_send_no_table_to_the_driver(spark, tmp_path, monkeypatch):
    plans, path = [], str(tmp_path)
    handle = ST.message_batch

    def seen(messages, *rest):
        ids = messages.select("msg_id")
        plans.append(messages.join(ids.distinct(), "msg_id")._jdf.queryExecution().executedPlan().toString())
        handle(messages, *rest)

    monkeypatch.setattr(ST, "message_batch", seen)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    ST.seed(ST.state_store(spark, f"{path}/state"), spark.createDataFrame([], K.FAILURE_ALERTS), spark.createDataFrame([], K.REPAIR_ACTIONS))
    spark.createDataFrame([(1, dt.datetime(2024, 1, 1), "e", "text", "hello")], K.MESSAGES).write.parquet(f"{path}/messages")
    ST.start_messages(spark.readStream.schema(K.MESSAGES).parquet(f"{path}/messages"), f"{path}/state", f"{path}/ckpt",
                      {"availableNow": True}).awaitTermination()
    assert len(plans) == 1 and "Broadcast" not in plans[0]
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before
    assert ids(ST.state_store(spark, f"{path}/state").read("rejected_messages").withColumnRenamed("msg_id", "id")) == [1]


def test_windows_of_rates_carry_what_rates_need_only(spark):
    facts = spark.range(1).select(*[F.col("id").cast("string").cast(f.dataType).alias(f.name) for f in K.LOG_DATA.fields])
    plan = SL.evaluate_again(facts, facts.withColumn("event_ts", F.lit("2024-01-01").cast("timestamp_ntz")))
    grouped = [x for x in plan._jdf.queryExecution().analyzed().toString().splitlines() if "Aggregate" in x and "max(" in x]
    assert grouped and not any("failed_testcode" in x or "process" in x for x in grouped)


def unit_facts(spark, *rows):
    """Facts from (id, track, line, status, minute of 2024-01-01)."""
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    return spark.createDataFrame([(i, "UCT", "M", line, "S1", s, "A;B" if s == "F" else "", t, f"{at(m):%Y-%m-%d}", f"{at(m):%H:%M:%S}",
                                   f"{at(m):%Y-%m-%d %H:%M:%S}") for i, t, line, s, m in rows], K.LOG_DATA)


UNIT_ROWS = [(1, "T1", "L1", "F", 5), (2, "T2", "L1", "P", 6), (3, None, "L1", "P", 7), (4, " ", "L1", "F", 8), (5, "T1", "L1", "P", 70),
             (6, "T1", "L2", "F", 71), (7, "T3", "L2", "P", 250), (8, "T1", "L2", "F", 300), (9, "T4", "L3", "F", 520), (10, "T4", "L3", "F", 700),
             (11, "T5", "L3", "P", 900), (12, "T5", None, None, 2000)]


def test_windows_of_alerts_hold_the_newest_row_of_each_track(spark, tmp_path):
    facts, got = unit_facts(spark, *UNIT_ROWS), []
    SL.closed_windows(facts, 0, str(tmp_path / "open"), lambda u: got.extend(
        SL.window_counts(u).select("asof", "line", "total", "failed").collect()))
    # the stream's own windows; those that the newest row has not closed are left out
    want = SL.stream_line_rates(facts).where("window_end <= TIMESTAMP_NTZ '2024-01-02 05:20:00'")
    assert {tuple(r) for r in got} == {tuple(r) for r in want.select("window_end", "line", "total", "failed").collect()}
    assert len(got) > 30


def test_alert_job_keeps_open_panes_on_disk_not_as_executor_state(spark, tmp_path):
    results = []
    for name, cuts in (("once", [0, 12]), ("turns", [0, 4, 9, 12])):
        base = str(tmp_path / name)
        for i, j in zip(cuts, cuts[1:]):
            unit_facts(spark, *UNIT_ROWS[i:j]).coalesce(1).write.mode("append").parquet(f"{base}/facts")
            SL.start_alerts(spark.readStream.schema(K.LOG_DATA).parquet(f"{base}/facts"), f"{base}/state", f"{base}/ckpt",
                            {"availableNow": True}, min_samples=2, threshold=20.0).awaitTermination()
        assert not os.path.exists(f"{base}/ckpt/state")          # state stores live on the executors' heap
        assert len(os.listdir(f"{base}/ckpt/open_panes")) == min(2, len(cuts) - 1)
        last = spark.read.schema(SL.PANES).parquet(f"{base}/ckpt/open_panes/batch={len(cuts) - 2}")
        assert [r.id for r in last.select("_m.*").collect()] == [12]
        results.append({n: [str(r) for r in SL.alert_table(spark, f"{base}/state", n).orderBy("id").collect()]
                        for n in ("failure_alerts", "repair_actions")})
    assert results[0] == results[1] and len(results[0]["failure_alerts"]) == len(results[0]["repair_actions"]) > 1
    # a batch whose panes of before are gone fails, as windows over a part of the rows would be wrong
    with pytest.raises(AnalysisException):
        SL.closed_windows(unit_facts(spark, (13, "T9", "L1", "F", 3000)), 9, f"{tmp_path}/once/ckpt/open_panes", lambda u: None)


def test_a_late_or_replayed_batch_changes_no_closed_window(spark, tmp_path):
    seen = lambda rows, bid, got: SL.closed_windows(unit_facts(spark, *rows), bid, str(tmp_path / "open"), lambda u: got.extend(
        (r.window_end.hour, r.line, r.failed_testcode) for r in u.where("minute(window_end) = 0").collect()))
    first, late, again = [], [], []
    seen([(1, "T1", "L1", "F", 5), (2, "T2", "L1", "P", 605)], 0, first)
    assert sorted(first) == [(h, "L1", "A;B") for h in (1, 2, 3, 4)]
    more = [(3, "T3", "L2", "F", 300), (4, "T2", "L1", "F", 400), (5, "T9", "L9", "P", 1300)]      # 300: closed; 400: still open
    seen(more, 1, late)
    assert sorted(late) == [(h, "L1", "A;B") for h in (7, 8, 9, 10)] + [(h, "L1", "") for h in (11, 12, 13, 14)]
    seen(more, 1, again)
    assert sorted(again) == sorted(late)


def test_what_an_alert_batch_holds_is_read_again(spark, tmp_path, monkeypatch):
    """The rows are copied into their windows for the counts and for the alerts' own rows, not for each table that is written."""
    leaves = []
    known = SL.L.open_alerts

    def seen(*args):
        out = known(*args)
        for df in out:
            found = df._jdf.queryExecution().withCachedData().collectLeaves()
            leaves.extend(str(found.apply(i).output()) for i in range(found.size()))
        return out

    monkeypatch.setattr(SL.L, "open_alerts", seen)
    SL.closed_windows(unit_facts(spark, *UNIT_ROWS), 0, str(tmp_path / "open"),
                      lambda u: SL.alert_batch(u, 0, str(tmp_path / "state"), 2, 20.0))
    assert any("asof" in x for x in leaves) and not any("next_end" in x for x in leaves)
