"""Parsing, routing, gap accounting, reconciliation and the streams (P1-P8,
A27-A29, J1, S1, S6, ST1-ST9)."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from yieldlens import schemas as K
from yieldlens.operators import gaps as G
from yieldlens.functions import columns as C
from yieldlens.operators import ingest as I
from yieldlens.operators.prepare import prepare
from yieldlens.plans import streams
from yieldlens.sources import files as SF
from yieldlens.sources import fixtures as fx
from yieldlens.streaming import ingest as SI


def _th4(track="T1", time="01/02/24 03:04:05", process="L2AR", station="L1-ST2", status="F",
         f12="", f14="TC_WIFI_RSSI_01", model="M1"):
    f = ["TH4", track, "S", time, process, station, "", "", "", status, "N/A", "", f12, "", f14, "REL.1_2_3",
         "", model, "", ""]
    return ",".join(f)


def _files(spark, rows):
    t0 = dt.datetime(2024, 1, 1)
    data = [(i, name, content, "watchdog", t0 + dt.timedelta(seconds=i)) for i, (name, content) in enumerate(rows)]
    return spark.createDataFrame(data, "file_id long, filename string, content string, source string,"
                                       " file_mtime timestamp_ntz")


def test_parse_and_route(spark):
    rows = [
        ("ic_T1_1.rslt", "HDR,1\r\n" + _th4() + "\r\n"),
        ("ic_T2_2.rslt", "HDR\nTH4,short,row\n" + _th4(track=" T2 ", f14="", f12="TC_AUDIO_LEVEL_03") + "\n"),
        ("ic_T3_3.rslt", "HDR\n" + _th4(track="T3", process="MANUAL") + "\n"),
        ("ic_T4_4.rslt", "HDR only\n"),
        ("ic_T5_5.rslt", None),
        ("ic_T1_1.rslt", "HDR\n" + _th4(track="again") + "\n"),
        ("ic_T6_6.rslt", _th4(track="T6", status=" P ", time="1/2/2024 3:04:05") + "\x1cX"),
        ("ic_T7_7.rslt", _th4(track="T7", f14="", f12="NOT_A_CODE") + "\n"),
    ]
    routed = {r.file_id: r for r in I.route(_files(spark, rows)).collect()}
    assert [routed[i].outcome for i in range(8)] == [
        K.INSERT, K.INSERT, K.R_PROCESS, K.R_NO_TH4, K.R_FILE_GONE, K.R_DUPLICATE, K.INSERT, K.INSERT]
    r0 = routed[0]
    assert (r0.track_id, r0.line, r0.failed_tests, r0.timestamp) == ("T1", "L1", "TC_WIFI_RSSI_01",
                                                                     "2024-01-02 03:04:05")
    assert (routed[1].track_id, routed[1].failed_tests) == ("T2", "TC_AUDIO_LEVEL_03")
    assert routed[3].track_id == "T4" and routed[4].track_id == "T5"
    assert (routed[6].status, routed[6].failed_tests, routed[6].date) == ("P", "", "2024-01-02")
    assert routed[7].failed_tests == ""


def test_envelope_roundtrip(spark):
    rows = [("ic_T1_1.rslt", "HDR\n" + _th4() + "\n")]
    rec = I.records(I.route(_files(spark, rows))).withColumnRenamed("failed_testcode", "failed_tests")
    env = I.to_envelope(rec)
    back = I.from_envelope(env).first()
    assert back.track_id == "T1" and back.filename == "ic_T1_1.rslt" and not back.bad_json
    bad = spark.createDataFrame([("{not json",)], "value string")
    assert I.from_envelope(bad).first().bad_json
    odd = spark.createDataFrame([("k", '"abc"', 7), ("k", "[1]", 8), ("k", None, 9)], "key string, value string, offset long")
    got = I.from_envelope(odd).collect()
    assert all(r.bad_json for r in got) and [(r.key, r.raw, r.offset) for r in got][:2] == [("k", '"abc"', 7), ("k", "[1]", 8)]


def test_rows_without_a_track_column_are_all_kept(spark):
    from yieldlens.operators.dedup import latest_per_track
    facts = spark.createDataFrame([(k, "UCT", "M", "L1", "S", "P", "", "T", "2024-01-30", "10:00:00", "2024-01-30 10:00:00")
                                   for k in range(3)], K.LOG_DATA).drop("track_id")
    assert latest_per_track(facts, "2024-01-30 23:59:59", 1440).count() == 3


def test_undecodable_bytes_are_dropped(spark, tmp_path):
    (tmp_path / "a_rslt.txt").write_bytes(b"TH4\xff,x")
    assert SF.read_result_files(spark, str(tmp_path)).first().content == "TH4,x"


def test_outcomes_add_up_and_gap_report(spark):
    routed = I.route(fx.raw_files(spark, "/root/testdata/sf0.001"))
    counts = {r.outcome: r["count"] for r in routed.groupBy("outcome").count().collect()}
    assert sum(counts.values()) == routed.count() == fx.raw_files(spark, "/root/testdata/sf0.001").count()
    rep = {r.reason: r for r in G.gap_report(routed).collect()}
    seen = rep[K.R_NO_TH4].seen
    assert seen == counts[K.INSERT] + sum(counts.get(k, 0) for k in
                                          [K.R_NO_TH4, K.R_PROCESS, K.R_FILE_GONE, K.R_PARSE_ERR])
    assert G.gap_report(routed, count_no_th4=False).where("reason = 'NO_TH4'").first().pct == 0.0


def test_reconcile_no_fanout(spark):
    facts = fx.log_data(spark, "/root/testdata/sf0.001")
    csv = fx.reconciliation_rows(facts)
    rec = G.reconcile(csv, facts)
    t = G.reconcile_totals(rec).first()
    assert rec.count() == csv.count() == t.inserted and t.matched + t.missing == t.inserted
    assert rec.where(F.col("track_id").startswith("ZZ") & (F.col("found_in_db") == 1)).count() == 0


def test_csv_source_and_hourly_sink(spark, tmp_path):
    p = tmp_path / "mqs.csv"
    p.write_text("Track_ID,Process,Station,Date,Time,Reason\n T1 ,L2AR,L1-S1,2024-01-01,10:00:00, NTF \n"
                 "T2,UCT,,2024-01-01,,\n")
    df = G.read_reconciliation_csv(spark, str(p))
    got = [tuple(r) for r in df.collect()]
    assert got[0] == ("T1", "L2AR", "L1-S1", "2024-01-01", "10:00:00", "NTF") and got[1][5] == ""
    facts = spark.createDataFrame([(1, "L2AR", "M", "L1", "S", "P", "", "T1", "2024-01-01", "09:00:00",
                                    "2024-01-01 09:00:00")], K.LOG_DATA)
    out = {r.track_id: r for r in G.reconcile(df, facts).collect()}
    assert out["T1"].found_in_db == 1 and out["T1"].mqs_timestamp == "2024-01-01 10:00:00"
    assert out["T2"].found_in_db == 0 and out["T2"].mqs_timestamp is None
    skips = spark.createDataFrame([("f", "PROCESS_SKIP", "MANUAL", "T9", "2024-01-01T09:10:00")],
                                  "filename string, reason string, process string, track_id string, timestamp string")
    rep = G.hourly_gap(facts, skips)
    row = rep.first()
    assert (row.hour, row.inserted, row.PROCESS_SKIP, row.total, row.gap_pct) == ("2024-01-01 09:00", 1, 1, 2, 50.0)
    G.write_hourly_csv(rep, str(tmp_path / "gap"))
    assert any(n.endswith(".csv") for n in os.listdir(tmp_path / "gap"))


def test_read_result_files_and_stream_twice(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "ic_T1_1.rslt").write_text("HDR\n" + _th4() + "\n")
    (src / "IC_T2_2.RSLT.txt").write_text("HDR\n" + _th4(track="T2") + "\n")
    (src / "notes.txt").write_text("not a result file")
    batch = SF.read_result_files(spark, str(src))
    assert sorted(r.filename for r in batch.collect()) == ["IC_T2_2.RSLT.txt", "ic_T1_1.rslt"]
    root, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    for _ in range(2):      # run twice: the checkpoint makes the second run a no-op
        q = SI.start_ingest(SI.stream_result_files(spark, str(src)), root, ck, {"availableNow": True})
        q.awaitTermination()
    facts = SF.read_table(spark, root, "log_data")
    assert sorted(r.track_id for r in facts.collect()) == ["T1", "T2"]
    # the same file name arriving again in a later batch is a duplicate, not a new row
    (src / "later").mkdir()
    (src / "later" / "ic_T1_1.rslt").write_text("HDR\n" + _th4(track="T1b") + "\n")
    q = SI.start_ingest(SI.stream_result_files(spark, str(src), recursive=True), root,
                        str(tmp_path / "ck2"), {"availableNow": True})
    q.awaitTermination()
    facts = SF.read_table(spark, root, "log_data")
    assert sorted(r.track_id for r in facts.collect()) == ["T1", "T2"]
    assert SF.read_table(spark, root, "duplicate_files").count() >= 1


def test_replayed_batch_is_idempotent(spark, tmp_path):
    rows = [("ic_T1_1.rslt", "HDR\n" + _th4() + "\n"), ("ic_T3_3.rslt", "HDR\n" + _th4(process="MANUAL") + "\n")]
    batch = _files(spark, rows)
    root = str(tmp_path / "out")
    SI.process_batch(batch, 0, root)
    SI.process_batch(batch, 0, root)          # replay of batch 0
    assert SF.read_table(spark, root, "log_data").count() == 1
    assert SF.read_table(spark, root, "skip_log").count() == 1
    assert SF.read_table(spark, root, "processed_files").count() == 2


def test_stream_equals_batch(spark):
    s = streams.stream_ingest(spark, "/root/testdata/sf0.001")
    b = I.records(I.route(fx.raw_files(spark, "/root/testdata/sf0.001"))).drop("event_ts")
    assert s.count() == b.count() and s.exceptAll(b.select(*s.columns)).count() == 0


def test_hot_file_name_and_hot_track(spark):
    """A third of the input under one file name / one track: results stay whole and exact."""
    from yieldlens.operators.dedup import latest_per_track
    rows = [(f"ic_T{i}_{i}.rslt", "HDR\n" + _th4(track=f"T{i}") + "\n") for i in range(200)]
    rows += [("ic_HOT_1.rslt", "HDR\n" + _th4(track="HOT") + "\n") for _ in range(100)]
    routed = I.route(_files(spark, rows)).cache()
    counts = {r.outcome: r["count"] for r in routed.groupBy("outcome").count().collect()}
    assert counts == {K.INSERT: 201, K.R_DUPLICATE: 99}
    first_hot = routed.where("filename = 'ic_HOT_1.rslt' AND outcome = 'INSERT'").first()
    assert first_hot.file_id == 200                       # earliest (mtime, id) copy wins
    facts = spark.createDataFrame(
        [(i, "L2AR", "M", "L1", "S", "F" if i % 2 else "P", "", "HOT" if i < 300 else f"T{i}", "2024-01-30",
          "10:00:00", f"2024-01-30 {10 + i % 10:02d}:{i % 60:02d}:00") for i in range(900)], K.LOG_DATA)
    latest = latest_per_track(facts, "2024-01-30 23:59:59", 1440)
    hot = latest.where("track_id = 'HOT'").collect()
    assert len(hot) == 1 and latest.count() == 601
    assert hot[0].id == max(i for i in range(300) if (10 + i % 10, i % 60) == max((10 + j % 10, j % 60)
                                                                               for j in range(300)))


def test_dedup_stream_within_watermark(spark, tmp_path):
    src = tmp_path / "staged"
    rows = [("a.rslt", "x", dt.datetime(2024, 1, 1, 10)), ("a.rslt", "y", dt.datetime(2024, 1, 1, 10, 5)),
            ("b.rslt", "z", dt.datetime(2024, 1, 1, 10, 6))]
    spark.createDataFrame(rows, "filename string, content string, file_mtime timestamp_ntz").write.parquet(str(src))
    stream = spark.readStream.schema("filename string, content string, file_mtime timestamp_ntz").parquet(str(src))
    q = (SI.dedup_stream(stream, "1 day").writeStream.format("memory").queryName("dedup_stream_test")
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = sorted(r.filename for r in spark.sql("SELECT * FROM dedup_stream_test").collect())
    assert got == ["a.rslt", "b.rslt"]


def test_csv_by_name_with_quotes(spark, tmp_path):
    p = tmp_path / "mqs.csv"
    p.write_text('Reason,Process,Extra,Track_ID,Date,Time\n"said ""no"",\nthen yes",L2AR,x, T1 ,2024-01-01,10:00:00\n')
    rows = G.read_reconciliation_csv(spark, str(p)).collect()
    assert [tuple(r) for r in rows] == [("T1", "L2AR", "", "2024-01-01", "10:00:00", 'said "no",\nthen yes')]


def test_second_query_on_the_same_root_adds(spark, tmp_path):
    from yieldlens.sources.files import read_table
    root = str(tmp_path / "out")
    for k in (1, 2):
        src = str(tmp_path / f"in{k}")
        rows = [(f"f{k}", f"ic_T{k}_{k}.rslt", "HDR\n" + _th4(track=f"T{k}") + "\n", "watchdog", dt.datetime(2024, 1, k))]
        spark.createDataFrame(rows, SI.RAW_SCHEMA).write.parquet(src)
        SI.start_ingest(SI.stream_raw_rows(spark, src), root, str(tmp_path / f"ck{k}"),
                        trigger={"availableNow": True}, lag_seconds=60).awaitTermination()
    facts = read_table(spark, root, "log_data")
    assert sorted(r.track_id for r in facts.collect()) == ["T1", "T2"] and facts.select("id").distinct().count() == 2
    assert {"id", "event_ts", "event_date"} <= set(facts.columns)
    assert read_table(spark, root, "no_th4_files").count() == 0            # no rows yet, still a table
    assert read_table(spark, root, "rescan_tracking").count() == 2         # found long after their modification
    assert prepare(facts, "span").count() == 2


def test_result_time_takes_any_white_space(spark):
    df = spark.createDataFrame([("01/02/24   10:11:12",), ("01/02/24\t10:11:12",), ("01/02/2410:11:12",)], "t string")
    assert [r[0] for r in df.select(C.parse_result_time("t")).collect()] == ["2024-01-02 10:11:12"] * 2 + [None]


def test_files_gone_after_the_listing_are_recorded(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name in ("A1_rslt.txt", "B2_rslt.txt"):
        (folder / name).write_text("no row here")
    (folder / "other.txt").write_text("x")
    SF.list_result_files(spark, str(folder)).write.parquet(str(tmp_path / "listing"))
    (folder / "B2_rslt.txt").unlink()
    listing = spark.read.parquet(str(tmp_path / "listing"))
    files = SF.with_gone(SF.read_result_files(spark, str(folder)), listing)
    got = {r.filename: (r.outcome, r.track_id) for r in I.route(files).collect()}
    assert got == {"A1_rslt.txt": (K.R_NO_TH4, "A1"), "B2_rslt.txt": (K.R_FILE_GONE, "B2")}


def test_relay_consumer_feeds_the_fact_table(spark, tmp_path):
    from yieldlens.streaming.ingest import relay_batch
    root = str(tmp_path / "out")

    def batch(rows):
        return I.from_envelope(spark.createDataFrame(rows, "key string, value string, partition int, offset long"))

    def msg(track, name):
        return (f'{{"track_id": "{track}", "process": "UCT", "status": "P", "timestamp": "2024-01-05 10:00:00", '
                f'"_filename": "{name}", "_source": "poll"}}')
    first = [("T1", msg("T1", "a_rslt"), 0, 1), ("T2", msg("T2", "a_rslt"), 0, 2), ("T9", "not json", 0, 3)]
    relay_batch(batch(first), 0, root)
    relay_batch(batch(first), 0, root)                                   # replayed
    relay_batch(batch([("T1", msg("T1", "a_rslt"), 0, 4), ("T3", msg("T3", "b_rslt"), 1, 1)]), 1, root)
    facts = SF.read_table(spark, root, "log_data").collect()
    assert sorted((r.track_id, r.filename, str(r.event_date)) for r in facts) == [
        ("T1", "a_rslt", "2024-01-05"), ("T3", "b_rslt", "2024-01-05")]
    assert [(r.key, r.raw) for r in SF.read_table(spark, root, "dead_letters").collect()] == [("T9", "not json")]
    assert SF.read_table(spark, root, "duplicate_files").count() == 2
