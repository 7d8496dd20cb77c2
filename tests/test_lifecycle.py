"""Alert / repair lifecycle (L1-L6, P19-P21, S11, S12) on hand-made state."""

import datetime as dt
import json

from pyspark.sql import functions as F

from yieldlens import schemas as K
from yieldlens.operators import lifecycle as L

ASOF = "2024-01-30 23:59:59"


def _alerts(spark, rows):
    full = []
    for (i, line, sent, resolved) in rows:
        full.append((i, "log_data", line, line + "-S1", 20.0, 10, 2, "[]", sent, resolved,
                     None, None, None, None))
    return spark.createDataFrame(full, K.FAILURE_ALERTS)


def _repairs(spark, rows):
    full = [(i, aid, unit, "L1", "L1-S1", status, None, None, None, None, None, "x", "x", None)
            for (i, aid, unit, status) in rows]
    return spark.createDataFrame(full, K.REPAIR_ACTIONS)


def _msgs(spark, rows):
    base = dt.datetime(2024, 1, 30, 10, 0, 0)
    return spark.createDataFrame([(i, base + dt.timedelta(minutes=m), "eng", kind, text)
                                  for (i, m, kind, text) in rows], K.MESSAGES)


def test_parse_messages(spark):
    msgs = _msgs(spark, [(1, 0, "text", "RCA:5:root cause"), (2, 0, "text", "rca:5: a: b"),
                         (3, 0, "text", "RCA::x"), (4, 0, "text", "RCA:abc:x"), (5, 0, "text", "RESOLVE:"),
                         (6, 0, "text", "hello"), (7, 0, "photo", "IMG:5"), (8, 0, "button", "act_5_Cleaned parts"),
                         (9, 0, "button", "resolve_5"), (10, 0, "photo", "IMG:x:y")])
    got = {r.msg_id: (r.action, r.field, r.value, r.alert_id, r.outcome)
           for r in L.parse_messages(msgs).collect()}
    assert got[1] == ("response", "rca_text", "root cause", 5, "ok")
    assert got[2] == ("response", "rca_text", "a: b", 5, "ok")
    assert got[3][4] == "format" and got[4][4] == "id not a number" and got[5][4] == "format"
    assert got[6][4] == "unknown command"
    assert got[7] == ("media", None, "", 5, "ok")
    assert got[8] == ("response", "action_taken", "Cleaned parts", 5, "ok")
    assert got[9][:1] == ("resolve",) and got[9][3] == 5
    assert got[10][4] == "id not a number"


def test_repair_row_resolution_and_responses(spark):
    alerts = _alerts(spark, [(1, "L1", "2024-01-30 09:00:00", 0), (2, "L2", "2024-01-30 09:00:00", 0),
                             (3, "L3", "2024-01-30 09:00:00", 0)])
    repairs = _repairs(spark, [(10, 1, "ALERT-1", "Open"), (11, 1, "ALERT-1", "Open"),   # newest by alert id
                               (20, None, "ALERT-2", "Open")])                           # found by unit, attached
    msgs = _msgs(spark, [(1, 0, "text", "RCA:1:first"), (2, 5, "text", "RCA:1:second"),
                         (3, 1, "text", "CAPA:2:capa two"), (4, 2, "text", "DESC:3:new row"),
                         (5, 3, "text", "RCA:999:unknown")])
    ev = L.parse_messages(msgs)
    out = {r.id: r for r in L.apply_responses(alerts, repairs, ev, ASOF).collect()}
    assert out[11].rca_text == "second" and out[10].rca_text is None       # last write wins, newest row
    assert out[20].alert_id == 2 and out[20].capa_text == "capa two"       # attached ALERT-2
    created = [r for r in out.values() if r.alert_id == 3]
    assert len(created) == 1 and created[0].failure_description == "new row" and created[0].status == "Open"
    assert len(out) == 4                                                    # unknown alert rejected
    rej = L.rejected_events(ev, alerts).collect()
    assert [r.msg_id for r in rej] == [5]


def test_resolve_rules(spark):
    alerts = _alerts(spark, [(1, "L1", "2024-01-30 10:00:00", 0), (2, "L2", "2024-01-30 09:00:00", 1),
                             (3, "L3", "bad time", 0)])
    repairs = _repairs(spark, [(10, 1, "ALERT-1", "Open"), (30, None, "ALERT-3", "Open")])
    msgs = _msgs(spark, [(1, 60, "text", "RESOLVE:1"),      # exactly 60 min -> within SLA
                         (2, 70, "text", "RESOLVE:1"),      # resolve twice -> rejected
                         (3, 0, "text", "RESOLVE:2"),       # already resolved -> rejected
                         (4, 0, "text", "RESOLVE:77"),      # unknown
                         (5, 5, "button", "resolve_3")])    # unparsable sent time -> 0 min
    a2, r2, res = L.resolve(alerts, repairs, L.parse_messages(msgs), 1)
    a = {r.id: r for r in a2.collect()}
    assert (a[1].resolved, a[1].resolution_mins, a[1].within_sla) == (1, 60.0, 1)
    assert (a[3].resolved, a[3].resolution_mins) == (1, 0.0)
    assert {r.msg_id: r.ok for r in res.collect()} == {1: True, 2: False, 3: False, 4: False, 5: True}
    assert {r.id: r.status for r in r2.collect()} == {10: "Closed", 30: "Closed"}


def test_close_all_and_empty(spark):
    alerts = _alerts(spark, [(1, "L1", "2024-01-30 09:00:00", 0), (2, "L2", "2024-01-30 09:00:00", 1)])
    repairs = _repairs(spark, [(10, 1, "ALERT-1", "Open")])
    a2, r2, n = L.close_all(alerts, repairs, ASOF)
    assert n.first().closed == 1
    assert all(r.resolved == 1 for r in a2.collect()) and r2.first().status == "Closed"
    empty_a = spark.createDataFrame([], K.FAILURE_ALERTS)
    empty_r = spark.createDataFrame([], K.REPAIR_ACTIONS)
    assert L.close_all(empty_a, empty_r, ASOF)[2].first().closed == 0


def test_open_alerts_skips_open_lines(spark):
    alerts = _alerts(spark, [(7, "L1", "2024-01-30 09:00:00", 0)])
    repairs = _repairs(spark, [(3, 7, "ALERT-7", "Open")])
    rates = spark.createDataFrame([("L1", 20, 8, 40.0), ("L2", 20, 6, 30.0), ("L3", 20, 4, 20.0)],
                                  "line string, total long, failed long, rate double")
    codes = spark.createDataFrame([("L2", 1, "TC_A_01", "UCT", 3, 20, 15.0)],
                                  "line string, rank long, testcode string, process string, failed_units long,"
                                  " total_line long, rate double")
    stations = spark.createDataFrame([("L2", "L2-S9")], "line string, station string")
    new_a, new_r = L.open_alerts(rates, codes, stations, alerts, repairs, ASOF)
    got = sorted((r.id, r.line, r.station) for r in new_a.collect())
    assert got == [(8, "L2", "L2-S9"), (9, "L3", "L3")]
    assert sorted((r.id, r.alert_id, r.unit_id) for r in new_r.collect()) == [(4, 8, "ALERT-8"), (5, 9, "ALERT-9")]
    decoded = new_a.where("line = 'L2'").select(L.read_codes(F.col("top_testcodes")).alias("c")).first().c
    assert decoded[0].testcode == "TC_A_01" and decoded[0].failed_units == 3


def test_backfill_and_evolve(spark):
    repairs = _repairs(spark, [(1, None, "ALERT-5", "Open"), (2, None, "ALERT-x", "Open"),
                               (3, None, "ALERT-0", "Open"), (4, 9, "ALERT-5", "Open")])
    got = {r.id: r.alert_id for r in L.backfill_alert_id(repairs).collect()}
    assert got == {1: 5, 2: None, 3: None, 4: 9}
    old = repairs.select("id", "unit_id")
    ev = L.evolve(old, K.REPAIR_ACTIONS)
    assert ev.columns == K.REPAIR_ACTIONS.fieldNames() and ev.where("capa_text is not null").count() == 0


def test_stream_alert_batch_is_replay_safe(spark, tmp_path):
    from yieldlens.streaming.line_rates import alert_batch, alert_table
    t = dt.datetime(2024, 1, 30, 12)
    early = dt.datetime(2024, 1, 30, 11, 30)
    units = spark.createDataFrame(
        [(t, "L1", "L1-S1", "P", None, 12), (t, "L1", "L1-S1", "F", "TC_A_01;TC_B_02", 3), (t, "L1", "L1-S2", "F", "TC_C_03", 5),
         (t, "L2", "L2-S1", "P", None, 20), (early, "L3", "L3-S1", "P", None, 11), (early, "L3", "L3-S1", "F", None, 9),
         (t, "L3", "L3-S2", "F", "TC_D_04", 20)],
        "window_end timestamp_ntz, line string, station string, status string, failed_testcode string, units long")
    units = units.withColumn("process", F.lit("UCT"))
    root = str(tmp_path / "state")
    alert_batch(units, 0, root)
    alert_batch(units, 0, root)          # replay: same partition rewritten
    alert_batch(units, 1, root)          # next evaluation: L1 already open
    alert_batch(units, 0, root, run="other")     # another query numbers its batches anew: nothing is replaced
    a = alert_table(spark, root, "failure_alerts").collect()
    # every window that the batch closed is evaluated, the older one with its own time
    assert sorted((r.line, r.alert_sent_at, r.resolved) for r in a) == [("L1", "2024-01-30 12:00:00", 0),
                                                                        ("L3", "2024-01-30 11:30:00", 0)]
    assert {r.line: (r.station, r.total_tests, r.failed_tests) for r in a} == {"L1": ("L1-S2", 20, 8), "L3": ("L3-S1", 20, 9)}
    codes = {r.line: [(c["testcode"], c["failed_units"], c["total_line"]) for c in json.loads(r.top_testcodes)] for r in a}
    assert codes == {"L1": [("TC_C_03", 5, 20), ("TC_A_01", 3, 20)], "L3": []}
    assert sorted((r.id, r.line) for r in a) == [(1, "L3"), (2, "L1")]
    assert alert_table(spark, root, "repair_actions").count() == 2


def test_unit_texts_by_like_and_exactly(spark):
    repairs = _repairs(spark, [(1, None, "ALERT-12abc", "Open"), (2, None, "alert-7", "Open"),
                               (3, None, "ALERT-007", "Open"), (4, None, "ALERT-8", "Open")])
    assert {r.id: r.alert_id for r in L.backfill_alert_id(repairs).collect()} == {1: 12, 2: 7, 3: 7, 4: 8}
    alerts = _alerts(spark, [(7, "L1", "2024-01-30 09:00:00", 0), (8, "L1", "2024-01-30 09:00:00", 0)])
    links, _ = L.repair_for(alerts, repairs, alerts.select(F.col("id").alias("alert_id")), "2024-01-30 12:00:00")
    got = {r.alert_id: r.repair_id for r in links.collect()}
    assert got[8] == 4 and got[7] not in (2, 3)              # only the exact text names the alert


def test_media_keeps_the_repair_row_it_points_to(spark):
    alerts = _alerts(spark, [(3, "L1", "2024-01-30 09:00:00", 0)])
    events = L.parse_messages(_msgs(spark, [(1, 1, "photo", "IMG:3:a picture")]))
    media, repairs = L.attach_media(alerts, _repairs(spark, [(10, 99, "x", "Open")]), events, "2024-01-30 12:00:00")
    ids = {r.id for r in repairs.collect()}
    found = {r.repair_id for r in media.collect()}
    assert found and found <= ids and ids >= {10} and len(ids) == 2


def test_open_line_gets_its_missing_repair_row(spark):
    alerts = _alerts(spark, [(3, "L1", "2024-01-30 09:00:00", 0), (4, "L2", "2024-01-30 09:00:00", 0)])
    rates = spark.createDataFrame([("L1", 20, 8, 40.0)], "line string, total long, failed long, rate double")
    repairs = L.ensure_repairs(rates, alerts, _repairs(spark, [(10, 99, "x", "Open")]), "2024-01-30 12:00:00")
    assert sorted((r.alert_id, r.unit_id) for r in repairs.collect()) == [(3, "ALERT-3"), (99, "x")]


def test_history_is_in_order_after_the_join(spark):
    alerts = _alerts(spark, [(k, "L1", "2024-01-30 09:00:00", 1) for k in range(1, 41)])
    alerts = alerts.withColumn("resolved_at", F.concat(F.lit("2024-01-30 10:"), F.lpad(F.col("id").cast("string"), 2, "0"),
                                                       F.lit(":00")))
    repairs = _repairs(spark, [(k, k, f"ALERT-{k}", "Closed") for k in range(1, 41)])
    view = L.history_view(alerts.hint("shuffle_merge"), repairs.hint("shuffle_merge"), 20)
    assert [r.id for r in view.collect()] == list(range(40, 20, -1))
