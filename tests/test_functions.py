"""Hand-made cases for the scalar column functions."""

import datetime as dt

from pyspark.sql import functions as F

from yieldlens.functions import columns as C


def _eval(spark, values, fn, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {typ}")
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


def test_is_testcode(spark):
    cases = {
        "": False, "N/A": False, "REL.1_2_3": False, "ABC": False, "Tc_A_01": False,
        "AB-C_D_12": False, "TC_X_INDIA": False, "TC_12": False, "TC_FOO_BAR": False,
        "TC_WIFI_RSSI": True, "A_B_12;X_INDIA": True, "TC_WIFI_RSSI_01": True,
        "BARCODE_NOT_FOUND_04": True, "  TC_GPS_LOCK_02  ": True, "(null)": False, "*": False,
        "TC_A_B_USA": False,
    }
    got = _eval(spark, list(cases), C.is_testcode)
    assert dict(zip(cases, got)) == cases


def test_result_time_two_formats(spark):
    cases = {
        "1/2/24 3:04:05": "2024-01-02 03:04:05",
        "01/02/2024 03:04:05": "2024-01-02 03:04:05",
        "01/02/70 03:04:05": "1970-01-02 03:04:05",   # %y 69..99 -> 19xx
        "01/02/68 03:04:05": "2068-01-02 03:04:05",
        "2024-01-02": None, "": None, "02/30/24 00:00:00": None, "13/01/24 00:00:00": None,
        "1/2/24 3:04:60": None,
    }
    got = _eval(spark, list(cases), C.parse_result_time)
    assert dict(zip(cases, got)) == cases


def test_track_from_filename(spark):
    cases = {"ic_T1_x.rslt": "T1", "IC_T1.rslt.txt": "T1", "T1_rslt.csv": "T1", "rslt": "rslt",
             "": "", ".rslt": "", "ic_T9.2_7.rslt": "T9"}
    got = _eval(spark, list(cases), C.track_from_filename)
    assert dict(zip(cases, got)) == cases


def test_line_from_station(spark):
    cases = {"L1-ST2": "L1", "L1_ST2": "L1", "": "", None: "", "NOSEP": "NOSEP"}
    got = _eval(spark, list(cases), C.line_from_station)
    assert dict(zip(cases, got)) == cases


def test_iso_and_normalized_time(spark, facts_df):
    rows = [(1, "P", "M", "L", "S", "F", "", "T", "2024-01-02", "03:04:05", ts) for ts in
            ["2024-01-02T03:04:05", " 2024-01-02 03:04:05 ", "", None, "not a time"]]
    df = facts_df(rows).select(C.parse_iso_ts(C.normalized_ts_text()).alias("t"))
    got = [r.t for r in df.collect()]
    want = dt.datetime(2024, 1, 2, 3, 4, 5)
    assert got == [want, want, want, want, None]


def test_alert_failed_and_primary_code(spark):
    got = _eval(spark, ["F", " fail ", "FAILED", "P", None, "X"], C.alert_failed)
    assert got == [True, True, True, False, False, False]
    got = _eval(spark, ["A_1;B_2", " A_1 ", ";B", "A"], C.primary_code)
    assert got == ["A_1", "A_1", "", "A"]


def test_ntf_code(spark):
    got = _eval(spark, ["BARCODE_X", "comm timeout", "MISSING_CODE", "TC_WIFI_01", "no data here"], C.ntf_code)
    assert got == [True, True, True, False, True]


def test_pct_half_even(spark):
    df = spark.createDataFrame([(49, 400, 1), (107, 4000, 2), (0, 0, 1)], "a long, b long, p int")
    got = [r[0] for r in df.select(C.pct("a", "b", 1)).collect()][:1]
    assert got == [12.2]          # 12.25 -> 12.2 (half even)
    assert df.select(C.pct("a", "b", 2)).collect()[1][0] == 2.68   # 2.675 -> 2.68
    assert df.select(C.pct("a", "b", 2)).collect()[2][0] == 0.0
