"""W1 / A31-A34 semantics on hand-made rows, and invariants on the fixtures."""

from pyspark.sql import functions as F

from yieldlens.operators import alerting as A
from yieldlens.operators.dedup import latest_per_track
from yieldlens.sources import fixtures as fx

ASOF = "2024-01-30 23:59:59"


def _row(i, track, status, ts, line="L1", station="L1-ST1", code="", date="2024-01-30", time="10:00:00"):
    return (i, "L2AR", "M1", line, station, status, code, track, date, time, ts)


def test_latest_per_track_cases(spark, facts_df):
    rows = [
        _row(1, "T1", "F", "2024-01-30 10:00:00"),
        _row(2, "T1", "P", "2024-01-30 10:00:00"),          # equal time: higher id wins
        _row(3, "  ", "F", "2024-01-30 11:00:00"),          # blank track: kept as is
        _row(4, "  ", "F", "2024-01-30 11:00:00"),
        _row(5, None, "F", "2024-01-30 12:00:00"),          # null track: kept
        _row(6, "T2", "F", "2024-01-30T13:00:00"),          # T separator
        _row(7, "T2", "P", "2024-01-30 12:59:59"),
        _row(8, "T3", "F", "", time="14:00:00"),            # blank time -> date + time
        _row(9, "T3", "P", "2024-01-30 13:00:00"),
        _row(10, "T4", "F", "not a time"),                  # unparsable: excluded (Q25)
        _row(11, "T5", "F", "2024-01-20 10:00:00"),         # outside the window
    ]
    df = facts_df(rows)
    for method in ("aggregate", "window"):
        got = sorted(r.id for r in latest_per_track(df, ASOF, 1440, method).collect())
        assert got == [2, 3, 4, 5, 6, 8], method


def test_line_rates_strict_threshold(spark, facts_df):
    rows = [_row(i, f"T{i}", "F" if i <= 1 else "P", "2024-01-30 10:00:00", line="LA") for i in range(1, 11)]
    rows += [_row(100 + i, f"U{i}", "F" if i <= 2 else "P", "2024-01-30 10:00:00", line="LB") for i in range(1, 11)]
    rows += [_row(200 + i, f"V{i}", "F", "2024-01-30 10:00:00", line="LC") for i in range(1, 5)]  # < min samples
    latest = latest_per_track(facts_df(rows), ASOF, 1440)
    got = [(r.line, r.total, r.failed, r.rate) for r in A.line_rates(latest, 5, 10.0, 3).collect()]
    assert got == [("LB", 10, 2, 20.0)]                 # LA at exactly 10 % is not > 10


def test_top_codes_and_worst_station(spark, facts_df):
    rows = [
        _row(1, "T1", "F", "2024-01-30 10:00:00", code="A_1;B_2", station="L1-S1"),
        _row(2, "T2", "F", "2024-01-30 10:00:00", code="A_1", station="L1-S2"),
        _row(3, "T3", "F", "2024-01-30 10:00:00", code=";X", station="L1-S2"),
        _row(4, "T4", "P", "2024-01-30 10:00:00"),
        _row(5, "T5", "P", "2024-01-30 10:00:00", line="L9"),
    ]
    latest = latest_per_track(facts_df(rows), ASOF, 1440)
    codes = sorted((r.line, r.rank, r.testcode, r.failed_units, r.total_line, r.rate)
                   for r in A.top_codes(latest, 3).collect())
    assert codes == [("L1", 1, "A_1", 2, 4, 50.0), ("L1", 2, "UNKNOWN", 1, 4, 25.0)]
    st = {r.line: (r.station, r.failed) for r in A.worst_station(latest).collect()}
    assert st == {"L1": ("L1-S2", 2), "L9": ("L9", 0)}


def test_dedup_invariant_on_fixture(spark):
    """raw vs deduplicated: dedup rows = distinct tracks + untracked rows."""
    facts = fx.log_data(spark, "/root/testdata/sf0.001")
    latest = latest_per_track(facts, ASOF, 10080)
    tracked = F.col("track_id").isNotNull() & (F.trim("track_id") != "")
    n = latest.count()
    distinct_tracks = latest.where(tracked).select("track_id").distinct().count()
    untracked = latest.where(~tracked).count()
    assert n == distinct_tracks + untracked
    diag = A.diagnostics(facts, latest, ASOF, 10080).first()
    assert diag.dedup_rows == n and diag.raw_rows >= n and diag.total_rows == 1000


def test_flagship_matches_probe(spark):
    import __spark_entry__ as entry
    got = [(r.line, r.total, r.failed, r.rate) for r in entry.entry(spark).collect()]
    assert got == [("L0", 17, 5, 29.41), ("L1", 17, 4, 23.53), ("L2", 16, 2, 12.5)]


def test_stored_facts_push_the_window_filter(spark, tmp_path):
    from yieldlens.sources import files as SF
    SF.write_facts(fx.log_data(spark, "/root/testdata/sf0.001"), str(tmp_path / "facts"))
    stored = SF.read_facts(spark, str(tmp_path / "facts"))
    latest = latest_per_track(stored, ASOF, 10080)
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [GreaterThanOrEqual(event_ts" in plan
    assert "PartitionFilters: [isnotnull(event_date" in plan or "PartitionFilters: [(event_date" in plan
    base = latest_per_track(fx.log_data(spark, "/root/testdata/sf0.001"), ASOF, 10080)
    assert latest.count() == base.count()


def test_rate_equal_to_the_threshold_is_no_alert(spark):
    from yieldlens.operators import alerting
    for percent in (7, 14, 28, 55, 56):
        rows = [("L1", "F" if k < percent else "P") for k in range(100)]
        latest = spark.createDataFrame(rows, "line string, status string")
        assert alerting.line_rates(latest, 5, float(percent)).count() == 0
        assert alerting.line_rates(latest, 5, percent - 0.5).count() == 1
