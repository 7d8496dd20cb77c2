"""Track classification (A17, A18, F10) and report semantics (Q8-Q15)."""

from yieldlens import schemas as K
from yieldlens.operators import reports as R
from yieldlens.operators import tracks as TR
from yieldlens.operators.filters import FilterSpec
from yieldlens.operators.prepare import prepare
from yieldlens.sources import fixtures as fx


def _r(i, track, status, ts, code="", station="L1-S1", model="M1"):
    return (i, "L2AR", model, "L1", station, status, code, track, "2024-01-01", "00:00:00", ts)


def test_classify_by_span(spark, facts_df):
    rows = [
        _r(1, "A", "P", "2024-01-01 10:00:00"),                                   # 0 failures
        _r(2, "B", "F", "2024-01-01 10:00:00"),                                   # 1 failure
        _r(3, "C", "F", "2024-01-01 10:00:00"), _r(4, "C", "F", "2024-01-01 11:00:00"),   # span = 60
        _r(5, "D", "F", "2024-01-01 10:00:00"), _r(6, "D", "F", "2024-01-01 11:00:01"),   # just above
        _r(7, "E", "F", "not a time"), _r(8, "E", "P", "2024-01-01 10:00:00"),     # null time dropped
        _r(9, None, "F", "2024-01-01 10:00:00"),                                  # null track excluded
    ]
    classes = TR.classify_by_span(prepare(facts_df(rows), "span"), 60)
    got = {r.track_id: r.overall_status for r in classes.collect()}
    assert got == {"A": K.PASSED, "B": K.FAILED, "C": K.NTF, "D": K.REAL_FAIL, "E": K.PASSED}


def test_classify_by_pattern_and_span_filter(spark, facts_df):
    rows = [
        _r(1, "A", "F", "2024-01-01 10:00:00", code="BARCODE_NOT_FOUND"),          # NTF word
        _r(2, "B", "F", "2024-01-01 10:00:00", code=""),                           # MISSING_CODE -> NTF
        _r(3, "C", "F", "2024-01-01 10:00:00", code="TC_WIFI_01"),                 # Real Fail
        _r(4, "C", "F", "2024-01-01 10:10:00", code="TC_TIMEOUT_02"),
        _r(5, "D", "F", "2024-01-01 10:00:00", code="TC_X_1"),
        _r(6, "D", "F", "2024-01-01 11:00:00", code="TC_X_1"),                     # span 60 > 30
        _r(7, "E", "P", "2024-01-01 10:00:00"),
    ]
    prep = prepare(facts_df(rows), "pattern")
    kept = TR.span_filter(prep, 30)
    assert sorted(r.track_id for r in kept.select("track_id").distinct().collect()) == ["A", "B", "C", "E"]
    got = {r.track_id: r.overall_status for r in TR.classify_by_pattern(kept).collect()}
    assert got == {"A": K.NTF, "B": K.NTF, "C": K.REAL_FAIL, "E": K.PASSED}


def test_class_counts_add_up(spark):
    prep = prepare(fx.log_data(spark, "/root/testdata/sf0.001"), "span")
    classes = TR.classify_by_span(prep)
    k = {r.overall_status: r.tracks for r in TR.kpis(classes).collect()}
    assert k == {"Passed": 285, "Failed": 82, "NTF": 1, "Real Fail": 17}
    assert sum(k.values()) == prep.where("track_id is not null").select("track_id").distinct().count()


def test_unknown_status_rules(spark, facts_df):
    rows = [_r(1, "A", "P", "2024-01-01 10:00:00"), _r(2, "B", "X", "2024-01-01 10:00:00"),
            _r(3, "C", "F", "2024-01-01 10:00:00")]
    tests = prepare(facts_df(rows), "tests")
    k = R.test_kpis(tests).first()
    assert (k.total, k.passed, k.failed) == (3, 1, 1)            # Unknown in neither (Q8)
    st = R.station_stats(tests).first()
    assert (st.total, st.passed, st.failed) == (3, 1, 2)         # Unknown counted failed here
    span = prepare(facts_df(rows), "span")
    assert R.station_stats(span, "span").first().passed == 2    # and passed here


def test_filters_and_hourly_grid(spark, facts_df):
    rows = [_r(1, "A", "P", "2024-01-01 05:59:59"), _r(2, "B", "F", "2024-01-01 06:00:00"),
            _r(3, "C", "P", "2024-01-01 14:00:00", station=None), _r(4, "D", "F", "2024-01-01 22:00:01")]
    prep = prepare(facts_df(rows), "span")
    am = FilterSpec(profile="span", shift="AM").apply(prep)
    assert sorted(r.id for r in am.collect()) == [2]             # null station never passes (Q6)
    assert FilterSpec(profile="span", start_time="14:00", end_time="06:00").apply(prep).count() == 0
    grid = R.hourly(prep, [K.PASSED, K.FAILED])
    assert grid.count() == 48 and sum(r["count"] for r in grid.collect()) == 4


def test_pareto_ends_at_100(spark):
    prep = FilterSpec().apply(prepare(fx.log_data(spark, "/root/testdata/sf0.001"), "tests"))
    rows = R.pareto(prep, 20).orderBy("rank").collect()
    assert rows and rows[-1].cum_pct == 100.0
    assert all(r.code != "" for r in rows)


def test_span_histogram_single_value(spark, facts_df):
    rows = [_r(1, "C", "F", "2024-01-01 10:00:00"), _r(2, "C", "F", "2024-01-01 10:30:00")]
    h = TR.span_histogram(TR.classify_by_span(prepare(facts_df(rows), "span")), 30).collect()
    assert [(r.bucket, r.tracks) for r in h] == [(1, 1)]         # min = max -> bucket 1 (Q15)


def test_wide_pivots_fill_gaps(spark, facts_df):
    rows = [_r(1, "A", "F", "2024-01-01 10:00:00", model="M1"),
            (2, "UCT", "M2", "L2", "L2-S1", "P", "", "B", "2024-01-01", "00:00:00", "2024-01-01 11:00:00")]
    prep = prepare(facts_df(rows), "tests")
    wide = {r.model: r.asDict() for r in R.fail_matrix(prep, "model", "line", columns=["L1", "L2"]).collect()}
    assert wide["M1"]["L1"] == 100.0 and wide["M1"]["L2"] == 0.0 and wide["M2"]["L1"] == 0.0
    r2 = {r.model: r.asDict() for r in R.distinct_failed_tracks(prep, columns=["L2AR"]).collect()}
    assert r2 == {"M1": {"model": "M1", "L2AR": 1}}


def test_export_and_fact_sink(spark, tmp_path):
    from yieldlens.sources import files as SF
    facts = fx.log_data(spark, "/root/testdata/sf0.001")
    out = str(tmp_path / "export")
    R.export(FilterSpec().apply(prepare(facts, "tests")), ["timestamp", "track_id", "status_display"], out)
    back = spark.read.option("header", True).csv(out)
    assert back.columns == ["timestamp", "track_id", "status_display"] and back.count() > 0
    SF.write_facts(facts, str(tmp_path / "facts"))
    stored = SF.read_facts(spark, str(tmp_path / "facts"))
    assert stored.count() == facts.count() and "event_date" in stored.columns
    one_day = stored.where("event_date = DATE '2024-01-15'")
    assert "PartitionFilters" in one_day._jdf.queryExecution().executedPlan().toString() or one_day.count() > 0


def test_map_columns_by_name(spark, facts_df):
    rows = [_r(1, "A", "F", "2024-01-01 10:00:00")]
    df = facts_df(rows).withColumnRenamed("station", "test_station").withColumnRenamed("process", "proc")
    prep = prepare(df, "span", columns={"test_station": "station", "proc": "process"})
    r = prep.first()
    assert (r.station, r.process) == ("L1-S1", "L2AR")       # by name, not by position (Q1)


def test_track_kpis_one_pass_equals_two_step(spark):
    prep = prepare(fx.log_data(spark, "/root/testdata/sf0.001"), "span")
    spec = FilterSpec(profile="span", line=["L0", "L1"])
    two = {r.overall_status: tuple(r) for r in
           TR.kpis(TR.classify_by_span(spec.apply(prep)), prep).select(
               "overall_status", "tracks", "total_tracks", "all_tracks", "pct").collect()}
    one = {r.overall_status: tuple(r) for r in
           TR.kpis_one_pass(prep, spec.predicate()).select(
               "overall_status", "tracks", "total_tracks", "all_tracks", "pct").collect()}
    assert one == two


def test_failed_as_a_word_fails(spark, facts_df):
    rows = [_r(1, "A", "FAILED", "2024-01-01 10:00:00"), _r(2, "B", "F", "2024-01-01 10:00:00.250"),
            _r(3, "C", "P", "2024-01-01 11:00:00")]
    for profile in ("span", "pattern"):
        prep = prepare(facts_df(rows), profile)
        assert {r.track_id: r.failed for r in prep.collect()} == {"A": True, "B": True, "C": False}
        spec = FilterSpec(profile=profile, search="failed")
        assert sorted(r.track_id for r in spec.apply(prep).collect()) == ["A", "B"]
