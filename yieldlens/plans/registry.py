"""All registered queries: name -> Spark callable, name -> DuckDB SQL twin."""

from __future__ import annotations

from . import alerting, dashboards, ingest, lifecycle, streams, tracks

_MODULES = [alerting, dashboards, tracks, ingest, lifecycle, streams]


def flagship(spark, sf_dir):
    return alerting.lines_above_threshold(spark, sf_dir, window=10080, threshold=10.0)


def queries() -> dict:
    out = {}
    for m in _MODULES:
        out.update(m.QUERIES)
    return out


def oracle_sql() -> dict:
    out = {}
    for m in _MODULES:
        out.update(m.ORACLES)
    return out
