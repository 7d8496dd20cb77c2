"""Registered queries of the alert / repair lifecycle (L1-L8, P19-P24,
A35, A36, S11, S12). State and events are the derived fixtures of
``sources.fixtures`` (alert state from the facts, repair rows, messages)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as K
from ..operators import alerting as A
from ..operators import lifecycle as L
from ..operators.dedup import latest_per_track
from ..session import checkpoint_dir
from ..sources import fixtures as fx
from . import common as Q
from .common import with_ctes


def _state(s, d):
    facts = Q.facts(s, d)
    # the alert state is used by every branch of the lifecycle plans: materialise
    # it once (reliable checkpoint) instead of re-deriving it from the facts in each
    checkpoint_dir(s)
    alerts_x = fx.alert_state(facts).checkpoint(eager=True)
    alerts = alerts_x.drop("_day")
    return facts, alerts_x, alerts, L.evolve(fx.repair_state(alerts_x), K.REPAIR_ACTIONS)


def _events(s, d):
    _, ax, alerts, repairs = _state(s, d)
    return alerts, repairs, L.parse_messages(fx.messages(ax))


def _repair_rows(s, d):
    alerts, repairs, ev = _events(s, d)
    touched = L.valid_events(ev, alerts).where(F.col("action").isin("response", "media"))
    links, _ = L.repair_for(alerts, repairs, touched, Q.ASOF)
    return links


def _apply(s, d):
    alerts, repairs, ev = _events(s, d)
    return L.apply_responses(alerts, repairs, ev, Q.ASOF)


def _media(part):
    def run(s, d):
        alerts, repairs, ev = _events(s, d)
        return L.attach_media(alerts, repairs, ev, Q.ASOF)[part]
    return run


def _resolve(part):
    def run(s, d):
        alerts, repairs, ev = _events(s, d)
        return L.resolve(alerts, repairs, ev, K.SLA_HOURS)[part]
    return run


def _close_all(part):
    def run(s, d):
        _, _, alerts, repairs = _state(s, d)
        return L.close_all(alerts, repairs, Q.ASOF)[part]
    return run


def _latest(s, facts):
    # W1 once (E2): the deduplicated window feeds rates, codes and stations
    return latest_per_track(facts, Q.ASOF, Q.WINDOW).checkpoint(eager=True)


def _open_alerts(s, d):
    facts, _, alerts, repairs = _state(s, d)
    latest = _latest(s, facts)
    rates = A.line_rates(latest, Q.MIN_SAMPLES, Q.THRESHOLD, Q.TOP_LINES)
    new_alerts, _ = L.open_alerts(rates, A.top_codes(latest, Q.TOP_CODES), A.worst_station(latest),
                                  alerts, repairs, Q.ASOF)
    return new_alerts


def _open_repairs(s, d):
    facts, _, alerts, repairs = _state(s, d)
    latest = _latest(s, facts)
    rates = A.line_rates(latest, Q.MIN_SAMPLES, Q.THRESHOLD, Q.TOP_LINES)
    return L.open_alerts(rates, A.top_codes(latest, Q.TOP_CODES), A.worst_station(latest),
                         alerts, repairs, Q.ASOF)[1]


def _view(fn):
    def run(s, d):
        _, _, alerts, repairs = _state(s, d)
        return fn(alerts, repairs)
    return run


def _diagnostics(s, d):
    facts, _, alerts, _ = _state(s, d)
    return A.diagnostics(facts, latest_per_track(facts, Q.ASOF, Q.WINDOW), Q.ASOF, Q.WINDOW, alerts)


def _line_status(k):
    def run(s, d):
        facts, _, alerts, _ = _state(s, d)
        return A.line_status(latest_per_track(facts, Q.ASOF, Q.WINDOW), Q.MIN_SAMPLES, Q.THRESHOLD, k, alerts)
    return run


_OLD_REPAIR_COLS = ["id", "alert_id", "unit_id", "line", "station", "status", "rca_text",
                    "action_taken", "created_at", "updated_at", "closed_at"]

QUERIES = {
    "parse_replies": lambda s, d: _events(s, d)[2],
    "repair_rows": _repair_rows,
    "apply_responses": _apply,
    "attach_media": _media(0),
    "attach_media_repairs": _media(1),
    "resolve_alerts": _resolve(0),
    "resolve_repairs": _resolve(1),
    "resolve_results": _resolve(2),
    "close_all": _close_all(0),
    "close_all_repairs": _close_all(1),
    "close_all_count": _close_all(2),
    "open_alerts": _open_alerts,
    "open_alert_repairs": _open_repairs,
    "alert_text": lambda s, d: L.alert_text(_state(s, d)[2], Q.ASOF),
    "open_view": _view(lambda a, r: L.open_view(a, r, Q.ASOF)),
    "history_view": _view(lambda a, r: L.history_view(a, r, 10)),
    "window_diagnostics_alerts": _diagnostics,
    "line_status_alerts": _line_status(None),
    "line_status_top10": _line_status(10),
    "alert_stats": lambda s, d: L.stats(_state(s, d)[2]),
    "sla_report": lambda s, d: L.sla(_state(s, d)[2]),
    "backfill_alert_id": lambda s, d: L.backfill_alert_id(_state(s, d)[3]),
    "evolve_schema": lambda s, d: L.evolve(_state(s, d)[3].select(*_OLD_REPAIR_COLS), K.REPAIR_ACTIONS),
}

# ---------------------------------------------------------------------------
# DuckDB twins
# ---------------------------------------------------------------------------


def _int_text(x: str) -> str:
    return f"(CASE WHEN regexp_full_match(trim({x}), '[+-]?\\d+') THEN TRY_CAST(trim({x}) AS BIGINT) END)"


_STRIP = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
_RESP = " OR ".join(f"starts_with(up, '{p}')" for p, _ in K.REPLY_FIELDS)
_RESP_FIELD = "CASE " + " ".join(f"WHEN starts_with(up, '{p}') THEN '{f}'" for p, f in K.REPLY_FIELDS) + " END"
_TWO = r"^[^:]*:[^:]*:((?s).*)$"
_ONE = r"^[^:]*:((?s).*)$"

_PARSE = f"""
SELECT msg_id, ts, user, kind, action, field, value, alert_id,
       CASE WHEN action IS NULL THEN 'unknown command' WHEN NOT fmt_ok THEN 'format'
            WHEN alert_id IS NULL THEN 'id not a number' ELSE 'ok' END AS outcome
FROM (SELECT *,
  CASE WHEN kind = 'text' AND ({_RESP}) THEN 'response'
       WHEN kind = 'text' AND starts_with(up, 'RESOLVE:') THEN 'resolve'
       WHEN kind = 'photo' AND starts_with(up, 'IMG:') THEN 'media'
       WHEN kind = 'button' AND starts_with(text, 'act_') THEN 'response'
       WHEN kind = 'button' AND starts_with(text, 'resolve_') THEN 'resolve' END AS action,
  CASE WHEN kind = 'text' AND ({_RESP}) THEN {_RESP_FIELD}
       WHEN kind = 'button' AND starts_with(text, 'act_') THEN 'action_taken' END AS field,
  CASE WHEN kind = 'text' AND ({_RESP}) THEN {_int_text("split_part(st, ':', 2)")}
       WHEN kind = 'text' AND starts_with(up, 'RESOLVE:') THEN {_int_text(f"regexp_extract(st, '{_ONE}', 1)")}
       WHEN kind = 'photo' THEN {_int_text("split_part(st, ':', 2)")}
       WHEN kind = 'button' AND starts_with(text, 'act_') THEN {_int_text("split_part(text, '_', 2)")}
       WHEN kind = 'button' AND starts_with(text, 'resolve_') THEN {_int_text("split_part(text, '_', 2)")} END
       AS alert_id,
  CASE WHEN kind = 'text' AND ({_RESP}) THEN
            (CASE WHEN regexp_matches(st, '{_TWO}') THEN trim(regexp_extract(st, '{_TWO}', 1)) END)
       WHEN kind = 'photo' THEN
            (CASE WHEN regexp_matches(st, '{_TWO}') THEN trim(regexp_extract(st, '{_TWO}', 1)) ELSE '' END)
       WHEN kind = 'button' AND starts_with(text, 'act_') THEN
            (CASE WHEN regexp_matches(text, '^[^_]*_[^_]*_((?s).*)$') THEN regexp_extract(text, '^[^_]*_[^_]*_((?s).*)$', 1) END)
       END AS value,
  CASE WHEN kind = 'text' AND ({_RESP}) THEN regexp_matches(st, '{_TWO}')
                AND trim(split_part(st, ':', 2)) <> '' AND trim(regexp_extract(st, '{_TWO}', 1)) <> ''
       WHEN kind = 'text' AND starts_with(up, 'RESOLVE:') THEN trim(regexp_extract(st, '{_ONE}', 1)) <> ''
       WHEN kind = 'photo' THEN trim(split_part(st, ':', 2)) <> ''
       WHEN kind = 'button' AND starts_with(text, 'act_') THEN regexp_matches(text, '^[^_]*_[^_]*_')
       ELSE true END AS fmt_ok
  FROM (SELECT *, {_STRIP} AS st, upper({_STRIP}) AS up FROM messages_src))"""

_UNIT_N = f"(CASE WHEN starts_with(unit_id, 'ALERT-') THEN {_int_text('substr(unit_id, 7)')} END)"

_REPAIR_COLS = ", ".join(K.REPAIR_ACTIONS.fieldNames())


def _base_ctes(*extra):
    return with_ctes(Q.log_cte(), ("alerts_src", fx.alerts_sql()),
                     ("alerts", "SELECT * EXCLUDE (_day) FROM alerts_src"),
                     ("repairs", fx.REPAIRS_SQL), ("messages_src", fx.messages_sql()),
                     ("events", _PARSE),
                     ("valid", "SELECT * FROM events WHERE outcome = 'ok' AND alert_id IN (SELECT id FROM alerts)"),
                     *extra)


def _links_ctes(actions: str):
    return [
        ("ids", f"""SELECT DISTINCT v.alert_id, a.line, a.station FROM valid v JOIN alerts a ON a.id = v.alert_id
                   WHERE v.action IN ({actions})"""),
        ("by_alert", "SELECT alert_id, MAX(id) AS by_alert FROM repairs WHERE alert_id IS NOT NULL GROUP BY 1"),
        ("by_unit", f"SELECT {_UNIT_N} AS alert_id, MAX(id) AS by_unit FROM repairs WHERE {_UNIT_N} IS NOT NULL GROUP BY 1"),
        ("j", "SELECT * FROM ids LEFT JOIN by_alert USING (alert_id) LEFT JOIN by_unit USING (alert_id)"),
        ("links", """SELECT alert_id, COALESCE(by_alert, by_unit, (SELECT COALESCE(MAX(id), 0) FROM repairs) + alert_id)
                     AS repair_id FROM j"""),
        ("reps", f"""
            SELECT r.id, COALESCE(CASE WHEN j.by_alert IS NULL THEN j.alert_id END, r.alert_id) AS alert_id,
                   r.unit_id, r.line, r.station, r.status, r.failure_description, r.rca_text, r.action_taken,
                   r.capa_text, r.engineer_contact, r.created_at, r.updated_at, r.closed_at
            FROM repairs r LEFT JOIN j ON j.by_unit = r.id AND j.by_alert IS NULL
            UNION ALL
            SELECT (SELECT COALESCE(MAX(id), 0) FROM repairs) + alert_id, alert_id, 'ALERT-' || CAST(alert_id AS VARCHAR),
                   line, station, 'Open', NULL, NULL, NULL, NULL, NULL, '{Q.ASOF}', '{Q.ASOF}', NULL
            FROM j WHERE by_alert IS NULL AND by_unit IS NULL"""),
    ]


_RESPONSE_CTES = [("ev", f"""
    SELECT v.*, l.repair_id FROM valid v JOIN links l USING (alert_id)
    WHERE v.action = 'response' AND v.field IN ({', '.join(f"'{f}'" for f in K.RESPONSE_FIELDS)})"""),
    ("upd", "SELECT repair_id, " + ", ".join(
        f"arg_max_null(value, {{'t': ts, 'm': msg_id}}) FILTER (WHERE field = '{f}') AS new_{f}"
        for f in K.RESPONSE_FIELDS) + ", arg_max_null(user, {'t': ts, 'm': msg_id}) AS last_user, "
        "strftime(MAX(ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM ev GROUP BY repair_id")]

_APPLY = _base_ctes(*_links_ctes("'response'"), *_RESPONSE_CTES) + """
SELECT r.id, r.alert_id, r.unit_id, r.line, r.station, r.status,
       COALESCE(u.new_failure_description, r.failure_description) AS failure_description,
       COALESCE(u.new_rca_text, r.rca_text) AS rca_text, COALESCE(u.new_action_taken, r.action_taken) AS action_taken,
       COALESCE(u.new_capa_text, r.capa_text) AS capa_text,
       CASE WHEN u.repair_id IS NOT NULL THEN u.last_user ELSE r.engineer_contact END AS engineer_contact,
       r.created_at, CASE WHEN u.repair_id IS NOT NULL THEN u.last_ts ELSE r.updated_at END AS updated_at, r.closed_at
FROM reps r LEFT JOIN upd u ON u.repair_id = r.id"""

_MEDIA = _base_ctes(*_links_ctes("'media'")) + """
SELECT v.msg_id AS id, CAST(l.repair_id AS BIGINT) AS repair_id, CAST(v.alert_id AS BIGINT) AS alert_id,
       'alert' || CAST(v.alert_id AS VARCHAR) || '_' || strftime(v.ts, '%Y%m%d_%H%M%S') || '_' || v.user || '.jpg'
       AS filepath, v.value AS caption, v.user AS uploaded_by, 'image' AS media_type,
       strftime(v.ts, '%Y-%m-%d %H:%M:%S') AS uploaded_at
FROM valid v JOIN links l USING (alert_id) WHERE v.action = 'media'"""

_ISO = f"(CASE WHEN regexp_full_match(trim(alert_sent_at), '{Q.ISO_RE}') THEN TRY_CAST(trim(alert_sent_at) AS TIMESTAMP) END)"

_RESOLVE_CTES = _base_ctes(
    ("rev", "SELECT * FROM events WHERE outcome = 'ok' AND action = 'resolve'"),
    ("first", """SELECT alert_id, ts AS rts, msg_id AS rmsg FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY alert_id ORDER BY ts, msg_id) AS rn FROM rev) WHERE rn = 1"""),
    ("res", f"""SELECT f.alert_id, f.rts, f.rmsg,
        CASE WHEN {_ISO} IS NULL THEN 0.0
             ELSE round_even(CAST(date_diff('second', {_ISO}, f.rts) AS DOUBLE) / 60, 1) END AS mins
        FROM first f JOIN alerts a ON a.id = f.alert_id AND a.resolved = 0"""),
    ("closing", "SELECT alert_id AS cid, rts AS cts FROM res"))

_A_COLS = K.FAILURE_ALERTS.fieldNames()


def _alerts_select(overrides: dict) -> str:
    return ", ".join(overrides.get(c, c) for c in _A_COLS)


_RESOLVE_ALERTS = _RESOLVE_CTES + "SELECT " + _alerts_select({
    "resolved": "CAST(CASE WHEN r.rts IS NOT NULL THEN 1 ELSE resolved END AS INTEGER) AS resolved",
    "resolved_at": "CASE WHEN r.rts IS NOT NULL THEN strftime(r.rts, '%Y-%m-%d %H:%M:%S') ELSE resolved_at END AS resolved_at",
    "resolution_mins": "CASE WHEN r.rts IS NOT NULL THEN r.mins ELSE resolution_mins END AS resolution_mins",
    "within_sla": f"CAST(CASE WHEN r.rts IS NOT NULL THEN CAST(r.mins <= {K.SLA_HOURS * 60} AS INTEGER) "
                  "ELSE within_sla END AS INTEGER) AS within_sla",
}) + " FROM alerts a LEFT JOIN res r ON r.alert_id = a.id"

_RESOLVE_REPAIRS = _RESOLVE_CTES + f"""
, rr AS (SELECT *, {_UNIT_N} AS unit_n FROM repairs)
, c AS (SELECT rr.*, c1.cts AS c1, c2.cts AS c2 FROM rr
        LEFT JOIN closing c1 ON rr.alert_id = c1.cid
        LEFT JOIN closing c2 ON rr.unit_n = c2.cid AND (rr.alert_id IS NULL OR rr.alert_id = c2.cid))
SELECT id, alert_id, unit_id, line, station,
       CASE WHEN COALESCE(c1, c2) IS NOT NULL THEN 'Closed' ELSE status END AS status,
       failure_description, rca_text, action_taken, capa_text, engineer_contact, created_at,
       CASE WHEN COALESCE(c1, c2) IS NOT NULL THEN strftime(COALESCE(c1, c2), '%Y-%m-%d %H:%M:%S') ELSE updated_at END
       AS updated_at,
       CASE WHEN COALESCE(c1, c2) IS NOT NULL THEN strftime(COALESCE(c1, c2), '%Y-%m-%d %H:%M:%S') ELSE closed_at END
       AS closed_at
FROM c"""

# all messages handled: responses, photos and resolve events on one repair table
_HANDLED_CTES = [
    *_links_ctes("'response', 'media'"), *_RESPONSE_CTES,
    ("closing", """SELECT f.alert_id AS cid, strftime(f.rts, '%Y-%m-%d %H:%M:%S') AS cts FROM (
        SELECT alert_id, MIN(ts) AS rts FROM events WHERE outcome = 'ok' AND action = 'resolve' GROUP BY 1) f
        JOIN alerts a ON a.id = f.alert_id AND a.resolved = 0"""),
    ("handled", f"""SELECT r.*, u.repair_id, u.last_user, u.last_ts, COALESCE(c1.cts, c2.cts) AS cts,
        {', '.join(f'u.new_{f}' for f in K.RESPONSE_FIELDS)}
        FROM (SELECT *, {_UNIT_N} AS unit_n FROM reps) r LEFT JOIN upd u ON u.repair_id = r.id
        LEFT JOIN closing c1 ON r.alert_id = c1.cid
        LEFT JOIN closing c2 ON r.unit_n = c2.cid AND (r.alert_id IS NULL OR r.alert_id = c2.cid)"""),
]
HANDLED_REPAIRS = _base_ctes(*_HANDLED_CTES) + f"""
SELECT id, alert_id, unit_id, line, station, CASE WHEN cts IS NOT NULL THEN 'Closed' ELSE status END AS status,
       {', '.join(f'COALESCE(new_{f}, {f}) AS {f}' for f in K.RESPONSE_FIELDS)},
       CASE WHEN repair_id IS NOT NULL THEN last_user ELSE engineer_contact END AS engineer_contact, created_at,
       CASE WHEN cts IS NOT NULL AND (last_ts IS NULL OR last_ts <= cts) THEN cts
            WHEN repair_id IS NOT NULL THEN last_ts ELSE updated_at END AS updated_at,
       COALESCE(cts, closed_at) AS closed_at FROM handled"""
REJECTED = _base_ctes() + """
SELECT msg_id, ts, user, kind, action, field, value, alert_id,
       CASE WHEN outcome = 'ok' THEN 'alert not found' ELSE outcome END AS outcome
FROM events WHERE outcome <> 'ok' OR alert_id NOT IN (SELECT id FROM alerts)"""

_RESOLVE_RESULTS = _RESOLVE_CTES + f"""
SELECT e.msg_id, e.alert_id, COALESCE(e.msg_id = r.rmsg, false) AS ok,
       CASE WHEN e.msg_id = r.rmsg THEN r.mins END AS minutes,
       CASE WHEN e.msg_id = r.rmsg THEN CAST(r.mins <= {K.SLA_HOURS * 60} AS INTEGER) END AS within_sla,
       CASE WHEN NOT COALESCE(e.msg_id = r.rmsg, false) THEN 'not found or already resolved' END AS reason
FROM rev e LEFT JOIN res r USING (alert_id)"""

_CLOSE_ALERTS = _base_ctes() + "SELECT " + _alerts_select({
    "resolved": "CAST(1 AS INTEGER) AS resolved",
    "resolved_at": f"CASE WHEN resolved = 0 THEN '{Q.ASOF}' ELSE resolved_at END AS resolved_at",
    "resolution_mins": "CASE WHEN resolved = 0 THEN 0.0 ELSE resolution_mins END AS resolution_mins",
    "within_sla": "CAST(CASE WHEN resolved = 0 THEN 0 ELSE within_sla END AS INTEGER) AS within_sla",
}) + " FROM alerts"

_CLOSE_REPAIRS = _base_ctes() + f"""
SELECT id, alert_id, unit_id, line, station, CASE WHEN status = 'Open' THEN 'Closed' ELSE status END AS status,
       failure_description, rca_text, action_taken, capa_text, engineer_contact, created_at,
       CASE WHEN status = 'Open' THEN '{Q.ASOF}' ELSE updated_at END AS updated_at,
       CASE WHEN status = 'Open' THEN '{Q.ASOF}' ELSE closed_at END AS closed_at FROM repairs"""

_JSON_T = ('[{"rank":"BIGINT","testcode":"VARCHAR","process":"VARCHAR","failed_units":"BIGINT",'
           '"total_line":"BIGINT","rate":"DOUBLE","failed":"BIGINT","total":"BIGINT"}]')
_CODES = f"(CASE WHEN json_valid(top_testcodes) THEN from_json(top_testcodes, '{_JSON_T}') END)"

_NEWEST = ("newest", """SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY alert_id ORDER BY id DESC) AS rn
                         FROM repairs WHERE alert_id IS NOT NULL) WHERE rn = 1""")


def _filled(c, placeholder):
    return f"COALESCE(NULLIF(n.{c}, ''), '{placeholder}') AS {c}"


_OPEN_VIEW = _base_ctes(_NEWEST) + f"""
SELECT a.id, a.line, a.station, a.line_failure_rate, a.failed_tests, a.total_tests, a.alert_sent_at, age_min,
       CASE WHEN age_min > {K.SLA_HOURS * 60} THEN '🔴 SLA BREACH'
            ELSE CAST(age_min AS VARCHAR) || 'm/{K.SLA_HOURS * 60}m' END AS sla,
       CASE WHEN codes IS NULL THEN ' (n/a)' ELSE array_to_string(list_transform(codes, lambda e:
            chr(10) || '    ' || CAST(e.rank AS VARCHAR) || '. ' || e.testcode || ' ' || CAST(e.rate AS VARCHAR) || '% ('
            || COALESCE(CAST(COALESCE(e.failed_units, e.failed) AS VARCHAR), '?') || '/'
            || COALESCE(CAST(COALESCE(e.total_line, e.total) AS VARCHAR), '?') || ')'), '') END AS codes,
       {_filled('failure_description', L.NOT_FILLED)}, {_filled('rca_text', L.NOT_FILLED)},
       {_filled('action_taken', L.NOT_FILLED)}, {_filled('capa_text', L.NOT_FILLED)},
       {_filled('engineer_contact', L.NOT_FILLED)}, n.status AS repair_status
FROM (SELECT *, {_CODES} AS codes,
             CAST(CASE WHEN {_ISO} IS NULL THEN 0
                       ELSE floor(date_diff('second', {_ISO}, TIMESTAMP '{Q.ASOF}') / 60) END AS BIGINT) AS age_min
      FROM alerts WHERE resolved = 0) a
LEFT JOIN newest n ON n.alert_id = a.id"""

_HISTORY = _base_ctes(_NEWEST) + f"""
SELECT a.id, a.line, a.station, a.line_failure_rate, a.failed_tests, a.total_tests, a.alert_sent_at,
       a.resolved_at, a.resolution_mins, CASE WHEN a.within_sla = 1 THEN '✅' ELSE '🔴' END AS sla_icon,
       {_filled('failure_description', L.DASH)}, {_filled('rca_text', L.DASH)}, {_filled('action_taken', L.DASH)},
       {_filled('capa_text', L.DASH)}, {_filled('engineer_contact', L.DASH)}
FROM (SELECT * FROM alerts WHERE resolved = 1 ORDER BY resolved_at DESC, id DESC LIMIT 10) a
LEFT JOIN newest n ON n.alert_id = a.id"""

_STATS = _base_ctes() + """
, top AS (SELECT line AS worst_line, COUNT(*) AS worst_line_alerts FROM alerts GROUP BY 1
          ORDER BY worst_line_alerts DESC, worst_line LIMIT 1)
SELECT k.*, round_even(COALESCE(CAST(within_sla AS DOUBLE) / NULLIF(resolved, 0) * 100, 0.0), 1) AS within_sla_pct,
       top.worst_line, top.worst_line_alerts
FROM (SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE resolved = 0) AS open,
             COUNT(*) FILTER (WHERE resolved = 1) AS resolved,
             COUNT(*) FILTER (WHERE resolved = 1 AND within_sla = 1) AS within_sla,
             round_even(AVG(resolution_mins) FILTER (WHERE resolved = 1), 1) AS avg_resolution_mins FROM alerts) k,
     top"""

_SLA = _base_ctes() + """
SELECT *, round_even(COALESCE(CAST(within_sla AS DOUBLE) / NULLIF(resolved, 0) * 100, 0.0), 1) AS within_sla_pct
FROM (SELECT COUNT(*) AS resolved, CAST(COALESCE(SUM(within_sla), 0) AS BIGINT) AS within_sla,
             round_even(AVG(resolution_mins), 1) AS avg_mins, round_even(MIN(resolution_mins), 1) AS min_mins,
             round_even(MAX(resolution_mins), 1) AS max_mins FROM alerts WHERE resolved = 1)"""

_COUNTS = """(SELECT COUNT(*) FROM alerts WHERE resolved = 0) AS open_alerts,
       (SELECT COUNT(*) FROM alerts WHERE resolved = 1) AS resolved_alerts"""
_WINDOW_CTES = [Q.alert_facts_cte(), *Q.latest_cte()]


def _line_status_sql(limit: str) -> str:
    rate = "failed * CAST(100.0 AS DOUBLE) / total"
    return _base_ctes(*_WINDOW_CTES) + f"""
SELECT line, total, failed, round_even({rate}, 2) AS rate, round_even({rate}, 2) > {Q.THRESHOLD} AS above, {_COUNTS}
FROM (SELECT line, COUNT(*) AS total, CAST(SUM(CASE WHEN {Q.FAIL_SQL} THEN 1 ELSE 0 END) AS BIGINT) AS failed
      FROM latest GROUP BY line)
WHERE total >= {Q.MIN_SAMPLES} ORDER BY {rate} DESC, line {limit}"""


_DIAGNOSTICS = _base_ctes(*_WINDOW_CTES) + f"""
SELECT (SELECT COUNT(*) FROM facts) AS total_rows,
       (SELECT COUNT(*) FROM facts WHERE event_ts IS NULL) AS unparsable_rows,
       (SELECT COUNT(*) FROM win) AS raw_rows,
       (SELECT COUNT(*) FROM win WHERE {Q.FAIL_SQL}) AS raw_failures,
       (SELECT MIN(event_ts) FROM win) AS earliest,
       (SELECT MAX(event_ts) FROM win) AS latest,
       (SELECT COUNT(*) FROM latest) AS dedup_rows,
       (SELECT COUNT(*) FROM latest WHERE {Q.FAIL_SQL}) AS dedup_failures,
       (SELECT COUNT(*) FROM alerts WHERE resolved = 0) AS open_alerts"""

_BACKFILL = _base_ctes() + f"""
SELECT {_REPAIR_COLS.replace('alert_id,', f'CASE WHEN alert_id IS NULL AND {_UNIT_N} > 0 THEN {_UNIT_N} ELSE alert_id END AS alert_id,', 1)}
FROM repairs"""

_EVOLVE = _base_ctes() + "SELECT " + ", ".join(
    c if c in _OLD_REPAIR_COLS else f"CAST(NULL AS VARCHAR) AS {c}" for c in K.REPAIR_ACTIONS.fieldNames()) + \
    " FROM repairs"

_TOP_CODES_CTE = ("codes", f"""
  SELECT * FROM (SELECT line, code, process, failed_units,
                        ROW_NUMBER() OVER (PARTITION BY line ORDER BY failed_units DESC, code ASC NULLS LAST,
                                           process ASC NULLS LAST) AS rank
                 FROM (SELECT line, TRIM(split_part(failed_testcode, ';', 1)) AS code, process,
                              COUNT(*) AS failed_units FROM latest
                       WHERE {Q.FAIL_SQL} AND failed_testcode IS NOT NULL AND TRIM(failed_testcode) <> ''
                       GROUP BY 1, 2, 3)) WHERE rank <= {Q.TOP_CODES}""")


def _open_alert_ctes():
    return (with_ctes(Q.log_cte(), Q.alert_facts_cte(), *Q.latest_cte(),
                      ("alerts_src", fx.alerts_sql()), ("alerts", "SELECT * EXCLUDE (_day) FROM alerts_src"),
                      ("repairs", fx.REPAIRS_SQL),
                      ("rates", f"""SELECT line, total, failed, round_even(failed * CAST(100.0 AS DOUBLE) / total, 2) AS rate
                          FROM (SELECT line, COUNT(*) AS total,
                                       CAST(SUM(CASE WHEN {Q.FAIL_SQL} THEN 1 ELSE 0 END) AS BIGINT) AS failed
                                FROM latest GROUP BY line)
                          WHERE total >= {Q.MIN_SAMPLES} AND failed * CAST(100.0 AS DOUBLE) / total > {Q.THRESHOLD}
                          ORDER BY failed * CAST(100.0 AS DOUBLE) / total DESC, line LIMIT {Q.TOP_LINES}"""),
                      _TOP_CODES_CTE,
                      ("totals", "SELECT line, COUNT(*) AS total_line FROM latest GROUP BY line"),
                      ("cj", """SELECT c.line, CAST(to_json(list_sort(list({'rank': CAST(c.rank AS BIGINT),
                                   'testcode': COALESCE(NULLIF(c.code, ''), 'UNKNOWN'),
                                   'process': COALESCE(c.process, 'N/A'), 'failed_units': c.failed_units,
                                   'total_line': t.total_line,
                                   'rate': round_even(CAST(c.failed_units AS DOUBLE) / t.total_line * 100, 1)})))
                                   AS VARCHAR) AS top_testcodes
                            FROM codes c JOIN totals t ON c.line = t.line GROUP BY c.line"""),
                      ("st", f"""SELECT l.line, CASE WHEN b.failed IS NULL THEN l.line ELSE b.station END AS station
                          FROM (SELECT DISTINCT line FROM latest) l LEFT JOIN (
                            SELECT * FROM (SELECT line, station, COUNT(*) AS failed,
                              ROW_NUMBER() OVER (PARTITION BY line ORDER BY COUNT(*) DESC, station ASC NULLS LAST) AS rn
                              FROM latest WHERE {Q.FAIL_SQL} GROUP BY 1, 2) WHERE rn = 1) b ON l.line = b.line"""),
                      ("fresh", """SELECT r.*, cj.top_testcodes, st.station,
                                  ROW_NUMBER() OVER (ORDER BY r.rate DESC, r.line) AS n
                           FROM rates r LEFT JOIN cj USING (line) LEFT JOIN st USING (line)
                           WHERE r.line NOT IN (SELECT line FROM alerts WHERE resolved = 0)""")))


_OPEN_ALERTS = _open_alert_ctes() + f"""
SELECT CAST((SELECT COALESCE(MAX(id), 0) FROM alerts) + n AS BIGINT) AS id, 'log_data' AS source_table, line,
       COALESCE(station, line) AS station, rate AS line_failure_rate, total AS total_tests, failed AS failed_tests,
       COALESCE(top_testcodes, '[]') AS top_testcodes, '{Q.ASOF}' AS alert_sent_at, CAST(0 AS INTEGER) AS resolved,
       CAST(NULL AS VARCHAR) AS resolved_at, CAST(NULL AS DOUBLE) AS resolution_mins,
       CAST(NULL AS INTEGER) AS within_sla, CAST(NULL AS VARCHAR) AS telegram_msg_id
FROM fresh"""

_OPEN_REPAIRS = _open_alert_ctes() + f"""
SELECT CAST((SELECT COALESCE(MAX(id), 0) FROM repairs) + n AS BIGINT) AS id,
       CAST((SELECT COALESCE(MAX(id), 0) FROM alerts) + n AS BIGINT) AS alert_id,
       'ALERT-' || CAST((SELECT COALESCE(MAX(id), 0) FROM alerts) + n AS VARCHAR) AS unit_id,
       line, COALESCE(station, line) AS station, 'Open' AS status, CAST(NULL AS VARCHAR) AS failure_description,
       CAST(NULL AS VARCHAR) AS rca_text, CAST(NULL AS VARCHAR) AS action_taken, CAST(NULL AS VARCHAR) AS capa_text,
       CAST(NULL AS VARCHAR) AS engineer_contact, '{Q.ASOF}' AS created_at, '{Q.ASOF}' AS updated_at,
       CAST(NULL AS VARCHAR) AS closed_at
FROM fresh"""

def _fill_sql(template: str, values: dict) -> str:
    """SQL text concatenation of a ``{name}`` template (twin of lifecycle._fill)."""
    import re
    parts = re.split(r"\{(\w+)\}", template)
    out = []
    for i, piece in enumerate(parts):
        if i % 2 == 0:
            if piece:
                out.append("'" + piece.replace("'", "''").replace("\n", "' || chr(10) || '") + "'")
        else:
            v = values[piece]
            out.append(v if isinstance(v, str) and v.startswith("(") else "'" + str(v) + "'")
    return "(" + " || ".join(out) + ")"


def _alert_text_sql() -> str:
    line = _fill_sql(K.ALERT_CODE_LINE, {
        "rank": "(CAST(e.rank AS VARCHAR))", "testcode": "(e.testcode)", "process": "(e.process)",
        "failed": "(CAST(COALESCE(e.failed_units, e.failed) AS VARCHAR))",
        "total": "(CAST(COALESCE(e.total_line, e.total) AS VARCHAR))", "rate": "(CAST(e.rate AS VARCHAR))"})
    block = (f"(CASE WHEN COALESCE(len(codes), 0) > 0 THEN array_to_string(list_transform(codes, lambda e: {line}), '') "
             f"ELSE {_fill_sql(K.ALERT_NO_CODES, {})} END)")
    text = _fill_sql(K.ALERT_MESSAGE, {
        "bar": K.ALERT_BAR, "rule": K.ALERT_RULE, "line": "(line)", "station": "(station)",
        "rate": "(CAST(line_failure_rate AS VARCHAR))", "threshold": K.FAILURE_THRESHOLD,
        "failed": "(CAST(failed_tests AS VARCHAR))", "total": "(CAST(total_tests AS VARCHAR))",
        "window": K.WINDOW_MINUTES, "id": "(CAST(id AS VARCHAR))", "time": Q.ASOF, "sla": K.SLA_HOURS,
        "codes": block})
    return _base_ctes() + f"SELECT id AS alert_id, {text} AS text FROM (SELECT *, {_CODES} AS codes FROM alerts)"


ORACLES = {
    "parse_replies": _base_ctes() + "SELECT * FROM events",
    "repair_rows": _base_ctes(*_links_ctes("'response', 'media'")) + "SELECT * FROM links",
    "apply_responses": _APPLY,
    "attach_media_repairs": _base_ctes(*_links_ctes("'media'")) + "SELECT * FROM reps",
    "attach_media": _MEDIA,
    "resolve_alerts": _RESOLVE_ALERTS,
    "resolve_repairs": _RESOLVE_REPAIRS,
    "resolve_results": _RESOLVE_RESULTS,
    "close_all": _CLOSE_ALERTS,
    "close_all_repairs": _CLOSE_REPAIRS,
    "close_all_count": _base_ctes() + "SELECT COUNT(*) FILTER (WHERE resolved = 0) AS closed FROM alerts",
    "open_alerts": _OPEN_ALERTS,
    "open_alert_repairs": _OPEN_REPAIRS,
    "alert_text": _alert_text_sql(),
    "open_view": _OPEN_VIEW,
    "history_view": _HISTORY,
    "window_diagnostics_alerts": _DIAGNOSTICS,
    "line_status_alerts": _line_status_sql(""),
    "line_status_top10": _line_status_sql("LIMIT 10"),
    "alert_stats": _STATS,
    "sla_report": _SLA,
    "backfill_alert_id": _BACKFILL,
    "evolve_schema": _EVOLVE,
}
