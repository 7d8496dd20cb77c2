"""Alert and repair lifecycle.

The reproduced system updates SQLite rows in place. Here every step is a
function "current state + new events -> new state" over DataFrames: events
are reduced per key with ``max_by``/``min_by`` (last write / first resolve
wins, ordered by (ts, msg_id)), joined to the state and merged with
``coalesce``; ids are assigned once and never change. State tables keep the
schemas in ``schemas.py`` (FAILURE_ALERTS, REPAIR_ACTIONS, REPAIR_MEDIA).

Timestamps in the state tables are text ``yyyy-MM-dd HH:mm:ss`` as in the
original tables; ``asof`` is always an argument.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as K
from ..functions import columns as C
from .frames import attach, single_row

TS_FMT = "yyyy-MM-dd HH:mm:ss"
NOT_FILLED = K.NOT_FILLED
DASH = K.DASH


def _fill(template: str, values: dict) -> Column:
    """Fill a ``{name}`` text template with columns / constants, in order."""
    import re
    parts = re.split(r"\{(\w+)\}", template)
    cols = []
    for i, piece in enumerate(parts):
        if i % 2 == 0:
            if piece:
                cols.append(F.lit(piece))
        else:
            v = values[piece]
            cols.append(v if isinstance(v, Column) else F.lit(str(v)))
    return F.concat(*cols)


def _ts_text(c: Column) -> Column:
    return F.date_format(c, TS_FMT)


def _lit_ts(asof: str) -> Column:
    return F.lit(asof).cast("timestamp_ntz")


# --- P19-P21: engineer messages -> events ---------------------------------------

def _int_text(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t.rlike("^[+-]?\\d+$"), t.try_cast("bigint"))


def parse_messages(messages: DataFrame) -> DataFrame:
    """P19 + P20 + P21: one event per message.

    Output: ``msg_id ts user kind action field value alert_id outcome``
    where action is ``response`` / ``resolve`` / ``media`` and outcome is
    ``ok`` or a rejection reason (format / id / unknown command). The text
    pieces are staged as columns so every rule reads attributes."""
    st, up, raw, kind = F.col("_st"), F.col("_up"), F.col("text"), F.col("kind")
    staged = (messages
              .withColumn("_st", C.strip_ws(F.col("text")))
              .withColumn("_up", F.upper(F.col("_st")))
              .withColumn("_p3", F.split(F.col("_st"), ":", 3))
              .withColumn("_p2", F.split(F.col("_st"), ":", 2))
              .withColumn("_b3", F.split(F.col("text"), "_", 3)))
    p3, p2, b3 = F.col("_p3"), F.col("_p2"), F.col("_b3")
    resp = None
    field = None
    for prefix, name in K.REPLY_FIELDS:
        hit = up.startswith(prefix)
        resp = hit if resp is None else resp | hit
        field = F.when(hit, F.lit(name)) if field is None else field.when(hit, F.lit(name))
    rule = (F.when((kind == "text") & resp, "response")
            .when((kind == "text") & up.startswith("RESOLVE:"), "resolve")
            .when((kind == "photo") & up.startswith("IMG:"), "media")
            .when((kind == "button") & raw.startswith("act_"), "button_response")
            .when((kind == "button") & raw.startswith("resolve_"), "button_resolve"))
    staged = staged.withColumn("_rule", rule)
    r = F.col("_rule")
    one, two = F.trim(F.get(p3, 1)), F.trim(F.get(p3, 2))
    after_first = F.trim(F.get(p2, 1))
    alert_id = (F.when(r == "response", _int_text(one))
                .when(r == "resolve", _int_text(after_first))
                .when(r == "media", _int_text(one))
                .when(r == "button_response", _int_text(F.get(b3, 1)))
                .when(r == "button_resolve", _int_text(F.get(b3, 1))))
    value = (F.when(r == "response", two)
             .when(r == "media", F.coalesce(two, F.lit("")))
             .when(r == "button_response", F.get(b3, 2)))
    fmt_ok = (F.when(r == "response", (F.size(p3) >= 3) & (F.coalesce(one, F.lit("")) != "")
                     & (F.coalesce(two, F.lit("")) != ""))
              .when(r == "resolve", F.coalesce(after_first, F.lit("")) != "")
              .when(r == "media", F.coalesce(one, F.lit("")) != "")
              .when(r == "button_response", F.size(b3) >= 3)
              .otherwise(F.lit(True)))
    out = staged.select(
        "msg_id", "ts", "user", "kind",
        F.when(r.isin("response", "button_response"), "response")
         .when(r.isin("resolve", "button_resolve"), "resolve").when(r == "media", "media").alias("action"),
        F.when(r == "response", field).when(r == "button_response", F.lit("action_taken")).alias("field"),
        value.alias("value"), alert_id.alias("alert_id"), fmt_ok.alias("_fmt"), r)
    outcome = (F.when(F.col("_rule").isNull(), "unknown command")
               .when(~F.col("_fmt"), "format")
               .when(F.col("alert_id").isNull(), "id not a number")
               .otherwise("ok"))
    return out.withColumn("outcome", outcome).drop("_fmt", "_rule")


def valid_events(events: DataFrame, alerts: DataFrame) -> DataFrame:
    """Events that parsed and name an existing alert (semi join)."""
    return (events.where(F.col("outcome") == "ok")
            .join(alerts.select(F.col("id").alias("alert_id")), "alert_id", "left_semi"))


def rejected_events(events: DataFrame, alerts: DataFrame) -> DataFrame:
    """Parsed events naming an unknown alert, plus malformed ones."""
    known = alerts.select(F.col("id").alias("alert_id"))
    unknown = (events.where(F.col("outcome") == "ok").join(known, "alert_id", "left_anti")
               .withColumn("outcome", F.lit("alert not found")))
    return events.where(F.col("outcome") != "ok").unionByName(unknown)


# --- S11 / S12 -----------------------------------------------------------------

def evolve(df: DataFrame, schema) -> DataFrame:
    """Add every column of ``schema`` that ``df`` lacks as typed nulls,
    in schema order (old rows read null)."""
    have = set(df.columns)
    cols = [F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name)
            for f in schema.fields]
    extra = [F.col(c) for c in df.columns if c not in {f.name for f in schema.fields}]
    return df.select(*cols, *extra)


def backfill_alert_id(repairs: DataFrame) -> DataFrame:
    """Null ``alert_id`` taken from a ``unit_id`` like 'ALERT-<n>' (any case, the number its
    leading digits) when n > 0."""
    tail = F.regexp_extract(F.substr(F.col("unit_id"), F.lit(7)), "^\\s*([+-]?\\d+)", 1)
    n = F.when(F.upper("unit_id").startswith("ALERT-"), tail.try_cast("bigint"))
    return repairs.withColumn("alert_id", F.when(F.col("alert_id").isNull() & (n > 0), n)
                              .otherwise(F.col("alert_id")))


def _exact_unit() -> Column:
    """The alert id of a ``unit_id`` that is exactly 'ALERT-<id>' as ids are written; else null."""
    return F.when(F.col("unit_id").rlike("^ALERT-(0|-?[1-9]\\d*)$"),
                  F.substr(F.col("unit_id"), F.lit(7)).try_cast("bigint"))


# --- L2: get or create the repair row of an alert ------------------------------

def repair_for(alerts: DataFrame, repairs: DataFrame, alert_ids: DataFrame, asof: str | None):
    """L2 for a set of alert ids. Returns ``(links, repairs')`` where links
    maps ``alert_id -> repair_id`` and repairs' is the repair table after
    attaching found ``ALERT-<id>`` rows and creating missing rows, at ``asof`` or, without one, at the
    first ``ts`` of their alert id."""
    if asof is None:
        ids = alert_ids.groupBy("alert_id").agg(F.min("ts").alias("_now"))
    else:
        ids = alert_ids.select("alert_id").distinct().withColumn("_now", _lit_ts(asof))
    ids = ids.join(alerts.select(F.col("id").alias("alert_id"), "line", "station"), "alert_id")
    by_alert = (repairs.where(F.col("alert_id").isNotNull()).groupBy("alert_id")
                .agg(F.max("id").alias("_by_alert")))
    unit_n = _exact_unit()
    by_unit = (repairs.where(unit_n.isNotNull()).groupBy(unit_n.alias("alert_id"))
               .agg(F.max("id").alias("_by_unit")))
    j = ids.join(by_alert, "alert_id", "left").join(by_unit, "alert_id", "left")
    max_id = repairs.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_max"))
    need = j.where(F.col("_by_alert").isNull() & F.col("_by_unit").isNull())
    # new ids: current maximum + alert id (unique per alert, no global rank)
    created = (attach(need, max_id)
               .select((F.col("_max") + F.col("alert_id")).cast("long").alias("id"),
                       F.col("alert_id").cast("long"),
                       F.concat(F.lit("ALERT-"), F.col("alert_id").cast("string")).alias("unit_id"),
                       "line", "station", F.lit("Open").alias("status"),
                       _ts_text(F.col("_now")).alias("created_at"), _ts_text(F.col("_now")).alias("updated_at")))
    links = (j.select("alert_id", F.coalesce("_by_alert", "_by_unit").alias("repair_id"))
             .where(F.col("repair_id").isNotNull())
             .unionByName(created.select("alert_id", F.col("id").alias("repair_id"))))
    found = j.where(F.col("_by_alert").isNull() & F.col("_by_unit").isNotNull()) \
        .select(F.col("_by_unit").alias("id"), F.col("alert_id").alias("_attach"))
    out = (repairs.join(found, "id", "left")
           .withColumn("alert_id", F.coalesce(F.col("_attach"), F.col("alert_id"))).drop("_attach"))
    out = out.unionByName(evolve(created, K.REPAIR_ACTIONS), allowMissingColumns=True)
    return links, evolve(out, K.REPAIR_ACTIONS)


# --- L3 / L4 / L5 / L6 ------------------------------------------------------------

def _responses(events: DataFrame) -> DataFrame:
    return events.where((F.col("action") == "response") & F.col("field").isin(*K.RESPONSE_FIELDS))


def apply_responses(alerts: DataFrame, repairs: DataFrame, events: DataFrame, asof: str) -> DataFrame:
    """L3: allowed fields only; per (repair row, field) the last value wins
    (ordered by ts, msg_id); engineer and updated_at from the last event."""
    ev = _responses(valid_events(events, alerts))
    links, reps = repair_for(alerts, repairs, ev, asof)
    return _answered(reps, links, ev)


def _answered(reps: DataFrame, links: DataFrame, responses: DataFrame) -> DataFrame:
    ev = responses.join(links, "alert_id")
    order = F.struct("ts", "msg_id")
    per_field = (ev.groupBy("repair_id").pivot("field", K.RESPONSE_FIELDS)
                 .agg(F.max_by("value", order)))
    last = ev.groupBy("repair_id").agg(F.max_by(F.struct("user", "ts"), order).alias("_last"))
    upd = per_field.join(last, "repair_id")
    j = reps.join(upd.withColumnRenamed("repair_id", "id"), "id", "left")
    return j.select(*[
        (F.coalesce(upd[f], reps[f]).alias(f) if f in K.RESPONSE_FIELDS else
         F.when(F.col("_last").isNotNull(), F.col("_last.user")).otherwise(reps["engineer_contact"])
         .alias("engineer_contact") if f == "engineer_contact" else
         F.when(F.col("_last").isNotNull(), _ts_text(F.col("_last.ts"))).otherwise(reps["updated_at"])
         .alias("updated_at") if f == "updated_at" else reps[f])
        for f in K.REPAIR_ACTIONS.fieldNames()])


def attach_media(alerts: DataFrame, repairs: DataFrame, events: DataFrame, asof: str):
    """L4 + P20: ``(media, repairs')``: media rows of valid photo events, linked to the repair
    row, and the repair table with the rows that were attached or created for them."""
    ev = valid_events(events, alerts).where(F.col("action") == "media")
    links, repairs2 = repair_for(alerts, repairs, ev, asof)
    return _media_rows(links, ev), repairs2


def _media_rows(links: DataFrame, photos: DataFrame) -> DataFrame:
    ev = photos.join(links, "alert_id")
    fname = F.concat(F.lit("alert"), F.col("alert_id").cast("string"), F.lit("_"),
                     F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit("_"), F.col("user"), F.lit(".jpg"))
    return ev.select(F.col("msg_id").alias("id"), F.col("repair_id").cast("long"), F.col("alert_id").cast("long"),
                     fname.alias("filepath"), F.col("value").alias("caption"), F.col("user").alias("uploaded_by"),
                     F.lit("image").alias("media_type"), _ts_text(F.col("ts")).alias("uploaded_at"))


def handle_events(alerts: DataFrame, repairs: DataFrame, events: DataFrame, sla_hours: int = K.SLA_HOURS) -> dict[str, DataFrame]:
    """L2-L5 for parsed messages of all kinds, as if handled one by one in the order of (ts, msg_id): ``alerts``,
    ``repairs`` and ``media`` after them, ``results`` of the resolve events and the ``rejected`` events. Splitting the
    events by time and handling the parts in turn gives the same."""
    valid = valid_events(events, alerts)
    responses = _responses(valid)
    touching = valid.where((F.col("action") == "media")
                           | ((F.col("action") == "response") & F.col("field").isin(*K.RESPONSE_FIELDS)))
    links, linked = repair_for(alerts, repairs, touching, None)
    alerts2, closed, results = resolve(alerts, _answered(linked, links, responses), events, sla_hours)
    # a response after the alert was resolved is the last change of its row
    last = (responses.join(links, "alert_id").groupBy(F.col("repair_id").alias("_rid"))
            .agg(_ts_text(F.max("ts")).alias("_late")))
    later = F.col("_late") > F.col("closed_at")
    repairs2 = (closed.join(last, closed["id"] == F.col("_rid"), "left")
                .withColumn("updated_at", F.when(later, F.col("_late")).otherwise(F.col("updated_at")))
                .select(*K.REPAIR_ACTIONS.fieldNames()))
    photos = valid.where(F.col("action") == "media")
    return {"alerts": alerts2, "repairs": repairs2, "media": _media_rows(links, photos), "results": results,
            "rejected": rejected_events(events, alerts)}


def resolve(alerts: DataFrame, repairs: DataFrame, events: DataFrame,
            sla_hours: int = K.SLA_HOURS):
    """The first resolve event of each open alert resolves it: minutes
    since sent (1 place; unparsable sent time -> 0), within SLA when
    <= sla_hours * 60; repair rows of the alert (by id or ``ALERT-<id>``)
    are closed. Returns ``(alerts', repairs', results)``; results holds one
    row per resolve event with ``ok`` and, when not ok, the reason."""
    ev = events.where((F.col("outcome") == "ok") & (F.col("action") == "resolve"))
    first = ev.groupBy("alert_id").agg(F.min_by(F.struct("ts", "msg_id"), F.struct("ts", "msg_id")).alias("_f"))
    opened = alerts.where(F.col("resolved") == 0).select(F.col("id").alias("alert_id"), "alert_sent_at")
    win = first.join(opened, "alert_id")
    sent = C.parse_iso_ts(F.col("alert_sent_at"))
    mins = F.when(sent.isNull(), F.lit(0.0)).otherwise(
        F.bround(F.timestamp_diff("SECOND", sent, F.col("_f.ts")).cast("double") / 60, 1))
    res = win.select("alert_id", F.col("_f.ts").alias("_rts"), F.col("_f.msg_id").alias("_rmsg"),
                     mins.alias("_mins"))
    res = res.withColumn("_within", (F.col("_mins") <= sla_hours * 60).cast("int"))
    a = alerts.join(res.withColumnRenamed("alert_id", "id"), "id", "left")
    hit = F.col("_rts").isNotNull()
    alerts2 = a.select(*[
        F.when(hit, F.lit(1)).otherwise(F.col("resolved")).cast("int").alias("resolved") if f == "resolved" else
        F.when(hit, _ts_text(F.col("_rts"))).otherwise(F.col("resolved_at")).alias("resolved_at")
        if f == "resolved_at" else
        F.when(hit, F.col("_mins")).otherwise(F.col("resolution_mins")).alias("resolution_mins")
        if f == "resolution_mins" else
        F.when(hit, F.col("_within")).otherwise(F.col("within_sla")).cast("int").alias("within_sla")
        if f == "within_sla" else F.col(f)
        for f in K.FAILURE_ALERTS.fieldNames()])
    # repairs closed by alert id, or by unit ALERT-<id> with no other alert id
    unit_n = _exact_unit()
    r = repairs.withColumn("_unit", unit_n)
    close = res.select(F.col("alert_id").alias("_cid"), F.col("_rts").alias("_cts"))
    by_id = r.join(close, r["alert_id"] == close["_cid"], "left").select(*r.columns, F.col("_cts").alias("_c1"))
    by_unit = by_id.join(close.withColumnRenamed("_cid", "_uid").withColumnRenamed("_cts", "_c2"),
                         (F.col("_unit") == F.col("_uid"))
                         & (F.col("alert_id").isNull() | (F.col("alert_id") == F.col("_uid"))), "left")
    cts = F.coalesce("_c1", "_c2")
    repairs2 = by_unit.select(*[
        F.when(cts.isNotNull(), F.lit("Closed")).otherwise(F.col("status")).alias("status") if f == "status" else
        F.when(cts.isNotNull(), _ts_text(cts)).otherwise(F.col(f)).alias(f) if f in ("closed_at", "updated_at")
        else F.col(f) for f in K.REPAIR_ACTIONS.fieldNames()])
    results = (ev.join(res.select("alert_id", "_rmsg", "_mins", "_within"), "alert_id", "left")
               .select("msg_id", "alert_id", (F.col("msg_id") == F.col("_rmsg")).alias("_ok"), "_mins", "_within"))
    results = results.select(
        "msg_id", "alert_id", F.coalesce("_ok", F.lit(False)).alias("ok"),
        F.when(F.col("_ok"), F.col("_mins")).alias("minutes"),
        F.when(F.col("_ok"), F.col("_within")).alias("within_sla"),
        F.when(~F.coalesce("_ok", F.lit(False)), F.lit("not found or already resolved")).alias("reason"))
    return alerts2, repairs2, results


def close_all(alerts: DataFrame, repairs: DataFrame, asof: str):
    """Every open alert resolved with 0 minutes and within_sla 0; every
    open repair closed. Returns ``(alerts', repairs', closed_count)`` where
    the count is a one-row DataFrame."""
    now = _ts_text(_lit_ts(asof))
    is_open = F.col("resolved") == 0
    alerts2 = alerts.select(*[
        F.when(is_open, F.lit(1)).otherwise(F.col(f)).cast("int").alias(f) if f == "resolved" else
        F.when(is_open, now).otherwise(F.col(f)).alias(f) if f == "resolved_at" else
        F.when(is_open, F.lit(0.0)).otherwise(F.col(f)).alias(f) if f == "resolution_mins" else
        F.when(is_open, F.lit(0)).otherwise(F.col(f)).cast("int").alias(f) if f == "within_sla" else F.col(f)
        for f in K.FAILURE_ALERTS.fieldNames()])
    ro = F.col("status") == "Open"
    repairs2 = repairs.select(*[
        F.when(ro, F.lit("Closed")).otherwise(F.col(f)).alias(f) if f == "status" else
        F.when(ro, now).otherwise(F.col(f)).alias(f) if f in ("closed_at", "updated_at") else F.col(f)
        for f in K.REPAIR_ACTIONS.fieldNames()])
    count = alerts.agg(F.count_if(is_open).cast("long").alias("closed"))
    return alerts2, repairs2, count


# --- L1 / J7 / P22 / P24: opening alerts ----------------------------------------

def codes_json(codes: DataFrame) -> DataFrame:
    """P24 encode: per line the ranked codes as a JSON array."""
    return (codes.groupBy("line")
            .agg(F.to_json(F.array_sort(F.collect_list(F.struct(
                "rank", "testcode", "process", "failed_units", "total_line", "rate")))).alias("top_testcodes")))


def read_codes(json_text: Column) -> Column:
    """P24 decode: array of code structs; old key names ``failed`` / ``total``
    are folded into ``failed_units`` / ``total_line``."""
    arr = F.from_json(json_text, K.TOP_CODE_READ)
    return F.transform(arr, lambda e: F.struct(
        e["rank"].alias("rank"), e["testcode"].alias("testcode"), e["process"].alias("process"),
        F.coalesce(e["failed_units"], e["failed"]).alias("failed_units"),
        F.coalesce(e["total_line"], e["total"]).alias("total_line"), e["rate"].alias("rate")))


def ensure_repairs(rates: DataFrame, alerts: DataFrame, repairs: DataFrame, asof: str) -> DataFrame:
    """L1 + L2 for breaching lines whose alert is still open: the repair table with a row for
    the newest open alert of each."""
    newest = (alerts.where(F.col("resolved") == 0).groupBy("line").agg(F.max("id").alias("alert_id"))
              .join(rates.select("line"), "line", "left_semi"))
    return repair_for(alerts, repairs, newest.select("alert_id"), asof)[1]


def open_alerts(rates: DataFrame, codes: DataFrame, stations: DataFrame, alerts: DataFrame,
                repairs: DataFrame, asof: str | None, source_table: str = "log_data"):
    """L1 + J7: an alert (and its ``Open`` repair row ``ALERT-<id>``) for
    each breaching line without an open alert; ids continue after the
    current maximum in rate order. ``rates`` is already the top N (Q13); with
    ``asof`` None it names each line's own time (``asof``, TIMESTAMP_NTZ), and ids go by time first.
    Returns ``(new_alerts, new_repairs)``."""
    open_lines = alerts.where(F.col("resolved") == 0).select("line")
    fresh = rates.join(open_lines, "line", "left_anti")
    fresh = (fresh.join(codes_json(codes), "line", "left")
             .join(stations.select("line", F.col("station").alias("_st")), "line", "left"))
    mx = alerts.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_amax"))
    rmx = repairs.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_rmax"))
    first = [] if asof else [F.col("asof")]
    w = Window.orderBy(*first, F.col("rate").desc(), F.col("line"))  # a row per breaching line at most
    base = attach(attach(fresh, mx), rmx).withColumn("_n", F.row_number().over(w))
    now = _ts_text(_lit_ts(asof) if asof else F.col("asof"))
    new_alerts = base.select(
        (F.col("_amax") + F.col("_n")).cast("long").alias("id"), F.lit(source_table).alias("source_table"),
        "line", F.coalesce("_st", "line").alias("station"), F.col("rate").alias("line_failure_rate"),
        F.col("total").alias("total_tests"), F.col("failed").alias("failed_tests"),
        F.coalesce("top_testcodes", F.lit("[]")).alias("top_testcodes"), now.alias("alert_sent_at"),
        F.lit(0).alias("resolved"))
    new_repairs = base.select(
        (F.col("_rmax") + F.col("_n")).cast("long").alias("id"),
        (F.col("_amax") + F.col("_n")).cast("long").alias("alert_id"),
        F.concat(F.lit("ALERT-"), (F.col("_amax") + F.col("_n")).cast("string")).alias("unit_id"),
        "line", F.coalesce("_st", "line").alias("station"), F.lit("Open").alias("status"),
        now.alias("created_at"), now.alias("updated_at"))
    return evolve(new_alerts, K.FAILURE_ALERTS), evolve(new_repairs, K.REPAIR_ACTIONS)


def alert_text(alerts: DataFrame, asof: str, threshold: float = K.FAILURE_THRESHOLD,
               window_minutes: int = K.WINDOW_MINUTES, sla_hours: int = K.SLA_HOURS) -> DataFrame:
    """The notification text of each alert (layout ``schemas.ALERT_MESSAGE``)."""
    codes = read_codes(F.col("top_testcodes"))
    block = F.concat_ws("", F.transform(codes, lambda e: _fill(K.ALERT_CODE_LINE, {
        "rank": e["rank"].cast("string"), "testcode": e["testcode"], "process": e["process"],
        "failed": e["failed_units"].cast("string"), "total": e["total_line"].cast("string"),
        "rate": e["rate"].cast("string")})))
    block = F.when(F.coalesce(F.size(codes), F.lit(0)) > 0, block).otherwise(F.lit(K.ALERT_NO_CODES))
    text = _fill(K.ALERT_MESSAGE, {
        "bar": K.ALERT_BAR, "rule": K.ALERT_RULE, "line": F.col("line"), "station": F.col("station"),
        "rate": F.col("line_failure_rate").cast("string"), "threshold": threshold,
        "failed": F.col("failed_tests").cast("string"), "total": F.col("total_tests").cast("string"),
        "window": window_minutes, "id": F.col("id").cast("string"), "time": asof, "sla": sla_hours,
        "codes": block})
    return alerts.select(F.col("id").alias("alert_id"), text.alias("text"))


# --- L7 / L8 / J3 / J4 / P23: views ------------------------------------------------

def _newest_repair(repairs: DataFrame) -> DataFrame:
    """J3/J4 right side: one repair row per alert, the newest (Q22)."""
    cols = ["rca_text", "action_taken", "capa_text", "failure_description", "engineer_contact", "status"]
    return (repairs.where(F.col("alert_id").isNotNull()).groupBy("alert_id")
            .agg(F.max_by(F.struct(F.col("id").alias("ra_id"), *cols), F.col("id")).alias("_r"))
            .select("alert_id", "_r.*"))


def open_view(alerts: DataFrame, repairs: DataFrame, asof: str, sla_hours: int = K.SLA_HOURS) -> DataFrame:
    """L7 + J3 + P23 + P24: open alerts, newest first, with the newest repair
    row, age in whole minutes, SLA label and ranked codes."""
    r = _newest_repair(repairs)
    a = alerts.where(F.col("resolved") == 0)
    j = a.join(r, a["id"] == r["alert_id"], "left")
    sent = C.parse_iso_ts(F.col("alert_sent_at"))
    age = F.when(sent.isNull(), F.lit(0)).otherwise(
        F.floor(F.timestamp_diff("SECOND", sent, _lit_ts(asof)) / 60)).cast("long")
    sla_min = sla_hours * 60
    label = F.when(F.col("age_min") > sla_min, F.lit(K.SLA_BREACH)).otherwise(
        _fill(K.SLA_AGE, {"age": F.col("age_min").cast("string"), "sla": sla_min}))
    codes = read_codes(F.col("top_testcodes"))
    summary = F.concat_ws("", F.transform(codes, lambda e: _fill(K.OPEN_VIEW_CODE_LINE, {
        "rank": e["rank"].cast("string"), "testcode": e["testcode"], "rate": e["rate"].cast("string"),
        "failed": F.coalesce(e["failed_units"].cast("string"), F.lit("?")),
        "total": F.coalesce(e["total_line"].cast("string"), F.lit("?"))})))
    filled = lambda c: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit(NOT_FILLED)).alias(c)
    return (j.withColumn("age_min", age)
            .select(a["id"].alias("id"), "line", "station", "line_failure_rate", "failed_tests", "total_tests",
                    "alert_sent_at", "age_min", label.alias("sla"),
                    F.when(codes.isNull(), F.lit(" (n/a)")).otherwise(summary).alias("codes"),
                    filled("failure_description"), filled("rca_text"), filled("action_taken"),
                    filled("capa_text"), filled("engineer_contact"), F.col("status").alias("repair_status"))
            .orderBy(F.col("alert_sent_at").desc(), F.col("id").desc()))


def history_view(alerts: DataFrame, repairs: DataFrame, k: int = 10) -> DataFrame:
    """L8 + J4: the newest ``k`` resolved alerts with the newest repair row."""
    r = _newest_repair(repairs)
    a = alerts.where(F.col("resolved") == 1)
    top = a.orderBy(F.col("resolved_at").desc(), F.col("id").desc()).limit(k)
    j = top.join(r, top["id"] == r["alert_id"], "left")
    dash = lambda c: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit(DASH)).alias(c)
    return (j.select(top["id"].alias("id"), "line", "station", "line_failure_rate", "failed_tests",
                    "total_tests", "alert_sent_at", "resolved_at", "resolution_mins",
                    F.when(F.col("within_sla") == 1, F.lit(K.ICON_WITHIN_SLA))
                    .otherwise(F.lit(K.ICON_SLA_BREACHED)).alias("sla_icon"),
                    dash("failure_description"), dash("rca_text"), dash("action_taken"),
                    dash("capa_text"), dash("engineer_contact"))
            .orderBy(F.col("resolved_at").desc(), F.col("id").desc()))


# --- A35 / A36 -----------------------------------------------------------------------

def stats(alerts: DataFrame) -> DataFrame:
    """Totals, SLA share, mean minutes and the line with most alerts."""
    res = F.col("resolved") == 1
    agg = alerts.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("resolved") == 0).cast("long").alias("open"),
        F.count_if(res).cast("long").alias("resolved"),
        F.count_if(res & (F.col("within_sla") == 1)).cast("long").alias("within_sla"),
        F.bround(F.avg(F.when(res, F.col("resolution_mins"))), 1).alias("avg_resolution_mins"))
    agg = agg.withColumn("within_sla_pct", C.pct("within_sla", "resolved", 1))
    top = (alerts.groupBy("line").agg(F.count(F.lit(1)).alias("worst_line_alerts"))
           .orderBy(F.col("worst_line_alerts").desc(), F.col("line")).limit(1)
           .withColumnRenamed("line", "worst_line"))
    return single_row(agg, top)


def sla(alerts: DataFrame) -> DataFrame:
    """Resolved count, within SLA, %, mean / fastest / slowest minutes."""
    r = alerts.where(F.col("resolved") == 1)
    out = r.agg(F.count(F.lit(1)).alias("resolved"),
                F.coalesce(F.sum("within_sla"), F.lit(0)).cast("long").alias("within_sla"),
                F.bround(F.avg("resolution_mins"), 1).alias("avg_mins"),
                F.bround(F.min("resolution_mins"), 1).alias("min_mins"),
                F.bround(F.max("resolution_mins"), 1).alias("max_mins"))
    return out.withColumn("within_sla_pct", C.pct("within_sla", "resolved", 1))
