"""Alert and repair state that changes while jobs run (ST8, L2-L6, P19-P21).

The reproduced system handles each reply, photo and button as it comes and updates its
rows. Here alerts and repair rows are state tables of a ``Store``: the alert job opens alerts against
their current rows, and the message job applies a micro-batch of messages and commits the rows that
changed, so a resolved alert lets its line alert again. Messages that change nothing are kept with the
reason. A replayed micro-batch is left out.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession

from .. import schemas as K
from ..operators import lifecycle as L
from ..sources.store import FANOUT, Store, Table, changed

EVENTS = ("msg_id long, ts timestamp_ntz, user string, kind string, action string, field string, value string, "
          "alert_id long, outcome string")
RESULTS = "msg_id long, alert_id long, ok boolean, minutes double, within_sla int, reason string"
TABLES = {
    "failure_alerts": Table(K.FAILURE_ALERTS, key="id"),
    "repair_actions": Table(K.REPAIR_ACTIONS, key="id"),
    "repair_media": Table(K.REPAIR_MEDIA, key="id"),
    "rejected_messages": Table(EVENTS),
    "resolve_results": Table(RESULTS),
}


def state_store(spark: SparkSession, root: str, fanout: int = FANOUT) -> Store:
    """The state tables of the alert and message jobs under ``root``."""
    return Store(spark, root, TABLES, fanout)


def seed(store: Store, alerts: DataFrame, repairs: DataFrame) -> None:
    """Take over the state of another system, once."""
    store.commit({"failure_alerts": alerts, "repair_actions": L.evolve(repairs, K.REPAIR_ACTIONS)}, "seed", 0)


def message_batch(messages: DataFrame, batch_id: int, root: str, run: str = "messages", sla_hours: int = K.SLA_HOURS) -> None:
    """One micro-batch of messages (``K.MESSAGES``) applied to the state, as one commit."""
    store = state_store(messages.sparkSession, root)
    if store.has(run, batch_id):
        return
    alerts, repairs = store.newest("failure_alerts").persist(), store.newest("repair_actions").persist()
    events = L.parse_messages(messages).select(*[c.split()[0] for c in EVENTS.split(", ")]).persist()
    try:
        done = L.handle_events(alerts, repairs, events, sla_hours)
        store.commit({"failure_alerts": changed(done["alerts"], alerts, "id"),
                      "repair_actions": changed(done["repairs"], repairs, "id"),
                      "repair_media": done["media"], "rejected_messages": done["rejected"],
                      "resolve_results": done["results"]}, run, batch_id)
    finally:
        for held in (events, alerts, repairs):
            held.unpersist()


def joins_shuffle(batch: DataFrame) -> None:
    """Joins of a stream's batches move no table over the driver: a held table is known by its packed size, which says little
    of the rows that a broadcast would collect. The setting is that of the stream's own session, not of the caller's."""
    batch.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")


def close_all(root: str, spark: SparkSession, asof: str, run: str, batch_id: int) -> None:
    """Every open alert and repair row closed, as one commit."""
    store = state_store(spark, root)
    alerts, repairs = store.newest("failure_alerts"), store.newest("repair_actions")
    alerts2, repairs2, _ = L.close_all(alerts, repairs, asof)
    store.commit({"failure_alerts": changed(alerts2, alerts, "id"), "repair_actions": changed(repairs2, repairs, "id")},
                 run, batch_id)


def start_messages(stream: DataFrame, root: str, checkpoint: str, trigger: dict | None = None,
                   sla_hours: int = K.SLA_HOURS):
    """The message job; ``stream`` has the columns of ``K.MESSAGES``, in the order of their time."""
    run = f"{zlib.crc32(checkpoint.encode()):08x}"

    def batch(df: DataFrame, bid: int) -> None:
        joins_shuffle(df)
        message_batch(df, bid, root, run, sla_hours)

    w = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return w.trigger(**(trigger or {"processingTime": "1 second"})).start()
