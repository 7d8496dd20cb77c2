"""

Each query is executed in full through the ``noop`` sink (nothing is
collected to the driver): one warm-up pass over all queries, then
$BENCH_RUNS interleaved rounds; the median per query is reported. Prints
one JSON line, with the seconds that building each plan took (``plan``, no job run).
$BENCH_FACTOR > 1 multiplies ``events`` (new ids and units, a copy in a scratch folder) to show
the cost per row at larger inputs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from yieldlens.plans import registry  # noqa: E402
from yieldlens.session import build_session  # noqa: E402

HEADLINE = {
    "lines_above_threshold": "lines_above_threshold",     # W1 dedup + A31
    "track_classes_span": "track_classes_span",           # A17
    "failure_hierarchy": "failure_hierarchy",             # A11
    "hourly_gap": "hourly_gap",                           # A29 + J9 (parse included)
    "parse_th4": "parse_th4",                             # P1-P6 over every file's text
    "route_outcomes": "route_outcomes",                   # P7 on top
    "reconcile": "reconcile",                             # J1
}


def run_once(spark, fn, sf_dir: str) -> float:
    t0 = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def plan_once(spark, fn, sf_dir: str) -> float:
    t0 = time.perf_counter()
    fn(spark, sf_dir)._jdf.queryExecution().executedPlan()
    return time.perf_counter() - t0


def multiplied(spark, sf_dir: str, factor: int) -> str:
    """A folder with ``factor`` copies of events; copies have ids and units of their own."""
    from pyspark.sql import functions as F
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    ids, users = events.agg(F.max("event_id") + 1, F.ceil((F.max("user_id") + 1) / 20) * 20).first()
    out = tempfile.mkdtemp(prefix="yieldlens-bench-")
    copy = F.explode(F.sequence(F.lit(0), F.lit(factor - 1))).alias("_copy")
    (events.select("*", copy).withColumn("event_id", F.col("event_id") + F.col("_copy") * ids)
     .withColumn("user_id", F.col("user_id") + F.col("_copy") * users).drop("_copy")
     .repartition(2 * spark.sparkContext.defaultParallelism).write.parquet(f"{out}/events.parquet"))
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "4"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(2, cpus * 2),
                          app_name="yieldlens-bench")
    qs = registry.queries()
    factor = int(os.environ.get("BENCH_FACTOR", "1"))
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    if factor > 1:
        sf_dir = multiplied(spark, sf_dir, factor)
    for name in HEADLINE.values():                              # warm-up pass: JIT, code generation
        run_once(spark, qs[name], sf_dir)
    times = {label: [] for label in HEADLINE}
    for _ in range(runs):                                       # interleaved timed rounds
        for label, name in HEADLINE.items():
            times[label].append(run_once(spark, qs[name], sf_dir))
    out = {label: round(statistics.median(ts), 3) for label, ts in times.items()}
    plan = {label: round(plan_once(spark, qs[name], sf_dir), 3) for label, name in HEADLINE.items()}
    print(json.dumps({"metric": "headline_total_median", "value": round(sum(out.values()), 3),
                      "unit": "sec", "queries": out, "plan": plan, "sf": sf, "factor": factor, "cpus": cpus,
                      "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()
