"""Session helpers.

The library never creates a session behind the caller's back; these helpers
are for tests, the bench and command-line use. ``checkpoint_dir`` honours the
cluster's ``spark.checkpoint.dir``; only a local-mode session without one gets a temporary folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

# Settings that matter at any scale: AQE re-plans joins and coalesces
# partitions at runtime, skew-join splitting is on, and all event times are
# naive local wall-clock values, so the session zone is pinned to UTC.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # The text-parsing plans carry large expression trees (the whole TH4
    # parse is built-in expressions); constraint inference over them costs
    # tens of seconds of driver time per query and prunes nothing.
    "spark.sql.constraintPropagation.enabled": "false",
    # reliable checkpoints of intermediate results are removed once unused
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def tune_for_parsing(spark: SparkSession) -> None:
    """Switch off constraint inference for the parse plans (see above); it holds for the session. One that
    refuses the change keeps its setting."""
    try:
        spark.conf.set("spark.sql.constraintPropagation.enabled", "false")
    except AnalysisException:
        pass


def scratch(spark: SparkSession) -> str:
    """A fresh folder in the shared checkpoint location (never machine-local
    on a cluster: ``spark.checkpoint.dir`` names the shared folder)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/yieldlens-run-{uuid.uuid4().hex}"


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "yieldlens", extra: dict | None = None) -> SparkSession:
    builder = (SparkSession.builder.master(master).appName(app_name)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", "8g"))
    for key, value in {**RECOMMENDED_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder that the cluster names in ``spark.checkpoint.dir``. Where it
    is unset, a local-mode session (tests, one machine) gets a temporary folder; any other
    session fails, because a machine's own folder is not shared."""
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        return current
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="yieldlens-ckpt-"))
    return sc.getCheckpointDir()
