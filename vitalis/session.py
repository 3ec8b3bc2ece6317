"""Session helpers: one place for the configuration every job relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the operators assume.  Timestamps are compared in UTC so that
# hour arithmetic matches the oracle; AQE re-plans joins from runtime sizes
# (broadcast only when the measured side is small) and splits skewed
# partitions of sort-merge joins.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.scheduler.mode": "FAIR",     # concurrent fits share the cluster; one job at a time is unaffected
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None, app: str = "vitalis") -> SparkSession:
    """Build (or reuse) a session with the engine's defaults.

    Shuffle partitions and driver memory are the cluster's to set; they change
    only when asked for (an argument, ``VITALIS_DRIVER_MEMORY``)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    memory = os.environ.get("VITALIS_DRIVER_MEMORY", "16g" if (master or "").startswith("local") else None)
    if memory:
        conf["spark.driver.memory"] = memory
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    The folder comes from ``spark.checkpoint.dir``.  Only a session in one
    process (``local[...]``, as in tests) may do without: it gets a scratch
    folder.  On a cluster a folder of the driver's machine would be out of the
    executors' reach, so a missing setting is an error there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="vitalis-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured
