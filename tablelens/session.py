"""Session defaults and shared-folder helpers.

Every operator takes an existing ``SparkSession`` (through its DataFrame);
this module only supplies defaults for sessions we create ourselves (tests,
bench) and a helper that finds the shared folder for written tables.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every session should carry. Cluster launchers may override them.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # one aggregation computes many statistics at once (profile, describe,
    # correlation); keep it inside whole-stage codegen past 100 buffer fields
    "spark.sql.codegen.maxFields": "2000",
}


def get_session(master: str = "local[8]", shuffle_partitions: int = 8,
                app_name: str = "tablelens", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the library defaults.

    Only used by tests and the bench; a cluster job passes its own session.
    """
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "8g")
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder named in ``spark.checkpoint.dir``.

    On a cluster this setting names a folder every executor can reach and is
    left as it is. Only in local mode with the setting unset (tests) do we set our own.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="tablelens-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    sc.setCheckpointDir(local)
    return local


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for a written intermediate table."""
    base = ensure_checkpoint_dir(spark)
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def apply_defaults(spark: SparkSession) -> None:
    """Set the runtime-settable defaults on an existing session."""
    for k in ("spark.sql.session.timeZone", "spark.sql.adaptive.enabled",
              "spark.sql.codegen.maxFields",
              "spark.sql.adaptive.skewJoin.enabled",
              "spark.sql.execution.arrow.pyspark.enabled"):
        try:
            spark.conf.set(k, DEFAULT_CONF[k])
        except Exception:  # some settings are static on shared clusters
            pass
