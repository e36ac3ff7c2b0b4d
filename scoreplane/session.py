"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


# Execution settings for data-sized inputs. The planner never broadcasts a
# side on its static size estimate (file sizes, which say nothing about a
# filtered, joined or decompressed input); AQE turns a shuffle join into a
# broadcast join only after the small side's shuffle has been written and
# its measured size is under the adaptive threshold. Explicit broadcasts are
# kept for rule tables whose row count is checked (``rules.MAX_RULE_ROWS``)
# and for one-row totals.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
}


def build_session(master: str | None = None, app: str = "scoreplane",
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Session with AQE on, UTC session zone and the UI off.

    ``shuffle_partitions`` is only an upper bound: AQE coalesces small
    partitions at run time and splits skewed ones in joins.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **SCALE_CONF,
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    Reads ``spark.checkpoint.dir``. Only a local-mode session (tests, one
    machine) without it gets a fresh scratch folder; on a cluster a
    machine-local folder would scatter checkpoints over executor disks, so
    a missing setting raises instead.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if d:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(d)
        return d.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: name a shared folder (HDFS, object store) "
                           "that every executor can read and write")
    d = tempfile.mkdtemp(prefix="scoreplane-ckpt-")
    spark.sparkContext.setCheckpointDir(d)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder for written tables."""
    import uuid

    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")
