"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that every job here relies on. Sizes (memory, partitions, executors) stay with the caller.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # plans here have hundreds of expressions; recording a Python stack for each takes longer than building it
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app_name: str = "karavel", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; ``conf`` takes further ones with ``__`` for a dot."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


_local_root: str | None = None


def shared_folder(spark: SparkSession, *parts: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``, which all executors can reach.

    Only a local master may go without the setting; it then gets a folder of this process. On a
    cluster a machine-local folder would lose data with its executor, so that is an error.
    """
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if _local_root is None:
            _local_root = tempfile.mkdtemp(prefix="karavel-")
        root = _local_root
    return os.path.join(root, *parts, uuid.uuid4().hex)
