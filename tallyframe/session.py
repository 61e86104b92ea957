"""Session settings the operators are tuned for, and the shared scratch folder."""

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Plans over many columns are built several times faster without call sites.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # Sessions of arriving rows are combined before they are shuffled.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    # Hot-key detection scans the key columns before its result is broadcast.
    "spark.sql.broadcastTimeout": "3600",
}


def build_session(app_name="tallyframe", master=None, **settings):
    """A session with the library's settings; ``settings`` use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()


_local_root = None


def _local_folder():
    """One temporary folder of this process, gone when it ends."""
    global _local_root
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="tallyframe-")
        atexit.register(shutil.rmtree, _local_root, ignore_errors=True)
    return _local_root


def shared_folder(spark, purpose):
    """A fresh path below ``spark.checkpoint.dir``, which every executor can reach.

    Only where that is unset and driver and executors are one machine, as in tests,
    is it a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("Set spark.checkpoint.dir to a folder all executors share.")
        root = _local_folder()
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
