"""Session factory and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "tripflow", master: str | None = None, **conf) -> SparkSession:
    """Session with wall-clock timestamps and adaptive execution.

    ``master`` stays unset on a cluster, where spark-submit names it.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.ui.enabled": "false",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.sql.timestampType": "TIMESTAMP_NTZ",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def sibling(spark: SparkSession, **conf) -> SparkSession:
    """Another session of the same application, with the settings of this one except those given."""
    other = spark.newSession()
    for key, value in {**spark.conf.getAll, **conf}.items():
        if spark.conf.isModifiable(key):
            other.conf.set(key, value)
    return other


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new, not yet existing path in the folder all executors can reach.

    The cluster names that folder in ``spark.checkpoint.dir``. Only a local
    session may fall back to a temporary folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="tripflow-")
    return os.path.join(root, f"{purpose}-{uuid.uuid4().hex}")
