"""Spark session and scratch-location helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "dialoscope", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators are tuned for.

    On a cluster the submit-time settings win; this only fills in defaults
    that matter for correctness (UTC) and for skew (AQE).
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared location that ``spark.checkpoint.dir`` names.

    Without one there is no place that driver and executors both see, so it raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
