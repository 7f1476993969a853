"""A session with the settings that the operators assume."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_fallback: list[str] = []


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder all executors share (``spark.checkpoint.dir``).

    Where it is unset a local folder serves sessions whose executors are in this
    process; on a cluster it would be a different folder on each machine.
    """
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _fallback:
            _fallback.append("file://" + tempfile.mkdtemp(prefix="tallyflow-"))
        shared = _fallback[0]
    return f"{shared.rstrip('/')}/tallyflow-{uuid.uuid4().hex}/{tag}"


def session(master: str | None = None, app: str = "tallyflow", **settings: str) -> SparkSession:
    """UTC, adaptive execution with skew joins; ``settings`` use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    for key, value in (defaults | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
